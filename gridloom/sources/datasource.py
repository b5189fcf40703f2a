"""Tiled GeoTIFF files as a data source: ``spark.read.format("tiled_tiff")`` and ``df.write.format("tiled_tiff")``, once
register(spark) was called.

Reading: rows are tiles. The path is a file or a folder of them, ``paths`` a JSON list; ``bands`` (such as "3,1") says which
bands are read. Filters on src, level, ty, tx and band are pushed into the reader, which opens only the files and reads only
the byte ranges that pass. A file is a partition, or with the option ``stripes`` as many, dealt by rows of tiles; headers are
read in the tasks. Writing: a folder of files, one for each block of a grid (see blocks()): tasks write files aside, and
the job's commit moves those of the attempts that won in; what failed or was tried twice leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from gridloom.plans.spec import OutGrid
from gridloom.sources import tiff

TILES = "src string, level int, ty int, tx int, band int, row0 long, col0 long, w int, data array<double>"
FORMAT = "tiled_tiff"

#: What a pushed filter asks of a value that is never null.
TESTS: dict[type, Callable] = {
    D.EqualTo: lambda value, wanted: value == wanted,
    D.In: lambda value, wanted: value in wanted,
    D.GreaterThan: lambda value, wanted: value > wanted,
    D.GreaterThanOrEqual: lambda value, wanted: value >= wanted,
    D.LessThan: lambda value, wanted: value < wanted,
    D.LessThanOrEqual: lambda value, wanted: value <= wanted,
}


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str) -> list[str]:
    """The path itself, or the .tif files of a folder, by name; what begins with a dot or an underscore isn't one."""
    from pyarrow import fs

    system, inner = _system(path)
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and f.extension.lower() in ("tif", "tiff") and f.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{n}" for n in names]


@dataclass
class Stripe(D.InputPartition):
    src: str
    number: int


class TileReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.stripes = int(options.get("stripes", 1))
        self.kept: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            wanted = getattr(f, "value", None)
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, D.IsNotNull) and column in ("src", "level", "ty", "tx", "band"):
                continue  # none of these is ever null
            if type(f) in TESTS and column in ("src", "level", "ty", "tx", "band") and wanted is not None:
                self.kept.append((type(f), column, wanted))
            else:
                yield f

    def passes(self, column: str, value) -> bool:
        return all(TESTS[kind](value, wanted) for kind, name, wanted in self.kept if name == column)

    def partitions(self) -> list[Stripe]:
        found = [src for path in self.paths for src in listed(path) if self.passes("src", src)]
        return [Stripe(src, n) for src in found for n in range(self.stripes)]

    def read(self, partition: Stripe):
        import pyarrow as pa

        kinds = dict(zip([x.split(" ")[0] for x in TILES.split(", ")], [pa.string(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64())], strict=True))
        schema = pa.schema([pa.field(n, t) for n, t in kinds.items()])
        with tiff.open_file(partition.src) as f:
            found = tiff.directories(f)
            for level, own in enumerate(found[1], 1):
                if not self.passes("level", level):
                    continue
                if "tile_width" not in own:
                    raise ValueError(f"{partition.src} is not tiled")
                wide, high = own["tile_width"][0], own["tile_height"][0]
                bands = [b for b in self.bands or range(1, own["bands"][0] + 1) if b <= own["bands"][0] and self.passes("band", b)]
                across = [x for x in range(-(-own["width"][0] // wide)) if self.passes("tx", x)]
                down = [y for y in range(-(-own["height"][0] // high)) if y % self.stripes == partition.number and self.passes("ty", y)]
                try:
                    fill = float(found[1][0].get("nodata") or 0)
                except ValueError:
                    fill = 0.0
                for y in down if bands and across else []:
                    # A row of tiles at a time is held.
                    rows = [(partition.src, level, y, left // wide, b, top, left, w, data) for b, top, left, w, data in tiff.tiles_of(f, found, level, [(y, x) for x in across], bands, fill)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Written(D.WriterCommitMessage):
    files: list[tuple[str, str]]


class BlockWriter(D.DataSourceArrowWriter):
    """Rows are packed tiles (tiff.PACKED) whose name is that of their block; rows of one block follow each other."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.grid, self.layout = OutGrid(**json.loads(options["grid"])), tiff.Layout(**json.loads(options["layout"]))
        self.bands, self.levels, self.block = int(options["bands"]), int(options["levels"]), int(options["block"])
        self.aside = f"{self.path}/_aside-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, inner = _system(self.aside)
        system.create_dir(inner, recursive=True)
        done, name, have = [], None, {}

        def end() -> None:
            if name is not None:
                staged = f"{inner}/{name}-{task.partitionId()}-{task.taskAttemptId()}"
                head, bodies = tiff.laid_out(self.block_grid(name), self.layout, self.bands, self.levels, have)
                with system.open_output_stream(staged) as f:
                    f.write(head)
                    for body in reversed(bodies):
                        for x in body:
                            f.write(x)
                done.append((staged, f"{name}.tif"))

        for batch in iterator:
            for r in (batch.slice(n, 1).to_pylist()[0] for n in range(batch.num_rows)):
                if r["name"] != name:
                    end()
                    name, have = r["name"], {}
                have[(r["level"], r["band"], r["ty"], r["tx"])] = r["data"]
        end()
        if len({n for _, n in done}) < len(done):
            raise ValueError("rows of one block must follow each other; sort them by name")
        return Written(done)

    def block_grid(self, name: str) -> OutGrid:
        g, (br, bc) = self.grid, (int(x) for x in name.removeprefix("block_").split("_"))
        return replace(g, xmin=g.xmin + bc * self.block * g.xres, ymax=g.ymax - br * self.block * g.yres, width=min(self.block, g.width - bc * self.block), height=min(self.block, g.height - br * self.block))

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = _system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        system.create_dir(inner, recursive=True)
        if len({n for _, n in files}) < len(files):
            self.abort(messages)
            raise ValueError("a block came from two tasks; repartition rows by name")
        new = {n for _, n in files}
        for old in listed(self.path) if self.overwrite else []:
            if old.rpartition("/")[2] not in new:
                system.delete_file(f"{inner}/{old.rpartition('/')[2]}")
        for staged, name in files:
            system.move(staged, f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, inner = _system(self.aside)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)


class TiledTiff(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters into it."""
    from gridloom.sources.shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiledTiff)


def write_blocks(cells: DataFrame, grid: OutGrid, bands: int, path: str, block: int = 8192, layout: tiff.Layout | None = None, overviews: int = 0, reduce: str = "average", overwrite: bool = True) -> str:
    """Cells (band, orow, ocol, value) as a folder of tiled files, one for each block x block cells of the grid that has any
    (block_<row>_<column>.tif): many tasks write, and one commit shows them. A task holds a block's packed tiles. Without
    overwrite, files of other blocks stay. block must be whole tiles, and cells of the coarsest overview."""
    layout = layout or tiff.Layout()
    if block < 1 or block % layout.tile or block % 2**overviews:
        raise ValueError("a block must be whole tiles, and cells of the coarsest overview")
    register(cells.sparkSession)
    br, bc = F.expr(f"orow div {block}"), F.expr(f"ocol div {block}")
    own = cells.select(F.concat_ws("_", F.lit("block"), br, bc).alias("name"), "band", (F.col("orow") % block).alias("orow"), (F.col("ocol") % block).alias("ocol"), "value")
    packed = tiff.pack(own, layout, overviews, reduce)
    rows = packed.repartition("name").sortWithinPartitions("name")
    options = {"grid": json.dumps(asdict(grid)), "layout": json.dumps(asdict(layout)), "bands": bands, "levels": overviews + 1, "block": block}
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").options(**options).save(path)
    return path
