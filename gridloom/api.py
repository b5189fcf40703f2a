"""Requests from end to end: sources in, an output grid's cells, arrays or files out.

A catalog (sources()) holds the headers, read once; cache() it to reuse it. A request (WarpSpec) is checked before any job,
planned over the catalog alone, and only the tiles that its windows touch are read. Cells, arrays and files are north-up.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import raster, stack
from gridloom.operators.warp import covered_blocks, dense, dense_blocks, mosaic, warp_windows
from gridloom.plans import windows as W
from gridloom.plans.preflight import preflight as _preflight
from gridloom.plans.spec import OutGrid, WarpSpec, methods_for
from gridloom.sources import datasource, tiff
from gridloom.sources.shipping import ship
from gridloom.streaming import batch as groups


def sources(spark: SparkSession, paths: list[str] | DataFrame, strict: bool = True) -> DataFrame:
    """The catalog of paths, or of a table (src, src_idx, and whatever else). Sends the package to the executors first."""
    ship(spark)
    return tiff.catalog(paths if isinstance(paths, DataFrame) else tiff.numbered(spark, paths), strict)


@dataclass(frozen=True)
class Warped:
    """cells (band, orow, ocol, value) that have a value, on their grid; nodata is that of the first source. copied, if a
    single source isn't resampled, is its window and the bands: then write() may copy tiles instead of cells."""

    cells: DataFrame
    grid: OutGrid
    bands: int
    nodata: float | None
    labels: list[str] | None = None
    copied: tuple[DataFrame, list[int]] | None = None
    windows: DataFrame | None = None
    held: DataFrame | None = None

    def release(self) -> None:
        """Lets go of the windows that were held; to_numpy() and write() do so themselves. What is used again is planned again."""
        if self.held is not None:
            self.held.unpersist()

    def dense(self) -> DataFrame:
        """Every cell; those without a value get nodata, else 0."""
        return dense(self.cells, self.grid, list(range(1, self.bands + 1)), self.nodata)

    def dense_where_covered(self, block: int = 256) -> DataFrame:
        """dense() in the blocks of the grid that lie under a source, and no cell elsewhere."""
        return dense_blocks(self.cells, covered_blocks(self.windows, self.grid, block), self.grid, list(range(1, self.bands + 1)), self.nodata, block)

    def to_numpy(self, most_bytes: float = 1e9):
        """bands x height x width; raises before anything is collected if that is larger than most_bytes."""
        out = raster.to_numpy(self.cells, self.grid.width, self.grid.height, self.bands, most_bytes, 0.0 if self.nodata is None else self.nodata)
        self.release()
        return out

    def write(self, path: str, dtype: str | None = None, tile: int | None = None, compress: str | None = None, overviews: int = 0, reduce: str = "average") -> str:
        """A tiled GeoTIFF at the path, which is returned. An existing one is replaced. What is copied from one source without
        resampling keeps its source's tiles as they are, where these fit and no other dtype, tile, compress (default: float64,
        256, deflate) or overview is asked for."""
        if (dtype, tile, compress, overviews) == (None, None, None, 0) and self.labels is None and self._copy(path):
            self.release()
            return path
        spark = self.cells.sparkSession
        named = self.cells.withColumn("name", F.lit(path))
        labels = spark.createDataFrame([(path, b, t) for b, t in enumerate(self.labels or [], 1)], "name string, band int, label string")
        whole = spark.createDataFrame([(path, self.bands)], "name string, bands int")
        tiff.write(named, self.grid, None, whole, dtype=dtype or "float64", tile=tile or 256, nodata=self.nodata, compress=compress or "deflate", labels=labels, overviews=overviews, reduce=reduce).collect()
        self.release()
        return path

    def write_blocks(self, folder: str, block: int = 8192, dtype: str = "float64", tile: int = 256, overviews: int = 0, reduce: str = "average") -> str:
        """As write(), but a folder of files, one for each block x block cells that have a value, put together by many tasks
        (sources/datasource.py): for grids that are too large for a task to join. Its files are the sources of a mosaic."""
        datasource.write_blocks(self.cells, self.grid, self.bands, folder, block, tiff.Layout(dtype, tile, 8, 1, self.nodata), overviews, reduce)
        self.release()
        return folder

    def _copy(self, path: str) -> bool:
        """Whether the file was made of its source's own tiles."""
        if self.copied is None:
            return False
        planned, bands = self.copied
        r = planned.select("src", "level", "xoff", "yoff", "xsize", "ysize", "n_bands").first()
        layout = tiff.copy_layout(r.src, r.level, (r.xoff, r.yoff, r.xsize, r.ysize), self.nodata)
        if layout is None or max(bands) > r.n_bands:
            return False
        whole = planned.sparkSession.createDataFrame([(path, 0, self.bands, -2, 0, bytearray())], tiff.PACKED)
        tiff.files_of(tiff.copied_tiles(planned, bands, layout, path).unionByName(whole), self.grid, layout, None, None, 1).collect()
        return True


def _copied(planned: DataFrame) -> OutGrid | None:
    """The windows' own grid, if they are all copies (nothing is resampled) on a single one."""
    found = planned.select("is_copy", "win_gt", "xsize", "ysize", "crs").distinct().head(2)
    if len(found) != 1 or not found[0].is_copy:
        return None
    r, gt = found[0], found[0].win_gt
    straight = gt.gt2 == 0 and gt.gt4 == 0 and gt.gt1 > 0 and gt.gt5 < 0
    return OutGrid(gt.gt0, gt.gt3, gt.gt1, -gt.gt5, r.xsize, r.ysize, r.crs) if straight else None


def _planned(catalog: DataFrame, spec: WarpSpec, strict: bool = True) -> tuple[DataFrame, OutGrid]:
    """The windows, within the request's limit, and the output grid. Windows cover the grid, which tap may have moved out. They
    are held (a row a source), as several small jobs look at them; Warped.release() lets go of them."""
    sound = catalog if strict else catalog.where(W.problem(spec).isNull())
    grid = None
    if not (spec.tr or spec.ts):
        planned = W.require_overlap(W.plan(sound, spec).persist())
        grid = _copied(planned)
        if grid is None:
            planned.unpersist()
    if grid is None:
        planned, grid = W.plan_on_grid(sound, spec)
        planned = W.require_overlap(planned.persist())
    return W.require_limit(planned), grid


def _chosen(planned: DataFrame, spec: WarpSpec) -> list[int]:
    return list(spec.bands) or list(range(1, planned.agg(F.max("n_bands")).first()[0] + 1))


def _nodata(planned: DataFrame) -> float | None:
    return planned.agg(F.min_by("nodata", "src_idx")).first()[0]


def warp(catalog: DataFrame, spec: WarpSpec) -> Warped:
    """All sources on one grid; where they overlap, the last one's valid value counts."""
    planned, grid = _planned(catalog, spec)
    bands = _chosen(planned, spec)
    cells = mosaic(warp_windows(tiff.read_pixels(planned, bands), W.as_catalog(planned), grid, spec.method))
    single = (planned, bands) if spec.tr is None and spec.ts is None and _copied(planned) and planned.count() == 1 else None
    return Warped(cells, grid, len(bands), _nodata(planned), copied=single, windows=W.as_catalog(planned), held=planned)


def _by_method(pixels: DataFrame, windows: DataFrame, grid: OutGrid) -> DataFrame:
    """Each window by its own method: a branch for each distinct one."""
    parts = []
    for method in sorted(r[0] for r in windows.select("method").distinct().collect()):
        own = windows.where(F.col("method") == method).drop("method")
        parts.append(warp_windows(pixels.join(own.select("src_idx"), "src_idx", "left_semi"), own, grid, method))
    return reduce(DataFrame.unionByName, parts)


def stacked(catalog: DataFrame, spec: WarpSpec, r: str | list[str] | None = None, labels: list[str] | None = None) -> Warped:
    """Each source's bands as bands of their own, in the order of src_idx. r is a method, or one for each source; labels
    name the bands, and must be as many. A source that the request doesn't overlap is left out."""
    planned, grid = _planned(catalog, spec)
    methods = methods_for(r or spec.method, catalog.count() if isinstance(r, list) and len(r) > 1 else 1)
    at = F.row_number().over(Window.orderBy("src_idx")) - 1 if len(methods) > 1 else F.lit(0)
    named = catalog.select("src_idx", F.get(F.array(*map(F.lit, methods)), at).alias("method"))
    windows = W.as_catalog(planned).join(named, "src_idx")
    windows = windows.withColumn("n_bands", F.lit(len(spec.bands))) if spec.bands else windows
    offsets = stack.band_offsets(windows)
    total = windows.agg(F.sum("n_bands")).first()[0]
    pixels = tiff.read_pixels(planned, _chosen(planned, spec))
    cells = _by_method(pixels, windows, grid).join(offsets.select("src_idx", "band_offset"), "src_idx")
    cells = cells.select((F.col("band") + F.col("band_offset")).cast("long").alias("band"), "orow", "ocol", "value")
    return Warped(cells, grid, total, _nodata(planned), stack.label_list(windows, total, labels), windows=W.as_catalog(planned), held=planned)


def batch(catalog: DataFrame, spec: WarpSpec, template: str | None = None, stack_groups: bool = False, dtype: str = "float64", tile: int = 256, compress: str = "deflate") -> DataFrame:
    """Groups of sources to files on one grid: group_idx (and band_pos), path, error and n_windows of each output.

    The catalog (sources() that aren't strict) also has group_idx and band_pos, and may have group_name and band_name for
    the template ``dir/stem.ext``, or ``out``, a path for each output; and ``method``. An output is a source, or with
    stack_groups a whole group. A source that can't be read costs its output, or its group; one that the request doesn't
    overlap has no output, or is left out of its group. Such outputs have no path."""
    ship(catalog.sparkSession)
    for name in ("group_name", "band_name"):
        catalog = catalog if name in catalog.columns else catalog.withColumn(name, F.lit(None).cast("string"))
    keys = ["group_idx"] if stack_groups else ["group_idx", "band_pos"]
    outputs = groups.explicit_paths(catalog, stack_groups) if "out" in catalog.columns else groups.output_paths(catalog, template, stack_groups)
    outputs = groups.require_distinct(outputs).drop("n_same")
    method = F.coalesce("method", F.lit(spec.method)) if "method" in catalog.columns else F.lit(spec.method)
    own = catalog.select("src_idx", "group_idx", "band_pos", method.alias("method"))
    unfit = _preflight(catalog, spec).where("error is not null").select("src_idx", "error").persist()
    planned, grid = _planned(catalog.join(unfit.select("src_idx"), "src_idx", "left_anti"), spec, strict=False)
    bands = _chosen(planned, spec)
    tiles = tiff.read_tiles(planned, bands).persist(StorageLevel.DISK_ONLY)  # read once, looked at for errors first; see release
    unread = tiles.where("error is not null").groupBy("src_idx").agg(F.min("error").alias("error"))
    failed = unread.unionByName(unfit).join(own, "src_idx").groupBy(*keys).agg(F.min("error").alias("error"))
    sound = planned.join(own, "src_idx").join(failed.select(*keys), keys, "left_anti")
    named = sound.join(outputs, keys)
    n = F.lit(len(spec.bands)) if spec.bands else F.col("n_bands")
    before = Window.partitionBy("path").orderBy("band_pos", "src_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.select("src_idx", "src", "method", "path", n.alias("n_bands"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("band_offset"))
    windows = W.as_catalog(planned).join(placed.select("src_idx", "method"), "src_idx")
    if windows.isEmpty():
        made = outputs.select(F.col("path").alias("made")).limit(0)
    else:
        pixels = tiff.pixels_of(tiles.where("error is null").join(placed.select("src_idx"), "src_idx", "left_semi"), planned, bands)
        cells = _by_method(pixels, windows, grid).join(placed.select("src_idx", "path", "band_offset"), "src_idx")
        values = cells.select(F.col("path").alias("name"), (F.col("band") + F.col("band_offset")).cast("int").alias("band"), "orow", "ocol", "value")
        whole = placed.groupBy(F.col("path").alias("name")).agg(F.sum("n_bands").cast("int").alias("bands"))
        labels = placed.withColumn("b", F.explode(F.sequence(F.lit(1), F.col("n_bands")))).select(F.col("path").alias("name"), (F.col("b") + F.col("band_offset")).alias("band"), stack.label(F.col("src"), F.col("n_bands"), F.col("b")).alias("label"))
        made = tiff.write(values, grid, None, whole, dtype=dtype, tile=tile, nodata=_nodata(planned), compress=compress, labels=labels if stack_groups else None).select(F.col("path").alias("made"))
    need = planned.join(own, "src_idx").groupBy(*keys).agg(F.count("*").alias("n_windows"))
    out = outputs.join(made, F.col("path") == F.col("made"), "left").join(failed, keys, "left").join(need, keys, "left")
    return out.select(*keys, F.col("made").alias("path"), "error", F.coalesce("n_windows", F.lit(0)).alias("n_windows"))


def preflight(catalog: DataFrame, spec: WarpSpec) -> DataFrame:
    """src_idx, src and error (null: none) of every source: what the request would fail on, before any tile is read."""
    return _preflight(catalog, spec)


def info(catalog: DataFrame) -> DataFrame:
    """Eight facts of each source, as text."""
    return W.described(catalog)
