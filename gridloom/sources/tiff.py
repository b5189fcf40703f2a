"""Tiled GeoTIFF files as a source and a sink.

Reading: a table of paths becomes a catalog (only headers are read, by range), and a table of planned tiles becomes pixels
(only the byte ranges of those tiles and bands are read). Spark deals paths and tiles to tasks; a task opens its files
through pyarrow's file systems (local, s3, gs, hdfs). A file that can't be read raises, or is a row whose ``error`` says
why. Writing: tiles are compressed in parallel, overviews are made level by level, and one task a file puts the tiles
together; tiles without a value take no bytes. A window that lies on its source's tiles is copied tile by tile, undecoded.
Compressions: none, deflate, zstd, LZW, PackBits; predictors: none, horizontal, floating point. Strips, and anything else,
are errors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import metadata as M
from gridloom.functions.crs import normalise, parameters
from gridloom.operators.raster import select_bands
from gridloom.plans.spec import OutGrid

# TIFF tags, field types, GeoTIFF keys.
TAGS = {254: "subfile", 256: "width", 257: "height", 258: "bits", 259: "compression", 277: "bands", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "sizes", 339: "format", 33550: "scale", 33922: "tie", 34264: "matrix", 34735: "keys", 34736: "doubles", 34737: "ascii", 42112: "xml", 42113: "nodata"}
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
RASTER_TYPE, CITATION, GEOGRAPHIC, GEOG_CITATION, PROJECTED, PROJ_CITATION, TRANSFORM = 1025, 1026, 2048, 2049, 3072, 3073, 3075
HEADER = "src string, src_idx int, width int, height int, n_bands int, bits int, format int, matrix array<double>, scale array<double>, tie array<double>, keys map<int,double>, texts map<int,string>, xml string, nodata_text string, levels array<struct<level:int,width:int,height:int,tile_width:int,tile_height:int>>, error string"


def open_file(path: str):
    from pyarrow import fs

    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path.removeprefix("file:")
    return system.open_input_file(inner)


def directories(f) -> tuple[str, list[dict]]:
    """Byte order and the image directories, full resolution first; masks are left out."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    head = at(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    where = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    found: list[dict] = []
    visited: set[int] = set()
    while where and where not in visited:  # a chain that leads back to itself ends there
        visited.add(where)
        n = struct.unpack(f"{order}{'Q' if big else 'H'}", at(where, 8 if big else 2))[0]
        size, start = (20, where + 8) if big else (12, where + 2)
        table = at(start, n * size + (8 if big else 4))
        own: dict = {"subfile": (0,), "compression": (1,), "bands": (1,), "planar": (1,), "predictor": (1,), "format": (1,), "bits": (1,)}
        for i in range(n):
            entry = table[i * size : (i + 1) * size]
            tag, kind, count = struct.unpack(f"{order}HH{'Q' if big else 'I'}", entry[: 12 if big else 8])
            if tag not in TAGS or kind not in FIELDS:
                continue
            width = struct.calcsize(FIELDS[kind].replace("II", "Q")) * count
            inline = entry[12:] if big else entry[8:]
            raw = inline[:width] if width <= len(inline) else at(struct.unpack(f"{order}{'Q' if big else 'I'}", inline)[0], width)
            own[TAGS[tag]] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else struct.unpack(f"{order}{count * len(FIELDS[kind])}{FIELDS[kind][0]}", raw)
        found.append(own)
        where = struct.unpack(f"{order}{'Q' if big else 'I'}", table[n * size :])[0]
    images = [d for d in found if not d["subfile"][0] & 4]
    return order, sorted(images, key=lambda d: -d["width"][0])


def geo_keys(own: dict) -> tuple[dict[int, float], dict[int, str]]:
    keys, numbers, texts = own.get("keys", (1, 1, 0, 0)), {}, {}
    for i in range(4, 4 + 4 * keys[3], 4):
        key, place, count, value = keys[i : i + 4]
        if place == 0:
            numbers[key] = float(value)
        elif place == 34736:
            numbers[key] = float(own["doubles"][value])
        elif place == 34737:
            texts[key] = own["ascii"][value : value + count].rstrip("|\0")
    return numbers, texts


def header(src: str) -> dict:
    """What the catalog needs of a file, as HEADER names it."""
    with open_file(src) as f:
        _, images = directories(f)
    if not images:
        raise ValueError("no image directory")
    own = images[0]
    numbers, texts = geo_keys(own)
    sizes = lambda d: {"width": d["width"][0], "height": d["height"][0], "tile_width": d.get("tile_width", (None,))[0], "tile_height": d.get("tile_height", (None,))[0]}
    levels = [{"level": i, **sizes(d)} for i, d in enumerate(images, 1)]
    floats = {k: list(map(float, own.get(k, ()))) for k in ("matrix", "scale", "tie")}
    return {"width": own["width"][0], "height": own["height"][0], "n_bands": own["bands"][0], "bits": own["bits"][0], "format": own["format"][0], **floats, "keys": numbers, "texts": texts, "xml": own.get("xml"), "nodata_text": own.get("nodata"), "levels": levels}


def catalog(paths: DataFrame, strict: bool = True) -> DataFrame:
    """The catalog of the files in ``paths`` (src, src_idx, and whatever else, which stays). A path may come twice. One that
    can't be read raises, or if not strict is a row of nulls with an error."""
    names = [x.split(" ")[0] for x in HEADER.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for src, idx in zip(rows.src, rows.src_idx, strict=True):
                try:
                    out.append({"src": src, "src_idx": idx, **header(src), "error": None})
                except Exception as e:
                    if strict:
                        raise ValueError(f"{src}: {e}") from e
                    out.append(dict.fromkeys(names) | {"src": src, "src_idx": idx, "error": f"{src}: {e}"})
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({n: "Int32" for n in ("width", "height", "n_bands", "bits", "format")})

    read = paths.select("src", "src_idx").mapInPandas(run, HEADER)
    key = lambda *ks: F.coalesce(*[F.try_element_at("keys", F.lit(k)) for k in ks])
    code = lambda k: key(k).cast("int")
    meridian, ellps = M.prime_meridian(code(2051), key(2061)), M.ellipsoid(code(2056), key(2057), key(2058), key(2059))
    proj = M.proj_string(code(TRANSFORM), key(3080, 3088, 3084, 3095), key(3081, 3089, 3085), key(3082, 3086), key(3083, 3087), key(3078), key(3079), key(3092), meridian, ellps)
    proj = F.coalesce(proj, M.degrees_string(code(1024), code(GEOGRAPHIC), meridian, ellps))
    name = M.crs(F.coalesce(code(PROJECTED), code(GEOGRAPHIC)), [F.try_element_at("texts", F.lit(k)) for k in (PROJ_CITATION, GEOG_CITATION, CITATION)], proj)
    done = read.select(
        "src", "src_idx", "width", "height", "n_bands", M.dtype(F.col("format"), F.col("bits")).alias("dtype"), M.nodata(F.col("nodata_text")).alias("nodata"), name.alias("crs"),
        M.geotransform(F.col("matrix"), F.col("scale"), F.col("tie"), F.coalesce(code(RASTER_TYPE), F.lit(1))).alias("gt"), M.band_names(F.col("xml"), F.col("n_bands")).alias("band_names"), "levels", "error",
    )
    more = [c for c in paths.columns if c not in ("src", "src_idx")]
    return done.join(paths.select("src_idx", *more), "src_idx") if more else done


def unpacked_lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; their width grows one code early, as TIFF has it."""
    clear, end = 256, 257
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, held, bits, at, width, before = [], 0, 0, 0, 9, b""
    while True:
        while bits < width and at < len(raw):
            held, bits, at = (held << 8 | raw[at]) & 0xFFFFFFFF, bits + 8, at + 1
        if bits < width:
            return b"".join(out)
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == end:
            return b"".join(out)
        if code == clear:
            del table[258:]
            width, before = 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("damaged LZW data")
        now = table[code] if code < len(table) else before + before[:1]
        out.append(now)
        if before:
            table.append(before + now[:1])
        before = now
        width = min(12, max(9, (len(table) + 1).bit_length()))


def unpacked_bits(raw: bytes) -> bytes:
    """PackBits: runs of literals and of repeats."""
    out, at = [], 0
    while at < len(raw):
        n, at = raw[at], at + 1
        if n < 128:
            out.append(raw[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(raw[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


DECODERS = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits, 50000: _zstd}


def decode(raw: bytes, own: dict, order: str, bands: int) -> np.ndarray:
    """tile_height x tile_width x bands."""
    how, predictor, bits = own["compression"][0], own["predictor"][0], own["bits"][0]
    if how not in DECODERS:
        raise ValueError(f"unsupported compression {how}")
    if len(set(own["bits"])) > 1 or len(set(own["format"])) > 1:
        raise ValueError("bands of different sample types")
    raw = DECODERS[how](raw)
    h, w, kind = own["tile_height"][0], own["tile_width"][0], {1: "u", 2: "i", 3: "f"}.get(own["format"][0])
    line = -(-w * bands * bits // 8)
    if len(raw) != h * line:
        raise ValueError(f"a tile of {len(raw)} bytes instead of {h * line}")
    if bits == 1 and predictor == 1:
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(h, line), axis=1)[:, : w * bands].reshape(h, w, bands)
    if bits % 8 or kind is None or predictor not in (1, 2, 3) or (predictor == 3 and kind != "f"):
        raise ValueError("unsupported samples or predictor")
    if predictor == 3:  # bytes of a line by significance, each the difference to the one a pixel before
        sums = np.cumsum(np.frombuffer(raw, np.uint8).reshape(h, -1, bands), axis=1, dtype=np.uint8)
        planes = sums.reshape(h, bits // 8, w * bands).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">f{bits // 8}").reshape(h, w, bands)
    tile = np.frombuffer(raw, np.dtype(f"{order}{kind}{bits // 8}")).reshape(h, w, bands)
    return np.cumsum(tile, axis=1, dtype=tile.dtype) if predictor == 2 else tile


def tiles_of(f, directory: tuple[str, list[dict]], level: int, places: list[tuple[int, int]], bands: list[int], fill: float) -> Iterator[tuple]:
    """(band, row, col, width, values) of each wanted tile and band, as far as they lie within the level."""
    order, images = directory
    own = images[level - 1]
    if "tile_width" not in own:
        raise ValueError("the file is not tiled")
    tw, th, width, height = (own[n][0] for n in ("tile_width", "tile_height", "width", "height"))
    across, apart = -(-width // tw), own["planar"][0] == 2
    per_band = across * -(-height // th)
    for ty, tx in places:
        whole = None
        for b in bands:
            n = ty * across + tx + ((b - 1) * per_band if apart else 0)
            if apart or whole is None:
                f.seek(own["offsets"][n])
                size = own["sizes"][n]
                # A tile without bytes is one that was never written.
                whole = decode(f.read(size), own, order, 1 if apart else own["bands"][0]) if size else np.full((th, tw, 1 if apart else own["bands"][0]), fill)
            data = whole[: height - ty * th, : width - tx * tw, 0 if apart else b - 1]
            yield b, ty * th, tx * tw, data.shape[1], data.astype(float).ravel()


def read_tiles(planned: DataFrame, bands: list[int]) -> DataFrame:
    """src_idx, band, row0, col0, w and data of the tiles that the planned windows touch, counted from the level's corner; of
    band-separate files only the wanted bands are read, as far as a source has them. What can't be read is a row with nothing but src_idx and error."""
    span = lambda off, size, tile: F.sequence(F.expr(f"{off} div {tile}"), F.expr(f"({off} + {size} - 1) div {tile}"))
    tiled = planned.withColumns({t: F.coalesce(t, F.lit(1 << 30)) for t in ("tile_width", "tile_height")})  # strips fail when read
    wanted = tiled.withColumn("ty", F.explode(span("yoff", "ysize", "tile_height"))).withColumn("tx", F.explode(span("xoff", "xsize", "tile_width")))
    wanted = wanted.select("src", "src_idx", "turn", "level", "ty", "tx", "n_bands", F.coalesce("nodata", F.lit(0.0)).alias("fill")).repartition("src", "ty", "tx")
    chosen, cols = sorted(set(bands)), ["src_idx", "turn", "band", "row0", "col0", "w", "data", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for (src, level, idx, turn), part in rows.groupby(["src", "level", "src_idx", "turn"]):
                out: list[tuple] = []
                try:
                    with open_file(src) as f:
                        places = list(zip(part.ty.tolist(), part.tx.tolist(), strict=True))
                        out = [(idx, turn, *t, None) for t in tiles_of(f, directories(f), level, places, [b for b in chosen if b <= part.n_bands.iloc[0]], float(part.fill.iloc[0]))]
                except Exception as e:
                    out = [(idx, turn, None, None, None, None, None, f"{src}: {e}")]
                yield pd.DataFrame(out, columns=cols).astype({c: "Int64" for c in ("band", "row0", "col0", "w")})

    return wanted.mapInPandas(run, "src_idx int, turn int, band int, row0 long, col0 long, w int, data array<double>, error string")


def pixels_of(tiles: DataFrame, planned: DataFrame, bands: list[int]) -> DataFrame:
    """The pixels of planned windows from their tiles, counted from the window's corner, bands in the order asked for, with
    the window's transform and nodata. A tile with an error raises."""
    sound = tiles.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(F.lit(True)))
    window = planned.select("src_idx", "turn", "xoff", "yoff", "xsize", "ysize", F.col("win_gt").alias("gt"), "nodata")
    own = ["src_idx", "turn", "band", "gt", "nodata"]
    each = sound.join(window, ["src_idx", "turn"]).select(*own, "row0", "col0", "w", "xoff", "yoff", "xsize", "ysize", F.posexplode("data").alias("at", "value"))
    row, col = F.col("row0") + F.expr("at div w") - F.col("yoff"), F.col("col0") + F.col("at") % F.col("w") - F.col("xoff")
    inside = each.withColumns({"row": row, "col": col}).where("col >= 0 and col < xsize and row >= 0 and row < ysize")
    return select_bands(inside.select("src_idx", "turn", "band", "row", "col", "value", "gt", "nodata"), bands)


def read_pixels(planned: DataFrame, bands: list[int]) -> DataFrame:
    """pixels_of() of the tiles that the planned windows (windows.plan) touch."""
    return pixels_of(read_tiles(planned, bands), planned, bands)


#: Tiles of a file as rows: level 0 is the full resolution.
PACKED = "name string, level int, band int, ty long, tx long, data binary"


@dataclass(frozen=True)
class Layout:
    """How a file's samples are stored: a numpy type, the side of its square tiles, and what TIFF calls compression and predictor."""

    dtype: str = "float64"
    tile: int = 256
    compression: int = 8
    predictor: int = 1
    nodata: float | None = None

    @property
    def kind(self) -> np.dtype:
        return np.dtype(self.dtype).newbyteorder("<")

    def packed(self, block: np.ndarray) -> bytes:
        """A tile of any numbers, whole ones to the nearest limit."""
        if self.kind.kind != "f":
            block = np.clip(np.nan_to_num(block), np.iinfo(self.kind).min, np.iinfo(self.kind).max)
        return ENCODERS[self.compression](block.astype(self.kind).tobytes())


ENCODERS = {1: bytes, 8: zlib.compress, 32946: zlib.compress}


def system_keys(name: str | None) -> tuple[list[int], list[float]]:
    """GeoTIFF keys of a coordinate system, and the doubles they refer to; those without a code by their parameters."""
    if name is None:
        return [1, 1, 0, 1, 1025, 0, 1, 1], []
    if name.startswith("EPSG:"):
        degrees, code = name == "EPSG:4326", int(name[5:])
        return [1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, code], []
    p = parameters(normalise(name))
    polar = abs(p.lat0) == 90
    # GeoTIFF codes of methods.
    method = {"tmerc": 1, "merc": 7, "lcc": 8, "laea": 10, "aea": 11, "stere": 15 if polar else 14, "eqc": 17, "sinu": 24, "cea": 28}.get(p.kind)
    if p.unit != 1 or (method is None and p.lon0) or (p.kind == "lcc" and p.k != 1):
        raise ValueError(f"{name!r} can't be written as GeoTIFF keys")
    whole = {1024: 2 if method is None else 1, 1025: 1, 2048: 32767, 2056: 32767}
    real = {2057: p.a, 2059: p.rf}
    if method is not None:
        whole |= {3072: 32767, 3074: 32767, TRANSFORM: method, 3076: 9001}
        real |= {3080: p.lon0, 3081: p.lat0, 3082: p.x0, 3083: p.y0}
        real |= {3078: p.lat1, 3079: p.lat2} if p.kind in ("lcc", "aea") else {3078: p.ts} if p.ts is not None else {3092: p.k} if p.kind in ("tmerc", "merc", "stere") else {}
    places = {k: n for n, k in enumerate(sorted(real))}
    entries = [x for k in sorted([*whole, *real]) for x in ((k, 0, 1, whole[k]) if k in whole else (k, 34736, 1, places[k]))]
    return [1, 1, 0, len(entries) // 4, *entries], [float(real[k]) for k in sorted(real)]


def directories_of(grid: OutGrid, layout: Layout, bands: int, bodies: list[list[bytes]], names: dict[int, str]) -> tuple[bytes, list[list[int]]]:
    """The head of a file with a directory for each level, full resolution first, and where the tiles go: those of the coarsest
    level follow the head. Tiles without bytes have no place."""
    kind, tile, per_level = layout.kind, layout.tile, []
    keys, doubles = system_keys(grid.crs)
    for level, body in enumerate(bodies):
        tags = [
            (254, 4, [1 if level else 0]), (256, 4, [-(-grid.width // 2**level)]), (257, 4, [-(-grid.height // 2**level)]), (258, 3, [kind.itemsize * 8] * bands), (259, 3, [layout.compression]), (262, 3, [1]), (277, 3, [bands]), (284, 3, [2]),
            *([(317, 3, [layout.predictor])] if layout.predictor != 1 else []), (322, 4, [tile]), (323, 4, [tile]), (324, 16, [0] * len(body)), (325, 4, [len(x) for x in body]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands),
        ]
        if not level:
            tags += [(33550, 12, [grid.xres, grid.yres, 0.0]), (33922, 12, [0.0, 0.0, 0.0, grid.xmin, grid.ymax, 0.0]), (34735, 3, keys), *([(34736, 12, doubles)] if doubles else [])]
            items = "".join(f'<Item name="DESCRIPTION" sample="{b - 1}" role="description">{escape(t)}</Item>' for b, t in sorted(names.items()))
            tags += [(42112, 2, [f"<GDALMetadata>{items}</GDALMetadata>\0".encode()])] if names else []
        tags += [(42113, 2, [f"{layout.nodata!r}\0".encode()])] if layout.nodata is not None else []
        per_level.append(tags)

    def laid(offsets: list[list[int]]) -> bytes:
        out = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16)
        for level, tags in enumerate(per_level):
            head, extra, free = [], b"", len(out) + 8 + 20 * len(tags) + 8
            for tag, field, vals in tags:
                vals = offsets[level] if tag == 324 else vals
                raw = vals[0] if field == 2 else struct.pack(f"<{len(vals)}{FIELDS[field]}", *vals)
                inline = raw.ljust(8, b"\0") if len(raw) <= 8 else struct.pack("<Q", free + len(extra))
                extra += raw if len(raw) > 8 else b""
                head.append(struct.pack("<HHQ", tag, field, len(raw) if field == 2 else len(vals)) + inline)
            follows = free + len(extra) if level + 1 < len(per_level) else 0
            out += struct.pack("<Q", len(tags)) + b"".join(head) + struct.pack("<Q", follows) + extra
        return out

    at, offsets = len(laid([[0] * len(body) for body in bodies])), [[0] * len(body) for body in bodies]
    for level in range(len(bodies) - 1, -1, -1):
        for n, x in enumerate(bodies[level]):
            if x:
                offsets[level][n], at = at, at + len(x)
    return laid(offsets), offsets


def laid_out(grid: OutGrid, layout: Layout, bands: int, levels: int, have: dict[tuple, bytes], names: dict[int, str] | None = None) -> tuple[bytes, list[list[bytes]]]:
    """A file's head, and the tiles of each level in their order, from tiles by (level, band, ty, tx)."""
    sizes = [(-(-grid.width // 2**v), -(-grid.height // 2**v)) for v in range(levels)]
    bodies = [[have.get((v, b, y, x), b"") for b in range(1, bands + 1) for y in range(-(-h // layout.tile)) for x in range(-(-w // layout.tile))] for v, (w, h) in enumerate(sizes)]
    return directories_of(grid, layout, bands, bodies, names or {})[0], bodies


def files_of(packed: DataFrame, grid: OutGrid, layout: Layout, folder: str | None, bands: int | None, levels: int) -> DataFrame:
    """(name, path, n_bytes) of the files that packed tiles (PACKED) make, one task a file. Tiles that aren't among them have no
    bytes in the file. Labels come as tiles of row -1, and numbers of bands, unless all have ``bands``, of row -2."""

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        have = {(r.level, r.band, r.ty, r.tx): bytes(r.data) for r in rows.itertuples()}
        names = {b: d.decode() for (_, b, y, _), d in have.items() if y == -1}
        n = bands if bands is not None else next(b for (_, b, y, _) in have if y == -2)
        head, bodies = laid_out(grid, layout, n, levels, have, names)
        path = rows["name"].iloc[0] if folder is None else f"{folder}/{rows['name'].iloc[0]}.tif"
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        if "/" in inner.strip("/"):
            system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as f:
            f.write(head)
            for body in reversed(bodies):
                for x in body:
                    f.write(x)
        return pd.DataFrame({"name": [rows["name"].iloc[0]], "path": [path], "n_bytes": [len(head) + sum(len(x) for body in bodies for x in body)]})

    return packed.groupBy("name").applyInPandas(assemble, "name string, path string, n_bytes long")


def pyramid(values: DataFrame, levels: int, reduce: str = "average") -> DataFrame:
    """values (name, band, orow, ocol, value; level 0) with ``levels`` - 1 more levels, each made of the one before: a cell is the
    mean of the up to four cells that have a value, or with ``near`` the first of them by row and column."""
    if reduce not in ("average", "near"):
        raise ValueError(f"unknown reduction {reduce!r}")
    now = values.withColumn("level", F.lit(0))
    out = now
    for level in range(1, levels):
        cell = ["name", "band", F.expr("orow div 2").alias("orow"), F.expr("ocol div 2").alias("ocol")]
        value = F.avg("value") if reduce == "average" else F.min_by("value", F.struct("orow", "ocol"))
        now = now.groupBy(*cell).agg(value.alias("value")).withColumn("level", F.lit(level))
        out = out.unionByName(now)
    return out


def pack(values: DataFrame, layout: Layout, overviews: int = 0, reduce: str = "average") -> DataFrame:
    """The tiles (PACKED) of name, band, orow, ocol and value, and of as many overviews (see pyramid)."""
    tile = layout.tile
    place = (F.col("orow") % tile) * tile + F.col("ocol") % tile
    cells = pyramid(values.select("name", "band", F.col("orow").cast("long").alias("orow"), F.col("ocol").cast("long").alias("ocol"), F.col("value").cast("double").alias("value")), overviews + 1, reduce)
    own = ["name", "level", "band", "ty", "tx"]
    # One key, no part of which is a constant by itself, so that both groupings share a shuffle.
    key = F.struct(*own[:3], F.expr(f"orow div {tile}").alias("ty"), F.expr(f"ocol div {tile}").alias("tx"))
    placed = cells.select(key.alias("tile"), F.struct(place.cast("int").alias("at"), "value").alias("cell"))
    blocks = placed.groupBy("tile").agg(F.collect_list("cell").alias("data"))

    def packing(rows: pd.DataFrame) -> pd.DataFrame:
        block = np.full(tile * tile, float(layout.nodata or 0))
        for at, values in zip(rows["at"], rows["value"], strict=True):
            block[at] = np.rint(values) if rows["level"].iloc[0] and layout.kind.kind != "f" else values
        return rows[own].iloc[:1].assign(data=layout.packed(block))

    # A group is a tile, so a task holds the cells of one, however many there are; plain arrays, not an object for each cell.
    return blocks.select("tile", "tile.*", F.col("data.at").alias("at"), F.col("data.value").alias("value")).groupBy("tile").applyInPandas(packing, PACKED)


def write(values: DataFrame, grid: OutGrid, folder: str | None, bands: int | DataFrame, name: str = "name", dtype: str = "float64", tile: int = 256, nodata: float | None = None, compress: str = "deflate", labels: DataFrame | None = None, overviews: int = 0, reduce: str = "average") -> DataFrame:
    """Writes a tiled, band-separate file for each ``name`` and returns (name, path, n_bytes); an existing one is replaced.
    values has name, band, orow, ocol and value; absent cells get nodata, else 0, and tiles without any cell take no bytes.
    The file is folder/name.tif, or without a folder the name itself. bands is the number of bands, or a table (name, bands)
    of all files to be made. labels (name, band, label), if given, become the bands' descriptions. overviews more levels, each
    half as large, are made by ``reduce`` (see pyramid). Lazily: an action on the result writes."""
    if compress not in ("deflate", "none"):
        raise ValueError(f"unsupported compression {compress!r}")
    fixed = bands if isinstance(bands, int) else None
    layout = Layout(dtype, tile, 8 if compress == "deflate" else 1, 1, nodata)
    packed = pack(values.select(F.col(name).alias("name"), "band", "orow", "ocol", "value"), layout, overviews, reduce)
    # Labels and numbers of bands travel as tiles above the first row.
    above = lambda ty, band, data: [F.col("name"), F.lit(0).alias("level"), F.col(band).cast("int").alias("band"), F.lit(ty).cast("long").alias("ty"), F.lit(0).cast("long").alias("tx"), data.cast("binary").alias("data")]
    if labels is not None:
        packed = packed.unionByName(labels.select(*above(-1, "band", F.col("label"))))
    if fixed is None:
        packed = packed.unionByName(bands.select(*above(-2, "bands", F.lit(""))))
    return files_of(packed, grid, layout, folder, fixed, overviews + 1)


def copy_layout(src: str, level: int, window: tuple[int, int, int, int], nodata: float | None) -> Layout | None:
    """The layout in which a window (xoff, yoff, xsize, ysize) of a file's level can be copied tile by tile: it begins on a
    tile's corner, bands are apart, tiles are square, and where it cuts a tile that can be packed anew. Else None."""
    with open_file(src) as f:
        order, images = directories(f)
    own, (xoff, yoff, xsize, ysize) = images[level - 1], window
    if "tile_width" not in own or own["tile_width"] != own["tile_height"] or len(set(own["bits"])) > 1 or own["bits"][0] not in (8, 16, 32, 64):
        return None
    side, how, predictor = own["tile_width"][0], own["compression"][0], own["predictor"][0]
    cuts = (xoff + xsize < own["width"][0] and xsize % side) or (yoff + ysize < own["height"][0] and ysize % side)
    apart = own["planar"][0] == 2 or own["bands"][0] == 1
    kind = {1: "u", 2: "i", 3: "f"}.get(own["format"][0])
    if not apart or order != "<" or xoff % side or yoff % side or kind is None or how not in DECODERS or (cuts and (how not in ENCODERS or predictor != 1)):
        return None
    return Layout(f"{kind}{own['bits'][0] // 8}", side, how, predictor, nodata)


def copied_tiles(planned: DataFrame, bands: list[int], layout: Layout, name: str) -> DataFrame:
    """The tiles (PACKED) of a window that copy_layout() found fit, as the bytes that the source has; a tile that the window cuts
    is packed anew. No pixel is a row, and nothing is shuffled but the tiles' places."""
    side = layout.tile
    span = lambda off, size: F.sequence(F.expr(f"{off} div {side}"), F.expr(f"({off} + {size} - 1) div {side}"))
    wanted = planned.withColumn("ty", F.explode(span("yoff", "ysize"))).withColumn("tx", F.explode(span("xoff", "xsize")))
    wanted = wanted.select("src", "level", "ty", "tx", "xoff", "yoff", "xsize", "ysize", "n_bands", F.coalesce("nodata", F.lit(0.0)).alias("fill")).repartition("src", "ty", "tx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for (src, level), part in rows.groupby(["src", "level"]):
                out = []
                with open_file(src) as f:
                    order, images = directories(f)
                    own = images[level - 1]
                    across, down = (-(-own[n][0] // side) for n in ("width", "height"))
                    for r in part.itertuples():
                        right, bottom = r.xoff + r.xsize - r.tx * side, r.yoff + r.ysize - r.ty * side
                        cut = (right < side and r.xoff + r.xsize < own["width"][0]) or (bottom < side and r.yoff + r.ysize < own["height"][0])
                        for place, b in enumerate(bands, 1):
                            n = (b - 1) * across * down + r.ty * across + r.tx
                            if not own["sizes"][n]:
                                continue
                            f.seek(own["offsets"][n])
                            raw = f.read(own["sizes"][n])
                            if cut:
                                block = decode(raw, own, order, 1)[:, :, 0].copy()
                                block[max(bottom, 0) :], block[:, max(right, 0) :] = r.fill, r.fill
                                raw = layout.packed(block)
                            out.append((name, 0, place, r.ty - r.yoff // side, r.tx - r.xoff // side, raw))
                yield pd.DataFrame(out, columns=["name", "level", "band", "ty", "tx", "data"])

    return wanted.mapInPandas(run, PACKED)


def numbered(spark, paths: list[str]) -> DataFrame:
    """Paths as a table, numbered from 1 in the order given."""
    own = spark.createDataFrame([(p,) for p in paths], "src string").withColumn("_n", F.monotonically_increasing_id())
    return own.select("src", F.row_number().over(Window.orderBy("_n")).alias("src_idx"))
