import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from gridloom.functions import metadata as M
from gridloom.operators.warp import dense, mosaic, scatter
from gridloom.plans import windows as W
from gridloom.plans.spec import OutGrid, WarpSpec
from gridloom.sources import tiff


def lzw(raw):
    """TIFF's LZW, by the book: codes of growing width, the highest bit first."""
    codes, table, now = [(256, 9)], {bytes([i]): i for i in range(256)}, b""
    width, free = 9, 258
    for c in raw:
        if now + bytes([c]) in table:
            now += bytes([c])
            continue
        codes.append((table[now], width))
        table[now + bytes([c])] = free
        free += 1
        if free == 4094:
            codes.append((256, width))
            table, free, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif free + 1 > 1 << width:
            width += 1
        now = bytes([c])
    if now:
        codes.append((table[now], width))
        free += 1
        width += free + 1 > 1 << width
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packbits(raw):
    out, at = b"", 0
    while at < len(raw):
        n = 1
        while at + n < len(raw) and n < 128 and raw[at + n] == raw[at]:
            n += 1
        out += bytes([257 - n, raw[at]]) if n > 1 else bytes([0, raw[at]])
        at += n
    return out


SQUEEZE = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits, 50000: lambda raw: zstandard.ZstdCompressor().compress(raw)}


def make(path, data, tile=16, planar=2, order="<", compress=8, predictor=1, overview=False, more=0, keys=(1, 1, 0, 2, 1025, 0, 1, 1, 3072, 0, 1, 32631)):
    """A classic TIFF by hand: bands x height x width."""
    images = [data] + ([-data[:, ::2, ::2]] if overview else []) + [data[:, :1, :1]] * more
    blob, out = b"", []
    at = 8
    chunks = []
    for img in images:
        nb, h, w = img.shape
        tiles = []
        for group in ([[b] for b in range(nb)] if planar == 2 else [list(range(nb))]):
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    block = np.zeros((tile, tile, len(group)), img.dtype)
                    part = img[group, y : y + tile, x : x + tile].transpose(1, 2, 0)
                    block[: part.shape[0], : part.shape[1]] = part
                    if predictor == 2:
                        block[:, 1:] = block[:, 1:] - block[:, :-1]
                    raw = block.astype(block.dtype.newbyteorder(order)).tobytes()
                    if predictor == 3:
                        planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(tile, -1, block.dtype.itemsize).transpose(0, 2, 1).reshape(tile, -1, len(group))
                        raw = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).tobytes()
                    tiles.append(SQUEEZE[compress](raw))
        chunks.append((img, tiles))
    for img, tiles in chunks:
        nb, h, w = img.shape
        offs = []
        for t in tiles:
            offs.append(at)
            blob += t
            at += len(t)
        bits = img.dtype.itemsize * 8
        tags = [(254, 4, [0 if img is data else 1]), (256, 3, [w]), (257, 3, [h]), (258, 3, [bits] * nb), (259, 3, [compress]), (277, 3, [nb]), (284, 3, [planar]), (317, 3, [predictor]), (322, 3, [tile]), (323, 3, [tile]), (324, 4, offs), (325, 4, [len(t) for t in tiles]), (339, 3, [{"u": 1, "i": 2, "f": 3}[img.dtype.kind]] * nb),
                (33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [0.0, 0, 0, 5e5, 4002560.0, 0]), (34735, 3, list(keys)), (42113, 2, b"-9999\0")]
        out.append(tags)
    where = []
    for tags in out:
        table = b""
        extra = b""
        start = at
        for tag, kind, vals in tags:
            raw = vals if kind == 2 else struct.pack(f"{order}{len(vals)}{tiff.FIELDS[kind]}", *vals)
            if len(raw) > 4:
                inline = struct.pack(f"{order}I", start + len(extra))
                extra += raw
            else:
                inline = raw.ljust(4, b"\0")
            table += struct.pack(f"{order}HHI", tag, kind, len(vals)) + inline
        blob += extra
        at += len(extra)
        where.append((at, table, len(tags)))
        blob += b"\0" * (2 + len(table) + 4)
        at += 2 + len(table) + 4
    whole = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, where[0][0]) + blob)
    for i, (pos, table, n) in enumerate(where):
        nxt = where[i + 1][0] if i + 1 < len(where) else 0
        whole[pos : pos + 2 + len(table) + 4] = struct.pack(f"{order}H", n) + table + struct.pack(f"{order}I", nxt)
    path.write_bytes(bytes(whole))
    return str(path)


DATA = (np.arange(3 * 40 * 52).reshape(3, 40, 52) * 7 % 3001 - 1000).astype("int16")


HOW = [{}, {"planar": 1}, {"order": ">"}, {"predictor": 2, "planar": 1}, {"compress": 1, "order": ">", "predictor": 2}, {"compress": 5, "predictor": 2}, {"compress": 5, "order": ">"}, {"compress": 32773}, {"compress": 50000}]


@pytest.mark.parametrize("how", HOW)
def test_window_of_a_file(spark, tmp_path, how):
    path = make(tmp_path / "a.tif", DATA, **how)
    cat = tiff.catalog(tiff.numbered(spark, [path])).cache()
    r = cat.first()
    assert (r.width, r.height, r.n_bands, r.dtype, r.nodata, r.crs, r.gt.gt0, r.gt.gt3, r.gt.gt5, r.band_names[1]) == (52, 40, 3, "Int16", -9999.0, "EPSG:32631", 5e5, 4002560.0, -10.0, "band_02")
    planned = W.plan(cat, WarpSpec(te=(500050, 4002250, 500330, 4002490), t_srs="EPSG:32631"))
    got = tiff.read_pixels(planned, [3, 1]).toPandas()
    out = np.zeros((2, 24, 28))
    out[got.band - 1, got.row, got.col] = got.value
    assert len(got) == out.size and (out == DATA[[2, 0], 7:31, 5:33]).all()


def test_overview_is_read(spark, tmp_path):
    cat = tiff.catalog(tiff.numbered(spark, [make(tmp_path / "a.tif", DATA, overview=True)]))
    planned = W.plan(cat, WarpSpec(te=(500000, 4002160, 500520, 4002560), tr=(20, 20)))
    got = tiff.read_pixels(planned, [2]).toPandas()
    assert planned.first().level == 2 and len(got) == 20 * 26
    assert (got.value.to_numpy() == -DATA[1, ::2, ::2][got.row, got.col]).all()


@pytest.mark.parametrize("dtype", ["float64", "int16"])
def test_written_file_is_read_again(spark, tmp_path, dtype):
    grid = OutGrid(5e5, 4002560.0, 10.0, 10.0, 52, 40, "EPSG:32631")
    rows = [("x", b + 1, r, c, float(DATA[b, r, c])) for b in range(2) for r in range(40) for c in range(52) if r + c != 5]
    values = spark.createDataFrame(rows, "name string, band int, orow long, ocol long, value double")
    paths = [r.path for r in tiff.write(values, grid, str(tmp_path), 2, dtype=dtype, tile=16, nodata=-9999.0).collect()]
    assert paths == [f"{tmp_path}/x.tif"]
    cat = tiff.catalog(tiff.numbered(spark, paths))
    r = cat.first()
    assert (r.width, r.height, r.n_bands, r.nodata, r.crs, r.gt.gt0, r.gt.gt3) == (52, 40, 2, -9999.0, "EPSG:32631", 5e5, 4002560.0)
    got = tiff.read_pixels(W.plan(cat, WarpSpec()), [1, 2]).toPandas()
    want = DATA[:2].astype(float)
    want[:, [r for r in range(6)], [5 - r for r in range(6)]] = -9999
    out = np.zeros((2, 40, 52))
    out[got.band - 1, got.row, got.col] = got.value
    assert (out == want).all()


def test_file_to_warped_grid(spark, tmp_path):
    cat = tiff.catalog(tiff.numbered(spark, [make(tmp_path / "a.tif", DATA)])).cache()
    px = tiff.read_pixels(W.plan(cat, WarpSpec(te=(500000, 4002160, 500500, 4002560), tr=(50, 50))), [1])
    grid = WarpSpec(te=(500000, 4002160, 500500, 4002560), tr=(50, 50), tap=False).grid()
    got = dense(mosaic(scatter(px, cat, grid, "average")), grid, [1]).where("orow = 2 and ocol = 3").first().value
    assert got == pytest.approx(DATA[0, 10:15, 15:20].mean())


def test_what_is_not_supported(spark, tmp_path):
    (tmp_path / "no.tif").write_bytes(b"nothing at all here")
    with pytest.raises(Exception, match="not a TIFF"):
        tiff.catalog(tiff.numbered(spark, [str(tmp_path / "no.tif")])).select(F.count("*")).collect()


@pytest.mark.parametrize("dtype", ["float32", "float64"])
@pytest.mark.parametrize("planar", [1, 2])
def test_floating_point_predictor(spark, tmp_path, dtype, planar):
    data = (DATA / 7).astype(dtype)
    cat = tiff.catalog(tiff.numbered(spark, [make(tmp_path / "a.tif", data, predictor=3, planar=planar, order="<")]))
    got = tiff.read_pixels(W.plan(cat, WarpSpec()), [1, 2, 3]).toPandas()
    out = np.zeros(data.shape)
    out[got.band - 1, got.row, got.col] = got.value
    assert (out == data).all()


def test_many_directories_and_repeated_paths(spark, tmp_path):
    path = make(tmp_path / "a.tif", DATA, overview=True, more=70)
    cat = tiff.catalog(tiff.numbered(spark, [path, path]))
    assert [(r.src_idx, len(r.levels)) for r in cat.orderBy("src_idx").collect()] == [(1, 72), (2, 72)]


def test_files_that_cannot_be_read(spark, tmp_path):
    """An error is raised, or is the row's own; in tiles likewise."""
    good, cut = make(tmp_path / "a.tif", DATA), make(tmp_path / "b.tif", DATA)
    raw = bytearray((tmp_path / "b.tif").read_bytes())
    raw[8:1500] = b"\0" * 1492
    (tmp_path / "b.tif").write_bytes(bytes(raw))
    (tmp_path / "c.tif").write_bytes(b"II*\0")
    paths = tiff.numbered(spark, [good, cut, str(tmp_path / "c.tif"), str(tmp_path / "none.tif")]).withColumn("group_idx", F.col("src_idx") * 10)
    cat = tiff.catalog(paths, strict=False).cache()
    assert [(r.src_idx, r.group_idx, r.error is None) for r in cat.orderBy("src_idx").collect()] == [(1, 10, True), (2, 20, True), (3, 30, False), (4, 40, False)]
    with pytest.raises(Exception, match=r"(c|none)\.tif"):
        tiff.catalog(paths).collect()
    planned = W.plan(cat, WarpSpec(te=(500050, 4002250, 500330, 4002490)), strict=False)
    tiles = tiff.read_tiles(planned, [1]).cache()
    assert {r.src_idx for r in tiles.where("error is null").collect()} >= {1} and {r.src_idx for r in tiles.where("error is not null").collect()} == {2}
    with pytest.raises(Exception, match="b.tif"):
        tiff.pixels_of(tiles, planned, [1]).collect()


def test_band_names(spark):
    xml = """<GDALMetadata><Item sample="1" role="description" name="DESCRIPTION"> two </Item><Item name="SCALE" sample="0">9</Item>
<Item name="DESCRIPTION" sample="0">x</Item><Item name="DESCRIPTION" sample="0">one
</Item><Item name="DESCRIPTION">none</Item><Item name="DESCRIPTION" sample="9">far</Item></GDALMetadata>"""
    names = lambda x, n: spark.createDataFrame([(x, n)], "x string, n int").select(M.band_names(F.col("x"), F.col("n")).alias("v")).first().v
    assert names(xml, 3) == ["one", "two", "band_03"] and names(None, 2) == ["band_01", "band_02"]
