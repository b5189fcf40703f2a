"""Files of all kinds: tiles copied as they are, levels of overviews, tiles without bytes, systems by parameters."""

import struct

import numpy as np
import pytest
from test_tiff import DATA, make

from gridloom import api
from gridloom.functions.crs import normalise
from gridloom.plans.spec import OutGrid, WarpSpec
from gridloom.sources import tiff

SINU = "+proj=sinu +lon_0=5 +R=6371007.181"


def raw_tiles(path):
    """Each directory's tiles as they stand in the file."""
    with open(path, "rb") as f:
        _, images = tiff.directories(f)
        blob = f.seek(0) or f.read()
    return images, [[blob[a : a + n] for a, n in zip(d["offsets"], d["sizes"], strict=True)] for d in images]


def test_copied_tiles_are_equal_bytes(spark, tmp_path):
    """A window on the source's tiles: whole tiles as they are, cut ones anew; values as by cells, which anything else takes."""
    path = make(tmp_path / "a.tif", DATA)
    cat = api.sources(spark, [path]).cache()
    images, before = raw_tiles(path)
    across = -(-52 // 16)
    for te, bands in (((500160, 4002240, 500520, 4002400), (3, 1)), ((500000, 4002300, 500200, 4002560), (2,))):
        spec = WarpSpec(te=te, bands=bands)
        out = api.warp(cat, spec)
        assert out.copied is not None
        to = out.write(f"{tmp_path}/out.tif")
        (own,), (after,) = raw_tiles(to)
        assert own["format"] == images[0]["format"][:1] * out.bands and own["tile_width"] == (16,)
        x0, y0 = int((out.grid.xmin - 5e5) // 160), int((4002560 - out.grid.ymax) // 160)
        wide, high = -(-out.grid.width // 16), -(-out.grid.height // 16)
        kept = 0
        for place, b in enumerate(bands or (1, 2, 3)):
            for ty in range(high):
                for tx in range(wide):
                    ours = after[place * wide * high + ty * wide + tx]
                    whole = (tx < wide - 1 or out.grid.width % 16 == 0 or x0 * 16 + out.grid.width == 52) and (ty < high - 1 or out.grid.height % 16 == 0 or y0 * 16 + out.grid.height == 40)
                    theirs = before[0][(b - 1) * across * 3 + (y0 + ty) * across + x0 + tx]
                    kept += whole
                    assert not whole or ours == theirs
        assert kept >= 1
        assert (api.warp(api.sources(spark, [to]), WarpSpec()).to_numpy() == out.to_numpy()).all()
    # No aggregation and no pixel rows stand between the two files.
    planned, bands = api.warp(cat, WarpSpec()).copied
    layout = tiff.copy_layout(path, 1, (0, 0, 52, 40), None)
    plan = tiff.copied_tiles(planned, bands, layout, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "posexplode" not in plan
    off = api.warp(cat, WarpSpec(te=(500050, 4002250, 500330, 4002490)))
    assert not off._copy(f"{tmp_path}/no.tif") and not api.warp(cat, WarpSpec(tr=(20, 20))).copied
    assert (api.warp(api.sources(spark, [off.write(f"{tmp_path}/off.tif")]), WarpSpec()).to_numpy() == off.to_numpy()).all()
    assert tiff.copy_layout(make(tmp_path / "m.tif", DATA, planar=1), 1, (0, 0, 52, 40), None) is None
    assert tiff.copy_layout(make(tmp_path / "b.tif", DATA, order=">"), 1, (0, 0, 52, 40), None) is None
    assert tiff.copy_layout(make(tmp_path / "l.tif", DATA, compress=5), 1, (0, 0, 20, 20), None) is None
    assert tiff.copy_layout(make(tmp_path / "l.tif", DATA, compress=5), 1, (0, 0, 52, 40), None).compression == 5


def test_overviews_of_a_written_file(spark, tmp_path):
    """Levels come back through the catalog, hold the means, and are what a coarse request reads."""
    rows = [(1, r, c, float(r * 10 + c % 7)) for r in range(40) for c in range(52) if (r // 16, c // 16) != (1, 1)]
    values = spark.createDataFrame(rows, "band int, orow long, ocol long, value double")
    grid = OutGrid(500000.0, 4000000.0, 10.0, 10.0, 52, 40, "EPSG:32631")
    path = api.Warped(values, grid, 1, -5.0).write(f"{tmp_path}/o.tif", tile=16, overviews=2)
    cat = api.sources(spark, [path]).cache()
    assert [(v.width, v.height) for v in cat.first().levels] == [(52, 40), (26, 20), (13, 10)]
    images, tiles = raw_tiles(path)
    assert [d["subfile"] for d in images] == [(0,), (1,), (1,)] and tiles[0][5] == b"" and tiles[0][4] != b""
    assert min(images[2]["offsets"]) < min(x for x in images[1]["offsets"] if x) < min(x for x in images[0]["offsets"] if x)  # the head, then the coarsest
    full = np.full((40, 52), np.nan)
    for _, r, c, v in rows:
        full[r, c] = v
    def half(a):
        a = np.pad(a, [(0, n % 2) for n in a.shape], constant_values=np.nan)
        with np.errstate(all="ignore"):
            blocks = a.reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2)
            n = (~np.isnan(blocks)).sum((1, 3))
            return np.where(n > 0, np.nansum(blocks, (1, 3)) / n, np.nan)
    one, two = half(full), half(half(full))
    got = api.warp(cat, WarpSpec(te=(500000, 3999640, 500480, 4000000), tr=(20, 20), tap=False, method="near")).to_numpy()[0]
    assert got == pytest.approx(np.nan_to_num(one[:18, :24], nan=-5.0))
    got = api.warp(cat, WarpSpec(te=(500000, 3999640, 500480, 4000000), tr=(40, 40), tap=False)).to_numpy()[0]
    assert got == pytest.approx(np.nan_to_num(two[:9, :12], nan=-5.0))
    near = api.Warped(values, grid, 1, -5.0).write(f"{tmp_path}/n.tif", tile=16, dtype="int16", overviews=1, reduce="near")
    got = api.warp(api.sources(spark, [near]), WarpSpec(te=(500000, 3999640, 500480, 4000000), tr=(20, 20), tap=False)).to_numpy()[0]
    assert (got == np.nan_to_num(full[:36:2, :48:2], nan=-5.0)).all()
    with pytest.raises(ValueError, match="reduction"):
        tiff.pyramid(values, 2, "median")


@pytest.mark.parametrize("system", [SINU, "+proj=stere +lat_0=90 +lat_ts=71 +lon_0=5", "+proj=longlat +ellps=bessel"])
def test_files_that_name_no_code(spark, tmp_path, system):
    """What is written in a system without a code is read back in it, from its keys alone, and can be warped."""
    name = normalise(system)
    flat = (np.arange(40)[:, None] * 100 + np.arange(52)[None, :]).astype("int16")[None]
    cat = api.sources(spark, [make(tmp_path / "a.tif", flat)]).cache()
    there = api.warp(cat, WarpSpec(t_srs=system))
    path = there.write(f"{tmp_path}/there.tif", tile=16)
    again = api.sources(spark, [path]).cache()
    said = again.first()
    assert said.crs.startswith("+proj=") and normalise(said.crs) == name
    g = there.grid
    assert (said.width, said.height) == (g.width, g.height) and abs(g.width * g.height / flat.size - 1) < 0.8
    back = api.warp(again, WarpSpec(te=(500150, 4002300, 500350, 4002450), t_srs="EPSG:32631", tr=(10, 10), tap=False)).to_numpy()[0]
    row, col = np.divmod(back, 100)
    assert back.shape == (15, 20) and abs(row - (11 + np.arange(15))[:, None]).max() <= 2 and abs(col - (15 + np.arange(20))[None, :]).max() <= 2


@pytest.mark.parametrize("system", ["+proj=laea +lat_0=45 +lon_0=5 +ellps=intl", "+proj=aea +lat_1=43 +lat_2=62 +lat_0=30 +lon_0=10 +ellps=bessel", "+proj=tmerc +lat_0=10 +lon_0=4 +k_0=0.9999 +x_0=1000 +ellps=clrk66", "+proj=cea +lat_ts=30", "+proj=lcc +lat_1=40 +lat_2=50 +lat_0=45 +lon_0=5", "+proj=merc +lon_0=3 +k_0=0.9", "+proj=eqc +lat_ts=10", "+proj=stere +lat_0=40 +lon_0=1"])
def test_keys_say_the_same_system(spark, tmp_path, system):
    """Keys of every method are read back as the same parameters."""
    keys, doubles = tiff.system_keys(normalise(system))
    numbers, _ = tiff.geo_keys({"keys": keys, "doubles": doubles})
    assert keys[3] * 4 + 4 == len(keys) and keys[4::4] == sorted(keys[4::4])
    grid = OutGrid(0.0, 0.0, 1.0, 1.0, 4, 4, normalise(system))
    head, _ = tiff.directories_of(grid, tiff.Layout(tile=16), 1, [[b""]], {})
    (tmp_path / "k.tif").write_bytes(head)
    assert normalise(api.sources(spark, [str(tmp_path / "k.tif")]).first().crs) == normalise(system) and 3075 in numbers


def test_systems_that_cant_be_written():
    for system in ("+proj=tmerc +units=us-ft", "+proj=longlat +pm=paris", "+proj=lcc +lat_1=45 +lat_0=45 +k_0=0.9"):
        with pytest.raises(ValueError, match="keys"):
            tiff.system_keys(normalise(system))


def test_blocks_under_sources_only(spark, tmp_path):
    """A mosaic of two far sources: filled where they are, and a file whose other tiles take no bytes."""
    far = (1, 1, 0, 2, 1025, 0, 1, 1, 3072, 0, 1, 32631)
    a, b = make(tmp_path / "a.tif", DATA, keys=far), make(tmp_path / "b.tif", DATA, keys=far)
    raw = bytearray(open(b, "rb").read())
    at = raw.index(struct.pack("<d", 500000.0))
    raw[at : at + 8] = struct.pack("<d", 600000.0)
    open(b, "wb").write(bytes(raw))
    out = api.warp(api.sources(spark, [a, b]).cache(), WarpSpec(te=(500000, 4002160, 600520, 4002560), tr=(10, 10), tap=False, t_srs="EPSG:32631", bands=(1,)))
    assert out.grid.width == 10052
    filled = out.dense_where_covered(16)
    none = out.nodata or 0.0
    assert filled.count() < 2 * 80 * 40 and filled.where(f"value <> {none}").count() == 2 * int((DATA[0] != none).sum())
    path = out.write(f"{tmp_path}/m.tif", tile=16)
    (own,), (tiles,) = raw_tiles(path)
    assert len(tiles) == 3 * 629 and sum(bool(t) for t in tiles) <= 3 * 9
