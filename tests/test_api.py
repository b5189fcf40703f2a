"""Requests from end to end, over files made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tiff import DATA, make

from gridloom import api
from gridloom.plans.spec import WarpSpec
from gridloom.sources import tiff
from gridloom.streaming import batch as B

WHOLE = (500000, 4002160, 500520, 4002560)


def test_copy_and_average_and_overview(spark, tmp_path):
    """The overview's values differ from the full resolution's, so both value and place show which level was read."""
    cat = api.sources(spark, [make(tmp_path / "a.tif", DATA, overview=True)]).cache()
    assert (api.warp(cat, WarpSpec()).to_numpy() == DATA).all()
    assert (api.warp(cat, WarpSpec(te=(500050, 4002250, 500330, 4002490), bands=(3, 1))).to_numpy() == DATA[[2, 0], 7:31, 5:33]).all()
    same = api.warp(cat, WarpSpec(te=WHOLE, tr=(20, 20)))
    assert (same.to_numpy() == -DATA[:, ::2, ::2]).all() and (same.grid.width, same.grid.height) == (26, 20)
    part = api.warp(cat, WarpSpec(te=(500100, 4002200, 500300, 4002400), tr=(40, 40), tap=False, method="average", margin=0, bands=(2,)))
    level = -DATA[1, ::2, ::2].astype(float)
    want = level[8:18, 5:15].reshape(5, 2, 5, 2).mean((1, 3))
    assert part.to_numpy()[0] == pytest.approx(want)
    fine = api.warp(cat, WarpSpec(te=(500100, 4002200, 500300, 4002400), tr=(40, 40), tap=False, method="average", overview=1, bands=(2,)))
    assert fine.to_numpy()[0] == pytest.approx(DATA[1, 16:36, 10:30].reshape(5, 4, 5, 4).mean((1, 3)))


def test_another_system(spark, tmp_path):
    """To degrees and back by nearest pixels stays close; te in degrees is the same request as te in metres."""
    flat = (np.arange(40)[:, None] * 100 + np.arange(52)[None, :]).astype("int16")[None]
    cat = api.sources(spark, [make(tmp_path / "a.tif", flat)]).cache()
    deg = api.warp(cat, WarpSpec(t_srs="EPSG:4326"))
    got = deg.to_numpy()[0]
    assert abs(deg.grid.width * deg.grid.height / flat.size - 1) < 0.35 and (got >= 0).mean() > 0.95
    mid = got[got.shape[0] // 2, got.shape[1] // 2]
    assert abs(mid // 100 - 20) <= 1 and abs(mid % 100 - 26) <= 1
    g = deg.grid
    te = (g.xmin + 0.001, g.ymax - 0.003, g.xmin + 0.003, g.ymax - 0.001)
    back = api.warp(cat, WarpSpec(te=te, te_srs="EPSG:4326", t_srs="EPSG:32631", tr=(10, 10)))
    col, row = (back.grid.xmin - 5e5) / 10, (4002560 - back.grid.ymax) / 10
    out = back.to_numpy()[0]
    assert out.shape[0] > 15 and (out == flat[0, int(row) : int(row) + out.shape[0], int(col) : int(col) + out.shape[1]]).all()


def test_mosaic_stack_and_files(spark, tmp_path):
    one, two = DATA[:1], DATA[1:].copy()
    two[:, 10:20] = -9999
    paths = [make(tmp_path / "a.tif", one), make(tmp_path / "b.tif", two)]
    cat = api.sources(spark, paths).cache()
    whole = api.warp(cat, WarpSpec(te=WHOLE, tr=(10, 10), bands=(1,)))
    assert (whole.to_numpy()[0] == np.where(two[0] == -9999, one[0], two[0])).all()
    both = api.stacked(cat, WarpSpec(te=WHOLE, tr=(10, 10)), ["near", "average"])
    assert both.labels == ["a", "b_b1", "b_b2"] and (both.to_numpy() == np.concatenate([one, two])).all()
    with pytest.raises(ValueError, match="2 labels for 3 bands"):
        api.stacked(cat, WarpSpec(), labels=["x", "y"])
    path = api.stacked(cat, WarpSpec(), labels=["x", "y z", "w"]).write(f"{tmp_path}/deep/out.tif", dtype="int16", tile=16, compress="none")
    again = api.sources(spark, [path])
    r = again.first()
    assert r.band_names == ["x", "y z", "w"] and r.dtype == "Int16" and r.nodata == -9999
    assert (api.warp(again, WarpSpec()).to_numpy() == np.concatenate([one, two])).all()
    with pytest.raises(MemoryError):
        api.warp(cat, WarpSpec(bands=(1,), max_bytes=100))
    with pytest.raises(ValueError, match="does not overlap"):
        api.warp(cat, WarpSpec(te=(0, 0, 9, 9)))
    with pytest.raises(MemoryError):
        whole.to_numpy(most_bytes=10)
    facts = api.info(again).first()
    assert (facts.bands, facts.resolution, facts.nodata, facts.overviews, facts.band_names) == ("3 Int16", "10", "-9999", "0 (52x40)", "x, y z, w")


@pytest.fixture()
def grouped(spark, tmp_path):
    """Five good files and two bad ones, in four groups; one file doesn't overlap."""
    paths = [make(tmp_path / f"f{i}.tif", DATA[:1] + i) for i in range(4)]
    raw = bytearray((tmp_path / "f3.tif").read_bytes())
    raw[8:900] = b"\0" * 892
    (tmp_path / "f3.tif").write_bytes(bytes(raw))
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    rows = [(paths[0], 1, 1, "t1", "B1"), (paths[1], 1, 2, "t1", ""), (paths[2], 2, 1, None, None), (str(tmp_path / "bad.tif"), 2, 2, None, None), (paths[3], 3, 1, "t3", None), (paths[1], 4, 1, "t4", None)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "src_idx int, src string, group_idx long, band_pos long, group_name string, band_name string")
    return api.sources(spark, table, strict=False).cache()


SPEC = WarpSpec(te=(500000, 4002160, 500520, 4002560), tr=(10, 10), t_srs="EPSG:32631")


def test_batch_of_stacks(spark, tmp_path, grouped):
    out = {r.group_idx: r for r in api.batch(grouped, SPEC, f"{tmp_path}/out/aoi.tif", stack_groups=True, dtype="int16").collect()}
    assert {k: (r.path, r.error is None) for k, r in out.items()} == {1: (f"{tmp_path}/out/aoi_t1.tif", True), 2: (None, False), 3: (None, False), 4: (f"{tmp_path}/out/aoi_t4.tif", True)}
    assert "not a TIFF" in out[2].error and "f3.tif" in out[3].error and [out[k].n_windows for k in (1, 2, 3, 4)] == [2, 1, 1, 1]
    cat = api.sources(spark, [out[1].path])
    assert (api.warp(cat, WarpSpec()).to_numpy() == np.concatenate([DATA[:1], DATA[:1] + 1])).all() and cat.first().band_names == ["f0", "f1"]


def test_batch_of_single_outputs(spark, tmp_path, grouped):
    out = {(r.group_idx, r.band_pos): r for r in api.batch(grouped, SPEC, f"{tmp_path}/x.tif").collect()}
    assert {k for k, r in out.items() if r.path is None} == {(2, 2), (3, 1)} and out[(1, 2)].path == f"{tmp_path}/x_t1_2.tif"
    assert (api.warp(api.sources(spark, [out[(2, 1)].path]), WarpSpec()).to_numpy() == DATA[:1] + 2).all()
    given = grouped.withColumn("out", F.concat(F.lit(f"{tmp_path}/own/"), F.col("src_idx").cast("string"), F.lit(".tif")))
    assert {r.path for r in api.batch(given, SPEC).where("error is null").collect()} == {f"{tmp_path}/own/{i}.tif" for i in (1, 2, 3, 6)}
    with pytest.raises(ValueError, match="duplicate output paths"):
        api.batch(given.withColumn("out", F.lit("same.tif")), SPEC)


def test_stream_of_windows(spark, tmp_path, grouped):
    """Planned windows as a stream: read, buffered by group, out once a group is whole."""
    from gridloom.plans import windows as W

    planned = W.plan(grouped, SPEC, strict=False).join(grouped.select("src_idx", "group_idx", "band_pos"), "src_idx")
    rows = B.needed(planned)
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = B.stack_stream(B.fetched(stream, [1, 1]), payload_type="binary").writeStream.format("memory").queryName("fetched").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = {r.group_idx: r for r in spark.table("fetched").collect()}
    assert {k: (r.failed, r.n_windows) for k, r in out.items()} == {1: (False, 2), 2: (False, 1), 3: (True, 1), 4: (False, 1)}
    got = [np.frombuffer(p, "<f8").reshape(2, 40, 52) for p in out[1].payloads]
    assert (got[0] == DATA[:1]).all() and (got[1] == DATA[:1] + 1).all()
    assert tiff.numbered(spark, ["a", "b"]).count() == 2


def test_the_example_of_the_readme(spark, tmp_path):
    import pathlib
    import re

    text = (pathlib.Path(__file__).parent.parent / "README.md").read_text()
    code = re.search(r"```python\n(.*?)```", text, re.S)[1]
    paths = [make(tmp_path / "a.tif", DATA, overview=True)]
    names = {"spark": spark, "paths": paths, "folder": str(tmp_path)}
    exec(code, names)
    assert names["array"].shape == (2, 8, 10)
