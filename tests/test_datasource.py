"""The data source: what filters leave unread, files of many tasks, and what a failed task leaves."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from test_tiff import DATA, make

from gridloom import api
from gridloom.plans.spec import OutGrid, WarpSpec
from gridloom.sources import datasource as S
from gridloom.sources import tiff

GRID = OutGrid(500000.0, 4002560.0, 10.0, 10.0, 52, 40, "EPSG:32631")


def read(spark, path, **options):
    S.register(spark)
    return spark.read.format("tiled_tiff").options(**options).load(str(path))


def pixels(tiles):
    each = tiles.select("src", "level", "band", "row0", "col0", "w", F.posexplode("data").alias("at", "value"))
    return each.select("src", "level", "band", (F.col("row0") + F.expr("at div w")).alias("row"), (F.col("col0") + F.col("at") % F.col("w")).alias("col"), "value").toPandas()


@pytest.mark.parametrize("stripes", [1, 2, 5])
def test_every_tile_once(spark, tmp_path, stripes):
    make(tmp_path / "a.tif", DATA, overview=True)
    make(tmp_path / "b.tif", DATA + 1, planar=1)
    (tmp_path / "_c.tif").write_bytes(b"no TIFF")
    tiles = read(spark, tmp_path, stripes=stripes)
    assert tiles.rdd.getNumPartitions() == 2 * stripes
    got = pixels(tiles)
    assert not got.duplicated(["src", "level", "band", "row", "col"]).any() and len(got) == 3 * (2 * 40 * 52 + 20 * 26)
    for name, level, want in (("a", 1, DATA), ("a", 2, -DATA[:, ::2, ::2]), ("b", 1, DATA + 1)):
        own = got[got.src.str.endswith(f"{name}.tif") & (got.level == level)]
        assert (own.value.to_numpy() == want[own.band - 1, own.row, own.col]).all() and len(own) == want.size


def test_filters_reach_the_reader(spark, tmp_path):
    paths = [make(tmp_path / f"{n}.tif", DATA + i, overview=True) for i, n in enumerate("ab")]
    tiles = read(spark, tmp_path, bands="3,1")
    asked = tiles.where((F.col("level") == 1) & (F.col("ty") >= 1) & F.col("tx").isin(0, 3) & (F.col("src") == paths[1]) & (F.col("w") > 0))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    # Spark has taken all but w's out of its own filter.
    (left,) = [line for line in plan.split("\n") if "Filter (" in line]
    assert "w#" in left and not any(f"{c}#" in left for c in ("src", "level", "ty", "tx")), plan
    got = asked.toPandas()
    assert {(r.src, r.level, r.ty, r.tx, r.band) for r in got.itertuples()} == {(paths[1], 1, y, x, b) for y in (1, 2) for x in (0, 3) for b in (1, 3)}


def test_bytes_that_are_read(tmp_path, monkeypatch):
    """One tile of one band costs the headers and that tile; the other file isn't opened."""
    paths = [make(tmp_path / f"{n}.tif", DATA, compress=1) for n in "ab"]
    taken = {}
    opened = tiff.open_file

    class Counted:
        def __init__(self, path):
            self.f, self.path = opened(path), path

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            taken[self.path] = taken.get(self.path, 0) + n
            return self.f.read(n)

    monkeypatch.setattr(tiff, "open_file", Counted)

    def cost(*filters):
        taken.clear()
        reader = S.TileReader({"path": str(tmp_path)})
        left = list(reader.pushFilters(list(filters)))
        rows = sum(batch.num_rows for p in reader.partitions() for batch in reader.read(p))
        return rows, left, dict(taken)

    rows, left, all_of_it = cost()
    assert rows == 2 * 3 * 12 and set(all_of_it) == set(paths)
    none = cost(D.EqualTo(("level",), 9))[2][paths[0]]
    rows, left, few = cost(D.EqualTo(("src",), paths[0]), D.IsNotNull(("ty",)), D.EqualTo(("ty",), 1), D.LessThan(("tx",), 1), D.EqualTo(("band",), 2), D.GreaterThan(("w",), 0), D.Not(D.EqualTo(("tx",), 1)))
    assert rows == 1 and set(few) == {paths[0]} and few[paths[0]] == none + 16 * 16 * 2 and len(left) == 2
    assert cost(D.In(("band",), (1, 3)), D.GreaterThanOrEqual(("ty",), 2), D.LessThanOrEqual(("tx",), 0), D.GreaterThan(("level",), 0))[0] == 2 * 2


def test_a_folder_of_blocks(spark, tmp_path):
    """Files of many tasks make the same mosaic, at every level; blocks without a cell have no file."""
    cat = api.sources(spark, [make(tmp_path / "a.tif", DATA)]).cache()
    whole = api.warp(cat, WarpSpec(te=(500000, 4002160, 500520, 4002560), tr=(10, 10), t_srs="EPSG:32631"))
    hole = api.Warped(whole.cells.where("not (orow < 32 and ocol >= 32)"), whole.grid, 3, -9999.0)
    folder = hole.write_blocks(f"{tmp_path}/out", block=32, dtype="int16", tile=16, overviews=1, reduce="near")
    names = sorted(n for n in os.listdir(folder) if not n.startswith("."))
    assert names == ["block_0_0.tif", "block_1_0.tif", "block_1_1.tif"]
    again = api.sources(spark, S.listed(folder)).cache()
    want = DATA.copy()
    want[:, :32, 32:] = -9999
    spec = WarpSpec(te=(500000, 4002160, 500520, 4002560), tr=(10, 10), t_srs="EPSG:32631")
    assert (api.warp(again, spec).to_numpy() == want).all()
    assert {tuple((v.width, v.height) for v in r.levels) for r in again.collect()} == {((32, 32), (16, 16)), ((32, 8), (16, 4)), ((20, 8), (10, 4))}
    coarse = pixels(read(spark, folder).where("level = 2 and band = 2"))
    own = coarse[coarse.src.str.endswith("block_1_1.tif")]
    assert (own.value.to_numpy() == DATA[1, 32::2, 32::2][own.row, own.col]).all() and len(own) == 4 * 10
    # Appending leaves other blocks alone, overwriting doesn't.
    cells = spark.createDataFrame([(1, 0, 40, 5.0)], "band int, orow long, ocol long, value double")
    layout = tiff.Layout("int16", 16, 8, 1, -9999.0)
    S.write_blocks(cells, GRID, 1, folder, 32, layout, overwrite=False)
    assert len(S.listed(folder)) == 4 and [r.data[8] for r in read(spark, f"{folder}/block_0_1.tif").where("data[8] = 5").collect()] == [5.0]
    S.write_blocks(cells, GRID, 1, folder, 32, layout)
    assert [p.rpartition("/")[2] for p in S.listed(folder)] == ["block_0_1.tif"]
    with pytest.raises(ValueError, match="whole tiles"):
        S.write_blocks(cells, GRID, 1, folder, 40, layout)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    """One of many tasks fails after others have written: what was there stays, and nothing else does."""
    folder = tmp_path / "out"
    cells = spark.range(40 * 52).select(F.lit(1).alias("band"), F.expr("id div 52").alias("orow"), (F.col("id") % 52).alias("ocol"), F.lit(1.0).alias("value"))
    layout = tiff.Layout(tile=16)
    S.write_blocks(cells, GRID, 1, str(folder), 16, layout)
    before = {n: (folder / n).read_bytes() for n in os.listdir(folder)}
    tif = [n for n in before if n.endswith(".tif")]
    assert len(tif) == 12
    bad = cells.withColumn("value", F.when(F.col("orow") == 39, F.raise_error(F.lit("lost")).cast("double")).otherwise(2.0))
    packed = tiff.pack(bad.select(F.concat_ws("_", F.lit("block"), F.expr("orow div 16"), F.expr("ocol div 16")).alias("name"), "band", (F.col("orow") % 16).alias("orow"), (F.col("ocol") % 16).alias("ocol"), "value"), layout)
    with pytest.raises(Exception, match="lost"):
        options = {"grid": json.dumps(S.asdict(GRID)), "layout": json.dumps(S.asdict(layout)), "bands": 1, "levels": 1, "block": 16}
        packed.repartition("name").sortWithinPartitions("name").write.format("tiled_tiff").mode("overwrite").options(**options).save(str(folder))
    assert {n: (folder / n).read_bytes() for n in os.listdir(folder)} == before
    # Rows of a block that don't follow each other are an error, not a file that lost some.
    good = tiff.pack(cells.select(F.concat_ws("_", F.lit("block"), F.expr("orow div 16"), F.expr("ocol div 16")).alias("name"), "band", (F.col("orow") % 16).alias("orow"), (F.col("ocol") % 16).alias("ocol"), "value"), layout)
    with pytest.raises(PythonException, match="follow each other"):
        doubled = good.unionByName(good).withColumn("n", F.monotonically_increasing_id()).coalesce(1).sortWithinPartitions("n").drop("n")
        doubled.write.format("tiled_tiff").mode("overwrite").options(**options).save(str(folder))
    assert {n: (folder / n).read_bytes() for n in os.listdir(folder)} == before


def test_from_any_folder(tmp_path):
    """The package reaches the workers from a folder that isn't its own."""
    path = make(tmp_path / "a.tif", DATA)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {top!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").getOrCreate()
from gridloom import api
from gridloom.plans.spec import WarpSpec
print("cells", api.warp(api.sources(spark, [{path!r}]), WarpSpec(bands=(1,))).cells.count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, timeout=240, env=env)
    assert f"cells {40 * 52}" in out.stdout, out.stderr[-3000:]


def test_lists_of_paths(spark, tmp_path):
    paths = [make(tmp_path / "a.tif", DATA), make(tmp_path / "b.tif", DATA)]
    S.register(spark)
    tiles = spark.read.format("tiled_tiff").option("paths", json.dumps(paths)).load()
    assert tiles.select("src").distinct().count() == 2
    with pytest.raises(Exception, match="nowhere"):
        read(spark, tmp_path / "nowhere").count()
    assert np.array(tiles.first().data).size == 16 * 16
