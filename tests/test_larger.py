"""Queries against their SQL on tables of other sizes than the smallest ones."""

import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import crs as C
from gridloom.operators.resample import combine
from gridloom.operators.warp import cells
from gridloom.plans import fixtures as X
from gridloom.plans.catalogue import ORACLES, QUERIES, rounded
from gridloom.plans.spec import OutGrid
from gridloom.sources import tiff
from tests.conftest import SMALL, _plain


@pytest.fixture
def held(spark, tmp_path):
    """Holds a query against its SQL on tables made by SQL from the smallest ones."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            smallest = f"read_parquet('{SMALL}/{table}.parquet')"
            con.execute(f"COPY ({sql.format(smallest)}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
        a, b = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLES[name]).df()
        assert sorted(a.columns) == sorted(b.columns) and len(b)
        rows = [sorted(tuple(map(_plain, r)) for r in x[sorted(x.columns)].itertuples(index=False)) for x in (a, b)]
        assert rows[0] == rows[1]

    return check


def test_bounds_at_and_beyond_a_pole(held):
    held("bounds_densified", supplier="SELECT s.* REPLACE (s_suppkey + k * 10 AS s_suppkey) FROM {} s, range(490, 520) t(k)")


def test_southern_latitudes_are_as_exact_as_northern_ones(spark):
    lat = spark.createDataFrame([(v,) for v in (0.0, 1e-9, 45.0, 89.0, 89.99999, 90.0)], "lat double")
    north, south = (C.transform("EPSG:4326", "EPSG:3857", F.lit(0.0), F.col("lat") * s)[1] for s in (1, -1))
    assert all(r.n == -r.s for r in lat.select(north.alias("n"), south.alias("s")).collect())


def parts(times):
    return f"SELECT p.* REPLACE (p_partkey + k * 200 AS p_partkey) FROM {{}} p, range({times}) t(k)"


def test_cells_up_to_a_pole(held):
    held("reproject_3857_near", part=parts(1790))


@pytest.mark.parametrize("name", ["reproject_3857_near", "warp_whole_extent", "gather_bilinear"])
def test_taps_are_not_broadcast(spark, name):
    """They are as many as the grid has cells, though they come of a catalog's one row."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+Join) \[[^\]]*\brow#", plan) == ["SortMergeJoin"]


@pytest.mark.parametrize("target", ["EPSG:3857", "+proj=merc +lon_0=10 +ellps=WGS84"])
def test_a_source_of_the_whole_world_covers_mercator(spark, target):
    """As far south as north, whichever points of its edges are looked at."""
    world = X.one_source(spark, 1, (-180.0, 1.0, 0.0, 90.0, 0.0, -1.0), 360, 180, crs="EPSG:4326")
    grid = OutGrid(-1.8e7, 1.9e7, 1e6, 1e6, 36, 38, C.normalise(target))
    assert cells(world, grid, "EPSG:4326", 0).select("orow", "ocol").distinct().count() == 36 * 38


@pytest.mark.parametrize("name", ["warp_te_srs", "warp_whole_extent"])
def test_extents_between_degrees_and_mercator_are_those_of_their_corners(held, name):
    held(name, part=parts(3125))


def test_rounding_keeps_the_sign_of_small_numbers(spark):
    """As DuckDB's: over a larger table warp_cubicspline differed from its SQL in nothing else."""
    values = [-3e-7, -5e-7, -0.1234565, 0.1234565, 3e-7, 0.0, None]
    got = [r.value for r in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value double").repartition(1)).orderBy("i").collect()]
    want = [r[0] for r in duckdb.sql(f"SELECT round(v, 6) FROM (SELECT unnest(range({len(values)})) AS i, unnest([{', '.join('NULL' if v is None else f'{v!r}::DOUBLE' for v in values)}]) AS v) ORDER BY i").fetchall()]
    assert list(map(repr, got)) == list(map(repr, want)) and repr(got[0]) == "-0.0"


@pytest.mark.parametrize("vectors", [211, 236, 239])
def test_cells_of_the_least_weights_have_values(held, vectors):
    """Where the last row of pixels ends early, a cell may have one pixel of a weight of 1e-11."""
    held("warp_cubicspline", embeddings=f"SELECT * FROM {{}} WHERE vec_id < {vectors}")


def test_weights_that_cancel_out_make_no_cell(spark):
    rows = spark.createDataFrame([(1, 3.0, 1e-12), (2, 3.0, 0.1), (2, 5.0, -0.1 + 1e-12), (3, 3.0, 0.0625), (3, 5.0, -0.03125)], "k int, value double, w double")
    assert sorted(map(tuple, combine(rows, ["k"], "cubic").collect())) == [(1, 3.0), (3, 1.0)]
    assert sorted(r.k for r in combine(rows, ["k"], "cubicspline").collect()) == [1, 2, 3]


def test_a_task_packs_one_tile_at_a_time(spark):
    """Whatever the number of tiles in a partition."""

    class Held(tiff.Layout):
        def packed(self, block):
            return len(sys._getframe(1).f_locals["rows"]).to_bytes(4, "little")

    cells = spark.range(40 * 64).select(F.lit("x").alias("name"), F.lit(1).alias("band"), F.expr("id div 8").alias("orow"), (F.col("id") % 8).alias("ocol"), F.rand(1).alias("value"))
    made = tiff.pack(cells.repartition(1), Held(tile=8), 1).select("level", "data").collect()
    assert len(made) == 40 + 20 and {int.from_bytes(r.data, "little") for r in made} == {1}
