"""Extents across the antimeridian and around poles, levels of mixed systems, overlaps by cells, blocks of cells."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom import api
from gridloom.functions import crs as C
from gridloom.operators.overlap import overlap_pairs
from gridloom.operators.warp import cell_blocks, cells, dense_blocks, covered_blocks, mosaic, warp_windows
from gridloom.plans import fixtures as X
from gridloom.plans import windows as W
from gridloom.plans.spec import OutGrid, WarpSpec


def source(spark, idx, x0, y0, px, crs, n=100):
    return X.one_source(spark, idx, (x0, px, 0.0, y0, 0.0, -px), n, n, crs=crs)


def test_both_sides_of_the_antimeridian(spark):
    """An extent in metres around 180 degrees meets sources on both sides of it, and a source of the whole world twice."""
    src = source(spark, 1, 179.0, 60.5, 0.01, "EPSG:4326").unionByName(source(spark, 2, -180.0, 60.5, 0.01, "EPSG:4326")).unionByName(X.one_source(spark, 3, (-180.0, 0.1, 0.0, 90.0, 0.0, -0.1), 3600, 1800, crs="EPSG:4326")).unionByName(source(spark, 4, 10.0, 60.5, 0.01, "EPSG:4326"))
    spec = WarpSpec(te=(310_000, 6_650_000, 370_000, 6_700_000), t_srs="EPSG:32601", tr=(1000, 1000), method="bilinear")
    planned = W.plan(src, spec)
    box = C.boxes(spark, spec.te, "EPSG:32601", ["EPSG:4326"])["EPSG:4326"]
    assert -181 < box[0] < -180 < box[2] < -179 and 59 < box[1] < box[3] < 61
    got = {(r.src_idx, r.turn): r for r in planned.collect()}
    assert set(got) == {(1, 1), (2, 0), (3, 0), (3, 1)}
    assert got[(1, 1)].win_gt.gt0 < -180.4 and got[(3, 0)].xoff == 0 and got[(3, 1)].xoff + got[(3, 1)].xsize == 3600
    # Values across the line: a source that counts its longitude from 0, as pixels, comes out without a seam.
    pixels = planned.where("src_idx = 3").select("src_idx", "turn", F.col("win_gt").alias("gt"), "nodata", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ysize") - 1)).alias("row"), "xsize")
    pixels = pixels.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("xsize") - 1))).select("src_idx", "turn", F.lit(1).alias("band"), "row", "col", (F.col("gt.gt0") + (F.col("col") + 0.5) * F.col("gt.gt1")).alias("value"), "gt", "nodata")
    grid = W.output_grid(src, spec)
    out = mosaic(warp_windows(pixels, W.as_catalog(planned.where("src_idx = 3")), grid, "bilinear")).collect()
    assert len(out) == grid.width * grid.height
    x = {(r.orow, r.ocol): r.value for r in out}
    steps = [x[(10, c + 1)] - x[(10, c)] for c in range(grid.width - 1)]
    assert min(steps) > 0 and max(steps) < 2 * min(steps)


def test_metres_on_either_side(spark):
    """Degrees that go on beyond 180 meet what lies beyond -180 in Mercator and in a UTM zone."""
    edge = C.turn("EPSG:3857") / 2
    src = source(spark, 1, -edge, 8_500_000.0, 500.0, "EPSG:3857").unionByName(source(spark, 2, edge - 50_000, 8_500_000.0, 500.0, "EPSG:3857")).unionByName(source(spark, 3, 340_000.0, 6_700_000.0, 500.0, "EPSG:32601"))
    planned = W.plan(src, WarpSpec(te=(179.8, 60.0, 180.2, 60.3), t_srs="EPSG:4326", tr=(0.01, 0.01)))
    assert {(r.src_idx, r.turn) for r in planned.collect()} == {(1, -1), (2, 0), (3, 0)}
    grid = OutGrid(179.0, 61.0, 0.05, 0.05, 40, 40, "EPSG:4326")
    under = cells(src.where("src_idx = 3"), grid, "EPSG:32601", 0).agg(F.count("*"), F.min("ocol"), F.max("ocol")).first()
    assert under[0] > 50 and under[1] >= 20 and under[2] <= 39


def test_extents_with_a_pole(spark):
    polar = C.normalise("+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +ellps=WGS84")
    box = C.boxes(spark, (-1e6, -1e6, 1e6, 1e6), polar, ["EPSG:4326", "EPSG:3857"])
    w, s, e, n = box["EPSG:4326"]
    assert n == 90 and e - w >= 360 and 76 < s < 79
    assert box["EPSG:3857"][2] - box["EPSG:3857"][0] >= C.turn("EPSG:3857") - 1
    aside = C.boxes(spark, (5e5, 5e5, 1e6, 1e6), polar, ["EPSG:4326"])["EPSG:4326"]
    assert aside[2] - aside[0] < 60 and aside[3] < 86


def test_levels_follow_the_grid_not_the_first_source(spark):
    """Of two systems, with and without a named one: the same levels."""
    degrees = source(spark, 1, 5.0, 50.0, 0.0001, "EPSG:4326", 400)
    metres = source(spark, 2, 643_000.0, 5_540_000.0, 10.0, "+proj=utm +zone=31 +datum=WGS84", 400)
    for cat in (degrees.unionByName(metres), degrees.withColumn("src_idx", F.lit(3)).unionByName(metres)):
        named = {r.crs: r.level for r in W.plan(cat, WarpSpec(tr=(25, 25), t_srs="EPSG:32631")).collect()}
        assert set(named) == {"EPSG:4326", "EPSG:32631"} and named["EPSG:32631"] == 2
        first = min(cat.collect(), key=lambda r: r.src_idx)
        planned, grid = W.plan_on_grid(cat, WarpSpec(tr=(25, 25) if first.src_idx == 2 else (0.0003, 0.0003)))
        assert grid.crs == C.normalise(first.crs)
    planned, grid = api._planned(cat, WarpSpec(tr=(25, 25), t_srs="EPSG:32631"))
    assert {r.crs: r.level for r in planned.collect()} == named


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(9)

    def boxes(n, key):
        rows = []
        for i in range(n):
            x, y, side = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.01, 0.5, 2.0, 8.0, 300.0])
            rows.append((i, round(x, 1), round(y, 1), round(x, 1) + side, round(y, 1) + rng.choice([side, side / 7])))
        rows += [(n, 0.0, 0.0, 0.0, 5.0), (n + 1, None, 0.0, 1.0, 1.0), (n + 2, -8.0, -8.0, 8.0, 8.0)]
        return rows, spark.createDataFrame(rows, f"{key} int, xmin double, ymin double, xmax double, ymax double")

    (a, left), (b, right) = boxes(150, "l"), boxes(200, "r")
    got = [tuple(r) for r in overlap_pairs(left, right, "l", "r").collect()]
    fine = lambda t: None not in t and t[1] < t[3] and t[2] < t[4]
    want = {(p[0], q[0]) for p in a for q in b if fine(p) and fine(q) and p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    assert overlap_pairs(left.limit(0), right, "l", "r").count() == 0
    plan = overlap_pairs(left, right, "l", "r")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_of_a_large_source_are_spread(spark):
    """No task makes all cells of a source."""
    src = source(spark, 1, 500_000.0, 5_500_000.0, 100.0, "EPSG:32631", 2000)
    grid = W.output_grid(src, WarpSpec(t_srs="EPSG:3857", tr=(400, 400)))
    n = cells(src, grid, "EPSG:32631", 0).groupBy(F.spark_partition_id()).count().collect()
    total = sum(r["count"] for r in n)
    assert len(n) == 4 and max(r["count"] for r in n) < 0.5 * total and total > 300_000
    assert cell_blocks(src, grid, "EPSG:32631", 0).count() > 50


def test_cells_of_covered_blocks_only(spark):
    """Two small sources at the ends of a large grid: what is filled costs what they cost."""
    src = source(spark, 1, 0.0, 0.0, 1.0, "EPSG:32631", 10).unionByName(source(spark, 2, 100_000.0, -100_000.0, 1.0, "EPSG:32631", 10))
    grid = OutGrid(0.0, 0.0, 1.0, 1.0, 100_010, 100_010, "EPSG:32631")
    covered = covered_blocks(src, grid, 16)
    assert {tuple(r) for r in covered.collect()} == {(0, 0), (6250, 6250), (6249, 6249), (6249, 6250), (6250, 6249)}
    one = spark.createDataFrame([(1, 3, 4, 7.0)], "band int, orow long, ocol long, value double")
    filled = dense_blocks(one, covered, grid, [1, 2], -1.0, 16).collect()
    assert len(filled) == sum(2 * min(16, 100_010 - 16 * r) * min(16, 100_010 - 16 * c) for r, c in ((0, 0), (6250, 6250), (6249, 6249), (6249, 6250), (6250, 6249)))
    assert [(r.band, r.orow, r.ocol) for r in filled if r.value == 7.0] == [(1, 3, 4)] and {r.value for r in filled} == {7.0, -1.0}


def test_requests_without_a_system_in_common(spark):
    src = source(spark, 1, 0.0, 100.0, 1.0, "EPSG:32631").unionByName(source(spark, 2, 0.0, 100.0, 1.0, "EPSG:32632"))
    asked = spark.createDataFrame([(1, "EPSG:32632", 10.0, 10.0, 20.0, 30.0), (2, "EPSG:32633", 10.0, 10.0, 20.0, 30.0)], "req_idx int, crs string, xmin double, ymin double, xmax double, ymax double")
    got = W.plan_requests(src, asked, WarpSpec()).collect()
    assert [(r.req_idx, r.src_idx, r.xoff, r.yoff, r.xsize, r.ysize, r.is_copy) for r in got] == [(1, 2, 10, 70, 10, 20, True)]


def test_unsupported_systems_are_named(spark):
    src = source(spark, 1, 0.0, 0.0, 1.0, "+proj=krovak")
    with pytest.raises(ValueError, match="krovak"):
        W.plan(src, WarpSpec(te=(0, 0, 1, 1), t_srs="EPSG:4326"))
