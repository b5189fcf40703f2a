"""Requests tried out on the catalog, and batches that hold sources no request can use."""

import numpy as np
from pyspark.sql import functions as F
from test_tiff import DATA, make

from gridloom import api
from gridloom.plans import fixtures as X
from gridloom.plans.preflight import preflight
from gridloom.plans.spec import WarpSpec


def many(spark, n, **odd):
    """n grids side by side; one of them with columns of its own."""
    cat = X.one_source(spark, 0, X.EMB_GT, 128, 128).drop("src", "src_idx").crossJoin(spark.range(n).select(F.col("id").cast("int").alias("src_idx"), F.format_string("s%d.tif", "id").alias("src")))
    cat = cat.withColumn("gt", F.struct((F.col("gt.gt0") + F.col("src_idx") * 10.0).alias("gt0"), *[F.col(f"gt.gt{i}").alias(f"gt{i}") for i in range(1, 6)]))
    return cat.withColumns({k: F.when(F.col("src_idx") == 700, v).otherwise(F.col(k)) for k, v in odd.items()})


def test_one_bad_grid_of_a_thousand(spark):
    moved = F.struct(F.lit(3e7).alias("gt0"), *[F.col(f"gt.gt{i}").alias(f"gt{i}") for i in range(1, 6)])
    out = preflight(many(spark, 1000, gt=moved), WarpSpec(t_srs="EPSG:3857"))
    (bad,) = out.where("error is not null").collect()
    assert (bad.src_idx, bad.src) == (700, "s700.tif") and "lead back" in bad.error and out.count() == 1000
    (bad,) = preflight(many(spark, 1000, crs=F.lit("+proj=nothing")), WarpSpec()).where("error is not null").collect()
    assert bad.error == "an unknown coordinate system in s700.tif"
    assert preflight(many(spark, 3), WarpSpec(t_srs="+proj=laea +lat_0=40 +lon_0=10")).where("error is not null").isEmpty()


def test_formulas_run_once_a_grid(spark):
    """A thousand sources of one grid are 16 points."""
    same = many(spark, 1000).withColumn("gt", X.gt_struct(X.EMB_GT))
    out = preflight(same, WarpSpec(t_srs="EPSG:4326"))
    assert out.count() == 1000 and out.where("error is not null").isEmpty()
    from gridloom.plans.preflight import _grids

    own = same.select("gt", "width", "height", F.lit("EPSG:32631").alias("system"), F.lit("one").alias("sig"))
    assert [tuple(r) for r in _grids(own, ["EPSG:32631"], "EPSG:4326").collect()] == [("one", 16, 0)]
    assert preflight(same.limit(0), WarpSpec(t_srs="EPSG:4326")).isEmpty() and preflight(same.limit(0), WarpSpec()).isEmpty()


def test_around_the_antimeridian_is_no_fault(spark):
    gt = (179.0, 0.02, 0.0, 60.0, 0.0, -0.02)
    cat = X.one_source(spark, 1, gt, 128, 128, crs="EPSG:4326")
    assert preflight(cat, WarpSpec(t_srs="EPSG:32601")).first().error is None
    assert preflight(cat, WarpSpec(te=(178.0, 50.0, 182.0, 60.0))).first().error is None


def test_a_batch_with_unusable_sources(spark, tmp_path):
    """An unknown system costs its own group only."""
    unknown = (1, 1, 0, 2, 1025, 0, 1, 1, 3072, 0, 1, 9999)
    paths = [make(tmp_path / "a.tif", DATA[:1]), make(tmp_path / "b.tif", DATA[:1], keys=unknown)]
    rows = spark.createDataFrame([(i, p, i, 1) for i, p in enumerate(paths, 1)], "src_idx int, src string, group_idx long, band_pos long")
    spec = WarpSpec(te=(500000, 4002160, 500520, 4002560), tr=(10, 10), t_srs="EPSG:32631")
    cat = api.sources(spark, rows, strict=False).cache()
    assert {r.src_idx: r.error is None for r in api.preflight(cat, spec).collect()} == {1: True, 2: False}
    out = {r.group_idx: r for r in api.batch(cat, spec, f"{tmp_path}/o.tif", stack_groups=True).collect()}
    assert out[1].error is None and "unknown coordinate system" in out[2].error and out[2].path is None
    assert (api.warp(api.sources(spark, [out[1].path]), WarpSpec()).to_numpy() == DATA[:1]).all() and np.isfinite(DATA).all()
