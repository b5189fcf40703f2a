import warnings

import pytest
from pyspark.sql import functions as F

from gridloom.functions import crs
from gridloom.operators import raster, stack
from gridloom.operators.warp import dense, gather, mosaic, scatter
from gridloom.plans import fixtures as X
from gridloom.plans import windows as W
from gridloom.plans.spec import METHODS, WarpSpec, methods_for
from gridloom.sources.auth import boolean, hadoop_options, settings_for

NORTH = (5e5, 10, 0, 4002560, 0, -10)
SOUTH = (5e5, 10, 0, 4000960, 0, 10)
TE = (500400, 4001260, 501500, 4002160)
FULL = (500000, 3997440, 505120, 4002560)


def planned(spark, gt, width, height, **spec):
    rows = W.plan(X.one_source(spark, 0, gt, width, height, 3), WarpSpec(**spec)).collect()
    return [(r.level, r.xoff, r.yoff, r.xsize, r.ysize, r.is_copy, r.win_gt.gt0, r.win_gt.gt3, r.win_gt.gt1) for r in rows]


@pytest.mark.parametrize(
    ("gt", "size", "spec", "want"),
    [
        (NORTH, (192, 160), {}, (1, 0, 0, 192, 160, True, 500000, 4002560, 10)),
        (NORTH, (192, 160), {"te": TE}, (1, 40, 40, 110, 90, True, 500400, 4002160, 10)),
        (NORTH, (192, 160), {"te": TE, "tr": (15, 15)}, (1, 32, 32, 126, 106, False, 500320, 4002240, 10)),
        (SOUTH, (192, 160), {"te": (500400, 4001360, 501500, 4002260), "tr": (15, 15)}, (1, 32, 32, 126, 106, False, 500320, 4001280, 10)),
        (NORTH, (512, 512), {"te": FULL, "tr": (15, 15)}, (1, 0, 0, 512, 512, False, 500000, 4002560, 10)),
        (NORTH, (512, 512), {"te": FULL, "tr": (39.9, 39.9)}, (2, 0, 0, 256, 256, False, 500000, 4002560, 20)),
        (NORTH, (512, 512), {"te": FULL, "tr": (400, 400)}, (3, 0, 0, 128, 128, False, 500000, 4002560, 40)),
        (NORTH, (512, 512), {"te": FULL, "ts": (100, 100)}, (3, 0, 0, 128, 128, False, 500000, 4002560, 40)),
        (NORTH, (512, 512), {"te": TE, "tr": (40, 40), "overview": 9}, (3, 2, 2, 44, 39, False, 500080, 4002480, 40)),
        (NORTH, (512, 512), {"te": TE, "overview": 2}, (2, 20, 20, 55, 45, True, 500400, 4002160, 20)),
        (NORTH, (192, 160), {"te": (500404, 4001264, 501496, 4002156)}, (1, 40, 40, 110, 90, True, 500400, 4002160, 10)),
    ],
)
def test_window_plans(spark, gt, size, spec, want):
    assert planned(spark, gt, *size, **spec) == [want]


def test_no_overlap(spark):
    far = X.one_source(spark, 0, (9e6, 10, 0, 9e6, 0, -10), 48, 48)
    none = W.plan(far, WarpSpec(te=(5e5, 4002240, 500320, 4002560), tr=(10, 10)))
    assert none.isEmpty()
    with pytest.raises(ValueError, match="does not overlap"):
        W.require_overlap(none)


def test_spec_is_checked_before_any_job():
    for bad in ({"te": (1, 2, 0, 3)}, {"tr": (1, 1), "ts": (2, 2)}, {"tr": (0, 1)}, {"method": "best"}, {"bands": (0,)}, {"t_srs": "EPSG:27700"}, {"overview": 0}):
        with pytest.raises(ValueError):
            WarpSpec(**bad)
    assert methods_for(None, 2) == ["near", "near"]
    with pytest.raises(ValueError):
        methods_for(["near", "sum"], 3)


def test_tap_is_idempotent():
    g = WarpSpec(te=(7, 1, 988, 999), tr=(15, 30)).grid()
    again = WarpSpec(te=(g.xmin, g.ymax - g.height * g.yres, g.xmin + g.width * g.xres, g.ymax), tr=(15, 30)).grid()
    assert g == again


def test_published_utm_points(spark):
    # Equator and central meridian are exact; the third is the CN Tower (17N, 630084 4833439).
    one = spark.range(1)
    for lon, lat, code, want in ((3.0, 0.0, "EPSG:32631", (500000.0, 0.0)), (-79.387139, 43.642567, "EPSG:32617", (630084.0, 4833439.0))):
        x, y = crs.transform("EPSG:4326", code, F.lit(lon), F.lit(lat))
        back = crs.transform(code, "EPSG:4326", x, y)
        r = one.select(x.alias("x"), y.alias("y"), back[0].alias("lon"), back[1].alias("lat")).first()
        assert (r.x, r.y) == pytest.approx(want, abs=1.0)
        assert (r.lon, r.lat) == pytest.approx((lon, lat), abs=1e-9)
    with pytest.raises(ValueError):
        crs.transform("EPSG:4326", "EPSG:2154", F.lit(0.0), F.lit(0.0))


def ramp(spark, width, height, src=0, value="id * 7 % 101 + 1"):
    return spark.range(width * height).select(F.lit(src).alias("src_idx"), F.lit(1).alias("band"), F.expr(f"id div {width}").alias("row"), (F.col("id") % width).alias("col"), F.expr(value).cast("double").alias("value"))


def test_any_number_of_spellings(spark):
    """201 spellings of one system are that system; an unsupported one, or none, raises rather than vanishing."""
    src = X.one_source(spark, 0, (0, 1, 0, 12, 0, -1), 16, 12).drop("crs", "src_idx")
    many = src.crossJoin(spark.range(201).select(F.col("id").cast("int").alias("src_idx"), F.concat(F.lit("epsg:4326"), F.expr("repeat(' ', cast(id as int))")).alias("crs")))
    px = ramp(spark, 16, 12).drop("src_idx").crossJoin(spark.range(201).select(F.col("id").cast("int").alias("src_idx")))
    grid = X.grid((0, 0, 16, 12), 4, 4, "EPSG:4326")
    assert gather(px, many, grid).select("src_idx").distinct().count() == 201
    assert W.plan(many, WarpSpec(te=(0, 0, 9, 9), te_srs="EPSG:4326")).count() == 201
    assert gather(px, many.limit(0), grid).count() == 0 and W.plan(many.limit(0), WarpSpec(te=(0, 0, 9, 9), te_srs="EPSG:4326")).count() == 0
    for bad in ("EPSG:9999", None):
        one = many.limit(3).withColumn("crs", F.lit(bad).cast("string"))
        with pytest.raises(Exception, match="coordinate system"):
            gather(px, one, grid).collect()
        with pytest.raises(Exception, match="coordinate system"):
            W.plan(one, WarpSpec(te=(0, 0, 9, 9), te_srs="EPSG:4326")).collect()


def test_plans_across_systems(spark):
    """Level and window by the extent in the right system, whichever system it is given in."""
    src = X.one_source(spark, 0, NORTH, 512, 512)
    corners = [spark.range(1).select(*crs.transform("EPSG:32631", "EPSG:4326", F.lit(x), F.lit(y))).first() for x, y in ((501000.0, 3999000.0), (504000.0, 4001000.0))]
    te = (*corners[0], *corners[1])
    one = W.plan(src, WarpSpec(te=te, te_srs="EPSG:4326", t_srs="EPSG:32631", tr=(10, 10))).first()
    assert one.level == 1 and abs(one.win_gt.gt0 - 500920) <= 20
    assert W.plan(src, WarpSpec(te=te, te_srs="EPSG:4326", t_srs="EPSG:32631", tr=(41, 41))).first().level == 3
    assert W.plan(src, WarpSpec(t_srs="EPSG:4326", tr=(0.01, 0.01))).first().level == 3
    assert W.plan(src, WarpSpec(te=te, te_srs="EPSG:4326", tr=(21, 21))).first().level == 2
    g = W.output_grid(src, WarpSpec(te=te, te_srs="EPSG:4326", t_srs="EPSG:32631", tr=(10, 10)))
    assert (g.xmin, g.crs) == (pytest.approx(501000, abs=10), "EPSG:32631") and g.width == pytest.approx(300, abs=3) and g.height == pytest.approx(200, abs=3)
    assert W.output_grid(src, WarpSpec()) == X.grid((500000, 3997440, 505120, 4002560), 512, 512, "EPSG:32631")
    whole = W.output_grid(src, WarpSpec(t_srs="EPSG:4326", ts=(10, 20)))
    assert (whole.width, whole.height) == (10, 20) and whole.xmin == pytest.approx(3.0, abs=0.01)
    with pytest.raises(ValueError, match="another system"):
        WarpSpec(te=te, te_srs="EPSG:4326", t_srs="EPSG:32631", tr=(10, 10)).grid()
    with pytest.raises(Exception, match="no band 2"):
        W.plan(src, WarpSpec(bands=(1, 2))).collect()
    with pytest.raises(Exception, match="no georeference"):
        W.plan(src.withColumn("gt", F.lit(None).cast(src.schema["gt"].dataType)), WarpSpec()).collect()


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("gt", [(0, 1, 0, 12, 0, -1), (0, 1, 0, 0, 0, 1)])
def test_both_plans_agree(spark, method, gt):
    src = X.one_source(spark, 0, gt, 16, 12, nodata=5.0)
    px = ramp(spark, 16, 12)
    for grid in (X.grid((0.3, 0.2, 15.8, 11.7), 5, 4), X.grid((-2.1, 1.3, 9.4, 13.9), 17, 19)):
        a, b = ({(r.orow, r.ocol): r.value for r in f(px, src, grid, method).collect()} for f in (scatter, gather))
        assert a.keys() == b.keys()
        assert all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9) for k in a)


def test_constant_stays_constant_and_identity_is_copy(spark):
    src, px = X.one_source(spark, 0, (0, 1, 0, 12, 0, -1), 16, 12), ramp(spark, 16, 12)
    const = px.withColumn("value", F.lit(3.5))
    grid = X.grid((1.0, 1.0, 15.0, 11.0), 9, 5)
    for m in set(METHODS) - {"sum"}:
        assert scatter(const, src, grid, m).where("abs(value - 3.5) > 1e-9").isEmpty()
    same = scatter(px, src, X.grid((0, 0, 16, 12), 16, 12), "near")
    assert same.join(px.withColumnRenamed("value", "v"), (F.col("row") == F.col("orow")) & (F.col("col") == F.col("ocol"))).where("value = v").count() == 192


def test_mosaic_of_a_split_raster_is_the_raster(spark):
    px, grid = ramp(spark, 16, 12), X.grid((0, 0, 16, 12), 8, 6)
    whole = dense(mosaic(scatter(px, X.one_source(spark, 0, (0, 1, 0, 12, 0, -1), 16, 12), grid, "average")), grid, [1])
    halves = px.withColumn("src_idx", F.when(F.col("col") < 8, 0).otherwise(1)).withColumn("col", F.col("col") % 8)
    two = X.one_source(spark, 0, (0, 1, 0, 12, 0, -1), 8, 12).unionAll(X.one_source(spark, 1, (8, 1, 0, 12, 0, -1), 8, 12))
    assert whole.exceptAll(dense(mosaic(scatter(halves, two, grid, "average")), grid, [1])).isEmpty()
    assert raster.to_numpy(whole, 8, 6, 1).shape == (1, 6, 8)
    with pytest.raises(MemoryError):
        raster.to_numpy(whole, 8, 6, 1, most_bytes=10)


def test_tiles_round_trip(spark, tmp_path):
    px = ramp(spark, 19, 13)
    for size in (4, 8):
        path = f"{tmp_path}/{size}"
        raster.to_tiles(px, size).write.parquet(path)
        back = raster.from_tiles(spark.read.parquet(path), size)
        assert back.select(*px.columns).exceptAll(px).isEmpty()
        assert back.count() == 19 * 13


def test_stack_orders_bands_and_labels(spark):
    src = X.one_source(spark, 0, (0, 1, 0, 2, 0, -1), 2, 2).unionAll(X.one_source(spark, 1, (0, 1, 0, 2, 0, -1), 2, 2, 2))
    px = ramp(spark, 2, 2, 0, "11").unionAll(ramp(spark, 2, 2, 1, "21")).unionAll(ramp(spark, 2, 2, 1, "22").withColumn("band", F.lit(2)))
    out = stack.stack(px, src, X.grid((0, 0, 2, 2), 2, 2), ["near", "average"])
    assert {(r.band, r.value) for r in out.select("band", "value").distinct().collect()} == {(1, 11.0), (2, 21.0), (3, 22.0)}
    assert [r.label for r in stack.labels(src).orderBy("out_band").collect()] == ["s0", "s1_b1", "s1_b2"]


def test_one_grid_is_required(spark):
    a, b = X.one_source(spark, 0, NORTH, 8, 8), X.one_source(spark, 1, SOUTH, 8, 8)
    W.require_one_grid(a.unionAll(a))
    with pytest.raises(ValueError, match="share one grid"):
        W.require_one_grid(a.unionAll(b))


def test_options_from_settings():
    assert [boolean(x) for x in ("yes", "0", "", "maybe", None)] == ["true", "false", None, None, None]
    assert hadoop_options({"AWS_S3_ENDPOINT": "minio:9000", "AWS_HTTPS": "NO", "AWS_VIRTUAL_HOSTING": "FALSE"}) == {"fs.s3a.endpoint": "http://minio:9000", "fs.s3a.connection.ssl.enabled": "false", "fs.s3a.path.style.access": "true"}
    assert hadoop_options({"AWS_REQUEST_PAYER": "Requester"}) == {"fs.s3a.requester.pays.enabled": "true"}
    assert hadoop_options({}) == {}
    with warnings.catch_warnings(record=True) as found:
        warnings.simplefilter("always")
        hadoop_options({"GS_ACCESS_KEY_ID": "x", "AZURE_STORAGE_CONNECTION_STRING": "y"})
    assert len(found) == 2
    of = "my.dfs.core.windows.net"
    assert hadoop_options({"AZURE_STORAGE_ACCOUNT": "my", "AZURE_NO_SIGN_REQUEST": "YES", "AZURE_STORAGE_ACCESS_KEY": "k"}) == {f"fs.azure.account.auth.type.{of}": "Anonymous"}
    assert hadoop_options({"AZURE_STORAGE_ACCOUNT": "my", "AZURE_STORAGE_ACCESS_KEY": "k", "AZURE_STORAGE_SAS_TOKEN": "t"}) == {f"fs.azure.account.key.{of}": "k"}
    assert hadoop_options({"AWS_NO_SIGN_REQUEST": "YES", "GS_NO_SIGN_REQUEST": "1"}) == {"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider", "fs.gs.auth.type": "UNAUTHENTICATED"}


def test_later_settings_win():
    env = {"AWS_REGION": "b", "PATH": "x", "google_x": "y", "AZURE_STORAGE_SAS_TOKEN": "old"}
    url = "https://My.blob.core.windows.net:443/c/f.tif?sp=r&sig=x#part"
    assert settings_for({"AWS_REGION": "a", "AWS_HTTPS": "NO"}, env) == {"AWS_REGION": "b", "AWS_HTTPS": "NO", "google_x": "y", "AZURE_STORAGE_SAS_TOKEN": "old"}
    assert settings_for({}, env, url)["AZURE_STORAGE_SAS_TOKEN"] == "sp=r&sig=x"
    for other in (url.replace("https", "http"), url.replace("sig=", "Sig="), url.replace(".blob.", ".x."), "s3://b/k?sig=1", None):
        assert settings_for({}, env, other)["AZURE_STORAGE_SAS_TOKEN"] == "old"
