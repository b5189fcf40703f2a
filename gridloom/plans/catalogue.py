"""The registered raster queries and the SQL that DuckDB runs against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import crs as projections
from gridloom.functions import metadata as M
from gridloom.functions.projections import Projection
from gridloom.functions.projections import forward as projected
from gridloom.operators import raster, stack
from gridloom.operators.overlap import overlap_pairs
from gridloom.operators.resample import FOOTPRINT, REACH
from gridloom.operators.warp import covered_blocks, dense, dense_blocks, gather, mosaic, scatter, warp_windows
from gridloom.plans import fixtures as X
from gridloom.plans import windows as W
from gridloom.plans.preflight import preflight
from gridloom.plans.spec import METHODS, OutGrid, WarpSpec
from gridloom.sources import dispatch as D
from gridloom.sources import datasource, tiff
from gridloom.sources.shared import shared_folder
from gridloom.streaming import batch as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6, column: str = "value") -> DataFrame:
    c = F.col(column)
    return df.withColumn(column, F.when(c < 0, -F.round(-c, digits)).otherwise(F.round(c, digits)))  # -0.0 as SQL's


# --- source strings ---------------------------------------------------------------------------------------------------

URLS = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url || '?AccessKeyId=a&Signature=b' WHEN 1 THEN url || '?x-amz-signature=b'
  WHEN 2 THEN 'https://acct.blob.core.windows.net/c/f.tif?sp=r&sig=x' WHEN 3 THEN 'https://acct.dfs.core.windows.net/c/f.tif?Sig=x'
  WHEN 4 THEN 's3://bucket/' || page_id || '.tif' WHEN 5 THEN 'C://data/f.tif' WHEN 6 THEN 'https://Host.example:8443/a/b.tif?X-Goog-Signature=1&z' ELSE url END AS src FROM pages"""
PARTS = rf"""u AS ({URLS}),
s AS (SELECT page_id, src, CASE WHEN length(regexp_extract(src, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) > 1 THEN lower(regexp_extract(src, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) END AS scheme,
  lower(regexp_extract(src, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS auth, regexp_extract(src, '^[^?#]*\?([^#]*)', 1) AS q,
  regexp_extract(src, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]*)', 1) AS container FROM u),
h AS (SELECT *, regexp_replace(regexp_replace(auth, '^.*@', ''), ':\d*$', '') AS host, list_transform(string_split(q, '&'), lambda x: lower(split_part(x, '=', 1))) AS keys FROM s),
k AS (SELECT *, coalesce(scheme IN ('http', 'https'), false) AND NOT regexp_matches(host, '\.(blob|dfs)\.core\.windows\.net$')
  AND ((list_contains(keys, 'accesskeyid') AND list_contains(keys, 'signature')) OR list_contains(keys, 'x-amz-signature') OR list_contains(keys, 'x-goog-signature')) AS presigned,
  coalesce(scheme = 'https', false) AND regexp_matches(host, '\.(blob|dfs)\.core\.windows\.net$') AND len(list_filter(string_split(q, '&'), lambda x: starts_with(x, 'sig='))) > 0 AS azure_sas FROM h)"""


@register("dispatch_kind", f"WITH {PARTS} SELECT page_id, CASE WHEN presigned THEN 'http' WHEN scheme IS NOT NULL AND scheme <> 'file' THEN 'store' ELSE 'local' END AS kind FROM k")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.urls(spark, sf).select("page_id", D.kind(F.col("src")).alias("kind"))


@register("presigned", f"WITH {PARTS} SELECT page_id, presigned FROM k")
def _(spark, sf):
    return X.urls(spark, sf).select("page_id", D.presigned(F.col("src")).alias("presigned"))


@register("azure_sas", f"WITH {PARTS} SELECT page_id, azure_sas FROM k")
def _(spark, sf):
    return X.urls(spark, sf).select("page_id", D.azure_sas(F.col("src")).alias("azure_sas"))


# --- metadata ---------------------------------------------------------------------------------------------------------


@register("geotransform", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 5e5 + s_suppkey ELSE 4e5 + s_suppkey - 3 * 20e0 END - b * CASE WHEN s_suppkey % 2 = 0 THEN 10e0 + 0.5e0 ELSE 20e0 END AS gt0,
  CASE WHEN s_suppkey % 2 = 0 THEN 10e0 ELSE 20e0 END AS gt1, CASE WHEN s_suppkey % 2 = 0 THEN 0.5e0 ELSE 0e0 END AS gt2,
  CASE WHEN s_suppkey % 2 = 0 THEN 4e6 ELSE 5e6 + 2 * 25e0 END - b * CASE WHEN s_suppkey % 2 = 0 THEN 0.25e0 - 10e0 ELSE -25e0 END AS gt3,
  CASE WHEN s_suppkey % 2 = 0 THEN 0.25e0 ELSE 0e0 END AS gt4, CASE WHEN s_suppkey % 2 = 0 THEN -10e0 ELSE -25e0 END AS gt5
  FROM (SELECT *, CASE WHEN s_suppkey % 3 = 2 THEN 0.5e0 ELSE 0e0 END AS b FROM supplier)""")
def _(spark, sf):
    k = F.col("s_suppkey")
    num = lambda *xs: F.array(*[x.cast("double") if hasattr(x, "cast") else F.lit(float(x)) for x in xs])
    matrix = F.when(k % 2 == 0, num(10, 0.5, 0, k + 500000, 0.25, -10, 0, 4000000, *[0] * 7, 1)).otherwise(F.array().cast("array<double>"))
    return X.table(spark, sf, "supplier").select("s_suppkey", M.geotransform(matrix, num(20, 25, 0), num(3, 2, 0, k + 400000, 5000000, 0), F.when(k % 3 == 2, 2).otherwise(1)).alias("gt")).select("s_suppkey", "gt.*")


CITATIONS = ["PROJCS[\"a\"]", "a note", "  GEOGCS (x", "PROJCSX[1]"]


@register("crs_resolve", """WITH t AS (SELECT *, CASE s_suppkey % 4 WHEN 0 THEN 'PROJCS["a"]' WHEN 1 THEN 'a note' WHEN 2 THEN '  GEOGCS (x' ELSE 'PROJCSX[1]' END AS cit,
  CASE s_suppkey % 5 WHEN 0 THEN 32631 WHEN 1 THEN 32767 WHEN 2 THEN 0 END AS epsg FROM supplier)
SELECT s_suppkey, CASE WHEN epsg NOT IN (0, 32767) THEN 'EPSG:' || epsg WHEN regexp_matches(cit, '^\\s*(PROJCS|GEOGCS)[\\[( ]') THEN cit WHEN s_suppkey % 3 = 0 THEN '+proj=longlat' END AS crs FROM t""".replace("\\\\", "\\"))
def _(spark, sf):
    k = F.col("s_suppkey")
    epsg = F.when(k % 5 == 0, 32631).when(k % 5 == 1, 32767).when(k % 5 == 2, 0)
    cite = F.get(F.array(*map(F.lit, CITATIONS)), (k % 4).cast("int"))
    return X.table(spark, sf, "supplier").select("s_suppkey", M.crs(epsg, [F.lit(None).cast("string"), cite], F.when(k % 3 == 0, "+proj=longlat")).alias("crs"))


def _case(names: dict, col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " END"


def _n(e: str) -> str:
    return f"CASE WHEN {e} = floor({e}) THEN ({e})::BIGINT::VARCHAR ELSE ({e})::VARCHAR END"


@register("proj_string", f"""WITH t AS (SELECT p_partkey, p_partkey % 29 AS code, CASE WHEN p_partkey % 7 < 4 THEN 3.5e0 + p_partkey % 5 END AS lon, CASE WHEN p_partkey % 2 = 0 THEN 47e0 END AS lat,
  CASE WHEN p_partkey % 3 = 0 THEN 500000e0 END AS x, CASE WHEN p_partkey % 3 = 1 THEN -0.25e0 END AS y, CASE WHEN p_partkey % 5 < 3 THEN 45.5e0 END AS l1, CASE WHEN p_partkey % 4 < 3 THEN 60e0 END AS l2,
  CASE WHEN p_partkey % 2 = 1 THEN 0.9996e0 END AS k, 8900 + p_partkey % 16 AS pm, CASE WHEN p_partkey % 11 = 0 THEN 2.5e0 END AS pd, 7000 + p_partkey % 50 AS el,
  CASE WHEN p_partkey % 3 = 0 THEN 6378137e0 END AS a, CASE WHEN p_partkey % 2 = 0 THEN 6356752.5e0 END AS b, CASE WHEN p_partkey % 5 = 0 THEN 298.25e0 END AS rf FROM part),
u AS (SELECT *, {_case(M.PROJECTIONS, 'code')} AS name, '+k_0=' || {_n('coalesce(k, 1e0)')} AS scaled, '+lat_ts=' || {_n('l1')} AS ts, '+lat_1=' || {_n('l1')} || ' +lat_2=' || {_n('l2')} AS pp, {_case(M.PRIME_MERIDIANS, 'pm')} AS pn, {_case(M.ELLIPSOIDS, 'el')} AS en FROM t)
SELECT p_partkey, CASE WHEN name IS NULL OR (code IN (8, 11, 13) AND pp IS NULL) THEN NULL ELSE concat_ws(' ', '+proj=' || name, '+lon_0=' || {_n('lon')}, '+lat_0=' || {_n('lat')}, '+x_0=' || {_n('x')}, '+y_0=' || {_n('y')},
  CASE WHEN code IN (1, 9, 14, 16) THEN scaled WHEN code IN (7, 15) THEN coalesce(ts, scaled) WHEN code IN (8, 11, 13) THEN pp WHEN code IN (17, 28) THEN ts END,
  CASE WHEN pm = 8901 THEN NULL WHEN pn IS NOT NULL THEN '+pm=' || pn WHEN pd <> 0 THEN '+pm=' || {_n('pd')} END,
  CASE WHEN en IS NOT NULL THEN '+ellps=' || en WHEN a IS NOT NULL AND rf IS NOT NULL THEN '+a=' || {_n('a')} || ' +rf=' || {_n('rf')} WHEN a IS NOT NULL AND b IS NOT NULL THEN '+a=' || {_n('a')} || ' +b=' || {_n('b')} WHEN a IS NOT NULL THEN '+a=' || {_n('a')} ELSE '+ellps=WGS84' END, '+no_defs') END AS proj FROM u""")
def _(spark, sf):
    k = F.col("p_partkey")
    v = lambda cond, x: F.when(cond, x if hasattr(x, "cast") else F.lit(float(x)))
    pm, el = (k % 16 + 8900).cast("int"), (k % 50 + 7000).cast("int")
    meridian = M.prime_meridian(pm, v(k % 11 == 0, 2.5))
    ellps = M.ellipsoid(el, v(k % 3 == 0, 6378137), v(k % 2 == 0, 6356752.5), v(k % 5 == 0, 298.25))
    proj = M.proj_string(k % 29, v(k % 7 < 4, k % 5 + 3.5), v(k % 2 == 0, 47), v(k % 3 == 0, 500000), v(k % 3 == 1, -0.25), v(k % 5 < 3, 45.5), v(k % 4 < 3, 60), v(k % 2 == 1, 0.9996), meridian, ellps)
    return X.table(spark, sf, "part").select("p_partkey", proj.alias("proj"))


@register("nodata_parse", """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN -9999e0 WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN 1000e0 WHEN 3 THEN NULL WHEN 4 THEN '-inf'::DOUBLE ELSE s_suppkey + 0.5e0 END AS nodata FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    text = F.when(k % 6 == 0, " -9999 ").when(k % 6 == 1, "INF").when(k % 6 == 2, "1E3").when(k % 6 == 3, "none").when(k % 6 == 4, "-inf").otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return X.table(spark, sf, "supplier").select("s_suppkey", M.nodata(text).alias("nodata"))


@register("band_names", """SELECT s_suppkey, array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN i = 0 AND s_suppkey % 2 = 0 THEN 'red ' || s_suppkey WHEN i = 2 THEN 'nir' ELSE 'band_0' || (i + 1) END), ';') AS names FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    xml = F.concat(F.lit("<GDALMetadata>"), F.when(k % 2 == 0, F.concat(F.lit('<Item name="DESCRIPTION" sample="0" role="description">red '), k.cast("string"), F.lit("</Item>"))).otherwise(""), F.lit('<Item name="SCALE" sample="1">2</Item><Item name="DESCRIPTION" sample="2" role="description">nir</Item></GDALMetadata>'))
    return X.table(spark, sf, "supplier").select("s_suppkey", F.array_join(M.band_names(xml, F.lit(4)), ";").alias("names"))


@register("dtype_size", """WITH t AS (SELECT p_partkey, 1 + p_partkey % 4 AS f, [1, 8, 16, 32, 64, 128][1 + p_partkey % 6] AS b FROM part),
u AS (SELECT *, CASE WHEN f = 1 AND b IN (1, 8) THEN 'Byte' WHEN f = 1 AND b < 128 THEN 'UInt' || b WHEN f = 2 AND b IN (8, 16, 32, 64) THEN 'Int' || b WHEN f = 3 AND b IN (32, 64) THEN 'Float' || b ELSE 'Float64' END AS dtype FROM t)
SELECT p_partkey, dtype, CASE WHEN dtype IN ('Byte', 'Int8') THEN 1 WHEN dtype IN ('UInt16', 'Int16') THEN 2 WHEN dtype IN ('UInt32', 'Int32', 'Float32') THEN 4 ELSE 8 END AS n_bytes FROM u""")
def _(spark, sf):
    k = F.col("p_partkey")
    name = M.dtype((k % 4 + 1).cast("int"), F.get(F.array(*map(F.lit, [1, 8, 16, 32, 64, 128])), (k % 6).cast("int")))
    return X.table(spark, sf, "part").select("p_partkey", name.alias("dtype"), M.sample_bytes(name).alias("n_bytes"))


@register("fill_cast", "SELECT event_id, CASE WHEN value IS NULL THEN 0 ELSE trunc(greatest(0e0, least(255e0, value * 8 - 20)))::SMALLINT END AS filled FROM events")
def _(spark, sf):
    return X.table(spark, sf, "events").select("event_id", F.coalesce(M.saturate(F.col("value") * 8 - 20, 0.0, 255.0, "smallint"), F.lit(0).cast("smallint")).alias("filled"))


# --- catalog ----------------------------------------------------------------------------------------------------------

SRC = """SELECT 's3://bucket/scene_' || s_suppkey || '.tif?v=1' AS src, s_suppkey::INT AS src_idx, 128 AS width, 128 AS height, (s_suppkey % 3 + 1)::INT AS n_bands, CASE WHEN s_suppkey % 2 = 0 THEN 'Int16' ELSE 'Float32' END AS dtype,
  CASE s_nationkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN -9999e0 END AS nodata, 'EPSG:32631' AS crs, 5e5 + 1280e0 * (s_suppkey % 10) AS gt0, 4002560e0 - 1280e0 * floor(s_suppkey / 10) AS gt3 FROM supplier"""


@register("catalog_flat", f"SELECT src, width, height, n_bands, dtype, nodata, crs, 10e0 AS res_x, 10e0 AS res_y, gt0 AS xmin, gt3 - 1280 AS ymin, gt0 + 1280 AS xmax, gt3 AS ymax, 3 AS n_levels, 32 AS tile_width, 32 AS tile_height FROM ({SRC})")
def _(spark, sf):
    return W.flat(X.sources(spark, sf))


@register("catalog_summary", f"""SELECT count(*) AS n_sources, 128 AS shared_width, 128 AS shared_height, CASE WHEN count(DISTINCT n_bands) = 1 THEN min(n_bands) END AS shared_n_bands, CASE WHEN count(DISTINCT dtype) = 1 THEN min(dtype) END AS shared_dtype,
  'EPSG:32631' AS shared_crs, count(DISTINCT nodata) AS n_nodata, min(gt0) AS xmin, min(gt3) - 1280 AS ymin, max(gt0) + 1280 AS xmax, max(gt3) AS ymax FROM ({SRC})""")
def _(spark, sf):
    return W.summary(X.sources(spark, sf))


@register("grid_signature", f"SELECT src_idx, printf('%.10f', gt0) || '|10.0000000000|0.0000000000|' || printf('%.10f', gt3) || '|0.0000000000|-10.0000000000|EPSG:32631|128,64,32|128,64,32' AS sig FROM ({SRC})")
def _(spark, sf):
    return X.sources(spark, sf).select("src_idx", M.grid_signature(F.col("gt"), F.col("crs"), F.col("levels")).alias("sig"))


# --- planning ---------------------------------------------------------------------------------------------------------

TE = (501000.0, 3992560.0, 509004.0, 4001004.0)


def plan_sql(te: tuple | None, level: str, margin: int, n_sel: str = "n_bands", copy: bool = False) -> str:
    """Windows of same-system sources, from the arithmetic alone."""
    x0, y0, x1, y1 = [f"{v!r}::DOUBLE" for v in te] if te else ("gt0", "(gt3 - 1280)", "(gt0 + 1280)", "gt3")
    return f"""WITH s AS ({SRC}), l AS (SELECT *, ({level})::INT AS level FROM s), f AS (SELECT *, 2 ** (level - 1) AS f, (128 // (2 ** (level - 1)))::BIGINT AS n FROM l),
o AS (SELECT *, greatest(0, floor(({x0} - gt0) / 10 / f) - {margin})::BIGINT AS xoff, greatest(0, floor((gt3 - {y1}) / 10 / f) - {margin})::BIGINT AS yoff,
  least(n, ceil(({x1} - gt0) / 10 / f) + {margin})::BIGINT AS xend, least(n, ceil((gt3 - {y0}) / 10 / f) + {margin})::BIGINT AS yend FROM f),
p AS (SELECT *, xend - xoff AS xsize, yend - yoff AS ysize, ((xend - xoff) * (yend - yoff) * {n_sel} * CASE dtype WHEN 'Int16' THEN 2 ELSE 4 END)::BIGINT AS n_bytes,
  gt0 + xoff * f * 10 AS win_x, 10e0 * f AS win_px, gt3 - yoff * f * 10 AS win_y, {str(copy).lower()} AS is_copy FROM o WHERE xend > xoff AND yend > yoff)"""


def _plan_rows(df: DataFrame) -> DataFrame:
    return df.select("src_idx", "level", "xoff", "yoff", "xsize", "ysize", F.col("win_gt.gt0").alias("win_x"), F.col("win_gt.gt1").alias("win_px"), F.col("win_gt.gt3").alias("win_y"), "is_copy", "n_bytes")


PLAN_COLS = " SELECT src_idx, level, xoff, yoff, xsize, ysize, win_x, win_px, win_y, is_copy, n_bytes FROM p"


@register("plan_window", plan_sql(TE, "1", 8) + PLAN_COLS)
def _(spark, sf):
    return _plan_rows(W.plan(X.sources(spark, sf), WarpSpec(te=TE, tr=(15, 15))))


@register("plan_overview", plan_sql(TE, "3", 8) + PLAN_COLS)
def _(spark, sf):
    return _plan_rows(W.plan(X.sources(spark, sf), WarpSpec(te=TE, tr=(45, 45))))


@register("plan_ts_level", plan_sql(TE, "2", 8) + PLAN_COLS)
def _(spark, sf):
    return _plan_rows(W.plan(X.sources(spark, sf), WarpSpec(te=TE, ts=(320, 320))))


@register("plan_forced_level", plan_sql(TE, "least(3, 9)", 2) + PLAN_COLS)
def _(spark, sf):
    return _plan_rows(W.plan(X.sources(spark, sf), WarpSpec(te=TE, tr=(15, 15), overview=9, margin=2)))


@register("plan_copy", plan_sql(TE, "1", 0, copy=True) + PLAN_COLS)
def _(spark, sf):
    return _plan_rows(W.plan(X.sources(spark, sf), WarpSpec(te=TE, t_srs="EPSG:32631")))


@register("plan_skip", plan_sql(TE, "1", 8) + " SELECT s.src_idx, p.src_idx IS NULL AS skipped FROM s LEFT JOIN p USING (src_idx)")
def _(spark, sf):
    src = X.sources(spark, sf)
    planned = W.plan(src, WarpSpec(te=TE, tr=(15, 15))).select("src_idx", F.lit(1).alias("hit"))
    return src.select("src_idx").join(planned, "src_idx", "left").select("src_idx", F.col("hit").isNull().alias("skipped"))


@register("plan_guard", plan_sql(None, "1", 8, "2") + " SELECT src_idx, n_bytes, n_bytes > 100000 AS over_limit FROM p")
def _(spark, sf):
    return W.plan(X.sources(spark, sf), WarpSpec(ts=(64, 64), bands=(1, 1), overview=1, max_bytes=1e5)).select("src_idx", "n_bytes", "over_limit")


# Sources of two systems: those of odd numbers in degrees, the others in metres of Web Mercator.
@register("plan_mixed_systems", """WITH k AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 1 THEN 0.001e0 ELSE 50e0 END AS px, CASE WHEN s_suppkey % 2 = 1 THEN radians(0.128e0) * 6378137e0 ELSE 6400e0 END AS span FROM supplier),
l AS (SELECT k, [x[2] FOR x IN [[1, 1], [2, 2], [4, 3]] IF x[1] <= round(150e0 * (128 * px / span) / px, 9)] AS fits FROM k)
SELECT k::INTEGER AS src_idx, coalesce(list_max(fits), 1)::INTEGER AS level, (128 >> (coalesce(list_max(fits), 1) - 1))::BIGINT AS xsize FROM l""")
def _(spark, sf):
    k, degrees = F.col("src_idx"), F.col("src_idx") % 2 == 1
    at = [F.when(degrees, 10.0 + k % 10 * 0.128).otherwise(1.2e6 + k % 10 * 6400.0), F.when(degrees, 0.001).otherwise(50.0), F.lit(0.0), F.when(degrees, 40.0 + F.floor(k / 10) * 0.001).otherwise(5e6), F.lit(0.0), F.when(degrees, -0.001).otherwise(-50.0)]
    src = X.sources(spark, sf).withColumns({"gt": F.struct(*[c.cast("double").alias(f"gt{i}") for i, c in enumerate(at)]), "crs": F.when(degrees, "EPSG:4326").otherwise("+proj=merc +a=6378137 +b=6378137 +no_defs")})
    return W.plan_on_grid(src.withColumn("src_idx", k), WarpSpec(tr=(150, 150), t_srs="EPSG:3857"))[0].select("src_idx", "level", "xsize")


# Sources around the antimeridian, 25.6 minutes wide, under an extent in metres that goes on beyond 180 degrees.
@register("plan_antimeridian", """WITH s AS (SELECT s_suppkey AS k, (s_suppkey * 7 % 360 - 180)::DOUBLE AS x0 FROM supplier), w AS (SELECT degrees(195e5 / 6378137e0) AS a, degrees(206e5 / 6378137e0) AS b),
t AS (SELECT k, x0, unnest(range(-1, 2)) AS turn FROM s), c AS (SELECT k, x0, turn, (a + turn * 360 - x0) / 0.02e0 AS c0, (b + turn * 360 - x0) / 0.02e0 AS c1 FROM t, w),
o AS (SELECT *, greatest(0, floor(round(c0, 9)) - 8) AS o0, least(128, ceil(round(c1, 9)) + 8) AS o1 FROM c WHERE turn = 0 OR (c0 < 128 - 1e-9 AND c1 > 1e-9))
SELECT k::INTEGER AS src_idx, turn::INTEGER AS turn, o0::BIGINT AS xoff, (o1 - o0)::BIGINT AS xsize, round(x0 + o0 * 0.02e0 - 360 * turn, 6) AS win_x FROM o WHERE o1 > o0""")
def _(spark, sf):
    at = [(F.col("src_idx") * 7 % 360 - 180).cast("double"), F.lit(0.02), F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(-0.02)]
    src = X.sources(spark, sf).withColumns({"gt": F.struct(*[c.alias(f"gt{i}") for i, c in enumerate(at)]), "crs": F.lit("+proj=longlat +datum=WGS84")})
    planned = W.plan(src, WarpSpec(te=(195e5, 9e5, 206e5, 11e5), t_srs="EPSG:3857", tr=(2000, 2000)))
    return planned.select("src_idx", "turn", "xoff", "xsize", F.round("win_gt.gt0", 6).alias("win_x"))


# Areas of interest of all customers, some larger than the sources, against the sources of all suppliers.
AREAS = "SELECT c_custkey AS req_idx, 5e5 + c_custkey % 97 * 131 AS xmin, 4002000e0 - c_custkey % 211 * 597 AS ymin, 5e5 + c_custkey % 97 * 131 + 40 + c_custkey % 13 * 90 AS xmax, 4002000e0 - c_custkey % 211 * 597 + 40 + c_custkey % 7 * 50 AS ymax FROM customer"


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = k % 97 * 131 + 5e5, F.lit(4002000.0) - k % 211 * 597
    return X.table(spark, sf, "customer").select(k.alias("req_idx"), x.alias("xmin"), y.alias("ymin"), (x + 40 + k % 13 * 90).alias("xmax"), (y + 40 + k % 7 * 50).alias("ymax"))


@register("overlap_pairs", f"SELECT req_idx, src_idx FROM ({AREAS}) a JOIN ({SRC}) s ON a.xmin < s.gt0 + 1280 AND a.xmax > s.gt0 AND a.ymin < s.gt3 AND a.ymax > s.gt3 - 1280")
def _(spark, sf):
    e = M.extent(F.col("gt"), F.col("width"), F.col("height"))
    boxes = X.sources(spark, sf).select("src_idx", *[e[n].alias(n) for n in ("xmin", "ymin", "xmax", "ymax")])
    return overlap_pairs(_areas(spark, sf), boxes, "req_idx", "src_idx")


@register("plan_requests", f"""WITH p AS (SELECT req_idx, src_idx, (xmin - gt0) / 20 AS c0, (xmax - gt0) / 20 AS c1, (gt3 - ymax) / 20 AS r0, (gt3 - ymin) / 20 AS r1 FROM ({AREAS}) a JOIN ({SRC}) s ON a.xmin < s.gt0 + 1280 AND a.xmax > s.gt0 AND a.ymin < s.gt3 AND a.ymax > s.gt3 - 1280),
q AS (SELECT *, greatest(0, floor(round(c0, 9)) - 2) AS x0, least(64, ceil(round(c1, 9)) + 2) AS x1, greatest(0, floor(round(r0, 9)) - 2) AS y0, least(64, ceil(round(r1, 9)) + 2) AS y1 FROM p)
SELECT req_idx, src_idx, 2 AS level, x0::BIGINT AS xoff, y0::BIGINT AS yoff, (x1 - x0)::BIGINT AS xsize, (y1 - y0)::BIGINT AS ysize FROM q""")
def _(spark, sf):
    return W.plan_requests(X.sources(spark, sf), _areas(spark, sf), WarpSpec(tr=(25, 25), margin=2)).select("req_idx", "src_idx", "level", "xoff", "yoff", "xsize", "ysize")


SHARED = "CASE WHEN src_idx % 3 = 0 THEN 64 ELSE 32 END"


@register("plan_shared_grid", plan_sql(TE, "1", 8) + f" SELECT src_idx, nodata, level, xoff, yoff, xsize, ysize, win_x, win_y, is_copy, n_bytes, n_bytes > 100000 AS over_limit, {SHARED} AS tile_width, {SHARED} AS tile_height FROM p")
def _(spark, sf):
    """Sources of one grid that differ in bands, sample type and tiles."""
    tile = F.when(F.col("src_idx") % 3 == 0, 64).otherwise(32)
    levels = F.transform("levels", lambda v: F.struct(v["level"], v["width"], v["height"], tile.alias("tile_width"), tile.alias("tile_height")))
    planned = W.plan_by_grid(X.sources(spark, sf).withColumn("levels", levels), WarpSpec(te=TE, tr=(15, 15), max_bytes=1e5))
    return planned.select("src_idx", "nodata", "level", "xoff", "yoff", "xsize", "ysize", F.col("win_gt.gt0").alias("win_x"), F.col("win_gt.gt3").alias("win_y"), "is_copy", "n_bytes", "over_limit", "tile_width", "tile_height")


COVER = ", c AS (SELECT src_idx, level, unnest(range(yoff // 32, (yoff + ysize - 1) // 32 + 1)) AS ty, xoff, xsize FROM p), t AS (SELECT src_idx, level, ty, unnest(range(xoff // 32, (xoff + xsize - 1) // 32 + 1)) AS tx FROM c)"


@register("tile_cover", plan_sql(TE, "1", 8) + COVER + " SELECT src_idx, level, ty, tx FROM t")
def _(spark, sf):
    return W.tile_cover(W.plan(X.sources(spark, sf), WarpSpec(te=TE, tr=(15, 15))))


def emb_sql(bands: tuple) -> str:
    return f"SELECT 0 AS src_idx, b.b AS band, vec_id // 25 AS row, vec_id % 25 AS col, embedding[b.b]::DOUBLE AS value FROM embeddings, (VALUES {', '.join(f'({b})' for b in bands)}) b(b)"


@register("band_select", f"SELECT src_idx, b.i AS band, row, col, value FROM ({emb_sql((11, 9))}) e JOIN (VALUES (1, 9), (2, 11), (3, 9)) b(i, b) ON e.band = b.b")
def _(spark, sf):
    return raster.select_bands(X.emb64(spark, sf, tuple(range(1, 65))), [9, 11, 9])


# --- windows ----------------------------------------------------------------------------------------------------------

WIN = (500030.0, 4002410.0, 500180.0, 4002530.0)


@register("window_blit", f"SELECT src_idx, band, row - 3 AS row, col - 3 AS col, value FROM ({emb_sql((11, 10, 9))}) WHERE row BETWEEN 3 AND 14 AND col BETWEEN 3 AND 17")
def _(spark, sf):
    return raster.cut_window(X.emb64(spark, sf), W.plan(X.emb_catalog(spark, sf), WarpSpec(te=WIN)))


@register("window_tiles", f"SELECT src_idx, b.i AS band, row - 3 AS row, col - 3 AS col, value FROM ({emb_sql((11, 10))}) e JOIN (VALUES (1, 10), (2, 11)) b(i, b) ON e.band = b.b WHERE row BETWEEN 3 AND 14 AND col BETWEEN 3 AND 17")
def _(spark, sf):
    tiles = raster.to_tiles(X.emb64(spark, sf), 8)
    return raster.read_window(tiles, W.plan(X.emb_catalog(spark, sf), WarpSpec(te=WIN)), 8, [10, 11])


@register("window_fill", f"SELECT 0 AS src_idx, b AS band, r AS row, c AS col, coalesce(value, -1e0) AS value FROM range(0, 12) x(r), range(0, 15) y(c), (VALUES (11), (10)) z(b) LEFT JOIN ({emb_sql((11, 10))}) e ON e.row = r + 3 AND e.col = c + 3 AND e.band = b AND value > 0")
def _(spark, sf):
    planned = W.plan(X.emb_catalog(spark, sf).withColumn("nodata", F.lit(-1.0)), WarpSpec(te=WIN))
    return raster.fill_window(raster.cut_window(X.emb64(spark, sf).where("value > 0"), planned), planned, [11, 10])


# --- warping ----------------------------------------------------------------------------------------------------------


def kernel_sql(method: str, d: str) -> str:
    inner = {
        "bilinear": f"1 - {d}",
        "cubic": f"CASE WHEN {d} <= 1 THEN 1.5e0 * {d} * {d} * {d} - 2.5e0 * {d} * {d} + 1 ELSE -0.5e0 * {d} * {d} * {d} + 2.5e0 * {d} * {d} - 4 * {d} + 2 END",
        "cubicspline": f"CASE WHEN {d} < 1 THEN 2e0 / 3 - {d} * {d} + {d} * {d} * {d} / 2 ELSE (2 - {d}) ** 3 / 6 END",
        "lanczos": f"CASE WHEN {d} = 0 THEN 1e0 ELSE sin(pi() * {d}) / (pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d} / 3) END",
    }[method]
    return f"CASE WHEN {d} < {REACH[method]} THEN {inner} ELSE 0e0 END"


def rows_sql(name: str, key: str, width: int) -> str:
    """How many rows of pixels a table makes, as X.rows_of()."""
    return f"(SELECT max({key}) // {width} + 1 FROM {name})"


def axis_sql(method: str, off: float, ratio: float, n: int | str, most: int | str) -> str:
    """(o, c, w): output index, pixel index, weight. Counts are numbers or subqueries."""
    off_s, ratio_s, s = f"{off!r}::DOUBLE", f"{ratio!r}::DOUBLE", max(1.0, abs(ratio))
    base = f"SELECT o, c, round({off_s} + (o + 0.5e0) * {ratio_s}, 9) AS u, round({off_s} + o * {ratio_s}, 9) AS a, round({off_s} + (o + 1) * {ratio_s}, 9) AS b FROM range({n}) x(o), range({most}) y(c)"
    if method == "near":
        return f"SELECT o, c, 1e0 AS w FROM ({base}) WHERE floor(u) = c"
    if method in FOOTPRINT:
        return f"SELECT * FROM (SELECT o, c, least(c + 1, greatest(a, b)) - greatest(c, least(a, b)) AS w FROM ({base})) WHERE w > 1e-9"
    return f"SELECT * FROM (SELECT o, c, {kernel_sql(method, 'd')} AS w FROM (SELECT o, c, abs(c + 0.5e0 - u) / {s!r}::DOUBLE AS d FROM ({base}))) WHERE w <> 0"


def value_sql(method: str) -> str:
    quantile = lambda p: f"list_sort(list(value))[ceil({p} * count(*))::INT]"
    return {"rms": "sqrt(sum(w * value * value) / sum(w))", "sum": "sum(w * value)", "min": "min(value)", "max": "max(value)", "q1": quantile("0.25e0"), "med": quantile("0.5e0"), "q3": quantile("0.75e0"), "near": "any_value(value)"}.get(method, "sum(w * value) / sum(w)")


def warp_sql(method: str, pixels: str, gt: tuple, g: OutGrid, most: tuple, height: str | None = None) -> str:
    """The grid's own height, or one that comes from a table."""
    x, y = axis_sql(method, (g.xmin - gt[0]) / gt[1], g.xres / gt[1], g.width, most[0]), axis_sql(method, (g.ymax - gt[3]) / gt[5], -g.yres / gt[5], height or g.height, most[1])
    head = f"WITH wx AS ({x}), wy AS ({y}), px AS ({pixels}), j AS (SELECT band, wy.o AS orow, wx.o AS ocol, row, col, value, wx.w * wy.w AS w FROM px JOIN wx ON wx.c = px.col JOIN wy ON wy.c = px.row)"
    if method == "mode":
        return head + ", n AS (SELECT band, orow, ocol, value, count(*) AS n, min(row * 100000 + col) AS pos FROM j GROUP BY ALL) SELECT band, orow, ocol, round(value, 6) AS value FROM n QUALIFY row_number() OVER (PARTITION BY band, orow, ocol ORDER BY n DESC, pos) = 1"
    return head + f" SELECT band, orow, ocol, round({value_sql(method)}, 6) AS value FROM j GROUP BY band, orow, ocol"


# Grids reach over the whole of their rasters, whatever the size of the tables. A table's rows of pixels give the height.
FINE, COARSE = X.tall(499997.0, 4002563.0, 5.95, 6.0, 44), X.tall(499990.0, 4002570.0, 32.5, 33.0, 9)
PARTS, ORDERS = X.tall(-0.4, 0.3, 5.6, 5.64, 10), X.tall(-1.0, 1.0, 5.1, 4.85, 60)
EMB_ROWS, PART_ROWS, ORD_ROWS = rows_sql("embeddings", "vec_id", 25), rows_sql("part", "p_partkey", 50), rows_sql("orders", "o_orderkey", 150)
FINE_ROWS, COARSE_ROWS = f"({EMB_ROWS} * 2)", f"({EMB_ROWS} // 3 + 2)"
PART_CELLS, ORD_CELLS = f"({PART_ROWS} // 5 + 2)", f"({ORD_ROWS} // 2 + 2)"
PART_GT = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)


def _emb_rows(spark: SparkSession, sf: str) -> int:
    return X.rows_of(spark, sf, "embeddings", "vec_id", 25)


def _register_warp(method: str) -> None:
    # Area averages run over the embeddings, order statistics over the parts, whose values repeat.
    if method in ("mode", "med", "q1", "q3", "min", "max"):

        def run(spark, sf):
            n = X.rows_of(spark, sf, "part", "p_partkey", 50)
            src = X.one_source(spark, 1, PART_GT, 50, n, 2, nodata=50.0)
            return rounded(scatter(X.part2(spark, sf), src, PARTS(n // 5 + 2), method)).drop("src_idx")

        pixels = "SELECT b.b AS band, p_partkey // 50 AS row, p_partkey % 50 AS col, CASE b.b WHEN 1 THEN p_size::DOUBLE ELSE p_retailprice END AS value FROM part, (VALUES (1), (2)) b(b) WHERE NOT (b.b = 1 AND p_size = 50) AND NOT (b.b = 2 AND p_retailprice = 50)"
        sql = warp_sql(method, pixels, PART_GT, PARTS(1), (50, PART_ROWS), PART_CELLS)
    else:
        coarse = method in FOOTPRINT

        def run(spark, sf):
            n = _emb_rows(spark, sf)
            return rounded(scatter(X.emb64(spark, sf), X.emb_catalog(spark, sf), COARSE(n // 3 + 2) if coarse else FINE(n * 2), method)).drop("src_idx")

        sql = warp_sql(method, emb_sql((11, 10, 9)), X.EMB_GT, (COARSE if coarse else FINE)(1), (25, EMB_ROWS), COARSE_ROWS if coarse else FINE_ROWS)
    register(f"warp_{method}", sql)(run)


for _method in METHODS:
    _register_warp(_method)


@register("warp_cubic_coarse", warp_sql("cubic", emb_sql((11, 10, 9)), X.EMB_GT, COARSE(1), (25, EMB_ROWS), COARSE_ROWS))
def _(spark, sf):
    return rounded(scatter(X.emb64(spark, sf), X.emb_catalog(spark, sf), COARSE(_emb_rows(spark, sf) // 3 + 2), "cubic")).drop("src_idx")


ORD_GT = (0.0, 2.0, 0.0, 0.0, 0.0, -2.0)
ORD_PX = "SELECT 1 AS band, o_orderkey // 150 AS row, o_orderkey % 150 AS col, o_totalprice AS value FROM orders"


def _ord_rows(spark: SparkSession, sf: str) -> int:
    return X.rows_of(spark, sf, "orders", "o_orderkey", 150)


@register("warp_orders_average", warp_sql("average", ORD_PX, ORD_GT, ORDERS(1), (150, ORD_ROWS), ORD_CELLS))
def _(spark, sf):
    n = _ord_rows(spark, sf)
    return rounded(scatter(X.ord1(spark, sf), X.one_source(spark, 2, ORD_GT, 150, n), ORDERS(n // 2 + 2), "average")).drop("src_idx")


@register("gather_bilinear", warp_sql("bilinear", emb_sql((11, 10, 9)), X.EMB_GT, FINE(1), (25, EMB_ROWS), FINE_ROWS))
def _(spark, sf):
    return rounded(gather(X.emb64(spark, sf), X.emb_catalog(spark, sf), FINE(_emb_rows(spark, sf) * 2), "bilinear")).drop("src_idx")


# A source whose second level are the embeddings, 10 m a pixel; its first level, of 5 m, is never read.
OVER = OutGrid(500000.0, 4002560.0, 20.0, 20.0, 13, 1)


@register("warp_overview", warp_sql("average", emb_sql((11, 10)), X.EMB_GT, OVER, (25, EMB_ROWS), f"(({EMB_ROWS} + 1) // 2)"))
def _(spark, sf):
    n = _emb_rows(spark, sf)
    src = X.one_source(spark, 0, (500000.0, 5.0, 0.0, 4002560.0, 0.0, -5.0), 50, n * 2, 64)
    spec = WarpSpec(te=(500000.0, 4002560.0 - 10 * n, 500250.0, 4002560.0), tr=(20, 20), overview=2, method="average")
    planned = W.plan(src, spec)
    pixels = raster.read_window(raster.to_tiles(X.emb64(spark, sf, (11, 10)), 8), planned, 8, [11, 10])
    named = pixels.withColumn("band", F.get(F.array(F.lit(11), F.lit(10)), F.col("band") - 1))
    return rounded(mosaic(scatter(named, W.as_catalog(planned), W.output_grid(src, spec), "average")))


# Degrees to Web Mercator: the parts as a raster 50 cells of 0.02 degrees wide, from 5 E, 50 N.
DEG_GT = (5.0, 0.02, 0.0, 50.0, 0.0, -0.02)
MERC = X.tall(556013.0, 6447017.0, 2200.0, 2200.0, 60, "EPSG:3857")
PART_NEAR = "SELECT b.b AS band, orow, ocol, round(CASE b.b WHEN 1 THEN p_size::DOUBLE ELSE p_retailprice END, 6) AS value FROM i, (VALUES (1), (2)) b(b), part WHERE p_partkey // 50 = row AND p_partkey % 50 = col AND NOT (b.b = 1 AND p_size = 50) AND NOT (b.b = 2 AND p_retailprice = 50)"
FROM_MERC = "i AS (SELECT orow, ocol, floor(round((x / 6378137e0 * 180 / pi() - 5e0) / 0.02e0, 9))::BIGINT AS col, floor(round((atan(sinh(y / 6378137e0)) * 180 / pi() - 50e0) / -0.02e0, 9))::BIGINT AS row FROM g)"


def _degrees(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    n = X.rows_of(spark, sf, "part", "p_partkey", 50)
    return X.one_source(spark, 1, DEG_GT, 50, n, 2, nodata=50.0, crs="EPSG:4326"), n


@register("reproject_3857_near", f"""WITH g AS (SELECT r AS orow, c AS ocol, 556013e0 + (c + 0.5e0) * 2200 AS x, 6447017e0 - (r + 0.5e0) * 2200 AS y FROM range({PART_ROWS} * 2 + 4) a(r), range(60) b(c)), {FROM_MERC} {PART_NEAR}""")
def _(spark, sf):
    src, n = _degrees(spark, sf)
    return rounded(gather(X.part2(spark, sf), src, MERC(n * 2 + 4), "near")).drop("src_idx")


# The same rasters by requests: an extent in degrees that goes to metres, and none at all, which is the whole extent's.
METRES = "radians({0}) * 6378137e0"
NORTHING = "asinh(tan(radians({0}))) * 6378137e0"
SNAPPED = f"""WITH n AS (SELECT {PART_ROWS} AS n), q AS (SELECT floor({METRES.format("5.1e0")} / 2200) AS x0, ceil({METRES.format("5.9e0")} / 2200) AS x1, floor({NORTHING.format("(50e0 - 0.02e0 * n)")} / 2200) AS y0, ceil({NORTHING.format("50e0")} / 2200) AS y1 FROM n),
r AS (SELECT *, unnest(range(0, (y1 - y0)::BIGINT)) AS orow FROM q), g AS (SELECT orow, ocol, (x0 + ocol + 0.5e0) * 2200 AS x, (y1 - orow - 0.5e0) * 2200 AS y FROM (SELECT *, unnest(range(0, (x1 - x0)::BIGINT)) AS ocol FROM r))"""


def _requested(spark: SparkSession, sf: str, spec: WarpSpec) -> DataFrame:
    src, _ = _degrees(spark, sf)
    planned = W.plan(src, spec)
    return rounded(mosaic(warp_windows(raster.cut_window(X.part2(spark, sf), planned), W.as_catalog(planned), W.output_grid(src, spec))))


@register("warp_te_srs", f"{SNAPPED}, {FROM_MERC} {PART_NEAR}")
def _(spark, sf):
    n = X.rows_of(spark, sf, "part", "p_partkey", 50)
    return _requested(spark, sf, WarpSpec(te=(5.1, 50 - 0.02 * n, 5.9, 50.0), te_srs="EPSG:4326", t_srs="EPSG:3857", tr=(2200, 2200)))


WHOLE = f"""WITH n AS (SELECT {PART_ROWS} AS n), q AS (SELECT {METRES.format("5e0")} AS x0, {METRES.format("6e0")} AS x1, {NORTHING.format("(50e0 - 0.02e0 * n)")} AS y0, {NORTHING.format("50e0")} AS y1 FROM n),
g AS (SELECT r AS orow, c AS ocol, x0 + (c + 0.5e0) * (x1 - x0) / 37 AS x, y1 - (r + 0.5e0) * (y1 - y0) / 61 AS y FROM q, range(61) a(r), range(37) b(c))"""


@register("warp_whole_extent", f"{WHOLE}, {FROM_MERC} {PART_NEAR}")
def _(spark, sf):
    return _requested(spark, sf, WarpSpec(t_srs="EPSG:3857", ts=(37, 61), overview=1))


# GRS80, and Snyder's formulas in their printed form.
GRS80 = "e2 AS (SELECT f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e FROM (SELECT 1e0 / 298.257222101e0 AS f))"


def _q_sql(sine: str) -> str:
    return f"((1 - e2) * ({sine} / (1 - e2 * {sine} * {sine}) - ln((1 - e * {sine}) / (1 + e * {sine})) / (2 * e)))"


EUROPE = X.tall(3800013.0, 3010017.0, 1700.0, 1700.0, 150, "EPSG:3035")


@register("reproject_3035_near", f"""WITH {GRS80}, k0 AS (SELECT *, {_q_sql("1e0")} AS qp, {_q_sql("sin(radians(52e0))")} AS q1 FROM e2),
k AS (SELECT *, asin(q1 / qp) AS b1, 6378137e0 * sqrt(qp / 2) AS rq, 6378137e0 * cos(radians(52e0)) / sqrt(1 - e2 * sin(radians(52e0)) ** 2) / (6378137e0 * sqrt(qp / 2) * cos(asin(q1 / qp))) AS d FROM k0),
g AS (SELECT r AS orow, c AS ocol, 3800013e0 + (c + 0.5e0) * 1700 - 4321000 AS u, 3010017e0 - (r + 0.5e0) * 1700 - 3210000 AS v FROM range({PART_ROWS} * 2 + 20) a(r), range(150) b(c)),
h AS (SELECT *, 2 * asin(rho / (2 * rq)) AS ce FROM (SELECT *, sqrt((u / d) ** 2 + (d * v) ** 2) AS rho FROM g, k)),
b AS (SELECT orow, ocol, e2, asin(cos(ce) * sin(b1) + d * v * sin(ce) * cos(b1) / rho) AS beta, 10 + degrees(atan2(u * sin(ce), d * rho * cos(b1) * cos(ce) - d * d * v * sin(b1) * sin(ce))) AS lon FROM h),
l AS (SELECT orow, ocol, lon, degrees(beta + (e2 / 3 + 31 * e2 ** 2 / 180 + 517 * e2 ** 3 / 5040) * sin(2 * beta) + (23 * e2 ** 2 / 360 + 251 * e2 ** 3 / 3780) * sin(4 * beta) + 761 * e2 ** 3 / 45360 * sin(6 * beta)) AS lat FROM b),
i AS (SELECT orow, ocol, floor(round((lon - 5e0) / 0.02e0, 9))::BIGINT AS col, floor(round((lat - 50e0) / -0.02e0, 9))::BIGINT AS row FROM l)
{PART_NEAR}""")
def _(spark, sf):
    src, n = _degrees(spark, sf)
    return rounded(gather(X.part2(spark, sf), src, EUROPE(n * 2 + 20), "near")).drop("src_idx")


def _m_sql(lat: str) -> str:
    return f"(cos(radians({lat})) / sqrt(1 - e2 * sin(radians({lat})) ** 2))"


def _t_sql(lat: str) -> str:
    return f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - e * sin(radians({lat}))) / (1 + e * sin(radians({lat}))), e / 2))"


@register("project_conics", f"""WITH {GRS80}, p AS (SELECT c_custkey, -125e0 + c_custkey % 590 * 0.1e0 AS lon, 25e0 + c_custkey % 240 * 0.1e0 AS lat FROM customer),
a AS (SELECT *, ({_m_sql("29.5e0")} ** 2 - {_m_sql("45.5e0")} ** 2) / ({_q_sql("sin(radians(45.5e0))")} - {_q_sql("sin(radians(29.5e0))")}) AS n, ln({_m_sql("49e0")} / {_m_sql("77e0")}) / ln({_t_sql("49e0")} / {_t_sql("77e0")}) AS nl FROM e2),
c AS (SELECT *, {_m_sql("29.5e0")} ** 2 + n * {_q_sql("sin(radians(29.5e0))")} AS c, {_m_sql("49e0")} / (nl * pow({_t_sql("49e0")}, nl)) AS fl FROM a),
r AS (SELECT *, 6378137e0 * sqrt(c - n * {_q_sql("sin(radians(lat))")}) / n AS ra, 6378137e0 * sqrt(c - n * {_q_sql("sin(radians(23e0))")}) / n AS ra0, 6378137e0 * fl * pow({_t_sql("lat")}, nl) AS rl, 6378137e0 * fl * pow({_t_sql("63.390675e0")}, nl) AS rl0 FROM p, c)
SELECT c_custkey, round(ra * sin(n * radians(lon + 96)), 3) AS albers_x, round(ra0 - ra * cos(n * radians(lon + 96)), 3) AS albers_y, round(6200000 + rl * sin(nl * radians(lon + 91.86666666666666e0)), 3) AS lambert_x, round(3000000 + rl0 - rl * cos(nl * radians(lon + 91.86666666666666e0)), 3) AS lambert_y FROM r""")
def _(spark, sf):
    k = F.col("c_custkey")
    at = X.table(spark, sf, "customer").select("c_custkey", (k % 590 * 0.1 - 125.0).alias("lon"), (k % 240 * 0.1 + 25.0).alias("lat"))
    images = [c for code in ("EPSG:5070", "EPSG:3347") for c in projections.transform("EPSG:4326", code, F.col("lon"), F.col("lat"))]
    return at.select("c_custkey", *[F.round(c, 3).alias(n) for c, n in zip(images, ("albers_x", "albers_y", "lambert_x", "lambert_y"), strict=True)])


# Each customer by a projection of its own: a transverse Mercator of its nation's meridian, and a cylindrical equal-area and a
# Mercator of its nation's parallel of true scale; on the ellipsoid Bessel 1841.
@register("project_by_row", """WITH e AS (SELECT 6377397.155e0 AS a, 1 / 299.1528128e0 AS f), m AS (SELECT a, f, f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e, f / (2 - f) AS n FROM e),
p AS (SELECT c_custkey, c_nationkey * 6 - 70 + c_custkey % 50 * 0.1e0 - 2.5e0 AS lon, c_custkey % 140 - 70e0 + 0.25e0 AS lat, c_nationkey * 6 - 70e0 AS lon0, 0.9e0 + c_nationkey * 0.004e0 AS k, c_nationkey * 2e0 AS ts FROM customer),
q AS (SELECT *, radians(lat) AS phi, radians(lon - lon0) AS lam, cos(radians(ts)) / sqrt(1 - e2 * sin(radians(ts)) ** 2) AS scale, a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS big FROM p, m),
t AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t, (1 - e2) * (sin(phi) / (1 - e2 * sin(phi) ** 2) + atanh(e * sin(phi)) / e) AS qq, asinh(tan(phi)) - e * atanh(e * sin(phi)) AS up FROM q),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(t * t + 1)) AS eta, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 AS a2, 61 * n ** 3 / 240 - 103 * n ** 4 / 140 AS a3, 49561 * n ** 4 / 161280 AS a4 FROM t)
SELECT c_custkey, round(k * big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 3) AS tmerc_x,
  round(k * big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 3) AS tmerc_y,
  round(lam * scale * a, 3) AS cea_x, round(a * qq / (2 * scale), 3) AS cea_y, round(a * scale * up, 3) AS merc_y FROM x""")
def _(spark, sf):
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    at = X.table(spark, sf, "customer").select("c_custkey", (nation * 6 - 70 + k % 50 * 0.1 - 2.5).alias("lon"), (k % 140 - 70.0 + 0.25).alias("lat"), (nation * 6 - 70.0).alias("lon0"), (nation * 0.004 + 0.9).alias("k"), (nation * 2.0).alias("ts"))
    own = {"lon0": F.col("lon0"), "a": 6377397.155, "rf": 299.1528128}
    found = [projected(Projection(kind, **own, **more), F.col("lon"), F.col("lat")) for kind, more in (("tmerc", {"k": F.col("k")}), ("cea", {"ts": F.col("ts")}), ("merc", {"ts": F.col("ts")}))]
    return at.select("c_custkey", *[F.round(c, 3).alias(n) for n, c in (("tmerc_x", found[0][0]), ("tmerc_y", found[0][1]), ("cea_x", found[1][0]), ("cea_y", found[1][1]), ("merc_y", found[2][1]))])


@register("bounds_densified", """WITH e AS (SELECT s_suppkey AS id, (s_suppkey % 10)::DOUBLE AS x0, 40e0 + s_suppkey // 10 * 0.1e0 AS y0 FROM supplier), s AS (SELECT id, x0, y0, k / 20e0 AS s FROM e, range(21) t(k)),
p AS (SELECT id, x0 + s AS x, y0 + d AS y FROM s, (VALUES (0e0), (0.5e0)) v(d) UNION ALL SELECT id, x0 + d AS x, y0 + s * 0.5e0 AS y FROM s, (VALUES (0e0), (1e0)) v(d))
SELECT id, round(min(x * 6378137e0 * pi() / 180), 3) AS xmin, round(min(asinh(tan(y * pi() / 180)) * 6378137e0), 3) AS ymin, round(max(x * 6378137e0 * pi() / 180), 3) AS xmax, round(max(asinh(tan(y * pi() / 180)) * 6378137e0), 3) AS ymax FROM p GROUP BY id""")
def _(spark, sf):
    k = F.col("s_suppkey")
    x, y = (k % 10).cast("double"), F.floor(k / 10) * 0.1 + 40.0
    e = W.densified(X.table(spark, sf, "supplier").select(k.alias("id"), x.alias("xmin"), y.alias("ymin"), (x + 1).alias("xmax"), (y + 0.5).alias("ymax")), "EPSG:4326", "EPSG:3857")
    return e.select("id", *[F.round(c, 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


MOSAIC = X.tall(-1.0, 0.0, 4.0, 4.0, 96)


def _two_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, OutGrid]:
    """The orders twice, the second shifted by 40 cells and missing where the price is odd; and a grid over both."""
    n = _ord_rows(spark, sf)
    first = X.ord1(spark, sf)
    second = first.where("cast(value as long) % 2 = 0").withColumn("src_idx", F.lit(3)).withColumn("value", F.col("value") * 2)
    src = X.one_source(spark, 2, ORD_GT, 150, n).unionAll(X.one_source(spark, 3, (80.0, 2.0, 0.0, 0.0, 0.0, -2.0), 150, n))
    return first.unionByName(second), src, MOSAIC(n // 2 + 1)


MOSAIC_CELLS = f"({ORD_ROWS} // 2 + 1)"
MOSAIC_PX = f"""WITH a AS (SELECT o_orderkey // 150 AS r, o_orderkey % 150 AS c, o_totalprice AS v FROM orders),
g AS (SELECT r AS orow, c AS ocol, floor((r + 0.5e0) * 4 / 2)::BIGINT AS row, floor((-1 + (c + 0.5e0) * 4) / 2)::BIGINT AS col FROM range({MOSAIC_CELLS}) x(r), range(96) y(c)),
m AS (SELECT orow, ocol, p.v AS v2, q.v * 2 AS v3 FROM g LEFT JOIN a p ON p.r = g.row AND p.c = g.col LEFT JOIN a q ON q.r = g.row AND q.c = g.col - 40 AND trunc(q.v)::BIGINT % 2 = 0)"""


@register("mosaic_last_wins", MOSAIC_PX + " SELECT 1 AS band, orow, ocol, round(coalesce(v3, v2), 6) AS value FROM m WHERE coalesce(v3, v2) IS NOT NULL")
def _(spark, sf):
    pixels, src, grid = _two_sources(spark, sf)
    return rounded(mosaic(scatter(pixels, src, grid, "near")))


@register("init_dest", MOSAIC_PX + " SELECT 1 AS band, orow, ocol, round(coalesce(v3, v2, -7e0), 6) AS value FROM m")
def _(spark, sf):
    pixels, src, grid = _two_sources(spark, sf)
    return rounded(dense(mosaic(scatter(pixels, src, grid, "near")), grid, [1], -7.0))


@register("copy_window", f"SELECT 0 AS src_idx, band, row - 3 AS row, col - 3 AS col, value FROM ({emb_sql((9,))}) WHERE row BETWEEN 3 AND 14 AND col BETWEEN 3 AND 17")
def _(spark, sf):
    planned = W.plan(X.emb_catalog(spark, sf), WarpSpec(te=(500034.0, 4002414.0, 500176.0, 4002526.0), t_srs="EPSG:32631", bands=(9,)))
    return raster.cut_window(X.emb64(spark, sf, (9,)), planned.where("is_copy"))


@register("stack_bands", MOSAIC_PX + " SELECT b AS band, orow, ocol, round(CASE b WHEN 1 THEN v2 ELSE v3 END, 6) AS value FROM m, range(1, 3) t(b) WHERE CASE b WHEN 1 THEN v2 ELSE v3 END IS NOT NULL")
def _(spark, sf):
    pixels, src, grid = _two_sources(spark, sf)
    return rounded(stack.stack(pixels, src, grid, "near", scatter))


@register("stack_labels", f"""WITH s AS ({SRC}), o AS (SELECT *, coalesce(sum(n_bands) OVER (PARTITION BY src_idx % 7 ORDER BY src_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s), b AS (SELECT *, unnest(range(1, n_bands + 1)) AS band FROM o)
SELECT src_idx % 7 AS g, src_idx, band, (off + band)::BIGINT AS out_band, 'scene_' || src_idx || CASE WHEN n_bands > 1 THEN '_b' || band ELSE '' END AS label FROM b""")
def _(spark, sf):
    return stack.labels(X.sources(spark, sf).withColumn("g", F.col("src_idx") % 7), ["g"])


def _per_source_sql() -> str:
    near, mean = (warp_sql(m, ORD_PX, gt, MOSAIC(1), (150, ORD_ROWS), MOSAIC_CELLS) for m, gt in (("near", ORD_GT), ("average", (80.0, *ORD_GT[1:]))))
    mean = mean.replace("AS value FROM orders", "* 2 AS value FROM orders WHERE trunc(o_totalprice)::BIGINT % 2 = 0", 1)
    return f"SELECT 1 AS band, orow, ocol, value FROM ({near}) UNION ALL SELECT 2 AS band, orow, ocol, value FROM ({mean})"


@register("stack_per_source_r", _per_source_sql())
def _(spark, sf):
    pixels, src, grid = _two_sources(spark, sf)
    return rounded(stack.stack(pixels, src, grid, ["near", "average"], scatter))


# Each order as a source of 3 x 3 pixels, on a grid of which they cover little; cells are counted and filled there only.
SPOTS = "SELECT o_orderkey, (o_orderkey * 7919 % 100003)::BIGINT AS x, (o_orderkey * 104729 % 100019)::BIGINT AS y FROM orders"


def _spots(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = [(k * 7919 % 100003).cast("double"), F.lit(1.0), F.lit(0.0), -(k * 104729 % 100019).cast("double"), F.lit(0.0), F.lit(-1.0)]
    return X.table(spark, sf, "orders").select(k.cast("int").alias("src_idx"), F.lit(3).alias("width"), F.lit(3).alias("height"), F.lit("EPSG:32631").alias("crs"), F.struct(*[c.alias(f"gt{i}") for i, c in enumerate(at)]).alias("gt"))


@register("covered_blocks", f"""WITH s AS ({SPOTS}), e AS (SELECT greatest(0, y - 1) // 64 AS r0, (y + 4) // 64 AS r1, greatest(0, x - 1) // 64 AS c0, (x + 4) // 64 AS c1 FROM s)
SELECT DISTINCT br, bc FROM (SELECT unnest(range(r0, r1 + 1)) AS br, c0, c1 FROM e), LATERAL (SELECT unnest(range(c0, c1 + 1)) AS bc)""")
def _(spark, sf):
    return covered_blocks(_spots(spark, sf), OutGrid(0.0, 0.0, 1.0, 1.0, 1 << 17, 1 << 17, "EPSG:32631"), 64)


# The orders' raster with levels of half its size each, a cell the mean of the cells under it that have a value.
@register("overview_pyramid", "WITH RECURSIVE p AS (SELECT o_orderkey // 150 AS orow, o_orderkey % 150 AS ocol, o_totalprice::DOUBLE AS value FROM orders), a AS (SELECT orow // 2 AS orow, ocol // 2 AS ocol, avg(value) AS value FROM p GROUP BY ALL), b AS (SELECT orow // 2 AS orow, ocol // 2 AS ocol, avg(value) AS value FROM a GROUP BY ALL) SELECT level::INTEGER AS level, orow, ocol, round(value, 6) AS value FROM (SELECT 1 AS level, * FROM a UNION ALL SELECT 2, * FROM b)")
def _(spark, sf):
    cells = X.ord1(spark, sf).select(F.lit("x").alias("name"), "band", F.col("row").alias("orow"), F.col("col").alias("ocol"), "value")
    return rounded(tiff.pyramid(cells, 3).where("level > 0").select("level", "orow", "ocol", "value"))


# The orders' raster as a folder of files, one for each 1024 x 1024 cells, and the first overview read back from them.
@register("blocks_overview", "WITH p AS (SELECT o_orderkey // 150 AS orow, o_orderkey % 150 AS ocol, o_totalprice::DOUBLE AS value FROM orders) SELECT orow // 2 AS orow, ocol // 2 AS ocol, round(avg(value), 6) AS value FROM p GROUP BY 1, 2")
def _(spark, sf):
    cells = X.ord1(spark, sf).select("band", F.col("row").alias("orow"), F.col("col").alias("ocol"), "value")
    height = X.rows_of(spark, sf, "orders", "o_orderkey", 150)
    folder = datasource.write_blocks(cells, OutGrid(5e5, 4e6, 10.0, 10.0, 150, height, "EPSG:32631"), 1, shared_folder(spark), 1024, tiff.Layout(tile=64, nodata=-1.0), 1)
    tiles = spark.read.format(datasource.FORMAT).load(folder).where("level = 2 and band = 1")
    block = F.regexp_extract("src", r"block_(\d+)_(\d+)\.tif$", 1).cast("long")
    each = tiles.select((block * 512 + F.col("row0")).alias("row0"), "col0", "w", F.posexplode("data").alias("at", "value")).where("value <> -1")
    return rounded(each.select((F.col("row0") + F.expr("at div w")).alias("orow"), (F.col("col0") + F.col("at") % F.col("w")).alias("ocol"), "value"))


# --- a request tried out ----------------------------------------------------------------------------------------------

FAULT = """CASE WHEN src_idx % 10 = 1 THEN 'no coordinate system in ' WHEN n_bands < 2 THEN 'no band 2 in ' WHEN src_idx % 10 = 3 THEN 'a transform that can''t be inverted in '
  WHEN src_idx % 10 = 6 THEN 'no tiles in ' WHEN src_idx % 10 = 2 THEN 'an unknown coordinate system in ' WHEN src_idx % 10 = 4 THEN 'no image in EPSG:3857 of ' WHEN src_idx % 10 = 5 THEN 'an image in EPSG:3857 that doesn''t lead back to ' END"""


@register("preflight", f"SELECT src_idx, {FAULT} || src AS error FROM ({SRC})")
def _(spark, sf):
    """Suppliers' sources with faults of every kind: in the header, and far outside what their system can show."""
    k = F.col("src_idx") % 10
    crs = F.when(k == 1, F.lit(None)).when(k == 2, "EPSG:9999").otherwise(F.col("crs"))
    east = F.col("gt.gt0") + F.when(k == 4, 1e12).when(k == 5, 3e7).otherwise(0.0)
    cell = F.when(k == 3, 0.0).otherwise(F.col("gt.gt1"))
    gt = F.struct(east.alias("gt0"), cell.alias("gt1"), *[F.col(f"gt.gt{i}").alias(f"gt{i}") for i in range(2, 6)])
    levels = F.transform("levels", lambda v: F.struct(v["level"], v["width"], v["height"], F.when(k != 6, v["tile_width"]).alias("tile_width"), v["tile_height"]))
    return preflight(X.sources(spark, sf).withColumns({"crs": crs, "gt": gt, "levels": levels}), WarpSpec(t_srs="EPSG:3857", bands=(2,))).select("src_idx", "error")


# --- groups -----------------------------------------------------------------------------------------------------------


@register("batch_unstacked", "SELECT user_id AS group_idx, event_id AS band_pos, CASE WHEN event_type <> 'error' THEN event_id::VARCHAR END AS payload, event_type = 'error' AS failed FROM events")
def _(spark, sf):
    return B.unstacked(X.windows_done(spark, sf))


@register("batch_stacked", "SELECT user_id AS group_idx, bool_or(event_type = 'error') AS failed, count(*) AS n_windows, CASE WHEN NOT bool_or(event_type = 'error') THEN string_agg(event_id::VARCHAR, ',' ORDER BY event_id) END AS payloads FROM events GROUP BY 1")
def _(spark, sf):
    return B.stacked(X.windows_done(spark, sf)).withColumn("payloads", F.array_join("payloads", ","))


@register("stream_stacked", ORACLES["batch_stacked"])
def _(spark, sf):
    """The same groups from a stream of all windows, run to its end."""
    folder = shared_folder(spark)
    stream = B.window_stream(B.needed(X.windows_done(spark, sf)), f"{folder}/in", per_file=1 << 16, files_per_batch=64)
    out = B.stack_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    done = spark.read.schema("group_idx long, failed boolean, n_windows long, payloads array<string>").parquet(f"{folder}/out")
    return done.withColumn("payloads", F.array_join("payloads", ","))


@register("batch_failures", "SELECT user_id AS group_idx, count(*) FILTER (WHERE event_type = 'error') AS n_failed, count(*) AS n_windows FROM events GROUP BY 1")
def _(spark, sf):
    return B.failures(X.windows_done(spark, sf))


@register("batch_paths", """WITH p AS (SELECT DISTINCT user_id AS group_idx, event_id AS band_pos, 'out/aoi_' || CASE WHEN user_id % 3 = 0 THEN user_id::VARCHAR ELSE 'g' || user_id % 50 END || '_' || CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE 'b' || event_id % 100 END || '.tif' AS path FROM events)
SELECT group_idx, band_pos, path, count(*) OVER (PARTITION BY path) AS n_same FROM p""")
def _(spark, sf):
    named = X.windows_done(spark, sf).select("group_idx", "band_pos", F.when(F.col("group_idx") % 3 != 0, F.concat(F.lit("g"), (F.col("group_idx") % 50).cast("string"))).otherwise("").alias("group_name"), F.when(F.col("band_pos") % 2 == 1, F.concat(F.lit("b"), (F.col("band_pos") % 100).cast("string"))).alias("band_name"))
    return B.output_paths(named, "out/aoi.tif", stack=False)


@register("batch_relist", "SELECT user_id AS group_idx, string_agg('p' || event_id, ',' ORDER BY event_id) AS paths FROM events GROUP BY 1")
def _(spark, sf):
    done = X.windows_done(spark, sf).select("group_idx", "band_pos", F.concat(F.lit("p"), F.col("payload")).alias("path"))
    return B.relist(done).withColumn("paths", F.array_join("paths", ","))


@register("describe_sources", f"""SELECT src, src_idx, '128 x 128' AS size, 0e0 AS megapixels, n_bands || ' ' || dtype AS bands, '10' AS resolution, crs, CASE nodata WHEN 0 THEN '0' WHEN -9999 THEN '-9999' ELSE '<none>' END AS nodata, '2 (128x128, 64x64, 32x32)' AS overviews,
  CASE n_bands WHEN 1 THEN 'band_01' WHEN 2 THEN 'band_01, band_02' ELSE 'band_01, band_02 and 1 more' END AS band_names FROM ({SRC})""")
def _(spark, sf):
    return W.described(X.sources(spark, sf).withColumn("band_names", M.band_names(F.lit(None).cast("string"), F.col("n_bands"))), 2)
