"""Virtual rasters, catalogs and source strings over the test tables, for Spark; catalogue.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.spec import OutGrid

EMB_WIDTH = 25
EMB_GT = (500000.0, 10.0, 0.0, 4002560.0, 0.0, -10.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, sf_dir: str, name: str, key: str, width: int) -> int:
    """How many rows of pixels a table makes as a raster of this width."""
    return table(spark, sf_dir, name).agg(F.max(key)).first()[0] // width + 1


def gt_struct(values: tuple):
    return F.struct(*[F.lit(float(v)).alias(f"gt{i}") for i, v in enumerate(values)])


def emb64(spark: SparkSession, sf_dir: str, bands: tuple[int, ...] = (11, 10, 9)) -> DataFrame:
    """The embeddings as a 25 pixels wide raster of 64 bands; only the wanted elements leave the array."""
    picked = F.array(*[F.struct(F.lit(b).alias("band"), F.get("embedding", F.lit(b - 1)).cast("double").alias("value")) for b in bands])
    rows = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {EMB_WIDTH}").alias("row"), (F.col("vec_id") % EMB_WIDTH).alias("col"), F.explode(picked).alias("p"))
    return rows.select(F.lit(0).alias("src_idx"), F.col("p.band").alias("band"), "row", "col", F.col("p.value").alias("value"))


def part2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bands over parts, 50 pixels wide; 50 is nodata."""
    p = F.array(F.struct(F.lit(1).alias("band"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit(2).alias("band"), F.col("p_retailprice").cast("double").alias("value")))
    at = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.floor(at / 50).alias("row"), (at % 50).alias("col"), F.explode(p).alias("p"))
    return rows.select(F.lit(1).alias("src_idx"), F.col("p.band").alias("band"), "row", "col", F.col("p.value").alias("value"))


def ord1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One band over orders, 150 pixels wide."""
    at = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.lit(2).alias("src_idx"), F.lit(1).alias("band"), F.floor(at / 150).alias("row"), (at % 150).alias("col"), F.col("o_totalprice").cast("double").alias("value"))


def one_source(spark: SparkSession, src_idx: int, gt: tuple, width: int, height: int, n_bands: int = 1, nodata: float | None = None, crs: str = "EPSG:32631") -> DataFrame:
    """A catalog of one source with three levels."""
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(max(1, width >> n - 1)).alias("width"), F.lit(max(1, height >> n - 1)).alias("height"), F.lit(32).alias("tile_width"), F.lit(32).alias("tile_height")) for n in (1, 2, 3)])
    return spark.range(1).select(
        F.lit(f"s{src_idx}.tif").alias("src"), F.lit(src_idx).alias("src_idx"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(n_bands).alias("n_bands"), F.lit("Float64").alias("dtype"),
        F.lit(nodata).cast("double").alias("nodata"), F.lit(crs).alias("crs"), gt_struct(gt).alias("gt"), levels.alias("levels"),
    )


def emb_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_source(spark, 0, EMB_GT, EMB_WIDTH, rows_of(spark, sf_dir, "embeddings", "vec_id", EMB_WIDTH), 64)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier is a source of 128 x 128 pixels with levels of 128, 64 and 32, ten to a row."""
    k = F.col("s_suppkey")
    gt = F.struct((k % 10 * 1280.0 + 5e5).alias("gt0"), F.lit(10.0).alias("gt1"), F.lit(0.0).alias("gt2"), (F.lit(4002560.0) - F.floor(k / 10) * 1280.0).alias("gt3"), F.lit(0.0).alias("gt4"), F.lit(-10.0).alias("gt5"))
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(128 >> n - 1).alias("width"), F.lit(128 >> n - 1).alias("height"), F.lit(32).alias("tile_width"), F.lit(32).alias("tile_height")) for n in (1, 2, 3)])
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s3://bucket/scene_"), k.cast("string"), F.lit(".tif?v=1")).alias("src"), k.cast("int").alias("src_idx"), F.lit(128).alias("width"), F.lit(128).alias("height"), (k % 3 + 1).cast("int").alias("n_bands"),
        F.when(k % 2 == 0, "Int16").otherwise("Float32").alias("dtype"), F.when(F.col("s_nationkey") % 3 == 0, 0.0).when(F.col("s_nationkey") % 3 == 1, -9999.0).alias("nodata"), F.lit("EPSG:32631").alias("crs"), gt.alias("gt"), levels.alias("levels"),
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses, with signatures and other schemes added by page number."""
    k = F.col("page_id") % 8
    src = (
        F.when(k == 0, F.concat("url", F.lit("?AccessKeyId=a&Signature=b"))).when(k == 1, F.concat("url", F.lit("?x-amz-signature=b"))).when(k == 2, F.lit("https://acct.blob.core.windows.net/c/f.tif?sp=r&sig=x"))
        .when(k == 3, F.lit("https://acct.dfs.core.windows.net/c/f.tif?Sig=x")).when(k == 4, F.concat(F.lit("s3://bucket/"), F.col("page_id").cast("string"), F.lit(".tif"))).when(k == 5, F.lit("C://data/f.tif")).when(k == 6, F.lit("https://Host.example:8443/a/b.tif?X-Goog-Signature=1&z")).otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", src.alias("src"))


def windows_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a completed window: the user its group, an error event a failure."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("group_idx"), F.col("event_id").alias("band_pos"), F.col("event_id").cast("string").alias("payload"), F.when(F.col("event_type") == "error", "failed").alias("error"))


def tall(xmin: float, ymax: float, xres: float, yres: float, width: int, crs: str | None = None):
    """Grids of this corner, cell size and width, for any height."""
    return lambda height: OutGrid(xmin, ymax, xres, yres, width, height, crs)


def grid(te: tuple, width: int, height: int, crs: str | None = None) -> OutGrid:
    return OutGrid(te[0], te[3], (te[2] - te[0]) / width, (te[3] - te[1]) / height, width, height, crs)
