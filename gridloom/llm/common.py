"""What several operators share: word splitting, held-out folds, written tables, bounded label samples."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a class of a regular expression and as the characters themselves.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


_made = threading.local()


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and Spark runs in this process alone (as in tests) a
    temporary one is set; on a cluster executors would not see it, so there the setting is required."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: lineage ends here, and a lost
    executor costs nothing but a new read. What was shuffled for it is of no more use; Spark deletes such files once the
    driver's JVM has collected what referred to them, which is asked for here, as a driver that does little else may not
    do so for half an hour."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    if getattr(_made, "tables", None) is not None:
        _made.tables.append(out)
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table from written(), once nothing reads it any more."""
    spark = df.sparkSession
    try:
        files = df.inputFiles()[:1]
    except AnalysisException:  # deleted already
        return
    for file in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("gridloom-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() describes, written; every other table that was written on the way is deleted."""
    outer, _made.tables = getattr(_made, "tables", None), []
    try:
        out = written(make())
        for t in _made.tables[:-1]:
            drop_written(t)
    finally:
        _made.tables = outer
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it unlike every column of df (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its exact name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def lookup(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows joined with named, which has each key once. Keys of over a thousandth of all rows, a thousand at most, are
    broadcast with what is named by them; so the rows of such a key stay where they are, and no task gets them all."""
    many = written(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1))
    hot = written(many.where(F.col("n") > rows.count() / 1000).select(key))
    drop_written(many)
    if hot.isEmpty():
        return rows.join(named, key)
    frequent = named.join(F.broadcast(hot), key, "left_semi")
    others = rows.join(F.broadcast(hot), key, "left_anti").join(named, key)
    return rows.join(F.broadcast(frequent), key).unionByName(others)


def attached(rows: DataFrame, named: DataFrame, hot: DataFrame, *keys: str) -> DataFrame:
    """rows joined with named, which has each key once. hot are the rows of named, or more, whose keys hold over a thousandth
    of rows (so a thousand at most); it is broadcast, and the rows of such keys stay where they are."""
    on = list(keys)
    others = rows.join(F.broadcast(hot.select(*keys)), on, "left_anti").join(named, on)
    return rows.join(F.broadcast(hot.select(*named.columns)), on).unionByName(others)


def recurring(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys (not null) more than one row has, with the number n of these. rows is read three times."""
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))
    return attached(rows, counts, counts.where(F.col("n") > rows.count() / 1000), *keys)


def agreed_labels(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """doc_id and label (int) of the rows that ``train`` admits, one for each id. A document with contradicting or null
    labels isn't used."""
    found = labels.where(F.col("doc_id").isNotNull() & train).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
    seen = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"), F.count(F.when(F.col("label").isNull(), 1)).alias("none"))
    return seen.where((F.col("label") == F.col("most")) & F.col("label").isin(0, 1) & (F.col("none") == 0)).select("doc_id", F.col("label").cast("int").alias("label"))


def sampled(agreed: DataFrame, max_rows: int) -> DataFrame:
    """Of agreed labels the max_rows whose ids hash lowest."""
    return agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
