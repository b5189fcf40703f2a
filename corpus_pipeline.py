"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import drop_written, fold, swept, table
from gridloom.llm.lines import drop_boilerplate
from gridloom.llm.mixing import mix
from gridloom.llm.packing import pack
from gridloom.llm.simhash import keep_first
from gridloom.llm.toxicity import score_toxicity

#: The columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return scored.where("toxic_predicted = 0").select(*COLUMNS)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; n_chars follows the text."""
    cleaned = drop_boilerplate(docs, host="source")
    return cleaned.withColumn("n_chars", F.when(F.col("n_lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the smallest id stays."""
    return keep_first(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is drawn once at least; documents of small sources up to twice."""
    return mix(docs, source="source", repetition=2.0).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and the bin it went to."""
    return pack(docs, capacity=2048)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_boilerplate),
    ("simhash_near_dedup", remove_near_copies),
    ("temperature_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the classifier, the fingerprints' hash or best-fit; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = swept(lambda: stage(spark, before, sf_dir))  # noqa: B023
        drop_written(before)  # the input tables themselves stay: only folders of written() go
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
