"""Connected components by alternating stars (Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the least of its neighbourhood. Least neighbours come from a
    partial aggregation and a join that Spark may split, so a node of many links doesn't meet in one task."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    kept = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return kept.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b) of longs; root is the least node of the component. Each round is
    written to the shared folder; the rounds end when one changes nothing."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    before = None
    while True:
        now = edges.agg(F.count("*"), mark).first()
        if now == before or not now[0]:
            break
        before = now
        new = written(_star(_star(edges, large=True), large=False))
        drop_written(edges)
        edges = new
    # Every node now links straight to its root.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
