"""Conflict-constrained best-fit packing.

Documents become pieces of at most ``capacity`` tokens (words). Pieces are dealt to shards by hash; a shard takes them
largest first. Its bins are ordered by residual capacity and carry bitmaps: one of the duplicate clusters they hold and
``per_source`` planes of their sources. A piece goes to the tightest bin that has room and no conflict: the search starts
at the first residual that fits and goes on to the next larger one while a bin already holds the piece's cluster, or its
source in every plane; a piece that fits nowhere opens a bin. There is a shard for every
``shard_pieces`` pieces, at any input size, however long the documents are and however often a row repeats: equal rows are
counted, and their copies numbered, before they are dealt.

Defined cases: null and empty texts are pieces of no tokens and go to a bin like any other; pieces of one document are
of one cluster, and so are repeated rows and exact copies, so none of these share a bin; a null source is a source of its
own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column, table, words, written

#: Copies of a row that one task unfolds.
UNFOLD = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Each piece's bin and its offset there. Pieces come largest first."""
    source_no: dict = {}
    cluster_no: dict = {}
    open_bins: list[tuple[int, int]] = []  # (residual, bin), in order
    planes: list[list[int]] = []
    held: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 1 << source_no.setdefault(source, len(source_no))
        c = 1 << cluster_no.setdefault(cluster, len(cluster_no))
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not held[b] & c and not all(p & s for p in planes[b]):
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(held)
            held.append(0)
            planes.append([0] * per_source)
        held[b] |= c
        free = next(i for i, p in enumerate(planes[b]) if not p & s)
        planes[b][free] |= s
        insort(open_bins, (residual - size, b))
        bins.append(b)
        offsets.append(capacity - residual)
    return bins, offsets


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 4, shard_pieces: int = 2048, source: str = "source", cluster: Column | None = None) -> DataFrame:
    """doc_id, source, piece, first_token, n_tokens, bin_id and bin_offset of every piece. ``cluster`` says which
    documents are duplicates; by default those whose words are equal."""
    ws = words(F.col("text"))
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column(source).cast("string").alias("source"), F.size(ws).alias("n"), (F.xxhash64(F.array_join(ws, " ")) if cluster is None else cluster).cast("long").alias("cluster"))
    # Sizes only; the texts are read once. Equal rows are one with a number, so that a row that repeats is no hot key; the
    # numbers are unfolded in two steps, the second one after a shuffle.
    light = written(light.groupBy("doc_id", "source", "n", "cluster").agg(F.count("*").alias("times")))
    parts = light.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / UNFOLD)))).repartition("doc_id", "cluster", "part")
    copies = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * UNFOLD, F.least(F.col("times"), (F.col("part") + 1) * UNFOLD) - 1)))
    pieces = copies.select("doc_id", "source", "cluster", "copy", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity)).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "source", "cluster", "copy", "piece", (F.col("piece") * capacity).cast("long").alias("first_token"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("n_tokens"))
    total = light.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)) * F.col("times"))).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    # By a hash of the row and its number, so that a task that runs again deals its rows alike.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "piece", "cluster", "copy"), F.lit(shards)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece", "cluster", "copy"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit(rows.n_tokens.tolist(), rows.source.tolist(), rows.cluster.tolist(), capacity, per_source)
        rows["bin_id"] = [f"{s}-{b}" for s, b in zip(rows["shard"], bins, strict=True)]
        rows["bin_offset"] = offsets
        return rows.drop(columns=["cluster", "copy", "shard"])

    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, source string, piece int, first_token long, n_tokens long, bin_id string, bin_offset long")


def op5(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
