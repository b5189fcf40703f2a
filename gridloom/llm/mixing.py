"""Temperature mixing of sources to target weights.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected (sixteen ways a
round) to the smallest in [0, 1] that keeps every source's repetition within a limit, or to the largest that reaches a
target entropy. The weights times the token budget are then realised as block permutations: a source's documents are
dealt to blocks by hash; each whole epoch draws all blocks, the last one draws blocks in that epoch's permutation until
the budget is met, and of the block at which it is met the documents that come first in hash order. A source's last
block and document say which documents its last epoch draws, so texts are joined with a row for each source only, and no
source's documents meet in one task. A block holds about ``block_docs`` documents, more in sources of over MOST_BLOCKS
such blocks. A target that no exponent in [0, 1] meets raises.

Without a budget it is the least one that draws every source once at least; then no document is left out.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and are drawn with their block;
a source without tokens is drawn once; repeated rows of one id are drawn together; extra columns stay, but n_tokens,
epoch, block, block_key and doc_key are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.llm.common import column, drop_written, fresh, table, words, written

MOST_BLOCKS = 65_536
OWN = ("n_tokens", "epoch", "block", "block_key", "doc_key")


def _key(*parts: Column) -> Column:
    """A hash below 2^60 that SQL engines share: the first 15 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def exponent(sources: DataFrame, repetition: float | None, entropy: float | None, budget: int | None, rounds: int = 13) -> float:
    """Bisect over ``sources`` (tokens above 0). Each round is one small aggregation for sixteen exponents at once."""
    lo, hi = 0.0, 1.0
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / 16 for i in range(17)]
        p, a = F.col("tokens") / F.lit(float(total)), F.col("a")
        row = sources.select("tokens", F.explode(F.array(*[F.lit(x) for x in grid])).alias("a")).groupBy("a").agg(
            F.sum(F.pow(p, a)).alias("z"), F.sum(F.pow(p, a) * F.log(p)).alias("zl"), F.max(F.pow(p, a - 1)).alias("most"), F.min(F.pow(p, a - 1)).alias("least")
        )
        if repetition is not None:  # tokens drawn over tokens there, of the source that is repeated most
            drawn = F.col("most") / F.col("least") if budget is None else F.col("most") / F.col("z") * (budget / total)
            fits = {r.a: r.x <= repetition + 1e-12 for r in row.select("a", drawn.alias("x")).collect()}
            first = next((i for i, x in enumerate(grid) if fits[x]), None)
            if first is None:
                raise ValueError(f"no exponent keeps every source's repetition within {repetition}")
            lo, hi = grid[max(0, first - 1)], grid[first]
            if first == 0:
                return lo
        else:
            fits = {r.a: r.h >= entropy - 1e-12 for r in row.select("a", (F.log("z") - F.col("a") * F.col("zl") / F.col("z")).alias("h")).collect()}
            last = max((i for i, x in enumerate(grid) if fits[x]), default=None)
            if last is None:
                raise ValueError(f"no exponent reaches an entropy of {entropy}")
            lo, hi = grid[last], grid[min(16, last + 1)]
            if last == 16:
                return hi
    return hi if repetition is not None else lo


def mix(docs: DataFrame, source: str = "source", repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_docs: int = 1024, seed: int = 0) -> DataFrame:
    """A row for each time a document is drawn: its columns, n_tokens, epoch (from 1), block, and the keys by which an
    epoch orders its blocks and a block its documents."""
    if (repetition is None) == (entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    docs = docs.drop(*OWN)

    def hashes() -> list[Column]:
        doc = F.coalesce(column("doc_id").cast("string"), F.lit(""))
        return [F.size(words(column("text"))).cast("long"), _key(F.lit(f"block{seed}"), doc), _key(F.lit(f"doc{seed}"), doc)]

    def block_key(epoch: Column, of: Column, block: Column) -> Column:
        return _key(F.lit(f"order{seed}"), epoch.cast("string"), F.coalesce(of.cast("string"), F.lit("")), block.cast("string"))

    # Sizes and hashes of every document, written once; all counts come from these.
    light = written(docs.select(column(source).alias("s"), *[c.alias(n) for c, n in zip(hashes(), ("n_tokens", "deal", "doc_key"), strict=True)]))
    sources = written(light.groupBy("s").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    some = sources.where("tokens > 0")
    a = exponent(some, repetition, entropy, budget)
    total = some.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens") / F.lit(float(total))
    z, least = some.agg(F.sum(F.pow(share, F.lit(a))), F.min(F.pow(share, F.lit(a - 1)))).first()
    budget = total * z / least if budget is None and z else budget
    drawn = F.round(F.pow(share, F.lit(a)) / F.lit(z or 1.0) * F.lit(float(budget or 0))).cast("long")
    weighed = sources.withColumn("drawn", F.when(F.col("tokens") > 0, drawn).otherwise(0)).select(
        "s", F.when(F.col("tokens") > 0, F.expr("drawn div tokens")).otherwise(1).alias("whole"), F.when(F.col("tokens") > 0, F.col("drawn") % F.col("tokens")).otherwise(0).alias("rest"),
        F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n") / block_docs)).alias("blocks"),
    )
    weighed = written(weighed)
    of = weighed.withColumnRenamed("s", "of")
    sized = light.join(of, F.col("s").eqNullSafe(F.col("of"))).where("rest > 0").select("s", "whole", "rest", (F.col("deal") % F.col("blocks")).alias("block"), "doc_key", "n_tokens")
    blocks = sized.groupBy("s", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("key", block_key(F.col("whole") + 1, F.col("s"), F.col("block")))
    before = Window.partitionBy("s").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumn("left", F.col("rest") - F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    # The first block that doesn't fit as a whole, and of its documents those up to a key.
    edges = written(summed.where("tokens > left").groupBy(F.col("s").alias("of")).agg(F.min(F.struct("key", "block", "left")).alias("e")).select("of", "e.*"))
    inside = sized.join(edges.withColumnRenamed("block", "edge"), F.col("s").eqNullSafe(F.col("of")) & (F.col("block") == F.col("edge"))).select("of", "left", "doc_key", "n_tokens")
    up_to = Window.partitionBy("of").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, 0)
    cuts = inside.withColumn("upto", F.sum("n_tokens").over(up_to)).where("upto <= left").groupBy(F.col("of").alias("cut_of")).agg(F.max("doc_key").alias("cut"))
    ends = edges.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left").select(F.col("of").alias("end_of"), F.col("key").alias("end_key"), F.col("block").alias("end_block"), F.coalesce("cut", F.lit(-1)).alias("cut"))
    plan = written(weighed.join(ends, F.col("s").eqNullSafe(F.col("end_of")), "left").select(F.struct("whole", "blocks", "end_key", "end_block", "cut").alias("plan"), "s"))
    for t in (light, sources, weighed, edges):
        drop_written(t)

    n_tokens, deal, doc_key, at, to = fresh(docs, "n_tokens", "deal", "doc_key", "plan", "of")
    rows = docs.withColumns(dict(zip((n_tokens, deal, doc_key), hashes(), strict=True)))
    # Sources are few next to documents; Spark picks the join by size.
    joined = rows.join(plan.select(F.col("plan").alias(at), F.col("s").alias(to)), column(source).eqNullSafe(F.col(to)))
    own = column(at)
    block = F.col(deal) % own["blocks"]
    key = block_key(own["whole"] + 1, column(source), block)
    again = (F.struct(key.alias("a"), block.alias("b")) < F.struct(own["end_key"].alias("a"), own["end_block"].alias("b"))) | ((block == own["end_block"]) & (F.col(doc_key) <= own["cut"]))
    copies = own["whole"] + F.when(own["end_block"].isNotNull() & again, 1).otherwise(0)
    epoch, in_block = fresh(joined, "epoch", "block")
    out = joined.withColumn(in_block, block).withColumn(epoch, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies.cast("long")))))
    return out.select(*map(column, docs.columns), F.col(n_tokens).alias("n_tokens"), F.col(epoch).alias("epoch"), F.col(in_block).alias("block"), block_key(F.col(epoch), column(source), F.col(in_block)).alias("block_key"), F.col(doc_key).alias("doc_key"))


def op10(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch", "block", "block_key", "doc_key")


# The exponent that bisecting finds has a closed form here: the largest source is drawn once, the smallest twice.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n FROM d GROUP BY ALL),
e AS (SELECT greatest(0e0, 1e0 - ln(2e0) / nullif(ln(max(tokens)::DOUBLE / min(tokens)), 0)) AS a, max(tokens) AS most FROM s WHERE tokens > 0),
w AS (SELECT source, tokens, least(65536, ceil(n / 1024e0))::BIGINT AS blocks, round(CASE WHEN a IS NULL THEN tokens ELSE pow(tokens::DOUBLE / most, a) * most END)::BIGINT AS drawn FROM s, e),
x AS (SELECT *, CASE WHEN tokens > 0 THEN drawn // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN drawn % tokens ELSE 0 END AS rest FROM w),
p AS (SELECT d.*, whole, rest, ('0x' || substr(md5('block0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % blocks AS block,
  ('0x' || substr(md5('doc0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS doc_key FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
o AS (SELECT *, ('0x' || substr(md5('order0:' || (whole + 1) || ':' || coalesce(source, '') || ':' || block), 1, 15))::BIGINT AS last_key FROM p),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY last_key, block, doc_key) AS upto FROM o),
r AS (SELECT *, unnest(range(1, 1 + whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM c)
SELECT doc_id, source, n_tokens, epoch::BIGINT AS epoch, block, ('0x' || substr(md5('order0:' || epoch || ':' || coalesce(source, '') || ':' || block), 1, 15))::BIGINT AS block_key, doc_key FROM r
"""
