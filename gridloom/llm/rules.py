"""Quality rules with risk-controlled thresholds.

A rule rejects a text whose feature exceeds a cut-off. Labelled holdouts (rows labelled good) choose the cut-offs: of a
stratum's n good rows, k exceed a candidate. The candidate's false rejection is at most ``risk`` with confidence if a
binomial with that risk gives k or fewer of n with probability ``error`` / m at most; that is the exact (Clopper-Pearson)
upper bound, and m, the number of stratum, rule and candidate triples, corrects for testing them all (Bonferroni). Each
stratum and rule takes the strictest candidate that passes; where none passes, the rule rejects nothing there. The risk
is a total, shared evenly by the rules. Fixed base rules come first.

Defined cases: null and empty texts have no words and fail the base rules; a null stratum is a stratum of its own; good
rows are label rows of quality 1, a document with contradicting labels isn't used; repeated rows count as rows; extra
columns are ignored; an empty table gives no rows, and without labels only the base rules reject.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE_CHARS, table, words, written

SYMBOLS = "#*$%&|<>"
#: Candidates of each rule, from strict to lax. The features are shares of a text's words or lines, and a mean length.
CANDIDATES = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
    "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.5],
    "repeat_share": [0.05, 0.1, 0.2, 0.3, 0.4],
    "mean_word_chars": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
}


def _window_hashes(w: Column) -> Column:
    """64-bit hashes of a text's 3-word windows, in order."""
    return F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (words in 3-word windows
    found twice or more) of each whole text. Only texts with repeated windows sort theirs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    one = docs.select(
        *keep,
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"), words(F.col("text")).alias("_w"),
    )
    two = one.select(*keep, "word_chars", "n_symbols", F.size("_w").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), _window_hashes(F.col("_w")).alias("_h"))
    ordered = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    three = two.select(*keep, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered).otherwise(F.slice(ordered, 1, 0)).alias("_o"))
    twice = F.filter("_o", lambda x, j: (x["h"] == F.get("_o", j - 1)["h"]) | (x["h"] == F.get("_o", j + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return three.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.size(covered).cast("long").alias("n_repeat_words"))


def _features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbols_per_word": F.col("n_symbols") / n, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / n, "mean_word_chars": F.col("word_chars") / n}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """Of x >= 1: Stirling's series at x + 8, taken back by the recurrence."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - sum(F.log(x + i) for i in range(8))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial; above the mean it isn't needed: 1. Terms are summed from k down. Below the mean they fall at
    least as fast as a normal density, so those beyond twelve standard deviations and fifty more add nothing."""
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 50).cast("long")

    def add(acc: Column, i: Column) -> Column:
        at = k - i + 1  # the term of at - 1 from that of at
        t = acc["t"] * at * (1 - p) / ((n - at + 1) * p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    below = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(below, F.struct(first.alias("t"), first.alias("s")), add, lambda acc: acc["s"])
    return F.when(k > n * p, 1.0).otherwise(total)


def cutoffs(good: DataFrame, stratum: str, risk: float, error: float) -> DataFrame:
    """_stratum and a cut-off for each rule (null: none passes), from the counts of good rows."""
    grid = [(rule, x) for rule, xs in CANDIDATES.items() for x in xs]
    feature = _features()
    tallied = good.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("n"), *[F.count(F.when(feature[rule] > x, 1)).alias(f"k{i}") for i, (rule, x) in enumerate(grid)])
    tallied = written(tallied)
    strata = max(1, tallied.count())
    each = risk / len(CANDIDATES)
    passes = [binomial_tail(F.col(f"k{i}"), F.col("n"), each) <= error / (strata * len(grid)) for i in range(len(grid))]
    return tallied.select("_stratum", *[F.array_min(F.filter(F.array(*[F.when(ok, F.lit(x)) for (r, x), ok in zip(grid, passes, strict=True) if r == rule]), lambda x: x.isNotNull())).alias(f"cut_{rule}") for rule in CANDIDATES])


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.04, error: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed, rejected_by (the rules, in order) and kept."""
    feats = written(counts(docs, list(dict.fromkeys(["doc_id", stratum]))))
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = 1 and b = 1").select("doc_id")
    cuts = written(cutoffs(feats.where(~base_failed()).join(good, "doc_id", "left_semi"), stratum, risk, error))
    feature = _features()
    joined = feats.join(cuts, feats[stratum].eqNullSafe(cuts["_stratum"]), "left")
    by = F.filter(F.array(*[F.when(feature[rule] > F.col(f"cut_{rule}"), F.lit(rule)) for rule in CANDIDATES]), lambda x: x.isNotNull())
    out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), by.alias("rejected_by"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op8(spark, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def _op8_sql() -> str:
    ws = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    exprs = {"symbols_per_word": "n_symbols / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)", "mean_word_chars": "word_chars / greatest(n_words, 1)"}
    grid = ", ".join(f"('{rule}', {x}e0)" for rule, xs in CANDIDATES.items() for x in xs)
    feats = " UNION ALL ".join(f"SELECT r, doc_id, lang, base_failed, '{rule}' AS rule, ({e})::DOUBLE AS x FROM f" for rule, e in exprs.items())
    p, m = f"({0.04 / len(CANDIDATES)!r}::DOUBLE)", sum(map(len, CANDIDATES.values()))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, {ws} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {blank}) <> '') AS ls FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rw AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g2 WHERE c > 1) GROUP BY r),
f0 AS (SELECT d.r, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rw.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rw ON d.r = rw.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f0),
x AS ({feats}),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
c AS (SELECT rule, cut FROM (VALUES {grid}) v(rule, cut)),
t AS (SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (WHERE x > cut) AS k FROM x JOIN c USING (rule) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
s AS (SELECT *, (SELECT count(*) FROM (SELECT DISTINCT lang FROM t)) AS strata FROM t),
b AS (SELECT lang, rule, cut, strata, CASE WHEN k > n * {p} THEN 1e0 ELSE list_sum(list_transform(range(0, k + 1),
  lambda i: exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) + i * ln({p}) + (n - i) * ln(1e0 - {p})))) END AS tail FROM s),
u AS (SELECT lang, rule, min(cut) AS cut FROM b WHERE tail <= 0.05e0 / (strata * {m}) GROUP BY ALL),
z AS (SELECT r, string_agg(x.rule, ',' ORDER BY list_position({list(CANDIDATES)}, x.rule)) AS rejected_by FROM x JOIN u ON x.rule = u.rule AND x.lang IS NOT DISTINCT FROM u.lang WHERE x.x > u.cut GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND z.r IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM f LEFT JOIN z ON f.r = z.r"""


OP8_SQL = _op8_sql()
