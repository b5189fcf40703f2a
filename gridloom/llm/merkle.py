"""Document fingerprints: Merkle trees over paragraphs and sections.

A text's sections lie between empty lines, a section's paragraphs are its lines, a paragraph's leaves are pieces of eight
words with the white space around them (words of over 64 code points count several times). A leaf's digest is the SHA-256
of its text, any other node's that of its children's digests: equal roots mean equal texts, and differing branches locate
an edit. The likeness of two trees comes from descending them together, section by section and paragraph by paragraph:
what lies below equal digests is alike, and below differing ones the leaves that both sides have. It is the number of
leaves alike over that of the larger tree. The fingerprint is the root, then the first eight hex digits of every leaf, with
``.`` between paragraphs and ``/`` between sections.

Defined cases: a null text is an empty one; two texts without leaves are alike (1), one without and one with are not (0);
rows of equal id follow each other in the order of a hash of their texts; null ids come first; the last row's next is
the first row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.llm.common import table

#: Hex digits of a leaf that the fingerprint shows and that leaves are compared by.
DIGITS = 8
#: Eight words and the white space around them, or white space alone.
LEAF = r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]{1,64}){1,8}[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"


def tree(text: Column) -> Column:
    """sections: array<struct<digest, paragraphs: array<struct<digest, leaves: array<string>>>>>."""
    cut = F.transform(F.split(text, "\n\n"), lambda s: F.split(s, "\n"))
    hashed = F.transform(cut, lambda ps: F.transform(ps, lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))))
    paragraphs = F.transform(hashed, lambda ps: F.transform(ps, lambda xs: F.struct(F.sha2(F.array_join(xs, ""), 256).alias("digest"), F.transform(xs, lambda x: F.substring(x, 1, DIGITS)).alias("leaves"))))
    return F.transform(paragraphs, lambda ps: F.struct(F.sha2(F.array_join(F.transform(ps, lambda p: p["digest"]), ""), 256).alias("digest"), ps.alias("paragraphs")))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["digest"]), ""), 256)


def shown(sections: Column) -> Column:
    """The fingerprint of a tree."""
    leaves = F.array_join(F.transform(sections, lambda s: F.array_join(F.transform(s["paragraphs"], lambda p: F.array_join(p["leaves"], "")), ".")), "/")
    return F.concat(root(sections), F.lit(":"), leaves)


def n_leaves(sections: Column) -> Column:
    return F.aggregate(sections, F.lit(0), lambda n, s: n + F.aggregate(s["paragraphs"], F.lit(0), lambda m, p: m + F.size(p["leaves"])))


def edited_branches(a: Column, b: Column) -> Column:
    """(section, paragraph, a_leaves, b_leaves) where two trees differ, numbered from 0; leaves of a paragraph that one side
    lacks are null. A branch of equal digests isn't descended."""
    span = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)

    def below(i: Column) -> Column:
        x, y = F.get(a, i), F.get(b, i)
        most = F.greatest(F.coalesce(F.size(x["paragraphs"]), F.lit(0)), F.coalesce(F.size(y["paragraphs"]), F.lit(0)))
        at = F.filter(F.sequence(F.lit(0), most - 1), lambda j: ~F.get(x["paragraphs"], j)["digest"].eqNullSafe(F.get(y["paragraphs"], j)["digest"]))
        return F.transform(at, lambda j: F.struct(i.alias("section"), j.alias("paragraph"), F.get(x["paragraphs"], j)["leaves"].alias("a_leaves"), F.get(y["paragraphs"], j)["leaves"].alias("b_leaves")))

    differing = F.filter(span, lambda i: ~F.get(a, i)["digest"].eqNullSafe(F.get(b, i)["digest"]))
    return F.flatten(F.transform(differing, below))


def likeness(n: Column, branches: Column) -> Column:
    """Of two trees, from the first one's number of leaves and their edited branches, 0 to 1."""
    none = F.array().cast("array<string>")
    x, y = (F.flatten(F.transform(branches, lambda d: F.coalesce(d[side], none))) for side in ("a_leaves", "b_leaves"))
    alike, own, other = n - F.size(x), F.size(F.array_distinct(x)), F.size(F.array_distinct(y))
    most = alike + F.greatest(own, other)
    return F.when(most == 0, 1.0).otherwise((alike + F.size(F.array_intersect(x, y))) / most)


def next_texts(docs: DataFrame, bucket_rows: int = 4096, most_buckets: int = 20_000) -> DataFrame:
    """doc_id, text and next_text, the text of the next row by ascending doc_id. Ids are cut at approximate quantiles
    into buckets; a window within a bucket finds the next row, and a bucket's last row takes the first of the next bucket
    that has rows. Texts are shuffled once. Beyond most_buckets the buckets grow instead (each is sorted on disk)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, nulls = docs.agg(F.count("*"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    if not n:
        return docs.withColumn("next_text", F.col("text"))
    k = min(max(1, -(-n // bucket_rows)), most_buckets)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], max(1000, 2 * k))).first()[0] or []
    # An id at which several quantiles lie has many rows; these are cut further, by the hash that orders them.
    parts = Counter(cuts if k > 1 else [])
    cuts, times = sorted(parts), [parts[c] for c in sorted(parts)]
    # A bucket is the number of cuts at or below the id: first among every stride-th cut, then within that stride.
    stride = max(1, int(len(cuts) ** 0.5))
    all_cuts, some = F.array(*map(F.lit, cuts)).cast("array<bigint>"), F.array(*map(F.lit, cuts[stride - 1 :: stride])).cast("array<bigint>")
    coarse = docs.withColumn("_c", F.size(F.filter(some, lambda x: F.col("doc_id") >= x)) * stride)
    fine = F.size(F.filter(F.slice(all_cuts, F.col("_c") + 1, stride), lambda x: F.col("doc_id") >= x))
    placed = coarse.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_c") + fine)).drop("_c")
    tie = F.xxhash64("text")
    level = (F.shiftright(tie, 32) + F.lit(1 << 31)) / F.lit(float(1 << 32))  # of the hash, from 0 to below 1
    of_cut = F.get(F.array(*map(F.lit, times)).cast("array<bigint>"), F.col("bucket") - 1)
    part = F.when(F.col("doc_id").isNull(), F.floor(level * max(1, -(-nulls // bucket_rows)))).when(F.col("doc_id") == F.get(all_cuts, F.col("bucket") - 1), F.floor(level * of_cut)).otherwise(F.coalesce(of_cut, F.lit(0)))
    placed = placed.withColumn("part", part)
    at = ["bucket", "part"]
    firsts = placed.select(*at, F.col("doc_id").alias("_id"), tie.alias("_tie")).groupBy(*at).agg(F.min(F.struct(F.col("_id"), F.col("_tie"))).alias("f")).select(*at, "f._id", "f._tie")
    # One row for each bucket: few enough for one window, and to be broadcast (most_buckets bounds them).
    by_bucket = Window.orderBy(*at)
    whole = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = [F.when(F.lead("bucket").over(by_bucket).isNull(), F.first(c).over(whole)).otherwise(F.lead(c).over(by_bucket)).alias(c) for c in ("_id", "_tie")]
    over = firsts.select(*following, F.col("bucket").alias("_to"), F.col("part").alias("_to_part"))
    heads = docs.join(F.broadcast(over), F.col("doc_id").eqNullSafe(F.col("_id")) & (tie == F.col("_tie"))).groupBy("_to", "_to_part").agg(F.min("text").alias("_head"))
    w = Window.partitionBy(*at).orderBy("doc_id", tie)
    led = placed.select("doc_id", "text", *at, F.lead("text").over(w).alias("_next"))
    return led.join(heads, (F.col("bucket") == F.col("_to")) & (F.col("part") == F.col("_to_part")), "left").select("doc_id", "text", F.coalesce("_next", "_head").alias("next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its text with the last quarter replaced by the next text's beginning."""
    both = next_texts(docs)
    m = F.floor(F.length("text") / 4).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - m), F.substring(F.col("next_text"), F.lit(1), m)))
    trees = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[tree(F.col(c)).alias(t) for c, t in (("text", "t"), ("edited", "te"), ("next_text", "tn"))])
    compared = trees.select("doc_id", "n_chars", "edited_sha256", shown(F.col("t")).alias("fingerprint"), shown(F.col("te")).alias("edited_fingerprint"), n_leaves(F.col("t")).alias("n"), *[edited_branches(F.col("t"), F.col(c)).alias(d) for c, d in (("te", "de"), ("tn", "dn"))])
    return compared.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("n"), F.col("de")).alias("near_edited"), likeness(F.col("n"), F.col("dn")).alias("near_next"), F.size("de").cast("long").alias("n_edited_branches"))


def op7(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def _op7_sql() -> str:
    leaf = LEAF.replace("'", "''")

    def branches(name: str, text: str) -> str:
        """A row for each paragraph, with its full leaf digests, its own digest and the short ones."""
        return rf"""{name}0 AS (SELECT r, i, j, list_transform(regexp_extract_all(ps[j], '{leaf}'), lambda x: sha256(x)) AS l FROM
  (SELECT r, i, ps, unnest(range(1, len(ps) + 1)) AS j FROM (SELECT r, i, string_split(ss[i], chr(10)) AS ps FROM (SELECT r, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT r, string_split({text}, chr(10) || chr(10)) AS ss FROM e))))),
{name} AS (SELECT r, i, j, sha256(array_to_string(l, '')) AS d, list_transform(l, lambda x: x[1:{DIGITS}]) AS l FROM {name}0),
{name}s AS (SELECT r, i, sha256(string_agg(d, '' ORDER BY j)) AS d, string_agg(array_to_string(l, ''), '.' ORDER BY j) AS shown FROM {name} GROUP BY r, i),
{name}r AS (SELECT r, sha256(string_agg(d, '' ORDER BY i)) || ':' || string_agg(shown, '/' ORDER BY i) AS print FROM {name}s GROUP BY r)"""

    def near(name: str, other: str) -> str:
        return rf"""{name} AS (SELECT r, coalesce(sum(len(a)) FILTER (WHERE same), 0) AS alike, flatten(coalesce(list(a) FILTER (WHERE NOT same AND a IS NOT NULL), [])) AS x, flatten(coalesce(list(b) FILTER (WHERE NOT same AND b IS NOT NULL), [])) AS y, count(*) FILTER (WHERE NOT same) AS n
  FROM (SELECT coalesce(ta.r, tb.r) AS r, ta.l AS a, tb.l AS b, ta.d IS NOT DISTINCT FROM tb.d AS same FROM ta FULL JOIN {other} tb ON ta.r = tb.r AND ta.i = tb.i AND ta.j = tb.j) GROUP BY ALL)"""

    def like(q: str) -> str:
        most = f"({q}.alike + greatest(len(list_distinct({q}.x)), len(list_distinct({q}.y))))"
        return f"CASE WHEN {most} = 0 THEN 1e0 ELSE ({q}.alike + len(list_intersect({q}.x, {q}.y)))::DOUBLE / {most} END"

    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, row_number() OVER () AS r, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nxt FROM d),
e AS (SELECT *, text[1 : length(text) - length(text) // 4] || nxt[1 : length(text) // 4] AS edited FROM n),
{branches("ta", "text")}, {branches("tb", "edited")}, {branches("tc", "nxt")}, {near("pe", "tb")}, {near("pn", "tc")}
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, tar.print AS fingerprint, tbr.print AS edited_fingerprint, {like("pe")} AS near_edited, {like("pn")} AS near_next, pe.n::BIGINT AS n_edited_branches
FROM e JOIN tar USING (r) JOIN tbr USING (r) JOIN pe USING (r) JOIN pn USING (r)"""


OP7_SQL = _op7_sql()
