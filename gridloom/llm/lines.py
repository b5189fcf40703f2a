"""Line dedup by site-relative frequency.

A line (surrounding ASCII white space trimmed, blank ones left aside) counts once for each page that holds it. Its count
divided by the host's number of pages is its ratio; lines above ``ratio`` on at least ``min_pages`` pages are
boilerplate of that host and are dropped from its pages, wherever they stand.

The host is a column or an expression: host_of() takes it from an address. A host's boilerplate set is joined to its
pages; it is small, as at most 1 / ratio lines of average page length can be boilerplate of a host.

Defined cases: a null text stays null and an empty one empty; both count as pages of their host; a null host is a host
of its own; repeated rows are pages each; a page all of whose lines go stays, with an empty text; a page on which
nothing goes keeps its text byte by byte; extra columns stay as they are, but n_lines_dropped is replaced; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE_CHARS, column, fresh, table, written

#: Rows of the boilerplate table up to which it is broadcast. Beyond, only the sets of hosts with over a thousandth of all
#: pages are (a thousand hosts at most), so their pages stay in place; the other hosts' pages are shuffled.
BROADCAST_ROWS = 20_000


def _print(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACE_CHARS)))


def host_of(url: Column) -> Column:
    """The lower-case host of an address, null if it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, print) of the boilerplate lines of pages (host, text). Counts are summed on the map side, so a host or a line
    with a third of all rows sends one row a task."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    each = pages.select("host", F.explode(F.array_distinct(F.transform(lines, _print))).alias("print"))
    counts = each.groupBy("host", "print").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("pages"))
    return counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > ratio * F.col("pages")).select("host", "print")


def drop_boilerplate(docs: DataFrame, host: str | Column = "source", ratio: float = 0.05, min_pages: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with cleaned text and n_lines_dropped."""
    docs = docs.drop("n_lines_dropped")
    own = docs.columns
    at, prints, kept, of, big_of = fresh(docs, "host", "prints", "kept", "of", "big_of")
    pages = docs.withColumn(at, column(host) if isinstance(host, str) else host)
    found = written(boilerplate(pages.select(F.col(at).alias("host"), "text"), ratio, min_pages))
    by_host = found.groupBy(F.col("host").alias(of)).agg(F.collect_list("print").alias(prints))
    match = F.col(at).eqNullSafe(F.col(of))
    if found.count() <= broadcast_rows:
        joined = pages.join(F.broadcast(by_host), match, "left")
    else:
        n = pages.groupBy(F.col(at).alias(big_of)).agg(F.count("*").alias("n_pages"))
        big = written(n.where(F.col("n_pages") > pages.count() / 1000).select(big_of))
        is_big = F.col(at).eqNullSafe(F.col(big_of))
        of_big = by_host.join(F.broadcast(big), F.col(of).eqNullSafe(F.col(big_of)), "left_semi")
        joined = pages.join(F.broadcast(big), is_big, "left_semi").join(F.broadcast(of_big), match, "left")
        joined = joined.unionAll(pages.join(F.broadcast(big), is_big, "left_anti").join(by_host, match, "left"))
    lines = F.split("text", "\n")
    stays = F.filter(lines, lambda x: ~F.array_contains(prints, _print(x)) | (F.btrim(x, F.lit(SPACE_CHARS)) == ""))
    cut = joined.select(*map(column, own), F.when(F.col(prints).isNotNull() & F.col("text").isNotNull(), stays).alias(kept))
    dropped = F.when(F.col(kept).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    text = F.when(dropped > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text")
    return cut.select(*[text if c == "text" else column(c) for c in own], dropped.alias("n_lines_dropped"))


def op4(spark, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines_dropped")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT DISTINCT r, source, trim(u, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT r, source, unnest(ls) AS u FROM d)),
k AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
b AS (SELECT k.source AS host, list(line) AS lines FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WHERE n >= 5 AND n > 0.05e0 * pages GROUP BY ALL),
c AS (SELECT d.*, CASE WHEN b.lines IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(b.lines, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) END AS kept
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.host)
SELECT doc_id, source, CASE WHEN len(kept) < len(ls) THEN array_to_string(kept, chr(10)) ELSE text END AS text,
  coalesce(len(ls) - len(kept), 0)::BIGINT AS n_lines_dropped FROM c
"""
