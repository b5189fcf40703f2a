"""Chat formatting of reply trees.

Messages are nodes with a parent; a node whose parent is missing is a root. Iterative self-joins enumerate the paths:
each round joins the table of jumps with itself, so that a jump spans twice as many replies, and extends every leaf's
list of ancestors by it; a path of d messages takes log2(d) rounds. Paths of a conversation are ranked by the mean score
of their messages (ties: the smaller leaf), and the best ``branches`` are formatted, each as one conversation.

Template: ``<|turn|>role\\ntext<|end|>`` for each turn. In texts and roles ``&``, ``<`` and ``[`` become ``&amp;``, ``&lt;`` and
``&#91;`` (in roles also a line feed ``&#10;``), so that no control string of this or another template that begins with
one of them survives inside a text; unescape() reverses it. loss_spans tells where the formatted string has assistant
texts (0-based code point, length).

Defined cases: null texts and roles are empty, null scores 0; rows that repeat a conversation's node keep the smallest
role and text; nodes whose ancestors form a cycle belong to no path; a null conversation is one of its own, rows of null
node are left out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.llm.common import drop_written, table, written

TURN, END = "<|turn|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def paths(nodes: DataFrame) -> DataFrame:
    """(conv, leaf, node, up) of every leaf and each of its ancestors, itself included, ``up`` replies above. nodes has
    conv, node and parent, one row for each conv and node, parent null at roots. Only ids are joined."""
    leaf = nodes.join(nodes.select(F.col("conv").alias("c"), F.col("parent").alias("p")), F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti")
    found = written(leaf.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    jumps = written(nodes.where("parent is not null").select("conv", "node", F.col("parent").alias("to")))
    span, most = 1, None
    while not jumps.isEmpty():
        if most is None:
            most = nodes.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if span > most:  # longer than any path: these nodes lead into a cycle
            endless = jumps.select(F.col("conv").alias("c"), F.col("node").alias("n"))
            return found.join(endless, F.col("conv").eqNullSafe(F.col("c")) & (F.col("leaf") == F.col("n")), "left_anti")
        j = jumps.select(F.col("conv").alias("c"), F.col("node").alias("n"), "to")
        further = found.join(j, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv", "leaf", F.col("to").alias("node"), (F.col("up") + span).alias("up"))
        new_found = written(found.unionAll(further))
        new_jumps = written(jumps.join(j.select("c", "n", F.col("to").alias("beyond")), F.col("conv").eqNullSafe(F.col("c")) & (F.col("to") == F.col("n"))).select("conv", "node", F.col("beyond").alias("to")))
        drop_written(found)
        drop_written(jumps)
        found, jumps, span = new_found, new_jumps, 2 * span
    return found


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """conv_id, leaf, rank (from 1), score, formatted and loss_spans of each chosen path. messages has conv_id, node_id,
    parent_id (longs), role, text and score."""
    text = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    one = messages.where("node_id is not null").groupBy(F.col("conv_id").alias("conv"), F.col("node_id").alias("node")).agg(F.min(text).alias("m"))
    one = written(one.select("conv", "node", F.col("m.parent_id").alias("parent"), F.col("m.role").alias("role"), F.col("m.text").alias("text"), F.col("m.score").alias("score")))
    there = one.select(F.col("conv").alias("c"), F.col("node").alias("n"))
    linked = one.select("conv", "node", "parent").join(there, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n")), "left").select("conv", "node", F.col("n").alias("parent"))
    found = paths(linked)
    body = one.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text", "score")
    ranked = found
    if branches is not None:
        scored = found.join(body.select("c", "n", "score"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).groupBy("conv", "leaf").agg(F.avg("score").alias("s"))
        best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("s"), "leaf"))).where(F.col("rank") <= branches)
        ranked = found.join(best.select(F.col("conv").alias("bc"), F.col("leaf").alias("bl")), F.col("conv").eqNullSafe(F.col("bc")) & (F.col("leaf") == F.col("bl")), "left_semi")
    rows = ranked.join(body, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv", "leaf", "up", "role", "score", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    before = Window.partitionBy("conv", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    turn = F.struct((-F.col("up")).alias("o"), F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"))).alias("loss"))
    whole = placed.groupBy("conv", "leaf").agg(F.avg("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv", "leaf", "score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x.isNotNull()).alias("loss_spans"))
    return whole.select(F.col("conv").alias("conv_id"), "leaf", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")).alias("rank"), "score", "formatted", "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """turns (role, text) and loss_text, from the formatted string and loss_spans alone."""
    parts = F.filter(F.split("formatted", "<\\|end\\|>"), lambda x: x != "")
    inner = F.transform(parts, lambda x: F.substring(x, len(TURN) + 1, 1 << 30))
    cut = formatted.withColumn("_in", inner)
    return cut.withColumns({
        "turns": F.expr("transform(_in, x -> struct(substring_index(x, '\n', 1) as role, substring(x, instr(x, '\n') + 1) as text))"),
        "loss_text": F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""),
    }).withColumn("turns", F.transform("turns", lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))).drop("_in")


def op2(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    chain = rows.unionAll(own).withColumn("node_id", n).select("conv_id", "node_id", (F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
    out = read_back(format_trees(chain))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(a, b, c, d)),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS te,
  replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS re FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>' || re || chr(10) || te || '<|end|>'))::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""
