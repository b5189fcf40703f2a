"""Spelling variant grouping with forward and backward minimal acyclic automata.

Words are the distinct runs of letters over all documents, with their numbers of occurrences n. Two words are near if one
inserted, deleted or replaced code point makes one of the other. One error leaves either the front half of the shorter word
(of m code points, the first m // 2) as it is, or the back half. So each word goes to four groups: by its front half, as a
shorter word (m is its length) and as a longer one (m is one less), and the same by its back half. Words of shards of such
groups are compiled into minimal acyclic automata, for back halves of the words spelled backwards, in which the words are
numbered in order (a perfect hash: a word's number is the sum of what its transitions skip). Every shorter word of a shard
walks its half exactly and completes the rest with one error; the numbers it ends at are its near words. Pairs that both
directions find are one.

A half that very many words share is dealt to blocks of ``shard_words`` words, an automaton each, and every word of that half
asks all of its blocks; halves depend on a word's length, so that a common prefix alone isn't such a group.

A word's form is its near word of largest n (ties: the smallest in code-point order), if that is ``ratio`` times the word's n
or more; its root is the last of its forms' forms, found by doubling. As n grows by the ratio each time, chains are short.

Defined cases: null and empty texts have no words; a null doc_id counts as empty text where typing errors are made; repeated
rows count as often as they stand; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import attached, drop_written, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def typed(doc_id: Column, run: Column, every: int) -> Column:
    """A run as it is typed: of those whose hash ``every`` divides, one code point is left out."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """word and n of the words of at least ``shortest`` code points that occur ``least`` times."""
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0))
    each = docs.select(F.col("doc_id").alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = each.select(typed(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, built word by word (Daciuk et al., Incremental Construction
    of Minimal Acyclic Finite-State Automata, 2000). A transition holds its target and how many words it skips."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path = [0]  # the states of the word before that may still change
        before = ""

        def settle(depth: int) -> None:
            """States below depth of the word before are done: each becomes an equal one, if there is one."""
            while len(path) > depth + 1:
                state = path.pop()
                mark = (self.final[state], *self.edges[state].items())
                same = known.setdefault(mark, state)
                if same != state:
                    self.edges[path[-1]][before[len(path) - 1]] = same
                    if state == len(self.edges) - 1:
                        self.edges.pop()
                        self.final.pop()

        for word in words:
            common = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                common += 1
            settle(common)
            for c in word[common:]:
                self.edges[path[-1]][c] = len(self.edges)
                path.append(len(self.edges))
                self.edges.append({})
                self.final.append(False)
            self.final[path[-1]] = True
            before = word
        settle(0)
        self._number()

    def _number(self) -> None:
        """How many words every state leads to, deepest first, and what each transition skips."""
        sizes: dict[int, int] = {}
        todo = [(0, False)]
        while todo:
            state, ready = todo.pop()
            if ready:
                total = int(self.final[state])
                for c, to in self.edges[state].items():
                    self.edges[state][c] = (to, total)
                    total += sizes[to]
                sizes[state] = total
            elif state not in sizes:
                sizes[state] = 0
                todo.append((state, True))
                todo += [(to, False) for to in self.edges[state].values() if to not in sizes]

    def walk(self, state: int, number: int, rest: str) -> tuple[int, int] | None:
        edges = self.edges
        for c in rest:
            step = edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with word[:half] and whose rest is one replaced or inserted sign away."""
        begin = self.walk(0, 0, word[:half])
        if begin is None:
            return set()
        (state, number), edges, final, out = begin, self.edges, self.final, set()
        for at in range(half, len(word) + 1):
            own = word[at] if at < len(word) else None
            own_rest, next_rest = word[at:], word[at + 1 :]
            for c, (to, skipped) in edges[state].items():
                further = edges[to]
                if own is not None and c != own and (not next_rest or next_rest[0] in further):
                    end = self.walk(to, number + skipped, next_rest)
                    if end and final[end[0]]:
                        out.add(end[1])
                if own is None or own in further:
                    end = self.walk(to, number + skipped, own_rest)
                    if end and final[end[0]]:
                        out.add(end[1])
            if own is None or own not in edges[state]:
                break
            state, skipped = edges[state][own]
            number += skipped
        return out


def grouped(words: DataFrame) -> DataFrame:
    """word, n, back (whether by back halves), m, half and asks (whether it is a shorter word there): four rows a word."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(*[F.struct(F.lit(back).alias("back"), F.lit(asks).alias("asks"), (size - (0 if asks else 1)).alias("m")) for back in (False, True) for asks in (True, False)])).alias("g"))
    m = F.col("g.m")
    front = F.floor(m / 2).cast("int")
    half = F.when(F.col("g.back"), F.substring("word", -(m - front), m - front)).otherwise(F.substring("word", F.lit(1), front))
    return rows.select("word", "n", "g.back", "g.m", half.alias("half"), "g.asks")


def near_words(words: DataFrame, shard_words: int = 20_000) -> DataFrame:
    """a, a_n, b, b_n of every two words (word, n; each word once) that are near, each pair once, a the smaller."""
    rows = written(grouped(words))
    total = rows.count()
    shards = max(1, -(-total // shard_words))
    sizes = written(rows.groupBy("back", "m", "half").agg(F.ceil(F.count("*") / shard_words).alias("blocks")).where("blocks > 1"))
    keys = ["back", "m", "half"]
    by_hash = F.pmod(F.xxhash64(*keys), F.lit(shards))
    columns = ["shard", "back", "m", "word", "n", "asks", "holds"]
    if sizes.isEmpty():
        dealt = rows.select(by_hash.alias("shard"), *columns[1:-1], F.lit(True).alias("holds"))
    else:
        # Of a half's blocks a word is held by one and, if it is a shorter one, asks all.
        hot = sizes.where(F.col("blocks") > F.lit(total / 1000 / shard_words))
        large = attached(rows, sizes, hot, *keys)
        own = F.pmod(F.xxhash64("word"), F.col("blocks"))
        every = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own)))
        large = large.select("*", own.alias("own"), every.alias("block")).select((-1 - F.pmod(F.xxhash64(*keys, "block"), F.lit((1 << 62) - 1))).alias("shard"), *columns[1:-1], (F.col("block") == F.col("own")).alias("holds"))
        dealt = rows.join(sizes.select(*keys), keys, "left_anti").select(by_hash.alias("shard"), *columns[1:-1], F.lit(True).alias("holds")).unionByName(large)

    names = ["a", "a_n", "b", "b_n"]

    def found(held: dict[bool, tuple[dict, list]]) -> Iterator[pa.RecordBatch]:
        for back, (own, asked) in held.items():
            spelled = sorted((w[::-1], n) for w, n in own.items()) if back else sorted(own.items())
            automaton = Automaton([w for w, _ in spelled])
            pairs = []
            for word, n in asked:
                half = len(word) // 2
                told = automaton.near(word[::-1], len(word) - half) if back else automaton.near(word, half)
                for number in told:
                    other, other_n = spelled[number]
                    other = other[::-1] if back else other
                    if len(other) > len(word) or word < other:  # of equal length, the other asks too
                        pairs.append((word, n, other, other_n) if word < other else (other, other_n, word, n))
            for at in range(0, len(pairs), 10_000):
                cols = list(zip(*pairs[at : at + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64()) * 2, strict=True)], names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard."""
        held: dict[bool, tuple[dict, list]] = {}
        now = None
        for batch in it:
            for shard, back, word, n, asks, holds in zip(*(batch.column(c).to_pylist() for c in ("shard", "back", "word", "n", "asks", "holds")), strict=True):
                if shard != now:
                    yield from found(held)
                    held, now = {}, shard
                own, asked = held.setdefault(back, ({}, []))
                if holds:
                    own[word] = n
                if asks:
                    asked.append((word, n))
        yield from found(held)

    pairs = dealt.select(*columns).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a string, a_n long, b string, b_n long")
    out = written(pairs.distinct())
    for t in (rows, sizes):
        drop_written(t)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root of all that have a form (word, form)."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("then"))
        new = written(now.join(further, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")))
        drop_written(now)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(docs: DataFrame, ratio: int = 5, **options) -> DataFrame:
    """word, n, form, form_n, n_near and root of every word."""
    words = written(counted(docs, **options))
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("near")).alias("x")).unionAll(pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("near")).alias("x")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("x").alias("x"))
    fits = -F.col("x.n") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.when(fits, F.col("x.near")).alias("form"), F.when(fits, -F.col("x.n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    rows = written(rows)
    for t in (words, pairs):
        drop_written(t)
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: CRC-32 bit by bit: 3988292384 is its polynomial, reversed.
OP11_SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
q AS (SELECT doc_id, w, count(*) AS k, string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, '') AS cs FROM r WHERE length(w) >= 6 GROUP BY doc_id, w),
b AS (SELECT w, k, flatten(list_transform(flatten(list_transform(cs, lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)), lambda x: [x, 0, 0, 0, 0, 0, 0, 0])) AS bits FROM q),
h AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, v: xor(xor(c, v) >> 1, 3988292384::BIGINT * (xor(c, v) & 1))), 4294967295) AS h FROM b),
t AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
m AS (SELECT word, n, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS x, substr(word, 1, i - 1) || substr(word, i + 1) AS y FROM i),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM m a JOIN m b ON a.x = b.x AND a.word <> b.word
  UNION SELECT m.word, v.word, v.n FROM m JOIN v ON m.y = v.word UNION SELECT v.word, m.word, m.n FROM m JOIN v ON m.y = v.word),
f AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -near_n, near := near)) AS best FROM p GROUP BY word),
o AS MATERIALIZED (SELECT v.word, v.n, CASE WHEN -best.n >= 5 * v.n THEN best.near END AS form, CASE WHEN -best.n >= 5 * v.n THEN -best.n END AS form_n, coalesce(n_near, 0) AS n_near FROM v LEFT JOIN f USING (word)),
c AS (SELECT word, word AS at, form FROM o UNION ALL SELECT c.word, o.word, o.form FROM c JOIN o ON c.form = o.word)
SELECT o.word, o.form, c.at AS root, o.n, o.n_near, o.form_n FROM o JOIN c ON c.word = o.word AND c.form IS NULL
"""
