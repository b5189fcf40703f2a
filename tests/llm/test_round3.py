"""Spelling variants, repeated phrases and sort-means: SQL, brute force, odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import phrases, sortmeans, spelling
from gridloom.llm.entries import ORACLES, QUERIES

ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, " ".join(f"w{i % 997}x{i % 31}" for i in range(3000))), (5, "one"), (6, "the same text of many words " * 9), (6, "the same text of many words " * 9),
    (7, "the same text\x0bof many words " * 7), (None, "no id " + "here and there " * 12), (9, None), (6, "another text of id six " * 8), (10, "a\x1cb   \x85 " * 12), (-4, "w1x1 " + " ".join(f"w{i % 997}x{i % 31}" for i in range(40, 90))),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in ("key", "th", "place", "block", "anchor", "n", "word", "run", "own_id", "a`b"):
        d = d.withColumn(c, F.lit("x"))
    return d


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("op11_", "op12_", "op13_"))])
def test_against_sql(same, name):
    same(QUERIES[name], ORACLES[name])


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def plain_drop(rows, window):
    """rows: (id, text), distinct."""
    order = sorted(range(len(rows)), key=lambda r: rows[r][2])
    first, gone = {}, {}
    for r in order:
        ws = split(rows[r][1])
        goes = set()
        for a in range(len(ws) - window + 1):
            if tuple(ws[a : a + window]) in first:
                goes |= set(range(a, a + window))
            else:
                first[tuple(ws[a : a + window])] = r
        gone[r] = (len(ws), len(goes), " ".join(w for k, w in enumerate(ws) if k not in goes))
    return gone


def by_brute_force(spark, d, window=20, **options):
    rows = [tuple(r) for r in phrases._key(d).select("own_id", "text", "doc_id", "th").collect()]
    distinct = sorted({(i, t, (p, th)) for i, t, p, th in rows}, key=lambda x: x[2])
    told = {(distinct[k][0], distinct[k][1]): v for k, v in plain_drop(distinct, window).items()}
    want = sorted(((i, *told[(i, t)]) for i, t, _, _ in rows), key=str)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in phrases.drop_repeats(d, window, **options).collect()), key=str)
    assert got == want
    return got


def test_phrases_of_odd_rows(spark, docs):
    got = by_brute_force(spark, docs)
    assert sum(g[2] for g in got) > 200 and len(got) == len(ROWS)
    assert phrases.drop_repeats(docs.limit(0)).count() == 0
    assert {r.n_removed for r in phrases.drop_repeats(docs.where("doc_id in (1, 2, 5)")).collect()} == {0}


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_of_few_words(spark, seed):
    """Texts of very few different words, so that windows recur everywhere, cross and overlap; several blocks."""
    rng = random.Random(seed)
    pool = [[rng.choice("abc") for _ in range(rng.randrange(4, 40))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = sum((rng.choice(pool) if rng.random() < 0.5 else [rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(rng.randrange(5))), [])
        rows.append((rng.randrange(-100, 100), " ".join(words)))
    by_brute_force(spark, spark.createDataFrame(rows, "doc_id long, text string"), window=8, anchor=3, block_words=500)


def test_phrases_of_a_hot_passage(spark):
    """One passage stands in all documents, amid words of their own."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"x{i}y{j}" for j in range(i % 30)) + f" {passage} " + " ".join(f"z{i}y{j}" for j in range(i % 7))) for i in range(1500)]
    got = by_brute_force(spark, spark.createDataFrame(rows, "doc_id long, text string"), block_words=2000)
    assert sum(g[2] for g in got) == 30 * 1499


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:])


@pytest.mark.parametrize("shard", [20_000, 40])
def test_near_words_against_all_pairs(spark, shard):
    """Also with halves that many words share, in blocks."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(400)} | {"aaaabb" + "".join(rng.choice("cde") for _ in range(rng.randrange(3, 6))) for _ in range(300)}
    rows = [(w, rng.randrange(5, 500)) for w in sorted(words)]
    n = dict(rows)
    got = spelling.near_words(spark.createDataFrame(rows, "word string, n long"), shard).collect()
    want = {(a, b) for a in words for b in words if a < b and one_error(a, b)}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want and all((r.a_n, r.b_n) == (n[r.a], n[r.b]) for r in got)


def test_automaton_numbers_words_in_order():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(500)})
    a = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = a.walk(0, 0, w)
        assert number == k and a.final[state]
    assert len({(f, *((c, t) for c, (t, _) in e.items())) for f, e in zip(a.final, a.edges, strict=True)}) == len(a.edges)  # no two states are equal
    for w in words[::7]:
        for half in (len(w) // 2, 0):
            assert {words[x] for x in a.near(w, half)} == {v for v in words if v[:half] == w[:half] and len(v) >= len(w) and one_error(w, v) and (one_error(w[half:], v[half:]))}


def test_variants_of_odd_rows(spark, docs):
    assert spelling.variants(docs.limit(0)).count() == 0
    word = "OversÉtting"
    rows = [(i, f"{word} 12{word}x") for i in range(400)] + [(None, f"{word}.{word}")] * 3 + [(1, None), (2, ""), (3, "short ones")]
    want = {}
    for i, t in rows:
        for run in [word, word + "x"] if t and "12" in t else [word] * 2 if t and word in t else []:
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            want[run] = want.get(run, 0) + 1
    got = {r.word: r.n for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect()}
    assert got == want and len(want) > 3


def test_roots_follow_forms_to_the_last(spark):
    n = 40
    rows = [(f"w{i:02}", f"w{i + 1:02}") for i in range(n)] + [(f"x{i}", "w00") for i in range(30)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {w: f"w{n:02}" for w, _ in rows}


def plain_kmeans(rows, k, rounds):
    kept = [(i, [int(np.floor(64.0 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    for step in range(rounds + 1):
        near = [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, at) in zip(kept, near, strict=True) if at == j]
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else centroids[j]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, near, strict=True)), key=str), centroids


def test_sort_means_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(7)
    rows = [(i, [rng.choice([0.0, 0.25, -1.0, rng.gauss(0, 2)]) for _ in range(4)]) for i in range(300)]
    rows += [(1, [1.0] * 4), (1, [2.0] * 4), (None, [0.5] * 4), (None, [0.5] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]), (903, [nan] * 4), (904, [inf] * 4), (905, [3.0, -0.0, 1.0, 1e4])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("vector", F.lit(1))
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    for k in (1, 7):
        out, centroids = sortmeans.sort_means(d, k=k, dims=4)
        want, plain = plain_kmeans(rows, k, 3)
        assert sorted(map(tuple, out.collect()), key=str) == want and centroids.tolist() == plain
    report = sortmeans.cluster_report(d, k=7, dims=4).collect()
    assert {r.inertia for r in report} == {sum(w[2] for w in want)} and len(report) == len(want)
    assert sortmeans.cluster_report(d.limit(0), dims=4).count() == 0
    assert len(sortmeans.cluster_report(d.where("vec_id < 3"), k=16, dims=4).collect()) == 5


def test_sort_means_of_huge_vectors(spark):
    """Components beyond 64 bits: exact clusters, distances at a long's largest."""
    rows = [(i, [1e30 * (i % 3), 3e38 * (i % 2), float(i), 1e20]) for i in range(30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    out, centroids = sortmeans.sort_means(d, k=5, dims=4)
    want, plain = plain_kmeans(rows, 5, 3)
    assert centroids.tolist() == plain
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, c, min(x, 2**63 - 1)) for i, c, x in want), key=str)


def test_sort_means_asks_for_few_distances():
    """Centroids far apart: most vectors look at their own only."""
    rng = np.random.default_rng(8)
    centroids = rng.integers(-100_000, 100_000, (16, 8))
    before = rng.integers(0, 16, 2000)
    q = centroids[before] + rng.integers(-50, 50, (2000, 8))
    cluster, _, asked = sortmeans.assign(q, before, centroids)
    assert (cluster == before).all() and asked == 2000
