"""The operators against SQL, brute force and held-out labels."""

import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import entries, mixing, packing, quality, rules, simhash, toxicity

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_equals_sql(same, name):
    same(entries.QUERIES[name], entries.ORACLES[name])


def test_held_out_accuracy(spark):
    y = spark.read.parquet(f"{MORE}/labels.parquet").toPandas().set_index("doc_id")
    q = quality.op1(spark, MORE).toPandas()
    t = toxicity.op6(spark, MORE).toPandas()
    for out, label, least in ((q, "quality", 0.97), (t, "toxic", 0.85)):
        held = out[out.held_out & out.doc_id.isin(y.index)]
        assert (held.predicted == y[label].reindex(held.doc_id).to_numpy()).mean() >= least
        assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def naive_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Smallest index reachable over pairs at up to three bits."""
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    prints = [naive_print(r.text) for r in rows]
    want = {rows[i].doc_id: (f"{p:016x}", rows[k].doc_id) for i, (p, k) in enumerate(zip(prints, classes(prints), strict=True))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3(spark, SMALL).collect()} == want


def test_fingerprints_against_brute_force_on_more(spark):
    """All pairs of a thousand documents."""
    rows = spark.read.parquet(f"{MORE}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in simhash.op3(spark, MORE).collect()}
    at = {r.doc_id: i for i, r in enumerate(rows)}
    for r in rows[:200]:
        assert got[r.doc_id].fingerprint == f"{naive_print(r.text):016x}"
    bits = np.array([int(got[r.doc_id].fingerprint, 16) for r in rows], dtype=np.uint64)
    up = np.arange(len(rows))
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    while True:  # the least number that a link leads to, until none is less
        least = np.where(near, up[None, :], len(rows)).min(1)
        if (least == up).all():
            break
        up = least
    assert all(at[r.component_id] == up[at[d]] for d, r in got.items())


@pytest.mark.parametrize("crowded", [4000, 3])
def test_links_of_crowded_groups(spark, crowded):
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):  # chains and dense groups
            prints.append(p)
            for _ in range(rng.choice([1, 2, 3, 4])):
                p ^= 1 << rng.randrange(64)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    links = simhash.link_fingerprints(df, crowded=crowded).collect()
    at = {p: i for i, p in enumerate(prints)}
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        a, b = at[r.a % 2**64], at[r.b % 2**64]
        assert (prints[a] ^ prints[b]).bit_count() <= 3
        a, b = sorted((find(a), find(b)))
        up[b] = a
    assert [find(i) for i in range(len(prints))] == classes(prints)


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def against_brute_force(texts, found):
    """Pairs at 0.8 or more share a component; no document is in one without a text at 0.7 or more beside it; a component
    is named by its smallest id."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    best = dict.fromkeys(sets, 0.0)
    for a, b in itertools.combinations(sets, 2):
        if sets[a].isdisjoint(sets[b]):
            continue
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert j < 0.8 or found[a] == found[b], (a, b, j)
        if found[a] == found[b]:
            best[a], best[b] = max(best[a], j), max(best[b], j)
    groups: dict = {}
    for d, c in found.items():
        groups.setdefault(c, []).append(d)
    assert set(found) == set(texts) and all(min(g) == c for c, g in groups.items())
    assert all(best[d] >= 0.7 for g in groups.values() if len(g) > 1 for d in g)


def test_similar_documents(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    against_brute_force({r.doc_id: r.text for r in docs.collect()}, found)


def test_similar_documents_in_crowded_groups(spark):
    """Near copies of one text, in groups walked in chunks; a second family and loners beside them."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, family = [], [[word() for _ in range(200)] for _ in range(2)]
    for i in range(120):
        w = list(family[i % 2]) if i % 6 else [word() for _ in range(60)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "short one"), (204, "Short  ONE"), (205, "short two"), (1, rows[1][1])]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), crowded=8).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.component_id for r in got}
    assert [found[i] for i in range(200, 206)] == [200, 200, 200, 203, 203, 205]
    against_brute_force({i: t for i, t in rows if i < 200}, {i: c for i, c in found.items() if i < 200})


def test_star_shaped_family(spark):
    """Copies at 0.8 or more to one original, but hardly to each other, in groups of many blocks."""
    rng = random.Random(11)
    original = [f"o{i}" for i in range(400)]
    rows = [(500, " ".join(original))]
    for i in range(300):
        w = list(original)
        for at in rng.sample(range(2, 398), 8):
            w[at] = f"c{i}-{at}"
        rows.append((i, " ".join(w)))
    sets = {d: shingle_set(t) for d, t in rows}
    near = {d for d in sets if len(sets[d] & sets[500]) / len(sets[d] | sets[500]) >= 0.8}
    assert len(near) > 250
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), crowded=8).collect()}
    assert {found[d] for d in near} == {found[500]}


def test_similarity_is_exact(spark):
    """Of pairs of 100 shingles each that differ in the last words, those at 89/111 link and those at 88/112 do not."""
    rows = []
    for i in range(120):
        w = [f"p{i}w{n}" for n in range(104)]
        cut = 104 - (11 if i % 2 else 12)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:cut] + [f"q{i}w{n}" for n in range(cut, 104)]))]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(120) if (found[2 * i + 1] == 2 * i) != (i % 2 == 1)] == []


def test_unlinked_groups_stay_in_blocks(spark):
    """Members of a group that nothing links meet pair by pair, in tasks of bounded size; a root's own blocks don't meet."""
    members = [(0, 7, n, 30, n) for n in range(200)] + [(1, 9, n, 30, 1000 if n < 150 else n) for n in range(200)]
    rows = simhash.block_pairs(spark.createDataFrame(members, "t int, k long, node long, size long, root long").withColumn("fp", F.lit(0)), 20, 100_000).collect()
    tasks: dict = {}
    for r in rows:
        tasks.setdefault((r.t, r.i, r.j), []).append((r.node, r.root, r.side))
    assert max(map(len, tasks.values())) <= 80
    met: list = [set(), set()]
    for (t, i, j), held in tasks.items():
        met[t] |= {frozenset((a, b)) for (a, ra, sa), (b, rb, sb) in itertools.combinations(held, 2) if ra != rb and (i == j or sa != sb)}
    for t in (0, 1):
        roots = {n: r for g, _, n, _, r in members if g == t}
        assert met[t] == {frozenset(x) for x in itertools.combinations(roots, 2) if roots[x[0]] != roots[x[1]]}
    assert all(j >= 0 for t, _, j in tasks)


def test_pivots_lose_no_pair():
    """With and without the pivot table the links connect the same, and the table discards pairs of other families."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    families = [[word() for _ in range(150)] for _ in range(6)]
    nodes, prints, sets = [], [], []
    for i in range(240):
        w = list(families[i % 6])
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = word()
        h = np.unique(simhash.shingle_hashes([x.encode() for x in w], 5))
        nodes.append(i), prints.append(simhash.majority(h)), sets.append(h.tobytes())
    ids, bits, none = np.array(nodes), np.array(prints, dtype=np.uint64).view(np.int64), np.zeros(240, np.int64)
    tally: list = []

    def classes_of(wide, tally=None):
        up = list(range(240))
        for a, b in simhash.exact_links(ids, ids, none, bits, sets, 0.8, wide, tally):
            x, y = sorted((up[a], up[b]))
            up = [x if u == y else u for u in up]
        return up

    assert classes_of(simhash.WIDE, tally) == classes_of(64)
    asked, gone = np.array(tally).sum(0)
    assert gone > 0.5 * asked


def test_fit_against_gradient_descent():
    """Newton's weights against plain gradient descent on the same pairs, and a cut against its definition."""
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(120, len(quality.NAMES))))
    y = (x[:, 0] + x[:, 2] + rng.normal(size=120) > 1.4).astype(int)
    d, mean, scale = quality.pair_differences(x, y, 400, 0)
    w = np.zeros(d.shape[1])
    for _ in range(60_000):
        w -= 0.5 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + 1e-3 * w)
    got = quality.fit(x, y, pairs=400)
    assert np.abs(got.weights - w).max() < 1e-4 and (got.mean == mean).all() and (got.scale == scale).all()
    s = np.round(rng.normal(size=50), 1)
    values, n = np.unique(s, return_counts=True)
    for k in (1, 7, 49):
        assert quality.quantile_cut(values, n, k) == pytest.approx((np.sort(s)[k - 1] + np.sort(s)[k]) / 2)


def test_gradients_against_differences():
    """Every parameter of the network, and every distinct word's embedding, against numerical differences."""
    rng = np.random.default_rng(5)
    shape = (len(toxicity.WIDTHS), toxicity.FILTERS)
    net = toxicity.Cnn(np.zeros((1, toxicity.DIM)), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], rng.normal(size=shape), rng.normal(size=shape), 0.3)
    e, flat, sizes = rng.normal(size=(7, toxicity.DIM)), rng.integers(0, 7, 13), np.array([5, 0, 1, 7])
    y, weight = np.array([1, 0, 1, 0]), np.array([2.0, 1.0, 2.0, 1.0])

    def loss():
        z = np.tensordot(net.pooled(e, flat, sizes), net.out, 2) + net.out_bias
        return (weight * np.where(y == 1, np.log1p(np.exp(-z)), np.log1p(np.exp(z)))).mean()

    by_kernel, by_bias, by_out, by_out_bias, by_word = net.gradients(e, flat, sizes, y, weight)
    for x, g in ((*zip(net.kernels, by_kernel, strict=True), (net.bias, by_bias), (net.out, by_out), (e, by_word))):
        for at in np.ndindex(x.shape):
            old = x[at]
            x[at] = old + 1e-6
            up = loss()
            x[at] = old - 1e-6
            down = loss()
            x[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    net.out_bias += 1e-6
    up = loss()
    net.out_bias -= 2e-6
    assert by_out_bias == pytest.approx((up - loss()) / 2e-6, abs=1e-6)


def test_thresholds_against_brute_force():
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 3)), round(float(rng.normal()), 1), int(rng.integers(1, 4))) for _ in range(200)]
    found = {}
    for lang, logit, n in rows:
        a, b = found.get((lang, logit), (0, 0))
        found[(lang, logit)] = (a + n, b + int(rng.integers(0, n + 1)))
    got = toxicity.cuts([(*k, *v) for k, v in found.items()])
    for lang in range(3):
        own = {k[1]: v for k, v in found.items() if k[0] == lang}
        f1 = lambda c: 2 * sum(h for s, (_, h) in own.items() if s >= c) / (sum(n for s, (n, _) in own.items() if s >= c) + sum(h for _, h in own.values()))  # noqa: B023, E731
        assert f1(got[lang]) == pytest.approx(max(f1(c) for c in own))


def test_false_rejection_stays_under_the_risk(spark):
    """Cut-offs from half of the good rows, held against the other half: in each stratum no more than the risk goes."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.gauss(6, 1.2), abs(rng.gauss(0, 0.1)), abs(rng.gauss(0, 0.2)), abs(rng.gauss(0, 0.15))) for i in range(12_000)]
    f = spark.createDataFrame(rows, "doc_id long, lang string, m double, s double, l double, r double").select("doc_id", "lang", F.lit(1000).cast("long").alias("n_words"), (F.col("m") * 1000).cast("long").alias("word_chars"), (F.col("s") * 1000).cast("long").alias("n_symbols"), F.lit(100).cast("long").alias("n_lines"), (F.col("l") * 100).cast("long").alias("n_dup_lines"), (F.col("r") * 1000).cast("long").alias("n_repeat_words"))
    cuts = rules.cutoffs(f.where("doc_id % 2 = 0"), "lang", 0.04, 0.05)
    feature = rules._features()
    rejected = F.exists(F.array(*[F.coalesce(feature[r] > F.col(f"cut_{r}"), F.lit(False)) for r in rules.CANDIDATES]), lambda x: x)
    unseen = f.where("doc_id % 2 = 1").join(cuts, F.col("lang").eqNullSafe(F.col("_stratum"))).groupBy("lang").agg(F.avg(rejected.cast("int")).alias("share"), F.count("*").alias("n")).collect()
    assert len(unseen) == 3 and all(0 < r.share <= 0.04 for r in unseen)


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        n, cap, per = 60, 50, rng.choice([1, 2])
        items = sorted(((rng.randint(0, cap), rng.choice("aab"), rng.randrange(40)) for _ in range(n)), key=lambda x: -x[0])
        bins, offsets = packing.best_fit(*map(list, zip(*items, strict=True)), cap, per)
        held: list[list] = []
        for (size, source, cluster), got, offset in zip(items, bins, offsets, strict=True):
            fits = [(cap - sum(x[0] for x in b) - size, k) for k, b in enumerate(held) if cap - sum(x[0] for x in b) >= size and all(x[2] != cluster for x in b) and sum(x[1] == source for x in b) < per]
            want = min(fits)[1] if fits else len(held)
            assert got == want
            if not fits:
                held.append([])
            assert offset == sum(x[0] for x in held[want])
            held[want].append((size, source, cluster))


def test_packing_is_whole(spark):
    out = packing.op5(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    n = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == n
    assert out.groupby("bin_id").n_tokens.sum().max() <= 2048
    assert out.groupby(["bin_id", "source"]).size().max() <= 4 and out.groupby(["bin_id", "doc_id"]).size().max() == 1


def test_binomial_tail(spark):
    from math import comb

    for n, k, p in ((1, 0, 0.01), (100, 0, 0.01), (500, 3, 0.02), (2000, 10, 0.01), (50_000, 430, 0.01)):
        got = spark.range(1).select(rules.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first().x
        assert got == pytest.approx(float(sum(Fraction(comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))) if n < 50_000 else 0.0009196, rel=1e-9 if n < 50_000 else 0.5)


def test_exponent_meets_its_target(spark):
    s = spark.createDataFrame([(10,), (1000,), (100000,)], "tokens long")
    total, p = 101010, np.array([10, 1000, 100000]) / 101010
    a = mixing.exponent(s, 2.0, None, None)
    assert (p ** (a - 1)).max() / (p ** (a - 1)).min() == pytest.approx(2.0, rel=1e-9)
    a = mixing.exponent(s, None, 0.9, None)
    w = p**a / (p**a).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9, rel=1e-9)
    a = mixing.exponent(s, 3.0, None, total * 2)
    assert (p**a / (p**a).sum() * 2 / p).max() <= 3.0 + 1e-9


def test_mixing_meets_its_budget(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    out = mixing.mix(docs, repetition=3.0, budget=100_000, block_docs=8).toPandas()
    assert 0.9 * 100_000 < out.n_tokens.sum() <= 100_000 * 1.001
    assert not out.duplicated(["doc_id", "epoch"]).any()


def test_pipeline_stages(spark):
    """Each stage on its own input, against plain Python."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), rules.F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).where("toxic_predicted = 1").collect()}
    one = p.remove_toxic(spark, docs, SMALL)
    assert one.columns == p.COLUMNS
    rows = one.orderBy("doc_id").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - toxic
    two = p.remove_boilerplate(spark, one, SMALL)
    pages: dict = {}
    for r in rows:
        for x in {x.strip() for x in r.text.split("\n")} - {""}:
            pages[(r.source, x)] = pages.get((r.source, x), 0) + 1
    total = {s: sum(r.source == s for r in rows) for s in {r.source for r in rows}}
    gone = {k for k, n in pages.items() if n >= 5 and n > 0.05 * total[k[0]]}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x.strip()) not in gone) for r in rows}
    got = {r.doc_id: (r.text, r.n_chars) for r in two.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}
    three = p.remove_near_copies(spark, two, SMALL)
    ids = sorted(want)
    kept = [r.doc_id for r in three.collect()]
    assert len(kept) == len(set(kept))
    against_brute_force(want, {r.doc_id: r.component_id for r in simhash.similar_documents(two).collect()})
    assert set(kept) == {r.component_id for r in simhash.similar_documents(two).collect()} and set(kept) <= set(ids)
    four = p.mix_sources(spark, three, SMALL)
    assert four.columns == p.COLUMNS and {r.doc_id for r in four.collect()} == set(kept)
    five = p.pack_sequences(spark, four, SMALL).toPandas()
    assert five.groupby("bin_id").n_tokens.sum().max() <= 2048
    assert five[five.piece == 0].groupby("doc_id").size().to_dict() == four.toPandas().groupby("doc_id").size().to_dict()
