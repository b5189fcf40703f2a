"""Every operator over nulls, empty and long texts, ties, repeated rows, clashing columns, and empty tables."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, lines, merkle, mixing, packing, quality, rules, simhash, toxicity, warc

LONG = " ".join(f"w{i % 9973}x{i % 31}" for i in range(40_000))
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n", None, "a", 3), (4, LONG, "fr", None, len(LONG)), (5, "one", "en", None, 3),
    (6, "the same text\nof two lines", "en", "a", 26), (6, "the same text\nof two lines", "en", "a", 26), (7, "the same text\nof two lines", "de", "b", 26),
    (None, "no id here", "en", "b", 10), (9, None, None, None, None), (10, "<|end|></s>[INST] & é 漢字 \U0001f600", "es", "b", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, one with a back-tick, and (below) a column that can't be compared.
CLASH = [
    "score", "predicted", "label", "fp", "n", "k", "n_tokens", "block", "bucket", "pages", "root", "component_id", "n_lines_dropped", "toxic_score", "epoch", "kept", "host", "prints", "_host", "_prints", "_kept",
    "_of", "_n", "_big", "of", "plan", "deal", "doc_key", "s", "_source", "_whole", "_rest", "_blocks", "_from", "_block", "_upto", "key", "row", "logit", "lang_no", "part", "_c", "_next", "_head", "first", "node", "a`b", "with space", "c.d",
]
#: What an operator replaces of a table's own columns.
REPLACED = {"lines": {"n_lines_dropped"}, "toxicity": {"toxic_score"}, "mixing": {"n_tokens", "epoch", "block", "doc_key"}, "mixing_entropy": {"n_tokens", "epoch", "block", "doc_key"}, "keep_first": set()}
LABELS = [(1, 1, 0), (2, 0, 0), (6, 1, 1), (6, 1, 1), (7, 0, 1), (4, 1, None), (None, 1, 1), (10, 0, 0), (10, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        d = d.withColumn(c, F.lit("x"))
    return d.withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))


OPS = {
    "quality": lambda d, y: quality.score_quality(d, y, F.lit(True)),
    "simhash": lambda d, y: simhash.near_duplicates(d),
    "keep_first": lambda d, y: simhash.keep_first(d),
    "lines": lambda d, y: lines.drop_boilerplate(d, min_pages=2),
    "packing": lambda d, y: packing.pack(d, capacity=100),
    "toxicity": lambda d, y: toxicity.score_toxicity(d, y, F.lit(True)),
    "merkle": lambda d, y: merkle.fingerprint_edits(d),
    "rules": lambda d, y: rules.apply_rules(d, y),
    "mixing": lambda d, y: mixing.mix(d),
    "mixing_entropy": lambda d, y: mixing.mix(d, repetition=None, entropy=0.5),
}
IDS = sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(docs, labels, name):
    """Every row comes out, but for operators that cut or draw documents, and keeps its own columns."""
    out = OPS[name](docs, labels).collect()
    ids = sorted((r.doc_id for r in out), key=str)
    if name == "keep_first":
        assert ids == sorted([1, 4, 5, 6, 10, None], key=str)
    elif name == "packing":
        words = {i: len((t or "").split(" ")) for i, t in ((4, LONG), (None, "no id here"))}
        assert sum(r.n_tokens for r in out if r.doc_id == 4) == words[4] and set(ids) == set(IDS) and len(out) == len(ROWS) + -(-words[4] // 100) - 1
        assert {(r.n_tokens, r.bin_offset is not None) for r in out if r.doc_id in (1, 2, 3, 9)} == {(0, True)}
    elif name.startswith("mixing"):
        assert sorted((r.doc_id for r in out if r.epoch == 1), key=str) == IDS
        assert {(r.doc_id, r.source, r.n_tokens) for r in out if r.epoch == 1} >= {(1, "a", 0), (4, None, 40_000), (6, "a", 6), (7, "b", 6), (None, "b", 3)}
    else:
        assert ids == IDS
    for r in out if name in REPLACED else []:
        own = r.asDict()
        assert all(own[c] == "x" for c in CLASH if c not in REPLACED[name]) and own["tags"] == {"a": 1}
        assert (own["text"], own["lang"], own["source"], own["n_chars"]) in {x[1:] for x in ROWS} or name == "lines"


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(docs, labels, name):
    assert OPS[name](docs.limit(0), labels).count() == 0
    if name not in ("keep_first", "packing"):
        got = OPS[name](docs.where("doc_id in (1, 2, 5, 7)"), labels.limit(0)).collect()
        assert {r.doc_id for r in got} == {1, 2, 5, 7}


def test_scores_without_labels(docs, labels):
    assert {r.score for r in quality.score_quality(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert {r.toxic_score for r in toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}


def test_simhash_components(docs):
    out = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (9, 1), (6, 6), (7, 6)} <= out
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 4, 5, 6, 10, None], key=str)


def test_lines(docs):
    out = {(r.doc_id, r.lang): (r.text, r.n_lines_dropped) for r in lines.drop_boilerplate(docs, min_pages=2).collect()}
    assert out == {(r.doc_id, r.lang): (r.text, r.n_lines_dropped) for r in lines.drop_boilerplate(docs, min_pages=2, broadcast_rows=0).collect()}
    assert out[(6, "en")] == ("", 2)
    assert out[(7, "de")] == ("the same text\nof two lines", 0)
    assert out[(1, "en")] == (None, 0)
    assert out[(2, "en")] == ("", 0)


def test_lines_by_the_host_of_an_address(spark):
    rows = [(i, f"https://{'A' if i % 2 else 'a'}.example/{i}", f"menu\ntext {i}") for i in range(6)] + [(6, "https://b.example/", "menu\nx"), (7, "no address", "menu"), (8, None, "menu")]
    out = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, url string, text string"), lines.host_of(F.col("url")), 0.5, 5).collect()
    assert {r.doc_id: r.text for r in out} == {i: f"text {i}" for i in range(6)} | {6: "menu\nx", 7: "menu", 8: "menu"}


def test_mixing_targets_out_of_reach(docs):
    with pytest.raises(ValueError, match="entropy"):
        mixing.mix(docs, repetition=None, entropy=5.0)
    with pytest.raises(ValueError, match="repetition"):
        mixing.mix(docs, repetition=1.5, budget=100_000)


def test_mixing_draws_everything_once(docs):
    out = mixing.mix(docs)
    assert sorted((r.doc_id for r in out.where("epoch = 1").collect()), key=str) == sorted((r[0] for r in ROWS), key=str)


def test_merkle(docs):
    out = {r.doc_id: r for r in merkle.fingerprint_edits(docs).collect()}
    assert out[6].fingerprint == out[7].fingerprint
    assert out[1].fingerprint == out[2].fingerprint
    assert out[1].near_next == 1.0 and out[5].n_chars == 3 and out[9].near_next == 0.0
    assert out[4].near_edited > 0.7


def test_chat(spark):
    rows = [(1, 1, None, "user", "a", 1.0), (1, 2, 1, "assistant", None, None), (1, 2, 1, "assistant", None, None), (1, 3, 1, None, "x\ny", 3.0), (None, 1, None, "user", "z", 0.0), (2, 5, 6, "user", "c", 0.0), (2, 6, 5, "user", "c", 0.0), (2, 7, 6, "user", "c", 0.0), (3, 1, 99, "a\n<b>[", LONG, 0.0), (4, None, None, "user", "q", 0.0)]
    m = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, role string, text string, score double").withColumn("leaf", F.lit(1)).withColumn("conv", F.lit("x"))
    out = chat.read_back(chat.format_trees(m)).collect()
    got = {(r.conv_id, r.leaf): (r["rank"], [(t.role, t.text) for t in r.turns], r.loss_text) for r in out}
    assert got == {(1, 2): (2, [("user", "a"), ("assistant", "")], ""), (1, 3): (1, [("user", "a"), ("", "x\ny")], ""), (None, 1): (1, [("user", "z")], ""), (3, 1): (1, [("a\n<b>[", LONG)], "")}
    assert [r.leaf for r in chat.format_trees(m, branches=1).where("conv_id = 1").collect()] == [3]
    assert chat.format_trees(m.limit(0)).count() == 0


def test_chat_paths_against_brute_force(spark):
    rng = random.Random(3)
    parent = {(c, n): None if n == 0 or rng.random() < 0.05 else rng.randrange(max(0, n - 3), n) for c in range(4) for n in range(60)}
    rows = [(c, n, p, rng.choice(["user", "assistant"]), f"t[{n}]<|end|>\n&lt;", rng.random()) for (c, n), p in parent.items()]
    text = {(r[0], r[1]): r for r in rows}
    out = chat.read_back(chat.format_trees(spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, role string, text string, score double"))).collect()
    want = {}
    for c, n in parent:
        if not any(k[0] == c and p == n for k, p in parent.items()):
            path, at = [], n
            while at is not None:
                path.append(text[(c, at)])
                at = parent[(c, at)]
            want[(c, n)] = path[::-1]
    assert {(r.conv_id, r.leaf): [(t.role, t.text) for t in r.turns] for r in out} == {k: [(x[3], x[4]) for x in p] for k, p in want.items()}
    assert {(r.conv_id, r.leaf): r.loss_text for r in out} == {k: "".join(x[4] for x in p if x[3] == "assistant") for k, p in want.items()}


def parsed(data):
    """A record read line by line, apart from the operator's own parser."""
    stream = io.BytesIO(data)
    assert stream.readline() == b"WARC/1.1\r\n"
    fields = {}
    while (line := stream.readline()) != b"\r\n":
        name, value = line.decode().rstrip("\r\n").split(": ", 1)
        assert name not in fields
        fields[name] = value
    block = stream.read(int(fields["Content-Length"]))
    assert stream.read() == b"\r\n\r\n"
    return fields, block


def sha1(block):
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_warc(spark):
    page = '<html><head><title>A &amp; b</title><script>x="</p>"</script></head><body><!-- no --><p>one<br>two  <b>three</b></p><a href="/x?a=1&amp;b=2">four</a></body></html>'
    rows = [(1, "http://h/a\r\nX: y", page), (1, "http://h/a\r\nX: y", page), (2, None, None), (3, "u", ""), (None, "u", "plain < text & é"), (5, "u", "<p>" + LONG + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("error", F.lit(1))
    made = warc.responses(pages)
    sources = [parsed(bytes(r.record)) for r in made.collect()]
    assert all(f["WARC-Type"] == "response" and f["WARC-Block-Digest"] == sha1(b) and f["WARC-Payload-Digest"] == sha1(b.partition(b"\r\n\r\n")[2]) for f, b in sources)
    out = warc.derivatives(made).collect()
    assert len(out) == 12 and warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    for r in out:
        fields, block = parsed(bytes(r.record))
        assert fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Record-ID"] == r.record_id and fields["WARC-Type"] == r.record_type
        assert fields["WARC-Block-Digest"] == sha1(block) == r.block_digest and len(block) == r.content_length
        assert r.refers_to in {f["WARC-Record-ID"] for f, _ in sources} and r.error is None and "X" not in fields
    of = {(r.page_id, r.record_type): parsed(bytes(r.record)) for r in out}
    assert of[(1, "conversion")][1].decode() == "A & b\none\ntwo three\nfour"
    meta = of[(1, "metadata")][1].decode()
    assert "title: A & b\r\n" in meta and "outlink: /x?a=1&b=2\r\n" in meta and f"source-payload-digest: {sha1(page.encode())}\r\n" in meta
    assert of[(1, "conversion")][0]["WARC-Record-ID"] in meta
    assert of[(None, "conversion")][1].decode() == "plain < text & é"
    assert of[(5, "conversion")][1].decode() == LONG


def test_warc_keeps_what_a_response_says(spark):
    """Ids, dates, headers in their order and stated digests of real responses; codings; what isn't a response."""
    body = gzip.compress("<title>T</title><p>caf\xe9</p>".encode("latin-1"))
    chunks = b"5\r\n" + body[:5] + b"\r\n" + f"{len(body) - 5:x};x=1\r\n".encode() + body[5:] + b"\r\n0\r\n\r\n"
    http = b"HTTP/1.0 404 Not Found\r\nServer: one\r\nSet-Cookie: a\r\nset-cookie: b\r\nContent-Type: text/html; charset=ISO-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks

    def made(kind, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "warc-record-id: <urn:x:1>", "WARC-Target-URI: http://h/", "WARC-Date: 2001-02-03T04:05:06Z", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    rows = [(1, made("response", http, "WARC-Payload-Digest: sha256:abc", "WARC-Block-Digest: sha1:WRONG")), (2, made("request", http)), (3, b"junk"), (4, None), (5, made("response", http)[:-200])]
    out = warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    assert [(r.page_id, r.error is None) for r in out] == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False)]
    meta, text = (parsed(bytes(r.record)) for r in out[:2])
    assert meta[0]["WARC-Refers-To"] == text[0]["WARC-Refers-To"] == "<urn:x:1>" and meta[0]["WARC-Date"] == text[0]["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert meta[0]["WARC-Payload-Digest"] == text[0]["WARC-Refers-To-Payload-Digest"] == "sha256:abc" and text[0]["WARC-Target-URI"] == "http://h/"
    assert text[1].decode() == "T\ncaf\xe9"
    about = meta[1].decode().split("\r\n")
    assert about[:4] == ["source-block-digest: sha1:WRONG", f"source-block-digest-mismatch: {sha1(http)}", "source-payload-digest: sha256:abc", f"source-length: {len(chunks)}"]
    assert about[4:8] == ["source-status: HTTP/1.0 404 Not Found", "source-header-server: one", "source-header-set-cookie: a", "source-header-set-cookie: b"]


def test_warc_of_unclosed_signs():
    """Signs that open something and never close it, very often: linear time, and text beside them stays."""
    for sign in ("<a ", "<!-- ", "<script ", "<title>", "<p", "<a>", "<b"):
        for end in ("", ">", " x"):
            warc.derive(warc.response("u", warc.DATE, "<urn:x>", "HTTP/1.1 200 OK", [], ("<p>one</p>" + sign * 200_000 + end).encode()))
    assert warc.plain_text("<p>one</p><!-- a > b") == "one" and warc.plain_text("<p>one</p>2 < 3") == "one\n2 < 3"
    assert warc.plain_text("<p>one</p><script> x > y") == "one"


def leaves(text):
    """A paragraph's pieces of eight words; longer words count for each 64 code points."""
    out, at = [], 0
    while at < len(text):
        begin, n = at, 0
        while n < 8:
            to = at
            while to < len(text) and text[to] in " \t\n\x0b\x0c\r":
                to += 1
            end = to
            while end < min(len(text), to + 64) and text[end] not in " \t\n\x0b\x0c\r":
                end += 1
            if end == to:
                break
            at, n = end, n + 1
        while at < len(text) and text[at] in " \t\n\x0b\x0c\r":
            at += 1
        out.append(text[begin:at])
    return out


def plain_tree(text):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    secs = [[[h(x) for x in leaves(p)] for p in s.split("\n")] for s in text.split("\n\n")]
    pars = [[h("".join(p)) for p in s] for s in secs]
    return secs, pars, h("".join(h("".join(s)) for s in pars))


def test_merkle_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["", " ", "\n", "\n\n", "\n\n\n", "a\u2028b\rc\x85d", "x" * 200, "one  two\tthree " * 20, LONG[:5000]]
    for _ in range(40):
        texts.append("".join(rng.choice(["word", "wörd", " ", " ", "\n", "\n\n", "漢字", "\t", "a" * 70]) for _ in range(rng.randrange(120))))
        texts.append(texts[-1].replace("word", "ward", 1))
    out = {r.doc_id: r for r in merkle.fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def near(a, b):
        (la, pa, _), (lb, pb, _) = plain_tree(a), plain_tree(b)
        alike, x, y = 0, set(), set()
        at = {(i, j) for t in (la, lb) for i, s in enumerate(t) for j in range(len(s))}
        for i, j in at:
            p = pa[i][j] if i < len(pa) and j < len(pa[i]) else None
            q = pb[i][j] if i < len(pb) and j < len(pb[i]) else None
            if p == q:
                alike += len(la[i][j])
            else:
                x |= {v[:8] for v in la[i][j]} if p else set()
                y |= {v[:8] for v in lb[i][j]} if q else set()
        most = alike + max(len(x), len(y))
        return 1.0 if not most else (alike + len(x & y)) / most

    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        secs, _, top = plain_tree(t)
        assert "".join(x for s in t.split("\n\n") for p in s.split("\n") for x in leaves(p)) == t.replace("\n", "")
        assert out[i].fingerprint == top + ":" + "/".join(".".join("".join(x[:8] for x in p) for p in s) for s in secs)
        assert out[i].near_edited == pytest.approx(near(t, edited)) and out[i].near_next == pytest.approx(near(t, nxt))
    assert len({out[i].fingerprint for i in range(len(texts))}) == len(set(texts))


def test_merkle_of_many_equal_ids(spark):
    """Rows of one id, or of none, in several parts: each row's next is the next in order of id and hash."""
    rows = [(7 if i % 3 else None if i % 2 else i, f"text {i}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.text for r in d.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    got = {r.text: r.next_text for r in merkle.next_texts(d, bucket_rows=20).collect()}
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_keep_first_of_ids_that_repeat_over_texts(spark):
    """Each component keeps one row, whichever rows share its ids; each row knows its component."""
    a, b, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "abz")
    rows = [(3, a, 1), (5, a, 1), (5, z, 1), (7, b, 1), (7, z + " tail", 1), (7, b, 0), (8, b, 1), (None, z, 1), (5, None, 2), (5, "", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(map(tuple, simhash.keep_first(d).collect()), key=str) == sorted([(3, a, 1), (5, z, 1), (7, b, 0), (None, z, 1), (5, None, 2)], key=str)
    classes = simhash.similar_documents(d).collect()
    assert len({r.class_key for r in classes}) == 4 and {(r.component_id, r.doc_id) for r in classes} >= {(3, 5), (5, 5), (7, 8), (5, 7)}


def test_warc_of_hostile_sizes():
    """Negative chunks and lengths, chunks that end nowhere, bodies that unfold without end: an answer or an error, at once."""
    for body in (b"-6\r\nabc", b"+3\r\nabc\r\n0\r\n\r\n", b"5\r\nab", b"0x3\r\nabc", b"ffffffffffffffffff\r\na", b"\r\n" * 50_000):
        with pytest.raises(ValueError):
            warc.unchunked(body)
        made = warc.response("u", warc.DATE, "<urn:x>", "HTTP/1.1 200 OK", [("Transfer-Encoding", "chunked")], body)
        assert parsed(warc.derive(made)[1]["record"])[1].decode() == warc.plain_text(body.decode())
    good = warc.response("u", warc.DATE, "<urn:x>", "HTTP/1.1 200 OK", [], b"abc")
    with pytest.raises(ValueError, match="negative"):
        warc.derive(good.replace(b"Content-Length: ", b"Content-Length: -"))
    for coding, squeeze in (("gzip", gzip.compress), ("deflate", zlib.compress)):
        made = warc.response("u", warc.DATE, "<urn:x>", "HTTP/1.1 200 OK", [("Content-Encoding", coding)], squeeze(bytes(3_000_000)))
        with pytest.raises(ValueError, match="unfolds"):
            warc.derive(made, 1_000_000)
        assert len(warc.derive(made, 3_000_000)) == 2
    assert warc.inflated(gzip.compress(b"ab") + gzip.compress(b"cd"), 31, 10) == b"abcd"
    cut = warc.response("u", warc.DATE, "<urn:x>", "HTTP/1.1 200 OK", [("Content-Encoding", "gzip")], gzip.compress(b"abc" * 99)[:-9])
    assert len(warc.derive(cut)) == 2


def test_packing_deals_equal_rows_to_many_shards(spark):
    """Rows that repeat, with and without an id: no shard gets more than its part, and no bin two of them."""
    rows = spark.range(12_000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    out = packing.pack(rows, capacity=30, per_source=10, shard_pieces=500).collect()
    shards = {}
    for r in out:
        shards.setdefault(r.bin_id.split("-")[0], []).append(r)
    assert len(out) == 12_000 and sum(r.doc_id == 7 for r in out) == 6_000
    assert len(shards) == 24 and max(map(len, shards.values())) < 700
    assert len({r.bin_id for r in out}) == 12_000
