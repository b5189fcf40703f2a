"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of a document. Every word that a window covers goes if the
window's words also start earlier: in a document of smaller id, or further up in the same one.

1. Candidates. Of the phrases of ``anchor`` words inside a window, the one of least hash (the leftmost of equals) is the
   window's anchor, so equal windows have equal anchors, and a text has an anchor for every six words or so. Anchors that
   occur once over all documents hold no repeated window and end here, as eight bytes each.
2. Confirmed passages. The words under all windows of one anchor occurrence are its segment. Of segments with the same anchor
   and the same hash (128 bits together) the first stays, the others are passages that recur as a whole. Where an anchor
   has several segments, the windows of their first occurrences are compared one by one in the same way: a window's first
   occurrence always lies in one of these.
3. Automata. All documents are dealt to blocks of about ``block_words`` words, a shard each. The passages that recur in a
   block, those that continue each other as one, with the places of their first occurrences anywhere, are compiled into one
   Aho-Corasick automaton over words (each word of the block is one sign), and all documents of the block stream through it.
   What each hit covers goes, if it starts later than its passage does first.

Hot anchors, segments and windows are counted before they are shuffled, and rows of such keys stay where they are
(``common.attached``). Texts are shuffled twice: to meet their recurring anchors, and to their block.

Defined cases: null and empty texts have no words; documents of a null id come first; documents that repeat an id with other
texts are ordered by the texts' hash, and rows that repeat id and text are one document, whose row comes out as often;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import attached, drop_written, recurring, table, written

#: Odd multipliers of the rolling sums.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: A document's id and the lower bits of its text's hash above this many bits of a word's position.
POSITION, TEXT_BITS = 31, 31
PLACE = pa.decimal128(38, 0)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch's texts (null: none), one behind the other, and where each text's begin and end."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.not_equal(flat, "")
    counts = np.bincount(owner.filter(real).to_numpy(), minlength=len(texts))
    return flat.filter(real), np.concatenate([[0], np.cumsum(counts)])


def word_hashes(words: pa.Array) -> np.ndarray:
    """XXH64 of each word; each distinct one is hashed once."""
    coded = words.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)


def _mixed(g: np.ndarray) -> np.ndarray:
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return g


def rolled(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes."""
    n = max(0, len(h) - width + 1)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        g *= base
        g += h[j : n + j]
    return _mixed(g)


def spanned(h: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of the word hashes from each begin to its end: differences of sums, taken back by a power of the inverse."""
    power = np.ones(len(h) + 1, dtype=np.uint64)
    power[1:] = base
    np.cumprod(power, out=power)
    inverse = np.ones(len(h) + 1, dtype=np.uint64)
    inverse[1:] = pow(int(base), -1, 1 << 64)
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[:-1], out=sums[1:])
    return _mixed((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def anchors(h: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one behind the other in h: where each anchor begins, its hash, and the words from which and up to
    which the windows of this anchor reach."""
    n = max(0, len(h) - window + 1)
    g = rolled(h, anchor, BASES[0])
    # Halves of hashes and places in one number: the least has the leftmost of the least halves.
    packed = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    least = sliding_least(packed, window - anchor + 1)[:n] if n else packed[:0]
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    starts = np.flatnonzero(owner[:n] == owner[window - 1 : window - 1 + n])
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)  # never falls from one window to the next
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(at)]]) - 1 if len(at) else new
    begins = at[new]
    return begins, g[begins], starts[new], starts[last] + window


def _key(docs: DataFrame) -> DataFrame:
    """text, doc_id (null: the smallest), th (bits of the text's hash) and key (a hash of both) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text).bitwiseAND(F.lit((1 << TEXT_BITS) - 1)).alias("th"))
    return rows.select("text", "own_id", F.coalesce("own_id", lowest).alias("doc_id"), "th", F.xxhash64("own_id", "th").alias("key"))


def _places(doc_id: np.ndarray, th: np.ndarray, at: np.ndarray) -> pa.Array:
    """Where words stand, as one number: by document, by the text's hash, by position."""
    low = (th.astype(np.uint64) << np.uint64(POSITION)) | at.astype(np.uint64)
    both = np.empty((len(at), 2), dtype=np.uint64)
    both[:, 0] = low | (doc_id.view(np.uint64) << np.uint64(POSITION + TEXT_BITS))
    both[:, 1] = (doc_id >> np.int64(64 - POSITION - TEXT_BITS)).view(np.uint64)
    return pa.Array.from_buffers(PLACE, len(at), [None, pa.py_buffer(both.tobytes())])


def _parts(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sketched(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """anchor (its hash), key and at (where it begins) of every anchor of every text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(it):
            words, ends = split_words(batch.column("text"))
            begins, hashes, _, _ = anchors(word_hashes(words), ends, window, anchor)
            text = np.searchsorted(ends, begins, side="right") - 1
            key = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(key[text]), pa.array((begins - ends[text]).astype(np.int32))], ["anchor", "key", "at"])

    return rows.select("text", "key").mapInArrow(run, "anchor long, key long, at int")


def joined_words(words: pa.Array, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words from each begin to its end, joined by one space."""
    sizes = ends - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    each = np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], sizes)
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.take(pa.array(each)).cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def segments(rows: DataFrame, found: DataFrame, window: int, anchor: int) -> DataFrame:
    """anchor, print (the hash of its words), place (of its first word), key, n (words) and text of the segment of every
    anchor that recurs. found has key and ats, the places of these anchors."""
    names = ["anchor", "print", "place", "key", "n", "text"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(it):
            words, ends = split_words(batch.column("text"))
            h = word_hashes(words)
            begins, hashes, lo, hi = anchors(h, ends, window, anchor)
            lists = batch.column("ats")
            wanted = lists.flatten().to_numpy() + np.repeat(ends[:-1], lists.value_lengths().to_numpy())
            keep = np.isin(begins, wanted)
            lo, hi = lo[keep], hi[keep]
            text = np.searchsorted(ends, lo, side="right") - 1
            own = {n: batch.column(n).to_numpy()[text] for n in ("doc_id", "th", "key")}
            prints = spanned(h, lo, hi, BASES[1]).view(np.int64)
            places = _places(own["doc_id"], own["th"], lo - ends[text])
            texts = joined_words(words, lo, hi).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(prints), places, pa.array(own["key"]), pa.array((hi - lo).astype(np.int32)), texts], names)

    joined = rows.join(found, "key").select("text", "doc_id", "th", "key", "ats")
    return joined.mapInArrow(run, "anchor long, print long, place decimal(38,0), key long, n int, text string")


def _shifted(base: list, which: np.ndarray, by: np.ndarray) -> pa.Array:
    """Places ``by`` words behind others; a place's lowest bits are a position, so this is a plain sum."""
    mask = (1 << 64) - 1
    both = np.array([[int(b) & mask, (int(b) >> 64) & mask] for b in base], dtype=np.uint64).reshape(-1, 2)[which]
    both[:, 0] += by.astype(np.uint64)
    return pa.Array.from_buffers(PLACE, len(by), [None, pa.py_buffer(np.ascontiguousarray(both).tobytes())])


def windows_of(firsts: DataFrame, window: int) -> DataFrame:
    """anchor and print (hashes of its words by two bases), place, key and n of every window of segments (place, key, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(it, 4096):
            words, ends = split_words(batch.column("text"))
            h = word_hashes(words)
            text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            n = max(0, len(h) - window + 1)
            starts = np.flatnonzero(text[:n] == text[window - 1 : window - 1 + n])
            own = text[starts]
            one, two = (pa.array(rolled(h, window, b)[starts].view(np.int64)) for b in BASES)
            place = _shifted(batch.column("place").to_pylist(), own, starts - ends[own])
            yield pa.RecordBatch.from_arrays([one, two, place, pa.array(batch.column("key").to_numpy()[own]), pa.array(np.full(len(starts), window, np.int32))], ["anchor", "print", "place", "key", "n"])

    return firsts.select("place", "key", "text").mapInArrow(run, "anchor long, print long, place decimal(38,0), key long, n int")


def later(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """key, place, n and first of the rows (anchor, print, place, key, n) that aren't the first of their anchor and print."""
    many = firsts.where("rows > 1").select("anchor", "print", "first")
    hot = firsts.where(F.col("rows") > rows.count() / 1000).select("anchor", "print", "first")
    return attached(rows.select("anchor", "print", "place", "key", "n"), many, hot, "anchor", "print").where("place > first").select("key", "place", "n", "first")


def first_places(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("anchor", "print").agg(F.min("place").alias("first"), F.count("*").alias("rows")))


def repeated_passages(docs: DataFrame, window: int, anchor: int) -> tuple[DataFrame, int]:
    """key, place, n and first of passages that start earlier too, at ``first``: together they hold every window that
    recurs, wherever it does. And about how many words there are."""
    rows = _key(docs)
    dealt = written(sketched(rows, window, anchor))
    size = dealt.count() * (window - anchor + 2) // 2 + docs.count() * window
    found = written(recurring(dealt, "anchor").groupBy("key").agg(F.collect_set("at").alias("ats")))
    drop_written(dealt)
    segs = written(segments(rows, found, window, anchor))
    drop_written(found)
    firsts = first_places(segs)
    whole = written(later(segs, firsts))
    # Of anchors with several segments the windows are compared one by one, in the first occurrence of each.
    mixed = written(recurring(firsts.select("anchor", F.col("first").alias("place")), "anchor").select("anchor", "place"))
    single = written(windows_of(segs.join(mixed, ["anchor", "place"]), window))
    starts = first_places(single)
    out = written(whole.unionAll(later(single, starts)))
    for t in (segs, firsts, whole, mixed, single, starts):
        drop_written(t)
    return out, size


def read_places(places: pa.Array) -> np.ndarray:
    """Places as rows of their lower and upper 64 bits."""
    return np.frombuffer(places.buffers()[1], dtype=np.uint64).reshape(-1, 2)[places.offset : places.offset + len(places)]


def merged(key: np.ndarray, place: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Passages (key, position, number of words, first place) that overlap and whose first occurrences overlap likewise, as one."""
    at = (place[:, 0] & np.uint64((1 << POSITION) - 1)).astype(np.int64)
    low = first[:, 0] - at.astype(np.uint64)  # equal for passages at equal distance from their firsts
    order = np.lexsort((at, low, first[:, 1], key))
    key, at, n, low, first = key[order], at[order], n[order].astype(np.int64), low[order], first[order]
    same = (key[1:] == key[:-1]) & (low[1:] == low[:-1]) & (first[1:, 1] == first[:-1, 1]) & (at[1:] <= at[:-1] + n[:-1])
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    reach = np.maximum.reduceat(at + n, new)
    return key[new], at[new], reach - at[new], first[new]


def signs_of(codes: np.ndarray, wide: bool) -> str:
    """Numbers of words as a string: a code point each (without the surrogates, which strings can't hold) or, if there are too
    many different words for that, two from different ranges."""
    if wide:
        codes = np.stack([codes % 100_000 + 0x10000, codes // 100_000 + 0x40000], axis=1).ravel()
    else:
        codes = np.where(codes < 0xD800, codes, codes + 0x800)
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def goes(codes: np.ndarray, ends: np.ndarray, bases: list[int], passages: dict[tuple[int, int], int]) -> np.ndarray:
    """Which words of a block go. codes: the words' numbers, document by document; bases: the place of each document's first
    word; passages: from which word of the block up to which, and where that starts first."""
    wide = bool(len(codes)) and int(codes.max()) >= 1_000_000
    per, text = 1 + wide, signs_of(codes, wide)
    found = ahocorasick.Automaton()
    for (a, b), first in passages.items():
        words = text[a * per : b * per]
        found.add_word(words, (b - a, min(first, found.get(words, (0, first))[1])))
    found.make_automaton()
    gone = np.zeros(len(codes) + 1, dtype=np.int64)
    for at, to, base in zip(ends[:-1].tolist(), ends[1:].tolist(), bases, strict=True):
        for end, (n, first) in found.iter(text, at * per, to * per):
            begin = (end + 1) // per - n
            if first < base + begin - at:
                gone[begin] += 1
                gone[begin + n] -= 1
    return np.cumsum(gone[:-1]) > 0


def drop_repeats(docs: DataFrame, window: int = 20, anchor: int = 8, block_words: int = 250_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept (what stays, words joined by one space) of every row."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor is part of a window")
    passages, size = repeated_passages(docs, window, anchor)
    block = F.pmod(F.xxhash64("key", F.lit("block")), F.lit(max(1, -(-size // block_words)))).alias("block")
    nothing = {"key": "long", "place": "decimal(38,0)", "n": "int", "first": "decimal(38,0)"}
    texts = _key(docs).select(block, "key", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items() if c != "key"], "own_id", "doc_id", "th", "text")
    marks = passages.select(block, *nothing, *[F.lit(None).cast(t).alias(c) for c, t in (("own_id", "long"), ("doc_id", "long"), ("th", "long"), ("text", "string"))])
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def flush(held: dict[int, list], words: list[pa.Array], marks: list[tuple]) -> Iterator[pa.RecordBatch]:
        """held: of each document's key its id, the place of its first word, its number of words and of rows."""
        if not held:
            return
        all_words = pa.concat_arrays(words)
        ends = np.concatenate([[0], np.cumsum([d[2] for d in held.values()])])
        stay = np.ones(len(all_words), dtype=bool)
        if marks:
            number = {k: r for r, k in enumerate(held)}
            key, at, n, first = merged(*(np.concatenate(x) for x in zip(*marks, strict=True)))
            begin = ends[[number[k] for k in key.tolist()]] + at
            known: dict[tuple[int, int], int] = {}
            for a, b, lo, hi in zip(begin.tolist(), (begin + n).tolist(), first[:, 0].tolist(), first[:, 1].view(np.int64).tolist(), strict=True):
                known[(a, b)] = min((hi << 64) + lo, known.get((a, b), (hi << 64) + lo))
            codes = all_words.dictionary_encode().indices.to_numpy().astype(np.int64)
            stay = ~goes(codes, ends, [d[1] for d in held.values()], known)
        left = np.concatenate([[0], np.cumsum(stay)])[ends]
        kept = joined_words(all_words.filter(pa.array(stay)), left[:-1], left[1:])
        total = np.diff(ends)
        rows = pa.array(np.repeat(np.arange(len(held)), [d[3] for d in held.values()]))
        cols = [pa.array([d[0] for d in held.values()], pa.int64()), pa.array(total), pa.array(total - np.diff(left)), kept.cast(pa.string())]
        out = pa.RecordBatch.from_arrays([c.take(rows) for c in cols], names)
        yield from (out.slice(a, 1000) for a in range(0, out.num_rows, 1000))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, those of documents and those of passages mixed."""
        held: dict[int, list] = {}
        words: list[pa.Array] = []
        marks: list[tuple] = []
        now = None
        for batch in _parts(it, 4096):
            blocks = batch.column("block").to_numpy()
            bounds = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if blocks[a] != now:
                    yield from flush(held, words, marks)
                    held, words, marks, now = {}, [], [], blocks[a]
                part = batch.slice(a, b - a)
                is_text = part.column("text").is_valid()
                ours = part.filter(pc.invert(is_text))
                if ours.num_rows:
                    marks.append((ours.column("key").to_numpy(), read_places(ours.column("place")), ours.column("n").to_numpy(), read_places(ours.column("first"))))
                theirs = part.filter(is_text)
                flat, ends = split_words(theirs.column("text"))
                for r, (key, own_id, doc_id, th) in enumerate(zip(*(theirs.column(c).to_pylist() for c in ("key", "own_id", "doc_id", "th")), strict=True)):
                    if key in held:
                        held[key][3] += 1
                    else:
                        held[key] = [own_id, (doc_id << (POSITION + TEXT_BITS)) + (th << POSITION), int(ends[r + 1] - ends[r]), 1]
                        words.append(flat.slice(ends[r], ends[r + 1] - ends[r]))
        yield from flush(held, words, marks)

    both = texts.unionByName(marks)
    return both.repartition("block").sortWithinPartitions("block").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op12(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS b FROM d WHERE len(ws) >= 20),
k AS (SELECT doc_id, b, md5(array_to_string(ws[b:b + 19], ' ')) AS h FROM s),
f AS (SELECT doc_id, b, row_number() OVER (PARTITION BY h ORDER BY doc_id, b) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, b + unnest(range(20)) AS p FROM f WHERE nth > 1),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM w ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
