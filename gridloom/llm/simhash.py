"""SimHash near-dedup with pivot distance tables.

Fingerprint: a text's A-Z are lowered, its words ``[^\\x20\\x09-\\x0D]+`` form shingles of three, repeats included (fewer
words: the whole sequence); a bit is 1 if set in over half the shingles' XXH64 (seed 42). No word: fingerprint zero.
Two fingerprints link at ``radius`` or fewer differing bits. Distinct fingerprints that link agree in two of five
stretches of bits, so each is dealt to ten groups by a pair of stretches. A group precomputes the Hamming distances of
its members to many reference fingerprints (the pivots); by the triangle inequality, pairs whose distances to any pivot
differ by more than the radius can't link and are discarded; the survivors are verified bit by bit. A group walks from
linked member to linked member and emits a spanning tree, not all its pairs, so a dense group of n costs about n. Groups
of more than ``crowded`` members are first split by cells of pivot distances that overlap by the radius, which loses no
pair; a cell that is still crowded is dealt to blocks, and every two blocks meet in a task of their own. Components come
from alternating stars.

Three bits admit only pairs that are nearly equal. similar_documents() links at a Jaccard similarity of word shingles
instead (0.8 of five words). Groups then come from shared least hashes of shingles (BANDS keys of ROWS hashes; a pair at
0.8 shares none once in 2,800 times). Within a group, members themselves are the reference fingerprints: pairs whose
distances to one of them differ by over WIDE bits are discarded (at 0.8 two fingerprints differ by more than that less
than once in 100,000 times), and every survivor is decided exactly, by its sets of shingle hashes, unless links connect
it already. Texts of equal words are one node. Groups that share members form a family, which one task compares as a whole. A
family of over ``crowded`` texts or two million shingles is compared group by group, and such a group in blocks of that
size, then block against block, each pair of blocks a task of its own. Texts travel as their words, one of each node, to
the families (half the bytes of their shingles' hashes), at any size by the same plan.

Defined cases: null and empty texts have fingerprint zero, linked like any other; repeated rows keep their rows; a null
doc_id is fingerprinted and gets its component's smallest id, null if there is none; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column, drop_written, fresh, lookup, table, words, written
from gridloom.llm.components import components

#: Where the five stretches of the 64 bits begin and end.
STRETCHES = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
PAIRS = [(i, j) for i in range(5) for j in range(i + 1, 5)]
#: Reference fingerprints: XXH64 of their numbers.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}", 42) for i in range(16)], dtype=np.uint64)

#: Bits by which fingerprints of similar documents differ at most, and how many members of a group are its pivots.
WIDE, REFERENCES = 24, 32
#: How many keys of how many least hashes a text has.
BANDS, ROWS = 20, 5
HASHES = BANDS * ROWS
MULTIPLIERS = np.array([xxhash.xxh32_intdigest(f"multiplier {i}", 42) | 1 for i in range(HASHES)], dtype=np.uint32)
MASKS = np.array([xxhash.xxh32_intdigest(f"mask {i}", 42) for i in range(HASHES)], dtype=np.uint32)


def shingle_hashes(ws: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every shingle of a text's words, repeats included; fewer words than width are one shingle."""
    digest, joined = xxhash.xxh64_intdigest, b" ".join(ws)
    if len(ws) <= width:
        return np.array([digest(joined, 42)] if ws else [], dtype=np.uint64)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(ws) - width + 1].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(h: np.ndarray) -> np.uint64:
    """The bits set in over half the hashes; long texts in slices."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(texts: list[bytes | None], width: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for k, t in enumerate(texts):
        out[k] = majority(shingle_hashes((t or b"").lower().split(), width))
    return out


def with_fingerprint(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist(), width).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the links among all of a group connect: (member, member it was reached from)."""
    fps = np.unique(fps)
    bits = fps.view(np.uint64)
    pivots = np.bitwise_count(bits[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    left = np.arange(len(fps))
    links: list[tuple[int, int]] = []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = left[(np.abs(pivots[left] - pivots[x]) <= radius).all(1)]  # survivors of the pivot table
            near = near[np.bitwise_count(bits[near] ^ bits[x]) <= radius]
            links += [(int(fps[y]), int(fps[x])) for y in near]
            todo += near.tolist()
            left = left[~np.isin(left, near)]
    return links


def link_fingerprints(distinct: DataFrame, radius: int = 3, crowded: int = 4000) -> DataFrame:
    """Edges (a, b) between fingerprints, at most ``radius`` bits apart, that connect whatever the links connect."""
    if radius > 3:
        raise ValueError("five stretches find pairs at up to three differing bits")
    fp = F.col("fp")
    cut = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in STRETCHES]
    keys = F.array(*[F.struct(F.lit(n).alias("t"), (cut[i] * F.lit(1 << 13) + cut[j]).alias("k")) for n, (i, j) in enumerate(PAIRS)])
    dealt = distinct.select("fp", F.explode(keys).alias("g")).select("fp", F.col("g.t").alias("t"), F.col("g.k").alias("k"))
    many = written(dealt.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"))
    shared = dealt.join(many, ["t", "k"])
    # A crowded group's members go to cells of four pivot distances; each to the cell of its distance and, if another,
    # to the cell of its distance plus the radius, so that any two that link meet in a cell.
    width = 2 * (radius + 1)
    cells = F.array(F.lit(0))
    for n in range(4):
        d = F.bit_count(fp.bitwiseXOR(F.lit(int(PIVOTS[n].view(np.int64)))))
        lo, hi = F.floor(d / width), F.floor((d + radius) / width)
        own = F.array_distinct(F.array(lo, hi))
        cells = F.flatten(F.transform(cells.cast("array<long>"), lambda c: F.transform(own, lambda x: c * 10 + x)))  # noqa: B023
    in_cells = written(shared.select("t", "k", "fp", F.explode(F.when(F.col("n") > crowded, cells.cast("array<long>")).otherwise(F.array(F.lit(0).cast("long")))).alias("cell")))
    at = ["t", "k", "cell"]
    blocks = written(in_cells.groupBy(*at).agg(F.ceil(F.count("*") / crowded).alias("blocks")).where("blocks > 1"))
    lone = F.lit(0).cast("long")
    if blocks.isEmpty():
        tasks = in_cells.select(*at, lone.alias("i"), lone.alias("j"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp", *at), F.coalesce("blocks", F.lit(1)))
        placed = in_cells.join(blocks, at, "left").withColumn("block", own)
        met = placed.withColumn("partner", F.explode(F.sequence(lone, F.coalesce("blocks", F.lit(1)) - 1)))
        tasks = met.select(*at, F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "fp")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go over several batches."""
        held: list[np.ndarray] = []
        key = None

        def flush() -> list[tuple[int, int]]:
            return spanning_links(np.concatenate(held), radius) if held else []

        for batch in it:
            *cols, f = (batch.column(n).to_numpy() for n in (*at, "i", "j", "fp"))
            if not len(f):
                continue
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            bounds = [0, *new.tolist(), len(f)]
            links: list[tuple[int, int]] = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                now = tuple(int(c[a]) for c in cols)
                if now != key:
                    links += flush()
                    held, key = [], now
                held.append(f[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])
        links = flush()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    task = [*at, "i", "j"]
    links = written(tasks.repartition(*task).sortWithinPartitions(*task).mapInArrow(run, "a long, b long"))
    for t in (many, in_cells, blocks):
        drop_written(t)
    return links


def _named(nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """key and component_id of every row of nodes (key, first): the smallest ``first`` of those with its root."""
    in_class = roots.withColumnRenamed("node", key).join(nodes, key)
    named = in_class.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = lookup(in_class.select(key, "root"), named, "root").select(key, "component_id")
    return nodes.join(linked, key, "left").select(key, F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id reachable over links, of every row."""
    prints = written(with_fingerprint(docs, width))
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = link_fingerprints(firsts.select("fp"), radius)
    roots = written(components(links))
    by_print = written(_named(firsts, roots, "fp"))
    for t in (firsts, links, roots):
        drop_written(t)
    return lookup(prints, by_print, "fp").select("doc_id", "fp", "component_id")


def least_hashes(h: np.ndarray) -> np.ndarray:
    """The least of the hashes' upper halves under each of HASHES permutations."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    upper = (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 256):
        x = upper[at : at + 256, None] ^ MASKS
        x *= MULTIPLIERS
        np.minimum(least, x.min(0), out=least)
    return least


def _id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _node(ws: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(ws), 42)


def plain_words(text: Column) -> Column:
    """A text's words, A-Z lowered, joined by one space; the XXH64 of it is the text's node."""
    return F.array_join(words(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), " ")


def _parts(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task holds the words and hashes of few texts at a time."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node (a hash of the words), size (the number of distinct shingles), fp (the fingerprint over these) and keys
    of every row; texts without words have no keys."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(it):
            nodes, sizes, prints, keys = [], [], [], []
            for t in batch.column(1).to_pylist():
                ws = (t or b"").lower().split()
                h = np.unique(shingle_hashes(ws, width))
                least = least_hashes(h)
                nodes.append(_node(ws))
                sizes.append(len(h))
                prints.append(majority(h) if len(h) else np.uint64(0))
                keys.append([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in least.reshape(BANDS, ROWS)] if ws else [])
            flat = np.array([x for ks in keys for x in ks], dtype=np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "node", "size", "fp", "keys"],
            )

    return _id_and_text(docs).mapInArrow(run, "doc_id long, node long, size long, fp long, keys array<long>")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """node and plain (its words) of every distinct text."""
    plain = docs.select(plain_words(F.col("text")).alias("plain"))
    return plain.select(F.xxhash64("plain").alias("node"), "plain").groupBy("node").agg(F.min("plain").alias("plain"))


def exact_links(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, prints: np.ndarray, sets: list[bytes], similarity: float, wide: int = WIDE, tally: list | None = None) -> list[tuple[int, int]]:
    """Links that connect what the links among all of a block pair connect. Members of equal roots are connected already.
    With two sides only pairs across them are compared, as another task has those within. tally, if given, gets the
    numbers of pairs that the pivot table was asked about and that it discarded."""
    n = len(nodes)
    bits = prints.view(np.uint64)
    references = bits[np.linspace(0, n - 1, min(n, REFERENCES)).astype(int)]
    pivots = np.bitwise_count(bits[:, None] ^ references[None, :]).astype(np.int16)
    sizes = np.array([len(s) // 8 for s in sets], dtype=np.int64)
    _, tokens = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    holders = owner[np.argsort(tokens, kind="stable")]  # who has a shingle, shingle by shingle
    ends = np.cumsum(np.bincount(tokens))
    starts = ends - np.diff(ends, prepend=0)
    at = np.cumsum(sizes) - sizes
    two, later = bool((sides != sides[0]).any()), np.arange(n)
    roots = roots.copy()
    links: list[tuple[int, int]] = []
    for x in np.flatnonzero(sides == sides[0]).tolist():
        open_ = (roots != roots[x]) & ((sides != sides[0]) if two else (later > x))
        open_ &= np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x]) - 1e-6  # else the sizes alone are too unlike
        asked = int(open_.sum())
        if asked:
            open_ &= (np.abs(pivots - pivots[x]) <= wide).all(1)
        if tally is not None and asked:
            tally.append((asked, asked - int(open_.sum())))
        if not open_.any():
            continue
        own = tokens[at[x] : at[x] + sizes[x]]
        both = np.bincount(np.concatenate([holders[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]), minlength=n)
        near = np.flatnonzero(open_ & (both / (sizes + sizes[x] - both) >= similarity))
        links += [(int(nodes[y]), int(nodes[x])) for y in near]
        if len(near):
            roots[np.isin(roots, roots[near])] = roots[x]
    return links


def block_pairs(members: DataFrame, most: int, most_shingles: int) -> DataFrame:
    """members (t, k, node, size, fp, root) dealt to tasks (i, j): every two members of a group whose roots differ meet in one.
    A group's most frequent root has blocks of its own, below zero, which needn't meet each other."""
    at = ["t", "k"]
    tops = members.groupBy(*at, "root").agg(F.count("*").alias("n")).groupBy(*at).agg(F.max_by("root", F.struct("n", "root")).alias("top"))
    flagged = members.join(written(tops), at).withColumn("in_top", F.col("root") == F.col("top"))
    count = lambda own: F.ceil(F.greatest(F.count(F.when(own, 1)) / most, F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)) / most_shingles))
    sizes = flagged.groupBy(*at).agg(count(F.col("in_top")).alias("tops"), count(~F.col("in_top")).alias("others")).where("others > 0")
    block = lambda n: F.pmod(F.xxhash64("node", "t", "k"), F.col(n))
    side = F.when(F.col("in_top"), -1 - block("tops")).otherwise(block("others"))
    dealt = flagged.join(written(sizes), at).withColumn("side", side)
    others = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    with_top = F.sequence(-F.col("tops"), F.lit(-1).cast("long"))
    partners = F.when(F.col("in_top"), others).otherwise(F.concat(with_top, others))
    return dealt.select(*at, "node", "root", "side", "fp", F.explode(partners).alias("partner")).select(*at, F.least("side", "partner").alias("i"), F.greatest("side", "partner").alias("j"), "node", "root", "side", "fp")


def compared(dealt: DataFrame, similarity: float, width: int) -> DataFrame:
    """Links (a, b) within the tasks (t, k, i, j) that members (node, root, side, fp, plain) were dealt to."""
    task = ["t", "k", "i", "j"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; a task may go over several batches."""
        held: list[tuple] = []
        key = None

        def flush() -> pa.RecordBatch:
            links: list[tuple[int, int]] = []
            if held:
                links = exact_links(*(np.concatenate([h[n] for h in held]) for n in range(4)), [s for h in held for s in h[4]], similarity)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in _parts(it, 2048):
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy() for n in task]
            own = [batch.column(n).to_numpy() for n in ("node", "root", "side", "fp")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            bounds = [0, *new.tolist(), batch.num_rows]
            sets = [np.unique(shingle_hashes(t.split(b" "), width)).tobytes() for t in batch.column("plain").to_pylist()]
            for a, b in zip(bounds, bounds[1:], strict=False):
                now = tuple(int(c[a]) for c in cols)
                if now != key:
                    yield flush()
                    held, key = [], now
                held.append((*(x[a:b] for x in own), sets[a:b]))
        yield flush()

    rows = dealt.select(*task, "node", "root", "side", "fp", F.col("plain").cast("binary").alias("plain"))
    return written(rows.repartition(*task).sortWithinPartitions(*task).mapInArrow(run, "a long, b long"))


def link_similar(texts: DataFrame, plain: DataFrame, similarity: float, width: int, crowded: int = 4000, most_shingles: int = 2_000_000) -> DataFrame:
    """Edges (a, b) between distinct texts (node, size, fp, keys; node, plain) that connect the similar ones among those that
    share a key."""
    dealt = texts.select("node", "size", "fp", F.posexplode("keys").alias("t", "k"))
    mark = [F.sum(F.col("node").cast("decimal(38,0)")).alias("m1"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("m2")]
    many = dealt.groupBy("t", "k").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *mark).where("n > 1")
    # Groups of the same members are one.
    many = written(many.groupBy("n", "total", "m1", "m2").agg(F.min(F.struct("t", "k")).alias("g")).select("g.t", "g.k", F.ceil(F.greatest(F.col("n") / crowded, F.col("total") / most_shingles)).alias("blocks")))
    members = written(dealt.join(many, ["t", "k"]))
    # Whatever groups connect is a family. A family of bounded size is compared as a whole, so each of its texts goes to one
    # task once; only larger ones are compared group by group.
    hubs = members.groupBy("t", "k").agg(F.min("node").alias("hub"))
    families = written(components(members.join(hubs, ["t", "k"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    rows = written(families.join(texts.select("node", "size", "fp"), "node"))
    bounded = written(rows.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total")).select("root", ((F.col("n") <= crowded) & (F.col("total") <= most_shingles)).alias("bounded")))
    placed = written(lookup(rows, bounded, "root"))
    needed = written(plain.join(placed.select("node", "fp", "root", "bounded"), "node"))
    for t in (many, families, rows, bounded):
        drop_written(t)
    zero = F.lit(0).cast("long")
    small = needed.where("bounded").select(F.lit(-1).alias("t"), F.col("root").alias("k"), zero.alias("i"), zero.alias("j"), "node", F.col("node").alias("root"), zero.alias("side"), "fp", "plain")
    links = compared(small, similarity, width)
    left = placed.where("not bounded")
    if not left.isEmpty():
        wide = written(members.join(left.select("node"), "node", "left_semi"))
        words_of = needed.where("not bounded").select("node", "plain")
        block = F.pmod(F.xxhash64("node", "t", "k"), F.col("blocks"))
        within = wide.select("t", "k", block.alias("i"), block.alias("j"), "node", F.col("node").alias("root"), block.alias("side"), "fp")
        links = links.unionAll(compared(within.join(words_of, "node"), similarity, width))
        large = wide.where("blocks > 1").select("t", "k", "node", "size", "fp")
        if not large.isEmpty():
            # What the blocks of a large group have connected so far needn't be compared; all else meets, block by block.
            roots = written(components(links))
            rooted = written(large.join(roots, "node", "left").select("t", "k", "node", "size", "fp", F.coalesce("root", "node").alias("root")))
            links = links.unionAll(compared(block_pairs(rooted, crowded, most_shingles).join(words_of, "node"), similarity, width))
            for t in (roots, rooted):
                drop_written(t)
        drop_written(wide)
    for t in (members, placed, needed):
        drop_written(t)
    return links


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, crowded: int = 4000) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links), node (a hash of the row's words) and class_key of every
    row. Where ids repeat over different texts, only class_key tells components apart: rows of one have one class_key, and
    rows of two have two. Cases as in near_duplicates; texts without words are of one component."""
    rows = written(sketched(docs, width))
    texts = written(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    roots = written(components(link_similar(texts, distinct_texts(docs), similarity, width, crowded=crowded)))
    by_node = written(_named(texts.select("node", "first"), roots, "node").join(roots, "node", "left").select("node", "component_id", F.coalesce("root", "node").alias("class_key")))
    for t in (texts, roots):
        drop_written(t)
    return lookup(rows.select("doc_id", "node"), by_node, "node").select("doc_id", "component_id", "node", "class_key")


def keep_first(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of each component of similar documents: of the smallest id; of several texts of that id in the component the
    one whose words' hash is smallest, and of several rows of that the one that comes first as JSON. Ids may repeat over
    different texts. Rows of null id stay. Columns may be of any type."""
    classes = written(similar_documents(docs, similarity, width).where("doc_id is not null"))
    light = classes.groupBy("class_key", "doc_id", "node").agg(F.count("*").alias("rows"))
    stays = light.groupBy("class_key").agg(F.min(F.struct("doc_id", "node", "rows")).alias("x")).select("x.*")
    times = classes.groupBy("doc_id").agg((F.count("*") > 1).alias("again"))
    stays = written(stays.join(times, "doc_id"))
    key, node, rows, again, row = fresh(docs, "key", "node", "rows", "again", "row")
    # The words of a text are looked at only where its id has other rows.
    own = F.when(F.col(again), F.xxhash64(plain_words(F.col("text"))) == F.col(node)).otherwise(True)
    ids = stays.select(F.col("doc_id").alias(key), F.col("node").alias(node), F.col("rows").alias(rows), F.col("again").alias(again))
    chosen = docs.withColumn(key, F.col("doc_id").cast("long")).join(ids.hint("shuffle_hash"), key).where(own)
    whole = F.struct(*map(column, docs.columns))
    kept = chosen.where(F.col(rows) == 1).select(*map(column, docs.columns)).unionAll(docs.where("doc_id is null"))
    if stays.where("rows > 1").isEmpty():
        return kept
    one = chosen.where(F.col(rows) > 1).groupBy(key, node).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return kept.unionAll(one.select(*[column(row)[c].alias(c) for c in docs.columns]))


def op3(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
