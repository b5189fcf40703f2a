"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the rows that the word and its first 4, 5, 6 and 8 characters hash to. Filters of widths
1, 2 and 3 slide over the whole text; each is max-pooled, and a logistic unit reads the pooled values (Kim 2014). The
first embedding column starts at the smoothed log-odds of a bucket's document frequency, the others at small noise.
Thresholds are calibrated by language on rows that the gradient didn't see; the language is guessed from function words
in the text itself, so no column but the text enters a score. A score is the logistic curve through the language's
threshold: score >= 0.5 means at or above it.

Words are hashed in executors; the driver gets numbers of at most ``max_rows`` labelled texts with ``max_words`` words
together, and fits the network to them. Every other labelled training row counts for the thresholds, over all data.

Defined cases: null and empty texts are scored as texts without words; repeated rows are scored each, and of a repeated
id the fit takes the shortest row; extra columns stay, but toxic_score and toxic_predicted are replaced; an empty table
gives no rows; without both labels in the training rows every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from gridloom.llm.common import agreed_labels, column, fold, fresh, sampled, table, written

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
#: What of a word is hashed: 0 is the word, other numbers its first characters.
PREFIXES = (0, 4, 5, 6, 8)
HASHES = len(PREFIXES)
#: Frequent function words by language, from public stop-word lists.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was"],
    "fr": ["le", "la", "les", "et", "des", "du", "une", "est", "pour", "dans"],
    "de": ["der", "die", "und", "das", "den", "ist", "nicht", "von", "mit", "ein"],
    "es": ["el", "los", "las", "del", "y", "una", "por", "con", "para", "es"],
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_WORD = re.compile(r"\w+")
_VOTE = {w: i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}


class Words:
    """Turns texts into word numbers; each distinct word is hashed once per batch of texts."""

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct words (n x HASHES), the words' numbers, each text's number of words, its language."""
        seen: dict[str, int] = {}
        flat: list[int] = []
        sizes, langs = [], []
        for t in texts:
            ws = _WORD.findall((t or "").lower())
            before = len(flat)
            flat += [seen.setdefault(w, len(seen)) for w in ws]
            sizes.append(len(flat) - before)
            votes = np.bincount([_VOTE[w] for w in ws if w in _VOTE], minlength=len(FUNCTION_WORDS))
            langs.append(int(votes.argmax()) if votes.any() else len(FUNCTION_WORDS))
        hashed = np.array([[zlib.crc32(f"{k}:{w[:k] if k else w}".encode()) % (BUCKETS - 1) + 1 for k in PREFIXES] for w in seen], dtype=np.int32).reshape(len(seen), HASHES)
        return hashed, np.array(flat, dtype=np.int32), np.array(sizes, dtype=np.int64), np.array(langs, dtype=np.int64)


@dataclass
class Cnn:
    emb: np.ndarray  # BUCKETS x DIM
    kernels: list[np.ndarray]  # width x DIM x FILTERS each
    bias: np.ndarray  # len(WIDTHS) x FILTERS
    out: np.ndarray  # len(WIDTHS) x FILTERS
    out_bias: float

    def pooled(self, e: np.ndarray, flat: np.ndarray, sizes: np.ndarray, winners: bool = False):
        """Max-pooled filter values: texts x widths x FILTERS. e holds a row per distinct word. Texts are padded with
        empty words at the end, so every window exists. With winners also where each maximum was reached, and the word at
        every place (len(e): an empty one)."""
        n, pad = len(sizes), max(WIDTHS) - 1
        starts = np.concatenate([[0], np.cumsum(sizes + pad + 1)])
        line = np.full(starts[-1] + pad, len(e), dtype=np.int64)
        line[np.arange(len(flat)) + np.repeat(starts[:-1] - (np.cumsum(sizes) - sizes), sizes)] = flat
        e = np.vstack([e, np.zeros((1, DIM), e.dtype)])
        top, where = np.zeros((n, len(WIDTHS), FILTERS), e.dtype), np.zeros((n, len(WIDTHS), FILTERS), np.int64)
        for k, width in enumerate(WIDTHS):
            z = sum((e @ self.kernels[k][j])[line[j : j + starts[-1]]] for j in range(width)) + self.bias[k].astype(e.dtype)
            top[:, k] = np.maximum.reduceat(z, starts[:-1], axis=0) if n else 0
            for f in range(FILTERS if winners else 0):
                hit = np.flatnonzero(z[:, f] == np.repeat(top[:, k, f], np.diff(starts)))
                where[:, k, f] = hit[np.searchsorted(hit, starts[:-1])]
        return (np.maximum(top, 0), where, line) if winners else np.maximum(top, 0)

    def logits(self, hashed: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        e = self.emb[hashed].sum(1) if len(hashed) else np.zeros((0, DIM), np.float32)
        return np.tensordot(self.pooled(e, flat, sizes), self.out, 2) + self.out_bias

    def gradients(self, e: np.ndarray, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Of the mean weighted logistic loss: by kernels, bias, out, out_bias and the distinct words' embeddings."""
        pooled, where, line = self.pooled(e, flat, sizes, winners=True)
        p = 1 / (1 + np.exp(-np.clip(np.tensordot(pooled, self.out, 2) + self.out_bias, -30, 30)))
        g = (p - y) * weight / len(y)
        back = g[:, None, None] * self.out * (pooled > 0)
        padded = np.vstack([e, np.zeros((1, DIM), e.dtype)])
        by_kernel, by_word = [np.zeros(k.shape) for k in self.kernels], np.zeros((len(e) + 1, DIM))
        for k, width in enumerate(WIDTHS):
            for j in range(width):
                w = line[where[:, k] + j]
                by_kernel[k][j] = np.einsum("tfd,tf->df", padded[w], back[:, k])
                np.add.at(by_word, w, np.einsum("tf,df->tfd", back[:, k], self.kernels[k][j]))
        return by_kernel, back.sum(0), np.tensordot(g, pooled, (0, 0)), g.sum(), by_word[:-1]


def best_cut(logits: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The threshold of the highest F1, halfway between neighbours; ties take the higher threshold. Logits differ, and each
    stands for n rows, hits of them toxic."""
    order = np.argsort(-logits, kind="stable")
    s, above, hit = logits[order], np.cumsum(n[order]), np.cumsum(hits[order])
    f1 = 2 * hit / (above + hits.sum())
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1)


def cuts(found: list, least: int = 12) -> np.ndarray:
    """A threshold for each language from rows (lang, logit, n, toxic); a language with fewer than ``least`` toxic rows
    or no clean one takes that of all languages together."""
    lang, logit, n, hits = (np.array([r[i] for r in found]) for i in range(4))
    values, at = np.unique(logit, return_inverse=True)
    out = np.full(len(LANGUAGES), best_cut(values, np.bincount(at, n), np.bincount(at, hits)))
    for k in range(len(LANGUAGES)):
        of = lang == k
        if hits[of].sum() >= least and (n[of] - hits[of]).sum() > 0:
            out[k] = best_cut(logit[of], n[of], hits[of])
    return out


def fit(hashed: np.ndarray, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.05, prior: float = 2.0, seed: int = 0) -> Cnn | None:
    """AdaGrad on the logistic loss, toxic texts weighted up to four times; None without both labels."""
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    ends = np.cumsum(sizes)
    texts = [flat[a:b] for a, b in zip(ends - sizes, ends, strict=True)]

    # Smoothed log-odds of document frequencies; buckets that no text has stay at 0.
    seen = np.zeros((2, BUCKETS))
    for i, t in enumerate(texts):
        seen[y[i], np.unique(hashed[np.unique(t)])] += 1
    odds = np.log((seen[1] + prior) / (y == 1).sum() / ((seen[0] + prior) / (y == 0).sum()))
    odds -= np.log((y == 0).sum() / (y == 1).sum())
    odds[seen.sum(0) == 0] = 0
    emb = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    emb[:, 0] = np.clip(odds / HASHES, -1.5, 1.5)
    kernels = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[0, 0, : FILTERS // 2] += 1.0
    net = Cnn(emb, kernels, np.full((len(WIDTHS), FILTERS), -0.5), np.full((len(WIDTHS), FILTERS), 0.1), -2.0)
    state = [np.full(x.shape, 0.1) for x in (*kernels, net.bias, net.out)]
    seen_emb, seen_b = np.full(BUCKETS, 0.1), 0.1
    weight = np.where(y == 1, min(4.0, (y == 0).sum() / (y == 1).sum()), 1.0)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            ids, own = np.unique(np.concatenate([texts[i] for i in at]), return_inverse=True)
            by_kernel, by_bias, by_out, by_out_bias, by_word = net.gradients(emb[hashed[ids]].sum(1), own.astype(np.int64), sizes[at], y[at], weight[at])
            for x, gr, st in zip((*kernels, net.bias, net.out), (*by_kernel, by_bias, by_out + 1e-4 * net.out), state, strict=True):
                st += gr * gr
                x -= (rate * gr / np.sqrt(st)).astype(x.dtype)
            seen_b += by_out_bias**2
            net.out_bias -= rate * by_out_bias / np.sqrt(seen_b)
            rows, step = hashed[ids].ravel(), np.repeat(by_word, HASHES, axis=0)
            moved = np.flatnonzero(np.abs(step).sum(1))
            np.add.at(seen_emb, rows[moved], (step[moved] ** 2).sum(1))
            np.add.at(emb, rows[moved], (-0.2 * rate * step[moved] / np.sqrt(seen_emb[rows[moved]])[:, None]).astype(np.float32))
    return net


def joined_words(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashed, flat and sizes of texts (ids, hashed) that were numbered one by one: words of equal hashes are one."""
    each = [np.frombuffer(r.hashed, dtype=np.int32).reshape(-1, HASHES) for r in rows]
    ids = [np.frombuffer(r.ids, dtype=np.int32) for r in rows]
    before = np.cumsum([0, *map(len, each)])
    hashed = np.concatenate([*each, np.zeros((0, HASHES), np.int32)])
    mark = np.zeros(len(hashed), np.uint64)
    for k in range(HASHES):
        mark += hashed[:, k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)
    _, first, to = np.unique(mark, return_index=True, return_inverse=True)
    to = to.astype(np.int32)
    flat = np.concatenate([*(to[x + b] for x, b in zip(ids, before[:-1], strict=True)), np.zeros(0, np.int32)])
    return hashed[first], flat, np.array([len(x) for x in ids], dtype=np.int64)


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in it:
        each = [words([t]) for t in batch.column("text").to_pylist()]
        cols = [pa.array([len(x[1]) for x in each], pa.int64()), pa.array([x[1].tobytes() for x in each], pa.binary()), pa.array([x[0].tobytes() for x in each], pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "label"]).columns, *cols], ["doc_id", "label", "n", "ids", "hashed"])


def _fit_on(docs: DataFrame, agreed: DataFrame, max_rows: int, max_words: int) -> tuple[Cnn | None, DataFrame]:
    """The network, and the ids (max_rows at most) that it was fitted to. Of labels that a second hash of the id sets aside
    for the thresholds none is among them. Texts of over an eighth of max_words come last."""
    own = sampled(agreed.where(F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) != 0), max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    found = texts.select("doc_id", "label", "text").mapInArrow(_hashed, "doc_id long, label int, n long, ids binary, hashed binary")
    sample = written(found.groupBy("doc_id").agg(F.min(F.struct("n", "ids", "hashed", "label")).alias("m")).select("doc_id", "m.*"))
    in_turn = Window.orderBy(F.col("n") > max_words // 8, F.xxhash64("doc_id"), "doc_id")  # over max_rows numbers at most
    used = sample.select("doc_id", "n").withColumn("upto", F.sum("n").over(in_turn)).where(F.col("upto") <= max_words).select("doc_id")
    rows = sorted(sample.join(F.broadcast(used), "doc_id").collect(), key=lambda r: r.doc_id)
    return fit(*joined_words(rows), np.array([r.label for r in rows], dtype=np.int64)), sample.select("doc_id")


def _logits(docs: DataFrame, net: Cnn, keep: list[str], out: list[str], text_bytes: int) -> DataFrame:
    """The kept columns and, under the names in ``out``, the logit (two decimals) and the language of each row."""
    net_var = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size: BUCKETS x DIM numbers and the filters

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words = net_var.value, Words()
        for batch in it:
            texts = batch.column("text").to_pylist()
            s, lang, at = np.zeros(len(texts)), np.zeros(len(texts), np.int32), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= text_bytes):
                    size += len(texts[to] or "")
                    to += 1
                hashed, flat, sizes, langs = words(texts[at:to])
                s[at:to], lang[at:to] = net.logits(hashed, flat, sizes), langs
                at = to
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(np.round(s, 2)), pa.array(lang)], [*keep, *out])

    schema = StructType([docs.schema[c] for c in keep]).add(out[0], DoubleType()).add(out[1], IntegerType())
    return docs.select(*map(column, dict.fromkeys([*keep, "text"]))).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = 6000, max_words: int = 2_000_000, text_bytes: int = 4 << 20, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all of docs by default) with toxic_score and toxic_predicted beside them. ``train`` admits
    label rows; labels must have doc_id and toxic. Texts are scored in slices of about text_bytes, each text whole."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("toxic_score", "toxic_predicted")]
    agreed = written(agreed_labels(labels, "toxic", train))
    net, fitted = _fit_on(docs, agreed, max_rows, max_words)
    if net is None:
        return docs.select(*map(column, keep), F.lit(0.0).alias("toxic_score"), F.lit(0).alias("toxic_predicted"))
    logit, lang = fresh(docs, "logit", "lang_no")
    rows = written(_logits(docs, net, keep if "doc_id" in keep else [*keep, "doc_id"], [logit, lang], text_bytes))
    # Thresholds from all labelled rows that the gradient didn't see: rounded logits, few next to the rows.
    known = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(logit).alias("logit"), F.col(lang).alias("lang")).join(agreed, "doc_id")

    def tallied(own: DataFrame) -> list:
        return own.groupBy("lang", "logit").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).collect()

    found = tallied(known.join(F.broadcast(fitted), "doc_id", "left_anti"))  # max_rows bounds what is broadcast
    if not sum(r.toxic for r in found) or not sum(r.n - r.toxic for r in found):
        found = tallied(known)  # too few rows to set some aside
    cut = F.get(F.array(*map(F.lit, cuts(found).tolist())), F.col(lang))
    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(logit) - cut))
    scored = rows.select(*map(column, keep), (1 / (1 + F.exp(-bounded))).alias("toxic_score"))
    return scored.withColumn("toxic_predicted", (F.col("toxic_score") >= 0.5).cast("int"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0, keep=["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
