"""Quality classifier: Bradley-Terry ranking learnt from preference pairs.

A document's strength is a weighted sum of text features. Of a pair made of a document labelled 1 and one labelled
0 the former is preferred; the weights minimise the logistic loss of feature differences (Bradley and Terry 1952).
The weights are fitted on a bounded sample of the labelled rows (``max_rows``). The cut-off is the quantile of strengths
at the share of documents labelled 0, over all labelled training rows; the score is a logistic curve through it, so that
score >= 0.5 means a strength at or above that quantile.

Defined cases: null and empty texts get the features of an empty text and are scored; repeated rows are scored each, and
of a repeated id the fit takes the row whose features come first; extra columns are ignored; an empty table gives no
rows; without both labels in the training rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import agreed_labels, fold, sampled, table, written

#: Bytes counted together, each as a share of all bytes of a text.
BYTE_CLASSES = {"upper": bytes(range(65, 91)), "digit": b"0123456789", "symbol": b"#*$%&<>@^~_=+\\", "pipe": b"|", "shout": b"!?", "stop": b".,;:", "newline": b"\n"}
NAMES = ["log_words", "distinct_words", "top_word", "distinct_triples", "distinct_lines", "word_length", "no_letter", "no_lower", *BYTE_CLASSES]


def features(raw: bytes) -> list[float]:
    """The features named in NAMES, of a whole text in UTF-8."""
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0] + [0.0] * len(BYTE_CLASSES)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    own = [
        np.log1p(n), len(counts) / n, max(counts.values()) / n, triples / max(1, n - 2) if n > 2 else 1.0, len(set(lines)) / max(1, len(lines)),
        sum(map(len, words)) / n, sum(k for w, k in counts.items() if not w.lower() != w.upper()) / n, sum(k for w, k in counts.items() if w == w.upper() and w != w.lower() and len(w) > 1) / n,
    ]
    return own + [(len(raw) - len(raw.translate(None, c))) / size for c in BYTE_CLASSES.values()]


def expand(x: np.ndarray) -> np.ndarray:
    """Features and their square roots: a small share of odd signs tells more than its size says."""
    return np.hstack([x, np.sqrt(np.abs(x))])


@dataclass(frozen=True)
class BradleyTerry:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((expand(x) - self.mean) / self.scale, -6, 6) @ self.weights


def pair_differences(x: np.ndarray, y: np.ndarray, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differences of standardised features, the preferred document's first, with the mean and the scale."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    e = expand(x)
    mean, scale = e.mean(0), e.std(0) + 1e-9
    z = np.clip((e - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    return z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)], mean, scale


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 20_000, l2: float = 1e-3, seed: int = 0) -> BradleyTerry | None:
    """Newton's method on the pairs' logistic loss; None without both labels."""
    if not (y == 1).any() or not (y == 0).any():
        return None
    d, mean, scale = pair_differences(x, y, pairs, seed)
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(0) + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return BradleyTerry(mean, scale, w)


def quantile_cut(strengths: np.ndarray, rows: np.ndarray, n_bad: int) -> float:
    """The quantile at the share of label 0, halfway between the two strengths around it. Strengths ascend, and each
    stands for a number of rows."""
    upto = np.cumsum(rows)
    k = min(max(n_bad, 1), int(upto[-1]) - 1)
    below, above = np.searchsorted(upto, [k - 1, k], side="right")
    return float((strengths[below] + strengths[min(above, len(strengths) - 1)]) / 2)


def _batches(it: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in it:
        rows = [features(t or b"") for t in batch.column("text").to_pylist()]
        yield batch.select(extra), np.array(rows, dtype=float).reshape(len(rows), len(NAMES))


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = 6000) -> DataFrame:
    """doc_id, score and predicted of every row. ``train`` admits label rows; the weights are fitted on at most max_rows
    of them, those whose ids hash lowest, and the cut-off comes from all. labels must have doc_id and quality."""
    agreed = agreed_labels(labels, "quality", train)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def described(it):
        for ids, x in _batches(it, ["doc_id", "label"]):
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    chosen = raw.join(F.broadcast(sampled(agreed, max_rows)), "doc_id").select("doc_id", "label", "text")  # max_rows bounds it
    first = chosen.mapInArrow(described, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("m"))
    sample = sorted(first.select("doc_id", "m.label", "m.x").collect(), key=lambda r: r.doc_id)
    model = fit(np.array([r.x for r in sample], dtype=float).reshape(len(sample), len(NAMES)), np.array([r.label for r in sample]))

    def ranked(it):
        for ids, x in _batches(it, ["doc_id"]):
            yield pa.RecordBatch.from_arrays([ids.column(0), pa.array(np.zeros(len(x)) if model is None else np.round(model.strength(x), 6))], ["doc_id", "strength"])

    strengths = written(raw.mapInArrow(ranked, "doc_id long, strength double"))
    cut = 0.0
    if model is not None:
        # All labelled rows count: rounded strengths, few next to the rows, with the number of rows of each label.
        tallied = strengths.join(agreed, "doc_id").groupBy(F.round("strength", 3).alias("s"))
        found = tallied.agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == 0, 1)).alias("bad")).orderBy("s").collect()
        s, n, bad = (np.array([r[i] for r in found]) for i in range(3))
        cut = quantile_cut(s, n, int(bad.sum()))
    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("strength") - F.lit(cut)))
    scored = strengths.withColumn("score", 1 / (1 + F.exp(-bounded)))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1(spark, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
