"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A feature says whether a hashed n-gram of the lower-cased text is present. Its scale is the log of the ratio between
the smoothed shares that it has among toxic and among other training texts; the features with the most significant
ratios are kept and a logistic regression is fitted over the scaled features.

Training takes at most `TRAIN_ROWS` labelled texts, those with the least hash of doc_id, on the driver.
Nulls and edges: a null text reads as empty, and an empty text has the classifier's intercept as its score; labels
without a document and null labels are not learned from; labels that disagree about a document are all used; without
both classes every score is the share of toxic training rows (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm.char_grams import gram_ids, lowered
from talweg.llm.common import blocks, sigmoid, small, texts_of

SIZES, BITS, FEATURES, TRAIN_ROWS, BLOCK_CHARS = (3, 4, 5), 18, 1536, 6000, 1 << 19


def present(texts: list[str], table: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) positions present, block by block, sorted and without repeats; table maps hashes to features (-1: none)."""
    for lo, hi in blocks([len(t) for t in texts], BLOCK_CHARS):
        symbols, offsets = lowered(texts[lo:hi])
        symbols = symbols.astype(np.uint32)
        row = np.repeat(np.arange(lo, hi, dtype=np.int64), np.diff(offsets))
        keys = []
        for size in SIZES:
            ids = gram_ids(symbols, offsets, size, BITS)
            f = ids if table is None else table[ids]
            ok = np.flatnonzero((ids < 1 << BITS) if table is None else f >= 0)
            keys.append((row[ok] << BITS) + f[ok])
        key = np.unique(np.concatenate(keys))
        yield key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    table: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for row, f in present(texts, self.table):
            z += np.bincount(row, self.weights[f], len(texts))
        return sigmoid(z)


def fit(samples: list[tuple[str, int]], steps: int = 300, l2: float = 1.0, weight: float = 4.0) -> Model:
    """A model from (text, label) samples; the classes weigh alike, but toxic rows `weight` times that."""
    samples = sorted(samples)
    y = np.array([label for _, label in samples], bool)
    if not y.any() or y.all():
        share = y.mean() if len(y) else 0.0
        return Model(np.full((1 << BITS) + 1, -1, np.int32), np.zeros(1), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30)))
    texts = [t for t, _ in samples]
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for row, f in present(texts):
        p += np.bincount(f[y[row]], minlength=1 << BITS)
        q += np.bincount(f[~y[row]], minlength=1 << BITS)
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    sure = np.abs(ratio) / np.sqrt(1 / (p + 1) + 1 / (q + 1))
    chosen = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    table = np.full((1 << BITS) + 1, -1, np.int32)
    table[chosen] = np.arange(len(chosen))
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for row, f in present(texts, table):
        x[row, f] = ratio[chosen[f]]
    each = np.where(y, weight / y.mean(), 1 / (1 - y.mean())) / 2
    w, b = np.zeros(len(chosen)), 0.0
    v, vb = w.copy(), b
    # The curvature's greatest eigenvalue, by power steps, bounds the length of a gradient step.
    u, top = np.ones(len(chosen) + 1), 1.0
    for _ in range(20):
        along = x @ u[:-1].astype(np.float32) + u[-1]
        u = np.r_[x.T @ (each * along).astype(np.float32), (each * along).sum()]
        top = float(np.linalg.norm(u))
        u /= top
    bound = 0.25 * 1.1 * top + l2
    for t in range(steps):
        gap = each * (y - sigmoid(x @ v.astype(np.float32) + vb))
        w2, b2 = v + (x.T @ gap.astype(np.float32) - l2 * v) / bound, vb + float(gap.sum()) / bound
        k = t / (t + 3)
        v, vb, w, b = w2 + k * (w2 - w), b2 + k * (b2 - b), w2, b2
    return Model(table, w * ratio[chosen], float(b))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, chosen: Column, most: int) -> list[tuple[str, int]]:
    """(text, label) of at most `most` labelled documents among the chosen rows, those with the least hash of doc_id."""
    rank = F.pmod(F.xxhash64(F.lit("label"), "doc_id"), F.lit(1 << 40))
    few = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & chosen).select("doc_id", F.col(label).cast("int").alias("label"), rank.alias("rank")).orderBy("rank", "label").limit(most)
    # At most `most` ids and labels: a bounded side to broadcast.
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "label", "rank")
    return [(r["text"], r["label"]) for r in rows.orderBy("rank", "label").limit(most).toLocalIterator()]


def score(docs: DataFrame, model, name: str = "score", text: str = "text") -> DataFrame:
    """docs with a double column of scores; a column of that name is replaced."""
    keep = [c for c in docs.columns if c != name]
    schema = docs.select(*keep, F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(model.scores(texts_of(batch, text)), pa.float64())], [*keep, name])

    return docs.mapInArrow(run, schema)
