"""Language ID by hierarchical discrimination: the family first, then the language within it.

Families are told apart by one-versus-one linear support vector machines over hashed letter n-grams, and so are the
languages of a family. Every machine votes; ties go to the larger sum of margins, then to the name. The score is the
least calibrated probability among the machines that the winner won in its family contest and its language contest.

Training takes at most `PER_LANGUAGE` texts of each language, those with the least hash of doc_id, and runs on the
driver over their n-gram frequencies. A language without a known family is a family of its own.

Nulls and edges: a null text and one without letters are `und` with score 0; rows with null lang are not learned
from; with one learned language everything with letters gets it with score 1; with none, everything is `und`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.llm.char_grams import gram_ids, letters_only, lowered
from talweg.llm.common import blocks, platt, segment_sums, sigmoid, small, texts_of

#: Families of closely related languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
SIZES, BITS, PER_LANGUAGE, BLOCK_CHARS = (1, 2, 3), 12, 1000, 1 << 19
_SCALE = 30.0


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi in blocks([len(t) for t in texts], BLOCK_CHARS):
        yield lo, hi, *letters_only(*lowered(texts[lo:hi]))


def frequencies(texts: list[str]) -> np.ndarray:
    """Row by row the relative n-gram frequencies of the texts."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for lo, hi, symbols, offsets in _blocks(texts):
        row = np.repeat(np.arange(hi - lo), np.diff(offsets))
        for size in SIZES:
            ids = gram_ids(symbols, offsets, size, BITS)
            ok = ids < 1 << BITS
            out[lo:hi] += np.bincount((row[ok] << BITS) + ids[ok], minlength=(hi - lo) << BITS).reshape(hi - lo, -1)
    return out * (_SCALE / np.maximum(out.sum(1, keepdims=True), 1))


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge loss), by accelerated gradient steps."""
    sign = np.where(y, 1.0, -1.0).astype(np.float32)
    weight = (c / np.where(y, max(y.sum(), 1), max((~y).sum(), 1))).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb = w.copy(), b
    bound = 1 + 2 * c * 2 * float((x * x).sum(1).max() + 1)
    for t in range(steps):
        gap = np.maximum(0, 1 - sign * (x @ v + vb)) * sign * weight
        w2 = v - (v - 2 * x.T @ gap) / bound
        b2 = vb + 2 * float(gap.sum()) / bound
        k = t / (t + 3)
        v, vb, w, b = w2 + k * (w2 - w), b2 + k * (b2 - b), w2, b2
    return w, float(b)


@dataclass
class Contest:
    """One-versus-one machines between names: pairs of positions, weight columns, biases, calibration."""

    names: list[str]
    pairs: list[tuple[int, int]]
    columns: list[int]
    bias: list[float]
    curve: list[tuple[float, float]]

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner's position and score for each row of margins."""
        n = len(margins)
        votes, total, least = np.zeros((n, len(self.names))), np.zeros((n, len(self.names))), np.ones((n, len(self.names)))
        for (i, j), c, b, (s, t) in zip(self.pairs, self.columns, self.bias, self.curve, strict=True):
            m = margins[:, c] + b
            p = sigmoid(s * m + t)
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            total[:, i] += m
            total[:, j] -= m
            least[:, i] = np.minimum(least[:, i], p)
            least[:, j] = np.minimum(least[:, j], 1 - p)
        win = np.argmax(votes + np.tanh(total) * 0.49, 1)
        return win, least[np.arange(n), win]


@dataclass
class Model:
    weights: np.ndarray
    families: Contest
    languages: list[Contest]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        for lo, hi, symbols, offsets in _blocks(texts):
            # Relative frequencies times weights: the mean weight of a text's n-grams.
            sums, n = np.zeros((hi - lo, self.weights.shape[1])), np.zeros(hi - lo)
            for size in SIZES:
                sums += segment_sums(self.weights[gram_ids(symbols, offsets, size, BITS)], offsets)
                n += np.maximum(np.diff(offsets) - size + 1, 0)
            margins = sums * (_SCALE / np.maximum(n, 1))[:, None]
            letters = segment_sums((symbols != 32).astype(np.int64), offsets) > 0
            fam, sure = self.families.decide(margins)
            for f, contest in enumerate(self.languages):
                rows = np.flatnonzero((fam == f) & letters)
                lang, p = contest.decide(margins[rows])
                score[lo + rows] = np.minimum(p, sure[rows])
                for r, k in zip(rows.tolist(), lang.tolist(), strict=True):
                    pred[lo + r] = contest.names[k]
        return pred, score


def fit(samples: list[tuple[str, str]]) -> Model | None:
    """A model from (text, lang) samples; None without any."""
    samples = sorted((t, g) for t, g in samples if t)
    if not samples:
        return None
    x = frequencies([t for t, _ in samples])
    lang = np.array([g for _, g in samples])
    weights: list[np.ndarray] = []

    def contest(names: list[str], of: np.ndarray) -> Contest:
        out = Contest(names, [], [], [], [])
        for i, j in combinations(range(len(names)), 2):
            rows = np.flatnonzero((of == names[i]) | (of == names[j]))
            y = of[rows] == names[i]
            part = x[rows]
            w, b = svm(part, y)
            out.pairs.append((i, j))
            out.columns.append(len(weights))
            out.bias.append(b)
            out.curve.append(platt(part @ w + b, y.astype(float), l2=1.0))
            weights.append(w)
        return out

    of_family = np.array([family(g) for g in lang])
    members: dict[str, set[str]] = defaultdict(set)
    for g, f in zip(lang.tolist(), of_family.tolist(), strict=True):
        members[f].add(g)
    names = sorted(members)
    top = contest(names, of_family)
    below = [contest(sorted(members[f]), lang) for f in names]
    table = np.zeros(((1 << BITS) + 1, max(1, len(weights))), np.float32)
    if weights:
        table[:-1] = np.stack(weights, 1)
    return Model(table, top, below)


def training_sample(docs: DataFrame, chosen: Column, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most per_language texts of each language among the chosen rows, by the least hash of doc_id."""
    rows = docs.where(chosen & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    rank = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30))
    under = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, int(min(1.0, 1.1 * per_language / n) * (1 << 30)))])
    wide = rows.where(rank < F.element_at(under, F.col("lang"))).select("text", "lang", rank.alias("rank"))
    # Each language is bounded alone: what another has in excess takes nothing from it.
    place = F.row_number().over(W.partitionBy("lang").orderBy("rank", F.xxhash64("text")))
    return [(r["text"], r["lang"]) for r in wide.withColumn("place", place).where(F.col("place") <= per_language).toLocalIterator()]


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text):
            texts = texts_of(batch, text)
            pred, score = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
