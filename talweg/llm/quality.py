"""Quality classifier by compression with zstandard dictionaries.

One dictionary is trained on good and one on bad labelled texts. A text is compressed block by block with either,
every block on its own, so that the dictionaries count throughout a long text. Its measure is the difference between
the two sizes over their sum, beside it the compressed share; a logistic curve through both, which minds the length of
short texts, fitted on training texts that the dictionaries have not seen, makes the calibrated score.

Training takes at most `TRAIN_ROWS` labelled texts, those with the least hash of doc_id, on the driver.
Nulls and edges: a null text reads as empty; an empty text scores the share of good training rows, as does every
text if one class is missing from training (0 without any training rows).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
import zstandard

from talweg.llm.common import sigmoid

BLOCK, LEVEL, DICTIONARY, TRAIN_ROWS, SAMPLE_BYTES = 1024, 3, 110 << 10, 6000, 8 << 20


def text_blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """A dictionary for the texts, trained on their blocks in turn up to SAMPLE_BYTES."""
    parts, total = [], 0
    for t in texts:
        for b in text_blocks(t):
            parts.append(b)
            total += len(b)
        if total > SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(512, total // 8)), parts).as_bytes()
    except zstandard.ZstdError:  # too little text: the text itself is the dictionary
        return b"".join(parts)[-DICTIONARY:] or b"\n" * 8


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: np.ndarray
    prior: float
    _tools: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": []}

    def measures(self, texts: list[str]) -> np.ndarray:
        """Per text the normalised size difference (above 0: the good dictionary fits better) and the compressed share."""
        if not self._tools:
            for data in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                self._tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        g, b = (t.compress for t in self._tools)
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            parts = text_blocks(t)
            if parts:
                x, y, n = sum(len(g(p)) for p in parts), sum(len(b(p)) for p in parts), sum(map(len, parts))
                out[i] = (y - x) / (x + y), min(x, y) / n
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        x = shape(self.measures(texts), texts)
        empty = np.array([not t for t in texts], bool)
        return np.where(empty, self.prior, sigmoid(x @ self.curve) if self.curve.any() else self.prior)


def shape(m: np.ndarray, texts: list[str]) -> np.ndarray:
    """Terms of the curve: the measures, and how far they hold in short texts."""
    short = 1 / (1 + np.array([len(t) for t in texts], np.float64) / 100)
    d, share = 10 * m[:, 0], m[:, 1]
    return np.stack([np.ones(len(m)), d, share, d * share, share**2, short, d * short, share * short], 1)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return w


def fit(samples: list[tuple[str, int]]) -> Model:
    """A model from (text, label) samples: dictionaries from one half of each class, the curve from the other."""
    texts = {k: sorted((t for t, label in samples if label == k and t), key=lambda t: (xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")), t)) for k in (0, 1)}
    n = len(texts[0]) + len(texts[1])
    prior = (len(texts[1]) / n) if n else 0.0
    if min(map(len, texts.values())) < 2:
        return Model(b"\n" * 8, b"\n" * 8, np.zeros(8), prior)
    model = Model(dictionary(texts[1][::2]), dictionary(texts[0][::2]), np.zeros(8), prior)
    held = [(t, k) for k in (0, 1) for t in texts[k][1::2]]
    y = np.array([k for _, k in held], float)
    seen = [t for t, _ in held]
    model.curve = logistic(shape(model.measures(seen), seen), y)
    return model
