"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Base spans are what the four patterns find, leftmost and without overlap within a kind. The field labels the words of
each line (runs without white space). Its features are the shapes of a word and of its neighbours, where runs of
characters of one class count once, the classes that a word mixes, and its numbers of characters and digits. It is
trained on the small labelled table that `training_table` makes, and decoded by Viterbi over many stretches at once. A
word whose `other` beats every other label by more than transitions can ever make good is `other` in any best path, so
only the stretches between such words need decoding; the result is that of decoding every line whole. Runs of equally
labelled words become spans, less punctuation at their ends, where they do not meet a base span.

Nulls and edges: a null text reads as empty and an empty text has no spans; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import blocks, code_points, small, texts_of

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("other", *KINDS)
BLOCK_CHARS, BITS, MIX_BITS = 1 << 19, 14, 11

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does, as the first part takes whole runs.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.groups()]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def training_table(rows: int = 900, seed: int = 7) -> list[list[tuple[str, str]]]:
    """Labelled lines: words with labels, made by rule."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def digits(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def word() -> str:
        w = "".join(r.choice(letters + "éüñ") for _ in range(r.choice([r.randint(1, 10), r.randint(1, 10), r.randint(11, 30)])))
        return r.choice([w, w, w, w, w.capitalize(), w.upper() + "!!", w + ",", w + ".", w + r.choice(["$$$", "###", "%%%", "&&&", "***"]), "|", f"({w})", f"{w}-{w}", f"{w}.{w}", f"{w},{w}", w + ",&&&", w + ".***", f"{w.capitalize()}.{w}", f"'{w}'", f"{w}/{w}"])

    def number() -> str:
        return r.choice([digits(r.randint(1, 2)), digits(r.randint(1, 7)), "19" + digits(2), f"{digits(1)}.{digits(2)}", f"{digits(2)}%", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"${digits(3)}", f"{digits(1)},{digits(3)},{digits(3)}", f"({digits(4)})", f"#{digits(3)}", f"{digits(3)}-{digits(3)}"])

    def email() -> list[str]:
        name = "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
        host = "".join(r.choice(letters) for _ in range(r.randint(2, 8)))
        return [r.choice([f"{name}@{host}.com", f"{name}.{host}@{host}.example", f"{name}{digits(2)}@{host}.org", f"{name}_{host}@{host}.co.uk"])]

    def phone() -> list[str]:
        return r.choice([[f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(2), digits(4), digits(4)], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"]])

    def card() -> list[str]:
        return r.choice([[digits(4) for _ in range(4)], [digits(16)], ["-".join(digits(4) for _ in range(4))]])

    def secret() -> list[str]:
        key = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40])))
        mixed = "".join(r.choice("0123456789" + letters + letters.upper()) for _ in range(r.choice([20, 24, 36])))
        access = "AKIA" + "".join(r.choice("0123456789" + letters.upper()) for _ in range(16))
        return [r.choice([f'"{key}"', key, f'"{mixed}"', f"sk_{mixed}", access, access])]

    def ip() -> list[str]:
        return [".".join(str(r.randint(0, 255)) for _ in range(4))]

    makers = {"email": email, "phone": phone, "card": card, "secret": secret, "ip": ip}
    out = []
    for _ in range(rows):
        line: list[tuple[str, str]] = [(word(), "other") for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 2)):
            kind = r.choice(KINDS)
            if kind == "secret" and r.random() < 0.7:
                line += [(r.choice(["token", "key", "secret", "password", "api_key"]), "other"), ("=", "other")]
            found = makers[kind]()
            tail = r.choice(["", "", "", ".", ",", "$$$", "###"])
            line += [(w + tail * (w is found[-1]), kind) for w in found]
            line += [(word(), "other") for _ in range(r.randint(1, 5))]
            if r.random() < 0.6:
                line += [(number() + r.choice(["", "", ".", ",", "!!"]), "other"), *[(word(), "other")] * r.randint(0, 1)]
        out.append(line or [(number(), "other")])
    return out


@cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 white space, 1 line feed, 2 digit, 3 upper, 4 other letters, then signs of their own, 31 others."""
    out = np.full(0x110000, 31, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if ch.isspace():
            out[c] = 0
        elif kind == "Nd" and c < 128:
            out[c] = 2
        elif kind[0] in "LM":
            out[c] = 3 if kind == "Lu" else 4
    for k, ch in enumerate("@.-+():/_=\"'#"):
        out[ord(ch)] = 5 + k
    out[10] = 1
    return out


@dataclass
class Words:
    """Words of a block of texts: bounds in the block's code points, features, and whether a line begins with it."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    size: np.ndarray
    mix: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray) -> Words:
        """codes: texts that each end with a line feed."""
        kind = _classes()[codes]
        inside = kind > 1
        edge = np.diff(np.r_[False, inside, False].astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            none = np.zeros(0, np.int64)
            return cls(none, none, none, none, none, np.zeros(0, bool))
        fresh = np.r_[True, kind[1:] != kind[:-1]] & inside
        # Shape: a polynomial hash of the classes met, each run of a class counted once.
        rank = np.cumsum(fresh)
        word = np.repeat(np.arange(len(start)), end - start)
        at = np.flatnonzero(inside)
        power = (rank[at] - rank[start][word]).astype(np.uint64)
        terms = np.where(fresh[at], (kind[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * (np.uint64(2) * power + np.uint64(1)) ** np.uint64(3), np.uint64(0))
        from_word = np.r_[0, np.cumsum(end - start)[:-1]]
        shape = np.add.reduceat(terms, from_word) * np.uint64(0xD6E8FEB86659FD93)
        shape = (shape >> np.uint64(64 - BITS)).astype(np.int64)
        digits = np.add.reduceat((kind[at] == 2).astype(np.int64), from_word)
        size = np.minimum(end - start, 47) * 24 + np.minimum(digits, 23)
        mix = np.bitwise_or.reduceat(np.uint32(1) << kind[at].astype(np.uint32), from_word) * np.uint32(0x9E3779B1)
        lines = np.cumsum(kind == 1)[start]
        return cls(start, end, shape, size, (mix >> np.uint32(32 - MIX_BITS)).astype(np.int64), np.r_[True, lines[1:] != lines[:-1]])


N_SIZE = 48 * 24


@dataclass
class Field:
    """Weights by label: of every word, of its shape, size, classes, and its neighbours' shapes; transitions; both ends are `other`."""

    bias: np.ndarray
    own: np.ndarray
    size: np.ndarray
    mix: np.ndarray
    before: np.ndarray
    after: np.ndarray
    move: np.ndarray

    @classmethod
    def empty(cls) -> Field:
        n = len(LABELS)
        return cls(np.zeros(n), np.zeros((1 << BITS, n)), np.zeros((N_SIZE, n)), np.zeros((1 << MIX_BITS, n)), np.zeros(((1 << BITS) + 1, n)), np.zeros(((1 << BITS) + 1, n)), np.zeros((n, n)))

    def neighbours(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        none = 1 << BITS
        before = np.where(w.first, none, np.r_[none, w.shape[:-1]])
        after = np.where(np.r_[w.first[1:], True], none, np.r_[w.shape[1:], none])
        return before, after

    def scores(self, w: Words) -> np.ndarray:
        before, after = self.neighbours(w)
        return self.bias + self.own[w.shape] + self.size[w.size] + self.mix[w.mix] + self.before[before] + self.after[after]

    def label(self, w: Words) -> np.ndarray:
        """The best label of each word, by Viterbi along each line."""
        out = np.zeros(len(w.shape), np.int64)
        if not len(out):
            return out
        e = self.scores(w)
        m = self.move
        # The most that transitions can gain by leaving `other` for one word between any two neighbours.
        gain = max(float((m[:, y][:, None] + m[y, :][None, :] - m[:, 0][:, None] - m[0, :][None, :]).max()) for y in range(1, len(LABELS)))
        unsure = np.flatnonzero(e[:, 0] - e[:, 1:].max(1) <= gain)
        if not len(unsure):
            return out
        # Stretches of unsure words of a line; on both sides there is a sure `other` or the line's end.
        starts = np.flatnonzero(np.r_[True, (np.diff(unsure) != 1) | w.first[unsure[1:]]])
        length = np.diff(np.r_[starts, len(unsure)])
        order = np.argsort(-length, kind="stable")
        begin, length = unsure[starts[order]], length[order]
        best = e[begin] + m[0]
        back: list[np.ndarray] = []
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, "left"))
            step = best[:live, :, None] + m[None]
            came = step.argmax(1)
            best[:live] = np.take_along_axis(step, came[:, None, :], 1)[:, 0] + e[begin[:live] + t]
            back.append(came)
        state = (best + m[:, 0]).argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, "left"))
            out[begin[:live] + t] = state[:live]
            if t:
                state[:live] = back[t - 1][np.arange(live), state[:live]]
        return out


def fit(table: list[list[tuple[str, str]]], steps: int = 150, rate: float = 0.15, l2: float = 0.01) -> Field:
    """A field from labelled lines, by gradient steps on the conditional likelihood."""
    w = Words.of(code_points(["".join(" ".join(x for x, _ in line) + "\n" for line in table)])[0])
    y = np.array([LABELS.index(label) for line in table for _, label in line])
    n, line = len(LABELS), np.cumsum(w.first) - 1
    place = np.arange(len(y)) - np.flatnonzero(w.first)[line]
    rows, width = int(line[-1]) + 1, int(place.max()) + 1
    real = np.zeros((rows, width), bool)
    real[line, place] = True
    last = real.sum(1) - 1
    field = Field.empty()
    before, after = field.neighbours(w)
    index = [np.zeros(len(y), np.int64), w.shape, w.size, w.mix, before, after]
    names = ["bias", "own", "size", "mix", "before", "after"]
    step_of = {k: (np.zeros_like(getattr(field, k)), np.zeros_like(getattr(field, k))) for k in [*names, "move"]}
    hot = np.eye(n)[y]
    padded = np.zeros((rows, width + 2), np.int64)
    padded[line, place + 1] = y
    seen_move = np.zeros((n, n))
    for t in range(width + 1):
        on = t <= last + 1
        np.add.at(seen_move, (padded[on, t], padded[on, t + 1]), 1)

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for step in range(1, steps + 1):
        e = np.zeros((rows, width, n))
        e[line, place] = field.scores(w)
        m = field.move
        forward, backward = np.zeros((rows, width, n)), np.zeros((rows, width, n))
        forward[:, 0] = e[:, 0] + m[0]
        for t in range(1, width):
            forward[:, t] = np.where(real[:, t, None], log_sum(forward[:, t - 1, :, None] + m, 1) + e[:, t], forward[:, t - 1])
        backward[:, width - 1] = m[:, 0]
        for t in range(width - 2, -1, -1):
            backward[:, t] = np.where(real[:, t + 1, None], log_sum(m[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2), m[:, 0])
        z = log_sum(forward[:, -1] + m[:, 0], 1)
        p = np.exp(forward + backward - z[:, None, None])
        expected = np.zeros((n, n))
        expected[0] += p[:, 0].sum(0)
        expected[:, 0] += p[np.arange(rows), last].sum(0)
        for t in range(1, width):
            on = real[:, t]
            expected += np.exp(forward[on, t - 1, :, None] + m + (e[on, t] + backward[on, t])[:, None, :] - z[on, None, None]).sum(0)
        gap = hot - p[line, place]
        for k, at in zip([*names, "move"], [*index, None], strict=True):
            value = getattr(field, k)
            if k == "move":
                g = seen_move - expected
            elif k == "bias":
                g = gap.sum(0)
            else:
                g = np.zeros_like(value)
                np.add.at(g, at, gap)
            g -= l2 * value
            first, second = step_of[k]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return field


_ENDS = "".join(map(chr, range(33, 127)))
_TRIM_LEFT = "".join(c for c in _ENDS if not c.isalnum() and c not in "+(")
_TRIM_RIGHT = "".join(c for c in _ENDS if not c.isalnum())


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans that the field finds in each text, by start."""
    out: list[list[Span]] = [[] for _ in texts]
    for lo, hi in blocks([len(t) + 1 for t in texts], BLOCK_CHARS):
        codes, offsets = code_points([t + "\n" for t in texts[lo:hi]])
        w = Words.of(codes)
        label = field.label(w)
        at = np.flatnonzero(label)
        if not len(at):
            continue
        joined = np.r_[False, (np.diff(at) == 1) & (label[at[1:]] == label[at[:-1]]) & ~w.first[at[1:]]]
        firsts = at[~joined]
        lasts = at[np.r_[~joined[1:], True]]
        doc = np.searchsorted(offsets, w.start[firsts], "right") - 1
        for k, a, b, d in zip(label[firsts].tolist(), w.start[firsts].tolist(), w.end[lasts].tolist(), doc.tolist(), strict=True):
            a, b = a - int(offsets[d]), b - int(offsets[d])
            part = texts[lo + d][a:b]
            a += len(part) - len(part.lstrip(_TRIM_LEFT))
            b -= len(part) - len(part.rstrip(_TRIM_RIGHT))
            if a < b:
                out[lo + d].append((LABELS[k], a, b))
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans; both by kind as listed, then start."""
    out = []
    for text, extra in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        ends = np.array([b for _, b in taken])
        tops = np.maximum.accumulate(ends) if len(ends) else ends
        starts = [a for a, _ in taken]
        whole = list(base)
        for kind, a, b in extra:
            before = int(np.searchsorted(starts, b, "left"))  # base spans that begin before this one ends
            if not before or tops[before - 1] <= a:
                whole.append((kind, a, b))
        whole.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append((base, whole))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256 and spans of every document."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = all_spans(texts_of(batch, "text"), field)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:4]]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([joined(s) for _, s in found], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
