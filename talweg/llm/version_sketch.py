"""Document fingerprints by an invertible Bloom lookup sketch of paragraph digests.

A text's paragraphs are its lines, long ones cut after words that their own hash chooses, one in `STRETCH`, and after
`LONGEST` words at last: a word put in changes the paragraph around it and no other. A paragraph's digest is the XXH64
of its text, seeded with how many equal ones came before it, so that digests make a set. A sketch has cells of a count, the
exclusive or of digests and of their checks; each digest goes to one cell of each third. Two sketches of a size
subtract cell by cell to the sketch of the digests that differ; peeling takes out, round by round, the digests that
stand alone in a cell. Where cells remain, sketches four times larger are made and subtracted, until all differing
digests are recovered. Likeness is twice the digests in common over those of both, 1 for two empty texts.

A fingerprint is the sketch of `CELLS` cells in base64: equal texts have equal ones, and fingerprints of texts that
differ in few paragraphs can be peeled without the texts.

Texts meet the next document's by one shuffle: rows are dealt to places by ranges of doc_id, each of about `PLACE_BYTES`
bytes or less, and to partitions of their own; ids that fill several places are split by the texts' hashes.

Nulls and edges: a null text reads as empty and an empty text has no digests; rows go by descending doc_id, equal ids
by the text's hash and then the text, null ids last; the next of the last row is the first row, and of a single row the
row itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import blocks, own_partitions

CELLS, GROWTH, STRETCH, LONGEST, BLOCK_CHARS, PLACE_BYTES = 12, 4, 8, 32, 1 << 19, 64 << 20


class _Ends(dict):
    """Whether a paragraph ends after a word."""

    def __missing__(self, word: bytes) -> bool:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 1) % STRETCH == 0
        return out


_ends = _Ends()


def paragraphs(line: bytes) -> list[bytes]:
    """The line in stretches of words that end where a word's hash says so."""
    words = line.split(b" ")
    if len(words) <= STRETCH:
        return [line] if line else []
    out, at = [], 0
    for end in [*(i + 1 for i, w in enumerate(words) if _ends[w]), len(words)]:
        while end - at > LONGEST:
            out.append(b" ".join(words[at : at + LONGEST]))
            at += LONGEST
        if end > at:
            out.append(b" ".join(words[at:end]))
            at = end
    return [p for p in out if p]


def digests(text: str) -> list[int]:
    """The digests of the text's paragraphs."""
    seen: dict[bytes, int] = {}
    out = []
    h = xxhash.xxh64_intdigest
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        for part in paragraphs(line):
            n = seen.get(part, 0)
            seen[part] = n + 1
            out.append(h(part, n))
    return out


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = keys ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 7) >> np.uint64(32)).astype(np.uint32)


class Cells:
    """Sketches of `size` cells (a multiple of 3), one for each of `n` owners."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        self.count = np.zeros(n * size, np.int32)
        self.key = np.zeros(n * size, np.uint64)
        self.check = np.zeros(n * size, np.uint32)

    def places(self, owner: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        third = self.size // 3
        return [owner * self.size + j * third + (_mixed(keys, j) % np.uint64(third)).astype(np.int64) for j in range(3)]

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        check = _check(keys)
        for at in self.places(owner, keys):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, other: Cells) -> Cells:
        out = Cells(self.n, self.size)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, sign) of what comes out, and whether an owner's cells are all empty after it."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.arange(len(self.count))
        while True:
            at = at[np.abs(self.count[at]) == 1]
            at = at[_check(self.key[at]) == self.check[at]]
            if not len(at):
                break
            owner, keys, sign = at // self.size, self.key[at], self.count[at]
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]
            owner, keys, sign = owner[new], keys[new], sign[new]
            self.add(owner, keys, -sign)
            found.append((owner, keys, sign))
            at = np.unique(np.concatenate(self.places(owner, keys)))
        left = ((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(self.n, self.size).any(1)
        return *(np.concatenate(x) if found else np.zeros(0, t) for x, t in zip(zip(*found, strict=True) if found else ((),) * 3, (np.int64, np.uint64, np.int32), strict=True)), ~left


def _owned(sets: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = [sets[i] for i in chosen]
    return np.repeat(np.arange(len(chosen)), [len(k) for k in keys]), np.concatenate([*keys, np.zeros(0, np.uint64)])


def differences(a: list[np.ndarray], b: list[np.ndarray], most_sizes: int = 40) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets (those only in a, those only in b), recovered from subtracted sketches."""
    out: list = [None] * len(a)
    # At least the difference of the sets' sizes has to come out, so smaller sketches need no try.
    least = np.array([abs(len(x) - len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    open_, size = np.arange(len(a)), CELLS
    for _ in range(most_sizes):
        now = open_[least[open_] <= size]
        for lo, hi in blocks([size] * len(now), 1 << 20):
            rows = now[lo:hi]
            left, right = Cells(len(rows), size), Cells(len(rows), size)
            left.add(*_owned(a, rows), 1)
            right.add(*_owned(b, rows), 1)
            owner, keys, sign, whole = left.minus(right).peel()
            order = np.argsort(owner, kind="stable")
            owner, keys, sign = owner[order], keys[order], sign[order]
            ends = np.searchsorted(owner, np.arange(len(rows) + 1))
            for k in np.flatnonzero(whole).tolist():
                part = slice(ends[k], ends[k + 1])
                out[rows[k]] = keys[part][sign[part] > 0], keys[part][sign[part] < 0]
        open_ = np.array([i for i in open_ if out[i] is None], np.int64)
        if not len(open_):
            return out
        size *= GROWTH
    raise RuntimeError("sketches do not peel")


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    found = differences(a, b)
    both = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    apart = np.array([len(x) + len(y) for x, y in found], np.float64)
    return np.where(both > 0, (both - apart) / np.maximum(both, 1), 1.0)


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    cells = Cells(len(sets), CELLS)
    cells.add(*_owned(sets, np.arange(len(sets))), 1)
    whole = np.zeros(len(cells.count), np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
    whole["count"], whole["key"], whole["check"] = cells.count, cells.key, cells.check
    width = CELLS * whole.dtype.itemsize
    data = whole.tobytes()
    return [base64.b64encode(data[i : i + width]).decode() for i in range(0, len(data), width)]


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _layout(docs: DataFrame, parts: int) -> tuple[np.ndarray, int, int]:
    """(bounds, places, of which for null ids): ascending ids that part the rows evenly; an id that fills several places is there several times."""
    n, nulls, size = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(parts, size // PLACE_BYTES + 1)
    at = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), max(10_000, 20 * parts)).alias("q")).first()[0] if at else []
    spare = -(-nulls * parts // max(n, 1))
    return np.sort(np.array(found or [], np.int64)), len(found or []) + 1 + spare, spare


def _share(h: np.ndarray, pieces: np.ndarray | int) -> np.ndarray:
    """Which of so many equal ranges of all hashes each hash is in."""
    return np.minimum(((h.astype(np.float64) / 2.0**64 + 0.5) * pieces).astype(np.int64), np.maximum(pieces, 1) - 1)


def _place(bounds: np.ndarray, spare: int):
    """Column function of (doc_id, hash): the row's place by descending id; null ids have the last places."""

    @F.arrow_udf("int")
    def place(doc_id: pa.Array, h: pa.Array) -> pa.Array:
        ids, h = doc_id.fill_null(0).to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
        above, from_ = len(bounds) - np.searchsorted(bounds, ids, "right"), len(bounds) - np.searchsorted(bounds, ids, "left")
        out = np.where(from_ > above, above + 1 + _share(h, from_ - above), above)
        none = doc_id.is_null().to_numpy(zero_copy_only=False)
        return pa.array(np.where(none, len(bounds) + 1 + _share(h, spare), out).astype(np.int32))

    return place


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(place, guest, doc_id, text) by place, each sorted; the first rows of a place are also guests of the one before."""
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    bounds, places, spare = _layout(placed, parts)
    placed = placed.withColumn("place", _place(bounds, spare)("doc_id", "h"))
    # One row for each place.
    first = F.min(F.struct((~F.col("doc_id").isNull()).alias("known"), F.bitwise_not("doc_id").alias("down"), "h"))
    heads = placed.groupBy("place").agg(first.alias("head")).orderBy("place").collect()
    before = {r["place"]: heads[i - 1]["place"] for i, r in enumerate(heads)}
    by_place = np.full((3, places), -1, np.int64)
    for r in heads:
        down = r["head"]["down"]
        by_place[:, r["place"]] = before[r["place"]], 0 if down is None else ~down, r["head"]["h"]

    @F.arrow_udf("int")
    def host(place: pa.Array, doc_id: pa.Array, h: pa.Array) -> pa.Array:
        to, ids, hashes = by_place[:, place.to_numpy(zero_copy_only=False)]
        head = (doc_id.fill_null(0).to_numpy(zero_copy_only=False) == ids) & (h.to_numpy(zero_copy_only=False) == hashes)
        return pa.array(to.astype(np.int32), mask=~head)

    keys = np.array(own_partitions(docs.sparkSession, places), np.int32)

    @F.arrow_udf("int")
    def key(place: pa.Array) -> pa.Array:
        return pa.array(keys[place.to_numpy(zero_copy_only=False)])

    own = F.struct("place", F.lit(0).alias("guest"))
    guest = F.struct(F.col("host").alias("place"), F.lit(1).alias("guest"))
    both = placed.withColumn("host", host("place", "doc_id", "h")).select(F.explode(F.when(F.col("host").isNotNull(), F.array(own, guest)).otherwise(F.array(own))).alias("at"), "doc_id", "h", "text")
    dealt = both.select("at.*", "doc_id", "h", "text").withColumn("key", key("place")).repartition(places, "key")
    return dealt.sortWithinPartitions("place", "guest", F.col("doc_id").desc_nulls_last(), "h", "text").drop("key", "h")


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str, str]]]:
    """Lists of (doc_id, text, next text) from rows of in_order."""
    held: tuple[int, int | None, str] | None = None
    for batch in batches:
        out = []
        for place, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("place", "guest", "doc_id", "text")), strict=True):
            if held is not None and held[0] == place:
                out.append((held[1], held[2], text))
            held = None if guest else (place, doc_id, text)
        yield out


def fingerprinted(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in with_next(batches):
            for lo, hi in blocks([len(r[1]) for r in rows], BLOCK_CHARS):
                ids, texts, after = zip(*rows[lo:hi], strict=True)
                changed = [edited(t, x) for t, x in zip(texts, after, strict=True)]
                own, new, following = ([np.array(digests(t), np.uint64) for t in ts] for ts in (texts, changed, after))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                     pa.array(fingerprints(own)), pa.array(fingerprints(new)), pa.array(likeness(own, new)), pa.array(likeness(own, following))],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return in_order(docs, parts).mapInArrow(run, schema)
