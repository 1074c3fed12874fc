"""LM scoring by a probabilistic suffix tree over words, beside add-one unigram scores.

Tokens are lower-cased words and one end for each text. A node is a context of whole words. Contexts of one word are
tried first, and those that a retained context is the suffix of after that, as long as any is retained: depth and
number of contexts follow the counts. A context met `LEAST` times or more is retained if its next
words diverge from what its suffix predicts: the log-likelihood ratio over the next words met twice or more, and all
others together, exceeds for each of these the logarithm of the number of tokens. In a retained context the words met
twice or more count; tokens met once there count for the suffix, whose smoothed prediction has their weight and that of
as many tokens as there are words met more often. A token is so predicted by the longest retained suffix of what
precedes it, and at last by the words' shares; unknown words have together the share of the words met once. Contexts
have at most as many words as the logarithm of the number of tokens to the base `LEAST`, so they grow with the corpus.

All counts are over all training texts, whose tokens are packed into blocks of bytes once and read from these by every
pass. Words and contexts are 64-bit hashes. Each level of contexts is counted in two steps: a task counts what it reads and
deals the counts by context, packed into blocks of bytes; of contexts that end with a very frequent word the counts are
dealt by next word too. A block's counts are summed by the task that gets it, whose share is bounded by `DEAL` tokens.
Divergence tests and smoothing are joins and sums over what was met twice.

A text's score is a sum: a retained context adds the logarithm of what it leaves to its suffix, a run of a context and
a next word that was met what it differs from that. The most frequent words and runs, at most `HOT` and `HOT_RUNS`,
go to every task, with filters of at most 2**`FILTER_BITS` bits that tell most keys that are in no table; what else a
document holds is dealt by key, packed like the counts, to the parts of the tables that have it, and the sums go back.

Nulls and edges: a null text reads as empty and has the end alone as token; rows equal in every column are each
answered; a null doc_id counts as the empty text for the training split; without training texts every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import blocks, cut, drop, own_partitions, small

LEAST, SHARE = 8, 0.75
HOT, HOT_RUNS, CODED, FILTER_BITS = 1 << 18, 1 << 19, 1 << 16, 28
FLUSH, DEAL, THIN, BLOCK_BYTES, BLOCK_TOKENS = 1 << 20, 1 << 22, 32, 1 << 20, 1 << 18
PAGE = 1 << 15
END = np.uint64(0x5851F42D4C957F2D)
#: Texts take less memory beside what a task holds; parts of tables of at most so many bytes are joined without being sorted.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(64 << 20)}
#: Bits of a context that its place does not hang on.
LOW = np.uint64((1 << 24) - 1)
#: Stands for all next words that are met once in a context's suffix, and so in the context.
OTHER = np.uint64(0x2545F4914F6CDD1D)
_BLANK = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: By a number of bytes, the bits of so many; words of more bytes than `_LONG` are hashed one by one.
_MASKS, _LONG = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64), 64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def longer(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of the runs with one more word before them."""
    return mixed((run * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0x632BE59BD9B4E019)))


def as_context(run: np.ndarray) -> np.ndarray:
    """Keys of contexts, apart from those of the same words as a run."""
    h = (run ^ np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(texts: pa.Array) -> np.ndarray:
    """How many bytes each text has; null has none."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)


def hashes(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token of each text, and the number of tokens of each text; null reads as empty."""
    parts = texts.cast(pa.binary()) if isinstance(texts, pa.Array) else pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary())
    whole = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), pc.fill_null(parts, b""))
    buffer = (b" " + pc.binary_join(whole, b" ")[0].as_py() + b" " * 9).translate(_BLANK)
    solid = np.frombuffer(buffer, np.uint8) != 32
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    # Eight bytes of every word at a time; few words have more.
    eights = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))
    h = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = mixed(h ^ (eights[starts] & _MASKS[np.minimum(sizes, 8)]) * np.uint64(0xD6E8FEB86659FD93))
    live, done = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
    while len(live):
        piece = eights[starts[live] + done] & _MASKS[np.minimum(sizes[live] - done, 8)]
        h[live] = mixed(h[live] * np.uint64(0x94D049BB133111EB) ^ piece)
        done += 8
        live = live[sizes[live] > done]
    for k in np.flatnonzero(sizes > _LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(buffer[starts[k] : starts[k] + sizes[k]], 42)
    ends = np.cumsum(text_bytes(parts) + 1)
    upto = np.searchsorted(starts, ends)
    return np.insert(h, upto, END), np.diff(np.r_[0, upto]) + 1


def places(sizes: np.ndarray) -> np.ndarray:
    """The place of each token in its text."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sums of n, a place of each)."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(key) else n[:0], order[first]


def _rows(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for lo in range(0, n, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in columns.values()], list(columns))


# Tokens of training texts, made once for all passes over them


def packed_tokens(h: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Tokens of texts as a block of bytes: each word is there once, and tokens are places among them."""
    words, at = np.unique(h, return_inverse=True)
    body = np.array([len(words), len(h), len(sizes)], "<u8").tobytes() + _near(words) + _wide(at) + _wide(sizes)
    return pa.RecordBatch.from_arrays([pa.array([zstandard.compress(body, 1)], pa.binary())], ["tokens"])


def token_places(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted words, each token's place among them, how many tokens each text has) of a block."""
    data = zstandard.decompress(block)
    a, n, k = np.frombuffer(data[:24], "<u8").tolist()
    ends = np.cumsum([24, 8 * a, 4 * n, 4 * k]).tolist()
    words, at, sizes = (data[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False))
    return _apart(words), _narrow(at), _narrow(sizes).astype(np.int64)


def token_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """All tokens of the texts as blocks of bytes of about `FLUSH` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        some = 0
        for h, sizes in tokens(batches, text):
            held.append((h, sizes))
            some += len(h)
            if some > FLUSH:
                yield packed_tokens(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, some = [], 0
        if some:
            yield packed_tokens(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return docs.select(text).mapInArrow(run, "tokens binary")


def corpus_counts(texts: DataFrame, parts: int) -> DataFrame:
    """(key, n): counts of the tokens in blocks; a task deals its counts by key, packed, to the task that sums them."""
    names = own_partitions(texts.sparkSession, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        some = 0

        def dealt(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            ends = _parts(key, parts)
            rows = [(names[k], zstandard.compress(_near(key[ends[k] : ends[k + 1]]) + _near(n[ends[k] : ends[k + 1]].view(np.uint64)), 1)) for k in np.flatnonzero(np.diff(ends)).tolist()]
            place, block = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(block, pa.binary())], ["place", "block"])

        for batch in batches:
            for block in batch.column("tokens").to_pylist():
                words, at, _ = token_places(block)
                held.append((words, np.bincount(at, minlength=len(words))))
                some += len(words)
                if some > FLUSH:
                    key, n, _ = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, some = [(key, n)], len(key)
                    if some > FLUSH // 2:
                        yield dealt(key, n)
                        held, some = [], 0
        if held:
            key, n, _ = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield dealt(key, n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for data in map(zstandard.decompress, batch.column("block").to_pylist()):
                held.append((_apart(data[: len(data) // 2]), _apart(data[len(data) // 2 :]).view(np.int64)))
        if held:
            key, n, _ = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield from _rows({"key": key.view(np.int64), "n": n})

    return texts.mapInArrow(run, "place int, block binary").repartition(parts, "place").mapInArrow(merge, "key long, n long")


# Filters


def _at(key: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The place of a key's bit: both bits are in one word of 64, which is looked up once."""
    return ((key & np.uint64((size >> 6) - 1)) << np.uint64(6) | (key >> np.uint64(52 + 6 * probe)) & np.uint64(63)).astype(np.int64)


def _marks(key: np.ndarray) -> np.ndarray:
    """Both bits of each key in its word."""
    one, low = np.uint64(1), np.uint64(63)
    return one << (key >> np.uint64(52) & low) | one << (key >> np.uint64(58))


def holds(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether keys may be among those of a filter."""
    words, marks = bits.view("<u8"), _marks(key)
    return words[(key & np.uint64(len(words) - 1)).view(np.int64)] & marks == marks


def no_bits(n: int) -> np.ndarray:
    """An empty filter for n keys."""
    return np.zeros(1 << min(FILTER_BITS, max(16, (16 * n).bit_length())) - 3, np.uint8)


def bits_of(keys: DataFrame, out: np.ndarray) -> np.ndarray:
    """The filter `out` with two bits for each of the column key. A task marks what it reads in a filter of its own, of which
    the pages that have bits are dealt and put together."""
    size = len(out)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size >> 3, "<u8")
        for b in batches:
            key = b.column("key").to_numpy().view(np.uint64)
            np.bitwise_or.at(words, (key & np.uint64(len(words) - 1)).view(np.int64), _marks(key))
        pages = words.reshape(-1, min(len(words), PAGE >> 3))
        for k in np.flatnonzero(pages.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(pages[k].tobytes(), 1)], pa.binary())], ["page", "bits"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            for k, bits in zip(b.column("page").to_pylist(), b.column("bits").to_pylist(), strict=True):
                pages[k] = pages[k] | unpacked(bits) if k in pages else unpacked(bits)
        for k, bits in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(bits)], pa.binary())], ["page", "bits"])

    form = "page int, bits binary"
    found = keys.select("key").mapInArrow(mark, form).repartition("page").mapInArrow(together, form).toArrow()
    for k, bits in zip(found.column("page").to_pylist(), found.column("bits").to_pylist(), strict=True):
        page = unpacked(bits)
        out[k * len(page) : (k + 1) * len(page)] |= page
    return out


def packed(bits: np.ndarray) -> bytes:
    return zstandard.compress(bits.tobytes(), 1)


def unpacked(bits: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(bits), np.uint8)


# Levels of contexts


def levels(h: np.ndarray, place: np.ndarray, grown) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, token, context, suffix's context) for contexts of one word and more, onward where grown(context)."""
    at, depth = np.flatnonzero(place >= 1), 1
    context = h[at - 1]
    suffix = context
    while len(at):
        yield depth, at, context, suffix
        on = (place[at] > depth) & grown(context)
        at, suffix = at[on], context[on]
        depth += 1
        context = longer(suffix, h[at - depth])


def _wide(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, which compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _narrow(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _near(keys: np.ndarray) -> bytes:
    """Keys by planes of their differences, which are short among sorted ones."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _apart(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def _coded(keys: np.ndarray, known: np.ndarray) -> list[bytes]:
    """Keys by their places among sorted known ones, which are short, and the others by their differences."""
    i, there = _found(known, keys)
    return [_wide(np.where(there, i + 1, 0)), _near(keys[~there])]


def _decoded(places: bytes, others: bytes, known: np.ndarray) -> np.ndarray:
    i = _narrow(places).astype(np.int64)
    out = known[np.maximum(i - 1, 0)] if len(known) else np.zeros(len(i), np.uint64)
    out[i == 0] = _apart(others)
    return out


def pack(context: np.ndarray, suffix: np.ndarray, word: np.ndarray, n: np.ndarray, known: np.ndarray, depth: int = 1) -> bytes:
    """Counts n of words after contexts of `depth` words as a block of bytes: each context and each word is there once, known words by their place."""
    if (context[1:] < context[:-1]).any():
        order = np.argsort(context)
        context, suffix, word, n = context[order], suffix[order], word[order], n[order]
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    words, at = np.unique(word, return_inverse=True)
    body = [*_coded(context[first], known[: len(known) * (depth == 1)]), *_coded(suffix[first], known[: len(known) * (depth <= 2)]), *_coded(words, known), _wide(np.diff(np.r_[first, len(context)])), _wide(at), _wide(n)]
    return zstandard.compress(np.array([len(x) for x in body], "<u8").tobytes() + b"".join(body), 1)


def unpack(block: bytes, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.decompress(block)
    ends = np.cumsum(np.r_[72, np.frombuffer(data[:72], "<u8").astype(np.int64)]).tolist()
    x = [data[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]
    context, suffix, words = (_decoded(x[k], x[k + 1], known) for k in (0, 2, 4))
    many = _narrow(x[6])
    return np.repeat(context, many), np.repeat(suffix, many), words[_narrow(x[7])], _narrow(x[8]).astype(np.int64)


def level_counts(docs: DataFrame, depth: int, given, parts: int, text: str = "text") -> DataFrame:
    """(run, context, suffix, n) of runs met twice or more whose context has `depth` words and may be retained, and under
    a null run the tokens after each such context; contexts that are dealt by next word are there in parts. After a context
    of two words come as many tokens as it was met as a run, so of these there are only runs that may be met twice."""
    keys, whole = own_partitions(docs.sparkSession, parts), "tokens" in docs.columns
    bounds = np.array([(k << 64) // parts for k in range(parts)], np.uint64) & ~LOW

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, bits, met = (unpacked(x) for x in given.value[:3])
        frequent, known = given.value[3:]
        held: list[list[np.ndarray]] = []

        def deal(part: bool, near: np.ndarray, context: np.ndarray, suffix: np.ndarray, word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends = np.r_[np.searchsorted(near, bounds), len(near)]
            for k in np.flatnonzero(np.diff(ends)).tolist():
                of = slice(ends[k], ends[k + 1])
                block = pack(context[of], suffix[of], word[of], n[of], known, depth)
                yield pa.RecordBatch.from_arrays([pa.array([keys[k]], pa.int32()), pa.array([part]), pa.array([block], pa.binary())], ["place", "part", "block"])

        def blocks_of() -> Iterator[pa.RecordBatch]:
            context, word, dealt, suffix = (_taken(held, k) for k in range(4))
            held.clear()
            run = longer(word, context)
            for part, rows in ((False, np.flatnonzero(~dealt)), (True, np.flatnonzero(dealt))):
                # One order for places, contexts and runs; a run that it should leave in two pieces is put together by merge().
                near = run[rows] if part else context[rows] & ~LOW | run[rows] & LOW
                order = np.argsort(near)
                near, rows = near[order], rows[order]
                first = np.flatnonzero(np.r_[True, run[rows[1:]] != run[rows[:-1]]]) if len(rows) else rows
                n = np.diff(np.r_[first, len(rows)])
                rows = rows[first]
                yield from deal(part, near[first], context[rows], suffix[rows] if depth > 1 else context[rows], word[rows], n)

        def pairs_of(words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
            """What blocks_of() yields at depth 1, of a block of tokens: two places are one number, sorted as the words are."""
            later = np.ones(len(at), bool)
            later[np.cumsum(sizes) - sizes] = False
            i = np.flatnonzero(later)
            i = i[holds(common, words)[at[i - 1]]]
            pair = at[i - 1].astype(np.uint64) << np.uint64(32) | at[i]
            pair.sort()
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else i
            n, pair = np.diff(np.r_[first, len(pair)]), pair[first]
            before, after = (pair >> np.uint64(32)).view(np.int64), (pair & np.uint64((1 << 32) - 1)).view(np.int64)
            dealt = np.isin(words, frequent)[before]
            context, word = words[before], words[after]
            yield from deal(False, context[~dealt], context[~dealt], context[~dealt], word[~dealt], n[~dealt])
            context, word, n = context[dealt], word[dealt], n[dealt]
            run = longer(word, context)
            order = np.argsort(run)
            context = context[order]
            yield from deal(True, run[order], context, context, word[order], n[order])

        if depth == 1 and whole:
            for batch in batches:
                for block in batch.column("tokens").to_pylist():
                    yield from pairs_of(*token_places(block))
            return
        some = 0
        for h, sizes in tokens(batches, text):
            # A context of two words is no more frequent than its words as a run of the level before.
            may = lambda c: holds(bits, as_context(c))
            for d, at, context, suffix in levels(h, places(sizes), may):
                if d == depth:
                    good = np.flatnonzero(holds(met, context) if d == 2 else holds(common, h[at - d]))
                    word = h[at[good]]
                    if d > 1:  # a run is met no oftener than the one without its first word
                        twice = holds(bits, longer(word, suffix[good]))
                        if d == 2:
                            good, word = good[twice], word[twice]
                        else:
                            word = np.where(twice, word, OTHER)
                    at, context, suffix = at[good], context[good], suffix[good]
                    held.append([context, word, np.isin(h[at - 1], frequent), suffix[: len(at) * (d > 1)]])
                    some += len(at)
                    break
            if some > 2 * FLUSH:
                yield from blocks_of()
                some = 0
        if some:
            yield from blocks_of()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, ...]]] = {False: [], True: []}
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
                held[part].append(unpack(block, given.value[4]))
        for part, some in held.items():
            if not some:
                continue
            context, suffix, word, n = (np.concatenate(x) for x in zip(*some, strict=True))
            run, n, at = summed(longer(word, context), n)
            context, suffix, word = context[at], suffix[at], word[at]
            twice = (n >= 2) & (word != OTHER)
            if depth == 2:
                total, a = context[:0], n[:0]
            else:
                order = np.argsort(context)
                run, context, suffix, word, n, twice = (x[order] for x in (run, context, suffix, word, n, twice))
                first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                total, a = context[first], np.add.reduceat(n, first)
                if not part:  # of these contexts all is here
                    enough = a >= LEAST
                    twice &= np.repeat(enough, np.diff(np.r_[first, len(n)]))
                    total, a = total[enough], a[enough]
            before = word if depth == 1 else longer(word, suffix)
            columns = (run[twice], context[twice], before[twice])
            yield from _rows(dict(zip(("run", "context", "suffix"), (c.view(np.int64) for c in columns), strict=True)) | {"n": n[twice]})
            for lo in range(0, len(total), 1 << 16):
                x, y = total[lo : lo + (1 << 16)].view(np.int64), a[lo : lo + (1 << 16)]
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(x), none, pa.array(y)], ["run", "context", "suffix", "n"])

    dealt = docs.mapInArrow(count, "place int, part boolean, block binary")
    return dealt.repartition(parts, "place").mapInArrow(merge, "run long, context long, suffix long, n long")


def tokens(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of tokens, and how many there are in a text, of blocks of texts or of what going_on() keeps of them."""
    for batch in batches:
        if "tokens" in batch.schema.names:
            for block in batch.column("tokens").to_pylist():
                words, at, sizes = token_places(block)
                ends = np.r_[0, np.cumsum(sizes)]
                for lo, hi in blocks(sizes.tolist(), BLOCK_TOKENS):
                    yield words[at[ends[lo] : ends[hi]]], sizes[lo:hi]
            continue
        for part in small(iter([batch]), text):
            body = part.column(text)
            for lo, hi in blocks(text_bytes(body).tolist(), BLOCK_BYTES):
                yield hashes(body[lo:hi])


def _taken(held: list[list[np.ndarray]], k: int) -> np.ndarray:
    """Column k of all that is held, which is let go."""
    out = np.concatenate([x[k] for x in held])
    for x in held:
        x[k] = out[:0]
    return out


def going_on(docs: DataFrame, given, depth: int, deepest: int, text: str = "text") -> DataFrame:
    """The tokens that may have a context of `depth` words whose suffix is retained, with the `deepest` words before each, as blocks of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(given.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            h, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return packed_tokens(h, sizes)

        some = 0
        for h, sizes in tokens(batches, text):
            place = places(sizes)
            for d, at, _, _ in levels(h, place, lambda c: holds(bits, as_context(c))):
                if d < depth:
                    continue
                size = len(h) + 1
                covered = np.cumsum(np.bincount(at - np.minimum(place[at], deepest), minlength=size) - np.bincount(at + 1, minlength=size))
                i = np.flatnonzero(covered)
                first = np.flatnonzero((place[i] == 0) | (np.diff(i, prepend=-2) > 1))
                held.append((h[i], np.diff(np.r_[first, len(i)])))
                some += len(i)
                break
            if some > FLUSH // 4:
                yield block()
                some = 0
        if some:
            yield block()

    return docs.mapInArrow(run, "tokens binary")


def grow(texts: DataFrame, words: DataFrame, n: int) -> tuple[list[DataFrame], np.ndarray]:
    """(key, value, n) of the retained contexts and of the runs met in them, level by level, and a filter of the keys.

    texts: blocks of tokens, a table cut before, which is dropped; words: (key, p, n), the words' shares and counts; n: the number of tokens. Values are log10: of a context, the share
    that it leaves to its suffix; of a run, its probability over the suffix's, less the value of its context."""
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // DEAL + 1)
    often = words.where((F.col("n") >= LEAST) & (F.col("key") != int(END.view(np.int64))))
    common = bits_of(often, no_bits(often.count()))
    bits = met_bits = no_bits(0)
    frequent = words.where(F.col("n") > n // (4 * parts)).select("key").toArrow().column("key").to_numpy().view(np.uint64)
    known = hot_rows(words, "p", CODED)[0]
    before, out, depth, deepest = words.select("key", "p"), [], 1, int(np.log(max(n, 2)) / np.log(LEAST))
    size = n
    c, least = F.col("n"), F.col("seen") + F.col("m")
    while True:
        given = spark.sparkContext.broadcast((packed(common), packed(bits), packed(met_bits), frequent, known))
        raw = cut(level_counts(texts, depth, given, parts))
        given.destroy()
        if depth == 1:
            pairs = cut(raw.where(F.col("run").isNotNull() & (c >= LEAST)).select(F.col("run").alias("context"), c.alias("a")))
            met_bits = bits_of(pairs.select(F.col("context").alias("key")), no_bits(pairs.count()))
        met = cut(raw.where(F.col("run").isNotNull()).join(before.select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix").drop("suffix"))
        total = pairs if depth == 2 else raw.where(F.col("run").isNull()).groupBy("context").agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST)
        own = met.groupBy("context").agg(F.sum("n").alias("seen"), F.count("*").alias("s"), F.sum("q").alias("mass"), F.sum(c * F.log(c / F.col("q"))).alias("g"))
        rest = F.col("a") - F.col("seen")
        others = F.when(rest > 0, rest * F.log(rest / F.greatest(1 - F.col("mass"), F.lit(1e-12)))).otherwise(0.0)
        gain = 2 * (F.col("g") + others - F.col("a") * F.log("a"))
        kept = cut(own.join(total, "context").where(gain > (F.col("s") + 1) * F.log(F.lit(float(n)))).select("context", "seen", (rest + F.col("s")).alias("m"), "a"), *([raw, pairs] if depth == 2 else [raw]))
        held = kept.agg(F.sum("a")).first()[0]
        if held is None:
            drop(met)
            drop(kept)
            break
        p = (c + F.col("m") * F.col("q")) / least
        runs = cut(met.join(kept.drop("a"), "context").select(F.col("run").alias("key"), p.alias("p"), F.log10(1 + c / (F.col("m") * F.col("q"))).alias("value"), "n"), met)
        contexts = cut(_context_keys(kept.select("context", F.log10(F.col("m") / least).alias("value"), F.col("a").alias("n"))), kept)
        out += [runs.select("key", "value", "n"), contexts]
        if depth == 1:  # those of one word are most of all
            bits = no_bits(runs.count() + contexts.count())
        bits_of(runs.select("key").union(contexts.select("key")), bits)
        if depth == deepest:
            break
        before, depth = runs.select("key", "p"), depth + 1
        if held * THIN < size:  # few tokens go deeper
            texts, size = cut(going_on(texts, spark.sparkContext.broadcast(packed(bits)), depth, deepest), texts), held * THIN // 4
    drop(texts)
    if depth == 1:
        drop(pairs)
    return out, bits


def _context_keys(contexts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = as_context(b.column("context").to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("value"), b.column("n")], ["key", "value", "n"])

    return contexts.mapInArrow(run, "key long, value double, n long")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def hot_rows(table: DataFrame, column: str, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys, and a column, of the rows with the greatest n, as many whole counts as `most` rows hold; the least n of these."""
    top, held = 10_000, 0
    least = top + 1
    for r in table.groupBy(F.least("n", F.lit(top)).alias("least")).agg(F.count("*").alias("rows")).orderBy(F.desc("least")).collect():
        held += r["rows"]
        if held > most:
            break
        least = r["least"]
    if least > top:
        return np.zeros(0, np.uint64), np.zeros(0), 1 << 62
    rows = table.where(F.col("n") >= least).select("key", column).toArrow()
    key = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], rows.column(column).to_numpy()[order], least


class Table:
    """Keys with a number each, found by open addressing: a round of array operations for each place that is tried."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, (2 * len(key)).bit_length())
        # A key and its number are one item, so that one look finds both; a number that is none marks a free place.
        self.slots = np.full(1 << self.bits, complex(0, np.nan))
        own = np.ascontiguousarray(np.stack([key.view(np.float64), value.astype(np.float64)], 1)).view(np.complex128).reshape(-1)
        left, at = np.arange(len(key)), self._first(key)
        while len(left):
            free = np.flatnonzero(np.isnan(self.slots[at].imag))
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slots[at[put]] = own[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _first(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key (0 where there is none), and whether it is there."""
        at = self._first(key)
        got = self.slots[at].view(np.float64).reshape(-1, 2)
        free = np.isnan(got[:, 1])
        there = (got.view(np.uint64)[:, 0] == key) & ~free
        value = np.where(there, got[:, 1], 0.0)
        left = np.flatnonzero(~(there | free))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[left]].view(np.float64).reshape(-1, 2)
            free = np.isnan(got[:, 1])
            hit = (got.view(np.uint64)[:, 0] == key[left]) & ~free
            value[left[hit]], there[left[hit]] = got[hit, 1], True
            left = left[~(hit | free)]
        return value, there


# Documents' words and runs that are not in every task, and the tables' rows, dealt by key


def _parts(key: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of keys begins and ends among sorted keys."""
    return np.searchsorted(key, [np.uint64(-(-(k << 64) // parts)) for k in range(parts)] + [np.uint64((1 << 64) - 1)])


def pack_places(key: np.ndarray, rid: np.ndarray) -> bytes:
    """Rows of sorted keys as a block of bytes: each key is there once, and each of its rows with its number; rows count from the least."""
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (rid[1:] != rid[:-1])])
    k = np.diff(np.r_[new, len(key)])
    key, rid = key[new], rid[new]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    head = np.array([len(first), len(key), rid.min()], "<u8").tobytes()
    return zstandard.compress(head + _near(key[first]) + _wide(np.diff(np.r_[first, len(key)])) + _wide(rid - rid.min()) + _wide(k), 1)


def unpack_places(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, how many rows each has, the rows, their numbers)."""
    data = zstandard.decompress(block)
    a, n, least = np.frombuffer(data[:24], "<u8").tolist()
    ends = np.cumsum([24, 8 * a, 4 * a, 4 * n, 4 * n]).tolist()
    keys, many, rid, k = (data[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False))
    return _apart(keys), _narrow(many), _narrow(rid).astype(np.int64) + least, _narrow(k).astype(np.int64)


_ROW = "place int, kind int, block binary, rid long, doc_id long, training boolean, n_tokens long, known long, base double, log double"
_KINDS = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _block_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    place, kind, block = zip(*rows, strict=True)
    given = {"place": place, "kind": kind, "block": block}
    return pa.RecordBatch.from_arrays([pa.array(given[n], t) if n in given else pa.nulls(len(rows), t) for n, t in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def table_blocks(table: DataFrame, parts: int, names: list[int]) -> DataFrame:
    """The rows (key, value, n) of a table as blocks of their parts (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            key, value, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key)
            key, value, n = key[order], value[order], n[order]
            ends = _parts(key, parts)
            return _block_rows([(names[k], 2, zstandard.compress(_near(key[ends[k] : ends[k + 1]]) + value[ends[k] : ends[k + 1]].tobytes() + _near(n[ends[k] : ends[k + 1]].view(np.uint64)), 1)) for k in np.flatnonzero(np.diff(ends)).tolist()])

        some = 0
        for b in batches:
            if b.num_rows:
                held.append([b.column("key").to_numpy().view(np.uint64), b.column("value").to_numpy(), b.column("n").to_numpy()])
                some += b.num_rows
            if some > FLUSH:
                yield out()
                some = 0
        if held:
            yield out()

    return table.select("key", "value", "n").mapInArrow(run, _ROW)


def resolved(dealt: DataFrame, parts: int, names: list[int]) -> DataFrame:
    """Documents as they are, and what each part's rows of the tables give them: a block of sums (kind 3) for each task of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, tables = [], []
        for b in batches:
            kind = b.column("kind").to_numpy()
            if (kind == 0).any():
                yield b.filter(pa.array(kind == 0))
            for k, block in zip(kind.tolist(), b.column("block").to_pylist(), strict=True):
                if k:
                    (places if k == 1 else tables).append(block)
        if not places or not tables:
            return
        rows = [(_apart(x[: len(x) // 3]), np.frombuffer(x[len(x) // 3 : len(x) // 3 * 2]), _apart(x[len(x) // 3 * 2 :]).view(np.int64)) for x in map(zstandard.decompress, tables)]
        key, value, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(key)
        key, value, n = key[order], value[order], n[order]
        base = np.log10(n + 1.0)
        sums: dict[int, list[np.ndarray]] = {}
        for block in places:
            keys, many, rid, k = unpack_places(block)
            i, there = _found(key, keys)
            i, there = np.repeat(i, many), np.repeat(there, many)
            i, rid, k = i[there], rid[there], k[there]
            if not len(rid):
                continue
            task = int(rid[0]) >> 33
            at, size = rid - (task << 33), int(rid.max() - (task << 33)) + 1
            own = np.stack([np.bincount(at, x, size) for x in (np.where(n[i] > 0, k, 0), k * base[i], k * value[i])])
            if task in sums:
                one, other = sorted((sums[task], own), key=lambda x: x.shape[1])
                other[:, : one.shape[1]] += one
                own = other
            sums[task] = own
        for task, own in sums.items():
            some = np.flatnonzero(own.any(0))
            body = np.array([task], np.int64).tobytes() + _near(some.astype(np.uint64)) + _near(own[0, some].astype(np.uint64)) + own[1:, some].tobytes()
            yield _block_rows([(names[task % parts], 3, zstandard.compress(body, 1))])

    return dealt.mapInArrow(run, _ROW)


def added_up(dealt: DataFrame) -> DataFrame:
    """Documents with the sums of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = [], {}
        for b in batches:
            kind = b.column("kind").to_numpy()
            own.append(b.filter(pa.array(kind == 0)).select(_NAMES[3:]))
            for block in b.filter(pa.array(kind == 3)).column("block").to_pylist():
                data = zstandard.decompress(block)
                task, rows = int(np.frombuffer(data[:8], np.int64)[0]), (len(data) - 8) // 32
                at, k = (_apart(data[lo : lo + 8 * rows]).astype(np.int64) for lo in (8, 8 + 8 * rows))
                sums.setdefault(task, []).append((at, np.stack([k, *np.frombuffer(data[8 + 16 * rows :]).reshape(2, rows)])))
        total = {}
        for task, parts in sums.items():
            total[task] = np.zeros((3, int(max(at.max() for at, _ in parts)) + 1))
            for at, part in parts:
                total[task][:, at] += part
        for b in own:
            rid = b.column("rid").to_numpy()
            more = np.zeros((3, len(rid)))
            for task in np.unique(rid >> 33).tolist():
                if task in total:
                    at = np.flatnonzero(rid >> 33 == task)
                    place = rid[at] - (task << 33)
                    inside = place < total[task].shape[1]
                    more[:, at[inside]] = total[task][:, place[inside]]
            known = b.column("known").to_numpy() + np.rint(more[0]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _NAMES[3:7]), pa.array(known), pa.array(b.column("base").to_numpy() + more[1]), pa.array(b.column("log").to_numpy() + more[2])], _NAMES[3:])

    return dealt.mapInArrow(run, _ROW.split(", ", 3)[3])


def _found(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return i, keys[i] == key


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scored(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    with _set(docs.sparkSession, SETTINGS):
        return _scored(docs, training, doc_id, text)


def _scored(docs: DataFrame, training: Column, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    with _set(spark, {"spark.sql.files.maxRecordsPerFile": "8"}):  # what reads blocks may hold those of a file at once
        texts = cut(token_blocks(docs.where(training), text))
    counts = cut(corpus_counts(texts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.count() * FLUSH // DEAL + 1)))
    v, n, once = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    # For all unknown words as many tokens as there are words met once.
    unknown = float(max(once, 1))
    whole = n + SHARE * v + unknown
    tree, bits = grow(texts, counts.select("key", ((F.col("n") + SHARE) / F.lit(whole)).alias("p"), "n"), n) if n else ([], no_bits(0))
    if not n:
        drop(texts)
    words, times, least_word = hot_rows(counts, "n", HOT)
    keys, values, least_run = hot_rows(_union(tree), "value", HOT_RUNS) if tree else (np.zeros(0, np.uint64), np.zeros(0), 0)
    given = spark.sparkContext.broadcast((packed(bits), words, times, Table(keys, values)))
    log_unknown, log_all = float(np.log10(unknown / whole)), float(np.log10(n + v + 1))
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 8), n // DEAL + 1)
    names = own_partitions(spark, parts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed_bits, words, times, hot_runs = given.value
        bits = unpacked(packed_bits)
        base_of, log_of = np.log10((times + 1) / (n + v + 1)), np.log10((times + SHARE) / whole)
        task = TaskContext.get().partitionId()
        rid = task << 33
        held: list[list[np.ndarray]] = []

        def place_blocks() -> pa.RecordBatch:
            key, row = (_taken(held, k) for k in range(2))
            held.clear()
            order = np.argsort(key)
            key = key[order]
            # Rows go in order within a key: both as one number, the key's by its place.
            both = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.uint64) << np.uint64(32) | row[order]
            both.sort()
            row = both.astype(np.uint32)
            ends = _parts(key, parts)
            return _block_rows([(names[k], 1, pack_places(key[ends[k] : ends[k + 1]], row[ends[k] : ends[k + 1]] + np.int64(task << 33))) for k in np.flatnonzero(np.diff(ends)).tolist()])

        some = 0
        for batch in small(batches, text):
            body = batch.column(text)
            for lo, hi in blocks(text_bytes(body).tolist(), BLOCK_BYTES):
                h, sizes = hashes(body[lo:hi])
                rows, place = len(sizes), places(sizes)
                doc = np.repeat(np.arange(rows), sizes)
                distinct, of = np.unique(h, return_inverse=True)
                i, there = _found(words, distinct)
                known = there[of]
                hot, at = doc[known], i[of[known]]
                n_hot, n_rest = np.bincount(hot, minlength=rows), np.bincount(doc[~known], minlength=rows)
                # A word that is not among the frequent ones counts as unknown here; the tables have the difference.
                base = np.bincount(hot, base_of[at], rows) - log_all * n_rest
                path = np.bincount(hot, log_of[at], rows) + log_unknown * n_rest
                late_doc, late_key = [doc[~known]], [h[~known]]
                at, depth = np.flatnonzero(place >= 1), 1
                context = h[at - 1]
                while len(at):
                    if depth == 1:  # contexts of one word are looked up once for all their places
                        own = as_context(distinct)
                        on, who = holds(bits, own), of[at - 1]
                        value, there = hot_runs.find(own)
                        on, own, value, there = on[who], own[who], value[who], there[who]
                        at, context, own, value, there = at[on], context[on], own[on], value[on], there[on]
                    else:
                        own = as_context(context)
                        on = holds(bits, own)
                        at, context, own = at[on], context[on], own[on]
                        value, there = hot_runs.find(own)
                    run = longer(h[at], context)
                    met = np.flatnonzero(holds(bits, run))
                    for token, key, (value, there) in ((at, own, (value, there)), (at[met], run[met], hot_runs.find(run[met]))):
                        path += np.bincount(doc[token], value, rows)
                        late_doc.append(doc[token[~there]])
                        late_key.append(key[~there])
                    on = place[at] > depth
                    at, context, depth = at[on], context[on], depth + 1
                    context = longer(context, h[at - depth])
                held.append([np.concatenate(late_key), (np.concatenate(late_doc) + (rid - (task << 33) + lo)).astype(np.uint32)])
                some += len(held[-1][0])
                if some > FLUSH:
                    yield place_blocks()
                    some = 0
                part, own_rid = batch.slice(lo, hi - lo), np.arange(rid + lo, rid + hi)
                columns = [np.full(rows, names[task % parts], np.int32), np.zeros(rows, np.int32), pa.nulls(rows, pa.binary()), own_rid, part.column("doc_id"), part.column("training"), sizes.astype(np.int64), n_hot.astype(np.int64), base, path]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], _NAMES)
            rid += len(body)
        if some:
            yield place_blocks()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text, training.alias("training")).mapInArrow(score, _ROW)
    more = F.log10((F.col("n") + SHARE) / F.lit(whole)) - F.lit(log_unknown)
    rows = rows.unionByName(table_blocks(counts.where(F.col("n") < least_word).select("key", more.alias("value"), "n"), parts, names))
    if tree:
        cold = _union(tree).where(F.col("n") < least_run).select("key", "value", F.lit(0).cast("long").alias("n"))
        rows = rows.unionByName(table_blocks(cold, parts, names))
    of = added_up(resolved(rows.repartition(parts, "place"), parts, names).repartition(parts, "place"))
    return of.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("log").alias("score"))
