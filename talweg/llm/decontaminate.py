"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become byte strings of lower-cased words between single blanks, so a window of words occurs in a text exactly
where its bytes, with the blanks around them, do. A pattern class holds patterns of like length: its shift table says
for each hashed block of bytes how far a search window may jump, its suffix-hash buckets list the patterns that may
end at a block of shift zero, and a direct comparison confirms each occurrence. The search runs many lanes of one
buffer at once, each lane jumping by its own shifts.

Nulls and edges: null and empty texts have no words and are not contaminated; items without words have no window;
rows equal in every column are each answered; the answer columns replace columns of the same name.
The benchmark is taken in blocks of about `BLOCK_BYTES` bytes of windows, one after the other over a table of what was
found so far, so that the driver and each task hold the windows of one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.llm.common import blocks, cut, small, texts_of

WINDOW = 10
#: Bytes of normalised benchmark text in one table, and of document text searched at once.
BLOCK_BYTES, BUFFER_BYTES, LANE = 8 << 20, 4 << 20, 2048
_WORD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


class WuManber:
    """Shift table, suffix-hash buckets and patterns of one length class."""

    BITS = 20

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = max(1, min(5, self.m))
        top = self.m - self.block + 1
        self.shift = np.full(1 << self.BITS, top, np.uint16)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        for end in range(self.block - 1, self.m):
            at = self._hash([heads[:, end - j] for j in range(self.block - 1, -1, -1)])
            np.minimum.at(self.shift, at, np.uint16(self.m - 1 - end))
        #: By the hash of the block that ends a pattern's window: the patterns by window.
        self.buckets: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        last = self._hash([heads[:, self.m - 1 - j] for j in range(self.block - 1, -1, -1)])
        for k, (h, p) in enumerate(zip(last.tolist(), patterns, strict=True)):
            self.buckets[h][p[: self.m]].append(k)
        self.buckets = {h: dict(b) for h, b in self.buckets.items()}

    def _hash(self, columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint32)
        for c in columns:
            h = h * np.uint32(0x01000193) + c
        h ^= h >> np.uint32(15)
        return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)

    def search(self, buffer: bytes) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence in the buffer."""
        text = np.frombuffer(buffer, np.uint8)
        at = np.arange(self.m - 1, len(text), LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, len(text))
        while len(at):
            suffix = self._hash([text[at - j] for j in range(self.block - 1, -1, -1)])
            jump = self.shift[suffix]
            stopped = jump == 0
            for end, h in zip(at[stopped].tolist(), suffix[stopped].tolist(), strict=True):
                start = end - self.m + 1
                for k in self.buckets[h].get(buffer[start : end + 1], ()):
                    if buffer.startswith(self.patterns[k], start):
                        yield start, k
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]


class Windows:
    """All windows of some items, by length class."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        owners: dict[bytes, set[str]] = defaultdict(set)
        self.n_words: dict[bytes, int] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                part = w[i : i + window]
                p = b" " + b" ".join(part) + b" "
                owners[p].add(item)
                self.n_words[p] = len(part)
        classes: dict[int, list[bytes]] = defaultdict(list)
        for p in sorted(owners):
            classes[min(5, len(p).bit_length())].append(p)
        self.owners = {p: sorted(o) for p, o in owners.items()}
        self.classes = [WuManber(ps) for _, ps in sorted(classes.items())]

    def spans(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each list of words: spans (first word, end) of windows that occur, and the items they are of."""
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
        lines = [b" " + b" ".join(w) + b" \n" for w in texts]
        for lo, hi in blocks([len(x) for x in lines], BUFFER_BYTES):
            buffer = b"".join(lines[lo:hi])
            starts = np.cumsum([0, *map(len, lines[lo:hi])])
            blanks = None
            for c in self.classes:
                found = list(c.search(buffer))
                if not found:
                    continue
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
                at = np.array([f[0] for f in found])
                doc = np.searchsorted(starts, at, "right") - 1
                # A window's blank is the one before its first word: blanks from the text's start count its words.
                word = np.searchsorted(blanks, at) - np.searchsorted(blanks, starts[doc])
                for (_, k), d, first in zip(found, doc.tolist(), word.tolist(), strict=True):
                    p = c.patterns[k]
                    spans, items = out[lo + d]
                    spans.append((first, first + self.n_words[p]))
                    items.update(self.owners[p])
        return out


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items as (id, text) in blocks of at most `limit` bytes (or one item), one block on the driver at a time."""
    sized = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    n = (sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * WINDOW // limit + 1
    for k in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (first word and end of every window met) and items (ids of the items met)."""
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    out = docs.select(*[c for c in docs.columns if c not in added.names], F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("hit_spans"), F.array().cast("array<string>").alias("items"))
    held: list[DataFrame] = []
    for k, items in enumerate(_item_blocks(benchmark, item_id, item_text, limit)):
        if k:  # one block's table at a time in a task
            out = cut(out, *held)
            held = [out]
        table = Windows(items, window)

        def search(batches: Iterator[pa.RecordBatch], table: Windows = table) -> Iterator[pa.RecordBatch]:
            for batch in small(batches, text):
                texts = [words(t) for t in texts_of(batch, text)]
                before = zip(batch.column("hit_spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                spans, met = [], []
                for (s, i), (s0, i0) in zip(table.spans(texts), before, strict=True):
                    spans.append([*((x["first"], x["end"]) for x in s0), *sorted(set(s))])
                    met.append(sorted({*i0, *i}))
                new = {"n_words": pa.array([len(w) for w in texts], pa.int64()), "hit_spans": pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], batch.schema.field("hit_spans").type), "items": pa.array(met, batch.schema.field("items").type)}
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], schema=batch.schema)

        out = out.mapInArrow(search, out.schema)
    return out


def hit_words(spans: Column) -> Column:
    """Words inside any of an array of spans."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reach"))
    step = lambda s, x: F.struct((s["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["first"], s["reach"]))).alias("total"), F.greatest(s["reach"], x["end"]).alias("reach"))
    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["total"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)
    hit = found.select("doc_id", "n_words", hit_words(F.col("hit_spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return hit.withColumn("contaminated", F.col("n_hit") > 0)
