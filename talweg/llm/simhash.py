"""SimHash near-duplicates: 64-bit fingerprints, exact links by vantage-point trees, components over all documents.

Fingerprint: bit b is set if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles.

Links: fingerprints that differ in at most `radius` bits. Over the whole 64 bits, distances between unrelated
fingerprints lie within a few bits of 32, where triangle bounds prune nothing, so the outermost partitions are by the
distance over a block of bits alone: a shard holds what lies at distance zero, on the block, from a vantage value. The
bits are in radius + 1 blocks, and two linked fingerprints differ in at most `radius` bits, so they share a shard of at
least one block. A shard of more than `shard` fingerprints is parted again, by radius + 1 blocks of the bits that are
not yet equal in it, and so on: no link is lost, and no shard stays above the limit however many fingerprints there are
or however close they lie, as fingerprints of which radius bits are free are few. A shard is searched by a vantage-point
tree over all 64 bits: points inside and outside the median distance meet only where triangle bounds allow, and leaves
that a boundary overlaps are queried from both of its sides.

Components: a task reports, for each fingerprint that it linked, the least fingerprint of its local component (never
all pairs); these edges are contracted by repeated large-star and small-star steps, cut between rounds. Fingerprints,
components and hubs that many rows share are joined by broadcast, at most `FREQUENT` of them.

Nulls and edges: null and empty texts have fingerprint zero, linked like any other; a null doc_id gets the component
of its fingerprint, and component_id is null where no member has an id. Rows equal in every column are each answered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.llm.common import cut, drop, small, spread_join, texts_of

RADIUS, SHINGLE, SHARD, LEAF = 4, 4, 4096, 32
_SHINGLES = 1 << 16


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of the text's shingles: `size` consecutive lower-cased words, or all of a shorter text."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if len(w) <= size:
        return [h(b" ".join(w), 42)] if w else []
    joined = b" ".join(w)
    starts = np.cumsum([0, *[len(x) + 1 for x in w]]).tolist()
    return [h(joined[a : b - 1], 42) for a, b in zip(starts, starts[size:], strict=False)]


def fingerprints(texts: list[str], size: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints of the texts."""
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        hashes = np.array(shingle_hashes(t, size), np.uint64)
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(hashes), _SHINGLES):
            ones += np.unpackbits(hashes[lo : lo + _SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", size: int = SHINGLE) -> DataFrame:
    """docs without `text`, with the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c not in (text, name)]
    schema = docs.select(*keep, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text):
            fp = pa.array(fingerprints(texts_of(batch, text), size).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], fp], [*keep, name])

    return docs.mapInArrow(run, schema)


class Links:
    """Components of links found among one shard's fingerprints."""

    def __init__(self, points: np.ndarray, radius: int = RADIUS):
        self.p, self.radius, self.label, self.compared = points, radius, np.arange(len(points)), 0
        self.within(self.label.copy())

    def _merge(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while not np.array_equal(up := label[label], label):
                label[:] = up

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        self.compared += len(a) * len(b)
        for lo in range(0, len(a), 256):
            x = a[lo : lo + 256]
            for at in range(0, len(b), 4096):
                y = b[at : at + 4096]
                i, j = np.nonzero(np.bitwise_count(self.p[x][:, None] ^ self.p[y][None, :]) <= self.radius)
                if len(i):
                    self._merge(x[i], y[j])

    def within(self, a: np.ndarray) -> None:
        """Links between the points at a: the median ball around a vantage point, and what lies outside it."""
        if len(a) <= LEAF:
            return self._compare(a, a)
        d = np.bitwise_count(self.p[a] ^ self.p[a[0]]).astype(np.int64)
        mid = int(np.median(d))
        inside = d <= mid
        if inside.all():
            inside = d < mid
            if not inside.any():
                return self._compare(a, a)
            mid -= 1
        self.within(a[inside])
        self.within(a[~inside])
        # By the triangle bound only points within the radius of the ball's edge can link across it.
        self.across(a[inside & (d > mid - self.radius)], a[~inside & (d <= mid + self.radius)])
        return None

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a) <= LEAF or len(b) <= LEAF:
            if len(a) and len(b):
                self._compare(a, b)
            return
        da, db = (np.bitwise_count(self.p[x] ^ self.p[a[0]]).astype(np.int64) for x in (a, b))
        mid = int(np.median(db))
        near = da <= mid + self.radius, db <= mid
        far = da > mid - self.radius, db > mid
        if near[0].sum() * near[1].sum() + far[0].sum() * far[1].sum() >= 0.8 * len(a) * len(b):
            return self._compare(a, b)
        self.across(a[near[0]], b[near[1]])
        self.across(a[far[0]], b[far[1]])
        return None


def _blocks(fixed: int, radius: int) -> list[int]:
    """The bits that are not in `fixed`, in radius + 1 blocks, as masks."""
    free = [b for b in range(64) if not fixed >> b & 1]
    ends = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(ends, ends[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shards(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(fixed, cell, fp): fps dealt to shards, which are equal in the bits of the mask `fixed`, none above `shard`."""
    shard = max(shard, 1 << radius + 1)
    parts, masks, rest, old = [], [0], fps.select(F.lit(0).cast("long").alias("fixed"), "fp"), None
    while True:
        more = {m: [m | b for b in _blocks(m, radius)] for m in masks}
        into = F.create_map(*[x for m, bs in more.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(b)).cast("long") for b in bs]))])
        dealt = rest.select(F.explode(F.element_at(into, F.col("fixed"))).alias("fixed"), "fp").select("fixed", F.col("fp").bitwiseAND(F.col("fixed")).alias("cell"), "fp")
        sizes = dealt.groupBy("fixed", "cell").agg(F.count("*").alias("n"))
        large = cut(sizes.where(F.col("n") > shard))
        if large.isEmpty():
            drop(large)
            parts.append(dealt)
            break
        # Few next to all shards, but no bound on them: an ordinary join.
        marked = cut(dealt.join(large, ["fixed", "cell"], "left"), *([old] if old is not None else []), large)
        parts.append(marked.where("n is null").drop("n"))
        old, rest = None, marked.where("n is not null").select("fixed", "fp")
        masks = sorted({b for bs in more.values() for b in bs})
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def local_edges(dealt: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): for every fingerprint with a link in a shard, the least of its local component there."""
    keys = ["fixed", "cell"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(shard: np.ndarray) -> np.ndarray:
            label = Links(shard.view(np.uint64), radius).label
            to = np.flatnonzero(label != np.arange(len(shard)))
            return np.stack([shard[to], shard[label[to]]])

        def edges(out: list[np.ndarray]) -> pa.RecordBatch:
            a, b = np.concatenate(out, 1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        open_key, parts = None, []
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(fp)]
            out = []
            for lo, hi in zip(starts, starts[1:], strict=False):
                if hi == lo:
                    continue
                this = tuple(key[:, lo].tolist())
                if this != open_key:
                    if sum(map(len, parts)) > 1:
                        out.append(found(np.concatenate(parts)))
                    open_key, parts = this, []
                parts.append(fp[lo:hi])
            if out:
                yield edges(out)
        if sum(map(len, parts)) > 1:
            yield edges([found(np.concatenate(parts))])

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(search, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable by edges (a, b), itself included, for every node with an edge."""
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, rows = None, 2 * e.count()
    for _ in range(rounds):
        # Large star: a node's larger neighbours move to its least neighbour.
        both = e.union(e.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both.where("b > a"), least, "a", rows).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        e, before = cut(small, e), mark
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        rows = 2 * mark[0]
        if mark == before:
            # A least node points nowhere, but is of its component.
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def _components_of(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, n, component_id, root) of each fingerprint of prints (doc_id, fp): its rows, and what its component has."""
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(cut(local_edges(shards(fps.select("fp"), radius), radius)))
    rooted = cut(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "root", "least"), fps)
    # A fingerprint without a link is its own component and joins nothing.
    alone = rooted.where("root is null").select("fp", "n", F.col("least").alias("component_id"), F.col("fp").alias("root"))
    linked = rooted.where("root is not null")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return alone.unionByName(spread_join(linked, named, "root", linked.count(), "members").select("fp", "n", "component_id", "root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """doc_id, row_hash (of id and text), fp (long), component_id and root (the component's least fingerprint) of every document."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, text).alias("row_hash"), F.col(text).alias("text"))
    prints = cut(with_fingerprint(own, size=size))
    of = cut(_components_of(prints, radius))
    return spread_join(prints, of, "fp", prints.count()).select("doc_id", "row_hash", "fp", "component_id", "root")


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the least by doc_id (null last), then by the row's hash; of equal ones any."""
    named = near_duplicates(docs, doc_id, text)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    kept = named.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.row_hash").alias("__hash"))
    # Dealt by the hash once: of rows with a hash that is kept, those of its id, of these one.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("hash"))
    joined = rows.join(kept, F.col("hash") == F.col("__hash"))
    same = F.col("id").eqNullSafe(F.col("__id"))
    numbered = joined.withColumn("n", F.row_number().over(W.partitionBy("__hash", "__id").orderBy(same.desc())))
    return numbered.where((F.col("n") == 1) & same).select("row.*")
