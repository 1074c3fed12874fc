"""Two-sample statistics over pair distances.

The kernel matrix is never gathered: vectors are dealt to blocks of bounded size, pairs of blocks are worked through as
matrix products, and only the sums for each pair of tiles leave a task. Every split of tiles is then a sum over those.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.operators.ranking import numbered, running
from talweg.sources.files import cut

#: Vectors in one block; a pair of blocks is one row of at most 2 BLOCK vectors. Each block is sent once for every other.
BLOCK = 8192
#: Items of a block whose distances to as many of another are held at once.
PIECE = 512
#: Splits of tiles of one size that are enumerated; draws beyond.
MOST_SPLITS = 5000


def vector_blocks(vectors: DataFrame, n: int, key: str = "id", population: int = 0, populations: int = 1) -> DataFrame:
    """(block, of, ids, tiles, xs, sizes): the items (id, tile, x) in blocks of at most about BLOCK, n being their number.

    x is an array of numbers: a vector, or the births and deaths of a diagram in turn, whose essential deaths are null. Of
    several populations of n items, each has as many blocks, one population's after another's; `of` counts all."""
    count = max(1, -(-n // min(BLOCK, max(64, n // 12))))
    # Blocks by id modulo their number are even for running ids; a hash would not be as even.
    block = (F.pmod(F.col(key), F.lit(count)) + population * count).cast("int")
    rows = vectors.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), "tile", "x"))).alias("v"))
    pick = lambda f: F.transform("v", lambda p: p[f])
    return rows.select("block", F.lit(count * populations).alias("of"), pick("id").alias("ids"), pick("tile").alias("tiles"), F.flatten(pick("x")).alias("xs"), F.transform("v", lambda p: F.size(p["x"])).alias("sizes"))


def block_pairs(blocks: DataFrame, populations: int = 1, first: bool = True) -> DataFrame:
    """Every unordered pair of blocks once: block_a, block_b and the columns of either as ids_a, ids_b and so on.

    A block is sent to the cells of its row and column of the grid of blocks, where equal cells join. Of several
    populations each meets itself and the first, not the others; the first meets itself if `first`."""
    count = (blocks.select("of").first() or [1])[0]
    parts = max(1, min(count * (count + 1) // 2, 1 << 16))

    def side(s: str, row: Column, column: Column) -> DataFrame:
        at = blocks.select(row.alias("block_a"), F.col("block"), "of", *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "tiles", "xs", "sizes")])
        cells = at.select("block_a", column.alias("block_b"), *[f"{c}_{s}" for c in ("ids", "tiles", "xs", "sizes")])
        of_a, of_b = (F.floor(F.col(c) / (count // populations)) for c in ("block_a", "block_b"))
        return cells.where((of_b > 0 if not first else F.lit(True)) & ((of_a == of_b) | (of_a == 0))) if populations > 1 else cells

    a = side("a", F.col("block"), F.explode(F.sequence(F.col("block"), F.col("of") - 1)))
    b = side("b", F.explode(F.sequence(F.lit(0), F.col("block"))), F.col("block"))
    cell = ["block_a", "block_b"]
    out = a.repartition(parts, *cell).hint("shuffle_hash").join(b.repartition(parts, *cell), cell)
    out.blocks = blocks
    return out


DIRECTIONS = 50


def _padded(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(births, deaths, there) of diagrams, as rows of one length; essential deaths are NaN."""
    points, owner = values.reshape(-1, 2), np.repeat(np.arange(len(sizes)), sizes // 2)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes // 2) - sizes // 2, sizes // 2)
    out = np.zeros((2, len(sizes), int((sizes // 2).max(initial=0))))
    there = np.zeros(out.shape[1:], bool)
    out[0, owner, place], out[1, owner, place], there[owner, place] = points[:, 0], points[:, 1], True
    return out[0], out[1], there


#: Diagrams of one side that are compared at once, so that their projections stay in a core's cache.
_SLICED_AT_ONCE = 32
#: Where points are that are not there, in both sides alike: beyond all.
_FAR = 1e300


def _projected(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of diagrams: the points over DIRECTIONS directions and those of the diagonal, either as a part that is fixed and one
    to be taken times the cap (the death of essential points), and the greatest finite deaths."""
    x, y, there = _padded(values, sizes)
    t = -math.pi / 2 + np.arange(DIRECTIONS) * math.pi / DIRECTIONS
    cos, sin = np.cos(t)[:, None], np.sin(t)[:, None]
    open_ = (np.isnan(y) & there)[:, None]
    top = np.where(there & ~np.isnan(y), y, -np.inf).max(1, initial=-np.inf)
    x, y, there = x[:, None], np.nan_to_num(y, nan=0.0)[:, None], there[:, None]
    far = lambda v: np.where(there, v, _FAR)
    return far(x * cos + y * sin), open_ * sin, far((x + y) / 2 * (cos + sin)), open_ * ((cos + sin) / 2), top


def _sliced_apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """As _sliced, diagram by diagram: for large diagrams, or those with few points in common."""
    (pa_, qa, da, ea, top_a), (pb, qb, db, eb, top_b) = _projected(*a), _projected(*b)
    n_a, n_b = a[1] // 2, b[1] // 2
    out = np.zeros((len(n_a), len(n_b)))
    order = np.argsort(n_b, kind="stable")
    for lo in range(0, len(order), _SLICED_AT_ONCE):
        at = order[lo : lo + _SLICED_AT_ONCE]
        kb = int(n_b[at].max())
        p, q, d, e = (v[at][:, :, :kb] for v in (pb, qb, db, eb))
        for i, ka in enumerate(n_a.tolist()):
            cap = np.maximum(top_a[i], top_b[at])
            cap = np.where(np.isfinite(cap), 1.5 * cap, 1.0)[:, None, None]
            u, v = np.empty((2, len(at), DIRECTIONS, ka + kb))
            for to, own, times, other, by in ((u, pa_, qa, d, e), (v, da, ea, p, q)):
                np.multiply(times[i, :, :ka], cap, out=to[:, :, :ka])
                to[:, :, :ka] += own[i, :, :ka]
                np.multiply(by, cap, out=to[:, :, ka:])
                to[:, :, ka:] += other
                to.sort(2)
            u -= v
            out[i, at] = np.abs(u, out=u).sum((1, 2)) / DIRECTIONS
    return out


#: Points of pairs of diagrams that are taken at once; projections that are sorted at once, so that they stay in a core's cache.
_POINTS_AT_ONCE, _ROOM = 1 << 19, 1 << 19
#: Points that many diagrams have, which are taken away from both sides of a pair; as many kinds at most.
_COMMON = 32
#: Places of a table of projections for all pairs of two blocks, and numbers that a network sorts, at most.
_PLACES, _MOST_WIRES = 1 << 14, 64
_ANGLES = -math.pi / 2 + np.arange(DIRECTIONS) * math.pi / DIRECTIONS


@cache
def _network(n: int) -> list[tuple[int, int]]:
    """Places to be compared and exchanged in turn so that n numbers get sorted (Batcher's merge exchange)."""
    out, top = [], 1 << max(0, (n - 1).bit_length() - 1)
    p = top if n > 1 else 0
    while p:
        q, r, d = top, 0, p
        while True:
            out += [(i, i + d) for i in range(n - d) if i & p == r]
            if q == p:
                break
            d, q, r = q - p, q // 2, p
        p //= 2
    return out


def _projections(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of points and then of their places on the diagonal: (ranks by point and direction, projections by direction and rank)."""
    middle = (x + y) / 2
    x, y = np.r_[x, middle], np.r_[y, middle]
    values = np.cos(_ANGLES)[:, None] * x
    values += np.sin(_ANGLES)[:, None] * y
    order = np.argsort(values, 1)
    ranks = np.empty((len(x), DIRECTIONS), np.uint16)
    np.put_along_axis(ranks.T, order, np.arange(len(x), dtype=ranks.dtype)[None], 1)
    return ranks, np.take_along_axis(values, order, 1)


def _transported(at: np.ndarray, of_a: np.ndarray, table: tuple[np.ndarray, np.ndarray], room: dict) -> np.ndarray:
    """Sliced distances of pairs of diagrams that have equally many points in all: (pairs, points) of places in the table of
    projections, and whose they are.

    Over a direction the points of one diagram and those of the other put on the diagonal are sorted against the reverse.
    Ranks are sorted in place of numbers, as they are shorter."""
    n, k = at.shape
    out = np.zeros(n)
    if not k:
        return out
    ranks, values = table
    flat = np.arange(DIRECTIONS) * values.shape[1]
    other = at + values.shape[1] // 2
    sides = np.stack([np.where(of_a, at, other).T, np.where(of_a, other, at).T], 1)
    step = max(1, _ROOM // (2 * DIRECTIONS * k))
    for lo in range(0, n, step):
        # By point, side, pair and direction.
        own = sides[:, :, lo : lo + step]
        w = np.take(ranks, own, 0, out=_room(room, "w", (*own.shape, DIRECTIONS), ranks.dtype), mode="clip")
        wires, spare = list(w), _room(room, "spare", w.shape[1:], ranks.dtype)
        for i, j in _network(k):
            np.minimum(wires[i], wires[j], out=spare)
            np.maximum(wires[i], wires[j], out=wires[j])
            wires[i], spare = spare, wires[i]
        place, found = (_room(room, s, w.shape[1:], t) for s, t in (("place", np.int64), ("found", np.float64)))
        total = _room(room, "total", w.shape[2:], np.float64)
        total[:] = 0
        for wire in wires:
            np.copyto(place, wire)
            np.take(values.reshape(-1), np.add(place, flat, out=place), out=found, mode="clip")
            apart = np.subtract(found[0], found[1], out=found[0])
            total += np.abs(apart, out=apart)
        out[lo : lo + step] = total.sum(1)
    return out / DIRECTIONS


def _room(room: dict, name: str, shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """An array of this shape; memory that was used before under the name, where it is enough."""
    n = math.prod(shape)
    if name not in room or len(room[name]) < n:
        room[name] = np.empty(n, dtype)
    return room[name][:n].reshape(shape)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1 and so on for each of the counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows of numbers, most frequent first, and which of them each row is); NaN equals NaN."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    order = np.lexsort(bits.T)
    starts = np.flatnonzero(np.r_[True, (bits[order[1:]] != bits[order[:-1]]).any(1)][: len(order)])
    n = np.diff(np.r_[starts, len(order)])
    best = np.argsort(-n, kind="stable")
    number, kind = np.empty(len(n), np.int64), np.empty(len(order), np.int64)
    number[best] = np.arange(len(n))
    kind[order] = np.repeat(number, n)
    return values[order[starts[best]]], kind


def _sliced(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sliced Wasserstein distances of the diagrams of two blocks over DIRECTIONS directions; essential deaths are at 1.5
    times the greatest finite death of the pair (1.0 without any).

    Points that both diagrams of a pair have don't count, as each is then on both sides with its place on the diagonal."""
    n_a, n_b = a[1] // 2, b[1] // 2
    if not len(n_a) or not len(n_b) or n_a.max() + n_b.max() > _MOST_WIRES:
        return _sliced_apart(a, b)
    owner = np.repeat(np.arange(len(n_a) + len(n_b)), np.r_[n_a, n_b])
    points, kind = _numbered(np.concatenate([a[0], b[0]]).reshape(-1, 2))
    top = np.full(len(n_a) + len(n_b), -np.inf)
    np.fmax.at(top, owner, points[kind, 1])
    tops, of_top = np.unique(top, return_inverse=True)
    caps = np.where(np.isfinite(tops), 1.5 * tops, 1.0)
    # Finite points have a place in the table of projections, essential ones one for each cap.
    is_open = np.isnan(points[:, 1])
    wide = np.where(is_open, len(caps), 1)
    if wide.sum() > _PLACES:
        return _sliced_apart(a, b)
    place = np.cumsum(wide) - wide
    x, y = (np.repeat(v, wide) for v in points.T)
    y[np.isnan(y)] = np.tile(caps, is_open.sum())
    table = _projections(x, y)
    common = min(_COMMON, len(points))
    often = kind < common
    many = np.bincount(owner[often] * common + kind[often], minlength=len(top) * common).reshape(len(top), common).astype(np.int32)
    rare, rares = kind[~often], np.bincount(owner[~often], minlength=len(top))
    begins = np.cumsum(rares) - rares
    out, room = np.zeros(len(n_a) * len(n_b)), {}
    step = max(1, _POINTS_AT_ONCE // max(1, int(n_a.max() + n_b.max())))
    for lo in range(0, len(out), step):
        pair = np.arange(lo, min(lo + step, len(out)))
        i, j = pair // len(n_b), len(n_a) + pair % len(n_b)
        more = many[i] - many[j]
        r, c = np.nonzero(more)
        more = more[r, c]
        times = np.abs(more)
        parts = [(np.bincount(r, times, len(pair)).astype(np.int64), np.repeat(c, times), np.repeat(more > 0, times))]
        for k, own in ((i, True), (j, False)):
            n = rares[k]
            parts.append((n, rare[np.repeat(begins[k], n) + _within(n)], np.full(n.sum(), own)))
        size = sum(n for n, *_ in parts)
        order = np.argsort(size, kind="stable")
        begin = np.empty(len(pair), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        at, of_a, free = np.empty(size.sum(), np.int64), np.empty(size.sum(), bool), begin.copy()
        cap = np.maximum(of_top[i], of_top[j])
        for n, p, own in parts:
            to = np.repeat(free, n) + _within(n)
            at[to], of_a[to] = place[p] + np.where(is_open[p], np.repeat(cap, n), 0), own
            free += n
        sizes, starts = np.unique(size[order], return_index=True)
        for k, u, v in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            points_at = slice(begin[order[u]], begin[order[u]] + k * (v - u))
            out[lo + order[u:v]] = _transported(*(z[points_at].reshape(v - u, k) for z in (at, of_a)), table, room)
    return out.reshape(len(n_a), len(n_b))


class _Vectors:
    """Vectors of one length, with the distances to others."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.x = values.reshape(len(sizes), -1)
        self.square = (self.x**2).sum(1)
        # Equal vectors have equal marks, so that rounding gives them no distance.
        bits = np.ascontiguousarray(self.x + 0.0).view(np.uint64)
        self.mark = (bits * np.random.default_rng(0).integers(1, 1 << 63, bits.shape[1], np.uint64)).sum(1, dtype=np.uint64)

    def part(self, at: np.ndarray) -> _Vectors:
        out = object.__new__(_Vectors)
        out.x, out.square, out.mark = self.x[at], self.square[at], self.mark[at]
        return out

    def distances(self, other: _Vectors) -> np.ndarray:
        d = self.x @ other.x.T
        d *= -2
        d += self.square[:, None]
        d += other.square
        near = d <= 1e-12 * (self.square.max(initial=0) + other.square.max(initial=0))
        if near.any():
            r, c = np.nonzero(near)
            d[r, c] = np.where(self.mark[r] == other.mark[c], 0, np.maximum(d[r, c], 0))
        return np.sqrt(d, out=d)

    def cubic(self, other: _Vectors) -> np.ndarray:
        return (self.x @ other.x.T / max(1, self.x.shape[1]) + 1) ** 3


class _Diagrams:
    """Diagrams (births and deaths in turn), with the sliced distances to others."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes

    def part(self, at: np.ndarray) -> _Diagrams:
        starts = np.cumsum(self.sizes) - self.sizes
        picked = [self.values[starts[k] : starts[k] + self.sizes[k]] for k in at]
        return _Diagrams(np.concatenate(picked) if picked else self.values[:0], self.sizes[at])

    def distances(self, other: _Diagrams) -> np.ndarray:
        return _sliced((self.values, self.sizes), (other.values, other.sizes))


METRICS = {"l2": _Vectors, "sliced": _Diagrams}


class _Piece:
    """Items of two blocks, at most PIECE of either: ids, tiles, distances, and which pairs count (None: all)."""

    def __init__(self, a: tuple, b: tuple, inner: bool, same: bool):
        (self.ia, self.ta, self.a), (self.ib, self.tb, self.b) = a, b
        self.d, self.keep = self.a.distances(self.b), None
        if inner:
            self.keep = np.triu(np.ones(self.d.shape, bool), 1)
        if same and len(np.intersect1d(self.ia, self.ib)):
            # Rows of one id are no pair.
            apart = self.ia[:, None] != self.ib
            self.keep = apart if self.keep is None else self.keep & apart

    def kept(self, values: np.ndarray) -> np.ndarray:
        return values.reshape(-1) if self.keep is None else values[self.keep]


def _pieces(batch: pa.RecordBatch, k: int, metric: str) -> Iterator[_Piece]:
    """A pair of blocks piece by piece, each pair of items in one of them; a block is in the order of its tiles."""

    def side(s: str) -> list[tuple]:
        get = lambda c: batch.column(f"{c}_{s}")[k].values.to_numpy(zero_copy_only=False)
        ids, tiles = get("ids"), get("tiles").astype(np.int64)
        items = METRICS[metric](get("xs").astype(np.float64), get("sizes").astype(np.int64))
        order = np.argsort(tiles, kind="stable")
        places = [order[lo : lo + PIECE] for lo in range(0, len(order), PIECE)]
        return [(ids[at], tiles[at], items.part(at)) for at in places]

    same = batch.column("block_a")[k].as_py() == batch.column("block_b")[k].as_py()
    a = side("a")
    b = a if same else side("b")
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if not same or i <= j:
                yield _Piece(x, y, same and i == j, same)


def _held_pieces(batch: pa.RecordBatch, k: int) -> Iterator[_Piece]:
    """The piece that a row of held() is."""
    get = lambda c: batch.column(c)[k].values.to_numpy(zero_copy_only=False)
    x = object.__new__(_Piece)
    x.ia, x.ta, x.ib, x.tb = get("ids_a"), get("tiles_a"), get("ids_b"), get("tiles_b")
    x.d, x.keep = get("d").reshape(len(x.ia), len(x.ib)).copy(), None
    if len(at := get("left_out")):
        x.keep = np.ones(x.d.shape, bool)
        x.keep.reshape(-1)[at] = False
    yield x


def held(pairs: DataFrame, metric: str) -> DataFrame:
    """The distances of all pieces as a table, a piece a row, for several passes by the metric `held`; 8 bytes a pair."""

    def work(pieces: Iterator[_Piece]) -> Iterator[list]:
        for x in pieces:
            out = np.flatnonzero(~x.keep) if x.keep is not None else np.zeros(0, np.int64)
            yield [[v.astype(np.int64)] for v in (x.ia, x.ta, x.ib, x.tb)] + [[x.d.reshape(-1)], [out]]

    out = cut(_blockwise(pairs, metric, work, "ids_a array<long>, tiles_a array<long>, ids_b array<long>, tiles_b array<long>, d array<double>, left_out array<long>"))
    out.blocks, out.metric = getattr(pairs, "blocks", None), metric
    return out


def _blockwise(pairs: DataFrame, metric: str, work, schema: str) -> DataFrame:
    """The rows that work makes of the pieces of each pair of blocks, as lists of columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for columns in work(_held_pieces(batch, k) if metric == "held" else _pieces(batch, k, metric)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return pairs.mapInArrow(run, schema)


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark's round does, half up by the shortest decimal form."""
    scale = 10.0**digits
    scaled = values * scale
    out = np.floor(scaled + 0.5) / scale
    # Near a half the decimal form decides.
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-6 + np.abs(scaled) * 1e-15):
        if math.isfinite(values[k]):
            out[k] = float(Decimal(repr(float(values[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def pair_distances(pairs: DataFrame, metric: str = "l2", digits: int | None = None) -> DataFrame:
    """(i, j, d) for every pair i < j; d rounded to so many digits, if given."""

    def work(pieces: Iterator[_Piece]) -> Iterator[list[np.ndarray]]:
        for x in pieces:
            i, j = x.kept(np.minimum(x.ia[:, None], x.ib)), x.kept(np.maximum(x.ia[:, None], x.ib))
            yield [i, j, x.kept(x.d) if digits is None else rounded(x.kept(x.d), digits)]

    return _blockwise(pairs, metric, work, "i long, j long, d double")


def closest_far_pairs(pairs: DataFrame, floor: float) -> DataFrame:
    """(i, j, d, gap): of the pairs of vectors at least `floor` apart, of each pair of blocks the one that differs least in its first number."""

    def work(pieces: Iterator[_Piece]) -> Iterator[list[np.ndarray]]:
        found = []
        for x in pieces:
            r, c = np.nonzero(x.d >= floor if x.keep is None else x.keep & (x.d >= floor))
            if not len(r):
                continue
            gap = np.abs(x.a.x[r, 0] - x.b.x[c, 0])
            r, c, gap = r[near := gap == gap.min()], c[near], gap[near]
            i, j = np.minimum(x.ia[r], x.ib[c]), np.maximum(x.ia[r], x.ib[c])
            k = np.lexsort((j, i))[0]
            found.append((gap[k], i[k], j[k], x.d[r[k], c[k]]))
        if found:
            gap, i, j, d = min(found)
            yield [np.array([v]) for v in (i, j, d, gap)]

    return _blockwise(pairs, "l2", work, "i long, j long, d double, gap double")


def _summed(keys: list[np.ndarray], *values: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of the keys, and the sums of values over them."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], 0)][: len(order)])
    return [k[first] for k in keys] + [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def _totals(parts: Iterator[list[np.ndarray]], n_keys: int) -> Iterator[list[np.ndarray]]:
    """The parts (keys, then values) with the values of equal keys added up, as far as a bounded store holds them."""
    held: list[list[np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > 1 << 18:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held = [_summed(columns[:n_keys], *columns[n_keys:])]
            size = len(held[0][0])
            if size > 1 << 17:
                yield held.pop()
                size = 0
    if size:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield _summed(columns[:n_keys], *columns[n_keys:])


def block_sums(pairs: DataFrame, sigma: float, kind: str = "gauss", metric: str = "l2") -> DataFrame:
    """(tile_a, tile_b, sum_k, n): kernel sums over all pairs of items of two tiles, tile_a <= tile_b, without the diagonal.

    kind: gauss, exp(-d2 / 2 sigma2); cubic, (x.y / dim + 1)^3; distance, d itself."""

    def sums(x: _Piece) -> list[np.ndarray]:
        if kind == "gauss":
            value = x.d
            value *= value
            value *= -1 / (2 * sigma * sigma)
            np.exp(value, out=value)
        else:
            value = x.a.cubic(x.b) if kind == "cubic" else x.d
        # Items are in the order of their tiles, so a tile is a run of rows or columns.
        (low, at_a, n_a), (high, at_b, n_b) = (np.unique(t, return_index=True, return_counts=True) for t in (x.ta, x.tb))
        over = lambda v: np.add.reduceat(np.add.reduceat(v, at_b, 1), at_a, 0).reshape(-1)
        a, b = np.repeat(low, len(high)), np.tile(high, len(low))
        if x.keep is None:
            total, n = over(value), np.outer(n_a, n_b).reshape(-1)
        else:
            total, n = over(np.where(x.keep, value, 0)), over(x.keep.astype(np.int64))
        ok = n > 0
        return [np.minimum(a, b)[ok], np.maximum(a, b)[ok], total[ok], n[ok]]

    def work(pieces: Iterator[_Piece]) -> Iterator[list[np.ndarray]]:
        return _totals((sums(x) for x in pieces), 2)

    parts = _blockwise(pairs, metric, work, "tile_a long, tile_b long, sum_k double, n long")
    return parts.groupBy("tile_a", "tile_b").agg(F.sum("sum_k").alias("sum_k"), F.sum("n").alias("n"))


#: Distances are told apart by their bits, which are in their order; the end of these.
_END = (1 << 63) - 1
#: Counters for a range of numbers; numbers that are few enough to be counted one by one.
_BINS, _FEW = 1 << 12, 1 << 20
#: Items of a block that the first ranges are guessed from.
_GUESS = {"l2": 1024, "sliced": 128}


def _guess(pairs: DataFrame, share: float, kinds: str, metric: str, positive: bool) -> dict[int, tuple[int, int]]:
    """Ranges of bits by kind that probably hold the percentile: those around it among some items of one block."""
    blocks, metric = getattr(pairs, "blocks", None), getattr(pairs, "metric", metric)
    if blocks is None:
        return {}
    n = _GUESS[metric]
    some = blocks.select(F.slice("tiles", 1, n).alias("tiles"), F.slice("sizes", 1, n).alias("sizes"), "xs")
    row = some.withColumn("xs", F.slice("xs", F.lit(1), F.aggregate("sizes", F.lit(0), lambda s, v: s + v))).first()
    if row is None:
        return {}
    tiles = np.array(row.tiles)
    items = METRICS[metric](np.array([np.nan if v is None else v for v in row.xs], np.float64), np.array(row.sizes, np.int64))
    r, c = np.triu_indices(len(tiles), 1)
    d = items.distances(items)[r, c]
    kind = (tiles[r] == tiles[c]).astype(int) if kinds == "tiles" else np.zeros(len(r), int)
    out = {}
    for k in np.unique(kind).tolist():
        found = d[(kind == k) & ((d > 0) if positive else (d >= 0))]
        if len(found) > 100:
            low, high = np.quantile(found, [max(0.0, share - 0.05), min(1.0, share + 0.05)]).view(np.int64).tolist()
            out[k] = (low, high + 1)
    return out


def distance_quantiles(pairs: DataFrame, share: float, kinds: str = "all", metric: str = "l2", positive: bool = True) -> dict[int, float]:
    """The exact percentile (interpolated) of the distances, or the positive ones, by kind: `all` (0), or by `tiles` (0 across, 1 within).

    No distance leaves a task: tasks count those of a range by its equal parts, and those below it. The part that holds the
    rank in question is the next range, until its numbers are so few that they are counted one by one. The first range is
    guessed; a rank that is not in it is looked for beside it."""
    guess = _guess(pairs, share, kinds, metric, positive)
    least = 1 if positive else 0
    # By kind and rank (the lower and the upper one): the range that holds it, from its first bits to before the last.
    places = {(k, p): guess.get(k, (least, _END)) for k in ((0, 1) if kinds == "tiles" else (0,)) for p in (0, 1)}
    few: set[tuple[int, int, int]] = set()
    totals: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    while len(found) < len(places):
        asked = sorted({(at[0], *r) for at, r in places.items() if at not in found})
        shifts = [0 if x in few else max(0, (x[2] - x[1]).bit_length() - _BINS.bit_length() + 1) for x in asked]

        def counts(x: _Piece, asked: list = asked, shifts: list = shifts) -> list[np.ndarray]:
            bits = x.d.view(np.int64) & _END
            out = []
            for kind in sorted({a[0] for a in asked}):
                ok = x.keep
                if kinds == "tiles":
                    ok = (x.ta[:, None] == x.tb) == bool(kind) if ok is None else ok & ((x.ta[:, None] == x.tb) == bool(kind))
                own = bits.reshape(-1) if ok is None else bits[ok]
                zeros = len(own) - np.count_nonzero(own) if positive else 0
                for at, (k, low, high) in enumerate(asked):
                    if k != kind:
                        continue
                    part = (own[(own >= low) & (own < high)] - low) >> shifts[at]
                    if shifts[at] and len(part) > _BINS // 4:
                        n = np.bincount(part)
                        bins = np.flatnonzero(n)
                        n = n[bins]
                    else:
                        bins, n = np.unique(part, return_counts=True)
                    # Bins -2 and -1 are for all of the kind, and for what is below the range.
                    out.append((np.full(len(bins) + 2, at), np.r_[-2, -1, bins], np.r_[len(own) - zeros, np.count_nonzero(own < low) - zeros, n]))
            return [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]

        def work(pieces: Iterator[_Piece], counts=counts) -> Iterator[list[np.ndarray]]:
            return _totals((counts(x) for x in pieces), 2)

        rows = _blockwise(pairs, metric, work, "at long, bin long, n long").groupBy("at", "bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")
        for at, (kind, low, high) in enumerate(asked):
            own = rows[rows["at"] == at]
            number, n = own["bin"].to_numpy(), own["n"].to_numpy()
            totals[kind] = int(n[number == -2].sum())
            below = int(n[number == -1].sum())
            number, n = number[number >= 0], n[number >= 0]
            through = below + np.cumsum(n)
            for p in (0, 1):
                if (kind, p) in found or places.get((kind, p)) != (low, high):
                    continue
                if not totals[kind]:
                    del places[kind, p]
                    continue
                rank = int((np.floor, np.ceil)[p]((totals[kind] - 1) * share))
                if rank < below:
                    places[kind, p] = (least, low)
                elif not len(n) or rank >= through[-1]:
                    places[kind, p] = (high, _END)
                else:
                    k = int(np.searchsorted(through, rank, "right"))
                    first = low + (int(number[k]) << shifts[at])
                    if shifts[at]:
                        places[kind, p] = (first, min(high, first + (1 << shifts[at])))
                        if n[k] <= _FEW:
                            few.add((kind, *places[kind, p]))
                    else:
                        found[kind, p] = first
    out = {}
    for kind in sorted({k for k, _ in found}):
        low, high = (float(np.array([found[kind, p]]).view(np.float64)[0]) for p in (0, 1))
        at = (totals[kind] - 1) * share
        out[kind] = float(low + (high - low) * (at - np.floor(at)))
    return out


def median_sigma(pairs: DataFrame, metric: str = "l2") -> float:
    """Median of the positive distances, 1.0 without any."""
    return distance_quantiles(pairs, 0.5, metric=metric).get(0, 1.0)


def mmd2(sums: DataFrame, splits: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """keys, n_a, n_b, mmd2: unbiased MMD2 of the items of tiles on side a against side b.

    sums: block sums; splits: (keys, tile, side); sizes: (tile, n_items). A side of at most one item gives 0."""
    left = splits.select(*keys, F.col("tile").alias("tile_a"), F.col("side").alias("sa"))
    right = splits.select(*keys, F.col("tile").alias("tile_b"), F.col("side").alias("sb"))
    # A split has few tiles, and splits times tiles are few beside the items; sums are at most tiles squared.
    pairs = left.join(right, [*keys]).where("tile_a <= tile_b").join(sums, ["tile_a", "tile_b"])
    part = lambda a, b: F.sum(F.when(((F.col("sa") == a) & (F.col("sb") == b)) | ((F.col("sa") == b) & (F.col("sb") == a)), F.col("sum_k")).otherwise(0.0))
    parts = pairs.groupBy(*keys).agg(part("a", "a").alias("kaa"), part("b", "b").alias("kbb"), part("a", "b").alias("kab"))
    count = lambda s: F.sum(F.when(F.col("side") == s, F.col("n_items")).otherwise(0))
    n = splits.join(sizes, "tile").groupBy(*keys).agg(count("a").alias("n_a"), count("b").alias("n_b"))
    value = 2 * F.col("kaa") / (F.col("n_a") * (F.col("n_a") - 1)) + 2 * F.col("kbb") / (F.col("n_b") * (F.col("n_b") - 1)) - 2 * F.col("kab") / (F.col("n_a") * F.col("n_b"))
    return parts.join(n, [*keys]).select(*keys, "n_a", "n_b", F.when((F.col("n_a") > 1) & (F.col("n_b") > 1), value).otherwise(0.0).alias("mmd2"))


def null_summary(null: DataFrame, *keys: str) -> DataFrame:
    """reps, smallest and mean sizes of the sides, and median, 95th percentile and greatest of the null values."""
    q = F.percentile("mmd2", F.array(F.lit(0.5), F.lit(0.95)))
    return null.groupBy(*keys).agg(
        F.count("*").alias("reps"), F.avg((F.col("n_a") + F.col("n_b")) / 2).alias("side_mean"), F.min(F.least("n_a", "n_b")).alias("side_min"), F.get(q, F.lit(0)).alias("median"), F.get(q, F.lit(1)).alias("p95"), F.max("mmd2").alias("greatest")
    )


def against_null(test: DataFrame, null: DataFrame) -> DataFrame:
    """One row: floor, median, ratio, share of test values above the floor, one-sided p of the test median, and whether it is rejected."""
    floor = null.agg(F.percentile("mmd2", 0.95).alias("floor"))
    middle = test.agg(F.percentile("mmd2", 0.5).alias("median"))
    both = F.broadcast(floor.crossJoin(middle))
    above = test.crossJoin(both).agg(F.avg((F.col("mmd2") > F.col("floor")).cast("int")).alias("above"))
    p = null.crossJoin(both).agg(F.avg((F.col("mmd2") >= F.col("median")).cast("int")).alias("p"))
    return floor.crossJoin(middle).crossJoin(above).crossJoin(p).select("floor", "median", F.try_divide("median", "floor").alias("ratio"), "above", "p", (F.col("median") > F.col("floor")).alias("rejected"))


def balanced_splits(tiles: list[int]) -> list[tuple[int, int, str]]:
    """(split, tile, side) for every split of an even number of tiles into halves, numbered by its bit mask; of an odd number,
    or of one that has more than MOST_SPLITS splits, as sized_splits."""
    half = len(tiles) // 2
    if len(tiles) % 2 or math.comb(len(tiles), half) > MOST_SPLITS:
        return sized_splits(tiles, half)
    return [(m, t, "a" if m >> i & 1 else "b") for m in range(1 << len(tiles)) if m.bit_count() == half for i, t in enumerate(tiles)]


def sized_splits(tiles: list[int], k: int) -> list[tuple[int, int, str]]:
    """(split, tile, side) of k tiles against k others: every such split, or where those are more than MOST_SPLITS, as many
    draws: the tiles in the order of a hash of (draw, tile), the first k against the next k, so that none is left out."""
    if math.comb(len(tiles), k) * math.comb(len(tiles) - k, k) <= MOST_SPLITS:
        pairs = [(a, b) for a in combinations(tiles, k) for b in combinations([t for t in tiles if t not in a], k)]
    else:
        orders = (sorted(tiles, key=lambda t: hashlib.md5(f"{rep},{t}".encode()).digest()) for rep in range(MOST_SPLITS))  # noqa: B023
        pairs = [(o[:k], o[k : 2 * k]) for o in orders]
    return [(i, t, side) for i, (a, b) in enumerate(pairs) for side, part in (("a", a), ("b", b)) for t in part]


def resampled(values: DataFrame, reps: int, order: list[str], value: str = "mmd2") -> DataFrame:
    """(rep, value): for each repetition as many draws with replacement as there are values, by a hash of (rep, draw)."""
    rows = cut(numbered(values.select(*order, value), order, "__i"))
    n = rows.count()
    draw = F.concat_ws(",", F.col("rep"), F.col("k"))
    place = F.conv(F.substring(F.md5(draw), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    draws = rows.sparkSession.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")).alias("k"))
    return draws.withColumn("__i", place).join(rows, "__i").select("rep", value)


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ranks from 1, ties sharing their mean; ranks are worked out over distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    ranks = running(counts, [value], {"__through": F.col("__n")}).select(F.col(value).alias("__v"), (F.col("__through") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, null where either side does not vary."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))


def allocation(counts: DataFrame, total: int, key: str = "province") -> DataFrame:
    """key, n, share: `total` dealt in proportion, half to even; the shares need not add up to the total."""
    return counts.select(key, "n", F.bround(F.lit(total) * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).cast("long").alias("share"))


def frechet(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray) -> float:
    """Frechet distance of two normal distributions; the trace of the root of cov_a cov_b by symmetric factors."""
    values, vectors = np.linalg.eigh(cov_a)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ cov_b @ root), 0)).sum()
    return float(((mean_a - mean_b) ** 2).sum() + np.trace(cov_a) + np.trace(cov_b) - 2 * cross)


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (ddof 1) of vectors x; partial sums of dim x dim leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 + dim + dim * dim)), pa.array(np.r_[n, s, q.reshape(-1)])], ["k", "v"])

    rows = vectors.select("x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()
    n, s, q = int(rows[0]), rows[1 : 1 + dim], rows[1 + dim :].reshape(dim, dim)
    mean = s / n
    return n, mean, (q - n * np.outer(mean, mean)) / max(1, n - 1)
