"""Per-patch kernels over Arrow batches: each patch is one row, so none of them shuffles.

Patches of one shape are stacked and walked together, level by level downstream; a step is one array operation for all
cells of a level. Null elevations are nodata: they neither give nor receive flow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Receiver codes 0 to 7 are N, NE, E, SE, S, SW, W, NW as (row, column) steps.
STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
SQRT2 = 2.0**0.5


def stacks(batch: pa.RecordBatch, column: str = "z") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row positions, values n x h x w) for each shape in the batch; nulls are NaN, rows without cells are left out."""
    h, w = (np.array(batch.column(k).to_pylist(), dtype=object) for k in ("h", "w"))
    lists = batch.column(column)
    for shape in sorted({(a, b) for a, b in zip(h, w, strict=True) if a and b}):
        rows = [i for i in range(len(h)) if (h[i], w[i]) == shape and lists[i].is_valid and len(lists[i]) == shape[0] * shape[1]]
        if rows:
            values = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield np.array(rows), values.reshape(len(rows), *shape)


def receivers(z: np.ndarray) -> np.ndarray:
    """Steepest-descent receiver code of each cell, -1 without a lower neighbour; ties go to the lowest code."""
    n, h, w = z.shape
    padded = np.full((n, h + 2, w + 2), np.nan)
    padded[:, 1:-1, 1:-1] = z
    best, code = np.zeros(z.shape), np.full(z.shape, -1, np.int8)
    for k, (dr, dc) in enumerate(STEPS):
        drop = z - padded[:, 1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w]
        if dr and dc:
            drop = drop / SQRT2
        better = drop > best
        best[better], code[better] = drop[better], k
    return code


def targets(code: np.ndarray) -> np.ndarray:
    """Receiver's cell number for each cell (n x cells), -1 without one."""
    n, h, w = code.shape
    r, c = np.indices((h, w))
    dr, dc = (np.array([s[i] for s in STEPS])[code] for i in (0, 1))
    at = (r + dr) * w + c + dc
    return np.where(code >= 0, at, -1).reshape(n, -1)


def flat_targets(to: np.ndarray) -> np.ndarray:
    """Receivers by place in the whole stack (patch x cells + cell), -1 without one."""
    n, m = to.shape
    return np.where(to >= 0, to + np.arange(n)[:, None] * m, -1).reshape(-1)


def levels(to: np.ndarray, among: np.ndarray | None = None) -> list[np.ndarray]:
    """Places of a forest of receivers (flat), or of those among them, by the length of the longest way from a head: each
    before its receiver. A level is one step of array operations, and levels are far fewer than cells."""
    waiting = np.bincount(to[to >= 0], minlength=len(to)) if among is None else np.bincount(to[among][to[among] >= 0], minlength=len(to))
    some = np.arange(len(to)) if among is None else among
    out, left, now = [], len(some), some[waiting[some] == 0]
    while len(now):
        out.append(now)
        left -= len(now)
        t = to[now]
        t = t[t >= 0]
        np.subtract.at(waiting, t, 1)
        now = np.unique(t[waiting[t] == 0])
    if left:
        raise ValueError("receivers run in a circle")
    return out


def depth_order(to: np.ndarray) -> list[np.ndarray]:
    """The levels of the receivers (n x cells) of a stack."""
    return levels(flat_targets(to))


def accumulation(to: np.ndarray, order: list[np.ndarray]) -> np.ndarray:
    """Cells draining through each cell, itself included; 0 where nothing flows in or out. order: the levels of the stack."""
    flat = flat_targets(to)
    acc = (flat >= 0).astype(np.int64)
    acc[flat[flat >= 0]] = 1
    for now in order:
        t = flat[now]
        on = t >= 0
        np.add.at(acc, t[on], acc[now[on]])
    return acc.reshape(to.shape)


def last_of(pointer: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where each place's pointers lead: to the first place that stops, or -1; each round doubles the way."""
    while True:
        on = (pointer >= 0) & ~stop[pointer]
        if not on.any():
            return pointer
        pointer = np.where(on, pointer[pointer], pointer)


class Forest:
    """The donor-graph merge trees of masked cells: nodes are heads and confluences, edges lead to the next node downstream.

    Cells are walked over by doubled pointers, nodes, which are far fewer, by levels of their tree."""

    def __init__(self, to: np.ndarray, acc: np.ndarray, mask: np.ndarray):
        n, m = to.shape
        self.acc, self.mask = acc, mask
        flat, flow, wet = flat_targets(to), acc.reshape(-1), mask.reshape(-1)
        inside = wet & (flat >= 0) & wet[flat]
        self.to = np.where(inside.reshape(n, m), to, -1)
        flat = np.where(inside, flat, -1)
        self.donors = np.bincount(flat[inside], minlength=n * m).reshape(n, m)
        if np.any(flow[flat[inside]] <= flow[inside]):
            raise ValueError("accumulation does not rise downstream")
        self.head, self.confluence = mask & (self.donors == 0), mask & (self.donors >= 2)
        self.node = self.head | self.confluence
        node, head = self.node.reshape(-1), self.head.reshape(-1)
        parent = np.where(node, last_of(flat, node), -1)
        some = np.flatnonzero(node)
        # Upstream first: orders, oldest births and descendants rise to the parents.
        top, times, below, order = (np.zeros(n * m, np.int64) for _ in range(4))
        oldest = np.where(head, flow, np.iinfo(np.int64).max)
        for now in levels(parent, some):
            order[now] = np.where(head[now], 1, np.where(times[now] == 1, top[now], top[now] + 1))
            now = now[parent[now] >= 0]
            p, mine = parent[now], order[now]
            before = top[p]
            np.maximum.at(top, p, mine)
            times[p[top[p] > before]] = 0
            np.add.at(times, p[mine == top[p]], 1)
            np.minimum.at(oldest, p, oldest[now])
            np.add.at(below, p, below[now] + 1)
        root = last_of(np.where(parent >= 0, parent, np.arange(n * m)), parent < 0)
        #: Places downstream within the mask, flat.
        self.flat = flat
        cell = lambda x: np.where(x >= 0, x % m, -1).reshape(n, m)
        self.parent, self.root = cell(parent), cell(np.where(node, root, -1))
        self.order, self.below = order.reshape(n, m), below.reshape(n, m)
        self.oldest = np.where(self.node, oldest.reshape(n, m), 0)

    def segments(self) -> np.ndarray:
        """The node that each masked cell is downstream of, itself if it is one: the segment that leads to the next node; -1 elsewhere."""
        node, m = self.node.reshape(-1), self.node.shape[1]
        out = np.where(node, np.arange(len(node)), -1)
        for now in levels(self.flat, np.flatnonzero(self.mask.reshape(-1))):
            t = self.flat[now]
            on = (t >= 0) & ~node[t]
            out[t[on]] = out[now[on]]
        return np.where(out >= 0, out % m, -1).reshape(self.node.shape)


FLOW = T.StructType([
    T.StructField("patch_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType()),
    T.StructField("z", T.DoubleType()), T.StructField("code", T.IntegerType()), T.StructField("recv", T.IntegerType()), T.StructField("acc", T.LongType()),
])
NODES = T.StructType([
    T.StructField("patch_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("is_head", T.BooleanType()),
    T.StructField("birth", T.LongType()), T.StructField("death", T.LongType()), T.StructField("oldest", T.LongType()), T.StructField("strahler", T.IntegerType()), T.StructField("n_below", T.LongType()), T.StructField("root", T.IntegerType()),
])


def _nullable(values: np.ndarray, none: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=none) if len(values) else pa.nulls(0, kind)


def _ids(batch: pa.RecordBatch, rows: np.ndarray, times: np.ndarray | int) -> list[pa.Array]:
    at = pa.array(np.repeat(rows, times))
    return [batch.column("patch_id").take(at).cast(pa.int64()), batch.column("label").take(at).cast(pa.int32())]


def routed(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(codes, receivers, accumulation, levels) of stacked elevations."""
    code = receivers(z)
    to = targets(code)
    order = depth_order(to)
    return code.reshape(len(z), -1), to, accumulation(to, order), order


def flow(patch_rows: DataFrame) -> DataFrame:
    """Cell rows with receiver code, receiver cell and accumulation (pits: code -1, recv null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, z in stacks(batch):
                n, h, w = z.shape
                code, to, acc, _ = routed(z)
                cell = np.tile(np.arange(h * w), n)
                zs = z.reshape(-1)
                columns = [*_ids(batch, rows, h * w), cell, cell // w, cell % w, _nullable(zs, np.isnan(zs), pa.float64()), code.reshape(-1), _nullable(to.reshape(-1), to.reshape(-1) < 0, pa.int32()), acc.reshape(-1)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], FLOW.names).cast(pa.schema([(f.name, {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}[f.dataType]) for f in FLOW]))

    return patch_rows.select("patch_id", "label", "h", "w", "z").mapInArrow(run, FLOW)


def _node_batches(batch: pa.RecordBatch, rows: np.ndarray, forest: Forest) -> pa.RecordBatch:
    at, cell = np.nonzero(forest.node)
    parent = forest.parent[at, cell]
    death = forest.acc[at, np.maximum(parent, 0)]
    ids = pa.array(rows[at])
    return pa.RecordBatch.from_arrays([
        batch.column("patch_id").take(ids).cast(pa.int64()), batch.column("label").take(ids).cast(pa.int32()), pa.array(cell, pa.int32()), _nullable(parent, parent < 0, pa.int32()), pa.array(forest.head[at, cell]),
        pa.array(forest.acc[at, cell], pa.int64()), _nullable(death, parent < 0, pa.int64()), pa.array(forest.oldest[at, cell], pa.int64()), pa.array(forest.order[at, cell], pa.int32()), pa.array(forest.below[at, cell], pa.int64()), pa.array(forest.root[at, cell], pa.int32()),
    ], NODES.names)


def merge_tree(patch_rows: DataFrame, tau: int = 2, kth: int | None = None) -> DataFrame:
    """Node rows of the merge trees over cells with accumulation of at least tau; with kth, of at least each patch's
    kth greatest accumulation (and 1) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, z in stacks(batch):
                _, to, acc, _ = routed(z)
                least = tau
                if kth is not None:
                    k = min(max(kth, 1), acc.shape[1])
                    least = np.maximum(np.partition(acc, acc.shape[1] - k, axis=1)[:, [acc.shape[1] - k]], 1)
                yield _node_batches(batch, rows, Forest(to, acc, acc >= least))

    return patch_rows.select("patch_id", "label", "h", "w", "z").mapInArrow(run, NODES)


STREAM = "patch_id long, cell int, segment int, strahler int, acc long"


def stream_cells(patch_rows: DataFrame, tau: int = 2) -> DataFrame:
    """The stream raster: masked cells with their segment (its first node) and that node's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, z in stacks(batch):
                _, to, acc, _ = routed(z)
                forest = Forest(to, acc, acc >= tau)
                segment = forest.segments()
                at, cell = np.nonzero(segment >= 0)
                own = segment[at, cell]
                ids = batch.column("patch_id").take(pa.array(rows[at])).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int32)) for x in (cell, own, forest.order[at, own])), pa.array(acc[at, cell])], ["patch_id", "cell", "segment", "strahler", "acc"])

    return patch_rows.select("patch_id", "label", "h", "w", "z").mapInArrow(run, STREAM)


def merge_tree_of_codes(code_rows: DataFrame, tau: int = 1) -> DataFrame:
    """The same from given receiver codes: patch rows whose `z` holds codes (-1: none) instead of elevations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, z in stacks(batch):
                to = targets(z.astype(np.int8))
                order = depth_order(to)
                acc = accumulation(to, order)
                yield _node_batches(batch, rows, Forest(to, acc, acc >= tau))

    return code_rows.select("patch_id", "label", "h", "w", "z").mapInArrow(run, NODES)


# Joins of components as cells come in by value


class Basins:
    """Steepest-descent basins of a stack of grids, joined at their saddles by falling age: the pairs of H0 of the sublevel
    sets in the total order (value, cell). Cells that are not `wet` are not there.

    Basins, not cells, go through the union-find: a cell joins its lowest neighbour the moment that it comes in."""

    def __init__(self, values: np.ndarray, steps: tuple[tuple[int, int], ...], outside: bool = False, wet: np.ndarray | None = None):
        n, h, w = values.shape
        size = n * h * w
        flat = values.reshape(-1)
        wet = np.ones(size, bool) if wet is None else wet.reshape(-1)
        order = np.argsort(flat, kind="stable")
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        none = size + n  # beyond all ranks
        grid = np.where(wet, rank, none).reshape(n, h, w)
        around = np.full((n, h + 2, w + 2), none, np.int64)
        if outside:
            around[:] = -1
        around[:, 1:-1, 1:-1] = grid
        low = grid.copy()
        for dr, dc in steps:
            np.minimum(low, around[:, 1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w], out=low)
        low = low.reshape(-1)
        # Places beyond the grids stand for what lies outside of each.
        patch = np.repeat(np.arange(n), h * w)
        to = np.where(low < 0, size + patch, order[np.minimum(np.maximum(low, 0), size - 1)])
        to = np.r_[np.where(wet, to, np.arange(size)), np.arange(size, size + n)]
        while True:
            further = to[to]
            if np.array_equal(further, to):
                break
            to = further
        self.rank, self.basin, self.order = np.r_[rank, np.full(n, -1)], to, order
        label, low_of = to[:size].reshape(n, h, w), grid
        edges = []
        for dr, dc in steps:
            if (dr, dc) > (0, 0):
                here = np.s_[:, : h - dr, max(0, -dc) : w - max(0, dc)]
                there = np.s_[:, dr:, max(0, dc) : w + min(0, dc)]
                a, b, at = label[here].reshape(-1), label[there].reshape(-1), np.maximum(low_of[here], low_of[there]).reshape(-1)
                apart = (a != b) & (at < none)
                edges.append((np.minimum(a, b)[apart], np.maximum(a, b)[apart], at[apart]))
        a, b, at = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 3
        by = np.argsort(at, kind="stable")
        _, first = np.unique(a[by] * np.int64(size + n) + b[by], return_index=True)
        by = by[np.sort(first)]
        names, where = np.unique(np.r_[a[by], b[by]], return_inverse=True)
        where = where.reshape(2, -1)
        # The older of two components is that of the lesser rank; outside is older than all.
        age = self.rank[names].tolist()
        parent = list(range(len(names)))
        joins = []
        for i, j, k in zip(where[0].tolist(), where[1].tolist(), at[by].tolist(), strict=True):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            while parent[j] != j:
                parent[j] = j = parent[parent[j]]
            if i != j:
                if age[j] < age[i]:
                    i, j = j, i
                parent[j] = i
                joins.append((j, k))
        young, saddle = np.array(joins, np.int64).reshape(-1, 2).T
        #: Places of the younger component's first cell, and of the cell that joined it.
        self.first, self.saddle = names[young], order[saddle]
