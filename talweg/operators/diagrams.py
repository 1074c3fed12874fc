"""Persistence diagrams: cleaning, curves, images, and distances.

A diagram is rows (patch_id, birth, death), or an array of such points for each patch; essential classes have a null death.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.operators import kernels

HUGE = 1e100


def filled_field(cell_rows: DataFrame, policy: str = "max", value: str = "z") -> DataFrame:
    """value with null, NaN and infinite cells replaced by the patch's finite max or min; a patch without finite cells stays null."""
    finite = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    pick = {"max": F.max, "min": F.min}[policy]
    return cell_rows.withColumn(value, F.coalesce(finite, pick(finite).over(W.partitionBy("patch_id"))))


def cleaned(pairs: DataFrame, patch_ids: DataFrame) -> DataFrame:
    """Finite pairs below HUGE; a patch without any has the dummy pair (0, 0)."""
    good = pairs.where(F.col("death").isNotNull() & (F.abs("birth") < HUGE) & (F.abs("death") < HUGE)).select("patch_id", F.col("birth").cast("double").alias("birth"), F.col("death").cast("double").alias("death"))
    return patch_ids.select("patch_id").join(good, "patch_id", "left").select("patch_id", F.coalesce("birth", F.lit(0.0)).alias("birth"), F.coalesce("death", F.lit(0.0)).alias("death"))


def pruned(pairs: DataFrame, eps: float) -> DataFrame:
    """Essential classes, and finite ones of at least eps; eps of 0 or less keeps all."""
    return pairs if eps <= 0 else pairs.where(F.col("death").isNull() | (F.col("death") - F.col("birth") >= eps))


def log_capped(pairs: DataFrame) -> DataFrame:
    """log10(max(x, 1)) of births and deaths; essential deaths at the greatest finite one plus 0.5 (1.0 without any)."""
    log = lambda c: F.log10(F.greatest(F.col(c).cast("double"), F.lit(1.0)))
    cap = pairs.agg(F.coalesce(F.max(log("death")) + 0.5, F.lit(1.0)).alias("cap"))
    return pairs.crossJoin(F.broadcast(cap)).select("patch_id", log("birth").alias("birth"), F.coalesce(log("death"), F.col("cap")).alias("death"))


def points(pairs: DataFrame) -> DataFrame:
    """patch_id, points: each patch's pairs as one sorted array, so that curves and distances are narrow steps."""
    point = F.struct(F.col("birth").cast("double").alias("birth"), F.col("death").cast("double").alias("death"))
    return pairs.groupBy("patch_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def as_items(point_rows: DataFrame) -> DataFrame:
    """(id, tile, x) from (id, tile, points): births and deaths in turn, as the blocks of pair distances take them."""
    return point_rows.select("id", "tile", F.flatten(F.transform("points", lambda p: F.array(p["birth"], p["death"]))).alias("x"))


def betti_curve(point_rows: DataFrame, grid: Column) -> DataFrame:
    """patch_id, i, t, n: classes alive at each threshold of the array `grid`."""
    out = point_rows.select("patch_id", "points", F.posexplode(grid).alias("i", "t"))
    alive = lambda p: (p["birth"] <= F.col("t")) & (p["death"].isNull() | (F.col("t") < p["death"]))
    return out.select("patch_id", "i", "t", F.size(F.filter("points", alive)).cast("long").alias("n"))


def landscape(point_rows: DataFrame, grid: Column, layers: int) -> DataFrame:
    """patch_id, i, k, value: the k-th greatest tent at each threshold, 0 beyond; finite classes only."""
    out = point_rows.select("patch_id", "points", F.posexplode(grid).alias("i", "t"))
    finite = F.filter("points", lambda p: p["death"].isNotNull())
    tents = F.reverse(F.array_sort(F.transform(finite, lambda p: F.greatest(F.lit(0.0), F.least(F.col("t") - p["birth"], p["death"] - F.col("t"))))))
    out = out.select("patch_id", "i", tents.alias("tents"))
    return out.select("patch_id", "i", "tents", F.explode(F.sequence(F.lit(1), F.lit(layers))).alias("k")).select("patch_id", "i", "k", F.coalesce(F.get("tents", F.col("k") - 1), F.lit(0.0)).alias("value"))


def image_sampled(point_rows: DataFrame, size: int, low: float, high: float) -> DataFrame:
    """patch_id, px, py, value: finite classes as Gaussians of one pixel's width over (birth, length), weighted by length, taken at pixel centers."""
    step = (high - low) / size
    out = point_rows.select("patch_id", "points", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("p")).withColumn("px", F.col("p") % size).withColumn("py", F.floor(F.col("p") / size).cast("int"))
    x, y = low + (F.col("px") + 0.5) * step, (F.col("py") + 0.5) * step

    def mass(p: Column) -> Column:
        length = p["death"] - p["birth"]
        dx, dy = (p["birth"] - x) / step, (length - y) / step
        return length * F.exp(-(dx * dx + dy * dy) / 2) / (2 * math.pi)

    finite = F.filter("points", lambda p: p["death"].isNotNull())
    return out.select("patch_id", "px", "py", F.aggregate(finite, F.lit(0.0), lambda a, p: a + mass(p)).alias("value"))


def euler_curve(cell_rows: DataFrame, levels: int = 16) -> DataFrame:
    """patch_id, level, chi: Euler characteristic of the cells at or below each of `levels` levels between the patch's extremes.

    Cells are vertices, neighbours in rows and columns edges, squares of four faces; a flat patch has 1 at every level."""
    w = W.partitionBy("patch_id")
    low, high = F.min("z").over(w), F.max("z").over(w)
    level = F.when(high > low, F.floor((F.col("z") - low) / (high - low) * (levels - 1))).otherwise(0).cast("int")
    at = cell_rows.withColumn("v", level)
    right, down = F.lead("v").over(W.partitionBy("patch_id", "r").orderBy("c")), F.lead("v").over(W.partitionBy("patch_id", "c").orderBy("r"))
    at = at.withColumn("right", right).withColumn("down", down)
    at = at.withColumn("corner", F.lead("right").over(W.partitionBy("patch_id", "c").orderBy("r")))
    pieces = F.array(
        F.struct(F.col("v").alias("level"), F.lit(1).alias("sign")), F.struct(F.greatest("v", F.when(F.col("right").isNotNull(), F.col("right"))).alias("level"), F.when(F.col("right").isNotNull(), -1).otherwise(0).alias("sign")),
        F.struct(F.greatest("v", "down").alias("level"), F.when(F.col("down").isNotNull(), -1).otherwise(0).alias("sign")), F.struct(F.greatest("v", "right", "down", "corner").alias("level"), F.when(F.col("corner").isNotNull(), 1).otherwise(0).alias("sign")),
    )
    steps = at.select("patch_id", F.explode(pieces).alias("p")).groupBy("patch_id", F.col("p.level").alias("level")).agg(F.sum("p.sign").alias("n"))
    grid = at.select("patch_id").distinct().select("patch_id", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    whole = grid.join(steps, ["patch_id", "level"], "left")
    return whole.select("patch_id", "level", F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("patch_id").orderBy("level")).alias("chi"))


def image_grid(pairs: DataFrame, pixels: int = 30) -> DataFrame:
    """One row: lo, hi (births), span (greatest persistence) and pixel of the grid that all diagrams (birth, death) share.

    A pixel is the span by `pixels`; a corpus without a span has the unit grid from 0."""
    life = F.max(F.col("death") - F.col("birth"))
    r = pairs.agg(F.min("birth").alias("lo"), F.max("birth").alias("hi"), life.alias("span"))
    span = F.when(F.col("span") > 0, F.col("span")).otherwise(1.0)
    pixel = span / pixels
    return r.select(F.coalesce("lo", F.lit(0.0)).alias("lo"), F.greatest(F.coalesce("hi", F.lit(0.0)), F.coalesce("lo", F.lit(0.0)) + pixel).alias("hi"), span.alias("span"), pixel.alias("pixel"))


def image_mass(point_rows: DataFrame, lo: float, hi: float, span: float, pixel: float) -> DataFrame:
    """patch_id, px, py, value: for each pixel of births and persistences the mass of a normal kernel of one pixel's width
    around each point, weighted by the point's persistence. Points with a null death are passed over."""
    across = lo + pixel * np.arange(math.ceil(round((hi - lo) / pixel, 9)) + 1)
    up = pixel * np.arange(math.ceil(round(span / pixel, 9)) + 1)

    def through(edges: np.ndarray, at: np.ndarray) -> np.ndarray:
        erf = np.frompyfunc(math.erf, 1, 1)
        return np.diff(0.5 * (1 + erf((edges[None] - at[:, None]) / (pixel * math.sqrt(2))).astype(np.float64)), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for patch, points in zip(batch.column("patch_id").to_pylist(), batch.column("points").to_pylist(), strict=True):
                x = np.array([(p["birth"], p["death"] - p["birth"]) for p in points or () if p["death"] is not None]).reshape(-1, 2)
                image = np.einsum("k,ki,kj->ji", x[:, 1], through(across, x[:, 0]), through(up, x[:, 1])) if len(x) else np.zeros((len(up) - 1, len(across) - 1))
                py, px = np.indices(image.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(image.size, patch, np.int64)), pa.array(px.astype(np.int32)), pa.array(py.astype(np.int32)), pa.array(image.reshape(-1))], ["patch_id", "px", "py", "value"])

    return point_rows.select("patch_id", "points").mapInArrow(run, "patch_id long, px int, py int, value double")


def sliced_wasserstein(pairs_of_points: DataFrame, directions: int = 50, cap: Column | None = None) -> DataFrame:
    """Adds sw to rows with arrays a and b of points: the mean over directions of the distance between sorted projections.

    Each side holds its own points and the other's projections to the diagonal. Essential deaths are set to `cap`, or to
    1.5 times the pair's greatest finite death (1.0 without any)."""
    greatest = F.array_max(F.transform(F.concat("a", "b"), lambda p: p["death"]))
    at = F.coalesce(cap if cap is not None else greatest * 1.5, F.lit(1.0))
    out = pairs_of_points.withColumn("__cap", at)
    capped = lambda side: F.transform(side, lambda p: F.struct(p["birth"].alias("x"), F.coalesce(p["death"], F.col("__cap")).alias("y")))
    out = out.withColumn("__a", capped("a")).withColumn("__b", capped("b"))
    angles = F.transform(F.sequence(F.lit(0), F.lit(directions - 1)), lambda k: -F.lit(math.pi / 2) + k * F.lit(math.pi) / directions)

    def along(own: str, other: str, t: Column) -> Column:
        flat = F.transform(other, lambda p: (p["x"] + p["y"]) / 2 * (F.cos(t) + F.sin(t)))
        return F.array_sort(F.concat(F.transform(own, lambda p: p["x"] * F.cos(t) + p["y"] * F.sin(t)), flat))

    gap = lambda t: F.aggregate(F.zip_with(along("__a", "__b", t), along("__b", "__a", t), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("sw", F.aggregate(F.transform(angles, gap), F.lit(0.0), lambda s, x: s + x) / directions).drop("__a", "__b", "__cap")


# Kernels


def sublevel_points(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(patch, dim, birth, death) of the sublevel sets of a stack of grids: cells join in rows and columns, squares of four
    are filled; essential classes have a NaN death.

    Holes are the bounded components of what lies above, which joins over 8 neighbours and beyond the edge."""
    n, h, w = z.shape
    flat = z.reshape(-1)
    low, high = kernels.Basins(z, ((-1, 0), (1, 0), (0, -1), (0, 1))), kernels.Basins(-z, kernels.STEPS, True)
    ends = np.repeat(np.nan, n)
    patch = np.r_[low.first // (h * w), np.arange(n), high.first // (h * w)]
    dim = np.r_[np.zeros(len(low.first) + n, np.int32), np.ones(len(high.first), np.int32)]
    birth = np.r_[flat[low.first], z.min((1, 2)), flat[high.saddle]]
    death = np.r_[flat[low.saddle], ends, flat[high.first]]
    some = np.flatnonzero(birth != death)
    some = some[np.lexsort((death[some], birth[some], dim[some], patch[some]))]
    return patch[some], dim[some], birth[some], death[some]


def sublevel_pairs(z: np.ndarray) -> list[tuple[int, float, float | None]]:
    """(dim, birth, death) of the sublevel sets of a grid."""
    _, dim, birth, death = sublevel_points(z[None])
    return [(int(d), float(a), None if math.isnan(b) else float(b)) for d, a, b in zip(dim, birth, death, strict=True)]


#: Cells of a stack that are worked on at once.
STACK = 1 << 19


def cubical(patch_rows: DataFrame, superlevel: bool = False) -> DataFrame:
    """patch_id, dim, birth, death of sublevel (or superlevel) sets, nodata cells filled with the patch's greatest value; essential classes have a null death."""
    schema = "patch_id long, dim int, birth double, death double"
    sign = -1.0 if superlevel else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, stack in kernels.stacks(batch):
                step = max(1, STACK // stack[0].size)
                for lo in range(0, len(rows), step):
                    z, ids = stack[lo : lo + step], rows[lo : lo + step]
                    finite = np.isfinite(z)
                    some = finite.any((1, 2))
                    z, ids, finite = z[some], ids[some], finite[some]
                    if not len(z):
                        continue
                    greatest = np.where(finite, z, -np.inf).max((1, 2), keepdims=True)
                    patch, dim, birth, death = sublevel_points(sign * np.where(finite, z, greatest))
                    none = np.isnan(death)
                    yield pa.RecordBatch.from_arrays([batch.column("patch_id").take(pa.array(ids[patch])).cast(pa.int64()), pa.array(dim), pa.array(sign * birth), pa.array(sign * death, mask=none)], ["patch_id", "dim", "birth", "death"])

    return patch_rows.select("patch_id", "label", "h", "w", "z").mapInArrow(run, schema)


def directional(patch_rows: DataFrame, directions: int = 8) -> DataFrame:
    """patch rows for each direction d: cells above the patch's mean hold their height along the direction on [-1, 1], others are null."""
    angle = F.col("d") * F.lit(2 * math.pi / directions)
    mean = F.aggregate("z", F.lit(0.0), lambda a, x: a + x) / F.size("z")
    out = patch_rows.select("patch_id", "label", "h", "w", "z", mean.alias("__m"), F.explode(F.sequence(F.lit(0), F.lit(directions - 1))).alias("d"))
    x = lambda k: (k % F.col("w")) / F.greatest(F.col("w") - 1, F.lit(1)) * 2 - 1
    y = lambda k: F.floor(k / F.col("w")) / F.greatest(F.col("h") - 1, F.lit(1)) * 2 - 1
    height = F.transform("z", lambda v, k: F.when(v > F.col("__m"), x(k) * F.cos(angle) + y(k) * F.sin(angle)))
    return out.select("patch_id", "label", "h", "w", "d", height.alias("z"))


def _matches_all(near: list[np.ndarray], m: int) -> bool:
    """Whether every row can be matched to a place of its own among its places: augmenting paths by layers, without recursion."""
    mate_row, mate = [-1] * len(near), [-1] * m
    for i, places in enumerate(near):  # most rows find a free place at once
        for j in places:
            if mate[j] < 0:
                mate_row[i], mate[j] = j, i
                break
    while True:
        free = [i for i, j in enumerate(mate_row) if j < 0]
        if not free:
            return True
        layer, now, found = dict.fromkeys(free, 0), free, False
        while now and not found:
            following = []
            for i in now:
                for j in near[i]:
                    if mate[j] < 0:
                        found = True
                    elif mate[j] not in layer:
                        layer[mate[j]] = layer[i] + 1
                        following.append(mate[j])
            now = following
        if not found:
            return False
        tried = [0] * len(near)
        for start in free:
            path = [start]
            while path:
                i = path[-1]
                if tried[i] == len(near[i]):
                    path.pop()
                    continue
                j = near[i][tried[i]]
                tried[i] += 1
                if mate[j] < 0:
                    for k in reversed(path):
                        mate_row[k], mate[j], j = j, k, mate_row[k]
                    break
                if layer.get(mate[j]) == layer[i] + 1:
                    path.append(mate[j])


def bottleneck(a: np.ndarray, b: np.ndarray) -> float:
    """Bottleneck distance of finite diagrams (n x 2), by search over the candidate distances with augmenting paths.

    A point whose distance to the diagonal is within the limit needs no partner, so a limit holds if the points of either
    diagram that need one can all be matched within it; the two matchings together give one that serves both."""
    half = [(x[:, 1] - x[:, 0]) / 2 if len(x) else np.zeros(0) for x in (a, b)]
    if not len(a) and not len(b):
        return 0.0
    apart = np.abs(a[:, None, 0] - b[None, :, 0]) if len(a) and len(b) else np.zeros((len(a), len(b)))
    if apart.size:
        np.maximum(apart, np.abs(a[:, None, 1] - b[None, :, 1]), out=apart)
    greatest = max(half[0].max(initial=0.0), half[1].max(initial=0.0))
    candidates = np.unique(np.r_[0.0, *half, apart[apart < greatest]])

    def holds(limit: float) -> bool:
        for cost, own in ((apart, half[0]), (apart.T, half[1])):
            rows = np.flatnonzero(own > limit)
            if len(rows) and not _matches_all([np.flatnonzero(cost[i] <= limit).tolist() for i in rows], cost.shape[1]):
                return False
        return True

    lo, hi = 0, len(candidates) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if holds(candidates[mid]) else (mid + 1, hi)
    return float(candidates[lo])


def bottleneck_rows(pairs_of_points: DataFrame, *keys: str) -> DataFrame:
    """keys and the bottleneck distance between the finite points of arrays a and b."""
    schema = pairs_of_points.select(*keys, F.lit(0.0).alias("distance")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ([np.array([(p["birth"], p["death"]) for p in x or () if p["death"] is not None]).reshape(-1, 2) for x in batch.column(c).to_pylist()] for c in ("a", "b"))
            found = [bottleneck(a, b) for a, b in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(found, pa.float64())], [*keys, "distance"])

    return pairs_of_points.select(*keys, "a", "b").mapInArrow(run, schema)
