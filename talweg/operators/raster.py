"""Raster operators over patch and cell rows."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.operators import kernels

#: Power-of-two pointers and the receiver codes (N to NW) that they stand for; 0 is no receiver.
POINTER_CODES = {64: 7, 128: 0, 1: 1, 32: 6, 2: 2, 16: 5, 8: 4, 4: 3, 0: -1}


def codes_of_pointers(df: DataFrame, pointer: str = "pointer", name: str = "code") -> DataFrame:
    """Adds the receiver code of a power-of-two pointer; null for any other value."""
    table = F.create_map(*[F.lit(x) for pair in POINTER_CODES.items() for x in pair])
    return df.withColumn(name, F.element_at(table, F.col(pointer).cast("int")))


def kth_threshold(cell_rows: DataFrame, k: int | Column, value: str = "acc") -> DataFrame:
    """patch_id, tau: the k-th largest value, k clamped to the number of cells, at least 1.0."""
    w = W.partitionBy("patch_id")
    ranked = cell_rows.select("patch_id", value, F.row_number().over(w.orderBy(F.desc(value))).alias("k"), F.count(value).over(w).alias("n"))
    wanted = F.greatest(F.lit(1), F.least(F.lit(k) if isinstance(k, int) else k, F.col("n")))
    return ranked.where(F.col("k") == wanted).select("patch_id", F.greatest(F.col(value).cast("double"), F.lit(1.0)).alias("tau"))


def density_rank(density: Column, area: Column, cell_km: Column) -> Column:
    """Cells that a drainage density asks for: half-to-even rounding; null unless all three are positive."""
    return F.when((density > 0) & (area > 0) & (cell_km > 0), F.bround(density * area / cell_km))


def tile_area_km2(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    mid = F.radians((min_lat + max_lat) / 2)
    return (max_lon - min_lon) * 111.32 * F.cos(mid) * ((max_lat - min_lat) * 110.57)


def cell_size_km(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, h: Column, w: Column) -> Column:
    mid = F.radians((min_lat + max_lat) / 2)
    return ((max_lon - min_lon) * 111.32 * F.cos(mid) / w + (max_lat - min_lat) * 110.57 / h) / 2


def gradient(cell_rows: DataFrame, value: str = "z") -> DataFrame:
    """Adds gy and gx: central differences, one-sided at the edges."""
    rows, columns = W.partitionBy("patch_id", "c").orderBy("r"), W.partitionBy("patch_id", "r").orderBy("c")

    def slope(w) -> Column:
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)

    return cell_rows.withColumn("gy", slope(rows)).withColumn("gx", slope(columns))


def hillshade(graded: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, factor: float = 1.0) -> DataFrame:
    """Adds shade in [0, 1] from gy and gx."""
    az, alt = F.radians(F.lit(360.0 - azimuth + 90.0)), F.radians(F.lit(altitude))
    slope = F.lit(np.pi / 2) - F.atan(F.hypot(F.col("gx") * factor, F.col("gy") * factor))
    aspect = F.atan2(-F.col("gx"), F.col("gy"))
    lit = F.sin(alt) * F.sin(slope) + F.cos(alt) * F.cos(slope) * F.cos(az - F.lit(np.pi / 2) - aspect)
    return graded.withColumn("shade", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lit + 1) / 2)))


def normalized(cell_rows: DataFrame, value: str = "z", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds norm: value between its patch's low and high percentiles, clipped to [0, 1]; a flat patch has hi = lo + 1."""
    edges = cell_rows.groupBy("patch_id").agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("__e"))
    out = cell_rows.join(edges, "patch_id").withColumn("__lo", F.col("__e")[0]).withColumn("__hi", F.when(F.col("__e")[1] <= F.col("__e")[0], F.col("__e")[0] + 1).otherwise(F.col("__e")[1]))
    norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))))
    return out.withColumn("norm", norm).drop("__e", "__lo", "__hi")


def between(value: Column, lo: float, hi: float) -> Column:
    """value between given bounds, clipped to [0, 1]; equal bounds have hi = lo + 1."""
    span = hi - lo if hi > lo else 1.0
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / span))


def geomorphic_stack(cell_rows: DataFrame) -> DataFrame:
    """(patch_id, cell, channel, level): hillshade, elevation and slope, each between its patch's percentiles, as 0 to 255."""
    graded = hillshade(gradient(cell_rows))
    slope = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    channels = graded.select("patch_id", "cell", F.posexplode(F.array("shade", "z", slope)).alias("channel", "v"))
    edges = channels.groupBy("patch_id", "channel").agg(F.percentile("v", F.array(F.lit(0.02), F.lit(0.98))).alias("e"))
    lo, hi = F.col("e")[0], F.col("e")[1]
    norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - lo) / F.when(hi <= lo, F.lit(1.0)).otherwise(hi - lo)))
    return channels.join(edges, ["patch_id", "channel"]).select("patch_id", "cell", "channel", to_uint8(F.round(norm, 6)).alias("level"))


def _cubic(t: Column) -> Column:
    a = F.abs(t)
    return F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1).when(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)


def resampled_cubic(patch_rows: DataFrame, h: int, w: int) -> DataFrame:
    """cell rows on an h x w grid over the same extent, by cubic weights of the sixteen cells around; edges are held. Narrow."""
    out = patch_rows.select("patch_id", "label", F.col("h").alias("__h"), F.col("w").alias("__w"), F.col("z").alias("__z"), F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("cell"))
    r, c = F.floor(F.col("cell") / w).cast("int"), F.col("cell") % w
    out = out.select("*", r.alias("r"), c.alias("c"), ((r + 0.5) * F.col("__h") / h - 0.5).alias("__y"), ((c + 0.5) * F.col("__w") / w - 0.5).alias("__x"))
    y, x = F.col("__y"), F.col("__x")
    held = lambda i, n: F.greatest(F.lit(0), F.least(i, n - 1))
    total = F.lit(0.0)
    for a in range(-1, 3):
        for b in range(-1, 3):
            i, j = F.floor(y).cast("int") + a, F.floor(x).cast("int") + b
            total = total + F.get("__z", held(i, F.col("__h")) * F.col("__w") + held(j, F.col("__w"))) * _cubic(y - i) * _cubic(x - j)
    return out.select("patch_id", "label", "cell", "r", "c", total.alias("z"))


def to_uint8(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(value * 255))).cast("int")


def reflected(r: Column, n: Column) -> Column:
    """Index with edge cells mirrored (d c b a | a b c d | d c b a)."""
    return F.when(r < 0, -r - 1).when(r >= n, 2 * n - 1 - r).otherwise(r)


def local_roughness(patch_rows: DataFrame, size: int = 5) -> DataFrame:
    """cell rows with rough: the standard deviation over a size x size window, edges mirrored. Narrow: array reads of one row."""
    reach = size // 2
    out = patch_rows.select("patch_id", "label", "h", "w", F.col("z").alias("__z"), F.posexplode("z").alias("cell", "z"))
    r, c = F.floor(F.col("cell") / F.col("w")).cast("int"), F.col("cell") % F.col("w")
    seen = F.array(*[
        F.get("__z", reflected(r + dr, F.col("h")) * F.col("w") + reflected(c + dc, F.col("w")))
        for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1)
    ])
    n = float(size * size)
    total = lambda f: F.aggregate("__seen", F.lit(0.0), lambda a, x: a + f(x)) / n
    out = out.withColumn("__seen", seen).withColumn("__m", total(lambda x: x)).withColumn("__q", total(lambda x: x * x))
    return out.select("patch_id", "label", "cell", r.alias("r"), c.alias("c"), "z", F.sqrt(F.greatest(F.col("__q") - F.col("__m") * F.col("__m"), F.lit(0.0))).alias("rough"))


def trench(patch_rows: DataFrame, depth: float, width: int = 1) -> DataFrame:
    """patch rows with a channel along the main diagonal, falling to `depth` below the patch's lowest cell, `width` cells to either side."""
    i, w = F.col("w"), F.col("w")
    floor_at = lambda k: F.array_min("z") - depth * (F.floor(k / w) + 1) / F.col("h")
    near = lambda k: F.abs(F.floor(k / i) - k % w) <= width - 1
    return patch_rows.withColumn("z", F.transform("z", lambda v, k: F.when(near(k), F.least(v, floor_at(k))).otherwise(v)))


def descriptors(flow_rows: DataFrame) -> DataFrame:
    """Substrate descriptors of each patch: relief, accumulation shares, Gini index and channel counts."""
    w = W.partitionBy("patch_id")
    ranked = flow_rows.select("*", F.row_number().over(w.orderBy("acc", "cell")).alias("k"), F.count("*").over(w).alias("n"))
    top = F.greatest(F.lit(1), F.floor(F.col("n") / 100).cast("int"))
    return ranked.groupBy("patch_id").agg(
        (F.stddev_pop("z") / (F.max("z") - F.min("z"))).alias("std_over_range"),
        (2 * F.sum(F.col("k") * F.col("acc")) / (F.max("n") * F.sum("acc")) - (F.max("n") + 1) / F.max("n")).alias("gini"),
        (F.sum(F.when(F.col("k") > F.col("n") - top, F.col("acc"))) / F.sum("acc")).alias("top_share"),
        (F.max("acc") / F.max("n")).alias("max_over_size"),
    )


def resampled(patch_rows: DataFrame, h: int, w: int) -> DataFrame:
    """cell rows on an h x w grid over the same extent, by bilinear weights of the four cells around. Narrow."""
    out = patch_rows.select("patch_id", "label", F.col("h").alias("__h"), F.col("w").alias("__w"), F.col("z").alias("__z"), F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("cell"))
    r, c = F.floor(F.col("cell") / w).cast("int"), F.col("cell") % w
    place = lambda i, n, m: F.greatest(F.lit(0.0), F.least((i + 0.5) * m / n - 0.5, (m - 1).cast("double")))
    out = out.select("*", r.alias("r"), c.alias("c"), place(r, h, F.col("__h")).alias("__y"), place(c, w, F.col("__w")).alias("__x"))
    y0, x0 = F.floor("__y").cast("int"), F.floor("__x").cast("int")
    y1, x1 = F.least(y0 + 1, F.col("__h") - 1), F.least(x0 + 1, F.col("__w") - 1)
    fy, fx = F.col("__y") - y0, F.col("__x") - x0
    at = lambda y, x: F.get("__z", y * F.col("__w") + x)
    z = at(y0, x0) * (1 - fy) * (1 - fx) + at(y0, x1) * (1 - fy) * fx + at(y1, x0) * fy * (1 - fx) + at(y1, x1) * fy * fx
    return out.select("patch_id", "label", "cell", "r", "c", z.alias("z"))


def _mapped(patch_rows: DataFrame, f, seeded: bool = False) -> DataFrame:
    """patch rows with z replaced by f(stack, patch ids); a narrow Arrow step."""
    schema = patch_rows.select("patch_id", "label", "h", "w", "z").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("patch_id").to_pylist()
            for rows, z in kernels.stacks(batch):
                new = f(z, [ids[i] for i in rows])
                n, h, w = z.shape
                flat = new.reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (h * w)), pa.array(flat, mask=np.isnan(flat)))
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("patch_id", "label", "h", "w")] + [lists], ["patch_id", "label", "h", "w", "z"])

    return patch_rows.select("patch_id", "label", "h", "w", "z").mapInArrow(run, schema)


def _ways(shape: tuple[int, int]) -> tuple[int, list[int]]:
    """Width of a grid with a margin of one cell, and the steps to the neighbours in it."""
    wide = shape[1] + 2
    return wide, [dr * wide + dc for dr, dc in kernels.STEPS]


def _bordered(z: np.ndarray) -> tuple[list[float], np.ndarray]:
    """The grid with a margin as one list, nodata and margin NaN, and its cells that touch either: where water leaves."""
    wide = np.pad(z, 1, constant_values=np.nan)
    dry = np.isnan(wide)
    touched = np.zeros(wide.shape, bool)
    for dr, dc in kernels.STEPS:
        touched |= np.roll(dry, (dr, dc), (0, 1))
    return wide.reshape(-1).tolist(), np.flatnonzero(touched & ~dry)


def flooded(z: np.ndarray, slope: float) -> np.ndarray:
    """A grid with each cell at least `slope` above the lowest neighbour on its lowest way out, by a priority flood."""
    _, steps = _ways(z.shape)
    height, outlets = _bordered(z)
    level: list[float | None] = [None] * len(height)
    heap = [(height[c], c) for c in outlets.tolist()]
    for v, c in heap:
        level[c] = v
    heapq.heapify(heap)
    while heap:
        v, c = heapq.heappop(heap)
        v += slope
        for step in steps:
            n = c + step
            own = height[n]
            if level[n] is None and own == own:
                level[n] = own if own > v else v
                heapq.heappush(heap, (level[n], n))
    out = np.array([math.nan if v is None else v for v in level]).reshape(z.shape[0] + 2, z.shape[1] + 2)[1:-1, 1:-1]
    return np.where(np.isnan(z), np.nan, out)


def breached_grid(z: np.ndarray, reach: int, slope: float) -> np.ndarray:
    """A grid in which ways are cut from pits to lower ground: of all ways of at most `reach` steps, the one that takes away
    least, falling by `slope` a step. Pits without such a way stay; the lowest pits are taken first."""
    _, steps = _ways(z.shape)
    height, outlets = _bordered(z)
    out = set(outlets.tolist())
    inside = [c for c, v in enumerate(height) if v == v and c not in out]
    pits = sorted((height[c], c) for c in inside if not any(height[c + s] < height[c] for s in steps))
    for _, pit in pits:
        low = height[pit]
        if any(height[pit + s] < low for s in steps):
            continue  # an earlier way has opened it
        best, came, done = {(pit, 0): 0.0}, {}, set()
        heap = [(0.0, 0, pit)]
        while heap:
            cost, k, c = heapq.heappop(heap)
            if c in done:
                continue
            done.add(c)
            if k and (c in out or height[c] < low - k * slope):
                at = (c, k)
                while at is not None:
                    height[at[0]] = min(height[at[0]], low - at[1] * slope)
                    at = came.get(at)
                break
            if k == reach:
                continue
            for s in steps:
                n = c + s
                v = height[n]
                if v != v or n in done:
                    continue
                total = cost + max(0.0, v - (low - (k + 1) * slope))
                if total < best.get((n, k + 1), math.inf):
                    best[n, k + 1], came[n, k + 1] = total, (c, k)
                    heapq.heappush(heap, (total, k + 1, n))
    return np.array(height).reshape(z.shape[0] + 2, z.shape[1] + 2)[1:-1, 1:-1]


def filled(patch_rows: DataFrame, slope: float = 1e-6) -> DataFrame:
    """Depressions raised to their lowest way out over the edge or nodata, rising by `slope` from cell to cell so that all of a patch drains."""
    return _mapped(patch_rows, lambda z, ids: np.stack([flooded(x, slope) for x in z]))


def breached(patch_rows: DataFrame, reach: int = 100, slope: float = 1e-6) -> DataFrame:
    """Depressions opened by least-cost ways of at most `reach` steps; those without one stay."""
    return _mapped(patch_rows, lambda z, ids: np.stack([breached_grid(x, reach, slope) for x in z]))


def conditioned(patch_rows: DataFrame, condition: str = "breach") -> DataFrame:
    """Patches ready for routing: depressions breached or filled."""
    ways = {"breach": breached, "fill": filled}
    if condition not in ways:
        raise ValueError(f"condition must be one of {sorted(ways)}, not {condition!r}")
    return ways[condition](patch_rows)


def gaussian_kernel(sigma: float) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return k / k.sum()


def smooth_stack(z: np.ndarray, sigma: float) -> np.ndarray:
    k = gaussian_kernel(sigma)
    reach = len(k) // 2
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (reach, reach)
        wide = np.pad(z, pad, mode="symmetric")
        z = sum(f * np.take(wide, np.arange(i, i + z.shape[axis]), axis=axis) for i, f in enumerate(k))
    return z


def smoothed(patch_rows: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing, edges mirrored."""
    return _mapped(patch_rows, lambda z, ids: smooth_stack(z, sigma))


def noisy(patch_rows: DataFrame, scale: float, sigma: float = 4.0, seed: int = 0) -> DataFrame:
    """Adds a smooth random field of standard deviation `scale`, seeded by patch."""

    def add(z: np.ndarray, ids: list) -> np.ndarray:
        fields = np.stack([np.random.default_rng([seed, int(i or 0)]).standard_normal(z.shape[1:]) for i in ids])
        fields = smooth_stack(fields, sigma)
        deviation = fields.std(axis=(1, 2), keepdims=True)
        return z + scale * fields / np.where(deviation > 0, deviation, 1)

    return _mapped(patch_rows, add)


def phase_surrogate(patch_rows: DataFrame, seed: int = 0) -> DataFrame:
    """Surrogates with the amplitude spectrum of each patch and random phases, seeded by patch."""

    def shuffle(z: np.ndarray, ids: list) -> np.ndarray:
        out = []
        for grid, i in zip(np.nan_to_num(z), ids, strict=True):
            noise = np.fft.rfft2(np.random.default_rng([seed, int(i or 0)]).standard_normal(grid.shape))
            out.append(np.fft.irfft2(np.abs(np.fft.rfft2(grid)) * noise / np.maximum(np.abs(noise), 1e-300), s=grid.shape))
        return np.stack(out)

    return _mapped(patch_rows, shuffle)
