"""Topology over node rows of merge trees, flowlines and masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.operators import kernels


def persistence_pairs(nodes: DataFrame) -> DataFrame:
    """patch_id, node, birth, death: at each confluence the oldest child lives on, each other gives a pair; roots have no death."""
    age = W.partitionBy("patch_id", "parent").orderBy("oldest", "node")
    ranked = nodes.withColumn("k", F.row_number().over(age))
    return ranked.where(F.col("parent").isNull() | (F.col("k") > 1)).select("patch_id", "label", "node", F.col("oldest").alias("birth"), "death")


def distribution(nodes: DataFrame, *keys: str) -> DataFrame:
    return nodes.groupBy(*keys, "strahler").agg(F.count("*").alias("n"))


def bifurcation(dist: DataFrame, *keys: str) -> DataFrame:
    """keys, rb: mean ratio of the counts of consecutive present orders; null with fewer than two orders."""
    following = F.lead("n").over(W.partitionBy(*keys).orderBy("strahler"))
    return dist.withColumn("ratio", F.col("n") / following).groupBy(*keys).agg(F.avg("ratio").alias("rb"))


def basins(nodes: DataFrame) -> DataFrame:
    """patch_id, root, n_below: the root with the most descendants, the least cell of equal ones."""
    first = W.partitionBy("patch_id").orderBy(F.desc("n_below"), "node")
    return nodes.where("parent is null").withColumn("k", F.row_number().over(first)).where("k = 1").select("patch_id", "label", F.col("node").alias("root"), "n_below")


def junctions(nodes: DataFrame, *keys: str) -> DataFrame:
    return nodes.groupBy(*keys).agg(F.count_if("is_head").alias("leaves"), F.count_if(~F.col("is_head")).alias("junctions"), F.count_if(F.col("parent").isNull()).alias("roots"))


def persistence_statistics(pairs: DataFrame, *keys: str) -> DataFrame:
    """Counts of finite and essential classes; total, greatest and mean length of finite ones, 0 without any."""
    length = F.col("death") - F.col("birth")
    zero = F.lit(0.0)
    return pairs.groupBy(*keys).agg(
        F.count("death").alias("n_finite"), F.count_if(F.col("death").isNull()).alias("n_essential"), F.coalesce(F.sum(length).cast("double"), zero).alias("total"),
        F.coalesce(F.max(length).cast("double"), zero).alias("longest"), F.coalesce(F.avg(length), zero).alias("mean"),
    )


def wasserstein1(samples: DataFrame, a: str, b: str, value: str, *keys: str) -> DataFrame:
    """keys, w1: distance between two weighted distributions over `value`, given as weight columns a and b (both may be 0 or null).

    An empty side counts as all mass at 0."""
    w = W.partitionBy(*keys)
    padded = samples.select(*keys, F.col(value).cast("double").alias("x"), F.coalesce(F.col(a), F.lit(0)).cast("double").alias("a"), F.coalesce(F.col(b), F.lit(0)).cast("double").alias("b"))
    zero = padded.select(*keys).distinct().select(*keys, F.lit(0.0).alias("x"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    whole = padded.unionByName(zero).groupBy(*keys, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    for side in ("a", "b"):
        total = F.sum(side).over(w)
        whole = whole.withColumn(f"{side}_share", F.when(total > 0, F.col(side) / total).otherwise((F.col("x") == 0).cast("double")))
    up = W.partitionBy(*keys).orderBy("x")
    through = up.rowsBetween(W.unboundedPreceding, 0)
    gap = F.abs(F.sum("a_share").over(through) - F.sum("b_share").over(through)) * (F.lead("x").over(up) - F.col("x"))
    return whole.withColumn("gap", gap).groupBy(*keys).agg(F.coalesce(F.sum("gap"), F.lit(0.0)).alias("w1"))


def mask_components(mask: np.ndarray) -> np.ndarray:
    """Number of 8-connected components of each mask in a stack."""
    n, h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        padded = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=h * w)
        low = np.min([padded[:, 1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w] for dr, dc in kernels.STEPS], axis=0)
        new = np.where(mask, np.minimum(label, low), h * w)
        if np.array_equal(new, label):
            return (label == np.arange(h * w).reshape(h, w)).sum((1, 2))
        label = new


def mask_h1(patch_rows: DataFrame, tau: int = 2) -> DataFrame:
    """patch_id, v, e, components, h1 of the mask of cells with accumulation of at least tau, joined over 8 neighbours, and donor_h1 along the flow."""
    schema = "patch_id long, v long, e long, components long, h1 long, donor_h1 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, z in kernels.stacks(batch):
                _, to, acc, _ = kernels.routed(z)
                forest = kernels.Forest(to, acc, acc >= tau)
                mask = (acc >= tau).reshape(z.shape)
                padded = np.pad(mask, ((0, 0), (1, 1), (1, 1)))
                h, w = z.shape[1:]
                v = mask.sum((1, 2))
                e = sum((mask & padded[:, 1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w]).sum((1, 2)) for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)))
                c = mask_components(mask)
                flow_edges, roots = (forest.to >= 0).sum(1), ((forest.to < 0) & forest.mask).sum(1)
                columns = [batch.column("patch_id").take(pa.array(rows)).cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in (v, e, c, e - v + c, flow_edges - v + roots))]
                yield pa.RecordBatch.from_arrays(columns, ["patch_id", "v", "e", "components", "h1", "donor_h1"])

    return patch_rows.select("patch_id", "label", "h", "w", "z").mapInArrow(run, schema)


def filtration_joins(values: np.ndarray, mask: np.ndarray, descending: bool = False) -> list[tuple[int, int]]:
    """(cell, components joined) for cells that join two or more 8-connected components as cells come in by (value, cell)."""
    place, joined = stack_joins(values[None], mask[None], descending)
    return list(zip(place.tolist(), joined.tolist(), strict=True))


def stack_joins(values: np.ndarray, mask: np.ndarray, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The same for a stack of grids: places (patch x cells + cell) in the order they come in, and components joined."""
    keys = -values if descending else values
    place, n = np.unique(kernels.Basins(keys, kernels.STEPS, wet=mask).saddle, return_counts=True)
    order = np.lexsort((place, keys.reshape(-1)[place]))
    return place[order], n[order] + 1


def cubical_confluences(patch_rows: DataFrame, tau: int = 2, descending: bool = False) -> DataFrame:
    """patch_id, cell, joined: the 8-neighbour control that takes cells in by accumulation, without regard to flow."""
    schema = "patch_id long, cell int, joined int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, z in kernels.stacks(batch):
                _, _, acc, _ = kernels.routed(z)
                m = acc.shape[1]
                acc = acc.reshape(z.shape)
                place, joined = stack_joins(acc, acc > 0 if descending else acc >= tau, descending)
                ids = batch.column("patch_id").take(pa.array(rows[place // m])).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array((place % m).astype(np.int32)), pa.array(joined.astype(np.int32))], ["patch_id", "cell", "joined"])

    return patch_rows.select("patch_id", "label", "h", "w", "z").mapInArrow(run, schema)


def flowline_edges(lines: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Directed edges from lines (line_id, tile, vertices array<struct<x, y>>): snapped first to last vertex; self-loops go, parallel edges stay."""
    snap = lambda v: F.struct(F.bround(v["x"] / tolerance).cast("long").alias("x"), F.bround(v["y"] / tolerance).cast("long").alias("y"))
    length = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size("vertices") - 1, F.lit(1))), F.lit(0.0),
        lambda a, i: a + F.coalesce(F.hypot(F.get("vertices", i)["x"] - F.get("vertices", i - 1)["x"], F.get("vertices", i)["y"] - F.get("vertices", i - 1)["y"]), F.lit(0.0)),
    )
    out = lines.where(F.size("vertices") >= 2).select("tile", "line_id", snap(F.get("vertices", F.lit(0))).alias("src"), snap(F.element_at("vertices", -1)).alias("dst"), length.alias("degrees"))
    return out.where("src != dst")


def flowline_statistics(edges: DataFrame, area_km2: Column) -> DataFrame:
    """tile, junctions (two or more edges in), roots (no edge out), edges, density in km per km2 (null without an area)."""
    into = edges.groupBy("tile", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    out = edges.select("tile", F.col("src").alias("node")).distinct().withColumn("leaves", F.lit(1))
    per_node = into.join(out, ["tile", "node"], "left").groupBy("tile").agg(F.count_if(F.col("n_in") >= 2).alias("junctions"), F.count_if(F.col("leaves").isNull()).alias("roots"))
    whole = edges.groupBy("tile").agg(F.count("*").alias("edges"), F.sum("degrees").alias("degrees"))
    return whole.join(per_node, "tile").select("tile", "edges", "junctions", "roots", F.when(area_km2 > 0, F.col("degrees") * 111 / area_km2).alias("density"))


def flowline_orders(edges: DataFrame) -> DataFrame:
    """(tile, strahler, n): Strahler orders of the nodes of each tile's directed edges, parallel edges counted apart.

    A node's order is the greatest of its donors', one more if two of them have it; heads, and nodes on or below a circle,
    have order 1. A tile's network is in one task."""

    def orders(tile: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.r_[tile.src.to_numpy(), tile.dst.to_numpy()], return_inverse=True)
        src, dst = at.reshape(2, -1)
        waiting = np.bincount(dst, minlength=len(names))
        out_edges = np.argsort(src, kind="stable")
        ends = np.searchsorted(src[out_edges], np.arange(len(names) + 1))
        top, times, order = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.ones(len(names), np.int64)
        now = np.flatnonzero(waiting == 0)
        while len(now):
            order[now] = np.maximum(1, np.where(times[now] > 1, top[now] + 1, top[now]))
            along = np.concatenate([out_edges[ends[k] : ends[k + 1]] for k in now])
            to, mine = dst[along], order[src[along]]
            before = top[to]
            np.maximum.at(top, to, mine)
            times[to[top[to] > before]] = 0
            np.add.at(times, to[mine == top[to]], 1)
            np.subtract.at(waiting, to, 1)
            now = np.unique(to[waiting[to] == 0])
        found, n = np.unique(order, return_counts=True)
        return pd.DataFrame({"tile": tile.tile.iloc[0], "strahler": found.astype(np.int32), "n": n.astype(np.int64)})

    node = lambda c: F.concat_ws(":", F.col(c)["x"].cast("string"), F.col(c)["y"].cast("string")).alias(c)
    kind = dict(edges.dtypes)["tile"]
    return edges.select("tile", node("src"), node("dst")).groupBy("tile").applyInPandas(orders, f"tile {kind}, strahler int, n long")


def flowline_branching(edges: DataFrame, area_km2: Column) -> DataFrame:
    """flowline_statistics with the greatest order and the bifurcation ratio of each tile."""
    dist = flowline_orders(edges)
    orders = dist.groupBy("tile").agg(F.max("strahler").alias("max_order"))
    return flowline_statistics(edges, area_km2).join(orders, "tile").join(bifurcation(dist, "tile"), "tile")


def branching_agreement(a: DataFrame, b: DataFrame, dist_a: DataFrame, dist_b: DataFrame, key: str = "tile") -> DataFrame:
    """The two sides' (key, junctions, rb, density) tile by tile: both values of each, the distance of their order
    distributions (key, strahler, n), and the difference of the ratios (null where one has none)."""
    names = ("junctions", "rb", "density")
    both = a.select(key, *[F.col(c).alias(f"{c}_a") for c in names]).join(b.select(key, *[F.col(c).alias(f"{c}_b") for c in names]), key)
    weights = dist_a.withColumnRenamed("n", "a").join(dist_b.withColumnRenamed("n", "b"), [key, "strahler"], "full")
    return both.join(wasserstein1(weights, "a", "b", "strahler", key), key).withColumn("rb_difference", F.abs(F.col("rb_a") - F.col("rb_b")))


def branching_shift(junctions_a: Column, junctions_b: Column, rb_a: Column, rb_b: Column, distance: Column, orders: Column) -> Column:
    """Greatest of the relative changes in junctions and ratio and of the distance per order; nulls are passed over."""
    return F.greatest(F.abs(junctions_b - junctions_a) / F.greatest(junctions_a, F.lit(1)), F.abs(rb_b - rb_a) / F.when(rb_a != 0, rb_a), distance / F.greatest(orders, F.lit(1)))
