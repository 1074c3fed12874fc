"""Joins of boxes.

Box joins are equi-joins on grid cells: both sides are dealt to the cells that they touch, met within a cell, and a
pair is kept only in the one cell that holds the corner of its common part, so no pair is met twice and none is lost.
A side is dealt to many cells only if its boxes are much larger than `CELL`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.functions import coords

CELL = 8.0
#: Rows among which equal shapes are put together; no list of keys is longer.
TOGETHER = 1 << 14
#: Pairs of rows in a cell that one task is to work through.
PAIRS_A_TASK = 1 << 22


def _dealt(df: DataFrame, box: str, cell: float) -> DataFrame:
    steps = lambda lo, hi: F.sequence(F.floor(F.col(box)[lo] / cell).cast("long"), F.floor(F.col(box)[hi] / cell).cast("long"))
    out = df.where(F.col(box).isNotNull()).withColumn("__x", F.explode(steps("min_x", "max_x")))
    return out.withColumn("__y", F.explode(steps("min_y", "max_y")))


def box_join(left: DataFrame, right: DataFrame, a: str, b: str, strict: bool = False, cell: float = CELL) -> DataFrame:
    """Pairs of rows whose boxes meet (strict: share an area). Column names of the sides must differ."""
    met = _dealt(left, a, cell).join(_dealt(right, b, cell), ["__x", "__y"])
    corner = lambda lo: F.floor(F.greatest(F.col(a)[lo], F.col(b)[lo]) / cell).cast("long")
    test = coords.overlaps if strict else coords.intersects
    return met.where((corner("min_x") == F.col("__x")) & (corner("min_y") == F.col("__y")) & test(F.col(a), F.col(b))).drop("__x", "__y")


def together(df: DataFrame, shape: str, key: str) -> DataFrame:
    """(shape, __some, key): the keys of equal shapes as lists, among every TOGETHER rows."""
    some = df.withColumn("__some", F.shiftright(F.monotonically_increasing_id(), TOGETHER.bit_length() - 1))
    return some.groupBy(shape, "__some").agg(F.collect_list(key).alias(key))


def point_join(points: DataFrame, shapes: DataFrame, point: str, box: str, a: str, b: str, inside: Column, cell: float = CELL) -> DataFrame:
    """(a, b): keys of the points, as boxes without an area, and of the shapes, whose boxes hold them, for which `inside` holds.

    Equal points and equal boxes are tested once for every two lists of their keys. A cell with more pairs than
    PAIRS_A_TASK is dealt to several tasks: its lists of points once, its shapes to each."""
    at = ["__x", "__y"]
    count = lambda df, shape, n: _dealt(df.select(shape), shape, cell).groupBy(*at).agg(F.count("*").alias(n))
    work = count(points, point, "n").join(count(shapes, box, "m"), at).select(*at, F.ceil(F.col("n") * F.col("m") / PAIRS_A_TASK).alias("__of"))
    parts = work.agg(F.sum("__of")).first()[0] or 1
    crowded = F.broadcast(work.where("__of > 1"))  # at most as many as the tasks
    shares = lambda df: df.join(crowded, at, "left").withColumn("__of", F.coalesce("__of", F.lit(1)))
    left = shares(_dealt(together(points, point, a), point, cell)).withColumn("__part", F.pmod(F.xxhash64(point, "__some"), F.col("__of"))).drop("__of", "__some")
    right = shares(_dealt(together(shapes, box, b), box, cell)).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__of") - 1))).drop("__of", "__some")
    by = [*at, "__part"]
    # AQE would put all of the short inputs into one task, which then makes all rows.
    parts = min(parts, 1 << 14)
    met = left.repartition(parts, *by).hint("shuffle_hash").join(right.repartition(parts, *by), by).where(coords.intersects(F.col(point), F.col(box)) & inside)
    return met.select(F.explode(a).alias(a), b).select(a, F.explode(b).alias(b))


def box_semi_join(left: DataFrame, right: DataFrame, a: str, b: str, key: str, strict: bool = False) -> DataFrame:
    """Rows of left whose box meets any of right; `key` identifies a row of left."""
    hits = box_join(left.select(key, a), right.select(b), a, b, strict).select(key).distinct()
    return left.join(hits, key, "left_semi")


def box_anti_join(left: DataFrame, right: DataFrame, a: str, b: str, key: str, strict: bool = True) -> DataFrame:
    """Rows of left whose box overlaps none of right; touching is allowed if strict."""
    hits = box_join(left.select(key, a), right.select(b), a, b, strict).select(key).distinct()
    return left.join(hits, key, "left_anti")


def best_cover(left: DataFrame, right: DataFrame, a: str, b: str, key: str, *order: Column) -> DataFrame:
    """For each row of left the right row that shares the most area, ties by `order`; rows without a common area are left out."""
    met = box_join(left, right, a, b, strict=True).withColumn("overlap", coords.overlap_area(F.col(a), F.col(b)))
    return met.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("overlap"), *order))).where("__k = 1").drop("__k")


def rasterized(boxes: DataFrame, box: str, value: str, ordinal: str, width: int, height: int) -> DataFrame:
    """(r, c, value): unit cells touched by boxes on a width x height grid; of boxes that meet, the one with the greatest ordinal."""
    b = F.col(box)
    steps = lambda lo, hi, n: F.sequence(F.greatest(F.lit(0), F.floor(b[lo]).cast("int")), F.least(F.lit(n - 1), F.floor(b[hi]).cast("int")))
    inside = boxes.where((b["max_x"] >= 0) & (b["max_y"] >= 0) & (b["min_x"] < width) & (b["min_y"] < height))
    cells = inside.withColumn("c", F.explode(steps("min_x", "max_x", width))).withColumn("r", F.explode(steps("min_y", "max_y", height)))
    return cells.groupBy("r", "c").agg(F.max_by(value, ordinal).alias("value"))


def clipped(df: DataFrame, box: str, to: Column) -> DataFrame:
    """Boxes cut to a box; what has no area left goes."""
    cut = F.struct(*[(F.greatest if k.startswith("min") else F.least)(F.col(box)[k], to[k]).alias(k) for k in ("min_x", "min_y", "max_x", "max_y")])
    return df.withColumn(box, cut).where((F.col(f"{box}.min_x") < F.col(f"{box}.max_x")) & (F.col(f"{box}.min_y") < F.col(f"{box}.max_y")))


def independent_split(df: DataFrame, key: str, box: str, n_test: int, n_validation: int, draw: Column) -> DataFrame:
    """Adds split: the first n_test rows by `draw` are test, then from the rows that overlap none of them the first
    n_validation are validation, and rows that overlap neither are train; the others have a null split."""
    test = df.orderBy(draw, key).limit(n_test)
    rest = box_anti_join(df.join(test.select(key), key, "left_anti"), test.select(F.col(box).alias("__t")), box, "__t", key)
    validation = rest.orderBy(draw, key).limit(n_validation)
    train = box_anti_join(rest.join(validation.select(key), key, "left_anti"), validation.select(F.col(box).alias("__t")), box, "__t", key)
    marked = test.select(key, F.lit("test").alias("split")).unionByName(validation.select(key, F.lit("validation").alias("split"))).unionByName(train.select(key, F.lit("train").alias("split")))
    return df.join(marked, key, "left")


def box_state(box: Column) -> Column:
    """missing, invalid (turned about), empty (without an area) or valid."""
    wide, high = box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]
    return F.when(box.isNull(), "missing").when((wide < 0) | (high < 0), "invalid").when((wide == 0) | (high == 0), "empty").otherwise("valid")


def repaired(df: DataFrame, box: str) -> DataFrame:
    """Boxes turned the right way; missing and empty ones go."""
    b = F.col(box)
    ends = lambda f, c: f(b[f"min_{c}"], b[f"max_{c}"])
    whole = F.struct(ends(F.least, "x").alias("min_x"), ends(F.least, "y").alias("min_y"), ends(F.greatest, "x").alias("max_x"), ends(F.greatest, "y").alias("max_y"))
    return df.where(box_state(b).isin("valid", "invalid")).withColumn(box, whole)


def union_cells(df: DataFrame, box: str, *keys: str, grid: float = 1.0) -> DataFrame:
    """(keys, x, y): the cells of a snapping grid inside the union of each key's boxes, every cell once."""
    b = F.col(box)
    inside = lambda c: F.sequence(F.ceil(b[f"min_{c}"] / grid).cast("long"), F.ceil(b[f"max_{c}"] / grid).cast("long") - 1)
    some = df.where((F.ceil(b["max_x"] / grid) > F.ceil(b["min_x"] / grid)) & (F.ceil(b["max_y"] / grid) > F.ceil(b["min_y"] / grid)))
    return some.select(*keys, box, F.explode(inside("x")).alias("x")).select(*keys, "x", F.explode(inside("y")).alias("y")).distinct()


def catalog(searches: DataFrame, items: DataFrame, a: str, b: str, key: str, fits: Column) -> DataFrame:
    """Items whose box shares an area with a search's: those that fit, or where a search has none that fit, all (by_gsd false)."""
    met = box_join(searches, items, a, b, strict=True).withColumn("__fits", fits)
    some = met.groupBy(key).agg(F.max("__fits").alias("by_gsd"))
    return met.join(some, key).where(F.col("__fits") | ~F.col("by_gsd")).drop("__fits")


def prefix_match(wanted: DataFrame, ids: DataFrame, want: str, name: str, order: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(want, name): for each wanted key the id that equals it, or has one of the suffixes in turn, or is the first by `order`
    that starts with it. Ids join by their prefixes, as many as they have characters, so the join is on equal keys."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substring(F.col(name), F.lit(1), n))
    by_prefix = ids.where(F.length(name) > 0).select(name, order, F.explode(prefixes).alias(want))
    rank = F.when(F.col(name) == F.col(want), 0)
    for k, suffix in enumerate(suffixes):
        rank = rank.when(F.col(name) == F.concat(F.col(want), F.lit(suffix)), k + 1)
    best = by_prefix.join(wanted, want).groupBy(want).agg(F.min(F.struct(rank.otherwise(len(suffixes) + 1).alias("rank"), order, name)).alias("m"))
    return best.select(want, f"m.{name}")
