"""Simplicial complexes as rows (complex_id, verts array<int>), vertices in ascending order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(facets: DataFrame) -> DataFrame:
    """All faces of the given simplices, each once."""
    v = F.array_sort(F.array_distinct("verts"))
    masks = facets.select("complex_id", v.alias("v")).where(F.size("v") > 0).select("complex_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2.0), F.size("v")).cast("long") - 1)).alias("m"))
    face = F.filter("v", lambda x, i: F.getbit("m", i) == 1)
    return masks.select("complex_id", face.alias("verts")).dropDuplicates(["complex_id", "verts"])


def boundary(simplices: DataFrame) -> DataFrame:
    """(complex_id, verts, face): every face of one dimension less; points have none."""
    v = F.col("verts")
    return simplices.where(F.size(v) > 1).select("complex_id", "verts", F.explode(F.transform(v, lambda x, i: F.filter(v, lambda y, j: j != i))).alias("face"))


def missing_faces(simplices: DataFrame) -> DataFrame:
    """Faces that a complex lacks; none if it is closed."""
    have = simplices.select("complex_id", F.col("verts").alias("face"))
    return boundary(simplices).select("complex_id", "face").distinct().join(have, ["complex_id", "face"], "left_anti")


def euler(simplices: DataFrame) -> DataFrame:
    """complex_id, chi, dim."""
    d = F.size("verts") - 1
    return simplices.groupBy("complex_id").agg(F.sum(F.when(d % 2 == 0, 1).otherwise(-1)).alias("chi"), F.max(d).alias("dim"))


def rank_mod2(columns: list[int]) -> int:
    """Rank over the field of two elements of columns given as bit sets."""
    pivots: dict[int, int] = {}
    for c in columns:
        while c:
            top = c.bit_length()
            if top not in pivots:
                pivots[top] = c
                break
            c ^= pivots[top]
    return len(pivots)


def betti_numbers(simplices: list[tuple[int, ...]]) -> list[int]:
    by_dim: dict[int, list[tuple[int, ...]]] = {}
    for s in sorted(set(simplices)):
        by_dim.setdefault(len(s) - 1, []).append(s)
    if not by_dim:
        return []
    top = max(by_dim)
    ranks = {0: 0, top + 1: 0}
    for d in range(1, top + 1):
        at = {s: k for k, s in enumerate(by_dim.get(d - 1, []))}
        ranks[d] = rank_mod2([sum(1 << at[s[:i] + s[i + 1 :]] for i in range(len(s))) for s in by_dim.get(d, [])])
    return [len(by_dim.get(d, [])) - ranks[d] - ranks[d + 1] for d in range(top + 1)]


def betti(simplices: DataFrame) -> DataFrame:
    """complex_id, dim, betti over the field of two elements; one complex is worked on at a time."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = betti_numbers([tuple(int(x) for x in v) for v in part["verts"]])
        return pd.DataFrame({"complex_id": [part["complex_id"].iloc[0]] * len(found), "dim": range(len(found)), "betti": found})

    return simplices.groupBy("complex_id").applyInPandas(run, "complex_id long, dim int, betti long")


def random_complex(spark, complexes: int, n: int, p: float, top: int = 2, seed: int = 0) -> DataFrame:
    """Bottom-up: all vertices; a simplex whose boundary is there comes in where a hash draw is below p."""
    draw = lambda: F.pmod(F.xxhash64(F.lit(seed), "complex_id", "verts"), F.lit(1 << 20)) / float(1 << 20)
    level = spark.range(complexes).select(F.col("id").alias("complex_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("v")).select("complex_id", F.array("v").alias("verts"))
    out = level
    for _ in range(top):
        # Two simplices that differ in their last vertex alone span the next dimension.
        a = level.select("complex_id", F.slice("verts", 1, F.size("verts") - 1).alias("stem"), F.element_at("verts", -1).alias("x"))
        b = a.select("complex_id", "stem", F.col("x").alias("y"))
        spanned = a.join(b, ["complex_id", "stem"]).where("x < y").select("complex_id", F.concat("stem", F.array("x", "y")).alias("verts")).where(draw() < p)
        whole = boundary(spanned).join(level.select("complex_id", F.col("verts").alias("face")), ["complex_id", "face"]).groupBy("complex_id", "verts").agg(F.count("*").alias("n"))
        level = whole.where(F.col("n") == F.size("verts")).select("complex_id", "verts")
        out = out.unionByName(level)
    return out


def eroded(simplices: DataFrame, p: float, top: int, seed: int = 0) -> DataFrame:
    """Top-down: simplices stay where a hash draw is below p; a simplex goes with any of its faces."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "complex_id", "verts"), F.lit(1 << 20)) / float(1 << 20)
    stays = simplices.where((F.size("verts") == 1) | (draw < p))
    out = stays.where(F.size("verts") == 1)
    for size in range(2, top + 2):
        level = stays.where(F.size("verts") == size)
        whole = boundary(level).join(out.select("complex_id", F.col("verts").alias("face")), ["complex_id", "face"]).groupBy("complex_id", "verts").agg(F.count("*").alias("n"))
        out = out.unionByName(whole.where(F.col("n") == size).select("complex_id", "verts"))
    return out
