"""Tables as engine input: patch rows, cell rows and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the square patches that embeddings hold.
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch rows: patch_id, label (its tile), h, w, z array<double> in row-major order."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("patch_id"), F.col("label").cast("int").alias("label"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.col("embedding").cast("array<double>").alias("z")
    )


def cells(patch_rows: DataFrame) -> DataFrame:
    """Cell rows: patch_id, label, cell, r, c, z; a narrow step, without a shuffle."""
    out = patch_rows.select("patch_id", "label", "w", F.posexplode("z").alias("cell", "z"))
    return out.select("patch_id", "label", "cell", F.floor(F.col("cell") / F.col("w")).cast("int").alias("r"), (F.col("cell") % F.col("w")).alias("c"), "z")


def window_grid(dims: DataFrame, size: int, stride: int | None = None) -> DataFrame:
    """Windows of size x size in rows of (patch_id, h, w): r0, c0; partial windows at the edges are left out."""
    step = stride or size
    starts = [F.explode(F.when(F.col(n) >= size, F.sequence(F.lit(0), F.col(n) - size, F.lit(step))).otherwise(F.array().cast("array<int>"))) for n in ("h", "w")]
    return dims.select("*", starts[0].alias("r0")).select("*", starts[1].alias("c0"))


def overlapping_windows(dims: DataFrame, size: int, overlap: float, prefix: str) -> DataFrame:
    """Windows whose stride is size x (1 - overlap), at least 1, named prefix_size_overlap_number within each patch."""
    from pyspark.sql import Window as W

    out = window_grid(dims, size, max(1, round(size * (1 - overlap))))
    number = F.row_number().over(W.partitionBy("patch_id").orderBy("r0", "c0")) - 1
    return out.withColumn("window_id", F.concat_ws("_", F.lit(prefix), F.lit(str(size)), F.lit(str(int(overlap * 100))), number.cast("string")))


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("min_x"), y.alias("min_y"), (x + width).alias("max_x"), (y + height).alias("max_y"))


def boxes(df: DataFrame, key: str, name: str) -> DataFrame:
    """Boxes made from a key by rule: corner (7 k mod 100, 13 k mod 100), sides 3 + k mod 5 and 2 + k mod 4."""
    k = F.col(key)
    return df.select(k.alias(name), box((k * 7 % 100).cast("double"), (k * 13 % 100).cast("double"), (3 + k % 5).cast("double"), (2 + k % 4).cast("double")).alias("b"))
