"""Running sums and ranks over a whole order, without one task that holds it.

Rows are dealt to partitions by ranges of (keys, order), so equal rows stay together; each partition sums on its own,
and the totals of the partitions before it, one row for each partition and key, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.sources.files import cut


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds running sums by name: of the rows of the same keys up to and with each row, in a total order."""
    parts = cut(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    through = W.partitionBy("__part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(c).over(through).alias(n) for n, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("__part", *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = totals.select("__part", *keys, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    # Null-safe, as a key may be null.
    o = offsets.toDF("__p", *[f"__k{i}" for i in range(len(keys))], *[f"__{n}" for n in sums])
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return local.join(o, same).select(*df.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, order: list[Column | str], name: str = "k", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds each row's number from 0 in a total order."""
    return running(df, order, {name: F.lit(1).cast("long")}, keys).withColumn(name, F.col(name) - 1)
