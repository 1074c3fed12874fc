"""Data-quality checks: rules in, one row for each check out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = ("dataset", "check", "passed", "severity", "message")


def check(df: DataFrame, dataset: str, name: str, passed: Column, message: Column, severity: str = "error") -> DataFrame:
    """One report row from aggregates over df; a null outcome is not passed."""
    return df.agg(F.coalesce(passed, F.lit(False)).alias("passed"), message.cast("string").alias("message")).select(
        F.lit(dataset).alias("dataset"), F.lit(name).alias("check"), "passed", F.lit(severity).alias("severity"), "message"
    )


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(found: DataFrame) -> None:
    """Raises with all failed checks of severity error."""
    bad = found.where("not passed and severity = 'error'").limit(100).collect()
    if bad:
        raise ValueError("; ".join(f"{r['dataset']}.{r['check']}: {r['message']}" for r in bad))


def policy(df: DataFrame, name: str, kept: Column) -> DataFrame:
    """One row: n, n_offenders, their names in order, and whether there are none; an unknown counts as an offence."""
    bad = ~F.coalesce(kept, F.lit(False))
    names = F.concat_ws(",", F.array_sort(F.collect_list(F.when(bad, F.col(name)))))
    return df.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_offenders"), names.alias("offenders"), (F.count_if(bad) == 0).alias("passed"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def null_share(df: DataFrame, columns: list[str]) -> Column:
    """Share of nulls over all required cells."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in columns])
    return nulls / (F.count("*") * len(columns))


def percent_difference(a: Column, b: Column) -> Column:
    """|a - b| over the greater magnitude; 0 when both are next to 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top < 1e-12, 0.0).otherwise(F.abs(a - b) / top)


def relative_error(value: Column, target: Column) -> Column:
    return F.when(target <= 0, 0.0).otherwise(F.abs(value - target) / target)


def finite(c: str) -> Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))


def cleaned_column(df: DataFrame, c: str, *keys: str) -> DataFrame:
    """Infinities become the group's finite extremes plus and minus three standard deviations, NaN and null its mean, 0 without finite values."""
    good = finite(c)
    s = df.groupBy(*keys).agg(F.max(good).alias("__hi"), F.min(good).alias("__lo"), F.avg(good).alias("__m"), F.stddev_pop(good).alias("__s"))
    joined = df.join(s, list(keys)) if keys else df.crossJoin(F.broadcast(s))
    value = (
        F.when(F.col(c) == float("inf"), F.col("__hi") + 3 * F.col("__s")).when(F.col(c) == float("-inf"), F.col("__lo") - 3 * F.col("__s")).otherwise(F.coalesce(good, F.col("__m")))
    )
    return joined.withColumn(c, F.coalesce(value, F.lit(0.0))).drop("__hi", "__lo", "__m", "__s")


def standardized(df: DataFrame, c: str, *keys: str) -> DataFrame:
    """(x - mean) / population deviation, invalid values as 0 before; 0 throughout where nothing varies."""
    zeroed = df.withColumn(c, F.coalesce(finite(c), F.lit(0.0)))
    s = zeroed.groupBy(*keys).agg(F.avg(c).alias("__m"), F.stddev_pop(c).alias("__s"))
    joined = zeroed.join(s, list(keys)) if keys else zeroed.crossJoin(F.broadcast(s))
    return joined.withColumn(c, F.when(F.col("__s") > 0, (F.col(c) - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")


def matrix_quality(df: DataFrame, c: str, *keys: str) -> DataFrame:
    """Counts of NaN, infinite, extreme (> 1e100) and large (> 1e10) values."""
    v = F.col(c)
    inf = F.abs(v) == float("inf")
    return df.groupBy(*keys).agg(F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(inf).alias("n_inf"), F.count_if(~F.isnan(v) & ~inf & (F.abs(v) > 1e100)).alias("n_extreme"), F.count_if(~F.isnan(v) & ~inf & (F.abs(v) > 1e10)).alias("n_large"))
