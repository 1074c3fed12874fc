"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.sources.files import cut, drop

__all__ = ["cut", "drop"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_partitions(spark: SparkSession, parts: int) -> list[int]:
    """`parts` ints that repartition(parts, column of them) deals to a partition each."""
    keys: dict[int, int] = {}
    for r in spark.range(0, parts * 40 + 1000, 1, 1).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect():
        keys[r["at"]] = r["id"]
    if len(keys) < parts:
        return list(range(parts))
    return [keys[k] for k in range(parts)]


#: A key is frequent if it has more than one row in so many; there are no more frequent keys than that.
FREQUENT = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], rows: int, n: str = "n") -> DataFrame:
    """left joined to right, which has each key once and in `n` its number of rows in left, of which there are `rows`.

    The at most FREQUENT keys of more than rows / FREQUENT rows are broadcast, so no task gets all rows of one of them."""
    key = [key] if isinstance(key, str) else key
    frequent = right.where(F.col(n) * FREQUENT > rows)
    rest = right.where(F.col(n) * FREQUENT <= rows).drop(n)
    one = left.join(F.broadcast(frequent.drop(n)), key)
    return one.unionByName(left.join(F.broadcast(frequent.select(*key)), key, "left_anti").join(rest, key))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to at most limit; a larger item stands alone."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the len(texts) + 1 offsets between them."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets, zero for empty ones; values may have columns."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=np.float64)
    return out


def small(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `limit` bytes of the column `name` (texts or lists), or one row: what a task holds is bounded."""
    for batch in batches:
        column = batch.column(name)
        kind = column.type
        size = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(kind) or pa.types.is_large_list(kind) else pc.binary_length(column)
        for lo, hi in blocks(pc.fill_null(size, 0).to_pylist(), limit):
            yield batch.slice(lo, hi - lo)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 50, l2: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through (margin, label), by Newton's method."""
    x = np.stack([margin, np.ones_like(margin)], 1).astype(np.float64)
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(2), x.T @ (p - label) + l2 * w)
        w -= np.clip(step, -5, 5)
    return float(w[0]), float(w[1])
