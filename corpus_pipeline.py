"""The corpus pipeline: documents through language ID, line dedup, near-dedup and decontamination to pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Stages hand over through Parquet tables in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.llm import decontaminate, langid, line_dedup, pieces, simhash
from talweg.llm.common import cut, remainder, table

#: A document is rejected if it has no letters or if no language is at least this likely.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language."""
    model = langid.fit(langid.training_sample(docs, remainder(F.col("doc_id"), 5) != 0))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later repeated runs of lines out of the texts; n_chars follows where it is there."""
    out = line_dedup.dedup_lines(docs).drop("n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: the document with the least id, and of rows equal in id and text one."""
    return simhash.distinct_documents(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no window of a benchmark item."""
    names = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in docs.columns])
    found = decontaminate.find_windows(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_spans") == 0).select(F.col("row").cast(names).alias("row")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its sampled pieces, and whether they decode to its text."""
    return pieces.encode(docs.select("doc_id", "text"), pieces.load(), lossless="lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("clean", clean),
    ("encode", encode),
]

#: The stages learn models and follow links, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
