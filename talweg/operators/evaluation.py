"""Evaluation of scores against labels.

Rows are (label name, truth 0/1, score). Scores are never overwritten by thresholds. Curves are running sums over distinct
scores, dealt by ranges of scores, so no label's scores meet in one task. The keys are label names, few by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.operators.ranking import running


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def counts(rows: DataFrame, threshold: Column, *keys: str) -> DataFrame:
    hit, true = F.col("score") >= threshold, F.col("truth") == 1
    return rows.groupBy(*keys).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))


def label_metrics(rows: DataFrame, threshold: Column, *keys: str) -> DataFrame:
    """accuracy, precision, recall, f1 of each group; 0 where a denominator is."""
    c = counts(rows, threshold, *keys)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *keys, (tp + fn).alias("support"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def global_metrics(per_label: DataFrame) -> DataFrame:
    """Macro and support-weighted means over labels."""
    weight = F.sum("support")
    return per_label.agg(*[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")], *[_ratio(F.sum(F.col(m) * F.col("support")), weight).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")])


def subset_metrics(rows: DataFrame, threshold: Column, item: str) -> DataFrame:
    """hamming loss and share of items with every label right."""
    wrong = ((F.col("score") >= threshold).cast("int") != F.col("truth")).cast("int")
    per_item = rows.groupBy(item).agg(F.sum(wrong).alias("w"), F.count("*").alias("n"))
    return per_item.agg((F.sum("w") / F.sum("n")).alias("hamming"), F.avg((F.col("w") == 0).cast("int")).alias("subset_accuracy"))


def _by_score(rows: DataFrame, *keys: str) -> DataFrame:
    """p and n, positives and negatives of each distinct score, and tp and fp, those at or above it."""
    by_score = rows.groupBy(*keys, "score").agg(F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("n"))
    return running(by_score, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")}, keys)


def auroc(rows: DataFrame, *keys: str) -> DataFrame:
    """Area under the ROC curve by counts of each distinct score; null without both classes."""
    # A negative counts the positives above it, and half of those beside it.
    at = _by_score(rows, *keys).withColumn("u", F.col("n") * (F.col("tp") - F.col("p") / 2))
    return at.groupBy(*keys).agg((F.sum("u") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auroc"))


def curve(rows: DataFrame, *keys: str) -> DataFrame:
    """For each distinct score: p and n at it, tp, fp, precision, recall and false-positive rate of the threshold at it."""
    at = _by_score(rows, *keys)
    whole = at.groupBy(*keys).agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))
    joined = at.join(F.broadcast(whole), list(keys)) if keys else at.crossJoin(F.broadcast(whole))
    return joined.select(*keys, "score", "p", "n", "np", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("np")).alias("recall"), _ratio(F.col("fp"), F.col("nn")).alias("fpr"))


def average_precision(rows: DataFrame, *keys: str) -> DataFrame:
    """Sum of precision times the step in recall over distinct scores."""
    step = _ratio(F.col("p"), F.col("np"))
    return curve(rows, *keys).withColumn("s", step * F.col("precision")).groupBy(*keys).agg(F.sum("s").alias("ap"))


def best_threshold(rows: DataFrame, *keys: str) -> DataFrame:
    """The score with the greatest F1, the highest of equal ones."""
    c = curve(rows, *keys).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8))
    return c.groupBy(*keys).agg(F.max(F.struct("f1", "score")).alias("m")).select(*keys, F.col("m.score").alias("threshold"), "m.f1")


def focal_loss(truth: Column, logit: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """alpha (1 - pt)^gamma times cross-entropy, by softplus of the logit."""
    ce = F.greatest(logit, F.lit(0.0)) - logit * truth + F.log1p(F.exp(-F.abs(logit)))
    return alpha * F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce
