"""Evaluation of scored rows: one row of everything, predictions, and those that are wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import cut
from . import metrics


def report(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: counts and ratios at the threshold, both areas, and the best threshold with its f1."""
    one = lambda df: df.withColumn("_k", F.lit(1))
    scored = cut(scored.select(label, score))
    points = cut(metrics.curve(scored, label, score))  # all three numbers are read from it
    at = metrics.confusion(scored.withColumn("_p", (F.col(score) >= threshold).cast("int")), label, "_p")
    best = metrics.best_threshold(scored, label, score, points).select(F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"))
    return one(at).join(one(metrics.roc_auc(scored, label, score, points)), "_k").join(one(metrics.pr_auc(scored, label, score, points)), "_k").join(one(best), "_k").drop("_k")


def wrong(predictions: DataFrame) -> DataFrame:
    return predictions.where(~F.col("correct"))
