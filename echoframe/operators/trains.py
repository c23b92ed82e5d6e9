"""Click trains and the fusion of scores with trains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Fusion, Trains
from .series import by


def build_trains(df: DataFrame, t: str, part: list[str], order: list[str], p: Trains) -> DataFrame:
    """Adds ``ici``, ``train_id`` (dense over trains that are kept, by time) and ``pos``; rows of short trains get null ids.

    A row stays in the train if min_ici <= gap <= max_ici; a session window has no lower bound.
    """
    w = by(part, *order)
    gap = F.col(t) - F.lag(t).over(w)
    df = df.withColumn("_gap", gap).withColumn("_new", F.when(F.col("_gap").between(p.min_ici, p.max_ici), 0).otherwise(1))
    df = df.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy(*part, "_g")))
    # ids count the first rows of trains that are long enough
    first = ((F.col("_new") == 1) & (F.col("_n") >= p.min_clicks)).cast("int")
    df = df.withColumn("_id", F.sum(first).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    kept = F.col("_n") >= p.min_clicks
    return df.withColumns({"ici": F.when(F.col("_new") == 0, F.col("_gap")), "train_id": F.when(kept, F.col("_id"))}).drop("_gap", "_new", "_g", "_n", "_id")


def train_stats(clicks: DataFrame, t: str, score: str, part: list[str]) -> DataFrame:
    """One row per kept train. The first click's gap doesn't count; deviation is of the population."""
    g = clicks.where(F.col("train_id").isNotNull()).groupBy(*part, "train_id")
    out = g.agg(
        F.min(t).alias("start_time"),
        F.max(t).alias("end_time"),
        (F.max(t) - F.min(t)).alias("duration"),
        F.count("*").alias("n_clicks"),
        F.median("ici").alias("ici_median"),
        F.avg("ici").alias("ici_mean"),
        F.stddev_pop("ici").alias("ici_std"),
        F.min("ici").alias("ici_min"),
        F.max("ici").alias("ici_max"),
        F.avg(score).alias("mean_confidence"),
    )
    return out.withColumn("ici_cv", F.when(F.col("ici_mean") > 0, F.col("ici_std") / F.col("ici_mean")).otherwise(0.0))


def consistent(p: Fusion) -> Column:
    return (F.col("n_clicks") >= p.min_clicks) & (F.col("ici_cv") <= p.max_cv)


def doublet(p: Fusion, confidence: Column, unit: float = 1000.0) -> Column:
    """A train of two whose gap, in ms (``unit`` per unit of time), and confidence allow it."""
    return (F.col("n_clicks") == 2) & (F.col("ici_median") * unit).between(*p.doublet_ici_ms) & (confidence >= p.doublet_confidence)


def fusion_reason(p: Fusion, score: Column, unit: float = 1000.0) -> Column:
    """Why a candidate is taken or not; train columns are null outside trains."""
    in_train = F.col("n_clicks").isNotNull()
    return (
        F.when(score >= p.high, "high_confidence_direct")
        .when(score < p.medium, "low_confidence_reject")
        .when(F.lit(not p.need_train), "medium_confidence_no_train_check")
        .when(~in_train, "medium_confidence_not_in_train")
        .when(consistent(p), "medium_confidence_consistent_train")
        .when(doublet(p, score, unit), "medium_confidence_consistent_doublet")
        .when(F.col("n_clicks") == 2, "medium_confidence_inconsistent_doublet")
        .otherwise("medium_confidence_inconsistent_train")
    )


#: Reasons that accept.
ACCEPTING = ["high_confidence_direct", "medium_confidence_no_train_check", "medium_confidence_consistent_train", "medium_confidence_consistent_doublet"]


def fused(clicks: DataFrame, t: str, score: str, part: list[str], p: Fusion, unit: float = 1000.0) -> DataFrame:
    """Clicks of :func:`build_trains` with ``reason`` and ``accept``.

    What the rules need of a train is made by windows over the train's rows, in the clicks' own partitioning.
    """
    w = Window.partitionBy(*part, "train_id")
    df = clicks.withColumns({"n_clicks": F.count("*").over(w), "ici_median": F.median("ici").over(w), "_m": F.avg("ici").over(w), "_s": F.stddev_pop("ici").over(w)})
    df = df.withColumn("ici_cv", F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")).otherwise(0.0)).drop("_m", "_s")
    df = df.withColumns({c: F.when(F.col("train_id").isNotNull(), F.col(c)) for c in ("n_clicks", "ici_median", "ici_cv")})
    df = df.withColumn("reason", fusion_reason(p, F.col(score), unit))
    return df.withColumn("accept", F.col("reason").isin(ACCEPTING))


def fusion_text(summary: DataFrame) -> DataFrame:
    """Adds the counts of :func:`fusion_summary` as lines of text; shares of an empty table are 0."""
    share = lambda c: F.when(F.col("total") > 0, 100.0 * F.col(c) / F.col("total")).otherwise(0.0)
    lines = [
        F.format_string("Total candidates: %d", "total"),
        F.format_string("Accepted: %d (%.1f%%)", "accepted", share("accepted")),
        F.format_string("Rejected: %d (%.1f%%)", "rejected", share("rejected")),
        *[F.format_string(f"{name}: %d", c) for name, c in (("High confidence", "high_confidence"), ("Medium confidence", "medium_confidence"), ("Low confidence", "low_confidence"), ("Trains detected", "n_trains"))],
    ]
    return summary.withColumn("text", F.concat_ws("\n", *lines))


def fusion_summary(decisions: DataFrame, score: str, part: list[str], p: Fusion) -> DataFrame:
    """One row of counts; zeros for an empty table."""
    s = F.col(score)
    train = F.when(F.col("train_id").isNotNull(), F.struct(*part, "train_id"))
    return decisions.agg(
        F.count("*").alias("total"),
        F.count_if("accept").alias("accepted"),
        F.count_if(~F.col("accept")).alias("rejected"),
        F.count_if(s >= p.high).alias("high_confidence"),
        F.count_if((s >= p.medium) & (s < p.high)).alias("medium_confidence"),
        F.count_if(s < p.medium).alias("low_confidence"),
        F.countDistinct(train).alias("n_trains"),
    )
