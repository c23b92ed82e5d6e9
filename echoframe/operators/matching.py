"""Matching of predictions with ground truth, by time and by interval."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ratio(a, b):
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to a row of tp, fp and fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", ratio(2 * p * r, p + r))


def nearest_within(pred: DataFrame, truth: DataFrame, part: list[str], tolerance: float) -> DataFrame:
    """Each prediction (pid, t) with its nearest truth (gid, g) within the tolerance, both ends in; ties go to the lower gid.

    A range join as an equi join: truths go to the buckets of width ``tolerance`` around them, so each prediction meets
    only what is near. Only the nearest truth is ever tried, so of the predictions of one truth the first is its match.
    """
    at = F.floor(F.col("g") / tolerance)
    near = truth.select(*part, "gid", "g", F.explode(F.array(at - 1, at, at + 1)).alias("_b"))
    pairs = pred.withColumn("_b", F.floor(F.col("t") / tolerance)).join(near, [*part, "_b"]).where(F.abs(F.col("t") - F.col("g")) <= tolerance)
    return pairs.groupBy(*part, "pid").agg(F.min_by(F.struct("gid", "g", "t"), F.struct(F.abs(F.col("t") - F.col("g")), F.col("gid"))).alias("_m")).select(*part, "pid", "_m.t", "_m.gid", "_m.g")


def event_matches(pred: DataFrame, truth: DataFrame, part: list[str], tolerance: float) -> DataFrame:
    """Matched pairs: one prediction, the first by pid, of each truth."""
    near = nearest_within(pred, truth, part, tolerance)
    return near.groupBy(*part, "gid", "g").agg(F.min_by(F.struct("pid", "t"), "pid").alias("_f")).select(*part, "_f.pid", "gid", (F.abs(F.col("_f.t") - F.col("g"))).alias("error"))


def event_metrics(pred: DataFrame, truth: DataFrame, part: list[str], tolerance: float) -> DataFrame:
    """One row of tp, fp, fn, precision, recall and f1; zeros where a side is empty."""
    tp = event_matches(pred, truth, part, tolerance).agg(F.count("*").alias("tp"))
    n = pred.agg(F.count("*").alias("n_pred")).select("n_pred", F.lit(1).alias("_k")).join(truth.agg(F.count("*").alias("n_true")).withColumn("_k", F.lit(1)), "_k").join(tp.withColumn("_k", F.lit(1)), "_k")
    return prf(n.select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn")))


def overlap_pairs(pred: DataFrame, truth: DataFrame, part: list[str], width: float, least: float = 0.5) -> DataFrame:
    """Pairs of intervals (pid, s, e) and (gid, gs, ge) that overlap by ``least`` of the shorter one.

    Intervals go to every bucket of ``width`` that they touch; a pair is taken in the first bucket that both have.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    p, g = pred.withColumn("_b", bins("s", "e")), truth.withColumn("_b", bins("gs", "ge"))
    both = p.join(g, [*part, "_b"]).where(F.col("_b") == F.floor(F.greatest("s", "gs") / width))
    common = F.greatest(F.lit(0.0), F.least("e", "ge") - F.greatest("s", "gs"))
    shorter = F.least(F.col("e") - F.col("s"), F.col("ge") - F.col("gs"))
    return both.withColumn("overlap", F.when(shorter > 0, common / shorter).otherwise(0.0)).where(F.col("overlap") >= least).drop("_b")


def train_matches(pairs: DataFrame, part: list[str]) -> DataFrame:
    """Greedy by pid over rows of :func:`overlap_pairs`: each prediction takes the free truth with the largest overlap, the
    lower gid of equals.

    Order matters only among pairs whose intervals touch, so each run of such pairs is an island of its own: islands are
    dealt to tasks, which read them as a sorted stream and remember one island's taken truths.
    """
    lo, hi = F.least("s", "gs"), F.greatest("e", "ge")
    w = Window.partitionBy(*part).orderBy("_lo", "_hi")
    rows = pairs.withColumns({"_lo": lo, "_hi": hi}).withColumn("_reach", F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", F.coalesce((F.col("_lo") > F.col("_reach")).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = pairs.columns

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, taken = None, None, set()
        for b in batches:
            keep = []
            for *island, pid, gid in zip(*(b.column(c).to_pylist() for c in (*part, "_island", "pid", "gid"))):
                if island != now:
                    now, done, taken = island, None, set()
                keep.append(pid != done and gid not in taken)
                if keep[-1]:
                    done = pid
                    taken.add(gid)
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    dealt = rows.select(*names, "_island").repartition(*part, "_island").sortWithinPartitions(*part, "_island", "pid", F.desc("overlap"), "gid")
    return dealt.mapInArrow(greedy, pairs.schema)


def train_metrics(matches: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts and scores of matched trains, with the mean errors of median gap (ici and g_ici, which the matched pairs carry)
    and of click count (n_clicks and g_clicks)."""
    error = lambda a, b: F.coalesce(F.avg(F.abs(F.col(a) - F.col(b))), F.lit(0.0))
    row = matches.agg(F.count("*").alias("tp"), error("ici", "g_ici").alias("ici_error"), error("n_clicks", "g_clicks").alias("count_error")).withColumn("_k", F.lit(1))
    row = row.join(pred.agg(F.count("*").alias("n_pred")).withColumn("_k", F.lit(1)), "_k").join(truth.agg(F.count("*").alias("n_true")).withColumn("_k", F.lit(1)), "_k")
    return prf(row.select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), "ici_error", "count_error"))
