"""Looking over signals and data sets: level summaries, abnormal signals, and readiness as rows that say what fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waves
from ..stages import cut
from .metrics import quantiles


def level_columns(samples: str) -> dict[str, Column]:
    x = F.col(samples)
    return {"rms": waves.rms(x), "peak": waves.peak(x), "mad": waves.mad(x)}


def level_summary(df: DataFrame, samples: str) -> DataFrame:
    """Mean, median, min, max and deviation of RMS, peak and median absolute deviation over all signals: a row for each."""
    levels = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("v")) for n, v in level_columns(samples).items()])).alias("l")).select("l.*")
    levels = cut(levels)  # sums and quantiles are read from it
    g = levels.groupBy("measure").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"))
    return g.join(quantiles(levels, "v", ["measure"], {"median": 0.5}), "measure").select("measure", "mean", "median", "min", "max", "std")


def sample_stats(df: DataFrame, samples: str) -> DataFrame:
    """Number, min, max, mean, deviation and median of all samples of all signals, from sums of each signal; the median from
    the values close to it."""
    x = F.col(samples)
    parts = df.select(F.size(x).alias("n"), F.array_min(x).alias("lo"), F.array_max(x).alias("hi"), waves.total(x).alias("s"), waves.energy(x).alias("q"))
    mean = F.sum("s") / F.sum("n")
    g = parts.agg(F.sum("n").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - mean * mean)).alias("std"))
    values = df.select(F.explode(x).alias("v"), F.lit(1).alias("_k"))
    return g.withColumn("_k", F.lit(1)).join(quantiles(values, "v", ["_k"], {"median": 0.5}), "_k").drop("_k")


def abnormal(df: DataFrame, samples: str, max_rms: float = 1.0, max_peak: float = 2.0, outlier: float = 2.0, limit: float = 10.0) -> DataFrame:
    """Adds why a signal is abnormal (``reason``: range, level or null) and how many of its samples are outliers."""
    x = F.col(samples)
    level = (waves.rms(x) > max_rms) | (waves.peak(x) > max_peak)
    reason = F.when(waves.peak(x) > limit, "range").when(level, "level")
    return df.withColumns({"reason": reason, "n_outliers": F.size(F.filter(x, lambda v: F.abs(v) > outlier)).cast("long")})


def quarantined(df: DataFrame, bad: Column, path: str, folder: str) -> DataFrame:
    """Adds ``quarantine``, the path that a bad file would move to, null for a good one. Nothing is moved or deleted."""
    return df.withColumn("quarantine", F.when(bad, F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(path, r"([^/]+)$", 1))))


def readiness(samples: DataFrame, length: int, min_rows: int = 1, max_imbalance: float = 3.0) -> DataFrame:
    """Rows (check, ok, detail) about a training set: rows of each split, both labels, lengths, finite values, balance, and
    no sample in two splits."""
    x = F.col("waveform")
    counted = {
        "train": F.col("split") == "train",
        "val": F.col("split") == "val",
        "pos": F.col("label") == 1,
        "neg": F.col("label") == 0,
        "odd": F.size(x) != length,
        "wild": F.exists(x, lambda v: F.isnan(v) | v.isNull() | (F.abs(v) > 10)),
    }
    by_file = samples.groupBy("file_id").agg(*[F.count_if(v).alias(n) for n, v in counted.items()], (F.min("split") != F.max("split")).alias("leaks"))
    zero = F.lit(0).cast("long")
    one = by_file.agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in counted], F.count_if("leaks").alias("leaks"))
    c = {n: F.col(n) for n in (*counted, "leaks")}
    told = lambda *names: reduce(lambda a, b: F.concat_ws(" ", a, b), [F.concat(F.lit(f"{n}="), c[n].cast("string")) for n in names])
    checks = [
        ("splits", (c["train"] >= min_rows) & (c["val"] >= min_rows), told("train", "val")),
        ("labels", (c["pos"] > 0) & (c["neg"] > 0), told("pos", "neg")),
        ("balance", F.greatest("pos", "neg") <= max_imbalance * F.least("pos", "neg"), told("pos", "neg")),
        ("length", c["odd"] == 0, told("odd")),
        ("values", c["wild"] == 0, told("wild")),
        ("leakage", c["leaks"] == 0, told("leaks")),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok"), d.alias("detail")) for n, ok, d in checks])).alias("r")).select("r.*")
