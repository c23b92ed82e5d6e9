"""Tables of files: events, noise manifests and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, read by ``schema``; columns are told by their place, so the header must have its order."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.EVENTS)


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The noise manifest, or one split of it."""
    df = read_csv(spark, path, schemas.NOISE)
    return df.where(F.col("split") == split.lower()) if split else df


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A training set of :func:`sinks.write_samples`; one split reads that split's folder alone."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def noise_audio(manifest: DataFrame, audio: DataFrame) -> DataFrame:
    """segment_id, parent_id, split and wave of each piece of the manifest, cut from its file (source_file, samples); pieces
    that the file doesn't hold whole go."""
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    both = manifest.withColumn("_n", name("path")).join(audio.select(name("source_file").alias("_n"), "samples"), "_n")
    wave = F.slice(F.col("samples").cast("array<double>"), F.col("start") + 1, F.col("end") - F.col("start"))
    return both.select("segment_id", "parent_id", "split", (F.col("end") - F.col("start")).alias("_len"), wave.alias("wave")).where(F.size("wave") == F.col("_len")).drop("_len")
