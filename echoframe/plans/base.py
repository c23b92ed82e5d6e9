"""The driver's tables in the shape of the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})") / 1e6


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clicks: src (recording), t (seconds), idx (tie-break), v (feature), k (second feature)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("src"),
        F.col("event_id").alias("idx"),
        seconds("ts").alias("t"),
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.col("event_type").alias("kind"),
    )


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

CLICKS = """clicks AS (SELECT user_id AS src, event_id AS idx, epoch_us(ts) / 1e6 AS t, value AS v,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS k, event_type AS kind FROM events)"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as signals of different loudness: id, label, x (doubles)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.transform(F.col("embedding").cast("array<double>"), lambda v: v * (F.col("vec_id") % 7 + 1)).alias("x"))


WAVES = "waves AS (SELECT vec_id AS id, label, [CAST(v AS DOUBLE) * (vec_id % 7 + 1) FOR v IN embedding] AS x FROM embeddings)"
SAMPLES = WAVES + """, samples AS (SELECT id, label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM waves)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score from document length: id, y, score."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.round(F.col("n_chars") / 5000, 3)).alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), "score", F.col("toxic"))


SCORES = "scores AS (SELECT l.doc_id AS id, l.quality AS y, least(1.0, round(d.n_chars / 5000, 3)) AS score, l.toxic FROM labels l JOIN documents d USING (doc_id))"
