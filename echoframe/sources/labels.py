"""Label files: tab-separated intervals, and the JSON of a labelling tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parsed_labels(lines: DataFrame, value: str = "value") -> DataFrame:
    """start, end, label of each line; blanks, comments (#) and lines without two numbers go; no name is ``segment``."""
    parts = F.split(F.trim(F.col(value)), "\t")
    out = lines.where((F.trim(F.col(value)) != "") & ~F.ltrim(F.col(value)).startswith("#") & (F.size(parts) >= 2))
    name = F.trim(F.get(parts, 2))
    out = out.select(F.get(parts, 0).try_cast("double").alias("start"), F.get(parts, 1).try_cast("double").alias("end"), F.when(F.coalesce(name, F.lit("")) == "", "segment").otherwise(name).alias("label"))
    return out.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of all label files under a path, with the stem of their recording: the file's, without ``_labels``."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    lines = spark.read.text(path).select("value", F.replace(stem, F.lit("_labels"), F.lit("")).alias("stem"))
    parts = F.split(F.trim("value"), "\t")
    kept = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#") & (F.size(parts) >= 2))
    return kept.select("stem", F.get(parts, 0).try_cast("double").alias("start"), F.get(parts, 1).try_cast("double").alias("end"), F.coalesce(F.nullif(F.trim(F.get(parts, 2)), F.lit("")), F.lit("segment")).alias("label"))


def audacity_lines(events: DataFrame, time: str, half: float, source: str = "source_file", label: str = "candidate") -> DataFrame:
    """One line per event, an interval of ``half`` seconds to each side, from 0 on."""
    t = F.col(time)
    return events.select(source, F.format_string(f"%.6f\t%.6f\t{label}", F.greatest(F.lit(0.0), t - half), t + half).alias("value"))


def write_audacity(events: DataFrame, time: str, half: float, path: str, source: str = "source_file") -> None:
    """One folder of label lines per source file."""
    audacity_lines(events, time, half, source).repartition(source).write.partitionBy(source).mode("overwrite").text(path)


LABELS_JSON = "map<string, struct<category: string, choice: string, timestamp: string>>"


def read_label_json(spark: SparkSession, path: str) -> DataFrame:
    """path, category, choice, timestamp of a labelling tool's JSON files."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", LABELS_JSON).alias("m"))
    return docs.select(F.explode("m").alias("path", "_l")).select("path", "_l.*")


def category_report(labels: DataFrame) -> DataFrame:
    """Count and share of each category."""
    counts = labels.groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each category


#: Of a folder's files with one stem, labels go to the first of these endings; other endings come behind.
EXTENSIONS = ("wav", "flac", "mp3")


def labelled_segments(cut: DataFrame, labels: DataFrame, ceiling: float = 0.95, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Audio of each labelled interval (stem, start, end, label), its peak at ``ceiling``.

    An interval takes from each chunk that it overlaps the part up to the next chunk; it is clamped to the recording, and
    empty ones go. Up to ``broadcast_rows`` labels go to the chunks, so that only the parts are shuffled; more are joined as
    Spark sees fit.
    """
    from ..functions import waves

    rate, first = F.col("sample_rate"), F.col("start_sample")
    at = labels.select(F.col("stem").alias("file_id"), "start", "end", "label").distinct()
    lo = F.greatest(first, F.floor(F.col("start") * rate))
    hi = F.least(first + F.size("samples"), F.floor(F.col("end") * rate))
    found = cut.join(F.broadcast(at) if at.count() <= broadcast_rows else at, "file_id").withColumns({"_lo": lo, "_hi": hi})
    found = found.where((F.col("_hi") > F.col("_lo")) | (first == 0))  # the first chunk tells that a file is there
    piece = F.slice("samples", F.least(F.col("_lo") - first, F.size("samples")).cast("int") + 1, F.greatest(F.lit(0), F.col("_hi") - F.col("_lo")).cast("int"))
    key = ["file_id", "start", "end", "label"]
    place = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.lower(F.regexp_extract("source_file", r"\.([^./]*)$", 1)))
    found = found.select("source_file", *key, "_lo", "_hi", piece.alias("_piece"), F.when(place > 0, place).otherwise(len(EXTENSIONS) + 1).alias("_rank"))
    folder = F.regexp_extract("source_file", r"^(.*/)?[^/]*$", 1)
    found = found.withColumn("_best", F.min(F.struct("_rank", "source_file")).over(Window.partitionBy(*key, folder)))
    found = found.where((F.col("source_file") == F.col("_best.source_file")) & (F.col("_hi") > F.col("_lo")))
    following = F.lead("_lo").over(Window.partitionBy(*key, "source_file").orderBy("_lo", "_hi"))
    own = F.slice("_piece", F.lit(1), F.coalesce(F.least(F.col("_hi"), following) - F.col("_lo"), F.col("_hi") - F.col("_lo")).cast("int"))
    parts = found.select("source_file", *key, "_lo", own.alias("_piece")).where(F.size("_piece") > 0)
    out = parts.groupBy("source_file", *key).agg(F.array_sort(F.collect_list(F.struct("_lo", "_piece"))).alias("_parts"))
    whole = F.flatten(F.col("_parts._piece")).cast("array<double>")
    return out.select("source_file", *key, F.transform(waves.normalized_peak(whole), lambda v: v * ceiling).alias("samples"))
