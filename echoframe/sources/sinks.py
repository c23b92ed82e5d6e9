"""Writers. Tables go through Spark's own writers; clips are written by the tasks that hold them and put in place at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header; nested columns as JSON, arrays of click indices left out."""
    df = df.drop("click_indices")
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "map", "array")]
    df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    w = df.write.option("header", True).mode("overwrite")
    (w.partitionBy(by) if by else w).csv(path)


#: The columns of a trains file, in order.
TRAIN_COLUMNS = ["train_id", "start_time", "end_time", "duration", "n_clicks", "ici_median", "ici_mean", "ici_std", "ici_cv", "ici_min", "ici_max", "mean_confidence"]


def write_trains(stats: DataFrame, path: str, by: str | None = None) -> None:
    """The fixed columns of trains as CSV, with ``by`` in a folder for each of its values."""
    write_csv(stats.select(*[by] * bool(by), *TRAIN_COLUMNS), path, by)


def write_rows(df: DataFrame, path: str) -> None:
    """A few rows, such as a report's, as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_samples(df: DataFrame, path: str) -> None:
    """Training samples, one folder per split, so that a split is read alone."""
    df.write.partitionBy("split").mode("overwrite").parquet(path)


def clip_name(ordinal, seconds):
    return F.format_string("click_%04d_%08dms.wav", ordinal, (seconds * 1000).cast("int"))


def write_clips(df: DataFrame, folder: str, rate: int | None = None, samples: str = "samples", name: str = "name") -> None:
    """One WAV file per row, by a sink that holds whole clips only; without ``rate`` each row has its own."""
    from . import clips

    clips.write(df.select(F.col(name).alias("name"), (F.lit(rate) if rate else F.col("rate")).alias("rate"), F.col(samples).alias("samples")), folder)


def summary_text(row: dict) -> str:
    """Lines of ``key: value``."""
    return "".join(f"{k}: {v}\n" for k, v in row.items())
