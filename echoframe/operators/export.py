"""From recordings to accepted clicks, trains and their audio: detection, model scores, fusion, trains, files."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Detection, Fusion, Trains
from ..sources import audio, labels, sinks
from ..stages import cut
from . import detect, model, trains, windows

PART, ORDER = ["source_file"], ["peak_time", "peak_idx"]


@dataclass(frozen=True)
class Result:
    """Tables of an export: all candidates with their decision, the accepted ones, their trains, and counts."""

    decided: DataFrame
    accepted: DataFrame
    trains: DataFrame
    summary: DataFrame


def scored(found: DataFrame, weights: model.Weights | None, shape: model.Shape) -> DataFrame:
    """Candidates with ``score``: the model's for the window around the peak, or the rules' confidence without a model."""
    if weights is None:
        return found.withColumn("score", F.col("confidence_score"))
    return found.withColumn("score", model.score_around(weights, F.col("segment"), F.col("segment_at"), shape))


def accepted(found: DataFrame, fusion: Fusion = Fusion(), train: Trains = Trains()) -> Result:
    """Decisions over scored candidates, and the trains of those that are accepted. The decided candidates are computed once:
    everything that an export writes is read from them."""
    built = trains.build_trains(found, "peak_time", PART, ORDER, train)
    decided = cut(trains.fused(built, "peak_time", "score", PART, fusion))
    kept = decided.where("accept").drop("train_id", "ici")
    stats = trains.train_stats(trains.build_trains(kept, "peak_time", PART, ORDER, train), "peak_time", "score", PART)
    return Result(decided, kept, stats, trains.fusion_summary(decided, "score", PART, fusion))


def run(found_files: DataFrame, detection: Detection = Detection(), fusion: Fusion = Fusion(), train: Trains = Trains(), weights: model.Weights | None = None, shape: model.Shape = model.Shape(), rate: int = 44100) -> Result:
    need = 1000.0 * shape.length / rate if weights is not None else 0.0
    p = replace(detection, carry_ms=max(detection.carry_ms, need))
    return accepted(scored(detect.candidates(audio.chunks(found_files, p.chunk_s, p.overlap_s), p), weights, shape), fusion, train)


def train_audio(result: Result, heard: DataFrame, margin_s: float = 0.05) -> DataFrame:
    """The signal of each train with a margin to both sides, peak at 1: file_id, train_id, samples."""
    spans = result.trains.select(F.regexp_extract("source_file", audio.STEM, 1).alias("stem"), (F.col("start_time") - margin_s).alias("start"), (F.col("end_time") + margin_s).alias("end"), F.col("train_id").cast("string").alias("label"))
    return labels.labelled_segments(heard, spans, 1.0).select("file_id", F.col("label").cast("int").alias("train_id"), "samples")


def write(result: Result, heard: DataFrame, folder: str, rate: int, with_audio: bool = True) -> None:
    """events, trains and reports under ``folder``, and WAV files of clicks (2 ms before to 10 ms behind the peak) and trains."""
    events = detect.events(result.accepted)
    sinks.write_csv(events, f"{folder}/events", "file_id")
    sinks.write_trains(result.trains.withColumn("file_id", F.regexp_extract("source_file", audio.STEM, 1)), f"{folder}/trains", "file_id")
    sinks.write_rows(trains.fusion_text(result.summary), f"{folder}/reports")
    if with_audio:
        order = F.row_number().over(trains.by(PART, *ORDER)) - 1
        clip = windows.around(int(2 * rate / 1000), int(10 * rate / 1000))
        clicks = result.accepted.select(F.concat_ws("_", "file_id", sinks.clip_name(order, F.col("peak_time"))).alias("name"), clip.alias("samples"))
        sinks.write_clips(clicks, f"{folder}/audio", rate)
        whole = train_audio(result, heard).withColumn("name", F.format_string("%s_train_%04d.wav", "file_id", "train_id"))
        sinks.write_clips(whole, f"{folder}/audio", rate)
