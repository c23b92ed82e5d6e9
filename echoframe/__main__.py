"""Command line: python -m echoframe <command> <input> <output> [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import waves
from .operators import checks, datasets, detect, evaluate, export, model, samples, training, trains
from .params import Detection, Fusion, Trains, load_yaml, with_settings
from .sources import audio, labels, ranges, sinks, tables

COMMANDS = {
    "scan": "headers of recordings, as CSV",
    "detect": "recordings to an events table",
    "trains": "events to trains, as CSV",
    "fuse": "events to decisions",
    "export": "recordings to accepted events, trains, reports and clips",
    "segment-noise": "recordings to windows of noise",
    "preprocess": "recordings and array files, resampled and filtered, to WAV files",
    "mat-to-wav": "a channel (--channel) of MATLAB files to WAV files at their own rates",
    "look": "a training set to WAV files of a few rows of each split (--n)",
    "collect-clicks": "clips of many folders, by name, to one table",
    "prepare-data": "files of labelled folders to their parts of the data set, as CSV",
    "build-dataset": "clips and a noise manifest (--noise) to a training set",
    "balance": "rows with a label to a balanced split",
    "train": "a training set to a model's weights (.npz)",
    "evaluate": "rows with label and score to a report and predictions",
    "eval": "a training set's part and weights (--weights) to a report and predictions",
    "eval-wav": "folders positive and negative of clips and weights to a report and predictions",
    "label-report": "files of a labelling tool to counts of categories",
    "audacity": "events to label files",
    "verify": "a training set to level and sample statistics",
    "check": "a training set to rows that say what it lacks",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echoframe")
    p.add_argument("--config", action="append", default=[], help="a YAML file; later ones go on top")
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in COMMANDS.items():
        s = sub.add_parser(name, help=about)
        s.add_argument("input")
        s.add_argument("output")
        s.add_argument("--seconds", type=float, default=1.0)
        s.add_argument("--seed", type=int, default=0)
        s.add_argument("--threshold", type=float, default=0.5)
        s.add_argument("--rate", type=int, default=44100)
        s.add_argument("--weights")
        s.add_argument("--noise")
        s.add_argument("--split", default="train")
        s.add_argument("--val", type=float, default=0.2)
        s.add_argument("--epochs", type=int, default=0, help="of train: 0 fits the head alone")
        s.add_argument("--channel", type=int, default=10)
        s.add_argument("--n", type=int, default=20)
        s.add_argument("--batch", type=int, default=128)
        s.add_argument("--checkpoints", help="folder of the training's state")
        s.add_argument("--resume", action="store_true")
    return p


def length(rate: int) -> int:
    """Samples of half a second, the length of a training sample."""
    return int(0.5 * rate)


def network(a: argparse.Namespace) -> tuple[model.Weights, model.Shape]:
    """The weights given, or seeded ones, and their shape."""
    if a.weights:
        weights = model.load(a.weights)
        return weights, model.shape_of(weights, length(a.rate))
    shape = model.Shape(length=length(a.rate))
    return model.initial(shape, a.seed), shape


def train_model(spark: SparkSession, a: argparse.Namespace) -> None:
    """Weights from a training set: all of the network by ``--epochs``, with its history beside them, or the head alone."""
    rows = tables.read_samples(spark, a.input, "train")
    weights, shape = network(a)
    if not a.epochs:
        model.save(model.train_head(rows, "waveform", "label", weights, shape), a.output)
        return
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    classes = [sum(n.values()) / len(n) / n[c] if c in n else 0.0 for c in range(shape.classes)]
    settings = training.Settings(batch=a.batch, epochs=a.epochs, seed=a.seed)
    done = training.fit(rows, tables.read_samples(spark, a.input, "val"), "waveform", "label", "file_id", shape, settings, classes, a.checkpoints, a.resume)
    model.save(training.scored_form(done.best), a.output)
    sinks.write_csv(spark.createDataFrame(done.history), a.output.removesuffix(".npz") + "_history")


def reported(scored: DataFrame, path: str, a: argparse.Namespace) -> None:
    """report, predictions and misclassified rows of scored ones (label, score) under the output folder."""
    sinks.write_rows(evaluate.report(scored, "label", "score", a.threshold), f"{a.output}/report")
    rows = model.predictions(scored, path, "label", a.threshold)
    sinks.write_csv(rows, f"{a.output}/predictions")
    sinks.write_csv(evaluate.wrong(rows), f"{a.output}/misclassified")


def half_second(spark: SparkSession, folder: str, rate: int) -> DataFrame:
    found = audio.clips(audio.files(spark, [folder]), rate=rate)
    return found.withColumn("wave", waves.padded(F.col("samples").cast("array<double>"), length(rate)))


def build_dataset(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Clips of exactly half a second, mixed with the noise of the manifest's split."""
    clean = audio.clips(audio.files(spark, [a.input]), rate=a.rate).where(F.size("samples") == length(a.rate))
    manifest = tables.read_manifest(spark, a.noise, a.split)
    roots = sorted({r[0].rpartition("/")[0] for r in manifest.select("path").distinct().collect()})  # as many as there are noise files' folders
    noise = tables.noise_audio(manifest, audio.clips(audio.files(spark, roots))).where(F.size("wave") == length(a.rate))
    return samples.training_set(clean.select("file_id", F.col("samples").cast("array<double>").alias("wave")), noise, a.seed, val=a.val)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"echoframe {a.command}").getOrCreate()
    config = load_yaml(*a.config) if a.config else {}
    detection = with_settings(Detection(), config.get("detection", {}))
    train = with_settings(Trains(), config.get("trains", {}))
    fusion = with_settings(Fusion(), config.get("fusion", {}))
    part, order = ["source_file"], ["peak_time", "peak_idx"]
    if a.command == "scan":
        sinks.write_csv(audio.recordings(audio.files(spark, [a.input])).orderBy("filepath"), a.output)
    elif a.command == "detect":
        cut = ranges.chunks(spark, [a.input], chunk_s=detection.chunk_s, overlap_s=detection.overlap_s)
        detect.events(detect.candidates(cut, detection)).write.mode("overwrite").parquet(a.output)
    elif a.command in ("trains", "fuse"):
        clicks = trains.build_trains(spark.read.parquet(a.input), "peak_time", part, order, train)
        if a.command == "trains":
            sinks.write_trains(trains.train_stats(clicks, "peak_time", "confidence_score", part), a.output, "source_file")
        else:
            trains.fused(clicks, "peak_time", "confidence_score", part, fusion).write.mode("overwrite").parquet(a.output)
    elif a.command == "export":
        found = audio.files(spark, [a.input])
        result = export.run(found, detection, fusion, train, model.load(a.weights) if a.weights else None, rate=a.rate)
        export.write(result, ranges.chunks(spark, [a.input], chunk_s=detection.chunk_s, overlap_s=detection.overlap_s), a.output, a.rate)
    elif a.command == "segment-noise":
        audio.noise_segments(ranges.chunks(spark, [a.input]), a.seconds).write.mode("overwrite").parquet(a.output)
    elif a.command == "preprocess":
        sinks.write_clips(audio.preprocessed_rows(audio.files(spark, [a.input], "*.{wav,npy,mat}"), a.rate, which=a.channel), a.output, a.rate)
    elif a.command == "mat-to-wav":
        found = audio.clips(audio.files(spark, [a.input], "*.mat"), mono="channel", which=a.channel)
        sinks.write_clips(found.select(F.concat("file_id", F.lit(".wav")).alias("name"), F.col("sample_rate").alias("rate"), "samples"), a.output)
    elif a.command == "look":
        rows = tables.read_samples(spark, a.input)
        splits = [r[0] for r in rows.select("split").distinct().collect()]
        chosen = samples.some(rows, a.seed, dict.fromkeys(splits, a.n))
        name = F.concat_ws("_", "split", F.when(F.col("label") == 1, "pos").otherwise("neg"), F.regexp_replace("file_id", "[^A-Za-z0-9._-]", "-"))
        sinks.write_clips(chosen.select(F.concat(name, F.lit(".wav")).alias("name"), "waveform"), a.output, a.rate, "waveform")
    elif a.command == "collect-clicks":
        named = datasets.collected_names(audio.files(spark, [a.input]).select("path"), "path")
        sinks.write_csv(named, a.output)
    elif a.command == "prepare-data":
        sinks.write_csv(audio.labelled_roles(audio.files(spark, [a.input], "*").select("path")), a.output)
    elif a.command == "build-dataset":
        made = build_dataset(spark, a)
        sinks.write_samples(made, a.output)
        sinks.write_rows(samples.set_stats(tables.read_samples(spark, a.output)), a.output.rstrip("/") + "_stats")
    elif a.command == "balance":
        out = datasets.train_val(datasets.balanced(spark.read.parquet(a.input), "label", a.seed, "id"), a.seed, a.val, "id")
        sinks.write_samples(out, a.output)
    elif a.command == "train":
        train_model(spark, a)
    elif a.command == "evaluate":
        reported(spark.read.parquet(a.input), "id", a)
    elif a.command == "eval":
        weights, shape = network(a)
        rows = tables.read_samples(spark, a.input, a.split)
        reported(rows.select("file_id", "label", model.score(weights, F.col("waveform"), shape).alias("score")), "file_id", a)
    elif a.command == "eval-wav":
        weights, shape = network(a)
        both = [half_second(spark, f"{a.input}/{name}", a.rate).withColumn("label", F.lit(y)) for name, y in (("positive", 1), ("negative", 0))]
        rows = both[0].unionByName(both[1])
        reported(rows.select("source_file", "label", model.score(weights, F.col("wave"), shape).alias("score")), "source_file", a)
    elif a.command == "label-report":
        sinks.write_csv(labels.category_report(labels.read_label_json(spark, a.input)), a.output)
    elif a.command == "audacity":
        labels.write_audacity(spark.read.parquet(a.input), "peak_time", 0.05, a.output)
    elif a.command == "verify":
        rows = tables.read_samples(spark, a.input).withColumn("waveform", F.col("waveform").cast("array<double>"))
        sinks.write_rows(checks.level_summary(rows, "waveform"), f"{a.output}/levels")
        sinks.write_rows(checks.sample_stats(rows, "waveform"), f"{a.output}/samples")
        sinks.write_csv(checks.abnormal(rows, "waveform").where("reason is not null").select("file_id", "reason", "n_outliers"), f"{a.output}/abnormal")
    else:
        sinks.write_rows(checks.readiness(tables.read_samples(spark, a.input), length(a.rate)), a.output)


if __name__ == "__main__":
    main()
