"""Click detection over chunks: frames, peaks, rules, transients, likelihood, merging, event features.

One Arrow kernel per chunk does the dense work and passes on only peaks that are above the first threshold, each with the
signal around it (20 ms, or as much as later windows need); everything after that is expressions, one shuffle by recording,
and no join back to the audio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import kernels, scores
from ..functions.waves import let
from ..params import Detection
from .series import refractory

_T = [x.split()[0] for x in schemas.TRANSIENT.split(", ")]
_NUMBERS = ["peak_time", "tkeo_value", "ste_value", "hfc_value", "spectral_centroid", "high_low_ratio", "envelope_width", *_T]
PEAKS = "source_file string, file_id string, chunk_id int, peak_idx long, sample_rate int, " + ", ".join(f"{n} double" for n in _NUMBERS) + ", segment array<float>, segment_at int"


def frame_table(chunks: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Every frame of every chunk with its features and robust z scores."""
    schema = schemas.FRAMES + ", ste_z double, tkeo_z double, hfc_z double, frame_time double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in kernels.records(b):
                f = kernels.frame_features(r["samples"], r["sample_rate"], p.window_ms, p.step_ms, p.high_hz)
                n = len(f["ste"])
                step = max(1, int(r["sample_rate"] * p.step_ms / 1000))
                columns = [pa.array([r["source_file"]] * n), pa.array([r["chunk_id"]] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(f[k]) for k in kernels.FEATURES)]
                columns += [pa.array(kernels.robust_z(f[k])) for k in ("ste", "tkeo", "hfc")] + [pa.array(np.arange(n) * step / r["sample_rate"])]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return chunks.select("source_file", "chunk_id", "sample_rate", "samples").mapInArrow(run, schema)


def passes(f: dict, p: Detection):
    """The rules for a peak, over NumPy arrays or columns alike: tkeo_z, ste_z, hfc_z, high_low and centroid."""
    return (f["tkeo_z"] > p.tkeo_z) & (f["ste_z"] >= p.ste_z) & ((f["hfc_z"] >= p.hfc_z) | (f["high_low"] >= p.high_low)) & (f["centroid"] >= p.centroid_hz)


def fits(width_ms, p: Detection):
    """The rule for the envelope's width."""
    return (width_ms >= p.width_ms[0]) & (width_ms <= p.width_ms[1])


def peaks(chunks: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Strict peaks of the z-scored energy operator above its threshold, with what the rules read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PEAKS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), *[pa.float64()] * len(_NUMBERS), pa.list_(pa.float32()), pa.int32()]
        for b in batches:
            for r in kernels.records(b):
                x, rate = r["samples"], r["sample_rate"]
                f = kernels.frame_features(x, rate, p.window_ms, p.step_ms, p.high_hz)
                z = {k: kernels.robust_z(f[k]) for k in ("tkeo", "ste", "hfc")}
                t = z["tkeo"]
                at = np.flatnonzero((t[1:-1] > t[:-2]) & (t[1:-1] > t[2:])) + 1
                at = at[passes({"tkeo_z": t[at], "ste_z": z["ste"][at], "hfc_z": z["hfc"][at], "high_low": f["high_low_ratio"][at], "centroid": f["spectral_centroid"][at]}, p)]
                if not len(at):
                    continue
                env = kernels.envelope(x)
                step, half = max(1, int(rate * p.step_ms / 1000)), int(rate * p.carry_ms / 1000) // 2
                rows = []
                for i in at.tolist():
                    s = i * step
                    lo = max(0, s - half)
                    numbers = ((r["start_sample"] + s) / rate, t[i], z["ste"][i], z["hfc"][i], f["spectral_centroid"][i], f["high_low_ratio"][i], kernels.width_ms(env, s, rate), *kernels.transient(x, s, rate))
                    rows.append((r["source_file"], r["file_id"], r["chunk_id"], r["start_sample"] + s, rate, *map(float, numbers), x[lo : lo + 2 * half].astype(np.float32), s - lo))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return chunks.select("source_file", "file_id", "chunk_id", "start_sample", "sample_rate", "samples").mapInArrow(run, PEAKS)


def candidates(chunks: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Clicks of all chunks: rules, confidence, likelihood, merging within chunks and then across them."""
    df = peaks(chunks, p).where(fits(F.col("envelope_width"), p))
    confidence = scores.rule_confidence(*[F.col(c) for c in ("tkeo_value", "ste_value", "hfc_value", "high_low_ratio", "envelope_width")])
    df = df.withColumns({"confidence_score": confidence, "dolphin_likelihood": F.lit(1.0)})
    if p.transient_filter:
        df = df.withColumn("dolphin_likelihood", scores.likelihood({n: F.col(n) for n in scores.WITH_SPECTRUM}))
        df = df.withColumn("confidence_score", F.col("confidence_score") * F.col("dolphin_likelihood")).where(F.col("dolphin_likelihood") >= p.min_likelihood)
    order = ["peak_time", "peak_idx"]
    df = refractory(df, "peak_time", "confidence_score", ["source_file", "chunk_id"], order, p.refractory_ms / 1000)
    return refractory(df, "peak_time", "confidence_score", ["source_file"], [*order, "chunk_id"], p.dedup_ms / 1000)


def events(found: DataFrame) -> DataFrame:
    """The events table of candidates, from the 20 ms around each peak."""
    kind = "struct<peak_amplitude: double, rms: double, snr_estimate: double, peak_factor: double, energy_ratio: double, zcr: double, bandwidth: double, rolloff: double, flatness: double>"
    names = [x.split(":")[0].strip() for x in kind[7:-1].split(",")]

    @F.arrow_udf(kind)
    def stats(seg: pa.Array, at: pa.Array, rate: pa.Array) -> pa.Array:
        rows = []
        for v, p, r in zip(seg, at.to_pylist(), rate.to_pylist()):
            half = int(r * 0.02) // 2
            x = np.asarray(v.values, np.float64)[max(0, p - half) : p + half]
            top, rms = (float(np.abs(x).max()), float(np.sqrt((x * x).mean()))) if len(x) else (0.0, 0.0)
            short, long = int(0.001 * r), int(0.005 * r)
            ratio = 0.0
            if len(x) >= long:
                c = int(np.abs(x).argmax())
                power = lambda n: float((x[max(0, c - n // 2) : c + n // 2] ** 2).mean())  # noqa: E731, B023
                ratio = power(short) / power(long) if power(long) > 0 else 0.0
            zcr = float(np.abs(np.diff(np.sign(x))).sum() / 2 / len(x)) if len(x) else 0.0
            rows.append(dict(zip(names, (top, rms, 20 * np.log10(top / (rms + 1e-10)) if top > 0 else 0.0, 20 * np.log10(top / rms) if rms > 0 else 0.0, ratio, zcr, *kernels.spectral_stats(x, r)))))
        return pa.array(rows, pa.struct([(n, pa.float64()) for n in names]))

    df = found.withColumn("_s", stats("segment", "segment_at", "sample_rate"))
    df = df.select("*", "_s.peak_amplitude", "_s.rms", "_s.snr_estimate", "_s.peak_factor", "_s.energy_ratio", "_s.zcr", F.col("_s.bandwidth").alias("spectral_bandwidth"), F.col("_s.rolloff").alias("spectral_rolloff"), F.col("_s.flatness").alias("spectral_flatness"))
    quality = scores.event_quality(*[F.col(c) for c in ("peak_factor", "energy_ratio", "envelope_width", "spectral_centroid", "high_low_ratio")])
    df = df.withColumns({"quality_score": quality, **{f"transient_{n}": F.col(n) for n in _T}})
    return df.select(*[x.split()[0] for x in schemas.EVENTS.split(", ")])


def segments(found: DataFrame, half: int, crest_db: float | None = 10.0) -> DataFrame:
    """Peak-normalised clips of ``half`` samples to each side, those with enough crest factor."""
    from ..functions import waves

    clip = waves.window_around(F.col("segment").cast("array<double>"), F.col("segment_at"), half)
    df = found.withColumn("_c", F.explode(F.array(clip)))
    if crest_db is not None:
        df = df.where(let(F.col("_c"), waves.crest_db) >= crest_db)
    return df.withColumn("samples", waves.normalized_peak(F.col("_c"))).drop("_c")
