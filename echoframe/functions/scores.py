"""Scores as arithmetic over columns. The step tables are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def rule_confidence(tkeo_z: Column, ste_z: Column, hfc_z: Column, high_low: Column, width_ms: Column) -> Column:
    """Weighted parts, each at most 1; a negative z lowers the score."""
    parts = [(0.3, tkeo_z / 10), (0.25, ste_z / 10), (0.2, hfc_z / 8), (0.15, high_low / 2), (0.1, F.greatest(F.lit(0.0), 1 - F.abs(width_ms - 0.8)))]
    return sum((w * F.least(F.lit(1.0), x) for w, x in parts), F.lit(0.0))


def event_quality(crest_db: Column, energy_ratio: Column, width_ms: Column, centroid_hz: Column, high_low: Column) -> Column:
    parts = [
        (0.25, clip((crest_db - 10) / 20, 0, 1)),
        (0.25, clip(energy_ratio / 3, 0, 1)),
        (0.20, 1 - clip(F.abs(width_ms - 0.8) / 1.5, 0, 1)),
        (0.15, clip((centroid_hz - 5000) / 10000, 0, 1)),
        (0.15, clip(high_low / 2, 0, 1)),
    ]
    return sum((w * x for w, x in parts), F.lit(0.0))


#: For each feature, conditions in the order in which they are tried, and the factor of the first that holds.
LIKELIHOOD_STEPS = {
    "peak_sharpness": [(">", 20, 0.3), (">", 12, 0.6), ("<", 8, 1.2)],
    "attack_time_ms": [("<", 0.5, 0.4), ("in", (1.0, 5.0), 1.2), (">", 10, 0.7)],
    "energy_concentration": [(">", 0.95, 0.5), ("in", (0.75, 0.90), 1.1)],
    "envelope_symmetry": [("<", 0.3, 0.6), ("in", (0.5, 2.0), 1.1)],
    "spectral_centroid": [(">", 35000, 1.4), ("<", 15000, 0.5)],
    "high_low_ratio": [(">", 1.5, 1.2), ("<", 0.8, 0.6)],
    "rise_slope": [(">", 0.5, 0.7)],
}
TRANSIENT_ONLY = ["peak_sharpness", "attack_time_ms", "energy_concentration", "envelope_symmetry", "rise_slope"]
WITH_SPECTRUM = ["peak_sharpness", "attack_time_ms", "energy_concentration", "envelope_symmetry", "spectral_centroid", "high_low_ratio"]


def step_factor(x: Column, steps: list) -> Column:
    holds = lambda op, at: x.between(*at) if op == "in" else x > at if op == ">" else x < at
    out = F
    for op, at, factor in steps:
        out = out.when(holds(op, at), F.lit(factor))
    return out.otherwise(F.lit(1.0))


def likelihood(features: dict[str, Column], use: list[str] = WITH_SPECTRUM) -> Column:
    """Product of the features' factors, within [0.1, 2]."""
    score = F.lit(1.0)
    for name in use:
        score = score * step_factor(features[name], LIKELIHOOD_STEPS[name])
    return clip(score, 0.1, 2.0)


#: Points of the first step that is passed.
CLIP_STEPS = {
    "crest_db": [(20, 0.25), (15, 0.15), (10, 0.05)],
    "concentration": [(0.4, 0.30), (0.25, 0.20), (0.15, 0.10)],
    "peak_to_rms": [(5, 0.10), (3, 0.05)],
}


def clip_quality(crest_db: Column, peak_to_rms: Column, zcr: Column, concentration: Column, position: Column) -> Column:
    """Points of a recorded clip, 0 to 1."""

    def above(x: Column, steps: list) -> Column:
        out = F
        for at, points in steps:
            out = out.when(x > at, F.lit(points))
        return out.otherwise(F.lit(0.0))

    off = F.abs(position - 0.5)
    return (
        above(crest_db, CLIP_STEPS["crest_db"])
        + above(concentration, CLIP_STEPS["concentration"])
        + F.when(off < 0.1, 0.20).when(off < 0.2, 0.10).otherwise(0.0)
        + F.when(zcr.between(0.1, 0.3), 0.15).when(zcr.between(0.05, 0.4), 0.08).otherwise(0.0)
        + above(peak_to_rms, CLIP_STEPS["peak_to_rms"])
    )
