"""Parameters of detection, fusion and trains, with YAML overrides."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Detection:
    tkeo_z: float = 6.0
    ste_z: float = 6.0
    hfc_z: float = 4.0
    high_low: float = 1.2
    width_ms: tuple[float, float] = (0.2, 1.8)
    centroid_hz: float = 8500.0
    refractory_ms: float = 1.5
    dedup_ms: float = 10.0
    transient_filter: bool = True
    min_likelihood: float = 0.3
    window_ms: float = 1.0
    step_ms: float = 0.25
    high_hz: float = 12000.0
    chunk_s: float = 60.0
    overlap_s: float = 0.5
    #: Signal around its peak that a candidate carries. Up to the overlap, one of the chunks that hold a peak has it whole.
    carry_ms: float = 20.0


@dataclass(frozen=True)
class Trains:
    min_ici: float = 0.005
    max_ici: float = 0.150
    min_clicks: int = 2


@dataclass(frozen=True)
class Fusion:
    high: float = 0.95
    medium: float = 0.60
    need_train: bool = True
    min_clicks: int = 3
    max_cv: float = 0.4
    doublet_ici_ms: tuple[float, float] = (8.0, 80.0)
    doublet_confidence: float = 0.85


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, nested dictionaries merged."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_yaml(*paths: str) -> dict:
    """The files' settings, later ones on top."""
    import yaml

    out: dict = {}
    for p in paths:
        with open(p, encoding="utf-8") as f:
            out = merged(out, yaml.safe_load(f) or {})
    return out


def required(config: dict, *keys: str) -> dict:
    """``config``, if it has all ``keys`` (dots go into nested parts)."""
    for key in keys:
        at = config
        for k in key.split("."):
            if not isinstance(at, dict) or k not in at:
                raise KeyError(f"missing setting: {key}")
            at = at[k]
    return config


def with_settings(params, settings: dict):
    """A parameter object with those of its fields that ``settings`` names."""
    names = {f.name for f in fields(params)}
    return replace(params, **{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items() if k in names})
