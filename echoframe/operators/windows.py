"""Windows of signal around candidates, as expressions over the signal that each carries (``segment``, ``segment_at``).

Lengths are in samples of the row's rate, truncated; what a window needs must be carried (``Detection.carry_ms``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waves
from .datasets import draw


def carried() -> Column:
    return F.col("segment").cast("array<double>")


def centered(samples: int, mode: str = "reflect") -> Column:
    """``samples`` around the peak; what is missing at an end of the signal is padded to both sides."""
    return waves.padded(waves.window_around(carried(), F.col("segment_at"), samples // 2), samples, mode)


def around(pre: int, post: int) -> Column:
    """From ``pre`` samples before the peak to ``post`` behind it, cut at the signal's ends, peak at 1."""
    lo = F.greatest(F.col("segment_at") - pre, F.lit(0))
    return waves.normalized_peak(F.slice(carried(), lo + 1, F.least(F.col("segment_at") + post, F.size("segment")) - lo))


def positives(found: DataFrame, seed: int, samples: int, rate: int = 44100, jitter_ms: float = 10.0) -> DataFrame:
    """A standardised window of ``samples`` around each candidate (source_file, peak_idx), its centre moved by a drawn offset
    of up to ``jitter_ms``; mirrored at the signal's ends. An odd length has no such window, and gives no rows."""
    n = int(rate * jitter_ms / 1000)
    offset = (F.floor(draw(seed, "source_file", "peak_idx") * (2 * n + 1)) - n).cast("int")
    window = waves.mirrored_window(carried(), F.col("segment_at") + offset, samples // 2)
    out = found.withColumn("waveform", waves.let(window, waves.standardized)).where(F.size("waveform") == samples)
    return out.select("waveform", F.lit(1).alias("label"), "file_id", F.col("peak_idx").alias("candidate_idx"), "peak_time", F.col("confidence_score").alias("confidence"))
