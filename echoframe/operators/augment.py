"""Seeded augmentation of signals and synthetic click trains.

Every draw is a number from md5 of the seed, the row's key and the draw's name, so it is the same in any engine, for any
partitioning and beside any other rows. Draws and click trains are column expressions; the stages of an augmentation, of
which one needs a spectrum, go through one kernel that is given the row's draws.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels, waves


def drawn(seed: int, key: Column, name: str, lo: float = 0.0, hi: float = 1.0) -> Column:
    """A number in [lo, hi)."""
    part = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(name))), 1, 8)
    return lo + F.conv(part, 16, 10).cast("double") / 4294967296.0 * (hi - lo)


def shaped(samples: Column, by: Column, scale: Column, low_db: Column, high_db: Column, delay: Column, echo: Column, rate: int) -> Column:
    """Moved right by ``by`` samples, the edge filling the gap, and scaled (neither where ``by`` is null); two bands with
    gains; one echo (none where ``echo`` is null) scaled back under a peak of 1. All by row."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array, *draws: pa.Array) -> pa.Array:
        out = []
        for v, by, k, a, b, d, g in zip(x, *(c.to_pylist() for c in draws)):
            if not v.is_valid or not len(v.values):
                out.append(v.as_py())
                continue
            y = v.values.to_numpy(zero_copy_only=False)
            if by is not None:
                y = y[np.clip(np.arange(len(y)) - by, 0, len(y) - 1)] * k
            y = kernels.equalized(y, rate, a, b)
            if g is not None:
                z = y.copy()
                if 0 < d < len(y):
                    z[d:] += g * y[:-d]
                top = np.abs(z).max()
                y = z / top if top > 1 else z
            out.append(y)
        return pa.array(out, pa.list_(pa.float64()))

    return run(samples, by, scale, low_db, high_db, delay, echo)


def augmented(samples: Column, key: Column, seed: int, rate: int = 44100, chance: float = 0.8) -> Column:
    """Three stages in order, each with ``chance``: shift by up to 10 ms and scale; two-band gain; one echo."""
    some = lambda name: drawn(seed, key, name) < chance
    n = rate // 100
    by = F.when(some("moved"), F.floor(drawn(seed, key, "shift", -n, n + 1)).cast("int"))
    gain = lambda name: F.when(some("gained"), drawn(seed, key, name, -3, 3)).otherwise(0.0)
    delay = F.floor(drawn(seed, key, "delay", 0.001, 0.01) * rate).cast("int")
    echo = F.when(some("echoed"), drawn(seed, key, "echo", 0.1, 0.4))
    return shaped(samples.cast("array<double>"), by, drawn(seed, key, "scale", 0.8, 1.25), gain("low"), gain("high"), delay, echo, rate)


def click_starts(n_click: Column, key: Column, seed: int, rate: int = 44100, length: int = 22050, ici_ms: tuple[float, float] = (8.0, 80.0), tries: int = 10) -> Column:
    """Start samples of 2 to 5 copies of a click of ``n_click`` samples, or null if they don't fit in ``tries`` draws.

    Gaps are normal about the middle of ``ici_ms`` with a sixth of its width, cut to it.
    """
    mid, width = sum(ici_ms) / 2, (ici_ms[1] - ici_ms[0]) / 6

    def gap(t: int, i: int) -> Column:
        u, v = drawn(seed, key, f"u{t}.{i}"), drawn(seed, key, f"v{t}.{i}")
        normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
        return F.greatest(F.lit(ici_ms[0]), F.least(F.lit(ici_ms[1]), mid + width * normal)) / 1000 * rate

    def attempt(t: int) -> Column:
        n = F.floor(drawn(seed, key, f"n{t}", 2, 6)).cast("int")
        ends = [F.lit(0.0)]
        for i in range(4):
            ends.append(ends[-1] + gap(t, i))
        at = F.transform(F.slice(F.array(*ends), F.lit(1), n), lambda x: F.floor(x).cast("int"))

        def placed(a: Column) -> Column:
            room = length - F.element_at(a, -1) - n_click
            first = F.floor(drawn(seed, key, f"first{t}") * (room + 1)).cast("int")
            return F.when(room >= 0, F.transform(a, lambda x: x + first))

        return waves.let(at, placed)

    return F.coalesce(*[attempt(t) for t in range(tries)])


def click_trains(click: Column, noise: Column, key: Column, seed: int, rate: int = 44100, length: int = 22050) -> Column:
    """Copies of a click, with an RMS of 0.1 and each with its own gain, at :func:`click_starts` over repeated noise; peaks
    stay under 0.95. Null where they don't fit."""
    clip = waves.let(click.cast("array<double>"), lambda c: waves.let(waves.rms(c), lambda r: F.when(r > 0, F.transform(c, lambda v: v * 0.1 / r)).otherwise(c)))
    starts = click_starts(F.size(click), key, seed, rate, length)
    gains = F.array(*[drawn(seed, key, f"gain{i}", 0.8, 1.25) for i in range(5)])
    z = noise.cast("array<double>")

    def made(p: Column) -> Column:
        def sample(t: Column) -> Column:
            base = F.when(F.size(p["z"]) > 0, F.get(p["z"], F.pmod(t, F.size(p["z"])))).otherwise(0.0)
            own = F.transform(p["at"], lambda a, i: F.coalesce(F.when(t >= a, F.get(p["c"], t - a)), F.lit(0.0)) * F.get(p["g"], i))
            return base + F.aggregate(own, F.lit(0.0), lambda s, v: s + v)

        y = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), sample)
        return waves.let(y, lambda v: waves.let(waves.peak(v), lambda top: F.when(top > 0.95, F.transform(v, lambda w: w * 0.95 / top)).otherwise(v)))

    parts = F.struct(clip.alias("c"), starts.alias("at"), gains.alias("g"), z.alias("z"))
    return waves.let(parts, lambda p: F.when(p["at"].isNotNull(), made(p)))
