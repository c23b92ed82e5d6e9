"""Column functions over one signal in an array column. All arithmetic is in double; positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where rows are made of the result: an explode pushes a filter
    on its array's size below the projection that computes ``value``, which else is computed again for every sample. Spark
    doesn't take it as the argument of a Python function, so functions that are such arguments leave it to their caller."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(total(x, lambda v: v * v) / F.size(x))).otherwise(0.0)


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0))


def peak_at(x: Column) -> Column:
    """Position of the first largest absolute value; -1 in an empty signal."""
    return let(F.transform(x, F.abs), lambda a: F.coalesce(F.array_position(a, F.array_max(a)), F.lit(0)).cast("int") - 1)


def crest_db(x: Column) -> Column:
    """Peak over RMS in dB; 0 for silence."""
    return let(rms(x), lambda r: F.when(r > 0, 20 * F.log10(peak(x) / r)).otherwise(0.0))


def scaled(x: Column, by: Column) -> Column:
    """The signal divided by ``by``; unchanged where that isn't positive."""
    return F.when(by > 0, F.transform(x, lambda v: v / by)).otherwise(x)


def normalized_rms(x: Column) -> Column:
    return let(rms(x), lambda r: scaled(x, r))


def normalized_peak(x: Column) -> Column:
    return let(peak(x), lambda p: scaled(x, p))


def median(x: Column) -> Column:
    """Exact median with linear interpolation; null in an empty signal."""

    def mid(s: Column) -> Column:
        n = F.size(s)
        return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2

    return let(F.array_sort(x), mid)


def mad(x: Column) -> Column:
    return let(median(x), lambda m: median(F.transform(x, lambda v: F.abs(v - m))))


def normalized_mad(x: Column) -> Column:
    return let(F.struct(median(x).alias("m"), mad(x).alias("d")), lambda s: F.when(s["d"] > 0, F.transform(x, lambda v: (v - s["m"]) / (1.4826 * s["d"]))).otherwise(x))


def tkeo(x: Column) -> Column:
    """x[n]^2 - x[n-1] x[n+1] for the inner samples; empty below three samples."""
    inner = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 2, F.lit(0)))
    return let(x, lambda x: F.transform(inner(x), lambda v, i: v * v - F.get(x, i) * F.get(x, i + 2)))


def zero_crossings(x: Column) -> Column:
    """Mean of half the sign changes."""
    steps = F.transform(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda v, i: F.abs(F.signum(v) - F.signum(F.get(x, i))))
    return F.when(F.size(x) > 0, total(steps) / 2 / F.size(x)).otherwise(0.0)


def window_around(x: Column, center: Column, half: int) -> Column:
    """Samples [center - half, center + half), cut at the signal's ends."""
    lo = F.greatest(center - half, F.lit(0))
    hi = F.least(center + half, F.size(x))
    return F.slice(x, lo + 1, F.greatest(hi - lo, F.lit(0)))


def energy(x: Column) -> Column:
    return total(x, lambda v: v * v)


def energy_ratio(x: Column, short: int, long: int) -> Column:
    """Mean power of a short window around the peak over that of a long one; 0 below ``long`` samples."""

    def of(p: Column) -> Column:
        power = lambda n: let(window_around(x, p, n // 2), lambda s: F.when(F.size(s) > 0, energy(s) / F.size(s)).otherwise(0.0))
        return let(power(long), lambda b: F.when(b > 0, power(short) / b).otherwise(0.0))

    return F.when(F.size(x) >= long, let(peak_at(x), of)).otherwise(0.0)


def energy_concentration(x: Column, half: int) -> Column:
    """Share of the energy within ``half`` samples of the peak, 1 at most."""
    return let(energy(x), lambda e: F.when(e > 0, F.least(F.lit(1.0), energy(let(peak_at(x), lambda p: window_around(x, p, half))) / e)).otherwise(0.0))


def center_energy(x: Column, share: float = 0.2) -> Column:
    """Share of the energy in the middle ``share`` of the signal."""
    half = F.floor(F.size(x) * share / 2).cast("int")
    mid = F.floor(F.size(x) / 2).cast("int")
    inner = F.slice(x, F.greatest(mid - half, F.lit(0)) + 1, 2 * half)
    return let(energy(x), lambda e: F.when(e > 0, energy(inner) / e).otherwise(0.0))


def peak_position(x: Column) -> Column:
    return F.when(F.size(x) > 0, peak_at(x) / F.size(x)).otherwise(0.0)


def clipped(x: Column, at: float = 0.99) -> Column:
    return F.size(F.filter(x, lambda v: F.abs(v) >= at))


def padded(x: Column, n: int, mode: str = "constant") -> Column:
    """Centred to ``n`` samples; longer signals keep their head. Modes: constant (zeros), edge, reflect."""

    def at(x: Column, i: Column) -> Column:
        j = i - F.floor((F.lit(n) - F.size(x)) / 2).cast("int")
        if mode == "constant":
            return F.when((j >= 0) & (j < F.size(x)), F.get(x, j)).otherwise(0.0)
        if mode == "edge":
            return F.get(x, F.greatest(F.least(j, F.size(x) - 1), F.lit(0)))
        period = F.greatest(2 * (F.size(x) - 1), F.lit(1))
        k = F.pmod(j, period)
        return F.get(x, F.least(k, period - k))

    whole = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(x, i))
    return F.when(F.size(x) >= n, F.slice(x, 1, n)).when(F.size(x) == 0, F.array_repeat(F.lit(0.0), n)).otherwise(whole)


def mirrored_window(x: Column, center: Column, half: int) -> Column:
    """Samples [center - half, center + half); beyond the signal's ends it is mirrored. Null where there are no samples."""

    def at(k: Column) -> Column:
        period = F.greatest(2 * (F.size(x) - 1), F.lit(1))
        j = F.pmod(center - half + k, period)
        return F.get(x, F.least(j, period - j))

    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.lit(2 * half - 1)), at))


def standardized(x: Column) -> Column:
    """Mean removed, then divided by 1.4826 times the median absolute deviation, or by the RMS where that is 0."""

    def of(c: Column) -> Column:
        by = let(F.struct((1.4826 * mad(c)).alias("d"), rms(c).alias("r")), lambda s: F.when(s["d"] > 1.4826e-10, s["d"]).when(s["r"] > 1e-10, s["r"]).otherwise(1.0))
        return let(by, lambda b: F.transform(c, lambda v: v / b))

    return let(let(total(x) / F.greatest(F.size(x), F.lit(1)), lambda m: F.transform(x, lambda v: v - m)), of)


def framed(x: Column, width: int, step: int) -> Column:
    """Whole frames of the signal; one short frame if it is shorter than a frame."""
    n = F.floor((F.size(x) - width) / step).cast("int")
    return F.when(F.size(x) >= width, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(x, i * step + 1, width))).otherwise(F.array(x))


def mean_square(x: Column) -> Column:
    return F.when(F.size(x) > 0, energy(x) / F.size(x)).otherwise(0.0)


def pre_emphasis(x: Column, c: float = 0.97) -> Column:
    return F.transform(x, lambda v, i: v - c * F.coalesce(F.get(x, i - 1), F.lit(0.0)))


def shifted(x: Column, by: Column) -> Column:
    """Moved right by ``by`` samples (left if negative), the edge value filling the gap."""
    return F.transform(x, lambda v, i: F.get(x, F.greatest(F.lit(0), F.least(F.size(x) - 1, i - by))))


def mixed(clean: Column, noise: Column, snr_db: Column, power_mode: str = "amplitude", limit: float = 1.0) -> Column:
    """Signal plus noise scaled to the wanted SNR, clipped to +-limit.

    ``amplitude`` takes 10^(snr/20) of the RMS ratio, so the realised SNR is the wanted one; ``legacy`` takes 10^(snr/10).
    """
    root = 10.0 if power_mode == "legacy" else 20.0

    def add(k: Column) -> Column:
        return F.zip_with(clean, noise, lambda a, b: F.greatest(F.lit(-limit), F.least(F.lit(limit), a + k * b)))

    return let(F.when(rms(noise) > 0, rms(clean) / rms(noise) / F.pow(F.lit(10.0), snr_db / root)).otherwise(0.0), add)


def realised_snr_db(mix: Column, clean: Column) -> Column:
    """10 log10 of signal power over the power of what was added; null (infinite) if nothing was."""
    rest = F.zip_with(mix, clean, lambda a, b: a - b)
    return let(mean_square(rest), lambda n: F.when(n > 0, 10 * F.log10(mean_square(clean) / n)))


def reverberated(x: Column, delay: int, gain: float) -> Column:
    """One echo, scaled back under a peak of 1."""
    return let(F.transform(x, lambda v, i: v + gain * F.coalesce(F.get(x, i - delay), F.lit(0.0))), lambda y: let(peak(y), lambda p: F.when(p > 1, F.transform(y, lambda v: v / p)).otherwise(y)))


def de_emphasis(x: Column, c: float = 0.97) -> Column:
    """Inverse of :func:`pre_emphasis`: y[n] = x[n] + c y[n-1], a filter section like any other."""
    from .kernels import filtered, mapped

    return mapped(lambda v: filtered([[1.0, 0.0, 0.0, 1.0, -c, 0.0]], v))(x)
