"""NumPy kernels over dense signals and their Arrow functions. No state, no Spark inside the arithmetic."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..schemas import TRANSIENT

FEATURES = ["ste", "tkeo", "hfc", "spectral_centroid", "spectral_flatness", "high_low_ratio", "spectral_flux"]


def frames(x: np.ndarray, width: int, step: int) -> np.ndarray:
    """Whole frames as rows; one short frame if the signal is shorter."""
    return x[None, :] if len(x) < width else np.lib.stride_tricks.sliding_window_view(x, width)[::step]


def frame_features(x: np.ndarray, rate: int, window_ms: float = 1.0, step_ms: float = 0.25, high_hz: float = 12000.0, block: int = 65536) -> dict[str, np.ndarray]:
    """All features of all frames of a signal."""
    width, step = max(1, int(rate * window_ms / 1000)), max(1, int(rate * step_ms / 1000))
    return of_frames(frames(np.asarray(x, np.float64), width, step), rate, high_hz, block)


def of_frames(f: np.ndarray, rate: int, high_hz: float = 12000.0, block: int = 65536) -> dict[str, np.ndarray]:
    """All features of frames (rows), which share one spectrum, in blocks of bounded size. The flux is to the row before."""
    out = {n: np.zeros(len(f)) for n in FEATURES}
    hann = np.hanning(f.shape[1])
    hz = np.fft.rfftfreq(f.shape[1], 1 / rate)
    bins = np.arange(len(hz)) ** 2
    last = None
    for a in range(0, len(f), block):
        g = f[a : a + block]
        m = np.abs(np.fft.rfft(g * hann, axis=1))
        p, total = m * m, m.sum(axis=1)
        low, high = p[:, hz < high_hz].sum(axis=1), p[:, hz >= high_hz].sum(axis=1)
        put = lambda name, v, a=a, g=g: out[name].__setitem__(slice(a, a + len(g)), v)
        put("ste", (g * g).mean(axis=1) if g.shape[1] else 0.0)
        put("tkeo", (g[:, 1:-1] ** 2 - g[:, :-2] * g[:, 2:]).mean(axis=1) if g.shape[1] > 2 else 0.0)
        put("hfc", m @ bins)
        put("spectral_centroid", np.divide(m @ hz, total, out=np.zeros(len(g)), where=total > 0))
        put("spectral_flatness", np.exp(np.log(m + 1e-10).mean(axis=1)) / (m + 1e-10).mean(axis=1))
        put("high_low_ratio", np.divide(high, low, out=np.zeros(len(g)), where=low > 0))
        flux = np.zeros(len(g))
        flux[1:] = ((m[1:] - m[:-1]) ** 2).sum(axis=1)
        if last is not None:
            flux[0] = ((m[0] - last) ** 2).sum()
        put("spectral_flux", flux)
        last = m[-1]
    return out


def mirrored(x: np.ndarray, center: int, half: int) -> np.ndarray:
    """Samples [center - half, center + half), mirrored beyond the signal's ends."""
    period = max(1, 2 * (len(x) - 1))
    at = np.arange(center - half, center + half) % period
    return x[np.minimum(at, period - at)]


def standardized(x: np.ndarray) -> np.ndarray:
    """Mean removed, then divided by 1.4826 times the median absolute deviation, or by the RMS where that is 0."""
    x = x - x.mean()
    d, rms = np.median(np.abs(x - np.median(x))), np.sqrt((x * x).mean())
    return x / (1.4826 * d) if d > 1e-10 else x / rms if rms > 1e-10 else x


def robust_z(x: np.ndarray) -> np.ndarray:
    m = np.median(x)
    d = np.median(np.abs(x - m))
    return (x - m) / (1.4826 * d) if d > 0 else np.zeros(len(x))


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal: negative frequencies removed, positive ones doubled."""
    n = len(x)
    if not n:
        return np.zeros(0)
    s = np.fft.fft(x)
    s[1 : (n + 1) // 2] *= 2
    s[n // 2 + 1 :] = 0
    return np.abs(np.fft.ifft(s))


def width_ms(env: np.ndarray, at: int, rate: int, db: float = -10.0) -> float:
    """Time for which the envelope around ``at`` stays above ``db`` of its value there."""
    if not 0 <= at < len(env) or env[at] <= 0:
        return 0.0
    below = env <= env[at] * 10 ** (db / 20)
    left, right = np.flatnonzero(below[:at]), np.flatnonzero(below[at:])
    lo = left[-1] if len(left) else 0
    hi = at + right[0] if len(right) else len(env) - 1
    return float((hi - lo) / rate * 1000)


def transient(x: np.ndarray, at: int, rate: int, window_ms: float = 20.0) -> tuple[float, ...]:
    """attack, decay, sharpness, concentration, rise slope and symmetry of the window around a peak; one envelope for all."""
    half = int(rate * window_ms / 1000) // 2
    lo = max(0, at - half)
    seg, p = x[lo : min(len(x), at + half)], at - lo
    if len(seg) < 10 or not 0 <= p < len(seg):
        return (0.0,) * 6
    env = envelope(seg)
    top = env[p]
    attack = decay = slope = 0.0
    if top > 0:
        if p >= 1:
            hit = np.flatnonzero(env[: p + 1] <= 0.9 * top)
            i90 = int(hit[-1]) if len(hit) else p
            hit = np.flatnonzero(env[: i90 + 1] <= 0.1 * top)
            attack = max(0.0, (i90 - (int(hit[-1]) if len(hit) else p)) / rate * 1000)
        if p < len(seg) - 1:
            hit = np.flatnonzero(env[p:] <= 0.1 * top)
            decay = (int(hit[0]) if len(hit) else len(seg) - 1 - p) / rate * 1000
        if p >= 2:
            slope = (env[p - 1] - env[0]) / (p - 1) / top
    near = np.concatenate([env[max(0, p - 5) : p], env[p + 1 : p + 6]])
    mean = near.mean() if len(near) else 0.0
    energy = float((seg * seg).sum())
    reach = int(0.002 * rate)
    inner = seg[max(0, p - reach) : p + reach]
    return attack, decay, float(top / mean) if mean > 0 else 0.0, min(1.0, float((inner * inner).sum()) / energy) if energy > 0 else 0.0, float(slope), attack / decay if decay > 0 else 0.0


def spectral_stats(x: np.ndarray, rate: int) -> tuple[float, float, float]:
    """Bandwidth about the centroid, 95 % roll-off of power, flatness."""
    if not len(x):
        return 0.0, 0.0, 0.0
    m = np.abs(np.fft.rfft(x * np.hanning(len(x))))
    hz = np.fft.rfftfreq(len(x), 1 / rate)
    total = m.sum()
    c = (hz * m).sum() / total if total > 0 else 0.0
    band = math.sqrt((m * (hz - c) ** 2).sum() / total) if total > 0 else 0.0
    power = np.cumsum(m * m)
    return band, float(hz[int(np.searchsorted(power, 0.95 * power[-1]))]), float(np.exp(np.log(m + 1e-10).mean()) / (m.mean() + 1e-10))


def butterworth(order: int, cutoff: float | tuple[float, float], rate: int, kind: str) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) by the bilinear transform; ``kind`` is lowpass, highpass or bandpass."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * rate * math.tan(math.pi * f / rate)
    zeros = np.zeros(0, complex)
    if kind == "lowpass":
        poles = poles * warp(cutoff)
    elif kind == "highpass":
        poles, zeros = warp(cutoff) / poles, np.zeros(order, complex)
    else:
        lo, hi = warp(cutoff[0]), warp(cutoff[1])
        half = poles * (hi - lo) / 2
        root = np.sqrt(half**2 - lo * hi + 0j)
        poles, zeros = np.concatenate([half + root, half - root]), np.zeros(order, complex)
    z = (2 * rate + zeros) / (2 * rate - zeros)
    z = np.concatenate([z, -np.ones(len(poles) - len(z))])
    p = (2 * rate + poles) / (2 * rate - poles)
    p = p[np.argsort(-np.abs(p.imag), kind="stable")]
    pairs = []
    rest = list(p)
    while rest:
        a = rest.pop(0)
        j = int(np.argmin([abs(b - a.conjugate()) for b in rest])) if rest else -1
        pairs.append((a, rest.pop(j) if j >= 0 else 0.0))
    z = np.sort(z.real)
    z = np.ravel(np.column_stack([z[: len(z) // 2], z[::-1][: len(z) // 2]])) if kind == "bandpass" else z
    out, at = [], 0
    for a, b in pairs:
        n = 2 if b != 0.0 or len(z) - at >= 2 and abs(a.imag) > 1e-12 else 1
        num = np.poly(z[at : at + n])
        at += n
        den = np.poly([a, b]).real if n == 2 else np.array([1.0, -a.real])
        out.append([*num, *[0.0] * (3 - len(num)), *den, *[0.0] * (3 - len(den))])
    sos = np.array(out)
    test = {"lowpass": 0.0, "highpass": math.pi}.get(kind) if kind != "bandpass" else 2 * math.atan(math.sqrt(math.tan(math.pi * cutoff[0] / rate) * math.tan(math.pi * cutoff[1] / rate)))
    e = np.exp(-1j * test * np.arange(3))
    sos[0, :3] /= abs(np.prod((sos[:, :3] @ e) / (sos[:, 3:] @ e)))
    return sos


BLOCK = 512


@lru_cache(maxsize=64)
def section(b0: float, b1: float, b2: float, a1: float, a2: float) -> tuple[np.ndarray, ...]:
    """Of one section over a block: spectrum of the impulse response, the powers of the step that moves its states (what a
    state adds to the outputs is their first row), and what an input leaves in them."""
    step = np.array([[-a1, 1.0], [-a2, 0.0]])
    into = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    p = np.array(powers)
    unit = np.append(b0, p[: BLOCK - 1, 0] @ into)
    return np.fft.rfft(unit, 2 * BLOCK), p, p @ into


def carried(sos: np.ndarray, x: np.ndarray, states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The cascade applied once, causal, from the states given (two a section; rest without), and the states that it leaves.

    A section's recursion is run in blocks: the response to a block from rest is a convolution with the section's impulse
    response, and the two states carried into the block add their decays.
    """
    y = np.asarray(x, np.float64)
    left = np.zeros(2 * len(sos)) if states is None else np.array(states, np.float64)
    for k, (b0, b1, b2, _, a1, a2) in enumerate(np.asarray(sos).tolist()):
        spectrum, powers, leaves = section(b0, b1, b2, a1, a2)
        out, state = np.empty(len(y)), left[2 * k : 2 * k + 2]
        for a in range(0, len(y), BLOCK):
            v = y[a : a + BLOCK]
            free = np.fft.irfft(np.fft.rfft(v, 2 * BLOCK) * spectrum, 2 * BLOCK)[: len(v)]
            out[a : a + len(v)] = free + powers[: len(v), 0] @ state
            state = powers[len(v)] @ state + v @ leaves[: len(v)][::-1]
        left[2 * k : 2 * k + 2] = state
        y = out
    return y, left


def silence(sos: np.ndarray) -> np.ndarray:
    """The matrix by which a sample of silence moves the states of the cascade."""
    n = 2 * len(sos)
    return np.stack([carried(sos, np.zeros(1), unit)[1] for unit in np.eye(n)], axis=1)


def filtered(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cascade applied once, causal, from rest."""
    return carried(sos, x)[0]


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cascade forward and backward over the signal with odd extensions at both ends."""
    n = min(3 * (2 * len(sos) + 1), len(x) - 1)
    if n <= 0:
        return filtered(sos, x)
    ext = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    return filtered(sos, filtered(sos, ext)[::-1])[::-1][n : n + len(x)]


def resampled(x: np.ndarray, rate: int, to: int, taps: int = 16) -> np.ndarray:
    """Polyphase resampling by a Kaiser-windowed sinc: ceil(len * to / rate) samples."""
    if rate == to or not len(x):
        return np.asarray(x, np.float64)
    g = math.gcd(rate, to)
    x = np.asarray(x, np.float64)

    def part(a: int, b: int) -> np.ndarray:
        return np.pad(x[max(0, a) : max(0, b)], (max(0, -a), max(0, b - max(len(x), a))))

    return resampled_part(part, rate, to, 0, -(-len(x) * (to // g) // (rate // g)), taps)


def resampled_part(source, rate: int, to: int, lo: int, hi: int, taps: int = 16) -> np.ndarray:
    """Samples [lo, hi) of the resampled signal, from ``source(a, b)``: samples [a, b) of the signal, zeros beyond its ends."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    wide = max(up, down)
    half = taps * wide
    t = np.arange(-half, half + 1)
    h = np.sinc(t / wide) * np.kaiser(len(t), 8.0) * (up / wide)
    out = np.zeros(hi - lo)
    at = np.arange(lo, hi, dtype=np.int64) * down
    reach = half // up + 1
    first = at // up
    if not len(out):
        return out
    base = int(first[0]) - reach
    x = source(base, int(first[-1]) + reach + 1)
    for k in range(-reach, reach + 1):  # each input sample that an output sees
        j = at - (first + k) * up
        ok = np.abs(j) <= half
        out[ok] += x[first[ok] + k - base] * h[j[ok] + half]
    return out


def preprocessed(x: np.ndarray, rate: int, to: int = 44100, cutoff: float = 1000.0, order: int = 4) -> np.ndarray:
    """Resampled and high-passed; the filter is left out where the cutoff is at or above half the rate."""
    y = resampled(x, rate, to)
    return (filtered(butterworth(order, cutoff, to, "highpass"), y) if len(y) and cutoff < to / 2 else y).astype(np.float32)


def equalized(x: np.ndarray, rate: int, low_db: float, high_db: float, split_hz: float = 5000.0) -> np.ndarray:
    """Two bands about ``split_hz`` with their own gains."""
    s = np.fft.rfft(x)
    hz = np.fft.rfftfreq(len(x), 1 / rate)
    return np.fft.irfft(s * np.where(hz < split_hz, 10 ** (low_db / 20), 10 ** (high_db / 20)), len(x))


def channel(x: np.ndarray, which: int) -> np.ndarray:
    """One channel of a 2-D signal: the longer side is time, and the last channel stands for any beyond it."""
    if x.ndim == 1:
        return x
    x = x.T if x.shape[0] < x.shape[1] else x
    return x[:, min(which, x.shape[1] - 1)]


def records(b: pa.RecordBatch, samples: str = "samples"):
    """Rows of an Arrow batch as dictionaries, their signals as arrays of the column's own buffer."""
    names = [n for n in b.schema.names if n != samples]
    for v, row in zip(b.column(samples), zip(*(b.column(n).to_pylist() for n in names))):
        yield dict(zip(names, row)) | {samples: v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else np.empty(0)}


def same_length(x: pa.Array):
    """Rows of an Arrow column of arrays and their signals as a matrix, for each length but 0."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(x), 0))
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        yield rows, x.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


def spectral_features(rate: int, high_hz: float = 12000.0):
    """Arrow function: array of samples -> struct of the features of the whole signal as one frame."""
    names = FEATURES[:-1]

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def run(x: pa.Array) -> pa.Array:
        out = {n: np.zeros(len(x)) for n in names}
        for rows, m in same_length(x):  # signals of one length are frames of one spectrum
            f = of_frames(m, rate, high_hz)
            for n in names:
                out[n][rows] = f[n]
        return pa.StructArray.from_arrays([pa.array(out[n]) for n in names], names)

    return run


def transient_features(rate: int, window_ms: float = 20.0):
    """Arrow function: samples and a position -> struct of the six transient features."""
    names = [x.split()[0] for x in TRANSIENT.split(", ")]

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def run(x: pa.Array, at: pa.Array) -> pa.Array:
        rows = [dict(zip(names, transient(np.asarray(v.values if v.is_valid else [], np.float64), int(p.as_py() or 0), rate, window_ms))) for v, p in zip(x, at)]
        return pa.array(rows, pa.struct([(n, pa.float64()) for n in names]))

    return run


def mapped(signal):
    """Arrow function from array to array by a function of a NumPy signal."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        out = [None if not ok else [] for ok in x.is_valid().to_pylist()]
        for rows, m in same_length(x):
            for i, v in zip(rows.tolist(), m):
                out[i] = np.asarray(signal(v), np.float64)
        return pa.array(out, pa.list_(pa.float64()))

    return run


def spectrum_db(x: np.ndarray, rate: int, width: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hz, seconds and dB (time, frequency) of Hann frames that overlap by half."""
    width = max(2, min(width, len(x)))
    f = frames(np.asarray(x, np.float64), width, max(1, width // 2))
    m = np.abs(np.fft.rfft(f * np.hanning(f.shape[1]), axis=1))
    return np.fft.rfftfreq(f.shape[1], 1 / rate), np.arange(len(f)) * max(1, width // 2) / rate, 20 * np.log10(m + 1e-10)
