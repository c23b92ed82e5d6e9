"""Queries over signals: level, shape, frames, padding, spectra of short signals, mixing."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import waves as W
from ..operators import checks as C
from ..operators import datasets as D
from ..operators import samples as T
from .base import SAMPLES, WAVES, waves

r6 = lambda c, n: F.round(c, 6).alias(n)
X = lambda: F.col("x")  # noqa: E731  columns exist only within a session
LEVELS = SAMPLES + """, lv AS (SELECT id, any_value(label) AS label, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak, count(*) AS n, arg_max(i, (abs(v), -i)) AS pk FROM samples GROUP BY id)"""


def wave_levels(spark, sf):
    return waves(spark, sf).select("id", r6(W.rms(X()), "rms"), r6(W.peak(X()), "peak"), r6(W.crest_db(X()), "crest_db"), W.peak_at(X()).cast("long").alias("peak_at"))


def wave_zcr(spark, sf):
    return waves(spark, sf).select("id", r6(W.zero_crossings(X()), "zcr"))


def wave_energy(spark, sf):
    return waves(spark, sf).select("id", r6(W.energy_ratio(X(), 8, 32), "ratio"), r6(W.energy_concentration(X(), 4), "concentration"), r6(W.center_energy(X()), "center"), r6(W.peak_position(X()), "position"))


ENERGY_SQL = f"""WITH {LEVELS}, e AS (SELECT s.id, sum(v * v) FILTER (i >= pk - 4 AND i < pk + 4) AS a4, count(*) FILTER (i >= pk - 4 AND i < pk + 4) AS n4,
 sum(v * v) FILTER (i >= pk - 16 AND i < pk + 16) AS a16, count(*) FILTER (i >= pk - 16 AND i < pk + 16) AS n16, sum(v * v) AS a, any_value(n) AS n, any_value(pk) AS pk,
 sum(v * v) FILTER (i >= 26 AND i < 38) AS c FROM samples s JOIN lv USING (id) GROUP BY s.id)
SELECT id, round((a4 / n4) / (a16 / n16), 6) AS ratio, round(least(1.0, a4 / a), 6) AS concentration, round(c / a, 6) AS center, round(pk / n, 6) AS position FROM e"""


def wave_clipping(spark, sf):
    return waves(spark, sf).select("id", W.clipped(X(), 0.5).cast("long").alias("n_clipped"))


def _long(df, name):
    return df.select("id", F.posexplode(name).alias("i", "v")).select("id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


def wave_normalize_rms(spark, sf):
    return _long(waves(spark, sf).select("id", W.normalized_rms(X()).alias("y")), "y")


def wave_normalize_peak(spark, sf):
    return _long(waves(spark, sf).select("id", W.normalized_peak(X()).alias("y")), "y")


def wave_normalize_mad(spark, sf):
    return _long(waves(spark, sf).select("id", W.normalized_mad(X()).alias("y")), "y")


MAD_SQL = f"""WITH {SAMPLES}, m AS (SELECT id, median(v) AS m FROM samples GROUP BY id), d AS (SELECT s.id, any_value(m.m) AS m, median(abs(v - m.m)) AS d FROM samples s JOIN m USING (id) GROUP BY s.id)
SELECT id, i, round(CASE WHEN d.d > 0 THEN (v - d.m) / (1.4826 * d.d) ELSE v END, 6) AS v FROM samples JOIN d USING (id)"""


def wave_tkeo(spark, sf):
    return _long(waves(spark, sf).select("id", W.tkeo(X()).alias("y")), "y")


def wave_pre_emphasis(spark, sf):
    return _long(waves(spark, sf).select("id", W.let(X(), lambda x: W.pre_emphasis(x)).alias("y")), "y")


def wave_pad_reflect(spark, sf):
    return _long(waves(spark, sf).select("id", W.let(X(), lambda x: W.padded(x, 100, "reflect")).alias("y")), "y")


def wave_pad_edges(spark, sf):
    return waves(spark, sf).select("id", r6(W.total(W.padded(X(), 100)), "zero_sum"), r6(W.total(W.padded(X(), 100, "edge")), "edge_sum"), r6(W.total(W.padded(X(), 40)), "head_sum"))


def wave_frames_ste(spark, sf):
    frames = waves(spark, sf).select("id", F.posexplode(W.framed(X(), 16, 4)).alias("frame", "f"))
    return frames.select("id", F.col("frame").cast("long").alias("frame"), r6(W.mean_square(F.col("f")), "ste"))


#: Stand-in rate: bins of a 64-point spectrum are 1 kHz apart.
RATE, N = 64000, 64
_hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / (N - 1)) for i in range(N)]


def wave_spectra(spark, sf):
    """Spectral features of each signal as one Hann-windowed frame, by the array kernel."""
    from ..functions.kernels import spectral_features

    out = waves(spark, sf).select("id", spectral_features(RATE, high_hz=12000.0)(X()).alias("f"))
    return out.select("id", F.round("f.spectral_centroid", 4).alias("centroid"), F.round("f.hfc", 4).alias("hfc"), F.round("f.spectral_flatness", 6).alias("flatness"), F.round("f.high_low_ratio", 5).alias("high_low"))


SPECTRA_SQL = f"""WITH {SAMPLES}, w AS (SELECT id, i, v * (0.5 - 0.5 * cos(2 * pi() * i / {N - 1})) AS v FROM samples),
k AS (SELECT unnest(range(0, {N // 2 + 1})) AS k), ft AS (SELECT id, k, sqrt(pow(sum(v * cos(2 * pi() * i * k / {N})), 2) + pow(sum(v * sin(2 * pi() * i * k / {N})), 2)) AS m FROM w, k GROUP BY id, k)
SELECT id, round(sum(m * k * {RATE / N}) / sum(m), 4) AS centroid, round(sum(m * k * k), 4) AS hfc, round(exp(avg(ln(m + 1e-10))) / (avg(m + 1e-10)), 6) AS flatness,
 round(sum(m * m) FILTER (k * {RATE / N} >= 12000) / sum(m * m) FILTER (k * {RATE / N} < 12000), 5) AS high_low FROM ft GROUP BY id"""


def wave_quality(spark, sf):
    w = waves(spark, sf)
    q = S.clip_quality(W.crest_db(X()), F.when(W.rms(X()) > 0, W.peak(X()) / W.rms(X())).otherwise(0.0), W.zero_crossings(X()), W.center_energy(X()), W.peak_position(X()))
    out = w.select("id", F.explode(F.array(q)).alias("q"))
    return out.select("id", F.round("q", 6).alias("quality"), (F.round("q", 6) >= 0.4).alias("good"))


QUALITY_SQL = f"""WITH {LEVELS}, z AS (SELECT id, sum(abs(sign(v) - sign(p))) / 2 / 64 AS zcr FROM (SELECT id, v, lag(v) OVER (PARTITION BY id ORDER BY i) AS p FROM samples) GROUP BY id),
c AS (SELECT id, sum(v * v) FILTER (i >= 26 AND i < 38) / sum(v * v) AS c FROM samples GROUP BY id),
q AS (SELECT id, CASE WHEN 20 * log10(peak / rms) > 20 THEN 0.25 WHEN 20 * log10(peak / rms) > 15 THEN 0.15 WHEN 20 * log10(peak / rms) > 10 THEN 0.05 ELSE 0 END
 + CASE WHEN c > 0.4 THEN 0.3 WHEN c > 0.25 THEN 0.2 WHEN c > 0.15 THEN 0.1 ELSE 0 END + CASE WHEN abs(pk / n - 0.5) < 0.1 THEN 0.2 WHEN abs(pk / n - 0.5) < 0.2 THEN 0.1 ELSE 0 END
 + CASE WHEN zcr BETWEEN 0.1 AND 0.3 THEN 0.15 WHEN zcr BETWEEN 0.05 AND 0.4 THEN 0.08 ELSE 0 END + CASE WHEN peak / rms > 5 THEN 0.1 WHEN peak / rms > 3 THEN 0.05 ELSE 0 END AS q
 FROM lv JOIN z USING (id) JOIN c USING (id)) SELECT id, round(CAST(q AS DOUBLE), 6) AS quality, round(CAST(q AS DOUBLE), 6) >= 0.4 AS good FROM q"""


def _mixed(spark, sf):
    w = waves(spark, sf)
    clean = w.where("id % 2 = 0").select("label", "id", F.col("x").alias("wave"))
    noise = w.where("id % 2 = 1").select("label", F.col("id").alias("noise_id"), F.col("x").alias("noise"))
    return D.mixed_samples(clean, noise, 5, ["label"])


def snr_mix(spark, sf):
    m = _mixed(spark, sf)
    return m.select("id", "noise_id", F.round("snr_db", 6).alias("snr_db"), r6(W.rms(F.col("wave")), "rms"), W.clipped(F.col("wave"), 1.0).cast("long").alias("n_clipped"))


_draw = lambda seed, key: f"(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) / 4294967296.0)"
MIX = f""", cl AS (SELECT id, label, x, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || id), id) - 1 AS k FROM waves WHERE id % 2 = 0),
no AS (SELECT id, label, x, row_number() OVER (PARTITION BY label ORDER BY md5('6:' || id), id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM waves WHERE id % 2 = 1),
sz AS (SELECT label, any_value(n) AS n FROM no GROUP BY label),
pa AS (SELECT cl.id, no.id AS noise_id, cl.x AS c, no.x AS z, 20.0 * {_draw(7, 'cl.id')} AS snr FROM cl JOIN sz USING (label) JOIN no ON no.label = cl.label AND no.r = cl.k % sz.n),
sm AS (SELECT id, noise_id, snr, unnest(c) AS c, unnest(z) AS z FROM pa),
kk AS (SELECT id, sqrt(avg(c * c)) / sqrt(avg(z * z)) / pow(10, any_value(snr) / 20) AS k FROM sm GROUP BY id),
mx AS (SELECT sm.id, noise_id, snr, c, greatest(-1, least(1, c + k * z)) AS m FROM sm JOIN kk USING (id))"""


def snr_verify(spark, sf):
    m = _mixed(spark, sf)
    return m.select("id", r6(W.realised_snr_db(F.col("wave"), F.col("clean")), "realised_db"))


def wave_describe(spark, sf):
    """Level statistics of each label, from per-signal partial sums."""
    w = waves(spark, sf).select("label", F.size("x").alias("n"), W.total(X()).alias("s"), W.energy(X()).alias("q"), W.peak(X()).alias("p"), W.rms(X()).alias("r"))
    g = w.groupBy("label").agg(F.count("*").alias("n_waves"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("p").alias("max_peak"), F.avg("r").alias("mean_rms"))
    mean = F.col("s") / F.col("n")
    return g.select(F.col("label").cast("long").alias("label"), "n_waves", r6(mean, "mean"), r6(F.sqrt(F.col("q") / F.col("n") - mean * mean), "std"), r6(F.col("max_peak"), "max_peak"), r6(F.col("mean_rms"), "mean_rms"))


def wave_transient(spark, sf):
    """Attack, decay, sharpness, concentration, rise slope and symmetry about each signal's peak."""
    from ..functions.kernels import transient_features

    w = waves(spark, sf).withColumn("at", W.peak_at(X()))
    return w.select("id", transient_features(RATE)(X(), F.col("at")).alias("f")).select("id", *[F.round(f"f.{n}", 6).alias(n) for n in ("attack_time_ms", "decay_time_ms", "peak_sharpness", "energy_concentration", "rise_slope", "envelope_symmetry")])


#: Of the analytic signal by an explicit transform of 64 samples: the envelope, then the places that the features look for.
TRANSIENT_SQL = f"""WITH {LEVELS}, ft AS (SELECT id, k, sum(v * cos(2 * pi() * i * k / {N})) AS re, -sum(v * sin(2 * pi() * i * k / {N})) AS im FROM samples, (SELECT unnest(range(0, {N // 2 + 1})) AS k) GROUP BY id, k),
an AS (SELECT id, i, sum(c * (re * cos(2 * pi() * i * k / {N}) - im * sin(2 * pi() * i * k / {N}))) / {N} AS re, sum(c * (re * sin(2 * pi() * i * k / {N}) + im * cos(2 * pi() * i * k / {N}))) / {N} AS im
 FROM (SELECT *, CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END AS c FROM ft), (SELECT unnest(range(0, {N})) AS i) GROUP BY id, i),
en AS (SELECT an.id, i, sqrt(re * re + im * im) AS e, pk FROM an JOIN lv USING (id)), tp AS (SELECT id, e AS top FROM en WHERE i = pk),
a1 AS (SELECT en.id, any_value(pk) AS pk, any_value(top) AS top, coalesce(max(i) FILTER (i <= pk AND e <= 0.9 * top), any_value(pk)) AS i90, min(i) FILTER (i >= pk AND e <= 0.1 * top) AS down,
  max(e) FILTER (i = pk - 1) AS prior, max(e) FILTER (i = 0) AS zero, avg(e) FILTER (abs(i - pk) BETWEEN 1 AND 5) AS near FROM en JOIN tp USING (id) GROUP BY en.id),
a2 AS (SELECT a1.*, (SELECT max(en.i) FROM en WHERE en.id = a1.id AND en.i <= a1.i90 AND en.e <= 0.1 * a1.top) AS i10 FROM a1),
f AS (SELECT id, CASE WHEN pk >= 1 THEN greatest(0, (i90 - coalesce(i10, pk)) / {RATE} * 1000) ELSE 0 END AS attack, CASE WHEN pk < {N - 1} THEN (coalesce(down, {N - 1}) - pk) / {RATE} * 1000 ELSE 0 END AS decay,
  top / near AS sharp, CASE WHEN pk >= 2 THEN (prior - zero) / (pk - 1) / top ELSE 0 END AS slope FROM a2)
SELECT id, round(attack, 6) AS attack_time_ms, round(decay, 6) AS decay_time_ms, round(sharp, 6) AS peak_sharpness, CAST(1.0 AS DOUBLE) AS energy_concentration, round(slope, 6) AS rise_slope,
 round(CASE WHEN decay > 0 THEN attack / decay ELSE 0 END, 6) AS envelope_symmetry FROM f"""


def band():
    from ..functions.kernels import butterworth

    return butterworth(4, (4000.0, 20000.0), RATE, "bandpass")


def wave_filter(spark, sf):
    """Level of each signal through a band-pass, causal and zero-phase, and after resampling."""
    from ..functions import kernels as K

    sos = band()
    level = lambda f: F.round(W.rms(K.mapped(f)(X())), 6)
    return waves(spark, sf).select("id", level(lambda x: K.filtered(sos, x)).alias("causal"), level(lambda x: K.zero_phase(sos, x)).alias("zero_phase"), level(lambda x: K.resampled(x, RATE, 44100)).alias("resampled"))


def recursion(name: str, source: str, sos) -> str:
    """The filter as its difference equations: two states a section, sample by sample, over ``source`` (id, i, v)."""
    states = [f"s{k}{j}" for k in range(len(sos)) for j in (1, 2)]
    inner, v = "SELECT p.*, q.v AS y_in FROM " + f"{name} p JOIN {source} q ON q.id = p.id AND q.i = p.i + 1", "y_in"
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
        inner = f"SELECT *, {b0!r} * {v} + s{k}1 AS o{k} FROM ({inner})"
        inner = f"SELECT *, {b1!r} * {v} - ({a1!r}) * o{k} + s{k}2 AS t{k}1, {b2!r} * {v} - ({a2!r}) * o{k} AS t{k}2 FROM ({inner})"
        v = f"o{k}"
    return f"""{name} AS (SELECT DISTINCT id, CAST(-1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS v, {', '.join(f'CAST(0 AS DOUBLE) AS {s}' for s in states)} FROM {source} UNION ALL
 SELECT id, i + 1, {v}, {', '.join(f't{s[1:]}' for s in states)} FROM ({inner}))"""


def filter_sql() -> str:
    sos, up, down, taps, to = band(), 441, 640, 16, 44100
    ext = min(3 * (2 * len(sos) + 1), N - 1)
    whole = N + 2 * ext
    half = taps * down
    bessel = lambda x: f"list_sum([pow({x} / 2, 2 * k) / pow(gamma(k + 1), 2) FOR k IN range(0, 40)])"
    return f"""WITH RECURSIVE {SAMPLES}, {recursion('fc', 'samples', sos)},
ex AS (SELECT w.id, j AS i, CASE WHEN j < {ext} THEN 2 * x[1] - x[{ext} - j + 1] WHEN j >= {ext + N} THEN 2 * x[{N}] - x[{N} - (j - {ext + N} + 1)] ELSE x[j - {ext} + 1] END AS v FROM waves w, (SELECT unnest(range(0, {whole})) AS j)),
{recursion('fe', 'ex', sos)}, rv AS (SELECT id, {whole - 1} - i AS i, v FROM fe WHERE i >= 0), {recursion('fb', 'rv', sos)},
tap AS (SELECT t, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t / {down}) / (pi() * t / {down}) END * {bessel(f'(8.0 * sqrt(greatest(0.0, 1 - pow(t / {half}, 2))))')} / {bessel('8.0')} * {up} / {down} AS h FROM (SELECT CAST(unnest(range({-half}, {half + 1})) AS DOUBLE) AS t)),
rs AS (SELECT id, m, sum(v * h) AS v FROM samples, (SELECT unnest(range(0, {-(-N * up // down)})) AS m) JOIN tap ON tap.t = m * {down} - i * {up} GROUP BY id, m)
SELECT id, (SELECT round(sqrt(avg(v * v)), 6) FROM fc WHERE fc.id = w.id AND fc.i >= 0) AS causal, (SELECT round(sqrt(avg(v * v)), 6) FROM fb WHERE fb.id = w.id AND fb.i BETWEEN {ext} AND {ext + N - 1}) AS zero_phase,
 (SELECT round(sqrt(avg(v * v)), 6) FROM rs WHERE rs.id = w.id) AS resampled FROM waves w"""


#: Signals of a recording that is filtered in pieces.
LONG = 8


def wave_filter_pieces(spark, sf):
    """Level of each piece of recordings of eight signals, filtered over the pieces: states go on from one to the next."""
    from ..operators import filtering

    at = F.col("id")
    pieces = waves(spark, sf).select(F.floor(at / LONG).cast("long").alias("rec"), (at % LONG).alias("k"), "x")
    # recordings that lack a signal close up
    order = F.row_number().over(Window.partitionBy("rec").orderBy("k")) - 1
    pieces = pieces.select("rec", order.cast("long").alias("k"), "x")
    level = lambda df, name: df.select("rec", "k", F.round(W.rms(X()), 6).alias(name))
    return level(filtering.filtered(pieces, ["rec"], "x", band()), "causal").join(level(filtering.zero_phase(pieces, ["rec"], "x", band()), "zero_phase"), ["rec", "k"])


def filter_pieces_sql() -> str:
    sos = band()
    ext = 3 * (2 * len(sos) + 1)
    return f"""WITH RECURSIVE {WAVES}, p AS (SELECT id // {LONG} AS id, row_number() OVER (PARTITION BY id // {LONG} ORDER BY id) - 1 AS k, x FROM waves),
s AS (SELECT id, k * {N} + generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM p), z AS (SELECT id, max(i) AS top FROM s GROUP BY id),
ends AS (SELECT s.id, -s.i AS i, 2 * a.v - s.v AS v FROM s JOIN s a ON a.id = s.id AND a.i = 0 WHERE s.i BETWEEN 1 AND {ext}
 UNION ALL SELECT s.id, 2 * top - s.i, 2 * b.v - s.v FROM s JOIN z ON z.id = s.id JOIN s b ON b.id = s.id AND b.i = top WHERE s.i BETWEEN top - {ext} AND top - 1),
ex AS (SELECT id, i + {ext} AS i, v FROM (SELECT id, i, v FROM s UNION ALL SELECT id, i, v FROM ends)),
{recursion('fc', 's', sos)}, {recursion('fe', 'ex', sos)}, rv AS (SELECT fe.id, top + {2 * ext} - i AS i, v FROM fe JOIN z USING (id) WHERE i >= 0), {recursion('fb', 'rv', sos)},
c AS (SELECT id, i // {N} AS k, round(sqrt(avg(v * v)), 6) AS causal FROM fc WHERE i >= 0 GROUP BY ALL),
b AS (SELECT id, (top + {ext} - i) // {N} AS k, round(sqrt(avg(v * v)), 6) AS zero_phase FROM fb JOIN z USING (id) WHERE i BETWEEN {ext} AND top + {ext} GROUP BY ALL)
SELECT id AS rec, k, causal, zero_phase FROM c JOIN b USING (id, k)"""


def recording_ranges(spark, sf):
    """Recordings of eight signals each, written as WAV files and read back by byte range: the level of the overlapping chunks
    that a filter on time leaves."""
    from ..sources import clips, ranges
    from ..stages import folder

    one = waves(spark, sf).groupBy(F.floor(F.col("id") / LONG).cast("long").alias("rec")).agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("s"))
    at = folder(spark, "recordings")
    clips.write(one.select(F.format_string("r%d.wav", "rec").alias("name"), F.lit(RATE).alias("rate"), F.flatten("s.x").alias("samples")), at)
    found = ranges.scan(spark, [at], chunk_s=N / RATE, overlap_s=N / 4 / RATE).where(f"start_s >= {2 * N / RATE} and end_s < {7 * N / RATE} and error is null")
    level = F.round(F.sqrt(W.energy(F.col("samples").cast("array<double>")) / F.size("samples")), 4)
    return found.select(F.expr("substr(file_id, 2)").cast("long").alias("rec"), "chunk_id", "start_sample", F.size("samples").alias("n"), level.alias("rms"))


RANGES_SQL = f"""WITH {WAVES}, r AS (SELECT id // {LONG} AS rec, flatten(list(x ORDER BY id)) AS x FROM waves GROUP BY id // {LONG}),
q AS (SELECT rec, [CAST(CAST(round(greatest(-1, least(1, v)) * 32767) / 32768 AS FLOAT) AS DOUBLE) FOR v IN x] AS x, len(x) AS total FROM r),
c AS (SELECT rec, total, k, k * {N * 3 // 4} AS lo, least(k * {N * 3 // 4} + {N}, total) AS hi, x FROM q, (SELECT unnest(range(0, {LONG * 2})) AS k) WHERE k = 0 OR (k - 1) * {N * 3 // 4} + {N} < total)
SELECT rec, CAST(k AS INTEGER) AS chunk_id, CAST(lo AS BIGINT) AS start_sample, CAST(hi - lo AS INTEGER) AS n, round(sqrt(list_sum([v * v FOR v IN x[lo + 1:hi]]) / (hi - lo)), 4) AS rms FROM c WHERE lo >= {2 * N} AND hi < {7 * N}"""


def network_training(spark, sf):
    """History of two epochs of the network on the signals and whether their label is odd, a fifth held back."""
    from ..operators import training
    from ..operators.model import Shape

    w = waves(spark, sf).select("id", (F.col("label") % 2).alias("y"), "x")
    held = F.col("id") % 5 == 0
    shape = Shape(4, ((8, 2, 1),), 0, 2, N)
    done = training.fit(w.where(~held), w.where(held), "x", "y", "id", shape, training.Settings(batch=1024, group=128, epochs=2, rate=0.01))
    return spark.createDataFrame(done.history, "epoch int, train_loss double, train_acc double, val_loss double, val_acc double, rate double")


def wave_augment(spark, sf):
    """Level of each signal after seeded augmentation, and where the clicks of a train stand (null where it didn't fit)."""
    from ..operators import augment as A

    w = waves(spark, sf).select("id", A.augmented(X(), F.col("id"), 9, RATE).alias("y"), A.click_starts(F.size("x"), F.col("id"), 9, RATE, 16000).alias("at"))
    return w.select("id", F.round(W.rms(F.col("y")), 6).alias("rms"), F.size("at").cast("long").alias("n_clicks"), F.element_at("at", 1).cast("long").alias("first"), F.element_at("at", -1).cast("long").alias("last"))


def _uniform(name: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"({lo} + (CAST('0x' || substr(md5('9:' || id || ':{name}'), 1, 8) AS BIGINT) / 4294967296.0) * ({hi} - ({lo})))"


def augment_sql() -> str:
    n = RATE // 100
    normal = lambda t, i: f"greatest(8.0, least(80.0, 44.0 + 12.0 * sqrt(-2 * ln(1 - {_uniform(f'u{t}.{i}')})) * cos(2 * pi() * {_uniform(f'v{t}.{i}')}))) / 1000 * {RATE}"
    tries = []
    for t in range(10):
        ends = ["0.0"] + [" + ".join(["0.0", *[f"g{j}" for j in range(i + 1)]]) for i in range(4)]
        gaps = ", ".join(f"{normal(t, i)} AS g{i}" for i in range(4))
        tries.append(f"SELECT id, {t} AS t, c, [CAST(floor(e) AS BIGINT) FOR e IN [{', '.join(ends)}][:c]] AS pos, {_uniform(f'first{t}')} AS f FROM (SELECT id, CAST(floor({_uniform(f'n{t}', 2, 6)}) AS INT) AS c, {gaps} FROM waves)")
    return f"""WITH {WAVES}, d AS (SELECT id, x, {_uniform('moved')} < 0.8 AS moved, CAST(floor({_uniform('shift', -n, n + 1)}) AS BIGINT) AS sh, {_uniform('scale', 0.8, 1.25)} AS sc, {_uniform('gained')} < 0.8 AS gained,
 {_uniform('low', -3, 3)} AS lo, {_uniform('high', -3, 3)} AS hi, {_uniform('echoed')} < 0.8 AS echoed, CAST(floor({_uniform('delay', 0.001, 0.01)} * {RATE}) AS BIGINT) AS dl, {_uniform('echo', 0.1, 0.4)} AS eg FROM waves),
s AS (SELECT d.*, j AS i, CASE WHEN moved THEN x[greatest(0, least({N - 1}, j - sh)) + 1] * sc ELSE x[j + 1] END AS v FROM d, (SELECT unnest(range(0, {N})) AS j)),
ft AS (SELECT id, k, any_value(CASE WHEN gained THEN pow(10, (CASE WHEN k * {RATE / N} < 5000 THEN lo ELSE hi END) / 20) ELSE 1 END) * CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END AS c,
 sum(v * cos(2 * pi() * i * k / {N})) AS re, -sum(v * sin(2 * pi() * i * k / {N})) AS im FROM s, (SELECT unnest(range(0, {N // 2 + 1})) AS k) GROUP BY id, k),
eq AS (SELECT id, i, sum(c * (re * cos(2 * pi() * i * k / {N}) - im * sin(2 * pi() * i * k / {N}))) / {N} AS v FROM ft, (SELECT unnest(range(0, {N})) AS i) GROUP BY id, i),
ec AS (SELECT eq.id, eq.i, echoed, CASE WHEN echoed AND dl > 0 THEN eq.v + eg * coalesce(p.v, 0) ELSE eq.v END AS v FROM eq JOIN d USING (id) LEFT JOIN eq p ON p.id = eq.id AND p.i = eq.i - dl),
lv AS (SELECT id, sqrt(avg(v * v)) / CASE WHEN any_value(echoed) THEN greatest(1, max(abs(v))) ELSE 1 END AS rms FROM ec GROUP BY id),
tr AS ({' UNION ALL '.join(tries)}), ok AS (SELECT id, t, c, pos, CAST(floor(f * (16000 - pos[-1] - {N} + 1)) AS BIGINT) AS f, row_number() OVER (PARTITION BY id ORDER BY t) AS rn FROM tr WHERE 16000 - pos[-1] - {N} >= 0)
SELECT lv.id, round(rms, 6) AS rms, CAST(c AS BIGINT) AS n_clicks, pos[1] + f AS "first", pos[-1] + f AS "last" FROM lv LEFT JOIN ok ON ok.id = lv.id AND rn = 1"""


def small_network():
    """A network that SQL can say in full: every kind of layer once, seeded weights."""
    from ..operators import model as M

    shape = M.Shape(base=3, blocks=((4, 2, 1), (4, 1, 2)), hidden=5, length=N)
    w = M.initial(shape, 1)
    return shape, w | {k: (v + 0.1 * (i + 1) / len(v)).astype("float32") for k, v in w.items() for i in [len(k)] if k.endswith((".scale", ".shift", ".b"))}


def wave_model_scores(spark, sf):
    """Class-1 probability of each signal by a convolutional scorer with seeded weights, against its label."""
    from ..operators import model as M

    shape, weights = small_network()
    w = waves(spark, sf).select(F.col("id").cast("string").alias("path"), (F.col("label") % 2).alias("y"), M.score(weights, X(), shape).alias("score"))
    return M.predictions(w, "path", "y").withColumn("confidence", F.round("confidence", 6))


def model_sql() -> str:
    """The layers as joins of samples with weights, one table a layer."""
    shape, w = small_network()
    parts = [SAMPLES, "l AS (SELECT id, 0 AS c, i AS t, v FROM samples)"]

    def conv(out: str, source: str, name: str, length: int, step: int = 1, dilation: int = 1, relu: bool = False) -> None:
        k = w[f"{name}.w"].shape[2]
        pad = (k - 1) * dilation // 2
        rows = ", ".join(f"({o}, {c}, {j}, {float(v)!r})" for o, m in enumerate(w[f"{name}.w"]) for c, r in enumerate(m) for j, v in enumerate(r))
        own = ", ".join(f"({o}, {float(a)!r}, {float(b)!r})" for o, (a, b) in enumerate(zip(w[f"{name}.scale"], w[f"{name}.shift"])))
        y = "sum(x.v * k.w) * any_value(n.a) + any_value(n.b)"
        parts.append(f"""{out} AS (SELECT x.id, k.o AS c, g.t, {f'greatest(0, {y})' if relu else y} AS v FROM (SELECT unnest(range(0, {length})) AS t) g, (VALUES {rows}) k(o, c, j, w), (VALUES {own}) n(o, a, b), {source} x
 WHERE x.c = k.c AND n.o = k.o AND x.t = g.t * {step} + k.j * {dilation} - {pad} GROUP BY x.id, k.o, g.t)""")

    length = -(-N // 2)
    conv("l0", "l", "stem", length, 2, relu=True)
    last = "l0"
    for b, (_, step, dilation) in enumerate(shape.blocks):
        length = -(-length // step)
        conv(f"p{b}", last, f"b{b}.1", length, step, dilation, relu=True)
        conv(f"q{b}", f"p{b}", f"b{b}.2", length, 1, dilation)
        if f"b{b}.skip.w" in w:
            conv(f"s{b}", last, f"b{b}.skip", length, step)
        parts.append(f"l{b + 1} AS (SELECT q.id, q.c, q.t, greatest(0, q.v + s.v) AS v FROM q{b} q JOIN {f's{b}' if f'b{b}.skip.w' in w else last} s USING (id, c, t))")
        last = f"l{b + 1}"
    parts.append(f"h AS (SELECT id, c, avg(v) AS v FROM {last} GROUP BY id, c)")

    def dense(out: str, source: str, name: str, relu: bool) -> None:
        rows = ", ".join(f"({o}, {c}, {float(v)!r}, {float(w[f'{name}.b'][o])!r})" for o, r in enumerate(w[f"{name}.w"]) for c, v in enumerate(r))
        y = "sum(x.v * k.w) + any_value(k.b)"
        parts.append(f"{out} AS (SELECT x.id, k.o AS c, {f'greatest(0, {y})' if relu else y} AS v FROM {source} x JOIN (VALUES {rows}) k(o, c, w, b) ON x.c = k.c GROUP BY x.id, k.o)")

    dense("d", "h", "hidden", True)
    dense("e", "d", "out", False)
    parts.append("sc AS (SELECT id, 1 / (1 + exp(sum(CASE c WHEN 0 THEN v ELSE -v END))) AS s FROM e GROUP BY id)")
    return f"""WITH {', '.join(parts)} SELECT CAST(id AS VARCHAR) AS file_path, label % 2 AS true_label, CAST(s >= 0.5 AS INT) AS predicted_label, round(CASE WHEN s >= 0.5 THEN s ELSE 1 - s END, 6) AS confidence,
 CAST(s >= 0.5 AS INT) = label % 2 AS correct FROM sc JOIN waves USING (id)"""


def wave_flux(spark, sf):
    """Spectral flux between neighbouring frames of 16 samples that begin 8 apart."""
    from ..functions.kernels import frame_features, mapped

    flux = mapped(lambda x: frame_features(x, RATE, 0.2501, 0.1251)["spectral_flux"])
    return _long(waves(spark, sf).select("id", flux(X()).alias("y")), "y")


FLUX_SQL = f"""WITH {SAMPLES}, fr AS (SELECT id, f, i - f * 8 AS j, v * (0.5 - 0.5 * cos(2 * pi() * (i - f * 8) / 15)) AS v FROM samples JOIN (SELECT unnest(range(0, 7)) AS f) ON i >= f * 8 AND i < f * 8 + 16),
m AS (SELECT id, f, k, sqrt(pow(sum(v * cos(2 * pi() * j * k / 16)), 2) + pow(sum(v * sin(2 * pi() * j * k / 16)), 2)) AS m FROM fr, (SELECT unnest(range(0, 9)) AS k) GROUP BY id, f, k)
SELECT a.id, CAST(a.f AS BIGINT) AS i, round(coalesce(sum(pow(a.m - b.m, 2)), 0), 6) AS v FROM m a LEFT JOIN m b ON b.id = a.id AND b.k = a.k AND b.f = a.f - 1 GROUP BY a.id, a.f"""


def wave_windows(spark, sf):
    """Mirrored windows of 48 samples around each peak, standardised: energy and the first and last sample."""
    w = waves(spark, sf).select("id", W.let(W.mirrored_window(X(), W.peak_at(X()), 24), W.standardized).alias("y"))
    return w.select("id", r6(W.energy(F.col("y")), "energy"), r6(F.element_at("y", 1), "first"), r6(F.element_at("y", -1), "last"))


WINDOWS_SQL = f"""WITH {LEVELS}, j AS (SELECT w.id, x, k, (((pk - 24 + k) % 126) + 126) % 126 AS j FROM waves w JOIN lv USING (id), (SELECT unnest(range(0, 48)) AS k)),
m AS (SELECT id, k, x[least(j, 126 - j) + 1] AS v FROM j), c AS (SELECT id, k, v - avg(v) OVER (PARTITION BY id) AS v FROM m),
md AS (SELECT id, median(v) AS m FROM c GROUP BY id), d AS (SELECT c.id, median(abs(v - m)) AS d FROM c JOIN md USING (id) GROUP BY c.id), s AS (SELECT id, k, v / (1.4826 * d.d) AS v FROM c JOIN d USING (id))
SELECT id, round(sum(v * v), 6) AS energy, round(max(v) FILTER (k = 0), 6) AS first, round(max(v) FILTER (k = 47), 6) AS last FROM s GROUP BY id"""


def wave_abnormal(spark, sf):
    """Signals whose levels are beyond bounds (set so that some are), with their outlying samples."""
    return C.abnormal(waves(spark, sf), "x", 0.6, 2.0, 1.0, 3.0).select("id", "reason", "n_outliers")


def level_summary(spark, sf):
    out = C.level_summary(waves(spark, sf), "x")
    return out.select("measure", *[F.round(c, 6).alias(c) for c in ("mean", "median", "min", "max", "std")])


LEVEL_SQL = f"""WITH {LEVELS}, md AS (SELECT id, median(v) AS m FROM samples GROUP BY id), mm AS (SELECT s.id, median(abs(v - m)) AS mad FROM samples s JOIN md USING (id) GROUP BY s.id),
a AS (SELECT 'rms' AS measure, rms AS v FROM lv UNION ALL SELECT 'peak', peak FROM lv UNION ALL SELECT 'mad', mad FROM mm)
SELECT measure, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std FROM a GROUP BY measure"""


def sample_stats(spark, sf):
    out = C.sample_stats(waves(spark, sf), "x")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "median")])


def _training(spark, sf, noisy="id % 3 <> 0"):
    w = waves(spark, sf)
    clean = w.where("id % 3 = 0").select(F.col("id").alias("file_id"), F.col("x").alias("wave"))
    noise = w.where(noisy).select(F.col("id").alias("segment_id"), (F.col("label") % 4).alias("parent_id"), F.col("x").alias("wave"))
    return T.training_set(clean, noise, 21, share=0.3, per_clean=0.8)


#: Far fewer pieces of noise than clips: those that want one source take them all.
SHORT = "id % 50 = 1"


def training_set(spark, sf, noisy="id % 3 <> 0"):
    """Clips mixed with noise that is used once, noise alone as negatives, and the split; the level of each."""
    return _training(spark, sf, noisy).select("file_id", "label", "split", "strategy", F.col("noise_parent").cast("long").alias("noise_parent"), F.round("snr_db", 6).alias("snr_db"), r6(W.rms(F.col("waveform")), "rms"))


def training_set_short(spark, sf):
    """The same with less noise than clips: every clip has its positive, by pieces that are used again."""
    return training_set(spark, sf, SHORT)


def training_stats(spark, sf):
    return T.set_stats(_training(spark, sf)).withColumn("mean_snr_db", F.round("mean_snr_db", 6))


def training_checks(spark, sf):
    return C.readiness(_training(spark, sf), N)


_md5 = lambda seed, key: f"md5('{seed}:' || {key})"
_part = lambda seed, key: f"(CAST('0x' || substr({_md5(seed, key)}, 1, 8) AS BIGINT) / 4294967296.0)"
TRAINING = f"""{WAVES}, cl AS (SELECT id AS file_id, x FROM waves WHERE id % 3 = 0), no AS (SELECT id AS segment_id, label % 4 AS parent_id, x FROM waves WHERE id % 3 <> 0),
ps AS (SELECT count(DISTINCT parent_id) AS np, list_sort(list(DISTINCT parent_id)) AS ids FROM no),
ro AS (SELECT file_id, CASE WHEN {_part(21, 'file_id')} < 0.3 AND np > 1 THEN ids[CAST(floor({_part(22, 'file_id')} * np) AS INT) + 1] END AS parent_id FROM cl, ps),
fr AS (SELECT file_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY {_md5(23, 'file_id')}, file_id) - 1 AS r FROM ro WHERE parent_id IS NOT NULL),
ow AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY {_md5(24, 'segment_id')}, segment_id) - 1 AS r, count(*) OVER (PARTITION BY parent_id) AS n FROM no),
f1 AS (SELECT file_id, 'one_parent' AS strategy, ow.segment_id, ow.parent_id FROM fr JOIN ow ON ow.parent_id = fr.parent_id AND ow.r = fr.r % ow.n),
lf AS (SELECT segment_id, parent_id FROM no WHERE segment_id NOT IN (SELECT segment_id FROM f1)),
le AS (SELECT segment_id, parent_id, row_number() OVER (ORDER BY {_md5(25, 'segment_id')}, segment_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT * FROM lf UNION ALL SELECT segment_id, parent_id FROM no WHERE NOT EXISTS (SELECT 1 FROM lf))),
an AS (SELECT file_id, row_number() OVER (ORDER BY {_md5(26, 'file_id')}, file_id) - 1 AS r FROM ro WHERE parent_id IS NULL),
f2 AS (SELECT file_id, 'any_parent' AS strategy, le.segment_id, le.parent_id FROM an JOIN le ON le.r = an.r % le.n),
ne AS (SELECT le.segment_id, le.parent_id FROM (SELECT unnest(range(0, (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM cl))) + (SELECT count(*) FROM an) AS r) w JOIN le ON le.r = w.r % le.n),
po AS (SELECT f.*, {-5.0} + {_part(27, 'f.file_id')} * 20.0 AS snr, cl.x AS c, no.x AS z FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) f JOIN cl USING (file_id) JOIN no USING (segment_id)),
pu AS (SELECT file_id, strategy, segment_id, parent_id, snr, unnest(c) AS c, unnest(z) AS z FROM po),
pk AS (SELECT file_id, sqrt(avg(c * c)) / sqrt(avg(z * z)) / pow(10, any_value(snr) / 20) AS k FROM pu GROUP BY file_id),
ml AS (SELECT pu.file_id, any_value(strategy) AS strategy, any_value(segment_id) AS segment_id, any_value(parent_id) AS parent_id, any_value(snr) AS snr, sqrt(avg(pow(greatest(-1, least(1, c + k * z)), 2))) AS rms FROM pu JOIN pk USING (file_id) GROUP BY pu.file_id),
nl AS (SELECT segment_id, any_value(parent_id) AS parent_id, count(*) AS copies, any_value(rms) AS rms FROM ne JOIN (SELECT id AS segment_id, sqrt(avg(v * v)) AS rms FROM (SELECT id, unnest(x) AS v FROM waves) GROUP BY id) USING (segment_id) GROUP BY segment_id),
rw AS (SELECT printf('%d_noise%d_%d_snr%.1f', file_id, parent_id, segment_id, snr) AS file_id, 1 AS label, strategy, parent_id, snr, rms FROM ml UNION ALL SELECT printf('neg_%d_%d', parent_id, segment_id), 0, NULL, parent_id, NULL, rms FROM nl, range(0, copies)),
sp AS (SELECT label, file_id, row_number() OVER (ORDER BY {_md5(28, "file_id || ':' || label")}, file_id, label) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT label, file_id FROM rw)),
ts AS (SELECT rw.*, CASE WHEN r < floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM rw JOIN sp USING (label, file_id))"""


PLANS = {
    "wave_windows": (wave_windows, WINDOWS_SQL),
    "wave_abnormal": (wave_abnormal, f"WITH {LEVELS} SELECT w.id, CASE WHEN peak > 3.0 THEN 'range' WHEN rms > 0.6 OR peak > 2.0 THEN 'level' END AS reason, CAST(len(list_filter(x, lambda v: abs(v) > 1.0)) AS BIGINT) AS n_outliers FROM waves w JOIN lv USING (id)"),
    "level_summary": (level_summary, LEVEL_SQL),
    "sample_stats": (sample_stats, f"WITH {SAMPLES} SELECT count(*) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median FROM samples"),
    "training_set": (training_set, f"WITH {TRAINING} SELECT file_id, label, split, strategy, CAST(parent_id AS BIGINT) AS noise_parent, round(snr, 6) AS snr_db, round(rms, 6) AS rms FROM ts"),
    "training_set_short": (training_set_short, f"WITH {TRAINING.replace('id % 3 <> 0', SHORT)} SELECT file_id, label, split, strategy, CAST(parent_id AS BIGINT) AS noise_parent, round(snr, 6) AS snr_db, round(rms, 6) AS rms FROM ts"),
    "training_stats": (training_stats, f"WITH {TRAINING} SELECT split, label, strategy, count(*) AS n, count(DISTINCT parent_id) AS n_parents, round(avg(snr), 6) AS mean_snr_db FROM ts GROUP BY ALL"),
    "training_checks": (training_checks, f"""WITH {TRAINING}, o AS (SELECT count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'val') AS va, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM ts)
 SELECT 'splits' AS "check", tr >= 1 AND va >= 1 AS ok, printf('train=%d val=%d', tr, va) AS detail FROM o UNION ALL SELECT 'labels', p > 0 AND n > 0, printf('pos=%d neg=%d', p, n) FROM o UNION ALL
 SELECT 'balance', greatest(p, n) <= 3 * least(p, n), printf('pos=%d neg=%d', p, n) FROM o UNION ALL SELECT 'length', true, 'odd=0' UNION ALL SELECT 'values', true, 'wild=0' UNION ALL
 SELECT 'leakage', count(*) = 0, printf('leaks=%d', count(*)) FROM (SELECT file_id FROM ts GROUP BY file_id HAVING count(DISTINCT split) > 1)"""),
    "wave_transient": (wave_transient, TRANSIENT_SQL),
    "wave_filter": (wave_filter, filter_sql()),
    "wave_filter_pieces": (wave_filter_pieces, filter_pieces_sql()),
    "recording_ranges": (recording_ranges, RANGES_SQL),
    "network_training": (network_training, None),
    "wave_augment": (wave_augment, augment_sql()),
    "wave_model_scores": (wave_model_scores, model_sql()),
    "wave_flux": (wave_flux, FLUX_SQL),
    "wave_levels": (wave_levels, f"WITH {LEVELS} SELECT id, round(rms, 6) AS rms, round(peak, 6) AS peak, round(20 * log10(peak / rms), 6) AS crest_db, pk AS peak_at FROM lv"),
    "wave_zcr": (wave_zcr, f"WITH {SAMPLES} SELECT id, round(sum(abs(sign(v) - sign(p))) / 2 / 64, 6) AS zcr FROM (SELECT id, v, lag(v) OVER (PARTITION BY id ORDER BY i) AS p FROM samples) GROUP BY id"),
    "wave_energy": (wave_energy, ENERGY_SQL),
    "wave_clipping": (wave_clipping, f"WITH {SAMPLES} SELECT id, count(*) FILTER (abs(v) >= 0.5) AS n_clipped FROM samples GROUP BY id"),
    "wave_normalize_rms": (wave_normalize_rms, f"WITH {LEVELS} SELECT id, i, round(v / rms, 6) AS v FROM samples JOIN lv USING (id)"),
    "wave_normalize_peak": (wave_normalize_peak, f"WITH {LEVELS} SELECT id, i, round(v / peak, 6) AS v FROM samples JOIN lv USING (id)"),
    "wave_normalize_mad": (wave_normalize_mad, MAD_SQL),
    "wave_tkeo": (wave_tkeo, f"WITH {SAMPLES}, nb AS (SELECT id, i, v, lag(v) OVER w AS p, lead(v) OVER w AS n FROM samples WINDOW w AS (PARTITION BY id ORDER BY i)) SELECT id, i - 1 AS i, round(v * v - p * n, 6) AS v FROM nb WHERE p IS NOT NULL AND n IS NOT NULL"),
    "wave_pre_emphasis": (wave_pre_emphasis, f"WITH {SAMPLES} SELECT id, i, round(v - 0.97 * coalesce(lag(v) OVER (PARTITION BY id ORDER BY i), 0), 6) AS v FROM samples"),
    "wave_pad_reflect": (wave_pad_reflect, f"WITH {WAVES}, g AS (SELECT id, x, unnest(range(0, 100)) AS i FROM waves), j AS (SELECT id, x, i, abs(i - 18) AS a FROM g) SELECT id, i, round(x[CASE WHEN a > 63 THEN 126 - a ELSE a END + 1], 6) AS v FROM j"),
    "wave_pad_edges": (wave_pad_edges, f"WITH {SAMPLES} SELECT id, round(sum(v), 6) AS zero_sum, round(sum(v) + 18 * sum(v) FILTER (i = 0) + 18 * sum(v) FILTER (i = 63), 6) AS edge_sum, round(sum(v) FILTER (i < 40), 6) AS head_sum FROM samples GROUP BY id"),
    "wave_frames_ste": (wave_frames_ste, f"WITH {SAMPLES}, f AS (SELECT unnest(range(0, 13)) AS frame) SELECT id, frame, round(avg(v * v), 6) AS ste FROM samples JOIN f ON i >= frame * 4 AND i < frame * 4 + 16 GROUP BY id, frame"),
    "wave_spectra": (wave_spectra, SPECTRA_SQL),
    "wave_quality": (wave_quality, QUALITY_SQL),
    "snr_mix": (snr_mix, f"WITH {WAVES}{MIX} SELECT id, any_value(noise_id) AS noise_id, round(any_value(snr), 6) AS snr_db, round(sqrt(avg(m * m)), 6) AS rms, count(*) FILTER (abs(m) >= 1.0) AS n_clipped FROM mx GROUP BY id"),
    "snr_verify": (snr_verify, f"WITH {WAVES}{MIX} SELECT id, round(10 * log10(avg(c * c) / avg((m - c) * (m - c))), 6) AS realised_db FROM mx GROUP BY id"),
    "wave_describe": (wave_describe, f"WITH {LEVELS}, a AS (SELECT label, avg(v) AS mean, stddev_pop(v) AS std FROM samples GROUP BY label), b AS (SELECT label, count(*) AS n_waves, max(peak) AS max_peak, avg(rms) AS mean_rms FROM lv GROUP BY label) SELECT CAST(label AS BIGINT) AS label, n_waves, round(mean, 6) AS mean, round(std, 6) AS std, round(max_peak, 6) AS max_peak, round(mean_rms, 6) AS mean_rms FROM a JOIN b USING (label)"),
}
