import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from echoframe.functions import kernels
from echoframe.operators import augment, datasets, detect, model
from echoframe.params import Detection
from echoframe.sources import audio, labels, sinks

RATE = 44100


def click_track(seconds, times, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.002, int(seconds * RATE))
    n = int(0.002 * RATE)
    t = np.arange(n) / RATE
    burst = np.sin(2 * np.pi * 14000 * t) * np.exp(-t / 0.0003) * 0.8
    for at in times:
        i = int(at * RATE)
        x[i : i + n] += burst
    return x


def test_kernels_have_closed_forms():
    n = np.arange(4096)
    w, a = 0.3, 0.7
    sine = a * np.sin(w * n)
    f = kernels.frame_features(sine, RATE, window_ms=1000 * 44.5 / RATE, step_ms=1000 * 11.5 / RATE)
    assert np.allclose(f["tkeo"], a * a * math.sin(w) ** 2)
    assert np.allclose(kernels.envelope(np.sin(2 * np.pi * 8 * n / 4096)), 1.0)
    assert kernels.width_ms(np.zeros(10), 3, RATE) == 0.0 and kernels.transient(np.zeros(5), 2, RATE) == (0.0,) * 6
    assert np.all(kernels.robust_z(np.ones(9)) == 0)


@pytest.mark.parametrize("kind,cutoff", [("highpass", 5000.0), ("lowpass", 5000.0), ("bandpass", (3000.0, 9000.0))])
@pytest.mark.parametrize("order", [3, 4])
def test_butterworth_is_3db_down_at_its_cutoff(kind, cutoff, order):
    sos = kernels.butterworth(order, cutoff, RATE, kind)
    for f in np.atleast_1d(cutoff):
        e = np.exp(-2j * np.pi * f / RATE * np.arange(3))
        assert abs(abs(np.prod((sos[:, :3] @ e) / (sos[:, 3:] @ e))) - math.sqrt(0.5)) < 1e-6
    x = np.random.default_rng(1).normal(size=1500)
    y = x
    for b0, b1, b2, _, a1, a2 in sos:
        out, x1, x2, y1, y2 = [], 0, 0, 0, 0
        for v in y:
            o = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, v, y1, o
            out.append(o)
        y = np.array(out)
    assert np.allclose(kernels.filtered(sos, x), y, atol=1e-8)


def test_resampling_keeps_a_tone():
    t = np.arange(48000) / 48000
    y = kernels.resampled(np.sin(2 * np.pi * 1000 * t), 48000, 44100)
    want = np.sin(2 * np.pi * 1000 * np.arange(len(y)) / 44100)
    assert len(y) == 44100 and np.abs(y - want)[500:-500].max() < 1e-3


def test_detection_finds_every_click_once(spark, tmp_path):
    times = [0.5, 0.53, 0.56, 1.2, 2.95, 4.4]  # 2.95 lies where two chunks overlap
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(audio.encode(click_track(6, times), RATE))
    (tmp_path / "in" / "broken.wav").write_bytes(b"RIFF....")
    found = audio.files(spark, [str(tmp_path / "in")])
    rec = {r.filename: r for r in audio.recordings(found).collect()}
    assert rec["a.wav"].frames == 6 * RATE and rec["a.wav"].error is None and rec["broken.wav"].error
    p = Detection(transient_filter=False, width_ms=(0.0, 5.0), tkeo_z=20.0)
    cut = audio.chunks(found, 3.0, 0.2)
    got = detect.candidates(cut, p)
    at = sorted(r.peak_time for r in got.collect())
    assert len(at) == len(times) and all(abs(a - b) < 0.004 for a, b in zip(at, times))
    e = detect.events(got).collect()
    assert all(0 <= r.quality_score <= 1 and r.peak_amplitude > 0.3 for r in e)
    assert detect.frame_table(cut, p).count() > 1000
    clips = detect.segments(got, 100).withColumn("name", sinks.clip_name(detect.F.lit(1), detect.F.col("peak_time")))
    sinks.write_clips(clips, str(tmp_path / "clips"), RATE)
    assert len(list((tmp_path / "clips").iterdir())) == len(times)
    assert audio.noise_segments(cut, 0.5).count() > 0


def test_model_scores_and_augmentation_are_seeded(spark):
    df = spark.createDataFrame([(i, [float(math.sin(i * j)) for j in range(64)]) for i in range(5)], "id int, x array<double>")
    one = df.select("id", augment.augmented(df.x, df.id, 4).alias("y")).collect()
    two = df.repartition(3).select("id", augment.augmented(df.x, df.id, 4).alias("y")).orderBy("id").collect()
    assert one == two and all(len(r.y) == 64 for r in one)
    t = df.select("id", augment.click_trains(df.x, df.x, df.id, 4, length=9000).alias("y"), augment.click_starts(F.size("x"), df.id, 4, length=9000).alias("at")).collect()
    assert any(r.y for r in t)
    for r in t:
        assert (r.y is None) == (r.at is None)
        if r.y:
            gaps = np.diff(r.at) / 44.1
            assert len(r.y) == 9000 and 2 <= len(r.at) <= 5 and r.at[-1] + 64 <= 9000 and (gaps > 7.9).all() and (gaps < 80.1).all() and max(map(abs, r.y)) <= 0.95 + 1e-9


def plain_forward(w, shape, x):
    """The network by loops over samples."""

    def conv(name, x, step, dilation):
        k = w[f"{name}.w"]
        pad = (k.shape[2] - 1) * dilation // 2
        out = np.zeros((len(k), -(-x.shape[1] // step)))
        for o in range(len(k)):
            for t in range(out.shape[1]):
                for j in range(k.shape[2]):
                    p = t * step + j * dilation - pad
                    if 0 <= p < x.shape[1]:
                        out[o, t] += (k[o, :, j] * x[:, p]).sum()
        return out * w[f"{name}.scale"][:, None] + w[f"{name}.shift"][:, None]

    h = np.maximum(conv("stem", np.asarray(x)[None], 2, 1), 0)
    for b, (_, step, dilation) in enumerate(shape.blocks):
        y = conv(f"b{b}.2", np.maximum(conv(f"b{b}.1", h, step, dilation), 0), 1, dilation)
        h = np.maximum(y + (conv(f"b{b}.skip", h, step, 1) if f"b{b}.skip.w" in w else h), 0)
    v = h.mean(axis=1)
    if shape.hidden:
        v = np.maximum(w["hidden.w"] @ v + w["hidden.b"], 0)
    z = w["out.w"] @ v + w["out.b"]
    return 1 / (1 + math.exp(z[0] - z[1]))


@pytest.mark.parametrize("shape", [model.Shape(4, ((6, 2, 1), (6, 1, 2)), length=80), model.Shape(3, ((3, 1, 1), (5, 2, 4)), 7, length=81)])
def test_scores_depend_on_the_signal_alone(spark, shape, tmp_path):
    w = model.initial(shape, 3)
    w = model.folded(w, "stem", np.full(shape.base, 0.1), np.full(shape.base, 1.2), np.full(shape.base, 0.05), np.full(shape.base, 0.02), np.full(shape.base, 0.9))
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate([shape.length] * 5 + [10, 40, 200, 0])] + [(9, None)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    model.save(w, str(tmp_path / "w.npz"))
    got = {r.id: r.s for r in df.repartition(3).select("id", model.score(model.load(str(tmp_path / "w.npz")), df.x, shape).alias("s")).collect()}
    alone = {i: df.where(f"id = {i}").select(model.score(w, df.x, shape).alias("s")).first().s for i in (0, 6)}
    for i, x in rows:
        x = (x or [])[: shape.length]
        left = (shape.length - len(x)) // 2
        whole = np.concatenate([np.zeros(left), x, np.zeros(shape.length - len(x) - left)])
        assert abs(got[i] - plain_forward(w, shape, whole)) < 1e-5 and (i not in alone or abs(alone[i] - got[i]) < 1e-9)


def test_published_sizes():
    n = lambda shape, *other: model.n_parameters(model.initial(shape, 0)) + sum(other)
    # scale and shift stand for a bias and four numbers of a normalisation
    assert n(model.Shape()) > 100_000 and model.LARGE.hidden == 128 and n(model.LARGE) > n(model.Shape())


def test_a_head_is_fitted(spark):
    shape = model.Shape(6, ((8, 2, 1),), length=64)
    rng = np.random.default_rng(5)
    t = np.arange(64)
    rows = [(i % 2, (np.sin(t * (0.4 if i % 2 else 2.2) + rng.uniform(0, 6)) + rng.normal(0, 0.3, 64)).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "label int, x array<double>")
    w = model.train_head(df.limit(160), "x", "label", model.initial(shape, 2), shape)
    got = df.select("label", model.score(w, df.x, shape).alias("s")).collect()
    assert sum((r.s >= 0.5) == (r.label == 1) for r in got) > 0.9 * len(got)
    features = df.select("label", df.x[3].alias("a"), df.x[7].alias("b"))
    assert model.apply_linear(model.train_linear(features, ["a", "b"], "label"), features).where("score between 0 and 1").count() == 240


def test_labels(spark, tmp_path):
    lines = spark.createDataFrame([("1\t2\tdolphin",), ("# c",), ("",), ("3\t4",), ("x\ty",), ("5",)], "value string")
    assert [tuple(r) for r in labels.parsed_labels(lines).collect()] == [(1.0, 2.0, "dolphin"), (3.0, 4.0, "segment")]
    (tmp_path / "l.json").write_text('{"a.wav": {"category": "c1", "choice": "y", "timestamp": "t"}, "b.wav": {"category": "c1", "choice": "n", "timestamp": "t"}}')
    got = labels.category_report(labels.read_label_json(spark, str(tmp_path / "l.json"))).collect()
    assert [(r.category, r.n, r.percent) for r in got] == [("c1", 2, 100.0)]


def test_labelled_segments_are_cut_and_scaled(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(audio.encode(click_track(4, [1.0, 3.2]), RATE))
    cut = audio.chunks(audio.files(spark, [str(tmp_path)]), 2.0, 0.5)
    marks = spark.createDataFrame([("x", 0.9, 1.1, "a"), ("x", 3.0, 3.4, "b"), ("x", 9.0, 9.5, "late"), ("x", 2.0, 2.0, "empty")], "stem string, start double, end double, label string")
    got = {r.label: r for r in labels.labelled_segments(cut, marks).collect()}
    assert set(got) == {"a", "b"} and all(abs(max(map(abs, r.samples)) - 0.95) < 1e-6 for r in got.values()) and len(got["a"].samples) == int(1.1 * RATE) - int(0.9 * RATE)
    hz, at, db = kernels.spectrum_db(np.sin(2 * np.pi * 5000 * np.arange(4096) / RATE), RATE)
    assert abs(hz[db.mean(axis=0).argmax()] - 5000) < RATE / 512 and len(at) == len(db)


def test_labelled_segments_go_through_chunks(spark, tmp_path):
    (tmp_path / "audio").mkdir()
    (tmp_path / "marks").mkdir()
    x = click_track(7, [1.0, 3.2, 6.5])
    (tmp_path / "audio" / "x.wav").write_bytes(audio.encode(x, RATE))
    np.save(tmp_path / "audio" / "x.npy", np.zeros(96000 * 9))
    (tmp_path / "marks" / "x_labels.txt").write_text("1.9\t2.1\tedge\n0.5\t6.75\tlong\n-1\t0.4\tearly\n6.0\t9.0\tend\n8.0\t8.5\tlate\n")
    cut = audio.chunks(audio.files(spark, [str(tmp_path / "audio")], "*"), 2.0, 0.5)
    got = {r.label: r for r in labels.labelled_segments(cut, labels.read_labels(spark, str(tmp_path / "marks"))).collect()}
    assert set(got) == {"edge", "long", "early", "end"} and all(r.source_file.endswith("x.wav") for r in got.values())
    x = audio.decode(audio.encode(x, RATE))[0]
    for name, lo, hi in (("edge", 1.9, 2.1), ("long", 0.5, 6.75), ("early", 0.0, 0.4), ("end", 6.0, 7.0)):
        want = x[int(lo * RATE) : int(hi * RATE)]
        assert len(got[name].samples) == len(want) and np.allclose(got[name].samples, want / np.abs(want).max() * 0.95, atol=1e-6), name


def test_negatives_use_no_noise_of_a_positive(spark):
    clean = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, part int")
    noise = spark.createDataFrame([(i, int(i >= 35)) for i in range(47)], "noise_id long, part int")
    used = {r.noise_id for r in datasets.paired(clean, noise, "id", "noise_id", 5, ["part"]).collect()}
    got = [(r.part, r.noise_id) for r in datasets.negatives(clean, noise, "noise_id", 5, ["part"], 1.5).collect()]
    assert len(used) == 20 and not used & {i for _, i in got} and len(set(got)) == len(got)
    assert sum(p == 0 for p, _ in got) == 15 and sum(p == 1 for p, _ in got) == 2  # 12 pieces, 10 of them used


def test_noise_crops_are_drawn_tiled_and_clipped(spark):
    waves = {1: [float(i) / 50 for i in range(90)], 2: [0.1, 0.2, 0.3], 3: [], 4: [0.5] * 10}
    df = spark.createDataFrame(list(waves.items()), "id long, noise array<double>")
    got = datasets.noise_crops(df, "id", "noise", 3, 6, 10).collect()
    assert sorted(r.id for r in got) == [1] * 6 + [2] * 6 + [4] * 6
    for r in got:
        x = np.resize(waves[r.id], max(10, len(waves[r.id])))
        assert r.noise == np.clip(x[r.start : r.start + 10], -1, 1).tolist()
    assert len({r.start for r in got if r.id == 1}) > 1
