"""Recordings by byte range, and filters over pieces of a recording."""

import io
import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringStartsWith

from echoframe.functions import kernels
from echoframe.operators import filtering
from echoframe.sources import audio, ranges

RATE = 8000


def wav(x, rate=RATE, width=2):
    """WAV data of whole numbers, one column per channel."""
    x = np.atleast_2d(x.T).T
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        v = np.round(x * ((1 << (8 * width - 1)) - 1)).astype(np.int64)
        raw = (v + 128).astype(np.uint8).tobytes() if width == 1 else v.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes() if width == 3 else v.astype(f"<i{width}").tobytes()
        w.writeframes(raw)
    return out.getvalue()


def float_wav(x, rate, bits=32, extensible=False):
    body = x.astype(f"<f{bits // 8}").tobytes()
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else 3, 1, rate, rate * bits // 8, bits // 8, bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, bits, 0, 3) + b"\x00" * 14
    junk = b"LIST" + struct.pack("<I", 601) + b"x" * 602  # of odd length, and beyond what is read at once
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + junk + b"data" + struct.pack("<I", len(body)) + body


def rf64(x, rate=RATE):
    body = np.round(x * 32767).astype("<i2").tobytes()
    ds = struct.pack("<QQQI", len(body) + 72, len(body), len(x), 0)
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    return b"RF64" + b"\xff" * 4 + b"WAVE" + b"ds64" + struct.pack("<I", len(ds)) + ds + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + b"\xff" * 4 + body


def npy(x):
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("recordings")
    rng = np.random.default_rng(1)
    noise = lambda n, c=1: rng.uniform(-0.9, 0.9, (n, c) if c > 1 else n)
    (at / "deep").mkdir()
    files = {
        "long.wav": wav(noise(RATE * 60)),
        "stereo.wav": wav(noise(RATE * 3 + 17, 2)),
        "deep/eight.wav": wav(noise(RATE), width=1),
        "wide.wav": wav(noise(RATE + 1), width=3),
        "full.wav": wav(noise(RATE * 2), width=4),
        "float.wav": float_wav(noise(20000), 44100),
        "double.wav": float_wav(noise(9000), 44100, 64, True),
        "huge.wav": rf64(noise(5000)),
        "a.npy": npy(noise(200_000)),
        "pair.npy": npy(noise(3000, 2).astype(np.float32)),
        "empty.wav": wav(np.empty(0)),
        "broken.wav": b"RIFF\x00\x00\x00\x00WAVEfmt ",
        "text.wav": b"no recording",
        "_hidden.wav": wav(noise(10)),
    }
    for name, data in files.items():
        (at / name).write_bytes(data)
    return str(at)


def by_chunk(df):
    return {(r.source_file, r.chunk_id): (r.file_id, r.start_sample, r.sample_rate, np.array(r.samples)) for r in df.collect()}


@pytest.mark.parametrize("mono,which,chunk_s,overlap_s", [("mean", 0, 1.0, 0.25), ("channel", 1, 60.0, 0.5), ("channel", 0, 0.4, 0.0)])
def test_chunks_equal_those_of_whole_files(spark, folder, mono, which, chunk_s, overlap_s):
    options = dict(chunk_s=chunk_s, overlap_s=overlap_s, mono=mono, which=which)
    got = by_chunk(ranges.chunks(spark, [folder], "*.[wn][ap][vy]", split_bytes=100_000, **options))
    want = by_chunk(audio.chunks(audio.files(spark, [folder], "*.{wav,npy}"), **options))
    own = {k for k in got if k[0].endswith("huge.wav")}  # that only the new source reads
    assert set(got) - own == set(want) and own
    for k, v in want.items():
        assert got[k][:3] == v[:3] and np.array_equal(got[k][3], v[3]), k


def test_stores_that_only_spark_opens_are_read_whole(spark, folder, monkeypatch):
    want = by_chunk(ranges.chunks(spark, [folder], "f*.wav", chunk_s=0.5, overlap_s=0.1))

    def unknown(path):
        raise ValueError("unrecognised scheme")

    monkeypatch.setattr(ranges, "located", unknown)
    got = by_chunk(ranges.chunks(spark, [folder], "f*.wav", chunk_s=0.5, overlap_s=0.1, split_bytes=1000))
    assert set(got) == set(want) and all(np.array_equal(got[k][3], v[3]) for k, v in want.items()) and want


def test_a_file_beyond_four_gigabytes_is_told_by_its_long_header(folder):
    with ranges.Bytes(f"{folder}/huge.wav") as f:
        at = ranges.layout(f)
        assert (at.frames, at.rate, at.dtype) == (5000, RATE, "<i2") and f.count <= ranges.HEAD


def test_a_long_file_is_many_tasks_and_filters_read_few_bytes(spark, folder):
    make = lambda: ranges.Reader({"path": f"{folder}/long.wav", "chunk_s": "1", "overlap_s": "0", "split_bytes": str(RATE * 2 * 5)})
    whole = make()
    splits = whole.partitions()
    assert len(splits) == 12 and all(len(s.parts[0][1]) == 5 for s in splits)
    assert sum(b.num_rows for s in splits for b in whole.read(s)) == 60 and whole.count < RATE * 2 * 60 + 14 * ranges.HEAD
    some = make()
    assert list(some.pushFilters([GreaterThan(("end_s",), 20.5), LessThan(("start_s",), 21.5)])) == []
    rows = [b.to_pylist()[0] for s in some.partitions() for b in some.read(s)]
    assert [r["chunk_id"] for r in rows] == [20, 21] and some.count < RATE * 2 * 2 + 3 * ranges.HEAD  # two seconds of sixty
    none = make()
    list(none.pushFilters([StringStartsWith(("source_file",), "file:/elsewhere/")]))
    assert [s.parts for s in none.partitions()] == [[]] and none.count == 0
    odd = EqualTo(("sample_rate",), RATE)
    assert list(make().pushFilters([odd, In(("chunk_id",), (1, 2))])) == [odd]  # is left to Spark
    df = ranges.scan(spark, [folder], "long.wav", chunk_s=1, overlap_s=0, split_bytes=RATE * 10)
    assert df.rdd.getNumPartitions() == 12
    near = df.where("start_s >= 30 and start_s < 32.5 and sample_rate = 8000 and file_id = 'long'")
    assert near.rdd.getNumPartitions() == 1 and sorted(r.chunk_id for r in near.select("chunk_id").collect()) == [30, 31, 32]
    assert df.where("chunk_id = 7 or start_s > 58.5").count() == 2 and df.count() == 60  # not the filters of a query before
    assert df.where("chunk_id = 3").union(df.where("chunk_id = 4")).count() == 2 and df.count() == 60


def test_unreadable_files_are_rows(spark, folder):
    df = ranges.scan(spark, [folder], samples=False)
    wrong = {os.path.basename(r.source_file): r.error for r in df.where("error is not null").collect()}
    assert set(wrong) == {"broken.wav", "text.wav"} and all(x.startswith(("ValueError", "error")) for x in wrong.values())
    assert df.where("error is null and samples is not null").count() == 0 and df.where("source_file like '%empty.wav'").count() == 0
    heads = {os.path.basename(r.source_file): r for r in ranges.headers(audio.files(spark, [folder])).collect()}
    assert heads["stereo.wav"].frames == RATE * 3 + 17 and heads["stereo.wav"].channels == 2 and heads["text.wav"].error
    assert spark.sql("select 1").count() == 1 and ranges.chunks(spark, [folder], "*.none").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        ranges.chunks(spark, [folder + "/nowhere"]).count()


# Filters over pieces


def test_states_are_carried_over_pieces():
    rng = np.random.default_rng(2)
    sos = kernels.butterworth(4, (300.0, 3000.0), RATE, "bandpass")
    x = rng.normal(size=5000)
    want, y, s = kernels.filtered(sos, x), [], None
    for a, b in zip([0, 1, 700, 1211, 1212, 4000], [1, 700, 1211, 1212, 4000, 5000]):
        part, s = kernels.carried(sos, x[a:b], s)
        y.append(part)
    assert np.allclose(np.concatenate(y), want, atol=1e-12)
    _, at = kernels.carried(sos, x)
    assert np.allclose(kernels.carried(sos, np.zeros(333), at)[1], filtering.moved(sos, at, 333), atol=1e-12)


def test_parts_of_a_resampled_signal():
    x = np.random.default_rng(3).normal(size=4000)
    for a, b in ((48000, 44100), (44100, 48000), (96000, 8000), (8000, 44100)):
        want = kernels.resampled(x, a, b)
        part = lambda lo, hi: np.array([x[i] if 0 <= i < len(x) else 0.0 for i in range(lo, hi)])
        for lo, hi in ((0, 5), (len(want) // 2, len(want) // 2 + 50), (len(want) - 3, len(want)), (7, 7)):
            assert np.allclose(kernels.resampled_part(part, a, b, lo, hi), want[lo:hi], atol=1e-12)


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_filtering_of_pieces_is_that_of_the_whole(spark, fan, monkeypatch):
    monkeypatch.setattr(filtering.entering, "__defaults__", (fan,))
    rng = np.random.default_rng(4)
    sos = kernels.butterworth(4, 200.0, RATE, "highpass")
    whole = {r: rng.normal(size=n) for r, n in ((1, 1200), (2, 60), (None, 777), (4, 1))}
    rows, cutters = [], {1: [0, 100, 150, 400, 401, 800, 1100], 2: [0], None: [0, 200, 500], 4: [0]}
    for r, x in whole.items():
        for k, (a, b) in enumerate(zip(cutters[r], [*cutters[r][1:], len(x)])):
            rows.append((r or 0, k, [float(v) for v in x[a:b]]))
    df = spark.createDataFrame(rows, "rec long, k long, x array<double>").withColumns({"n": F.lit("clash"), "states": F.lit(1)})
    for name, made, want in (("filtered", filtering.filtered, kernels.filtered), ("zero_phase", filtering.zero_phase, kernels.zero_phase)):
        if fan == 3 and name == "zero_phase":
            continue
        out = made(df.drop("states"), ["rec"], "x", sos)
        assert out.columns == ["rec", "k", "x", "n"] and out.count() == len(rows)
        got = {}
        for r in sorted(out.collect(), key=lambda r: (r.rec, r.k)):
            got.setdefault(r.rec, []).extend(r.x)
        for r, x in whole.items():
            assert np.allclose(got[r or 0], want(sos, x), atol=1e-9), (name, r)
    assert filtering.filtered(df.drop("states").limit(0), ["rec"], "x", sos).count() == 0


def test_a_piece_shorter_than_the_extension_is_an_error(spark):
    sos = kernels.butterworth(4, 200.0, RATE, "highpass")
    df = spark.createDataFrame([(1, 0, [1.0] * 5), (1, 1, [2.0] * 50)], "rec long, k long, x array<double>")
    with pytest.raises(Exception, match="shorter than the filter's extension"):
        filtering.zero_phase(df, ["rec"], "x", sos).collect()


@pytest.mark.parametrize("rate,cutoff", [(None, 500.0), (6000, None), (6000, 500.0), (44100, 1000.0)])
def test_preprocessed_chunks_equal_whole_files(spark, folder, rate, cutoff):
    found = audio.files(spark, [folder], "{stereo,float,wide,long,text,empty}.wav")
    options = dict(chunk_s=0.7, overlap_s=0.2, rate=rate, cutoff=cutoff)
    got = by_chunk(filtering.preprocessed_chunks(found, split_bytes=50_000, **options))
    want = by_chunk(audio.chunks(found, **options))
    assert set(got) == set(want) and want
    for k, v in want.items():
        assert got[k][:3] == v[:3] and np.allclose(got[k][3], v[3], atol=1e-6), k  # both are rounded to 32 bits
