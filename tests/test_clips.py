"""The sink of clips: whole files, each once, or none."""

import io
import os
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echoframe.sources import audio, clips, sinks


def batch(names, rate=8000):
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array([rate] * len(names), pa.int32()), pa.array([[0.5, -0.5]] * len(names), pa.list_(pa.float64()))], ["name", "rate", "samples"])


def failing():
    yield batch(["a.wav", "b.wav"])
    raise OSError("lost")


def test_a_task_that_fails_and_runs_again_leaves_each_clip_once(tmp_path):
    w = clips.Writer(str(tmp_path))
    with pytest.raises(OSError):
        w.write(failing())
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".wav")]  # only staged
    done = [w.write(iter([batch(["a.wav", "b.wav"]), batch(["c.wav"])])), w.write(iter([])), None]
    w.commit(done)
    assert sorted(os.listdir(tmp_path)) == ["a.wav", "b.wav", "c.wav"]
    assert audio.decode((tmp_path / "c.wav").read_bytes())[1] == 8000


def test_an_abort_leaves_nothing(tmp_path, spark):
    w = clips.Writer(str(tmp_path / "x"))
    w.abort([w.write(iter([batch(["a.wav"])])), None])
    assert os.listdir(tmp_path / "x") == []
    df = spark.range(40).select(F.format_string("c%d.wav", "id").alias("name"), F.when(F.col("id") == 37, F.raise_error(F.lit("no signal")).cast("array<double>")).otherwise(F.array(F.lit(0.1))).alias("samples"))
    with pytest.raises(Exception, match="no signal"):
        sinks.write_clips(df.repartition(4), str(tmp_path / "y"), 8000)
    assert not [f for f in os.listdir(tmp_path / "y") if f.endswith(".wav")] if (tmp_path / "y").exists() else True
    for name in ("", "a/b.wav", None):
        with pytest.raises(ValueError, match="no name"):
            w.write(iter([batch([name])]))


def test_clips_at_their_own_rates(tmp_path, spark):
    df = spark.createDataFrame([("a.wav", 8000, [0.25, -1.5, 1.0]), ("b.wav", 44100, []), ("c.wav", 96000, None)], "name string, rate int, samples array<float>").withColumn("folder", F.lit("x"))
    sinks.write_clips(df, str(tmp_path / "z"))
    sinks.write_clips(df.where("name = 'a.wav'"), str(tmp_path / "z"), 16000)  # put in place of the one before
    got = {}
    for name in os.listdir(tmp_path / "z"):
        with wave.open(io.BytesIO((tmp_path / "z" / name).read_bytes())) as w:
            got[name] = (w.getframerate(), w.getnframes())
    assert got == {"a.wav": (16000, 3), "b.wav": (44100, 0), "c.wav": (96000, 0)}
    assert np.allclose(audio.decode((tmp_path / "z" / "a.wav").read_bytes())[0], [0.25, -1, 1], atol=1e-4)
