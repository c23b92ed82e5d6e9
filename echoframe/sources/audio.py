"""Recordings: listing, headers, decoding into overlapping chunks, preprocessing. Files are read by Spark's binary source."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import kernels
from . import mat

NAME = r"([^/]+)$"
STEM = r"([^/]+?)(?:\.[^./]*)?$"


def files(spark: SparkSession, roots: list[str], pattern: str = "*.wav", distinct: bool = True) -> DataFrame:
    """path, length and content of all files under the roots; each path once if ``distinct``. Unused content isn't read."""
    out = None
    for r in roots:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(r)
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(["path"]) if distinct and len(roots) > 1 else out


def labelled_roles(paths: DataFrame, path: str = "path") -> DataFrame:
    """Adds, for files of labelled folders, whether their name tells a high signal-to-noise ratio (``snr``), their part in the
    data set (``role``: high ones train, others test) and where a copy would go (``dst_path``). Nothing is copied."""
    name = F.regexp_extract(path, NAME, 1)
    high = F.lower(name).contains("highsnr")
    role = F.when(high, "train").otherwise("test")
    return paths.withColumns({"snr": F.when(high, "high").otherwise("low"), "role": role, "dst_path": F.concat(role, F.lit("/"), name)})


def listing(found: DataFrame) -> DataFrame:
    return found.select(F.col("path").alias("filepath"), F.regexp_extract("path", NAME, 1).alias("filename"), F.col("length")).orderBy("filepath")


def supported(path, extensions: tuple[str, ...] = (".wav", ".npy")):
    """Files with a known ending, or with ``noise`` in the path, but no desktop files."""
    p = F.lower(path)
    known = F.lit(False)
    for e in extensions:
        known = known | p.endswith(e)
    return (known | p.contains("noise")) & ~path.endswith(".DS_Store")


def header(data: bytes) -> dict:
    with wave.open(io.BytesIO(data)) as w:
        n, rate = w.getnframes(), w.getframerate()
        return {"sample_rate": rate, "channels": w.getnchannels(), "duration": n / rate if rate else 0.0, "frames": n, "sample_width": w.getsampwidth(), "error": None}


def recordings(found: DataFrame) -> DataFrame:
    """One row per file with its header; a file that can't be read has an error and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schemas.RECORDINGS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.string()]
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    h = header(data.as_py())
                except Exception as e:  # any unreadable file becomes a row
                    h = {"error": f"{type(e).__name__}: {e}"}
                rows.append({"filepath": path, "filename": path.rsplit("/", 1)[-1], **h})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    return found.select("path", "content").mapInArrow(run, schemas.RECORDINGS)


#: Fixed value: the rate of recordings that come as plain arrays.
ARRAY_RATE = 96000


def float_wav(data: bytes) -> tuple[np.ndarray, int] | None:
    """Samples (one column per channel) and rate of WAV data with floating-point samples; None for any other."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, n, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            kind = struct.unpack_from("<H", data, at + 32)[0] if kind == 0xFFFE and size >= 40 else kind  # the extensible form names it further on
        elif name == b"data" and kind == 3 and bits in (32, 64):
            width = bits // 8 * n
            body = data[at + 8 : at + 8 + min(size, len(data) - at - 8) // width * width]
            return np.frombuffer(body, f"<f{bits // 8}").astype(np.float64).reshape(-1, n), rate
        at += 8 + size + size % 2
    return None


def decode(data: bytes, array_rate: int = ARRAY_RATE) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1] (one column per channel if several) and the rate of WAV data, whole numbers or floating-point, or of
    a MATLAB file's signal; NPY data has ``array_rate``."""
    if data[:6] == b"\x93NUMPY":
        return np.load(io.BytesIO(data), allow_pickle=False).astype(np.float64), array_rate
    if mat.is_mat(data[:8]):
        f = Memory(data)
        x, rate = mat.signal(f)
        m = x.values(f, 0, x.slow * x.fast).astype(np.float64).reshape(x.slow, x.fast)
        m = m.T if x.fast >= x.slow else m  # the longer side is time
        return (m if m.shape[1] > 1 else m[:, 0]), rate
    if found := float_wav(data):
        return (found[0] if found[0].shape[1] > 1 else found[0][:, 0]), found[1]
    with wave.open(io.BytesIO(data)) as w:
        raw, size, n, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if size == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif size == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608.0
    else:
        x = np.frombuffer(raw, f"<i{size}").astype(np.float64) / (1 << (8 * size - 1))
    return (x.reshape(-1, n) if n > 1 else x), rate


class Memory:
    """Data that is read by ranges."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + max(0, n)]


def encode(x: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def ranges(n: int, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    start, step = 0, max(1, chunk - overlap)
    while start < n:
        yield start, min(start + chunk, n)
        if start + chunk >= n:
            return
        start += step


def one_channel(x: np.ndarray, r: int, rate: int | None, mono: str, which: int, cutoff: float | None) -> tuple[np.ndarray, int]:
    x = kernels.channel(x, which) if mono == "channel" else x.mean(axis=1) if x.ndim > 1 else x
    if cutoff is not None:
        return kernels.preprocessed(x, r, rate or r, cutoff), rate or r
    return (kernels.resampled(x, r, rate), rate) if rate and rate != r else (x, r)


def undecodable(found: DataFrame, array_rate: int = ARRAY_RATE) -> DataFrame:
    """filepath and error of the files that :func:`chunks` and :func:`clips` leave out: the error log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    decode(data.as_py(), array_rate)
                except Exception as e:  # any unreadable file becomes a row
                    rows.append((path, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["filepath", "error"])

    return found.select("path", "content").mapInArrow(run, "filepath string, error string")


def clips(found: DataFrame, start_s: float = 0.0, duration_s: float | None = None, rate: int | None = None, normalize: bool = False, mono: str = "mean", which: int = 0, array_rate: int = ARRAY_RATE) -> DataFrame:
    """source_file, file_id, sample_rate and samples: of each file, the part from ``start_s`` on, ``duration_s`` long (to the
    end without), resampled, with an RMS of 1 if ``normalize``. A part beyond the file's end is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    x, r = decode(data.as_py(), array_rate)
                except Exception:
                    continue
                x = x[int(start_s * r) :] if duration_s is None else x[int(start_s * r) : int(start_s * r) + int(duration_s * r)]
                x, r = one_channel(x, r, rate, mono, which, None)
                level = float(np.sqrt((x * x).mean())) if len(x) else 0.0
                x = x / level if normalize and level > 0 else x
                stem = path.rsplit("/", 1)[-1].rpartition(".")[0] or path.rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([stem]), pa.array([r], pa.int32()), pa.array([x.astype(np.float32)], pa.list_(pa.float32()))], ["source_file", "file_id", "sample_rate", "samples"])

    return found.select("path", "content").mapInArrow(run, "source_file string, file_id string, sample_rate int, samples array<float>")


def preprocessed_rows(found: DataFrame, rate: int = 44100, cutoff: float = 1000.0, which: int = 10, array_rate: int = ARRAY_RATE) -> DataFrame:
    """name and samples of each file after resampling and high-pass: one row a recording, or one for each row of a
    two-dimensional array file, numbered behind the stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                raw = data.as_py()
                try:
                    x, r = decode(raw, array_rate)
                except Exception:
                    continue
                stem = path.rsplit("/", 1)[-1].rpartition(".")[0]
                many = raw[:6] == b"\x93NUMPY" and x.ndim == 2
                for i, row in enumerate(x if many else [kernels.channel(x, which)]):
                    y = kernels.preprocessed(row, r, rate, cutoff)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f"{stem}_{i:05d}.wav" if many else f"{stem}.wav"]), pa.array([y], pa.list_(pa.float32()))], ["source_file", "name", "samples"])

    return found.select("path", "content").mapInArrow(run, "source_file string, name string, samples array<float>")


def chunks(found: DataFrame, chunk_s: float = 60.0, overlap_s: float = 0.5, rate: int | None = None, mono: str = "mean", which: int = 0, cutoff: float | None = None, array_rate: int = ARRAY_RATE) -> DataFrame:
    """Decoded audio in overlapping chunks. Files that can't be decoded give no rows; :func:`undecodable` tells them.

    Filters and resampling act on the whole file before it is cut, as their state runs through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schemas.CHUNKS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float32())]
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    x, r = decode(data.as_py(), array_rate)
                except Exception:
                    continue
                x, r = one_channel(x, r, rate, mono, which, cutoff)
                stem = path.rsplit("/", 1)[-1].rpartition(".")[0] or path.rsplit("/", 1)[-1]
                for i, (lo, hi) in enumerate(ranges(len(x), int(chunk_s * r), int(overlap_s * r))):
                    row = (path, stem, i, lo, r, x[lo:hi].astype(np.float32))
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return found.select("path", "content").mapInArrow(run, schemas.CHUNKS)


def noise_segments(cut: DataFrame, seconds: float, overlap: float = 0.0, level: float = 0.1, ceiling: float = 0.95) -> DataFrame:
    """Fixed windows of each chunk, brought to an RMS of ``level`` and then under ``ceiling``; a rest of at least half a
    window gives one more window that ends with the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in kernels.records(b):
                x, n = r["samples"], int(seconds * r["sample_rate"])
                step = max(1, int(n * (1 - overlap)))
                starts = list(range(0, len(x) - n + 1, step))
                rest = len(x) - (starts[-1] + n if starts else 0)
                if starts and rest >= n / 2:
                    starts.append(len(x) - n)
                if not starts:
                    continue
                y = np.stack([x[s : s + n] for s in starts])
                rms = np.sqrt((y * y).mean(axis=1, keepdims=True))
                y = np.where(rms > 0, y * (level / np.where(rms > 0, rms, 1)), y)
                top = np.abs(y).max(axis=1, keepdims=True)
                y = np.where(top > ceiling, y * (ceiling / np.where(top > 0, top, 1)), y).astype(np.float32)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * n), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([r["source_file"]] * len(starts)), pa.array(np.arange(len(starts), dtype=np.int32)), pa.array(np.array(starts, np.int64) + r["start_sample"]), parts], ["source_file", "segment", "start", "samples"])

    return cut.select("source_file", "start_sample", "sample_rate", "samples").mapInArrow(run, "source_file string, segment int, start long, samples array<float>")
