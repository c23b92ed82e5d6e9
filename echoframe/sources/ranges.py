"""Recordings read by byte range, so that a long file is many tasks and a part of it costs that part's bytes.

``Recordings`` is a Python data source of overlapping chunks (format ``recordings``). Its planner lists files; of those longer
than ``split_bytes`` it reads the header and deals their chunks to tasks of about that many bytes, shorter ones are packed
together and their headers are left to the tasks. Filters on ``source_file``, ``chunk_id``, ``start_sample``, ``start_s`` and
``end_s`` are pushed: files and chunks that they rule out are never opened or read. A task holds one chunk.

WAV (whole numbers of 8 to 32 bits, floats, the extensible form, RF64 beyond 4 GB), NPY arrays and MATLAB files are read; a file
that is none of these, or is broken, gives one row with ``error``. Files are opened through Arrow's file systems (local, HDFS, S3, GCS); where
only Spark can read a store, ``audio.chunks`` still takes whole files.
"""

from __future__ import annotations

import fnmatch
import io
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from .. import schemas
from . import audio, mat
from .audio import ARRAY_RATE

SCHEMA = schemas.CHUNKS + ", start_s double, end_s double, error string"
#: Bytes of samples that a task of a scan reads, about.
SPLIT_BYTES = 64 << 20
#: Bytes that are read at once of what stands before the samples.
HEAD = 512


@dataclass(frozen=True)
class Layout:
    """Where a file's samples lie: ``frames`` of ``channels`` values of ``dtype`` ("i3" for 24 bits) from byte ``start`` on, one
    channel after the other if ``planar``; a sample is (value - zero) / full."""

    rate: int
    channels: int
    frames: int
    start: int
    dtype: str
    zero: float = 0.0
    full: float = 1.0
    planar: bool = False
    #: Where samples are no run of the file's bytes: the array that reads them.
    array: mat.Array | None = None

    @property
    def width(self) -> int:
        return int(self.dtype.lstrip("<>|=")[1:])


class Bytes:
    """A file that is read by ranges, and how many bytes of it were."""

    def __init__(self, path: str):
        system, name = located(path)
        self.file = system.open_input_file(name)
        self.size, self.count = self.file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        out = self.file.read_at(max(0, min(n, self.size - at)), at)
        self.count += len(out)
        return out

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path's name there."""
    scheme, _, rest = path.partition(":")
    if path.startswith("/") or scheme == "file" or not rest:
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme == "file" else path
    return pafs.FileSystem.from_uri(path)


def listed(root: str, pattern: str) -> list[tuple[str, int]]:
    """Path (as Spark writes it) and length of the files under a root, hidden ones left out."""
    system, name = located(root)
    info = system.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(name, recursive=True))
    front = "file:" if isinstance(system, pafs.LocalFileSystem) else root[: len(root) - len(name)] if root.endswith(name) else root.partition("://")[0] + "://"
    below = lambda p: p[len(name) :].split("/")
    return sorted((front + x.path, x.size) for x in found if x.type == pafs.FileType.File and fnmatch.fnmatchcase(x.base_name, pattern) and not any(y[:1] in ("_", ".") for y in below(x.path)))


def layout(f: Bytes, array_rate: int = ARRAY_RATE) -> Layout:
    """Where the samples of an open file are."""
    head = f.read(0, HEAD)
    if head[:6] == b"\x93NUMPY":
        return _array(f, head, array_rate)
    if mat.is_mat(head):
        a, rate = mat.signal(f)
        planar = a.fast >= a.slow  # the longer side is time
        return Layout(rate, min(a.fast, a.slow), max(a.fast, a.slow), 0, a.dtype, planar=planar, array=a)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("neither WAV, NPY nor MATLAB data")
    at, kind, long = 12, None, None
    while at + 8 <= f.size:
        piece = head[at : at + 48] if at + 48 <= len(head) else f.read(at, 48)
        if len(piece) < 8:
            break
        name, size = piece[:4], struct.unpack_from("<I", piece, 4)[0]
        if name == b"ds64":
            long = struct.unpack_from("<Q", piece, 16)[0]
        elif name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", piece, 8)
            kind = struct.unpack_from("<H", piece, 32)[0] if kind == 0xFFFE and size >= 40 else kind  # the extensible form names it further on
        elif name == b"data":
            if kind is None:
                raise ValueError("samples before their format")
            size = long if size == 0xFFFFFFFF and long is not None else size
            width = (bits + 7) // 8
            if not channels or not rate or kind == 1 and width not in (1, 2, 3, 4) or kind == 3 and width not in (4, 8) or kind not in (1, 3):
                raise ValueError(f"unknown format {kind} of {bits} bits, {channels} channels, {rate} Hz")
            n = min(size, f.size - at - 8) // (width * channels)
            form = ("<f%d" % width, 0.0, 1.0) if kind == 3 else ("|u1", 128.0, 128.0) if width == 1 else ("<i%d" % width, 0.0, float(1 << (8 * width - 1)))
            return Layout(rate, channels, n, at + 8, *form)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _array(f: Bytes, head: bytes, rate: int) -> Layout:
    major = head[6]
    size = struct.unpack_from("<H" if major == 1 else "<I", head, 8)[0]
    start = (10 if major == 1 else 12) + size
    body = io.BytesIO((head if start <= len(head) else f.read(0, start))[8:])
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(body)
    if dtype.kind not in "iuf" or len(shape) not in (1, 2) or dtype.itemsize > 8:
        raise ValueError(f"an array of {dtype} with {len(shape)} dimensions")
    if len(shape) == 1:
        return Layout(rate, 1, shape[0], start, dtype.str)
    time_first = shape[0] >= shape[1]  # the longer side is time
    frames, channels = shape if time_first else shape[::-1]
    return Layout(rate, channels, frames, start, dtype.str, planar=by_column == time_first)


def samples(f: Bytes, at: Layout, lo: int, hi: int, mono: str = "mean", which: int = 0) -> np.ndarray:
    """Samples [lo, hi) of one channel (the last for any beyond it) or of the mean of all; zeros beyond the ends."""
    a, b = max(0, lo), min(hi, at.frames)
    if b <= a:
        return np.zeros(max(0, hi - lo))
    one = min(which, at.channels - 1)
    if at.planar:
        wanted = [one] if mono == "channel" else range(at.channels)
        x = np.stack([_values(f, at, c * at.frames + a, c * at.frames + b) for c in wanted], axis=1)
    else:
        x = _values(f, at, a * at.channels, b * at.channels).reshape(-1, at.channels)
        x = x[:, one : one + 1] if mono == "channel" else x
    x = x[:, 0] if x.shape[1] == 1 else x.mean(axis=1)
    return np.pad(x, (a - lo, hi - b)) if a > lo or b < hi else x


def _values(f: Bytes, at: Layout, a: int, b: int) -> np.ndarray:
    """Values [a, b) in the file's order."""
    if at.array is not None:
        return at.array.values(f, a, b).astype(np.float64)
    raw = f.read(at.start + a * at.width, (b - a) * at.width)
    if at.dtype == "<i3":
        x = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = (x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) >> 8
    else:
        v = np.frombuffer(raw, at.dtype)
    return (v.astype(np.float64) - at.zero) / at.full


@dataclass(frozen=True)
class Grid:
    """Overlapping chunks of a recording, by seconds."""

    chunk_s: float
    overlap_s: float

    def sizes(self, rate: int) -> tuple[int, int]:
        """Samples of a chunk, and from one's start to the next's."""
        chunk = int(self.chunk_s * rate)
        return chunk, max(1, chunk - int(self.overlap_s * rate))

    def count(self, frames: int, rate: int) -> int:
        chunk, step = self.sizes(rate)
        return 0 if not frames else 1 + max(0, -(-(frames - chunk) // step)) if chunk else frames

    def bounds(self, k: int, frames: int, rate: int) -> tuple[int, int]:
        chunk, step = self.sizes(rate)
        return k * step, min(k * step + chunk, frames)


@dataclass
class Split(InputPartition):
    """What one task reads: (path, the chunks to read, or None for all that pass) of one or several files."""

    parts: list[tuple[str, list[int] | None]]


KNOWN = ("source_file", "file_id", "chunk_id", "start_sample", "start_s", "end_s")
COMPARE = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}


def holds(f: Filter, row: dict) -> bool:
    """Whether a pushed filter holds for a row; columns that the row doesn't have yet don't rule it out."""
    name = f.attribute[0]
    if name not in row:
        return True
    v = row[name]
    if isinstance(f, (IsNull, IsNotNull)):
        return (v is None) == isinstance(f, IsNull)
    return v is not None and COMPARE[type(f)](v, f.value)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [x for x in options.get("paths", options.get("path", "")).split("\n") if x]
        self.pattern = options.get("pattern", "*.wav")
        self.grid = Grid(float(options.get("chunk_s", 60.0)), float(options.get("overlap_s", 0.5)))
        self.mono, self.which = options.get("mono", "mean"), int(options.get("which", 0))
        self.array_rate, self.split = int(options.get("array_rate", ARRAY_RATE)), int(options.get("split_bytes", SPLIT_BYTES))
        self.with_samples = options.get("samples", "true").lower() == "true"
        self.filters: list[Filter] = []
        self.count = 0  # bytes that this object has read

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ("",))
            value = getattr(f, "value", 0)
            if len(name) == 1 and name[0] in KNOWN and (isinstance(f, (IsNull, IsNotNull)) or type(f) in COMPARE and value is not None and not (isinstance(f, In) and None in value)):
                self.filters.append(f)
            else:
                yield f

    def passes(self, row: dict) -> bool:
        return all(holds(f, row) for f in self.filters)

    def partitions(self) -> list[Split]:
        found = sorted({x for r in self.roots for x in listed(r, self.pattern)})
        found = [(p, n) for p, n in found if self.passes(named(p))]
        with ThreadPoolExecutor(16) as pool:
            long = dict(zip([p for p, n in found if n > self.split], pool.map(self._long, [p for p, n in found if n > self.split])))
        out, held, size = [], [], 0
        for path, n in found:
            if long.get(path) is not None:
                out += [Split([(path, ks)]) for ks in long[path]]
                continue
            if held and size + n > self.split:
                out, held, size = [*out, Split(held)], [], 0
            held.append((path, None))
            size += n
        return out + [Split(held)] * bool(held) or [Split([])]

    def _long(self, path: str) -> list[list[int]] | None:
        """The chunks of a long file that pass, dealt to tasks; None if its header can't be read: a task will say why."""
        try:
            with Bytes(path) as f:
                at = layout(f, self.array_rate)
                self.count += f.count
        except Exception:
            return None
        ks = [k for k in range(self.grid.count(at.frames, at.rate)) if self.passes(self._row(path, at, k))]
        each = max(1, self.split // max(1, self.grid.sizes(at.rate)[0] * at.width * at.channels))
        return [ks[a : a + each] for a in range(0, len(ks), each)]

    def _row(self, path: str, at: Layout, k: int) -> dict:
        lo, hi = self.grid.bounds(k, at.frames, at.rate)
        return named(path) | {"chunk_id": k, "start_sample": lo, "sample_rate": at.rate, "samples": None, "start_s": lo / at.rate, "end_s": hi / at.rate, "error": None}

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        for path, ks in partition.parts:
            try:
                with Bytes(path) as f:
                    at = layout(f, self.array_rate)
                    for k in range(self.grid.count(at.frames, at.rate)) if ks is None else ks:
                        row = self._row(path, at, k)
                        if not self.passes(row):
                            continue
                        if self.with_samples:
                            row["samples"] = samples(f, at, *self.grid.bounds(k, at.frames, at.rate), self.mono, self.which).astype(np.float32)
                        yield batch(row)
                    self.count += f.count
            except (OSError, ValueError, struct.error) as e:  # a file that can't be read becomes a row
                row = named(path) | dict.fromkeys(("chunk_id", "start_sample", "sample_rate", "samples", "start_s", "end_s")) | {"error": f"{type(e).__name__}: {e}"}
                if self.passes(row):
                    yield batch(row)


def named(path: str) -> dict:
    name = path.rsplit("/", 1)[-1]
    return {"source_file": path, "file_id": name.rpartition(".")[0] or name}


COLUMNS = {"source_file": pa.string(), "file_id": pa.string(), "chunk_id": pa.int32(), "start_sample": pa.int64(), "sample_rate": pa.int32(), "samples": pa.list_(pa.float32()), "start_s": pa.float64(), "end_s": pa.float64(), "error": pa.string()}


def batch(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in COLUMNS.items()], list(COLUMNS))


class Recordings(DataSource):
    """Chunks of the recordings under ``path`` (or ``paths``, a line each); options as in :class:`Reader`."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format ``recordings`` known to the session, with its filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)


def scan(spark: SparkSession, roots: list[str], pattern: str = "*.wav", **options) -> DataFrame:
    """Chunks of all recordings under the roots, with their times and, of files that can't be read, the error.

    Spark 4.1 gives a query without a filter that can be pushed the reader of the query before it on the same DataFrame, with
    that one's filters. The filter that stands here always is pushed, so that each query gets a reader of its own."""
    register(spark)
    read = spark.read.format("recordings").option("paths", "\n".join(roots)).option("pattern", pattern)
    for k, v in options.items():
        read = read.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return read.load().where("source_file is not null")


def chunks(spark: SparkSession, roots: list[str], pattern: str = "*.wav", **options) -> DataFrame:
    """The chunks of :func:`audio.chunks`, by byte range; files that can't be read give none. From stores that only Spark can open
    whole files are taken."""
    try:
        for r in roots:
            system, name = located(r)
            system.get_file_info(name)
    except (ValueError, NotImplementedError, OSError):
        some = {k: v for k, v in options.items() if k in ("chunk_s", "overlap_s", "mono", "which", "array_rate")}
        return audio.chunks(audio.files(spark, roots, pattern), **some)
    return scan(spark, roots, pattern, **options).where("error is null").select(*[x.split()[0] for x in schemas.CHUNKS.split(", ")])


HEADERS = "source_file string, sample_rate int, channels int, frames long, width int, error string"


def headers(found: DataFrame, array_rate: int = ARRAY_RATE) -> DataFrame:
    """One row per file of ``found`` (path) with its rate, channels, frames and bytes a value, or its error; only headers are
    read, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in HEADERS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                try:
                    with Bytes(path) as f:
                        at = layout(f, array_rate)
                    rows.append((path, at.rate, at.channels, at.frames, at.width, None))
                except (OSError, ValueError, struct.error) as e:
                    rows.append((path, *[None] * 4, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return found.select("path").mapInArrow(run, HEADERS)


def pieces(heads: DataFrame, grid: Grid, rate: int | None = None) -> DataFrame:
    """One row for each chunk of each recording, with its bounds [lo, hi) at ``rate`` (its own without), ``step`` and layout."""
    out = F.col("sample_rate") if rate is None else F.lit(rate)
    n = F.ceil(F.col("frames") * out / F.col("sample_rate")) if rate is not None else F.col("frames")
    chunk = F.floor(F.lit(grid.chunk_s) * out)
    df = heads.where("error is null").withColumns({"rate": out.cast("int"), "n": n.cast("long"), "chunk": chunk.cast("long")})
    df = df.withColumn("step", F.greatest(F.lit(1), F.col("chunk") - F.floor(F.lit(grid.overlap_s) * out)).cast("long")).where("n > 0")
    count = F.lit(1) + F.greatest(F.lit(0), F.ceil((F.col("n") - F.col("chunk")) / F.col("step")))
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))))
    return df.withColumns({"lo": F.col("k") * F.col("step"), "hi": F.least(F.col("k") * F.col("step") + F.col("chunk"), "n")})
