"""MATLAB files that are assembled here, byte by byte, and read back in parts."""

import random
import struct
import zlib

import numpy as np
import pytest

from echoframe.operators import filtering
from echoframe.sources import audio, mat, ranges

CODES = {"i1": 1, "u1": 2, "i2": 3, "u2": 4, "i4": 5, "u4": 6, "f4": 7, "f8": 9, "i8": 12, "u8": 13}


def element(kind, data, order="<"):
    if len(data) <= 4 and kind != mat.MATRIX:
        first = struct.pack(order + "I", len(data) << 16 | kind)
        return first + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, x, order="<", packed=False, kind=None, flags=6):
    x = np.atleast_2d(x)
    dtype = kind or x.dtype.str[1:]
    body = element(6, struct.pack(order + "II", flags, 0), order) + element(5, struct.pack(order + "2i", *x.shape), order) + element(1, name.encode(), order)
    whole = element(mat.MATRIX, body + element(CODES[dtype], x.astype(order + dtype).tobytes("F"), order), order)
    if not packed:
        return whole
    z = zlib.compress(whole)
    return struct.pack(order + "II", mat.DEFLATED, len(z)) + z


def level5(*parts, order="<"):
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x100) + (b"IM" if order == "<" else b"MI") + b"".join(parts)


class Writer:
    """HDF5 as level 7.3 writes it, behind a block of 512 bytes that places don't count."""

    def __init__(self):
        self.raw = bytearray(96)

    def put(self, data):
        at = len(self.raw)
        self.raw += data + b"\0" * (-len(data) % 8)
        return at

    def header(self, messages, split=False):
        pack = lambda ms: b"".join(struct.pack("<HHB3x", k, len(d), 0) + d for k, d in ms)
        messages = [(k, d + b"\0" * (-len(d) % 8)) for k, d in messages]
        if split:  # the last message stands in a continuation
            rest = pack(messages[-1:])
            messages = [*messages[:-1], (0x10, struct.pack("<QQ", self.put(rest), len(rest)))]
            n = len(messages) + 1
        else:
            n = len(messages)
        body = pack(messages)
        return self.put(struct.pack("<BBHII4x", 1, 0, n, 1, len(body)) + body)

    @staticmethod
    def dtype(x):
        order = 1 if x.dtype.str[0] == ">" else 0
        kind = 1 if x.dtype.kind == "f" else 0
        return struct.pack("<B3BI", 0x10 | kind, order | (8 if x.dtype.kind == "i" else 0), 0, 0, x.dtype.itemsize) + b"\0" * 8

    @staticmethod
    def dims(shape):
        return struct.pack("<BBBB4x", 1, len(shape), 0, 0) + struct.pack(f"<{len(shape)}Q", *shape)

    def attribute(self, name, value):
        v = np.array(value, "<f8")
        name = name.encode() + b"\0"
        parts = [name, self.dtype(v), self.dims(())]
        return 12, struct.pack("<BBHHH", 1, 0, *map(len, parts)) + b"".join(p + b"\0" * (-len(p) % 8) for p in parts) + v.tobytes()

    def dataset(self, x, chunk=None, filters=(), attributes=(), compact=False):
        messages = [(1, self.dims(x.shape)), (3, self.dtype(x))]
        if compact:
            messages.append((8, struct.pack("<BBH", 3, 0, x.nbytes) + x.tobytes()))
        elif chunk is None:
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(x.tobytes()), x.nbytes)))
        else:
            messages.append((8, struct.pack("<BBBQ", 3, 2, x.ndim + 1, self.tree(x, chunk, filters)) + struct.pack(f"<{x.ndim + 1}I", *chunk, x.dtype.itemsize)))
            if filters:
                pipe = struct.pack("<BB6x", 1, len(filters))
                for k in filters:
                    pipe += struct.pack("<HHHH", k, 8, 0, 1) + b"a filter" + struct.pack("<I4x", x.dtype.itemsize if k == 2 else 6)
                messages.append((11, pipe))
        return self.header([*messages, *(self.attribute(*a) for a in attributes)], split=len(messages) > 3)

    def tree(self, x, chunk, filters):
        leaves = []
        for corner in np.ndindex(*(-(-n // c) for n, c in zip(x.shape, chunk))):
            at = [i * c for i, c in zip(corner, chunk)]
            block = np.zeros(chunk, x.dtype)
            part = x[tuple(slice(a, a + c) for a, c in zip(at, chunk))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            raw = block.tobytes()
            for k in filters:
                raw = zlib.compress(raw) if k == 1 else np.frombuffer(raw, np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() if k == 2 else raw + b"sums"
            leaves.append((struct.pack(f"<II{x.ndim + 1}Q", len(raw), 0, *at, 0), self.put(raw)))
        end = struct.pack(f"<II{x.ndim + 1}Q", 0, 0, *(s + c for s, c in zip(x.shape, chunk)), 0)
        node = lambda level, some, after: self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(some), 2**64 - 1, 2**64 - 1) + b"".join(k + struct.pack("<Q", a) for k, a in some) + after)
        level = 0
        while len(leaves) > 1 or not level:  # nodes of three, on as many levels as it takes
            groups = [leaves[i : i + 3] for i in range(0, len(leaves), 3)]
            leaves = [(g[0][0], node(level, g, groups[i + 1][0][0] if i + 1 < len(groups) else end)) for i, g in enumerate(groups)]
            level += 1
        return leaves[0][1]

    def done(self, **objects):
        names, text = {}, b"\0" * 8
        for k in sorted(objects):
            names[k] = len(text)
            text += k.encode() + b"\0" * (8 - len(k) % 8)
        data = self.put(text)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(text), 0, data))
        order = sorted(objects)
        nodes = []
        for some in [order[: len(order) // 2], order[len(order) // 2 :]]:
            if some:
                nodes.append((names[some[0]], self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(some)) + b"".join(struct.pack("<QQII16x", names[k], objects[k], 0, 0) for k in some))))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), 2**64 - 1, 2**64 - 1) + b"".join(struct.pack("<QQ", k, a) for k, a in nodes) + struct.pack("<Q", 0))
        root = self.header([(0x11, struct.pack("<QQ", tree, heap))])
        front = mat.HDF5 + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 512, 2**64 - 1, len(self.raw), 2**64 - 1)
        self.raw[:96] = front + struct.pack("<QQII16x", 0, root, 1, 0)
        return b"MATLAB 7.3 MAT-file".ljust(124) + struct.pack("<H", 0x200) + b"IM" + b"\0" * 384 + bytes(self.raw)


def made(seed=1):
    """name -> data, rate, and the signal by channel (time, channel)."""
    rng = np.random.default_rng(seed)
    out = {}
    x = rng.normal(size=(3, 500))
    out["wide.mat"] = level5(matrix("note", np.frombuffer(b"text", np.uint8), flags=4), matrix("data", x), matrix("fs", np.array([[48000.0]]))), 48000, x.T
    out["packed.mat"] = level5(matrix("other", rng.normal(size=(5, 5)), packed=True), matrix("newFiltDat", x.T, packed=True), matrix("Fs", np.array([[8000]], np.uint16), kind="u2", flags=11, packed=True)), 8000, x.T
    out["big.mat"] = level5(matrix("y", x[:1], ">"), order=">"), 96000, x[:1].T
    s = np.round(x * 1000).astype("<i2")
    out["short.mat"] = level5(matrix("x", s, kind="i2")), 96000, s.T.astype(float)
    for name, chunk, filters, y in (("plain", None, (), x), ("tall", None, (), x.T), ("chunks", (2, 70), (2, 1), x), ("tiles", (90, 2), (1,), x.T), ("sums", (1, 128), (2, 1, 3), s), ("line", (64,), (1,), x[0])):
        w = Writer()
        y = np.ascontiguousarray(y)
        objects = {"signal": w.dataset(y, chunk, filters, [("fs", 22050.0)] if name == "tall" else ()), "aaa": w.dataset(np.arange(4.0))}
        if name in ("chunks", "tiles"):
            objects["sample_rate"] = w.dataset(np.array([[44100.0]]), compact=name == "tiles")
        z = np.atleast_2d(y)
        out[f"{name}.mat"] = w.done(**objects), {"tall": 22050, "chunks": 44100, "tiles": 44100}.get(name, 96000), (z if z.shape[0] > z.shape[1] else z.T).astype(float)
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("mat")
    for name, (data, _, _) in made().items():
        (at / name).write_bytes(data)
    return at


def test_parts_of_channels(folder):
    for name, (_, rate, x) in made().items():
        with ranges.Bytes(str(folder / name)) as f:
            at = ranges.layout(f)
            assert (at.rate, at.channels, at.frames) == (rate, x.shape[1], x.shape[0]), name
            for lo, hi in ((0, len(x)), (0, 1), (61, 143), (len(x) - 5, len(x) + 3), (-2, 2), (7, 7)):
                want = np.stack([x[i] if 0 <= i < len(x) else 0 * x[0] for i in range(lo, hi)]) if hi > lo else np.zeros((0, x.shape[1]))
                for c in range(x.shape[1]):
                    assert np.array_equal(ranges.samples(f, at, lo, hi, "channel", c), want[:, c]), (name, lo, c)
                assert np.allclose(ranges.samples(f, at, lo, hi), want.mean(axis=1))


def test_one_channel_is_read_without_the_rest(tmp_path):
    x = np.random.default_rng(2).normal(size=(20, 50_000))
    w = Writer()
    (tmp_path / "chunks.mat").write_bytes(w.done(data=w.dataset(x, (1, 5000), (1,))))
    (tmp_path / "five.mat").write_bytes(level5(matrix("data", x.T)))
    for name in ("chunks.mat", "five.mat"):
        with ranges.Bytes(str(tmp_path / name)) as f:
            at = ranges.layout(f)
            before = f.count
            assert before < 5000 and np.array_equal(ranges.samples(f, at, 20_000, 24_000, "channel", 10), x[10, 20_000:24_000])
            assert f.count - before < 60_000  # of eight million


def test_broken_files_are_errors(folder, tmp_path):
    rng = random.Random(3)
    for name, (data, _, _) in made().items():
        for _ in range(60):
            bad = bytearray(data[: rng.randrange(130, len(data))] if rng.random() < 0.5 else data)
            for _ in range(rng.randrange(4)):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            (tmp_path / "bad.mat").write_bytes(bytes(bad))
            try:
                with ranges.Bytes(str(tmp_path / "bad.mat")) as f:
                    at = ranges.layout(f)
                    ranges.samples(f, at, 0, min(at.frames, 1000), "channel", 1)
            except (OSError, ValueError, struct.error):
                pass  # what becomes an error's row
    (tmp_path / "bad.mat").write_bytes(level5(matrix("unknown", np.ones((2, 2)))))
    with ranges.Bytes(str(tmp_path / "bad.mat")) as f, pytest.raises(ValueError, match="none of newFiltDat"):
        ranges.layout(f)


def test_matlab_files_as_recordings(spark, folder):
    (folder / "none.mat").write_bytes(b"MATLAB 5.0 MAT-file".ljust(200))
    rows = ranges.scan(spark, [str(folder)], "*.mat", chunk_s=0.002, overlap_s=0, mono="channel", which=10).collect()
    (folder / "none.mat").unlink()
    assert [r.file_id for r in rows if r.error] == ["none"]
    for name, (_, rate, x) in made().items():
        parts = sorted((r.start_sample, r.samples) for r in rows if r.file_id == name[:-4])
        assert np.array_equal(np.concatenate([p for _, p in parts]), x[:, min(10, x.shape[1] - 1)].astype(np.float32)) and len(parts) > 1
    found = audio.files(spark, [str(folder)], "{chunks,packed}.mat")
    got = filtering.preprocessed_chunks(found, 0.01, 0.002, rate=16000, cutoff=1000.0, mono="channel", which=2)
    assert {r.sample_rate for r in got.collect()} == {16000} and got.count() > 4


def test_matlab_to_wav_and_clips_to_look_at(spark, folder, tmp_path):
    from echoframe import __main__ as cli

    cli.main(["mat-to-wav", str(folder), str(tmp_path / "wav"), "--channel", "1"], spark)
    for name, (_, rate, x) in made().items():
        got, r = audio.decode((tmp_path / "wav" / f"{name[:-4]}.wav").read_bytes())
        assert r == rate and np.allclose(got, np.clip(x[:, min(1, x.shape[1] - 1)], -1, 1), atol=1e-4)
    rows = [(f"a/b {i}", i % 2, "train" if i < 8 else "val", [0.1 * i, -0.5]) for i in range(12)]
    spark.createDataFrame(rows, "file_id string, label int, split string, waveform array<double>").write.partitionBy("split").parquet(str(tmp_path / "set"))
    cli.main(["look", str(tmp_path / "set"), str(tmp_path / "look"), "--n", "3", "--seed", "4"], spark)
    names = sorted(p.name for p in (tmp_path / "look").iterdir())
    assert len(names) == 6 and sum(n.startswith("train_") for n in names) == 3 and all("_a-b-" in n and n.endswith(".wav") for n in names)
