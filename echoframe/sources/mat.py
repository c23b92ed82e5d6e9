"""MATLAB files as recordings: level 5 elements, and the HDF5 structures in which level 7.3 keeps its arrays.

``find`` gives the place of each numeric array of an open file. Its values are read by ranges in the file's own order, columns
first, so one channel is read without the rest: plain arrays by their bytes, chunked ones by the chunks that a range meets
(deflate, shuffle and checksums are undone), compressed elements of level 5 up to the range's end, as a deflated stream has no
other way in. Sparse, complex, cell and object arrays are not read; a file that lacks a known array is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Names that samples and their rate go by, the first that is there is taken, and the rate without any.
DATA_KEYS = ["newFiltDat", "data", "y", "audio", "signal", "x"]
RATE_KEYS = ["fs", "sr", "Fs", "sampleRate", "sample_rate"]
DEFAULT_RATE = 96000

#: Types of level 5 elements.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, DEFLATED = 14, 15
#: Classes of arrays of numbers, from double to uint64.
NUMERIC = range(6, 16)
HDF5 = b"\x89HDF\r\n\x1a\n"
STEP = 1 << 16
#: What a broken file may raise on the way.
BROKEN = (IndexError, KeyError, RecursionError, OverflowError, ZeroDivisionError, zlib.error, struct.error)


@dataclass
class Array:
    """``slow`` runs of ``fast`` values of ``dtype``; ``attributes`` are numbers that stand with it."""

    fast: int
    slow: int
    dtype: str
    store: Plain | Deflated | Chunked
    attributes: dict[str, float] = field(default_factory=dict)

    def values(self, f, a: int, b: int) -> np.ndarray:
        """Values [a, b) in the file's order."""
        w = np.dtype(self.dtype).itemsize
        try:
            raw = self.store.read(f, a * w, b * w)
        except BROKEN as e:
            raise ValueError(f"a broken MATLAB file: {type(e).__name__}: {e}") from e
        if len(raw) < (b - a) * w:
            raise ValueError("an array is cut off")
        return np.frombuffer(raw, self.dtype)


@dataclass
class Plain:
    at: int

    def read(self, f, a: int, b: int) -> bytes:
        return f.read(self.at + a, b - a)


@dataclass
class Inline:
    data: bytes

    def read(self, f, a: int, b: int) -> bytes:
        return self.data[a:b]


@dataclass
class Deflated:
    """Bytes from ``skip`` on of the stream that lies at [at, at + size)."""

    at: int
    size: int
    skip: int

    def read(self, f, a: int, b: int) -> bytes:
        out, done, z = [], 0, zlib.decompressobj()
        lo, hi = self.skip + a, self.skip + b
        for at in range(self.at, self.at + self.size, STEP):
            part = f.read(at, min(STEP, self.at + self.size - at))
            while part and done < hi:
                got = z.decompress(part, STEP * 4)
                out.append(got[max(0, lo - done) : max(0, hi - done)])
                done, part = done + len(got), z.unconsumed_tail
            if done >= hi:
                break
        return b"".join(out)


@dataclass
class Chunked:
    """An array in chunks of ``tall`` x ``wide`` values, which a tree at ``root`` lists by their first value's place."""

    file: Hdf5
    root: int
    rank: int
    slow: int
    fast: int
    tall: int
    wide: int
    width: int
    filters: list[tuple[int, list[int]]]

    def read(self, f, a: int, b: int) -> bytes:
        if b <= a:
            return b""
        first, last = a // self.width, (b - 1) // self.width
        r0, r1 = first // self.fast, last // self.fast + 1
        c0, c1 = (first % self.fast, last % self.fast + 1) if r1 == r0 + 1 else (0, self.fast)
        out = np.zeros((r1 - r0, c1 - c0), f"V{self.width}")
        low = (r0 // self.tall * self.tall, c0 // self.wide * self.wide)
        high = ((r1 - 1) // self.tall * self.tall, (c1 - 1) // self.wide * self.wide)
        for (r, c), size, mask, at in self._chunks(f, self.root, low, high):
            if r + self.tall <= r0 or r >= r1 or c + self.wide <= c0 or c >= c1:
                continue
            raw = self._plain(f.read(at, size), mask)
            m = np.frombuffer(raw[: self.tall * self.wide * self.width], f"V{self.width}").reshape(self.tall, self.wide)
            x0, x1, y0, y1 = max(r, r0), min(r + self.tall, r1), max(c, c0), min(c + self.wide, c1)
            out[x0 - r0 : x1 - r0, y0 - c0 : y1 - c0] = m[x0 - r : x1 - r, y0 - c : y1 - c]
        skip = first - (r0 * self.fast + c0)
        return out.tobytes()[skip * self.width : skip * self.width + b - a]

    def _place(self, key: bytes) -> tuple[int, int]:
        at = struct.unpack_from(f"<{self.rank}Q", key, 8)
        return at if self.rank == 2 else (0, at[0])

    def _chunks(self, f, at: int, low: tuple, high: tuple) -> Iterator[tuple]:
        """Chunks whose place is between ``low`` and ``high``; only the tree's nodes on the way are read."""
        level, n, body = self.file.node(f, at, 1, 8 + 8 * (self.rank + 1))
        step = 16 + 8 * (self.rank + 1)
        keys = [body[i * step : i * step + step - 8] for i in range(n + 1)]
        for i in range(n):
            child = self.file.base + struct.unpack_from("<Q", body, i * step + step - 8)[0]
            if self._place(keys[i]) > high or (i + 1 < n or level) and self._place(keys[i + 1]) <= low:
                continue
            if level:
                yield from self._chunks(f, child, low, high)
            else:
                yield self._place(keys[i]), *struct.unpack_from("<II", keys[i]), child

    def _plain(self, raw: bytes, mask: int) -> bytes:
        for i, (kind, values) in reversed(list(enumerate(self.filters))):
            if mask >> i & 1:
                continue
            if kind == 1:
                raw = zlib.decompress(raw)
            elif kind == 2:
                w = values[0] if values else self.width
                n = len(raw) // w
                raw = np.frombuffer(raw[: n * w], np.uint8).reshape(w, n).T.tobytes() + raw[n * w :]
            elif kind == 3:
                raw = raw[:-4]
            else:
                raise ValueError(f"unknown filter {kind}")
        return raw


def find(f) -> dict[str, Array]:
    """The numeric arrays of an open file by name."""
    head = f.read(0, 128)
    if len(head) == 128 and head[126:128] in (b"IM", b"MI") and struct.unpack("<H" if head[126:128] == b"IM" else ">H", head[124:126])[0] >> 8 == 1:
        return dict(_elements(f, "<" if head[126:128] == b"IM" else ">"))
    at = 0
    while at < f.size:
        if f.read(at, 8) == HDF5:
            return Hdf5(f, at).arrays(f)
        at = at * 2 or 512
    raise ValueError("no MATLAB file")


def is_mat(head: bytes) -> bool:
    return head[:6] == b"MATLAB" or head[:8] == HDF5


def signal(f) -> tuple[Array, int]:
    """The samples' array and their rate."""
    try:
        found = find(f)
        name = next((k for k in DATA_KEYS if k in found), None)
        if name is None:
            raise ValueError(f"none of {', '.join(DATA_KEYS)} among {', '.join(found) or 'no arrays'}")
        for k in RATE_KEYS:
            if k in found:
                return found[name], int(found[k].values(f, 0, 1)[0])
            if k in found[name].attributes:
                return found[name], int(found[name].attributes[k])
        return found[name], DEFAULT_RATE
    except BROKEN as e:
        raise ValueError(f"a broken MATLAB file: {type(e).__name__}: {e}") from e


# Level 5


def _tag(data: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """Type, size, place of the data and of the next element."""
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + size + (-size % 8)


def _elements(f, order: str) -> Iterator[tuple[str, Array]]:
    at = 128
    while at + 8 <= f.size:
        kind, size, data, after = _tag(f.read(at, 8), 0, order)
        if kind == DEFLATED:
            z, head = zlib.decompressobj(), b""
            packed = f.read(at + 8, min(size, STEP))
            head = z.decompress(packed, 1024)
            if len(head) >= 8 and _tag(head, 0, order)[0] == MATRIX:
                yield from _matrix(head, order, lambda skip, size=size, at=at: Deflated(at + 8, size, skip))
            at += 8 + size
            continue
        if kind == MATRIX:
            yield from _matrix(f.read(at, min(1024, 8 + size)), order, lambda skip, at=at: Plain(at + skip))
        at += after


def _matrix(head: bytes, order: str, place) -> Iterator[tuple[str, Array]]:
    """The array of a matrix element that begins with ``head``, if it is one of numbers."""
    _, _, at, _ = _tag(head, 0, order)
    _, _, data, at = _tag(head, at, order)
    flags = struct.unpack_from(order + "I", head, data)[0]
    _, size, data, at = _tag(head, at, order)
    dims = struct.unpack_from(f"{order}{size // 4}i", head, data)
    _, size, data, at = _tag(head, at, order)
    name = head[data : data + size].decode("latin-1")
    kind, _, data, _ = _tag(head, at, order)
    if flags & 0xFF in NUMERIC and not flags & 0x800 and kind in NUMBERS and len(dims) == 2:
        yield name, Array(dims[0], dims[1], order + NUMBERS[kind], place(data))


# Level 7.3


class Hdf5:
    """An HDF5 file of symbol-table groups, as level 7.3 writes them; places are those of the file."""

    def __init__(self, f, at: int):
        head = f.read(at, 128)
        version, offsets, lengths = head[8], head[13], head[14]
        if version > 1 or (offsets, lengths) != (8, 8):
            raise ValueError(f"superblock {version} with offsets of {offsets} and lengths of {lengths} bytes")
        front = 24 + 4 * version
        self.base = struct.unpack_from("<Q", head, front)[0]
        self.root = self.base + struct.unpack_from("<Q", head, front + 40)[0]

    def messages(self, f, at: int) -> list[tuple[int, bytes]]:
        """Types and data of an object's header, its continuations included."""
        version, _, n, _, size = struct.unpack("<BBHII", f.read(at, 12))
        if version != 1:
            raise ValueError(f"object header {version}")
        blocks, out = [(at + 16, size)], []
        while blocks and len(out) < n:
            start, size = blocks.pop(0)
            raw, i = f.read(start, size), 0
            while i + 8 <= len(raw) and len(out) < n:
                kind, m = struct.unpack_from("<HH", raw, i)
                data = raw[i + 8 : i + 8 + m]
                if kind == 0x10:
                    a, b = struct.unpack_from("<QQ", data)
                    blocks.append((self.base + a, b))
                out.append((kind, data))
                i += 8 + m
        return out

    def node(self, f, at: int, kind: int, key: int) -> tuple[int, int, bytes]:
        """Level, number of children, and keys and children of a tree's node."""
        head = f.read(at, 24)
        if head[:4] != b"TREE" or head[4] != kind:
            raise ValueError("a tree's node is missing")
        n = struct.unpack_from("<H", head, 6)[0]
        return head[5], n, f.read(at + 24, n * (key + 8) + key)

    def arrays(self, f) -> dict[str, Array]:
        table = next((d for k, d in self.messages(f, self.root) if k == 0x11), None)
        if table is None:
            raise ValueError("the root is no group of symbols")
        tree, heap = (self.base + x for x in struct.unpack_from("<QQ", table))
        names = self.base + struct.unpack_from("<Q", f.read(heap, 32), 24)[0]
        size = struct.unpack_from("<Q", f.read(heap, 32), 8)[0]
        text = f.read(names, size)
        out = {}
        for offset, at in self._symbols(f, tree):
            array = self._array(f, at)
            if array:
                out[text[offset : text.index(b"\0", offset)].decode("utf-8", "replace")] = array
        return out

    def _symbols(self, f, at: int) -> Iterator[tuple[int, int]]:
        level, n, body = self.node(f, at, 0, 8)
        for i in range(n):
            child = self.base + struct.unpack_from("<Q", body, i * 16 + 8)[0]
            if level:
                yield from self._symbols(f, child)
                continue
            head = f.read(child, 8)
            if head[:4] != b"SNOD":
                raise ValueError("symbols are missing")
            many = struct.unpack_from("<H", head, 6)[0]
            raw = f.read(child + 8, 40 * many)
            for j in range(many):
                name, header = struct.unpack_from("<QQ", raw, 40 * j)
                yield name, self.base + header

    def _array(self, f, at: int) -> Array | None:
        parts: dict[int, list[bytes]] = {}
        for k, d in self.messages(f, at):
            parts.setdefault(k, []).append(d)
        if not all(k in parts for k in (1, 3, 8)):
            return None
        dims, dtype, layout = _dims(parts[1][0]), _dtype(parts[3][0]), parts[8][0]
        if dtype is None or len(dims) > 2:
            return None
        slow, fast = (1, *dims, 1)[-3:-1] if len(dims) == 1 else dims if dims else (1, 1)
        attributes = dict(x for d in parts.get(12, []) for x in _attribute(d))
        if layout[0] != 3:
            raise ValueError(f"layout {layout[0]}")
        if layout[1] == 0:
            store = Inline(layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]])
        elif layout[1] == 1:
            store = Plain(self.base + struct.unpack_from("<Q", layout, 2)[0])
        else:
            rank = layout[2] - 1
            root = self.base + struct.unpack_from("<Q", layout, 3)[0]
            sizes = struct.unpack_from(f"<{rank}I", layout, 11)
            tall, wide = sizes if rank == 2 else (1, sizes[0])
            store = Chunked(self, root, rank, slow, fast, tall, wide, np.dtype(dtype).itemsize, _filters(parts[11][0]) if 11 in parts else [])
        return Array(fast, slow, dtype, store, attributes)


def _dims(d: bytes) -> tuple[int, ...]:
    return struct.unpack_from(f"<{d[1]}Q", d, 8 if d[0] == 1 else 4)


def _dtype(d: bytes) -> str | None:
    """The type of whole or floating-point numbers, None for any other."""
    kind, size = d[0] & 15, struct.unpack_from("<I", d, 4)[0]
    order = ">" if d[1] & 1 else "<"
    if kind == 0 and size in (1, 2, 4, 8):
        return f"{order}{'i' if d[1] & 8 else 'u'}{size}"
    return f"{order}f{size}" if kind == 1 and size in (4, 8) else None


def _filters(d: bytes) -> list[tuple[int, list[int]]]:
    version, n = d[0], d[1]
    at, out = 8 if version == 1 else 2, []
    for _ in range(n):
        kind = struct.unpack_from("<H", d, at)[0]
        named = version == 1 or kind >= 256
        length = struct.unpack_from("<H", d, at + 2)[0] if named else 0
        _, many = struct.unpack_from("<HH", d, at + (4 if named else 2))
        at += (8 if named else 6) + (length + (-length % 8) if version == 1 else length)
        out.append((kind, list(struct.unpack_from(f"<{many}I", d, at))))
        at += 4 * many + (4 if version == 1 and many % 2 else 0)
    return out


def _attribute(d: bytes) -> Iterator[tuple[str, float]]:
    """Name and first value of an attribute of numbers."""
    version = d[0]
    sizes = struct.unpack_from("<HHH", d, 2)
    at, parts = 9 if version == 3 else 8, []
    for n in sizes:
        parts.append(d[at : at + n])
        at += n + (-n % 8 if version == 1 else 0)
    dtype = _dtype(parts[1])
    if dtype and len(d) >= at + np.dtype(dtype).itemsize:
        yield parts[0].split(b"\0")[0].decode("utf-8", "replace"), float(np.frombuffer(d, dtype, 1, at)[0])
