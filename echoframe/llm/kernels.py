"""NumPy helpers over the bytes of Arrow string columns, used inside Spark's Arrow tasks.

A batch is cut into slices of a few MB of text, so that memory is bounded by the slice or by the longest single text.
Hashes chain a bit mix over blocks of 8 bytes, and over words by odd multipliers of their own, so no structure of a text
(such as two letters in the order of Thue and Morse, where polynomials modulo 2**64 meet) makes two of them equal. They are
no guard against somebody who looks for two equal ones; where that would give a wrong result, bytes are compared.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 3 << 20
_LIBC = ctypes.CDLL(None)

#: Bytes between words: space and 0x09-0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes outside terms, which are runs of ASCII letters and digits and of all that is not ASCII.
BETWEEN_TERMS = np.zeros(256, bool)
BETWEEN_TERMS[:128] = True
BETWEEN_TERMS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):  # products are meant modulo 2**64
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def tidy() -> None:
    """Gives memory that is free back to the system: workers live from job to job, and what one needed for a moment would stay
    with it beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` of about ``limit`` bytes of text each; every row is in exactly one."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes + 16) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    tidy()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' bounds in them (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, between: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``, or of every run without the bytes of ``between``."""
    n = len(raw)
    if not n:
        return (np.empty(0, np.int64),) * 3
    inside = ~between[raw]
    first = np.zeros(n + 1, bool)
    first[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside
    ends = inside & np.append(~inside[1:] | first[1:n], True)
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(at, s, "right") - 1


#: Bytes of a span that are hashed in blocks side by side with other spans; longer spans are rare and go one by one.
LONG = 64
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)  # masks of the first k bytes of a block


def span_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    ahead = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each position on
    size = e - s
    h = mix(size.astype(U64) ^ U64(BASE))
    live, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        h[live] = mix(h[live] ^ (ahead[s[live] + k] & _FIRST[np.minimum(size[live] - k, 8)]))
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[s[i] : e[i]], digest_size=8).digest(), "little")
    return h


def differing(raw: np.ndarray, s: np.ndarray, e: np.ndarray, other: np.ndarray, t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Whether the spans [s, e) of ``raw`` and [t, f) of ``other`` have different bytes."""
    a, b = (np.ndarray(len(x) + 1, "<u8", np.concatenate([x, np.zeros(8, np.uint8)]), strides=(1,)) for x in (raw, other))
    size = e - s
    out = size != f - t
    live, k = np.flatnonzero(~out & (size > 0) & (size <= LONG)), 0
    while len(live):
        out[live] |= ((a[s[live] + k] ^ b[t[live] + k]) & _FIRST[np.minimum(size[live] - k, 8)]) != 0
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(~out & (size > LONG)).tolist():
        out[i] = not np.array_equal(raw[s[i] : e[i]], other[t[i] : f[i]])
    return out


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    s, e, row = word_spans(raw, at)
    return span_hashes(raw, s, e), row


def term_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z as a-z."""
    low = LOWER[raw]
    s, e, row = word_spans(low, at, BETWEEN_TERMS)
    return span_hashes(low, s, e), row


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``n`` words inside one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    out = np.zeros(m, U64)
    for k, odd in enumerate(multipliers(n)):
        out += hashes[k : k + m] * odd
    keep = row[:m] == row[n - 1 :]
    return mix(out[keep]), row[:m][keep]


def multipliers(n: int) -> np.ndarray:
    """``n`` odd numbers, one for each place of a run."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(BASE)) | U64(1)


def sequence_hashes(h: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row's words in their order; ``size`` has the words of each row."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    total = np.append(U64(0), np.cumsum(mix(h ^ mix(place.astype(U64) + U64(salt << 40)))))
    ends = np.cumsum(size)
    return mix(total[ends] - total[ends - size] + size.astype(U64))


def crc_of_id(doc_id: int | None) -> int:
    """crc32 of the id as decimal text; a null id counts as the empty text."""
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
