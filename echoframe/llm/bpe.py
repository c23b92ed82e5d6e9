"""Byte-level BPE as a monoid: halves are encoded on their own and joined at the seam.

A text longer than a leaf is cut in the middle, wherever that falls. Two encoded neighbours are joined by re-encoding a
window around the seam. The window grows until it begins and ends at positions where the splitting pattern must begin a
match whatever stands around: a single space between two characters that aren't white space. No alternative of the pattern
goes from a non-space on to a space, so a match ends there; none looks behind, so the next begins afresh; and the only
look-ahead is for white space, which doesn't end there. Tokens outside the window are therefore those of the whole text.
Decoding concatenates the halves' bytes up the same tree.

Defined cases: a null or empty text has no tokens; very long texts are encoded whole; repeated rows are each encoded; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices
from .scratch import small_batches

LEAF = 4096
WINDOW = 32

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The ranks of a file with the public splitting pattern; loaded once per worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def is_sync(t: str, p: int) -> bool:
    return t[p] == " " and not t[p - 1].isspace() and not t[p + 1].isspace()


def sync_before(t: str, lo: int, p: int) -> int:
    """The last sync position in (lo, p], or lo, where the text on this side begins."""
    while p > lo and not (p + 1 < len(t) and is_sync(t, p)):
        p -= 1
    return p


def sync_after(t: str, p: int, hi: int) -> int:
    """The first sync position in [p, hi), or hi, where the text on this side ends."""
    while p < hi and not (p + 1 < hi and is_sync(t, p)):
        p += 1
    return p


class Tree:
    def __init__(self, leaf, size: int = LEAF, window: int = WINDOW):
        self.leaf, self.size, self.window = leaf, size, window

    def encode(self, t: str) -> list[int]:
        return self.span(t, 0, len(t))

    def span(self, t: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.size:
            return self.leaf(t[lo:hi])
        mid = (lo + hi) // 2
        return self.join(t, lo, mid, hi, self.span(t, lo, mid), self.span(t, mid, hi))

    def join(self, t: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        a = sync_before(t, lo, max(lo, mid - self.window))
        b = sync_after(t, min(hi, mid + self.window), hi)
        tail = len(self.leaf(t[a:mid]))  # of the left half's tokens, those inside the window
        head = len(self.leaf(t[mid:b]))
        return left[: len(left) - tail] + self.leaf(t[a:b]) + right[head:]

    def decode(self, ids: list[int], leaf) -> bytes:
        if len(ids) <= self.size:
            return leaf(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def encoded(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per document: key, n_tokens, a digest of the ids and one of the bytes they decode to; with ``ids`` also the
    ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        tree = Tree(enc.encode_ordinary)
        names = [str(i) for i in range(enc.n_vocab)]
        for b in batches:
            for s in slices(b, "text", 1 << 20):
                n, sha, back, out = [], [], [], []
                for v in s.column("text"):
                    got = tree.encode(v.as_py() or "")
                    n.append(len(got))
                    sha.append(hashlib.sha256(",".join([names[i] for i in got]).encode()).hexdigest())
                    back.append(hashlib.sha256(tree.decode(got, enc.decode_bytes)).hexdigest())
                    if ids:
                        out.append(np.array(got, np.int32))
                columns = [s.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if ids:
                    bounds = np.append(0, np.cumsum(n)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(out))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
