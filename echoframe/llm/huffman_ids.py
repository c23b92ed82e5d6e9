"""Token ids in a compact file: canonical length-limited Huffman codes from global counts.

Format: a folder with two Parquet tables. ``header`` has one row: the code length of each id (0: not used). ``blocks`` has
rows of whole documents in ascending doc_id order by (part, seq): the documents' ids and token counts, the bit offset of
every ``STRIDE``-th token of each document in the block's payload, and the payload. Every document begins on a byte, every
block can be read alone, and a checkpoint lets a reader begin inside a document. Codes are canonical: ordered by length,
then id, so the lengths say everything. Decoding looks up the next ``limit`` bits in one table, for all checkpoints of a
batch side by side.

Encoding with a vocabulary is done per unit: texts are cut before single spaces, and around other single white-space
bytes, between characters that aren't white space, where byte-level splitting ends and begins a piece in any case. Units
are looked up by 64-bit hashes and compared byte by byte before ids are used again; a unit that a worker hasn't met, or whose
hash another unit has, is encoded by the tokenizers library, many at once with line feeds between them, and the units' ids
are put together by position.

Defined cases: a null or empty text has only the end id; a very long text is encoded whole and has a block of its own;
repeated doc_ids stand side by side, ordered by their token ids; a null doc_id comes first; an empty table gives an empty
result; columns other than the key and the text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import SEPARATOR, differing, slices, span_hashes, text_bytes
from .scratch import Tables, new_path, small_batches

LIMIT = 16
STRIDE = 128
BLOCK_TOKENS = 1 << 18
#: Units that a worker keeps, and their bytes.
CACHE, CACHE_BYTES = 1_500_000, 32 << 20
END = 2

_tokenizers: dict[str, object] = {}
_units: dict[str, "Units"] = {}


def tokenizer(path: str):
    """A vocabulary file's encoder; loaded once per worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _units[path] = Units()
    return _tokenizers[path]


class Units:
    """Bytes and ids of units by hash, as sorted arrays."""

    def __init__(self):
        self.hash, self.start, self.size, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)
        self.begin, self.bytes, self.raw = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint8)
        self.uses = np.empty(0, np.uint16)  # slices that had the unit

    def missing(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hash, h)
        return (at == len(self.hash)) | (self.hash[np.minimum(at, len(self.hash) - 1)] != h) if len(self.hash) else np.ones(len(h), bool)

    def add(self, h: np.ndarray, size: np.ndarray, flat: np.ndarray, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Ascending hashes that are missing, with their ids one after the other and their spans in ``raw``."""
        at = np.searchsorted(self.hash, h)
        self.start = np.insert(self.start, at, len(self.flat) + np.cumsum(size) - size)
        self.begin = np.insert(self.begin, at, len(self.raw) + np.cumsum(e - s) - (e - s))
        self.uses = np.insert(self.uses, at, 0)
        self.size, self.bytes, self.hash = np.insert(self.size, at, size), np.insert(self.bytes, at, e - s), np.insert(self.hash, at, h)
        self.flat, self.raw = np.concatenate([self.flat, flat]), np.concatenate([self.raw, take_ragged(raw, s, e - s)])


    def used(self, place: np.ndarray) -> None:
        self.uses[place] = np.minimum(self.uses[place], 60_000) + 1

    def thin(self) -> None:
        """Drops the units that one slice had, and more while over half of the room is taken; what is left counts half."""
        if len(self.hash) <= CACHE and len(self.raw) <= CACHE_BYTES:
            return
        least = 2
        while (keep := self.uses >= least).sum() > CACHE // 2 or self.bytes[keep].sum() > CACHE_BYTES // 2:
            least *= 2
        self.flat, self.raw = take_ragged(self.flat, self.start[keep], self.size[keep].astype(np.int64)), take_ragged(self.raw, self.begin[keep], self.bytes[keep].astype(np.int64))
        self.hash, self.size, self.bytes, self.uses = self.hash[keep], self.size[keep], self.bytes[keep], self.uses[keep] // 2
        self.start, self.begin = (np.cumsum(n, dtype=np.int64) - n for n in (self.size, self.bytes))


def unit_cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions where units begin: the rows' bounds, and around single white space between other characters."""
    n = len(raw)
    row = np.zeros(n + 1, bool)
    row[at] = True
    if n > 2:
        # bytes that may end or begin a white-space character beyond ASCII count as white space: too few cuts are harmless
        blank = SEPARATOR[raw] | ((raw >= 28) & (raw <= 31)) | (raw == 0x85) | (raw == 0xA0)
        tail = np.zeros(n, bool)
        tail[2:] = (raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3)  # the last byte of U+1000-U+3FFF
        lead = (raw >= 0xE1) & (raw <= 0xE3) | (raw == 0xC2)
        alone = np.zeros(n + 1, bool)
        alone[1 : n - 1] = SEPARATOR[raw[1:-1]] & ~(blank | tail)[:-2] & ~(blank | lead)[2:]
        alone[1 : n - 1] &= ~row[1 : n - 1] & ~row[2:n]
        row |= alone
        row[1:] |= alone[:-1] & (raw != 32)  # white space but a space is a piece of its own
    row[n] = False
    return np.flatnonzero(row)


def take_ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[start[i]:start[i]+length[i]], one after the other."""
    ends = np.cumsum(length)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)
    return flat[index]


def encode_units(t, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each unit, and all ids in the units' order."""
    feed = t.encode("\n", add_special_tokens=False).ids
    feeds = np.append(0, np.cumsum(SEPARATOR[raw] & (raw != 32)))
    odd = SEPARATOR[raw] | ((raw >= 28) & (raw <= 31)) | (raw == 0x85) | (raw == 0xA0) | (raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3))
    spaces = np.append(0, np.cumsum(odd))  # and bytes that may belong to other white space
    # between line feeds a unit is read as if alone, if it has no white space but a space at its beginning
    plain = (feeds[e] == feeds[s]) & (spaces[e] - spaces[s] == (raw[s] == 32)) & (e - s > 1) if len(feed) == 1 else np.zeros(len(s), bool)
    size, parts = np.zeros(len(s), np.int64), {}
    own = np.flatnonzero(~plain)
    for i, x in zip(own.tolist(), t.encode_batch_fast([raw[a:b].tobytes().decode() for a, b in zip(s[own].tolist(), e[own].tolist())], add_special_tokens=False)):
        parts[i] = x.ids
        size[i] = len(x.ids)
    many = np.flatnonzero(plain)
    got = []
    if len(many):
        length = e[many] - s[many] + 1
        text = np.full(int(length.sum()), 10, np.uint8)
        inside = np.ones(len(text), bool)
        inside[np.cumsum(length) - 1] = False
        text[inside] = take_ragged(raw, s[many], length - 1)
        ends = np.cumsum(length)
        cuts = np.append(0, ends[np.append(np.flatnonzero(np.diff(ends // 65536)), len(ends) - 1)])
        pieces = [text[a:b].tobytes().decode() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        got = np.concatenate([np.array(x.ids, np.uint32) for x in t.encode_batch_fast(pieces, add_special_tokens=False)])
        stop = np.flatnonzero(got == feed[0])
        size[many] = np.diff(np.append(-1, stop)) - 1
        got = got[got != feed[0]]
    out = np.empty(int(size.sum()), np.uint32)
    mine = np.repeat(plain, size)
    out[mine] = got
    if parts:
        out[~mine] = np.concatenate([np.array(parts[i], np.uint32) for i in own.tolist()])
    return size, out


def encode_texts(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and each text's number of ids."""
    t = tokenizer(path)
    raw, at = text_bytes(column)
    s = unit_cuts(raw, at)
    if not len(s):
        return np.empty(0, np.uint32), np.zeros(len(column), np.int64)
    e = np.append(s[1:], len(raw))
    h, first, back = np.unique(span_hashes(raw, s, e), return_index=True, return_inverse=True)
    known = _units[path]
    known.thin()
    new = known.missing(h)
    if new.any():
        known.add(h[new], *encode_units(t, raw, s[first[new]], e[first[new]]), raw, s[first[new]], e[first[new]])
    place = np.searchsorted(known.hash, h)
    known.used(place)
    begin, n, flat = known.start[place][back], known.size[place][back].astype(np.int64), known.flat
    # a unit whose bytes aren't those that its hash stands for, in this slice or among the known ones, is encoded anew
    again = np.flatnonzero(first[back] != np.arange(len(s)))
    mine = first[back[again]]
    odd = np.zeros(len(s), bool)
    odd[again] = differing(raw, s[again], e[again], raw, s[mine], e[mine])
    old = np.flatnonzero(~new)
    met = np.zeros(len(h), bool)
    met[old] = differing(raw, s[first[old]], e[first[old]], known.raw, known.begin[place[old]], known.begin[place[old]] + known.bytes[place[old]])
    odd |= met[back]
    if odd.any():
        size, more = encode_units(t, raw, s[odd], e[odd])
        begin[odd], n[odd] = len(flat) + np.cumsum(size) - size, size
        flat = np.concatenate([flat, more])
    of = np.searchsorted(at, s, "right") - 1
    return take_ragged(flat, begin, n), np.bincount(of, n, len(column)).astype(np.int64)


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(n), end), n + 1


def token_table(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", end: int = END) -> DataFrame:
    """doc_id, n and the ids (little-endian, 16 bits each while the vocabulary allows) of each document with its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                ids, n = with_end(*encode_texts(s.column("text"), path), end)
                wide = tokenizer(path).get_vocab_size() > 65536
                width = 4 if wide else 2
                bounds = np.append(0, np.cumsum(n) * width).astype(np.int64)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4" if wide else "<u2"))])
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(n), data.cast(pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def ids_of(column: pa.Array, n: np.ndarray) -> np.ndarray:
    raw = b"".join(x.as_buffer() for x in column)
    width = len(raw) // max(1, int(n.sum()))
    return np.frombuffer(raw, "<u4" if width == 4 else "<u2").astype(np.uint32)


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id in the whole table; the vocabulary bounds what comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(ids_of(b.column("ids"), b.column("n").to_numpy()))
            if len(c) > len(total):
                c, total = total, c
            total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "c"])

    rows = tokens.select("n", "ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r.id] = r.c
    return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by merging packages level by level; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    used = used[np.argsort(counts[used], kind="stable")]
    w = counts[used].astype(np.float64)
    leaf, levels = np.arange(len(used)), []
    value, kind = w, leaf
    for _ in range(limit - 1):
        levels.append(kind)
        m = len(value) // 2
        pairs = value[: 2 * m : 2] + value[1 : 2 * m : 2]
        value = np.concatenate([w, pairs])
        kind = np.concatenate([leaf, np.full(m, -1)])
        order = np.argsort(value, kind="stable")
        value, kind = value[order], kind[order]
    levels.append(kind)
    length = np.zeros(len(used), np.int64)
    take = 2 * len(used) - 2
    for kind in reversed(levels):
        chosen = kind[:take]
        length[chosen[chosen >= 0]] += 1
        take = 2 * int((chosen < 0).sum())
    out[used] = length
    return out


class Code:
    """The canonical code of given lengths, as an encoding and a decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.length = lengths.astype(np.int64)
        self.limit = max(1, int(self.length.max(initial=1)))
        used = np.flatnonzero(self.length)
        used = used[np.argsort(self.length[used], kind="stable")]
        span = np.int64(1) << (self.limit - self.length[used])
        first = np.cumsum(span) - span
        self.code = np.zeros(len(lengths), np.uint64)
        self.code[used] = (first >> (self.limit - self.length[used])).astype(np.uint64)
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        filled = np.repeat(used, span)
        self.symbol[: len(filled)] = filled
        self.steps = np.ones(1 << self.limit, np.int64)
        self.steps[: len(filled)] = self.length[filled]

    def pack(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all documents, each from a byte on; their byte bounds; checkpoints in bits from the document's start,
        and their number for each document."""
        bits = self.length[ids]
        end = np.cumsum(bits)
        doc_end = np.append(0, end)[np.cumsum(n)]
        doc_bits = np.diff(np.append(0, doc_end))
        size = (doc_bits + 7) // 8
        bounds = np.append(0, np.cumsum(size))
        inside = end - bits - np.repeat(doc_end - doc_bits, n)
        pos = inside + np.repeat(bounds[:-1] * 8, n)
        word, off = pos >> 6, pos & 63
        out = np.zeros((int(bounds[-1]) + 7) // 8 + 2, np.uint64)
        code = self.code[ids]
        room = 64 - off - bits
        over = np.flatnonzero(room < 0)
        part = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        at = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)
        if len(at):
            out[word[at]] = np.add.reduceat(part, at)
            out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        begin = np.cumsum(n) - n
        marks = -(-n // STRIDE)
        where = np.repeat(begin, marks) + STRIDE * (np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks))
        return out.astype(">u8").view(np.uint8)[: int(bounds[-1])], bounds, inside[where].astype(np.uint32), marks

    def unpack(self, data: np.ndarray, lane: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Ids of all lanes, one lane after the other: lane i begins at bit lane[i] and has n[i] ids."""
        if not len(n):
            return np.empty(0, np.uint32)
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        ahead = np.zeros(len(padded) - 4, np.uint64)
        for k in range(5):
            ahead |= padded[k : len(padded) - 4 + k] << np.uint64(8 * (4 - k))
        order = np.argsort(-n, kind="stable")
        pos = lane[order].astype(np.int64)
        to = (np.cumsum(n) - n)[order]
        live = np.searchsorted(-n[order], -np.arange(int(n.max())), "left")  # lanes with more than k ids
        out = np.empty(int(n.sum()), np.uint32)
        shift, mask = np.int64(40 - self.limit), np.uint64((1 << self.limit) - 1)
        for k in range(int(n.max())):
            m = int(live[k])
            p = pos[:m]
            v = (ahead[p >> 3] >> (shift - (p & 7)).astype(np.uint64)) & mask
            out[to[:m] + k] = self.symbol[v]
            p += self.steps[v]
        return out


def lanes(n: np.ndarray, marks: np.ndarray, bits: np.ndarray, byte_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bit and number of ids of every checkpoint's lane."""
    place = np.arange(len(bits)) - np.repeat(np.cumsum(marks) - marks, marks)
    return np.repeat(byte_start * 8, marks) + bits, np.minimum(STRIDE, np.repeat(n, marks) - STRIDE * place)


BLOCKS = "part int, seq int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, doc_bytes array<long>, marks binary, payload binary"


def write(tokens: DataFrame, path: str) -> None:
    """Write the file format's two tables for a table of :func:`token_table`'s form."""
    spark = tokens.sparkSession
    lengths = code_lengths(id_counts(tokens))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/header")

    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq, first = Code(lengths), TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            n = np.concatenate([h.column("n").to_numpy() for h in held])
            ids = np.concatenate([ids_of(h.column("ids"), h.column("n").to_numpy()) for h in held])
            data, bounds, bits, _ = code.pack(ids, n)
            row = (part, seq, first, size, [k for h in held for k in h.column("doc_id").to_pylist()], n.tolist(), np.diff(bounds).tolist(), bits.astype("<u4").tobytes(), data.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for b in batches:
            ends = np.cumsum(b.column("n").to_numpy()) + size
            cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK_TOKENS, prepend=size // BLOCK_TOKENS)) + 1).tolist()]
            for x, y in zip(cuts, cuts[1:]):  # a block ends with the document that fills it
                held.append(b.slice(x, y - x))
                size = sum(int(h.column("n").to_numpy().sum()) for h in held)
                yield out()
                seq, first, held, size = seq + 1, first + size, [], 0
            if cuts[-1] < b.num_rows:
                held.append(b.slice(cuts[-1]))
                size += int(held[-1].column("n").to_numpy().sum())
        if held:
            yield out()

    tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(block, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row per document of the file: doc_id, start (ids of all documents before it), n_tokens, crc32 of its ids as
    little-endian 32-bit integers; with ``ids`` also the ids."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/header").first().lengths, np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # as many as files
    base, total = {}, 0
    for p, n in parts:
        base[p], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for b in batches:
            for r in b.to_pylist():
                n, size = np.array(r["doc_tokens"], np.int64), np.array(r["doc_bytes"], np.int64)
                lane, length = lanes(n, -(-n // STRIDE), np.frombuffer(r["marks"], "<u4").astype(np.int64), np.cumsum(size) - size)
                got = code.unpack(np.frombuffer(r["payload"], np.uint8), lane, length).astype("<u4")
                raw, ends = got.tobytes(), np.cumsum(n)
                begin = ends - n
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begin.tolist(), ends.tolist())]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(begin + base[r["part"]] + r["first_token"]), pa.array(n), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.array([got[x:y] for x, y in zip(begin.tolist(), ends.tolist())], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode, write the file in the shared folder, and read it back."""
    spark = docs.sparkSession
    small_batches(spark)
    out = new_path(spark, "huffman-ids")
    with Tables(spark, "huffman") as t:
        write(t.put(token_table(docs, path, text, key), "token-ids"), out)
    return read(spark, out)
