"""Benchmark decontamination: passages within a small edit distance of a benchmark item, found in whole documents.

Texts are sequences of words (ASCII letters lower-cased). An item of n words allows k = floor(n * max_edit) word edits.

1. Which item-sized windows can hold the item: of its first k + 2 pieces of floor(n / (k + 2)) words, two must stand in the
   text unchanged, with no more than k words between the places where they put the item's begin (pigeonhole; items too short
   for that have k + 1 pieces, of which one must stand there). And of the n + 2k words around, at least n - k must be words
   of the item. These conditions are necessary, so nothing within the distance is lost here, and a piece that many items
   share (a question's usual beginning) makes no windows by itself.
2. Windows of n words, at each of the 2k + 1 starts that the edits allow, go through a CGK random walk: 3n steps, each
   writing the word under the pointer and moving it by a bit hashed from step and word. Edit distance becomes Hamming
   distance; sampled positions of the walk form a key, and a window is a candidate for the items with an equal key in any
   repeat. Each length of item has as many repeats as its simulated edits need to reach ``recall``.
3. Candidates are verified by exact edit distance to the best substring around the window.

The benchmark is a stated set of queries; where it exceeds ``block_items`` it goes over the documents in blocks.

Defined cases: null or empty texts and items match nothing; very long texts and items are searched whole; repeated rows are
each searched; items with equal texts are each told; of equally near passages the first is told; an empty table on either
side gives an empty result; the documents' other columns are not read by :func:`matches` and kept by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, U64, mix, slices, text_bytes, windows, word_hashes
from .scratch import small_batches


@dataclass(frozen=True)
class Search:
    max_edit: float = 0.15
    recall: float = 0.999
    samples: int = 3
    #: Simulated passages for each length of item; they set its number of repeats and decide no match.
    simulated: int = 400
    seed: int = 7
    block_items: int = 20_000


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, at = text_bytes(column)
    return word_hashes(LOWER[raw], at)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of ``item`` to a substring of ``text``, and where the first such substring ends."""
    m = len(text)
    row = np.zeros(m + 1, np.int64)
    step = np.arange(m + 1)
    for i, w in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(np.append(i, new) - step) + step
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """The items' pieces and keys, built on the driver from their word hashes and sent with the tasks."""

    def __init__(self, items: list[tuple[int, list[int]]], p: Search):
        self.p = p
        self.ids = [i for i, _ in items]
        self.words = [np.array(w, U64) for _, w in items]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.floor(self.size * p.max_edit + 1e-9).astype(np.int64)
        self.keys: dict[int, tuple] = {}
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            keys = self.embed(np.stack([self.words[j] for j in own]), self.fitted(n, own))
            self.keys[n] = (own, [(np.argsort(k, kind="stable"), np.sort(k)) for k in keys])
        self.needed = np.where((self.size >= 2 * (self.edits + 2)) & (self.edits > 0), 2, 1)
        count = self.edits + self.needed
        length = self.size // count
        self.pieces: dict[int, tuple] = {}
        for q in np.unique(length).tolist():
            hashes, item, offset = [], [], []
            for j in np.flatnonzero(length == q).tolist():
                for o in range(0, q * int(count[j]), q):
                    h, _ = windows(self.words[j][o : o + q], np.zeros(q, np.int64), q)
                    hashes.append(h[0])
                    item.append(j)
                    offset.append(o)
            order = np.argsort(np.array(hashes, U64), kind="stable")
            h = np.array(hashes, U64)[order]
            seen = np.zeros(1 << 20, bool)
            seen[(h >> U64(44)).astype(np.int64)] = True
            self.pieces[q] = (h, np.array(item, np.int64)[order], np.array(offset, np.int64)[order], seen)
        self.vocabulary = [np.unique(w) for w in self.words]

    def embed(self, x: np.ndarray, repeats: int) -> np.ndarray:
        """Keys (repeat, window) of windows (window, word); all repeats walk side by side. Which steps a repeat samples, and
        how each moves the pointer, follows from seed, repeat and step."""
        count, n = x.shape
        x = np.concatenate([x, np.zeros((count, 1), U64)], axis=1)  # past the end: a blank
        repeat = np.arange(repeats, dtype=U64)[:, None]
        salt = mix(U64(self.p.seed))
        at = mix(salt ^ (repeat << U64(8)) ^ np.arange(self.p.samples, dtype=U64)) % U64(3 * n)
        sampled: dict[int, list[int]] = {}
        for r, row in enumerate(np.sort(at.astype(np.int64), axis=1).tolist()):
            for j in row:
                sampled.setdefault(j, []).append(r)
        pointer = np.zeros((repeats, count), np.int64)
        key = np.zeros((repeats, count), U64)
        rows = np.arange(count)
        for j in range(int(at.max()) + 1):
            w = x[rows, pointer]
            for r in sampled.get(j, ()):
                key[r] = mix(key[r] + w[r] + U64(j))
            odd = mix(~salt ^ (repeat << U64(32)) ^ U64(j)) | U64(1)
            pointer = np.minimum(pointer + ((w * odd) >> U64(63)).astype(np.int64), n)
        return key

    def fitted(self, n: int, own: np.ndarray) -> int:
        """Repeats after which ``recall`` of simulated passages of items of ``n`` words, with the most edits allowed, have met
        their item; tried with twice as many until that is reached."""
        k = int(self.edits[own[0]])
        if not k:
            return 1
        rng = np.random.default_rng([self.p.seed, n])
        chosen = [int(j) for j in rng.choice(own, self.p.simulated)]
        passages = []
        for j in chosen:
            w = self.words[j].tolist()
            for _ in range(k):
                at, kind = int(rng.integers(len(w))), int(rng.integers(3))
                if kind == 0:
                    w[at] = int(rng.integers(1 << 62))
                elif kind == 1:
                    w.insert(at, int(rng.integers(1 << 62)))
                elif len(w) > 1:
                    del w[at]
            passages.append((w + [int(x) for x in rng.integers(1 << 62, size=n)])[:n])  # the window goes on into the text behind
        repeats = 16
        while True:
            a = self.embed(np.stack([self.words[j] for j in chosen]), repeats)
            b = self.embed(np.array(passages, U64), repeats)
            met = np.where((a == b).any(axis=0), (a == b).argmax(axis=0) + 1, 1 << 30)
            found = int(np.quantile(met, self.p.recall, method="higher"))
            if found <= repeats:
                return found
            if repeats >= 1 << 14:
                raise ValueError(f"items of {n} words with {k} edits don't meet a recall of {self.p.recall} with {repeats} repeats")
            repeats *= 2

    def places(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, start and row of every place where the pieces allow the item to begin."""
        found: list[tuple[np.ndarray, ...]] = []
        for q, (piece, item, offset, seen) in self.pieces.items():
            if len(h) < q:
                continue
            # windows() leaves out those over a row's end: here positions are needed too
            whole = np.flatnonzero(row[: len(h) - q + 1] == row[q - 1 :])
            g, _ = windows(h, row, q)
            near = np.flatnonzero(seen[(g >> U64(44)).astype(np.int64)])
            if not len(near):
                continue
            g, pos = g[near], whole[near]
            lo, hi = np.searchsorted(piece, g, "left"), np.searchsorted(piece, g, "right")
            n = hi - lo
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            pos = np.repeat(pos, n)
            found.append((item[at], pos - offset[at], row[pos], offset[at]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        item, start, of, offset = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, of, item))
        item, start, of, offset = item[order], start[order], of[order], offset[order]
        keep = self.needed[item] == 1
        # two pieces of one item whose begins are at most k words apart: neighbours in this order, as equal pieces follow
        # each other by at least a piece's length wherever they don't overlap themselves
        step = 1
        while True:
            same = (item[step:] == item[:-step]) & (of[step:] == of[:-step]) & (start[step:] - start[:-step] <= self.edits[item[step:]])
            if not same.any():
                break
            two = np.flatnonzero(same & (offset[step:] != offset[:-step]))
            keep[two] = keep[two + step] = True
            step += 1
        return item[keep], start[keep], of[keep]

    def search(self, h: np.ndarray, row: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(row, item) -> (distance, last word of the passage in its row) for the words of some texts."""
        first = np.searchsorted(row, np.arange(int(row[-1]) + 2 if len(row) else 1))
        item, begin, of = self.places(h, row)
        spans = sorted({*zip(item.tolist(), begin.tolist(), of.tolist())})
        by_size: dict[int, set] = {}
        for j, start, r in spans:
            n, k = int(self.size[j]), int(self.edits[j])
            a, b = max(first[r], start - k), min(first[r + 1], start + n + k)
            if b - a < n - k or np.isin(h[a:b], self.vocabulary[j]).sum() < n - k:
                continue
            by_size.setdefault(n, set()).update((x, r) for x in range(max(int(first[r]), start - k), start + k + 1) if x < first[r + 1])
        pairs: set[tuple[int, int, int]] = set()
        for n, starts in by_size.items():
            place = sorted(starts)
            at = np.array([x for x, _ in place])[:, None] + np.arange(n)
            end = np.array([first[r + 1] for _, r in place])[:, None]
            x = np.where(at < end, h[np.minimum(at, len(h) - 1)], U64(0))
            own, tables = self.keys[n]
            for keys, (order, known) in zip(self.embed(x, len(tables)), tables):
                lo, hi = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                for i in np.flatnonzero(hi > lo).tolist():
                    pairs.update((place[i][1], int(own[order[t]]), place[i][0]) for t in range(lo[i], hi[i]))
        out: dict[tuple[int, int], tuple[int, int]] = {}
        spread: dict[tuple[int, int], list[int]] = {}
        for r, j, start in sorted(pairs):
            spread.setdefault((r, j), []).append(start)
        for (r, j), starts in spread.items():
            n, k = int(self.size[j]), int(self.edits[j])
            done = -1
            for i, start in enumerate(starts):  # starts that follow each other closely share one verification
                if start <= done:
                    continue
                last = max(x for x in starts[i:] if x <= start + 2 * k)
                done = last
                a, b = max(int(first[r]), start - k), min(int(first[r + 1]), last + n + k)
                d, end = edit_distance(self.words[j], h[a:b])
                if d <= k:
                    out[r, j] = min(out.get((r, j), (k + 1, 0)), (d, a + end - int(first[r])))
        return out


def item_words(benchmark: DataFrame, item: str, text: str) -> list[tuple[int, list[int]]]:
    rows = benchmark.select(F.col(item), F.col(text)).where(F.col(text).isNotNull()).orderBy(item, text).collect()
    out = []
    for r in rows:
        h, _ = words(pa.array([r[1]], pa.string()))
        if len(h):
            out.append((r[0], h.tolist()))
    return out


def blocks(benchmark: DataFrame, p: Search, item: str, text: str) -> Iterator[list[tuple[int, list[int]]]]:
    """The items in blocks of about ``block_items``; one block for any usual benchmark."""
    n = -(-benchmark.count() // p.block_items)
    for b in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64(item), F.lit(n)) == b)
        yield item_words(part, item, text)


def matches(docs: DataFrame, benchmark: DataFrame, p: Search = Search(), text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance in words, and the passage's last word."""
    schema = "doc_id long, item_id long, distance long, end_word long"
    small_batches(docs.sparkSession)
    out = None
    for block in blocks(benchmark, p, item, text):
        if not block:
            continue

        def run(batches: Iterator[pa.RecordBatch], index=Index(block, p)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in slices(b, "text"):
                    keys = s.column("doc_id").to_pylist()
                    got = [(keys[r], index.ids[j], d, e) for (r, j), (d, e) in sorted(index.search(*words(s.column("text"))).items())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*got) if got else [[]] * 4)], ["doc_id", "item_id", "distance", "end_word"])

        one = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def holds(index: Index):
    """Arrow function: text -> whether it holds an item of the index."""

    @F.arrow_udf("boolean")
    def leaks(x: pa.Array) -> pa.Array:
        found = np.zeros(len(x), bool)
        batch, at = pa.RecordBatch.from_arrays([x.cast(pa.string())], ["text"]), 0
        for s in slices(batch, "text"):
            for r, _ in index.search(*words(s.column("text"))):
                found[at + r] = True
            at += s.num_rows
        return pa.array(found)

    return leaks


def clean(docs: DataFrame, benchmark: DataFrame, p: Search = Search(), text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents without any item, with their columns as they came. No join: each text is searched where it is read."""
    small_batches(docs.sparkSession)
    for block in blocks(benchmark, p, item, text):
        if not block:
            continue
        docs = docs.where(~holds(Index(block, p))(F.col(text)))
    return docs
