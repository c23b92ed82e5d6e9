"""Ranked lexical search: an inverted index in blocks of documents, searched by a hybrid of both orders of evaluation.

``index`` reads the texts once. A block is a run of documents with about ``BLOCK_BYTES`` of text; for each of its terms the
index has one row with the documents (by their place in the block) and the term's occurrences in them, and for each block one
row with the documents' ids and lengths. ``search`` reads the rows of the queries' terms, block by block:

- term at a time: the short lists of a query are summed into one accumulator, sorted by document, which from then on is an
  iterator like any other whose largest sum is its bound;
- document at a time: windows of documents go by in order. Lists whose bounds together stay below the query's last kept score
  can't bring a document in by themselves; documents come from the other lists only, and the rest are looked up by skips, in
  falling order of their bounds, for the documents that can still get in.

A task keeps a query's best documents from block to block, so that later blocks skip more. Scores are whole numbers and exact.

The score is that of ``weights`` and ``parts``: w * ((10**9 * tf) div (1000 * tf + 12 * m)), summed over the query's terms with
repeats, with m = 75 + (25 * n * N) div L and w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

Terms are the runs of ASCII letters and digits and of all code points above 0x7F, A-Z as a-z; the index tells them apart by
64-bit hashes (ten thousand query terms meet one of ten billion others with a probability of about 5e-6).

Defined cases: null and empty texts and texts without terms are no documents of the index and match nothing; a query without
terms gets no row; a text of any length is taken whole (a block of its own where it is longer than one); equal scores go by
ascending doc_id, a null id first; repeated rows are documents each, and rows of queries are queries each, also where their
ids are equal; empty tables give an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import slices, term_hashes, text_bytes
from .scratch import Tables, small_batches

#: Text of a block; what a task holds is in proportion to it.
BLOCK_BYTES = 16 << 20
#: Lists of at most so many documents of a block are summed first.
SHORT = 64
#: Documents of a window.
WINDOW = 4096
#: Queries that are searched at once; further ones read the index again.
QUERIES_AT_ONCE = 20_000
#: Terms of queries that are sent to every task; more are joined by a shuffle.
BROADCAST_TERMS = 500_000
#: Stands for a null id, which comes first among equal scores.
NO_ID = np.iinfo(np.int64).min


@dataclass
class Index:
    """Postings (block, term, n, docs, tfs), blocks (block, ids, sizes) and the corpus's number of documents and of terms."""

    postings: DataFrame
    blocks: DataFrame
    docs: int
    terms: int


def index(docs: DataFrame, tables: Tables, text: str = "text", key: str = "doc_id") -> Index:
    """The index of all documents of ``docs``, written to ``tables``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for s in slices(b, "text"):
                raw, at = text_bytes(s.column("text"))
                h, row = term_hashes(raw, at)
                if not len(h):
                    continue
                held.append((s.column("id").fill_null(NO_ID).to_numpy(), *_occurrences(h, row), np.bincount(row, minlength=len(s))))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield from _block(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield from _block(block, held)

    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(build, "block long, term long, n int, a binary, b binary, kind int")
    out = tables.put(rows, "index", by="kind")
    blocks = out.where("kind = 0").select("block", F.col("term").alias("terms"), "n", F.col("a").alias("ids"), F.col("b").alias("sizes"))
    total = blocks.agg(F.sum("n").alias("n"), F.sum("terms").alias("l")).first()
    postings = out.where("kind = 1").select("block", "term", "n", F.col("a").alias("docs"), F.col("b").alias("tfs"))
    return Index(postings, blocks, total.n or 0, total.l or 0)


def _occurrences(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different term of each row, with its occurrences, by term and then row."""
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
    return h[first], row[first], np.diff(np.append(first, len(h)))


def _block(block: int, held: list) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its documents that have terms, and a list for each term."""
    ids, sizes = np.concatenate([x[0] for x in held]), np.concatenate([x[4] for x in held])
    start = np.cumsum([0, *(len(x[0]) for x in held)])
    h, row, tf = np.concatenate([x[1] for x in held]), np.concatenate([x[2] + a for x, a in zip(held, start)]), np.concatenate([x[3] for x in held])
    named = sizes > 0
    place = np.cumsum(named) - 1
    yield _rows([block], [int(sizes.sum())], [int(named.sum())], [ids[named].tobytes()], [sizes[named].tobytes()], 0)
    order = np.argsort(h, kind="stable")  # rows stay in order within a term
    h, row, tf = h[order], place[row[order]].astype(np.int32), tf[order].astype(np.int32)
    first = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
    for a in range(0, len(first) - 1, 50_000):
        cut = first[a : a + 50_001]
        n = np.diff(cut).astype(np.int32)
        bounds = pa.py_buffer(np.ascontiguousarray((cut - cut[0]) * 4, np.int32))
        lists = [pa.Array.from_buffers(pa.binary(), len(n), [None, bounds, pa.py_buffer(np.ascontiguousarray(x[cut[0] : cut[-1]]))]) for x in (row, tf)]
        yield _rows(np.full(len(n), block), h[cut[:-1]].view(np.int64), n, *lists, 1)


def _rows(block, term, n, a, b, kind: int) -> pa.RecordBatch:
    kinds = np.full(len(n), kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(term, pa.int64()), pa.array(n, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(kinds)], ["block", "term", "n", "a", "b", "kind"])


def weights(df: dict[int, int], docs: int) -> dict[int, int]:
    """The weight of each term."""
    return {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for t, n in df.items()}


def parts(w: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to the score of each of its documents, for one occurrence in the query."""
    return w * ((10**9 * tf) // (1000 * tf + 12 * m))


def search(found: Index, queries: DataFrame, k: int = 20, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents with a score above 0 of each row of ``queries``."""
    spark = queries.sparkSession
    asked = _queries(queries, key, text)
    best = [_searched(found, asked[a : a + QUERIES_AT_ONCE], a, k) for a in range(0, len(asked), QUERIES_AT_ONCE)]
    if not best or not found.docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = best[0]
    for x in best[1:]:
        out = out.unionByName(x)
    return out.select("item_id", "rank", "doc_id", "score")


def _queries(queries: DataFrame, key: str, text: str) -> list[tuple[int | None, Counter]]:
    """Each query's id and terms with their occurrences. Queries are a given set, held by the driver as they are."""
    rows = queries.select(F.col(key).cast("long"), F.col(text)).collect()
    out = []
    for r in rows:
        h, _ = term_hashes(*text_bytes(pa.array([r[1]], pa.string())))
        out.append((r[0], Counter(h.view(np.int64).tolist())))
    return out


def _searched(found: Index, asked: list[tuple[int | None, Counter]], first: int, k: int) -> DataFrame:
    spark = found.postings.sparkSession
    distinct = sorted({t for _, q in asked for t in q})
    terms = spark.createDataFrame([(t,) for t in distinct], "term long")
    lists = found.postings.join(F.broadcast(terms) if len(distinct) <= BROADCAST_TERMS else terms, "term", "left_semi")
    df = {r.term: r.n for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the terms of these queries only
    weight = weights(df, found.docs)
    known = [[(t, q) for t, q in c.items() if t in weight] for _, c in asked]
    docs, total = found.docs, found.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in known]
        for ids, sizes, rows in _blocks(batches):
            m = 75 + (25 * sizes * docs) // total
            held = {t: List(d, parts(weight[t], tf.astype(np.int64), m[d])) for t, d, tf in rows}
            for q, b in zip(known, best):
                evaluate([(held[t], n) for t, n in q if t in held], ids, b)
        pid = TaskContext.get().partitionId() % 64
        for a in range(0, len(best), 1000):
            full = [(first + a + i, b) for i, b in enumerate(best[a : a + 1000]) if len(b.ids)]
            if full:
                q = np.repeat([i for i, _ in full], [len(b.ids) for _, b in full])
                ids, scores = (np.concatenate(x) for x in zip(*((b.ids, b.scores) for _, b in full)))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids), pa.array(scores), pa.array(np.full(len(q), pid, np.int32))], ["query", "id", "score", "part"])

    # One block's rows stand together in a task, its documents first.
    rows = lists.select("block", "term", F.col("docs").alias("a"), F.col("tfs").alias("b"), F.lit(1).alias("kind")).unionByName(
        found.blocks.select("block", F.lit(0).cast("long").alias("term"), F.col("ids").alias("a"), F.col("sizes").alias("b"), F.lit(0).alias("kind"))
    )
    dealt = rows.repartition("block").sortWithinPartitions("block", "kind", "term")
    tops = dealt.mapInArrow(run, "query long, id long, score long, part int")
    order = (F.desc("score"), F.asc("id"))
    some = tops.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(first + i, x) for i, (x, _) in enumerate(asked)], "query long, item_id long")
    return last.join(names, "query").select("item_id", "rank", F.nullif("id", F.lit(int(NO_ID))).alias("doc_id"), "score")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Ids, sizes and (term, docs, tfs) of each block; one block is held at a time."""
    at, ids, sizes, rows = None, None, None, []
    for b in batches:
        for block, term, x, y, kind in zip(*(c.to_pylist() for c in b.columns)):
            if block != at:
                if rows:
                    yield ids, sizes, rows
                at, rows = block, []
            if kind:
                rows.append((term, np.frombuffer(x, np.int32), np.frombuffer(y, np.int32)))
            else:
                ids, sizes = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
    if rows:
        yield ids, sizes, rows


class List:
    """One term's documents in a block, ascending, what each gets, and the most that any gets."""

    def __init__(self, docs: np.ndarray, parts: np.ndarray):
        self.docs, self.parts, self.bound = docs, parts, int(parts.max())


class Best:
    """A query's ``k`` best documents so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.least = k, 1  # scores of 0 aren't kept
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def put(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def accumulated(lists: list[tuple[List, int]]) -> List:
    """The sum of short lists as one list."""
    docs = np.concatenate([x.docs for x, _ in lists])
    each, back = np.unique(docs, return_inverse=True)
    total = np.zeros(len(each), np.int64)
    np.add.at(total, back, np.concatenate([x.parts * n for x, n in lists]))
    return List(each, total)


def evaluate(lists: list[tuple[List, int]], ids: np.ndarray, best: Best) -> None:
    """Puts a block's documents into ``best``: short lists term at a time, then all as iterators document at a time."""
    lists = [x for x in lists if x[0].bound]
    short = [x for x in lists if len(x[0].docs) <= SHORT]
    lists = [x for x in lists if len(x[0].docs) > SHORT]
    if short:
        lists.append((accumulated(short), 1))
    lists.sort(key=lambda x: x[0].bound * x[1])
    bounds = np.cumsum([x.bound * n for x, n in lists])  # with all lists of lower bounds
    if not len(bounds) or bounds[-1] < best.least:
        return
    for low in range(0, len(ids), WINDOW):
        needless = int(np.searchsorted(bounds, best.least))  # together below the last score kept: bring no document in
        if needless == len(lists):
            return
        score = np.zeros(min(WINDOW, len(ids) - low), np.int64)
        for x, n in lists[needless:]:
            a, b = np.searchsorted(x.docs, (low, low + len(score)))
            score[x.docs[a:b] - low] += x.parts[a:b] * n
        docs = np.flatnonzero(score)
        for i in range(needless - 1, -1, -1):
            docs = docs[score[docs] + bounds[i] >= best.least]
            if not len(docs):
                break
            x, n = lists[i]
            at = np.minimum(np.searchsorted(x.docs, docs + low), len(x.docs) - 1)
            hit = x.docs[at] == docs + low
            score[docs[hit]] += x.parts[at[hit]] * n
        docs = docs[score[docs] >= best.least]
        if len(docs):
            best.put(ids[docs + low], score[docs])


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of each query, as a written table; its index goes when that is done. To search more than once,
    keep what ``index`` returns."""
    with Tables(docs.sparkSession, "search") as tables:
        return tables.keep(tables.put(search(index(docs, tables), queries, k), "ranks"))
