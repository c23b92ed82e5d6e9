"""Katz backoff over words: Good-Turing discounted bigrams that back off to Good-Turing discounted unigrams.

P(w | v) = d2(c(v,w)) c(v,w) / N(v) if the pair was seen, else alpha(v) P(w); P(w) = d1(c(w)) c(w) / N, and one unknown word
has what the discounts leave. alpha(v) makes the probabilities after v sum to one exactly. Good-Turing discounts hold for
counts up to ``K``; above, the absolute discount of count ``K`` goes on, so every context has mass left. Where counts of
counts are too thin for Good-Turing, one absolute discount serves all counts.

Tables. Tokens (word, word before, document) go to a table bucketed by the word, in arrays that name each word and each
context once; frequent words are dealt by word and context, and frequent pairs also by the group of documents that they come
from, so no bucket holds a hot word or pair whole. A bucket has all of a word's tokens, so its counts, the pairs' counts, and
every part of a score that needs them are made there; the counts of frequent words and pairs, whose number is bounded, are
sums of the buckets' parts. What needs a context, alpha(v), is asked for only by unseen pairs. Their questions go with the
buckets' shares of alpha to a second table, bucketed by context; questions about frequent contexts stay where they are, and
the few values of alpha that they need are sent to them. N(v) is the count of v as a word, so log N(v) is taken where v
stands. A document's parts add up, in doubles.

Words and pairs are told apart by 64-bit hashes: among n of them, two share one with a probability of about n * n / 2**65.

Defined cases: a null or empty text has one token, its end; very long texts are scored whole; repeated rows are each scored
and, if they belong to the training part, each counted; columns other than the three that are read don't matter, whatever
their names; an empty table gives an empty result; without training text every token is the unknown word with probability 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import LOWER, U64, mix, slices, text_bytes, word_hashes
from .scratch import Tables, small_batches

K = 5
START, END = U64(0x5BD1E9955BD1E995), U64(0xC2B2AE3D27D4EB4F)
#: Buckets of a table's files at least: as many tasks work on it. A document's parts of one task are added before they are
#: moved. A file's bucket has up to BUCKETS_OF_FILE buckets of tokens, which are worked on one after the other.
FILES = 96
BUCKETS_OF_FILE = 64
#: Bytes of text whose tokens make up a bucket, and tokens that a task holds before it passes them on.
BUCKET_BYTES = 10 << 20
HELD_TOKENS = 1_500_000
#: Documents whose parts a task adds before it passes them on.
HELD_DOCS = 2_000_000
#: Frequent words and pairs are those with a share of one in so many tokens, so there are no more of them than that: four
#: times the number of buckets, within these bounds. What is sent to all tasks is at most 2**20 hashes with counts.
FREQUENT = (256, 1 << 20)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, word before and row of all tokens; each row ends with END."""
    raw, at = text_bytes(column)
    h, row = word_hashes(LOWER[raw], at)
    n = np.bincount(row, minlength=len(column))
    w = np.insert(h, np.cumsum(n), END)
    row = np.repeat(np.arange(len(column)), n + 1)
    before = np.append(START, w[:-1])
    before[np.append(0, np.cumsum(n + 1)[:-1])] = START
    return w, before, row


def pairs_of(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(w + mix(v ^ U64(0x9E3779B97F4A7C15)))


def among(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``x`` is in the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x, at


def frequent_grams(docs: DataFrame, most: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words and of the pairs that have a share of 1 / ``most`` of all tokens. Each slice of a task
    passes on those that have it there; one that has it in all texts has it in some slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                w, v, _ = tokens_of(s.column("text"))
                u, back, n = np.unique(w, return_inverse=True, return_counts=True)
                keep = n >= len(w) / most
                hot = keep[back]
                q, m = np.unique(pairs_of(w[hot], v[hot]), return_counts=True)
                also = m >= len(w) / most
                kind = np.repeat([0, 1, 2], [1, int(keep.sum()), int(also.sum())]).astype(np.int32)
                gram = np.concatenate([np.zeros(1, U64), u[keep], q[also]])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(gram.view(np.int64)), pa.array(np.concatenate([[len(w)], n[keep], m[also]]))], ["kind", "gram", "n"])

    rows = tables.put(docs.select("text").mapInArrow(run, "kind int, gram long, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n")), "frequent")
    total = rows.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    kept = rows.where((F.col("kind") > 0) & (F.col("n") * most >= total)).collect()
    words, pairs = ([r.gram for r in kept if r.kind == k] for k in (1, 2))
    return tuple(np.sort(np.array(x, np.int64).view(U64)) for x in (words, pairs))


def bucket_ids(spark: SparkSession, n: int) -> np.ndarray:
    """``n`` integers that Spark's hash deals to ``n`` different buckets."""
    rows = spark.range(40 * n + 200).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("b")).agg(F.min("id").alias("id")).collect()
    assert len(rows) == n
    return np.array([r.id for r in rows], np.int32)


def bucketed(df: DataFrame, n: int, by: str) -> str:
    name = f"katz_{uuid.uuid4().hex}"
    df.write.bucketBy(n, by).option("compression", "zstd").saveAsTable(name)
    return name


def narrow(x: np.ndarray, top: int) -> bytes:
    return x.astype(np.uint16 if top <= 65536 else np.uint32).tobytes()


def widen(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32)


TOKENS = "kind int, file int, bucket int, grp long, n_docs long, held binary, words binary, runs binary, contexts binary, context_at binary, docs binary, doc_ids array<long>"
T_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())]
T_NAMES = [x.split()[0] for x in TOKENS.split(", ")]


def token_rows(docs: DataFrame, ids: np.ndarray, n_buckets: int, frequent: np.ndarray, frequent_pairs: np.ndarray) -> DataFrame:
    """Rows of kind 0: the tokens of one bucket and one group of documents. Rows of kind 1: the group's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        w, v, d, doc_ids, held = [], [], [], [], []
        size = docs_held = 0

        def out() -> Iterator[pa.RecordBatch]:
            words, before, of = np.concatenate(w), np.concatenate(v), np.concatenate(d)
            w.clear(), v.clear(), d.clear()
            flags = np.packbits(np.concatenate(held)).tobytes()
            group = part * 4096 + seq
            n = np.bincount(of, minlength=docs_held)
            rows = [(1, int(ids[group % len(ids)]), -1, group, docs_held, flags, None, n.astype(np.uint32).tobytes(), None, None, None, [x for y in doc_ids for x in y])]
            to = mix(words)
            hot = np.flatnonzero(among(frequent, words)[0])
            to[hot] = mix(to[hot] ^ before[hot])
            hot = hot[among(frequent_pairs, pairs_of(words[hot], before[hot]))[0]]
            to[hot] = mix(to[hot] ^ U64(group))
            to = (to >> U64(33)) % U64(n_buckets)
            order = np.argsort(words, kind="stable")
            order = order[np.argsort(to[order], kind="stable")]  # buckets, and in them equal words side by side
            to, words, before, of = to[order], words[order], before[order], of[order]
            cuts = np.searchsorted(to, np.arange(n_buckets + 1, dtype=U64))
            for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                if b > a:
                    x = words[a:b]
                    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                    c, back = np.unique(before[a:b], return_inverse=True)
                    rows.append((0, int(ids[i % len(ids)]), i, group, docs_held, flags, x[first].tobytes(), np.diff(np.append(first, b - a)).astype(np.uint32).tobytes(), c.tobytes(), narrow(back, len(c)), narrow(of[a:b], docs_held), None))
            for a in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[a : a + 16]), T_KINDS)], T_NAMES)

        for b in batches:
            for s in slices(b, "text"):
                x, y, z = tokens_of(s.column("text"))
                w.append(x)
                v.append(y)
                d.append((z + docs_held).astype(np.int32))
                doc_ids.append(s.column("doc_id").to_pylist())
                held.append(s.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
                size += len(x)
                docs_held += s.num_rows
                if size >= HELD_TOKENS:
                    yield from out()
                    w, v, d, doc_ids, held = [], [], [], [], []
                    size = docs_held = 0
                    seq += 1
        if w:
            yield from out()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, TOKENS)


class Bucket:
    """All tokens of one bucket with their counts in the training part."""

    def __init__(self, t: pa.Table):
        w, v, d, train = [], [], [], []
        for i in range(t.num_rows):
            r = {n: t.column(n)[i].as_py() for n in ("grp", "n_docs", "held", "words", "runs", "contexts", "context_at", "docs")}
            runs = np.frombuffer(r["runs"], np.uint32)
            n = int(runs.sum())
            doc = widen(r["docs"], n).astype(np.int64)
            held = np.unpackbits(np.frombuffer(r["held"], np.uint8), count=r["n_docs"]).astype(bool)
            w.append(np.repeat(np.frombuffer(r["words"], U64), runs))
            v.append(np.frombuffer(r["contexts"], U64)[widen(r["context_at"], n)])
            d.append((r["grp"] << 32) | doc)
            train.append(~held[doc])
        self.w, self.v, self.doc, self.train = (np.concatenate(x) for x in (w, v, d, train))
        w.clear(), v.clear(), d.clear(), train.clear()
        self.words, self.word_at = np.unique(self.w, return_inverse=True)
        self.word_count = np.bincount(self.word_at, self.train).astype(np.int64)
        self.pairs, self.pair_first, self.pair_at = np.unique(pairs_of(self.w, self.v), return_index=True, return_inverse=True)
        self.pair_count = np.bincount(self.pair_at, self.train).astype(np.int64)


def counts_of_counts(n: np.ndarray) -> np.ndarray:
    """How many counts are 1, ..., K + 1."""
    return np.bincount(n[(n > 0) & (n <= K + 1)], minlength=K + 2)[1:]


def good_turing(n: np.ndarray) -> tuple[np.ndarray, float]:
    """Discount factors for counts 0 to K, and the absolute discount above."""
    n = n.astype(float)
    r = np.arange(1, K + 1)
    if (n > 0).all():
        common = (K + 1) * n[K] / n[0]
        if common < 1:
            d = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common)
            if (d > 0.01).all() and (d < 0.999).all():
                return np.append(0.0, d), float(K * (1 - d[-1]))
    fixed = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5))
    return np.append(0.0, (r - fixed) / r), fixed


def discounted(c: np.ndarray, discount: tuple[np.ndarray, float]) -> np.ndarray:
    """d(c) * c."""
    d, above = discount
    return np.where(c <= K, d[np.minimum(c, K)] * c, c - above)


STATS = "kind int, r long, n long"
PARTS = "kind int, dest int, grp long, x1 binary, x2 binary, x3 binary, x4 binary"
P_KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def table_of(rows: list[tuple], kinds: list, schema: str) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])


def by_group(doc: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> list[tuple]:
    """Rows of kind 0 for ascending documents, one for each group."""
    if not len(doc):
        return []
    cuts = np.append(0, np.append(np.flatnonzero(np.diff(doc >> 32)) + 1, len(doc))).tolist()
    rows = []
    for a, b in zip(cuts, cuts[1:]):
        at, n = doc[a:b] & 0xFFFFFFFF, known[a:b]
        rows.append((0, -1, int(doc[a] >> 32), narrow(at, int(at[-1]) + 1), narrow(n, int(n.max()) + 1), base[a:b].astype(np.float64).tobytes(), score[a:b].astype(np.float64).tobytes()))
    return rows


def parts_of(x1, x2, x3, x4) -> tuple[np.ndarray, ...]:
    """Documents, known, base and score of a row of :func:`by_group`."""
    base, score = (np.frombuffer(x, np.float64) for x in (x3, x4))
    return widen(x1, len(base)), widen(x2, len(base)), base, score


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 of one task added up by document; others pass."""
    sums: dict[int, list[np.ndarray]] = {}
    names = [x.split()[0] for x in PARTS.split(", ")]
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for grp, (seen, known, base, score) in sums.items():
            at = np.flatnonzero(seen)
            for row in by_group((grp << 32) | at, known[at], base[at], score[at]):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, P_KINDS)], names)
        sums.clear()

    for b in batches:
        kind = np.asarray(b.column("kind"))
        if (kind > 0).any():
            yield b.filter(pa.array(kind > 0))
        for i in np.flatnonzero(kind == 0).tolist():
            grp = b.column("grp")[i].as_py()
            x = parts_of(*(b.column(c)[i].as_buffer() for c in ("x1", "x2", "x3", "x4")))
            top = int(x[0][-1]) + 1
            have = sums.setdefault(grp, [np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)])
            if len(have[0]) < top:
                size += top - len(have[0])
                have[:] = [np.append(v, np.zeros(top - len(v), v.dtype)) for v in have]
            have[0][x[0]] = True
            for v, more in zip(have[1:], x[1:]):
                v[x[0]] += more
        if size > HELD_DOCS:
            yield from out()
            size = 0
    yield from out()


def log_weight(left: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 of alpha(v) * N(v)."""
    return np.log10(np.maximum(left, 1e-300) / np.maximum(1 - lower, 1e-12))


def joined(column: pa.ChunkedArray, form) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), form) for x in column]
    return np.concatenate(parts) if parts else np.empty(0, form)


def answers(v: np.ndarray, weight: np.ndarray, ask: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Parts of scores for questions (context, document, how often), from sorted contexts and their weights. A context that
    was never seen has alpha 1, and N taken as 1."""
    met, at = among(v, ask)
    got = np.where(met, weight[at], 0.0) * n if len(v) else np.zeros(len(ask))
    doc, back = np.unique(doc, return_inverse=True)
    return by_group(doc, np.zeros(len(doc), np.int64), np.zeros(len(doc)), np.bincount(back, got))


def scored(docs: DataFrame, held_out: str = "held_out") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, held_out): the model learns from the rows that aren't held out."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", F.col(held_out).alias("held_out"))
    n_train, size = docs.agg(F.count_if(~F.col("held_out")), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()  # n_train: occurrences of START as a context
    n_buckets = max(1, -(-(size or 0) // BUCKET_BYTES))
    files = max(FILES, -(-n_buckets // BUCKETS_OF_FILE))
    n_buckets = files * -(-n_buckets // files)
    ids = bucket_ids(spark, files)
    with Tables(spark, "katz") as tables:
        frequent, frequent_pairs = frequent_grams(docs, min(max(4 * n_buckets, FREQUENT[0]), FREQUENT[1]), tables)
        contexts = np.sort(np.append(frequent, START))
        tokens = bucketed(token_rows(docs, ids, n_buckets, frequent, frequent_pairs), files, "file")
        meta = tables.put(spark.table(tokens).where("kind = 1").select("grp", "n_docs", "held", "runs", "doc_ids"), "documents")
        rows = spark.table(tokens).where("kind = 0").drop("doc_ids", "kind")

        def stats(t: pa.Table) -> pa.Table:
            b = Bucket(t)
            part, _ = among(frequent, b.words)
            split, _ = among(frequent_pairs, b.pairs)
            one = b.word_count[~part]
            out = [(1, r, int(n)) for r, n in enumerate(counts_of_counts(one), 1)] + [(2, r, int(n)) for r, n in enumerate(counts_of_counts(b.pair_count[~split]), 1)]
            out += [(3, 0, int(one.sum())), (4, 0, int((one > 0).sum()))]
            out += [(5, int(w), int(n)) for w, n in zip(b.words[part].view(np.int64), b.word_count[part])]  # shares of frequent words
            out += [(6, int(w), int(n)) for w, n in zip(b.pairs[split].view(np.int64), b.pair_count[split])]  # and pairs
            return table_of(out, [pa.int32(), pa.int64(), pa.int64()], STATS)

        got = {(r.kind, r.r): r.n for r in rows.groupBy("file", "bucket").applyInArrow(stats, STATS).groupBy("kind", "r").agg(F.sum("n").alias("n")).collect()}

        def shared(kind: int) -> tuple[np.ndarray, np.ndarray]:
            x = sorted((np.int64(r).view(U64), n) for (k, r), n in got.items() if k == kind)
            return np.array([w for w, _ in x], U64), np.array([n for _, n in x], np.int64)

        hot_words, hot_counts = shared(5)
        hot_pairs, hot_pair_counts = shared(6)
        n1 = np.array([got.get((1, r), 0) for r in range(1, K + 2)]) + counts_of_counts(hot_counts)
        n2 = np.array([got.get((2, r), 0) for r in range(1, K + 2)]) + counts_of_counts(hot_pair_counts)
        total = got.get((3, 0), 0) + int(hot_counts.sum())
        kinds = got.get((4, 0), 0) + int((hot_counts > 0).sum())
        d1, d2 = good_turing(n1), good_turing(n2)
        small = np.arange(1, K + 1)
        unknown = (float((n1[:K] * (small - discounted(small, d1))).sum()) + d1[1] * (kinds - int(n1[:K].sum()))) / total if total else 1.0
        floor = total + 0.5 * (kinds + 1)

        def parts(t: pa.Table) -> pa.Table:
            b = Bucket(t)
            c, pair_count, whole = b.word_count.copy(), b.pair_count.copy(), np.ones(len(b.pairs))
            met, at = among(hot_words, b.words)
            c[met] = hot_counts[at[met]]
            met, at = among(hot_pairs, b.pairs)
            pair_count[met] = hot_pair_counts[at[met]]
            whole[met] = b.pair_count[met] / np.maximum(1, pair_count[met])  # of a pair in several buckets, this one's part
            p = np.where(c > 0, discounted(c, d1) / max(1, total), unknown)
            log_p, log_c = np.log10(p), np.log10(np.maximum(c, 1))
            seen = pair_count[b.pair_at] > 0
            score = np.where(seen, np.log10(np.maximum(discounted(pair_count, d2), 1e-300))[b.pair_at], log_p[b.word_at])
            score -= np.where(b.w == END, 0.0, log_c[b.word_at])
            doc, at = np.unique(b.doc, return_inverse=True)
            known = np.bincount(at, (c > 0)[b.word_at]).astype(np.int64)
            base = np.bincount(at, np.log10((c + 0.5) / floor)[b.word_at])
            out = by_group(doc, known, base, np.bincount(at, score))
            # shares of alpha by context: those of frequent contexts in rows of their own
            kind = np.flatnonzero(pair_count > 0)
            first = b.pair_first[kind]
            v, back = np.unique(b.v[first], return_inverse=True)
            left = np.bincount(back, (pair_count[kind] - discounted(pair_count[kind], d2)) * whole[kind])
            lower = np.bincount(back, p[b.word_at[first]] * whole[kind])
            apart, _ = among(contexts, v)
            to = (mix(v ^ U64(77)) >> U64(33)) % U64(n_buckets)
            for i in np.unique(to[~apart]).tolist():
                mine = (to == i) & ~apart
                out.append((1, i, 0, v[mine].tobytes(), left[mine].tobytes(), lower[mine].tobytes(), None))
            if apart.any():
                out.append((4, -1, 0, v[apart].tobytes(), left[apart].tobytes(), lower[apart].tobytes(), None))
            # unseen pairs ask for their context's alpha; a context that several tokens of a document ask for goes once
            ask = np.flatnonzero(~seen)
            if len(ask):
                v, doc = b.v[ask], b.doc[ask]
                order = np.lexsort((v, doc))
                v, doc = v[order], doc[order]
                first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])))
                n = np.diff(np.append(first, len(v))).astype(np.uint32)
                v, doc = v[first], doc[first]
                apart, _ = among(contexts, v)
                to = (mix(v ^ U64(77)) >> U64(33)) % U64(n_buckets)
                for i in np.unique(to[~apart]).tolist():
                    mine = (to == i) & ~apart
                    out.append((2, i, 0, v[mine].tobytes(), doc[mine].tobytes(), n[mine].tobytes(), None))
                if apart.any():
                    out.append((3, -1, 0, v[apart].tobytes(), doc[apart].tobytes(), n[apart].tobytes(), None))
            return table_of(out, P_KINDS, PARTS)

        shares = rows.groupBy("file", "bucket").applyInArrow(parts, PARTS)
        if n_buckets > files:  # else a task has one part of a document already
            shares = shares.mapInArrow(added, PARTS)
        moved = tables.put(shares, "parts", by="kind")
        spark.sql(f"DROP TABLE {tokens}")

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v, left, lower = joined(b.column("x1"), np.int64), joined(b.column("x2"), np.float64), joined(b.column("x3"), np.float64)
                v, back = np.unique(v, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(np.bincount(back, left, len(v))), pa.array(np.bincount(back, lower, len(v)))], ["v", "left", "lower"])

        at_once = moved.where("kind = 4").select("x1", "x2", "x3").mapInArrow(spread, "v long, left double, lower double").groupBy("v").agg(F.sum("left"), F.sum("lower")).collect()
        at_once = sorted((np.int64(r[0]).view(U64), r[1], r[2]) for r in at_once)  # as many as there are frequent contexts
        hot_contexts = np.array([x[0] for x in at_once], U64)
        hot_weights = log_weight(np.array([x[1] for x in at_once]), np.array([x[2] for x in at_once]))

        def backed_off(t: pa.Table) -> pa.Table:
            of = lambda k: t.filter(pc.equal(t.column("kind"), k))
            share, ask = of(1), of(2)
            if not ask.num_rows:
                return table_of([], P_KINDS, PARTS)
            v, back = np.unique(joined(share.column("x1"), U64), return_inverse=True)
            sums = [np.bincount(back, joined(share.column(c), np.float64), len(v)) for c in ("x2", "x3")]
            return table_of(answers(v, log_weight(*sums), joined(ask.column("x1"), U64), joined(ask.column("x2"), np.int64), joined(ask.column("x3"), np.uint32)), P_KINDS, PARTS)

        def at_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = answers(hot_contexts, hot_weights, joined(b.column("x1"), U64), joined(b.column("x2"), np.int64), joined(b.column("x3"), np.uint32))
                yield from table_of(rows, P_KINDS, PARTS).to_batches()

        columns = ["grp", "x1", "x2", "x3", "x4"]
        more = moved.where("kind in (1, 2)").groupBy("dest").applyInArrow(backed_off, PARTS)
        hot = moved.where("kind = 3").mapInArrow(at_hot, PARTS)
        same = moved.where("kind = 0").select(columns).unionByName(more.select(columns)).unionByName(hot.select(columns))
        everything = same.unionByName(meta, allowMissingColumns=True)

        def summed(t: pa.Table) -> pa.Table:
            n_docs = t.column("n_docs").to_pylist()
            i = next(i for i, n in enumerate(n_docs) if n is not None)
            size = n_docs[i]
            held = np.unpackbits(np.frombuffer(t.column("held")[i].as_py(), np.uint8), count=size).astype(bool)
            sums = [np.zeros(size) for _ in range(3)]
            for j in range(t.num_rows):
                if n_docs[j] is None:
                    at, *values = parts_of(*(t.column(c)[j].as_buffer() for c in columns[1:]))
                    for have, v in zip(sums, values):
                        have[at] += v
            known, base, score = sums
            return pa.Table.from_arrays(
                [
                    t.column("doc_ids")[i].values,
                    pa.array(held),
                    pa.array(np.frombuffer(t.column("runs")[i].as_py(), np.uint32).astype(np.int64)),
                    pa.array(known.astype(np.int64)),
                    pa.array(np.full(size, total)),
                    pa.array(base),
                    pa.array(score - np.log10(max(1, n_train))),
                ],
                [x.split()[0] for x in SCORES.split(", ")],
            )

        out = tables.keep(tables.put(everything.groupBy("grp").applyInArrow(summed, SCORES), "scores"))
    return out
