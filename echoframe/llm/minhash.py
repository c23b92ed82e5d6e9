"""Near duplicates by ProbMinHash.

A document is its runs of ``width`` words with their counts (a text of fewer words is one run). Each run is a Poisson
process with its count as the rate; an arrival falls on a hashed component of the signature, and the component keeps the
earliest. Arrivals are made in rounds for a whole batch, and a run ends as soon as it is later than every component of its
document. Two signatures agree in a component with the probability Jaccard of the weighted runs. A text with runs that
repeat has a second signature with all counts one, which agrees with others of its kind, and with those of texts without
repeats, with the Jaccard of the sets. Bands of the signatures give candidates, which are verified exactly: a link is a
probability Jaccard, or a Jaccard of the sets of runs, of at least ``threshold``.

Equal word sequences are one text from the start, so copies cost a row each. In a band's bucket the texts are compared
with one leader, not with each other: first with the text that meets most others, as it stands nearest to the middle of a
group of copies, then with another one. Links make components. What is still apart goes through exact bounds, and a text
that can be similar to nothing in a bucket leaves it, by its own numbers and the bucket's least ones: the share of its runs
that no other remaining text has is lost in any comparison. Of the buckets left, only texts outside a bucket's largest
component are compared with the others, where a bound allows it. The bound knows which runs of a pivot, the text with the
fewest runs of its own around, each of the two has, as bits: two texts have in common what their bits say and no more of
the rest than the smaller rest. Where runs repeat, with shares p and q of runs of their own, a probability Jaccard is at
most 1 / (1 / (1 - p) + q / (1 - q)). So no candidate is lost, and none is compared twice. Copies of one text take one
comparison each; only texts that are close to the threshold on either side of it, and outside the largest component of
their buckets, take more.

Defined cases: a text without words is alone in its class; a null id too, with a null class; rows with one id are one
document, whose text is the first in order; very long texts are taken whole; ties between leaders and pivots go to the
lower id; an empty table gives an empty result; other columns pass through :func:`deduplicated` unchanged, whatever their
names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import BASE, U64, mix, multipliers, sequence_hashes, slices, text_bytes, windows, word_hashes
from .scratch import Tables, small_batches


@dataclass(frozen=True)
class Bands:
    width: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 7
    rounds: int = 2
    seed: int = 11
    #: Sets of ids up to this size are broadcast; larger ones are joined by a shuffle.
    broadcast_ids: int = 400_000


def shingles(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run; a row of fewer words has one run."""
    g, of = windows(h, row, width)
    n = np.bincount(row)
    start = np.cumsum(n) - n
    parts = [(g, of)]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            x = np.zeros(len(short), U64)
            for i, odd in enumerate(multipliers(k)):
                x += h[start[short] + i] * odd
            parts.append((mix(x + U64(k)), short))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def counted(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each row: row, hash, count."""
    k = mix(g ^ mix(row.astype(U64)))
    order = np.argsort(k)
    k = k[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    n = np.diff(np.append(at, len(k)))
    first = order[at]
    return row[first], g[first], n


def prob_minhash(row: np.ndarray, g: np.ndarray, n: np.ndarray, count: int, m: int, seed: int) -> np.ndarray:
    """Signatures (row, component) of weighted elements; a row without elements has zeros."""
    earliest = np.full(count * m, np.inf)
    holder = np.zeros(count * m, U64)
    latest = np.full(count, np.inf)
    time = np.zeros(len(g))
    start = int(mix(U64(seed)))
    r = 0
    while len(g):
        wide = 1 if len(g) > 40_000 else 32  # arrivals of each element in this round
        salts = np.array([(start + (r + i) * 0xD1342543DE82EF95) % (1 << 64) for i in range(wide)], U64)
        z = mix(g[:, None] ^ salts)
        times = time[:, None] + np.cumsum(-np.log(((z >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / n[:, None]
        soon = times < latest[row][:, None]
        of, _ = np.nonzero(soon)
        t, z = times[soon], z[soon]
        at = row[of] * m + (mix(z + U64(BASE)) % U64(m)).astype(np.int64)
        np.minimum.at(earliest, at, t)
        won = earliest[at] == t
        holder[at[won]] = g[of[won]]
        some = np.unique(row)
        latest[some] = earliest.reshape(count, m)[some].max(axis=1)
        live = times[:, -1] < latest[row]
        row, g, n, time = row[live], g[live], n[live], times[live, -1]
        r += wide
    return holder.reshape(count, m)


def both_minhash(row: np.ndarray, g: np.ndarray, n: np.ndarray, count: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all rows by count, then of the rows with a count over one as sets; and each signature's row."""
    again = np.unique(row[n > 1])
    part = np.isin(row, again)
    as_sets = prob_minhash(np.searchsorted(again, row[part]), g[part], np.ones(int(part.sum()), np.int64), len(again), m, seed)
    return np.concatenate([prob_minhash(row, g, n, count, m, seed), as_sets]), np.append(np.arange(count), again)


SIGNED = "doc_id long, k1 long, k2 long, bands array<long>"


def signed(docs: DataFrame, p: Bands, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: two hashes of its word sequence (null without words) and its bands' hashes, those of both signatures
    where it has two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = p.bands * p.rows
        for b in batches:
            for s in slices(b, "text", 1 << 20):
                h, row = word_hashes(*text_bytes(s.column("text")))
                size = np.bincount(row, minlength=s.num_rows)
                sig, of = both_minhash(*counted(*shingles(h, row, p.width)), s.num_rows, m, p.seed)
                x = np.zeros((len(of), p.bands), U64)
                for k, odd in enumerate(multipliers(p.rows)):
                    x += sig.reshape(len(of), p.bands, p.rows)[:, :, k] * odd
                x = mix(x + np.arange(p.bands, dtype=U64))[np.argsort(of, kind="stable")]
                at = np.append(0, np.cumsum(np.bincount(of, minlength=s.num_rows))) * p.bands
                keys = [sequence_hashes(h, size, salt).view(np.int64) for salt in (1, 2)]
                none = size == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        s.column("doc_id"),
                        *(pa.array(k, mask=none) for k in keys),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.view(np.int64).ravel())),
                    ],
                    ["doc_id", "k1", "k2", "bands"],
                )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNED)


def runs_of(text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct runs of one text and their counts."""
    h, row = word_hashes(*text_bytes(pa.array([text], pa.string())))
    if not len(h):
        return h, np.empty(0, np.int64)
    return np.unique(shingles(h, row, width)[0], return_counts=True)


def run_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id with the sorted distinct runs of its text and their counts, as bytes, and whether all counts are one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text", 1 << 20):
                got = [runs_of(t.as_py() or "", width) for t in s.column("text")]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array([g.tobytes() for g, _ in got], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in got], pa.binary()), pa.array([bool((n == 1).all()) for _, n in got])], ["doc_id", "runs", "counts", "plain"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, runs binary, counts binary, plain boolean")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard and set Jaccard."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(a[0]) + len(b[0]) - len(both))
    if a[1].max() == b[1].max() == 1:
        return plain
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    ratio = x / y
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    # for an element with ratio t, the others count as x where their ratio is at least t, else as t * y
    at = np.searchsorted(ratio, ratio, "left")
    above = np.append(np.cumsum(x[::-1])[::-1], 0.0)[at] + a[1].sum() - x.sum()
    below = np.append(0.0, np.cumsum(y))[at] + b[1].sum() - y.sum()
    return max(plain, float((x / (above + ratio * below)).sum()))


def linked(pairs: DataFrame, runs: DataFrame, p: Bands) -> DataFrame:
    """Those of the pairs (a, b) whose runs are similar. Both sides come by shuffles; a common ``a`` is split by AQE."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda g, n: (np.frombuffer(g.as_buffer(), U64), np.frombuffer(n.as_buffer(), np.int32))
        for t in batches:
            keep = [similarity(of(ga, na), of(gb, nb)) >= p.threshold for ga, na, gb, nb in zip(*(t.column(i) for i in range(2, 6)))]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: runs.select(F.col("doc_id").alias(c), F.col("runs").alias(f"runs_{c}"), F.col("counts").alias(f"counts_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "runs_a", "counts_a", "runs_b", "counts_b").mapInArrow(check, "a long, b long")


def own_runs(runs: DataFrame) -> DataFrame:
    """Per text: its distinct runs (n), whether their counts are all one (plain), those of them that no other text of the
    table has (u), and their share by count (own)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, g, c in zip(b.column("doc_id").to_pylist(), b.column("runs"), b.column("counts")):
                h, c = np.frombuffer(g.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), d)), pa.array(h), pa.array(c / c.sum())], ["doc", "h", "share"])

    rows = runs.select("doc_id", "runs", "counts").mapInArrow(spread, "doc long, h long, share double")
    alone = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), F.min("share").alias("share")).where("n = 1")
    alone = alone.groupBy("doc").agg(F.count("*").alias("u"), F.sum("share").alias("own"))
    size = runs.select(F.col("doc_id").alias("doc"), (F.octet_length("runs") / 8).cast("long").alias("n"), "plain")
    return size.join(alone, "doc", "left").na.fill(0, ["u", "own"]).withColumn("own", F.least(F.col("own"), F.lit(1 - 1e-9)))


def bound_by_count(s: Column, t: Column) -> Column:
    """The most that a probability Jaccard can be, for the shares of own runs of two texts."""
    one = lambda x, y: 1 / (1 / (1 - x) + y / (1 - y))
    return F.least(one(s, t), one(t, s))


def hopeful(rest: DataFrame, sized: DataFrame, p: Bands) -> DataFrame:
    """Rows of ``rest`` (band, rep, label) whose text can be similar to some text of its bucket, with n, u, own and plain."""
    at = rest.join(sized.withColumnRenamed("doc", "rep"), "rep")
    least = at.groupBy("band").agg(F.min("n").alias("_n"), F.min("own").alias("_own"), F.min("plain").alias("_plain"))
    shared = F.col("n") - F.col("u")
    by_set = shared / F.greatest(F.col("n"), F.col("n") + F.col("_n") - shared)
    by_count = bound_by_count(F.col("own"), F.col("_own"))
    bound = F.when(F.col("_plain"), F.least(by_set, by_count)).otherwise(F.greatest(by_set, by_count))
    return at.join(least, "band").where(bound >= p.threshold - 1e-9).drop("_n", "_own", "_plain")


def pivoted(at: DataFrame, runs: DataFrame) -> DataFrame:
    """Per text of ``at`` (rows of :func:`hopeful`): n, own, whether all its counts are one, its pivot, the pivot's runs that
    it has as bits, and how many other runs it has that some text shares. The pivot is the text with the least own share
    among those that share a bucket with it, or with one of these."""
    best = at.select("band", "rep", "n", "u", "own", "plain", F.struct("own", "rep").alias("best"))
    for _ in range(2):
        of_band = best.groupBy("band").agg(F.min("best").alias("_best"))
        of_text = best.select("band", "rep").join(of_band, "band").groupBy("rep").agg(F.min("_best").alias("best"))
        best = best.drop("best").join(of_text, "rep")
    pivot = best.groupBy("rep").agg(F.first("n").alias("n"), F.first("u").alias("u"), F.first("own").alias("own"), F.first("plain").alias("plain"), F.first("best.rep").alias("pivot")).withColumnRenamed("rep", "doc")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, extra = [], []
            for d, v, u, g, h in zip(b.column("doc").to_pylist(), b.column("pivot").to_pylist(), b.column("u").to_pylist(), b.column("runs"), b.column("pivot_runs")):
                g, h = np.frombuffer(g.as_buffer(), U64), np.frombuffer(h.as_buffer(), U64)
                has = np.isin(h, g, assume_unique=True)
                extra.append(0 if d == v else len(g) - int(has.sum()) - u)
                out.append(np.packbits(np.pad(has, (0, -len(has) % 64))).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc", "n", "own", "pivot", "plain")), pa.array(out, pa.list_(pa.int64())), pa.array(extra, pa.int64())], ["doc", "n", "own", "pivot", "plain", "bits", "extra"])

    both = pivot.join(runs.select(F.col("doc_id").alias("doc"), "runs"), "doc").join(runs.select(F.col("doc_id").alias("pivot"), F.col("runs").alias("pivot_runs")), "pivot")
    return both.select("doc", "n", "u", "own", "pivot", "plain", "runs", "pivot_runs").mapInArrow(bits, "doc long, n long, own double, pivot long, plain boolean, bits array<long>, extra long")


def may_link(p: Bands) -> Column:
    """Whether the bounds allow a link of two rows of :func:`pivoted` with suffixes _a and _b."""
    a, b = ({c: F.col(f"{c}_{s}") for c in ("n", "own", "pivot", "plain", "bits", "extra")} for s in "ab")
    shared = F.aggregate(F.zip_with(a["bits"], b["bits"], lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda t, x: t + x)
    common = F.when(a["pivot"] == b["pivot"], shared + F.least(a["extra"], b["extra"])).otherwise(F.least(a["n"], b["n"]))
    by_count = bound_by_count(a["own"], b["own"]) >= p.threshold - 1e-9
    by_set = common >= p.threshold * (a["n"] + b["n"] - common)
    return F.when(a["plain"] & b["plain"], by_set & by_count).otherwise(by_set | by_count)  # plain: both measures are one


def free_name(df: DataFrame) -> str:
    name = "_near_id"
    while name in df.columns:
        name += "_"
    return name


def semi(docs: DataFrame, ids: DataFrame, key: str, p: Bands, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose key is (not) among ``ids``, which are broadcast where they are few."""
    small = ids.count() <= p.broadcast_ids
    name = free_name(docs)
    other = ids.select(F.col(ids.columns[0]).alias(name))
    return docs.join(F.broadcast(other) if small else other, F.col(key) == F.col(name), how)


def single(docs: DataFrame, text: str, key: str, p: Bands) -> DataFrame:
    """One row for each id that isn't null: that with the first text (a null one last), and of equals the first as JSON."""
    again = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    if again.isEmpty():
        return docs
    name = free_name(docs)
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last(text), F.to_json(F.struct("*")))
    one = semi(docs, again, key, p).withColumn(name, F.row_number().over(order)).where(F.col(name) == 1).drop(name)
    return semi(docs, again, key, p, "left_anti").unionByName(one)


def pairs_with_leaders(at: DataFrame, apart: DataFrame) -> DataFrame:
    return at.join(apart, "band").where(F.col("label") != F.col("leader.label")).select(F.col("leader.rep").alias("a"), F.col("rep").alias("b"))


def pairs_left(t: Tables, rest: DataFrame, runs: DataFrame, p: Bands) -> DataFrame:
    """Pairs of texts of different components that share a bucket and that no bound tells apart: of each bucket, the texts
    outside its largest component with all others."""
    left = t.put(runs.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"), "left")
    at = t.put(hopeful(rest, own_runs(left), p), "hopeful")
    sizes = at.groupBy("band", "label").agg(F.count("*").alias("_n"))
    main = sizes.groupBy("band").agg(F.max_by("label", F.struct("_n", -F.col("label"))).alias("main"), F.count("*").alias("_labels")).where("_labels > 1").select("band", "main")
    at = t.put(at.join(main, "band"), "apart")
    known = t.put(pivoted(at, left), "pivots")
    side = lambda c: at.join(known.drop("n", "own", "plain"), F.col("rep") == F.col("doc")).select("band", F.col("rep").alias(c), (F.col("label") == F.col("main")).alias(f"in_main_{c}"), *[F.col(v).alias(f"{v}_{c}") for v in ("label", "n", "own", "pivot", "plain", "bits", "extra")])
    outside = side("a").where("not in_main_a")
    both = outside.join(side("b"), "band").where((F.col("label_a") != F.col("label_b")) & (F.col("in_main_b") | (F.col("a") < F.col("b"))) & may_link(p))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, p: Bands = Bands(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, the id of its text's first document, and class_id, the least doc_id of its class."""
    small_batches(docs.sparkSession)
    every = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    docs = single(every, "text", "doc_id", p)
    with Tables(docs.sparkSession, "near") as t:
        all_rows = t.keep(t.put(signed(docs, p), "signed"))
        known = all_rows.where(F.col("doc_id").isNotNull() & F.col("k1").isNotNull())
        first = t.keep(t.put(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "first"))
        own = known.join(first, ["k1", "k2"]).where(F.col("doc_id") == F.col("rep"))
        rows = t.put(own.select("rep", F.explode(F.array_distinct("bands")).alias("band")), "bands")
        shared = rows.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        buckets = t.put(rows.join(shared, "band"), "buckets")  # texts that share a band with another
        t.drop(rows)
        nodes = t.put(buckets.groupBy("rep").agg(F.sum("size").alias("met")), "nodes")
        runs = t.put(run_table(semi(docs, nodes.select("rep"), "doc_id", p), p.width), "runs")

        labels = nodes.select(F.col("rep").alias("node"), F.col("rep").alias("label"))
        tested = docs.sparkSession.createDataFrame([], "a long, b long")
        for r in range(p.rounds + 1):
            at = buckets.join(labels, F.col("rep") == F.col("node")).select("band", "rep", "label")
            if r == 0:
                leader = F.min_by(F.struct("rep", "label"), F.struct(-F.col("met"), F.col("rep")))
                apart = at.join(nodes, "rep").groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), leader.alias("leader"))
            else:
                leader = F.min_by(F.struct("rep", "label"), F.struct(F.xxhash64("rep", F.lit(r)), F.col("rep")))
                apart = at.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), leader.alias("leader"))
            apart = apart.where("lo <> hi").select("band", "leader")
            pairs = pairs_with_leaders(at, apart).distinct() if r < p.rounds else pairs_left(t, t.put(at.join(apart.select("band"), "band"), "rest"), runs, p)
            back = tested.select(F.col("b").alias("a"), F.col("a").alias("b"))
            pairs = t.put(pairs.join(tested, ["a", "b"], "left_anti").join(back, ["a", "b"], "left_anti"), "pairs")
            if pairs.isEmpty():
                if apart.isEmpty():
                    break
                continue
            found = t.put(linked(pairs, runs, p), "links")
            tested = tested.unionByName(pairs)
            labels = components(labels, found)

        moved = t.keep(t.put(labels.where("node <> label"), "moved"))
    named = first.join(moved, F.col("rep") == F.col("node"), "left").select("k1", "k2", "rep", F.coalesce("label", "rep").alias("label"))
    joined = all_rows.select("doc_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("text_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("class_id"))
    return out if docs is every else every.select("doc_id").join(out.where(F.col("doc_id").isNotNull()), "doc_id", "left")


def deduplicated(docs: DataFrame, p: Bands = Bands(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with one of each class left, that with the least id; columns as they came."""
    docs = single(docs, text, key, p)
    with Tables(docs.sparkSession, "near") as t:
        gone = t.keep(t.put(classes(docs, p, text, key).where("class_id <> doc_id").select("doc_id"), "gone"))
    return semi(docs, gone, key, p, "left_anti")
