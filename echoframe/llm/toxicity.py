"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

A text's features are its terms, pairs of terms that follow each other, and pairs with one term left out, each hashed to one of 2**``BITS`` coordinates and counted once. FTRL-proximal keeps for each coordinate the sum of its squared
gradients, which sets its own rate, and a dual sum, which is zeroed within the L1 bound: most coordinates have no weight at
all, and those that do are broadcast (at most 2**``BITS`` pairs of numbers, whatever the corpus).

Learning is bounded: ``SAMPLE`` labelled documents at most, those with the least hashes of their ids (all, where there are
fewer), dealt to ``SHARDS`` shards by the hash. Each pass runs a learner in each shard over its documents in hash order, from
the same state, and the shards' changes are averaged in the shards' order, so that the weights don't depend on partitions or
on the order of rows. Only features (whole texts) and labels are learned from.

Defined cases: null, empty and termless texts have no features, and get the score of the intercept alone; rows without a label
or with a null one aren't learned from; several labels of one id count as the greatest; rows with one id are each learned from
and scored; without any label every score is that of an even chance; very long texts are taken whole; an empty table gives an
empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import mix, multipliers, slices, term_hashes, text_bytes
from .scratch import Tables, small_batches

BITS = 20
#: Most labelled documents that are learned from.
SAMPLE = 30_000
SHARDS = 4
PASSES = 10
#: Documents of the sample that must have a coordinate for it to be learned; what fewer have would be learned by heart.
LEAST = 3
#: Words of one kind of feature: each term's distance from the first.
SHAPES = ((0,), (0, 1), (0, 2))
#: The intercept's coordinate.
INTERCEPT = 1 << BITS


@dataclass(frozen=True)
class Rates:
    """FTRL-proximal's parameters: the rate of a coordinate is alpha / (beta + root of its squared gradients)."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and row of each feature of each row once, by row and then coordinate."""
    h, row = term_hashes(raw, at)
    odd, found = multipliers(len(SHAPES) * 4), []
    for k, shape in enumerate(SHAPES):
        n = len(h) - shape[-1]
        if n <= 0:
            continue
        x = np.full(n, odd[4 * k + 3], np.uint64)
        for j, d in enumerate(shape):
            x += h[d : d + n] * odd[4 * k + j]
        keep = row[:n] == row[shape[-1] :]
        found.append((row[:n][keep].astype(np.uint64) << np.uint64(BITS)) | (mix(x[keep]) >> np.uint64(64 - BITS)))
    each = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
    return (each & np.uint64(INTERCEPT - 1)).astype(np.int64), (each >> np.uint64(BITS)).astype(np.int64)


class Learner:
    """FTRL-proximal's state over all coordinates and the intercept."""

    def __init__(self, z: np.ndarray, n: np.ndarray, rates: Rates):
        self.z, self.n, self.rates = z, n, rates

    def weights(self, at: np.ndarray) -> np.ndarray:
        r, z = self.rates, self.z[at]
        l1 = np.where(at == INTERCEPT, 0.0, r.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One document: its coordinates, each once, and its label."""
        w = self.weights(at)
        g = chance(w.sum()) - label
        was = self.n[at]
        now = was + g * g
        self.z[at] += g - (np.sqrt(now) - np.sqrt(was)) / self.rates.alpha * w
        self.n[at] = now


def chance(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, tables: Tables, rates: Rates = Rates(), passes: int = PASSES, sample: int = SAMPLE) -> pd.DataFrame:
    """Coordinates and their weights, of those that aren't 0. ``docs``: doc_id, text; ``labels``: doc_id, label."""
    spark = docs.sparkSession
    chosen = labels.where("label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("place", order("doc_id")).orderBy("place", "doc_id").limit(sample)
    known = F.broadcast(tables.put(chosen, "chosen"))  # at most ``sample`` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                at, row = features(*text_bytes(s.column("text")))
                ends = np.searchsorted(row, np.arange(len(s) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in ("place", "label")), lists], ["place", "label", "at"])

    small_batches(spark)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(known, F.col("id").eqNullSafe(F.col("doc_id"))).select("place", "label", "text")
    rows = tables.put(texts.mapInArrow(extract, "place long, label int, at array<int>"), "features")
    kept = np.zeros(INTERCEPT, bool)
    kept[_often(rows)] = True
    # Held from pass to pass, and made again from the table of features where an executor is lost.
    dealt = _dealt(rows, kept).persist()
    try:
        shards = max(1, dealt.select("shard").distinct().count())
        z, n = np.zeros(INTERCEPT + 1), np.zeros(INTERCEPT + 1)
        for _ in range(passes):
            z, n = _passed(dealt, z, n, rates, shards)
    finally:
        dealt.unpersist()
    w = Learner(z, n, rates).weights(np.arange(INTERCEPT + 1))
    at = np.flatnonzero(w)
    return pd.DataFrame({"at": at, "w": w[at]})


def _often(rows: DataFrame) -> np.ndarray:
    """The coordinates that at least ``LEAST`` documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(INTERCEPT, np.int64)
        for b in batches:
            n += np.bincount(b.column("at").flatten().to_numpy(), minlength=INTERCEPT)
        at = np.flatnonzero(n)
        for part in np.array_split(at, len(at) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["at", "n"])

    sums = rows.select("at").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= LEAST).select("at").toArrow()["at"].to_numpy()  # of all coordinates at most


def _dealt(rows: DataFrame, kept: np.ndarray) -> DataFrame:
    """Documents by shard in hash order, with the coordinates that are learned."""
    mask = rows.sparkSession.sparkContext.broadcast(np.packbits(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.unpackbits(mask.value).astype(bool)
        for b in batches:
            lists = b.column("at")
            at, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            keep = some[at]
            ends = np.append(0, np.cumsum(keep))[bounds].astype(np.int32)
            shard = (b.column("place").to_numpy() % SHARDS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column("place"), b.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[keep]))], ["shard", "place", "label", "at"])

    out = rows.mapInArrow(run, "shard int, place long, label int, at array<int>")
    return out.repartition(SHARDS, "shard").sortWithinPartitions("shard", "place", "label", "at")


def order(key: str) -> Column:
    """A hash of an id, the same for any partitioning."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _passed(dealt: DataFrame, z: np.ndarray, n: np.ndarray, rates: Rates, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The state after each shard has learned its documents from the state given, averaged over the shards."""
    known = dealt.sparkSession.sparkContext.broadcast((z, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, touched = None, None, None
        for b in batches:
            lists = b.column("at")
            for i, (s, y) in enumerate(zip(b.column("shard").to_pylist(), b.column("label").to_pylist())):
                if s != shard:
                    if own is not None:
                        yield from changes(shard, own, touched)
                    shard, own = s, Learner(*(x.copy() for x in known.value), rates)
                    touched = np.zeros(INTERCEPT + 1, bool)
                at = np.append(lists[i].values.to_numpy(), INTERCEPT)
                own.learn(at, y)
                touched[at] = True
        if own is not None:
            yield from changes(shard, own, touched)

    def changes(shard: int, own: Learner, touched: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(touched)
        for part in np.array_split(at, len(at) // 50_000 + 1):
            dz, dn = ((x[part] - y[part]).astype(np.float32).tobytes() for x, y in zip((own.z, own.n), known.value))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in (part.astype(np.int32).tobytes(), dz, dn))], ["shard", "at", "dz", "dn"])

    z, n = z.copy(), n.copy()
    got = dealt.mapInArrow(run, "shard int, at binary, dz binary, dn binary").collect()  # 12 bytes for each coordinate of a shard at most
    for r in sorted(got, key=lambda r: r.shard):  # a shard has a coordinate once
        at = np.frombuffer(r.at, np.int32)
        for total, v in zip((z, n), (r.dz, r.dn)):
            total[at] += np.frombuffer(v, np.float32).astype(np.float64) / shards
    known.destroy()
    return z, n


def score(docs: DataFrame, model: pd.DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1; higher: toxic is likelier) and predicted (1 from 0.5 on) of each document."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((model["at"].to_numpy(), model["w"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(INTERCEPT + 1)
        w[known.value[0]] = known.value[1]
        for b in batches:
            for s in slices(b, "text"):
                at, row = features(*text_bytes(s.column("text")))
                p = chance(np.bincount(row, w[at], minlength=len(s)) + w[INTERCEPT])
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    small_batches(spark)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
