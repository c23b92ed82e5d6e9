"""Language identification by rank-order profiles.

A profile is a language's ``top`` most frequent letter n-grams (one to three letters, words bounded by a blank), ranked by
count over all training texts, ties by the n-gram. A document's own most frequent n-grams are ranked alike, and the
out-of-place distance to a language is the sum of rank differences, ``top`` for an n-gram that the profile lacks.

Profiles hold languages x ``top`` rows whatever the corpus's size; counts are summed in Spark.

Defined cases: null text or text without a letter is ``und`` with score 0; without any training text every document is;
equal distances go to the first name, equal counts to the lower n-gram; very long texts are read whole; repeated rows count
as often as they occur, and are each predicted; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import slices
from .scratch import small_batches

TOP = 300
#: Distinct n-grams that a task holds before it passes their counts on.
HELD = 2_000_000

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters; built once per worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as tagged integers; empty if it has no letter."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[c], c, 0).astype(np.uint64)
    one = c[c > 0]
    if not len(one):
        return one
    two = ((c[:-1] << np.uint64(21)) | c[1:])[(c[:-1] > 0) | (c[1:] > 0)]
    three = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[c[1:-1] > 0]
    return np.concatenate([one | np.uint64(3 << 62), two | np.uint64(1 << 63), three])


def counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return g[at], np.diff(np.append(at, len(g)))


def ranked(g: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by the n-gram."""
    u, n = counted(g)
    if len(u) > top:  # only what can be among the first
        least = np.partition(n, len(n) - top)[len(n) - top]
        u, n = u[n >= least], n[n >= least]
    return u[np.argsort(-n, kind="stable")][:top]


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """The profile of each language of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)

        def out() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                u = np.concatenate([p[0] for p in parts])
                n = np.concatenate([p[1] for p in parts])
                u, back = np.unique(u, return_inverse=True)
                n = np.bincount(back, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        size = 0
        for b in batches:
            for s in slices(b, "text"):
                found = defaultdict(list)
                for k, t in zip(s.column("lang").to_pylist(), s.column("text").to_pylist()):
                    if t and len(g := grams(t)):
                        found[k].append(g)
                for k, g in found.items():
                    held[k].append(counted(np.concatenate(g)))
                    size += len(held[k][-1][0])
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), F.expr("gram < 0"), "gram")  # as unsigned, like the documents' own
    best = sums.withColumn("place", F.row_number().over(first)).where(F.col("place") <= top)
    profiles: dict[str, list] = defaultdict(list)
    for r in sorted(best.collect(), key=lambda r: (r.lang, r.place)):
        profiles[r.lang].append(r.gram)
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in profiles.items()}


class Matcher:
    """Distances of a text to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int):
        self.names, self.top = sorted(profiles), top
        self.known = np.unique(np.concatenate([profiles[n] for n in self.names]))
        self.ranks = np.full((len(self.known) + 1, len(self.names)), -1, np.int32)
        for j, n in enumerate(self.names):
            self.ranks[np.searchsorted(self.known, profiles[n]), j] = np.arange(len(profiles[n]))

    def best(self, text: str | None) -> tuple[str, float]:
        if not text or not len(g := grams(text)):
            return "und", 0.0
        g = ranked(g, self.top)
        at = np.searchsorted(self.known, g)
        at = np.where(self.known[np.minimum(at, len(self.known) - 1)] == g, at, len(self.known))
        r = self.ranks[at]
        far = np.where(r < 0, self.top, np.abs(r - np.arange(len(g))[:, None])).sum(0)
        j = int(far.argmin())
        return self.names[j], float(1 - far[j] / (self.top * len(g)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", key: str = "doc_id", top: int = TOP) -> DataFrame:
    """One row per document: key, lang_pred and score (1: the profile's own order, 0: nothing in common)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(profiles, top) if profiles else None
        for b in batches:
            got = [m.best(t.as_py()) if m else ("und", 0.0) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
