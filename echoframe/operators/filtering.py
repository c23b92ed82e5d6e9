"""Filters and resampling of recordings that are many tasks' work.

A cascade of sections is linear in its states and its input: after a piece of n samples the states are A**n times those before
it, plus what the piece alone leaves from rest. Such affine maps compose, so the states before every piece follow from a
parallel prefix over the pieces: each piece is filtered from rest where it is, its states (two numbers a section) go to groups
of ``FAN`` neighbours, whose compositions go to groups of their own, until a recording has one group; then states are handed
down again. Samples never meet in one task, and the result is that of the whole recording but for rounding (1e-9).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import kernels
from ..sources import ranges
from ..stages import cut

#: Pieces of a group.
FAN = 1024


def moved(sos: np.ndarray, states: np.ndarray, n: int) -> np.ndarray:
    """States after ``n`` samples of silence."""
    return np.linalg.matrix_power(kernels.silence(sos), n) @ states


def entering(df: DataFrame, keys: list[str], sos: np.ndarray, fan: int = FAN) -> DataFrame:
    """The states before each piece, from rest before the first. ``df``: keys, k (from 0, without gaps), n (samples) and left
    (what the piece leaves from rest); the result has keys, k and states. ``df`` is read more than once: cut it first."""
    top = df.agg(F.max("k")).first()[0] or 0
    rows = df.select(*keys, "k", "n", "left").withColumn("group", F.floor(F.col("k") / fan).cast("long"))
    size = 2 * len(sos)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def composed(g: pd.DataFrame) -> pd.DataFrame:
        g, s = g.sort_values("k"), np.zeros(size)
        for n, left in zip(g["n"], g["left"]):
            s = moved(sos, s, int(n)) + left
        return g.iloc[:1].assign(k=g["group"].iloc[0], n=g["n"].sum(), left=[s])[[*keys, "k", "n", "left"]]

    def handed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        s, out = np.asarray(g["states"].iloc[0], float), []
        for n, left in zip(g["n"], g["left"]):
            out.append(s)
            s = moved(sos, s, int(n)) + left
        return g.assign(states=out)[[*keys, "k", "states"]]

    if top < fan:
        start = rows.withColumn("states", F.array_repeat(F.lit(0.0), size))
    else:
        totals = cut(rows.groupBy(*keys, "group").applyInPandas(composed, f"{fields}, k long, n long, left array<double>"))
        start = rows.join(entering(totals, keys, sos, fan).withColumnRenamed("k", "group"), [*keys, "group"])
    return start.groupBy(*keys, "group").applyInPandas(handed, f"{fields}, k long, states array<double>")


def filtered(df: DataFrame, keys: list[str], samples: str, sos: np.ndarray) -> DataFrame:
    """``df`` (keys, k, samples) with ``samples`` through the cascade as if each recording's pieces were one signal. The pieces
    move once, to their states."""

    @F.arrow_udf("array<double>")
    def rest(x: pa.Array) -> pa.Array:
        return pa.array([kernels.carried(sos, v)[1] for v in signals(x)], pa.list_(pa.float64()))

    @F.arrow_udf("array<double>")
    def run(x: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array([kernels.carried(sos, v, t)[0] for v, t in zip(signals(x), signals(s))], pa.list_(pa.float64()))

    left = cut(df.select(*keys, "k", F.size(samples).cast("long").alias("n"), rest(doubles(samples)).alias("left")))
    return df.join(entering(left, keys, sos), [*keys, "k"]).withColumn(samples, run(doubles(samples), F.col("states"))).drop("states")


def zero_phase(df: DataFrame, keys: list[str], samples: str, sos: np.ndarray) -> DataFrame:
    """``df`` with ``samples`` through the cascade forward and backward, odd extensions at both ends of each recording. The
    first and last pieces must be longer than the extension, 3 * (2 * sections + 1) samples, or be the whole recording; a
    recording of one sample has no phase and goes forward only."""
    reach = 3 * (2 * len(sos) + 1)
    ends = df.groupBy(*keys).agg(F.max("k").alias("_last"), F.sum(F.size(samples)).alias("_n"))
    rows = df.join(ends, keys).withColumns({"_x": doubles(samples), "_e": F.least(F.lit(reach), F.col("_n") - 1).cast("int")})
    x, e = F.col("_x"), F.col("_e")
    first, last = F.col("k") == 0, F.col("k") == F.col("_last")
    short = (first | last) & (F.size(x) <= e)
    rows = rows.withColumn("_x", F.when(short, F.raise_error(F.lit("a first or last piece is shorter than the filter's extension")).cast("array<double>")).otherwise(x))
    nothing = F.array().cast("array<double>")
    front = F.when(first & (e > 0), F.transform(F.reverse(F.slice(x, 2, e)), lambda v: 2 * F.element_at(x, 1) - v)).otherwise(nothing)
    back = F.when(last & (e > 0), F.transform(F.reverse(F.slice(x, F.size(x) - e, e)), lambda v: 2 * F.element_at(x, -1) - v)).otherwise(nothing)
    rows = rows.withColumn("_y", F.concat(front, x, back))
    there = filtered(rows.drop("_x"), keys, "_y", sos)
    turned = there.withColumns({"_f": F.when(F.col("_n") == 1, F.col("_y")), "_y": F.reverse("_y"), "_k": F.col("k"), "k": F.col("_last") - F.col("k")})
    again = filtered(turned, keys, "_y", sos).withColumns({"_y": F.reverse("_y"), "k": F.col("_k")})
    y = F.slice(F.col("_y"), F.when(F.col("k") == 0, e).otherwise(0) + 1, F.size(samples))
    return again.withColumn(samples, F.coalesce("_f", y)).drop("_last", "_n", "_e", "_f", "_y", "_k")


def doubles(samples: str) -> Column:
    return F.col(samples).cast("array<double>")


def signals(x: pa.Array) -> Iterator[np.ndarray]:
    for v in x:
        yield v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else np.empty(0)


def preprocessed_chunks(found: DataFrame, chunk_s: float = 60.0, overlap_s: float = 0.5, rate: int | None = None, cutoff: float | None = None, order: int = 4, mono: str = "mean", which: int = 0, array_rate: int = ranges.ARRAY_RATE, split_bytes: int = ranges.SPLIT_BYTES) -> DataFrame:
    """The chunks of :func:`audio.chunks` with ``rate`` or ``cutoff``, each made from its own bytes.

    A chunk reads its samples and, to resample, the taps around them; the high-pass starts from the states before it. Samples
    are read twice where there is a cutoff, and don't move."""
    grid = ranges.Grid(chunk_s, overlap_s)
    heads = cut(ranges.headers(found, array_rate))
    rows = ranges.pieces(heads, grid, rate)
    total = heads.where("error is null").agg(F.sum(F.col("frames") * F.col("channels") * F.col("width"))).first()[0] or 0
    tasks = max(1, -(-int(total) // split_bytes))
    dealt = lambda df: df.repartition(tasks, "source_file", "k")  # noqa: E731  rows are small, what they stand for is not
    rates = [r[0] for r in rows.select("rate").distinct().collect()] if cutoff is not None else []
    sections = {r: kernels.butterworth(order, cutoff, r, "highpass") for r in rates if cutoff < r / 2}

    def source(r: dict, f: ranges.Bytes, lo: int, hi: int) -> np.ndarray:
        at = ranges.layout(f, array_rate)
        if r["rate"] == at.rate:
            return ranges.samples(f, at, lo, hi, mono, which)
        return kernels.resampled_part(lambda a, b: ranges.samples(f, at, a, b, mono, which), at.rate, r["rate"], lo, hi)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with ranges.Bytes(r["source_file"]) as f:
                    hi = min(r["lo"] + r["step"], r["n"])
                    s = kernels.carried(sections[r["rate"]], source(r, f, r["lo"], hi))[1]
                yield pa.RecordBatch.from_arrays([pa.array([r["source_file"]]), pa.array([r["rate"]], pa.int32()), pa.array([r["k"]]), pa.array([hi - r["lo"]]), pa.array([s], pa.list_(pa.float64()))], ["source_file", "rate", "k", "n", "left"])

    if sections:
        some = rows.where(F.col("rate").isin(list(sections)))
        done = cut(dealt(some).mapInArrow(left, "source_file string, rate int, k long, n long, left array<double>"))
        states = None
        for r, sos in sections.items():  # as many as there are rates of recordings
            one = entering(done.where(F.col("rate") == r), ["source_file"], sos)
            states = one if states is None else states.unionByName(one)
        rows = rows.join(states, ["source_file", "k"], "left")
    else:
        rows = rows.withColumn("states", F.lit(None).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schemas.CHUNKS.split(", ")]
        for b in batches:
            for r in b.to_pylist():
                with ranges.Bytes(r["source_file"]) as f:
                    x = source(r, f, r["lo"], r["hi"])
                if r["states"] is not None:
                    x = kernels.carried(sections[r["rate"]], x, np.array(r["states"]))[0]
                row = ranges.named(r["source_file"]) | {"chunk_id": r["k"], "start_sample": r["lo"], "sample_rate": r["rate"], "samples": x.astype(np.float32)}
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], ranges.COLUMNS[c]) for c in names], names)

    return dealt(rows).mapInArrow(run, schemas.CHUNKS)
