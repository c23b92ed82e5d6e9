"""Operators over ordered series: one partition column, one order column, a tie-break.

Greedy merges are cut into islands first: a gap of at least the refractory time starts a new group whatever came before, so
islands are dealt to tasks on their own. Where an island begins is found in buckets of time: neighbours within a bucket by a
window over it, and neighbours across buckets by a window over one row a bucket. Within its task an island is read as a
sorted stream with one open group, so a dense recording takes time in proportion and constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket of time is so many gaps wide.
BUCKET_GAPS = 1024


def by(part: list[str] | str, *order: str) -> Window:
    return Window.partitionBy(*([part] if isinstance(part, str) else part)).orderBy(*order)


def robust_z(df: DataFrame, value: str, part: list[str], out: str = "z") -> DataFrame:
    """(x - median) / (1.4826 MAD) within each partition; 0 where the MAD is 0. One shuffle serves both medians."""
    w = Window.partitionBy(*part)
    df = df.withColumn("_m", F.median(value).over(w)).withColumn("_d", F.median(F.abs(F.col(value) - F.col("_m"))).over(w))
    return df.withColumn(out, F.when(F.col("_d") > 0, (F.col(value) - F.col("_m")) / (1.4826 * F.col("_d"))).otherwise(0.0)).drop("_m", "_d")


def tkeo(df: DataFrame, value: str, part: list[str], order: list[str], out: str = "tkeo") -> DataFrame:
    """x[n]^2 - x[n-1] x[n+1] over rows; rows without both neighbours go."""
    w = by(part, *order)
    x = F.col(value)
    return df.withColumn(out, x * x - F.lag(value).over(w) * F.lead(value).over(w)).where(F.col(out).isNotNull())


def smoothed(df: DataFrame, value: str, part: list[str], order: list[str], width: int = 5, out: str = "smooth") -> DataFrame:
    """Moving sum over ``width`` rows divided by ``width``, edges too (zeros beyond them)."""
    half = width // 2
    return df.withColumn(out, F.sum(value).over(by(part, *order).rowsBetween(-half, width - 1 - half)) / width)


def local_peaks(df: DataFrame, value: str, part: list[str], order: list[str], threshold: float) -> DataFrame:
    """Rows above the threshold and strictly above both neighbours; first and last rows are none."""
    w = by(part, *order)
    x = F.col(value)
    df = df.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w))
    return df.where((x > threshold) & (x > F.col("_p")) & (x > F.col("_n"))).drop("_p", "_n")


def islands(df: DataFrame, t: str, part: list[str], order: list[str], gap: float, out: str = "island", first: str = "_first") -> DataFrame:
    """Adds ``out``, the time at which a row's run of rows with gaps below ``gap`` begins, and whether it is the run's first.
    Rows without a time go."""
    rows = df.withColumn("_b", F.floor(F.col(t) / (gap * BUCKET_GAPS)))
    w = by([*part, "_b"], *order)
    rows = rows.withColumn("_before", F.lag(t).over(w))
    inner = F.when(F.col(t) - F.col("_before") >= gap, F.col(t))
    # one row a bucket: its first and last times, and the begin of its last run that begins within it
    ends = rows.groupBy(*part, "_b").agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"), F.max(inner).alias("_last"))
    u = by(part, "_b")
    ends = ends.withColumn("_new", F.coalesce(F.col("_lo") - F.lag("_hi").over(u) >= gap, F.lit(True)))
    ends = ends.withColumn("_last", F.coalesce("_last", F.when(F.col("_new"), F.col("_lo"))))
    ends = ends.withColumn("_open", F.when(F.col("_new"), F.col("_lo")).otherwise(F.last("_last", ignorenulls=True).over(u.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.join(ends.select(*part, "_b", "_new", "_open"), [*part, "_b"])
    w = by([*part, "_b"], *order)
    begins = F.coalesce(F.col(t) - F.col("_before") >= gap, F.col("_new"))
    rows = rows.withColumn(first, begins)
    rows = rows.withColumn(out, F.coalesce(F.last(F.when(F.col(first), F.col(t)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open")))
    return rows.select(*df.columns, out, first)


def by_island(df: DataFrame, t: str, part: list[str], order: list[str], gap: float, keep, also: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` that ``keep`` leaves: it gets each task's islands as sorted record batches with the columns of ``df``,
    ``also``, and ``_first`` at an island's first row."""
    cut = islands(df, t, part, order, gap, "_island").withColumns(also)
    dealt = cut.repartition(*part, "_island").sortWithinPartitions(*part, "_island", *order)
    return dealt.drop("_island").mapInArrow(keep, df.schema)


def refractory(df: DataFrame, t: str, score: str, part: list[str], order: list[str], period: float) -> DataFrame:
    """Groups rows from an anchor on while ``t - anchor < period``; keeps each group's best, the first of equals.

    The anchor doesn't move, so this isn't a session: 0, 8, 12, 30 with a period of 10 are three groups.
    """
    names = df.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = best = None
        held: pa.RecordBatch | None = None  # the open group's best row, if it came in an earlier batch
        for b in batches:
            taken, open_at = [], None
            for i, (x, s, new) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_t", "_s", "_first")))):
                if anchor is None or new or x - anchor >= period:
                    if held is not None:
                        yield held
                    elif open_at is not None:
                        taken.append(open_at)
                    anchor, best, open_at, held = x, s, i, None
                elif s is not None and (best is None or s > best):
                    best, open_at, held = s, i, None
            b = b.select(names)
            if taken:
                yield b.take(pa.array(taken))
            if open_at is not None:
                held = b.slice(open_at, 1)
        if held is not None:
            yield held

    return by_island(df, t, part, order, period, keep, {"_t": F.col(t), "_s": F.col(score)})


def suppressed(df: DataFrame, t: str, score: str, part: list[str], order: list[str], width: float) -> DataFrame:
    """Non-maximum suppression: by falling score, a row stays unless one that stays is nearer than ``width``.

    A row that stays rules out its surroundings, a slice of the sorted times; rows that stay are ``width`` apart, so no row
    is ruled out more than a few times. A task holds one island at a time.
    """
    names = df.columns

    def stays(x: pa.Table | pa.RecordBatch) -> pa.Table | pa.RecordBatch:
        """Of whole islands, the rows that stay."""
        at = [float(v) for v in x.column("_t").to_pylist()]
        score = [-float(v) if v is not None and v == v else float("inf") for v in x.column("_s").to_pylist()]
        begins = [i for i, new in enumerate(x.column("_first").to_pylist()) if new or i == 0]
        kept = [True] * len(at)
        for a, z in zip(begins, [*begins[1:], len(at)]):
            if z - a == 1:
                continue
            out = [False] * (z - a)
            for i in sorted(range(a, z), key=score.__getitem__):
                if out[i - a]:
                    kept[i] = False
                    continue
                j = i - 1
                while j >= a and at[j] > at[i] - width:
                    out[j - a] = True
                    j -= 1
                j = i + 1
                while j < z and at[j] < at[i] + width:
                    out[j - a] = True
                    j += 1
        return x.select(names).filter(pa.array(kept, pa.bool_()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the island that is open
        for b in batches:
            begins = np.flatnonzero(b.column("_first").to_numpy(zero_copy_only=False))
            if not len(begins):
                held.append(b)
                continue
            a, z = int(begins[0]), int(begins[-1])
            before = [*held, b.slice(0, a)]
            if any(x.num_rows for x in before):
                yield from stays(pa.Table.from_batches(before)).to_batches()
            if z > a:
                yield stays(b.slice(a, z - a))
            held = [b.slice(z)]
        if held:
            yield from stays(pa.Table.from_batches(held)).to_batches()

    return by_island(df, t, part, order, width, keep, {"_t": F.col(t), "_s": F.col(score)})


def threshold_runs(df: DataFrame, value: str, part: list[str], order: list[str], threshold: float) -> DataFrame:
    """Runs of rows above the threshold: first and last position, length, and the position of the first maximum."""
    w = by(part, *order)
    df = df.withColumn("pos", F.row_number().over(w) - 1)
    above = df.where(F.col(value) > threshold)
    above = above.withColumn("_run", F.col("pos") - F.row_number().over(by(part, "pos")))
    return above.groupBy(*part, "_run").agg(
        F.min("pos").cast("long").alias("start_pos"),
        F.max("pos").cast("long").alias("end_pos"),
        F.count("*").alias("n_rows"),
        F.max_by("pos", F.struct(value, -F.col("pos"))).cast("long").alias("peak_pos"),
    ).drop("_run")


def chunk_ranges(df: DataFrame, length: str, chunk: int, overlap: int) -> DataFrame:
    """Overlapping ranges [start, end) that cover each row's length; the first that reaches the end is the last."""
    step = chunk - overlap
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col(length) - 1, F.lit(0)).cast("long"), F.lit(step).cast("long"))
    out = df.select("*", F.posexplode(starts).alias("chunk_id", "start_sample")).where(F.col(length) > 0)
    out = out.where((F.col("start_sample") == 0) | (F.col("start_sample") - step + chunk < F.col(length)))
    return out.withColumn("end_sample", F.least(F.col("start_sample") + chunk, F.col(length).cast("long")))


def spaced_peaks(df: DataFrame, value: str, part: list[str], order: list[str], threshold: float, min_distance: int) -> DataFrame:
    """Largest row of each run above the threshold; after a run's end, ``min_distance`` more rows are left out, so a run that
    begins among them is cut. Columns of ``part`` and peak_pos, v."""
    above = df.withColumn("pos", F.row_number().over(by(part, *order)) - 1).where(F.col(value) > threshold)
    rows = above.select(*part, F.col("pos").cast("int").alias("peak_pos"), F.col(value).cast("double").alias("v"))
    names = rows.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = best = None
        held: pa.RecordBatch | None = None
        for b in batches:
            taken, open_at = [], None
            for i, (pos, v, new) in enumerate(zip(*(b.column(c).to_pylist() for c in ("peak_pos", "v", "_first")))):
                if new or last is None or pos >= last + 1 + min_distance:  # a run begins
                    if held is not None:
                        yield held
                    elif open_at is not None:
                        taken.append(open_at)
                    last, best, open_at, held = pos, v, i, None
                elif pos == last + 1:
                    last = pos
                    if v > best:
                        best, open_at, held = v, i, None
            b = b.select(names)
            if taken:
                yield b.take(pa.array(taken))
            if open_at is not None:
                held = b.slice(open_at, 1)
        if held is not None:
            yield held

    return by_island(rows, "peak_pos", part, ["peak_pos"], min_distance + 1, keep, {})
