"""Whitening of embeddings by MLlib's distributed block matrices.

Each entry c becomes the whole number floor(256 * c); the fit list is each different vector once. Its rows, centred, are
indexed and cut into blocks of ``ROWS`` x ``COLUMNS``; the transposed blocks times the blocks give the scatter, which is summed
over parts of the middle dimension, so that no task gets more than a few blocks of it. The scatter (dimensions squared) goes to
the driver for its eigenvectors; a block matrix of the whitening vectors then projects all rows, block by block.

Indices are counted within the partitions of a written table and moved on by the counts of the partitions before, so rows are
numbered from 0 without gaps and without one task that sees all. Products are made in panels of at most ``PANEL`` rows, as block
matrices number rows by 32-bit integers.

Defined cases: null vectors and vectors with a null, NaN or infinite entry are left out; vectors of different lengths, or
entries beyond 2**53 / 256, are an error; repeated rows each get their own result, while the fit list holds their vector once;
a null vec_id stays null; components whose eigenvalue is 0 (up to 1e-12 of the largest) aren't returned, so that equal vectors
or one vector give no row; equal eigenvalues come in the order of the local solver; an empty table gives an empty result; other
columns aren't read. The exact deviation is a 64-bit integer, and an error where it doesn't fit one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Tables

#: Rows and columns of a block.
ROWS, COLUMNS = 1024, 1024
#: Blocks of the middle dimension that one task of a product multiplies.
BLOCKS_A_TASK = 8
#: Rows of one block matrix.
PANEL = 1 << 26
SCALE = 256
#: Of the largest eigenvalue: what counts as 0.
NOTHING = 1e-12


@dataclass
class Whitening:
    """What was fitted: the list's length and sums, eigenvalues from the largest on, and a whitening vector for each."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def whole(vector: Column) -> Column:
    """floor(256 * c) of each entry; null where the vector or an entry is null or not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    far = F.when(F.exists(vector, lambda c: F.abs(c) > 2.0**45), F.raise_error(F.lit("an entry is too large to be whitened")).cast("array<long>"))
    return F.when(vector.isNotNull() & ~bad, F.coalesce(far, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))))


def numbered(rows: DataFrame, tables: Tables, name: str) -> tuple[DataFrame, int]:
    """``rows`` with ``index`` from 0 on, and their number."""
    spark = rows.sparkSession
    own = F.monotonically_increasing_id()
    done = tables.put(rows.withColumns({"part": F.shiftright(own, 33), "place": own.bitwiseAND((1 << 33) - 1)}), name)
    counts = sorted((r.part, r.n) for r in done.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each task that wrote
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    at = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "part long, start long")
    return done.join(F.broadcast(at), "part").withColumn("index", F.col("start") + F.col("place")).drop("part", "place", "start"), starts[-1]


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """Each whole entry less the mean."""
    means = F.array(*(F.lit(s / n) for s in sums))
    return F.zip_with(x.cast("array<double>"), means, lambda a, b: a - b)


def blocks(rows: DataFrame, n: int, width: int, tall: int) -> BlockMatrix:
    """The block matrix of ``index`` and ``v`` (array of doubles), in blocks of ``tall`` rows."""
    table = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(table, n, width).toBlockMatrix(tall, COLUMNS)


def panels(rows: DataFrame, n: int, width: int) -> Iterator[tuple[int, BlockMatrix]]:
    """The matrix of all rows, in panels, and the index at which each starts."""
    for a in range(0, n, PANEL):
        some = rows.where(F.col("index").between(a, a + PANEL - 1)) if n > PANEL else rows
        yield a, blocks(some.withColumn("index", F.col("index") - a), min(PANEL, n - a), width, ROWS)


def scatter(m: BlockMatrix) -> np.ndarray:
    """The transposed matrix times itself, as products of parts of the middle dimension that are summed."""
    left, right = (x._java_matrix_wrapper._java_model for x in (m.transpose(), m))
    splits = -(-m.numRowBlocks // BLOCKS_A_TASK)
    product = BlockMatrix(left.multiply(right, splits), m.colsPerBlock, m.colsPerBlock)
    return product.toLocalMatrix().toArray()


def fit(vectors: DataFrame, tables: Tables, k: int) -> Whitening | None:
    """The whitening of the different vectors ``x`` (array of long), with ``k`` components at most. None: nothing to fit."""
    rows, n = numbered(vectors.select("x").distinct(), tables, "fit")
    if not n:
        return None
    sizes = rows.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError(f"vectors of {sizes.a} to {sizes.b} entries can't be whitened together")
    if not (d := sizes.a):
        return None
    sums = [int(s) for s in rows.agg(*(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d))).first()]
    centre = rows.select("index", centred(F.col("x"), n, sums).alias("v"))
    held = [m.persist(StorageLevel.MEMORY_AND_DISK) for _, m in panels(centre, n, d)]
    try:
        v = sum(scatter(m) for m in held) / n
        v = (v + v.T) / 2
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        some = min(k, int((e > NOTHING * max(e[0], 0)).sum())) if e[0] > 0 else 0
        if not some:
            return None
        e, u, trace = e[:some], u[:, :some] / np.sqrt(e[:some]), float(np.trace(v))
        spark = rows.sparkSession
        white = sum(scatter(m.multiply(small(spark, u))) for m in held) / n
    finally:
        for m in held:
            m._java_matrix_wrapper._java_model.blocks().unpersist(False)
    return Whitening(n, sums, e, u, trace, float(np.abs(white - np.eye(some)).max()))


def small(spark: SparkSession, u: np.ndarray) -> BlockMatrix:
    """A matrix of the driver as blocks."""
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(u.tolist())], "index long, v array<double>")
    return blocks(rows, u.shape[0], u.shape[1], COLUMNS)


def projected(rows: DataFrame, n: int, w: Whitening) -> DataFrame:
    """``index`` and ``whitened`` (array) of the ``n`` rows ``index``, ``x``."""
    spark = rows.sparkSession
    turn = small(spark, w.vectors)
    out = None
    for a, m in panels(rows.select("index", centred(F.col("x"), w.n, w.sums).alias("v")), n, len(w.sums)):
        part = callMLlibFunc("getIndexedRows", m.multiply(turn).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        part = part.select((F.col("index") + a).alias("index"), vector_to_array("vector").alias("whitened"))
        out = part if out is None else out.unionByName(part)
    return out


def whitened(table: DataFrame, k: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each row and component."""
    spark = table.sparkSession
    rows = table.select(F.col(key).alias("vec_id"), whole(F.col(vector)).alias("x")).where("x is not null")
    with Tables(spark, "whitening") as tables:
        w = fit(rows, tables, k)
        if w is None:
            return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
        own, count = numbered(rows, tables, "rows")
        sums = F.array(*(F.lit(s).cast("decimal(38,0)") for s in w.sums))
        far = F.zip_with("x", sums, lambda a, s: a.cast("decimal(20,0)") * F.lit(w.n).cast("decimal(18,0)") - s)
        deviation = F.aggregate(far, F.lit(0).cast("decimal(38,0)"), lambda t, y: (t + (y.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)")).cast("decimal(38,0)"))
        got = own.select("index", "vec_id", deviation.cast("long").alias("deviation")).join(projected(own, count, w), "index")
        explained = F.array(*(F.lit(float(e / w.trace)) for e in w.values))
        out = got.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
        out = out.select(
            F.col("vec_id"), (F.col("place") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
            "whitened", explained[F.col("place")].alias("explained"), F.lit(w.identity_error).alias("identity_error"),
        )
        return tables.keep(tables.put(out, "result"))
