"""Tables that cut lineage: written once in the folder that all executors share, then read back."""

from __future__ import annotations

import tempfile
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its machine; a session
    whose executors are elsewhere gets an error, as they would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session end at 8 MB, where they may be larger: 10,000 texts of any length would not fit beside
    each other in the memory of a task's Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Every folder that was opened by this driver, in order; names, not data.
_OPENED: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _OPENED.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _OPENED[-1]


class Intermediates:
    """Folders that were opened since this was made, whoever opened them: for a caller who has written what was computed from
    them and reads none of them again."""

    def __init__(self) -> None:
        self.start = len(_OPENED)
        self.paths: list[str] = []

    def end(self) -> Intermediates:
        self.paths = _OPENED[self.start :]
        return self

    def remove(self, spark: SparkSession) -> None:
        for path in self.paths:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def saved(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table; with ``by``, a folder for each value of that column."""
    w = df.write.option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; a lost executor costs a re-read, not a re-run."""
    return saved(df, new_path(df.sparkSession, name))


class Tables:
    """Tables of one computation: ``put`` writes one, ``drop`` deletes it, and leaving the block deletes all but those that
    were given to ``keep``, as what the returned DataFrame reads must be."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.open: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{name}")
        out = saved(df, path, by)
        self.open.append((out, path))
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        self.open = [x for x in self.open if x[0] is not df]
        return df

    def drop(self, df: DataFrame) -> None:
        for x in [x for x in self.open if x[0] is df]:
            self.open.remove(x)
            removed(self.spark, x[1])

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        for _, path in self.open:
            removed(self.spark, path)
        self.open.clear()
