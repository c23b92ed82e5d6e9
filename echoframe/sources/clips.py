"""A sink of WAV files, one a row, that holds whole clips only: tasks write to a staging folder, the driver's commit puts what the
successful attempts wrote in place, and an abort leaves nothing. Files go through Arrow's file systems, as in ``ranges``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .audio import encode
from .ranges import located

SCHEMA = "name string, rate int, samples array<double>"


@dataclass
class Written(WriterCommitMessage):
    """Where an attempt's files stand, and their names."""

    folder: str
    names: list[str]


class Writer(DataSourceArrowWriter):
    """Writes rows of ``SCHEMA``. Of rows with one name, whichever attempt is put in place last stands."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, names = f"{self.staging}/{uuid.uuid4().hex}", []
        system, place = located(folder)
        system.create_dir(place)
        for b in iterator:
            for name, rate, x in zip(b.column("name").to_pylist(), b.column("rate").to_pylist(), b.column("samples")):
                if not name or "/" in name:
                    raise ValueError(f"no name of a clip: {name!r}")
                with system.open_output_stream(f"{place}/{name}") as f:
                    f.write(encode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else [], rate))
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, target = located(self.path)
        moves = {n: f"{located(m.folder)[1]}/{n}" for m in messages if m for n in m.names}
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(lambda x: system.move(x[1], f"{target}/{x[0]}"), moves.items()))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, place = located(self.staging)
        if system.get_file_info(place).type != pafs.FileType.NotFound:
            system.delete_dir(place)


class Clips(DataSource):
    """WAV files under ``path``: format ``clips``, for appending."""

    @classmethod
    def name(cls) -> str:
        return "clips"

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("clips are added to a folder, never put in place of all that is there")
        return Writer(dict(self.options)["path"])


def write(df: DataFrame, folder: str) -> None:
    """One WAV file for each row (name, rate, samples)."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(Clips)
    df.select("name", F.col("rate").cast("int").alias("rate"), F.col("samples").cast("array<double>").alias("samples")).write.format("clips").mode("append").save(folder)
