"""Helpers shared by the operators: tables, the folder that all executors share, stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set by setCheckpointDir. Where both are unset, as in tests, a local master gets a
    folder of its own; on a cluster that is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='evidencespark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch where rows hold whole texts: what a task holds outside the JVM's heap stays small.
TEXT_BATCH_ROWS = 512


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """For jobs run inside, Arrow batches have at most TEXT_BATCH_ROWS rows; the session's own setting comes back at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if 0 < int(own) <= TEXT_BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(TEXT_BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, own)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of a query run inside as it ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, own)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder, in bounded batches, and read back: it cuts the lineage and survives lost executors.
    Its shuffle files go with the write, as only the table is read from then on."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with bounded_batches(spark), freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a stored table that only stored tables were made from."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Texts that a Python worker holds as Python strings at a time; the Arrow batch they come from is bounded by Spark in bytes.
TEXTS_AT_ONCE = 256


def each_text(column: pa.Array) -> Iterator[str | None]:
    """The texts of an Arrow column, few at a time as Python strings."""
    for a in range(0, len(column), TEXTS_AT_ONCE):
        yield from column.slice(a, TEXTS_AT_ONCE).to_pylist()


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind))
