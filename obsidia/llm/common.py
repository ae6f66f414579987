"""What the corpus operators share: the shared folder, written intermediate tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of whole texts that a Python worker holds at once.
TEXT_BATCH_ROWS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, one of our own if all run on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="obsidia-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


#: For each open scratch_of(), the paths that were given out within it.
_given: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _given:
        paths.append(path)
    return path


@contextmanager
def scratch_of() -> Iterator[list[str]]:
    """The scratch paths that are given out within, also by what is called."""
    paths: list[str] = []
    _given.append(paths)
    try:
        yield paths
    finally:
        _given.remove(paths)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from Parquet in the shared folder: later stages don't compute them again, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table of written(), once what was made of it is written too."""
    delete(df.sparkSession, [df.written_to])


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that carry whole texts to Python workers, also of results that run later.

    It is the one value that stays set, whichever operators are called, and a smaller one of the session's own is left as it is.
    """
    if int(spark.conf.get(_BATCH)) > TEXT_BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(TEXT_BATCH_ROWS))


@contextmanager
def batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> Iterator[None]:
    """Batches of so many rows for what is written within; the session's own setting comes back."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key at a time, from batches that arrive sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        at = 0
        for i in [*((keys[1:] != keys[:-1]).nonzero()[0] + 1), batch.num_rows]:
            if held and held[-1].column(key)[0].as_py() != keys[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, i - at))
            at = i
    if held:
        yield pa.Table.from_batches(held)
