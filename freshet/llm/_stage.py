"""Intermediate tables, and small helpers for partition functions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

from freshet.shared import dropped, saved

__all__ = ["bounded", "dropped", "free_name", "lean", "table", "trim", "written"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, lost executors re-read."""
    bounded(df.sparkSession)
    return saved(df, name)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it (Spark ignores case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def trim() -> None:
    """Hand freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition function that hands freed memory back to the system at its end: Python workers stay idle for later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def bounded(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker's memory doesn't follow Spark's default of 10,000 rows of text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")
