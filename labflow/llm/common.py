"""What the operators share: cutting lineage, reading tables and Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labflow.operators.once import cut as cut

#: Bytes of a batch of rows that Python gets.
BATCH_BYTES = 4 << 20


def unused(df: DataFrame, stem: str = "_own") -> str:
    """A prefix that no column of df begins with, for columns that an operator adds for a while."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    return stem


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints that nothing refers to any more.

    Its cleaner acts on what the driver's collector finds; a driver with much
    memory and little to do may not collect for the whole of a long loop.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Have a Python worker hand the memory that it has freed back to the machine; idle workers of earlier stages would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(df: DataFrame) -> DataFrame:
    """df, with a session that hands texts to Python in batches of a few MB, so that long ones don't add up in a worker.

    Spark has no such setting for a single query, so it holds for the session
    from then on; one that the session's owner has made stays as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def small(df: DataFrame, limit: int) -> DataFrame:
    """df, marked for broadcast if a count shows that it has at most limit rows.

    df should be cheap to count, such as a cut table.
    """
    return F.broadcast(df) if len(df.limit(limit + 1).select(F.lit(1)).collect()) <= limit else df
