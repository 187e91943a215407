"""What follows from a text alone, once for each different one: lines of reports repeat."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different values of a table that is broadcast; rows that a value must stand for on average, if there are more, for a join to pay.
MOST, LEAST_ROWS = 200_000, 4


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there.

    The folder is the session's spark.checkpoint.dir; only where none is named
    and all of Spark runs in one process (as in tests) a temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not where:
            where = tempfile.mkdtemp(prefix="labflow-checkpoint-")
            atexit.register(shutil.rmtree, where, True)
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


class Once:
    """Rows that are kept on the executors (in memory, or on disk where that is short) until release()."""

    def __init__(self, most: int = MOST) -> None:
        self.held: list[DataFrame] = []
        self.most = most

    def hold(self, df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
        """df, computed now, so that what comes after knows how its rows are dealt out; another table that it makes needless is let go."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        df.count()
        if instead is not None:
            instead.unpersist()
        return df

    def few(self, df: DataFrame) -> DataFrame:
        """Rows to be joined that are few as a rule: found now, and broadcast if they are."""
        df = cut(df)
        return F.broadcast(df) if df.count() <= self.most else df

    def release(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held.clear()

    def each(self, rows: DataFrame, column: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows with the columns that made() adds to a table of the column's different values, null included.

        They are found at once. A table of up to `most` is broadcast, so that
        rows stay where they are; a larger one is joined, and where values
        hardly repeat, made() runs on the rows.
        """
        values = rows.select(column).distinct().persist(StorageLevel.MEMORY_AND_DISK)
        n = values.count()
        if n > self.most and n * LEAST_ROWS > rows.count():
            values.unpersist()
            return made(rows)
        known = cut(made(values).withColumnRenamed(column, "_value"))
        values.unpersist()
        known = F.broadcast(known) if n <= self.most else known.hint("merge")
        return rows.join(known, rows[column].eqNullSafe(known["_value"]), "left").drop("_value")
