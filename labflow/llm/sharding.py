"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labflow.llm.common import cut, small, table

#: Rows whose slots one task numbers, about, and equal rows that one task writes.
ROWS, EQUAL = 4096, 1 << 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, by the jumps of Lamping and Veach: no table, and one more shard takes rows only into itself."""
    key, shard = keys.astype(np.uint64), np.full(len(keys), -1, np.int64)
    at = np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(going):
            shard[going] = at[going]
            key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
            step = ((key[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            at[going] = ((shard[going] + 1) * (float(1 << 31) / step)).astype(np.int64)
            going = going[at[going] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long column; a null key counts as 0."""

    @F.pandas_udf("int")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(jump(p.to_numpy(np.int64), shards).astype(np.int32))

    return each(F.coalesce(key, F.lit(0).cast("long")))


def shard(docs: DataFrame, shards: int = 16, rows: int = ROWS, equal: int = EQUAL) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text, any others).

    The law is `key`: doc_id and the number of shards decide. size is the text's
    UTF-8 bytes plus 1 (null: 1), slot numbers a shard's rows from 0 without
    gaps, by hash; grown_shard is the shard if there were one more. Null ids
    share a shard; no rows give no rows; other columns are ignored. Rows that
    are equal in all that is returned are counted before anything is numbered,
    and written `equal` at a time, so one that comes very often fills no task.
    Shards are numbered in pieces of about `rows` rows, whose sizes give where
    each piece begins.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.xxhash64("doc_id")
    own = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("h"))
    own = cut(own.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count(F.lit(1)).alias("n")))
    pieces = 1 << max(0, (own.count() // (rows * shards)).bit_length())
    piece = F.pmod(F.xxhash64(F.col("h"), F.col("text_crc32")), F.lit(pieces))
    put = cut(own.withColumn("shard", shard_of(F.col("h"), shards)).withColumn("grown_shard", shard_of(F.col("h"), shards + 1)).withColumn("piece", piece))
    counts = put.groupBy("shard", "piece").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    within = F.sum("n").over(Window.partitionBy("shard", "piece").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    slots = put.withColumn("within", within).join(small(starts, 100_000), ["shard", "piece"]).withColumn("first", F.col("start") + F.col("within"))
    if not put.where(F.col("n") > equal).isEmpty():
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(equal).cast("long"))).alias("at")
        split = slots.where(F.col("n") > equal).select("*", part).select(*(c for c in slots.columns if c not in ("n", "first")), F.least(F.lit(equal).cast("long"), F.col("n") - F.col("at")).alias("n"), (F.col("first") + F.col("at")).alias("first"))
        slots = slots.where(F.col("n") <= equal).unionByName(split.repartition("shard", "first"))
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 16)
