"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labflow.llm.common import cut, let_go


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node of its component.

    Each round links neighbours to the smallest one (large star: larger
    neighbours; small star: smaller ones), so a hub never has to be gathered:
    minima are combined before the shuffle, and the joins are plain equi-joins
    that adaptive execution can split where a node is hot. Each round is cut to
    the checkpoint folder. Self-loops and null ends are ignored; no edges give no rows.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        nearer = linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = cut(nearer.unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        after = _state(then)
        if after == state:
            break
        now, state = then, after
        del both, least, large, linked, nearer, then
        let_go(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
