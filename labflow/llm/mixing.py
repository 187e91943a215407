"""Mixing sources to target weights with hash thresholds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labflow.llm.common import cut, small, table, unused

#: Hash bits that a histogram resolves; each is within one bucket of the one before, until all 60 bits are used.
BITS = 10
#: No source is taken more often than this.
MOST = 3
#: Sources whose targets and thresholds are sent to all executors; beyond it they are joined.
MOST_SOURCES = 100_000
#: Sources that one task numbers, about.
PIECE = 50_000


def words(text: Column) -> Column:
    """How many runs of other than space and U+0009 to U+000D a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def hash60(*columns: Column) -> Column:
    """60 bits of the MD5 of the columns' text, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).cast("binary")), 1, 15), 16, 10).cast("long")


def numbered(rows: DataFrame, *order: Column, piece: int = PIECE) -> DataFrame:
    """rows (a cut table) with n, their place in order from 1: by ranges of about `piece` rows, each numbered by a task."""
    parts = -(-rows.count() // piece)
    if parts <= 1:
        return rows.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("own", own).join(F.broadcast(starts), "range").select(*rows.columns, (F.col("start") + F.col("own")).alias("n"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share
    the sum of sizes; none gets over MOST times its own: the excess is shared
    again by weight until none is above. Each turn sums the sources that are
    above, and only these sums come to the driver.
    """
    own = numbered(cut(sizes), F.col("source").isNull(), F.col("source"))
    weighed = cut(own.select("source", "source_size", ((F.col("n") - 1) % 3 + 1).alias("weight")))
    total, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, above = (total or 0) / (weights or 1), 0
    while True:
        n, capped, gone = weighed.where(F.col("weight") * F.lit(level) > MOST * F.col("source_size")).agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")).first()
        if n == above:
            break
        level, above = (total - MOST * capped) / (weights - gone), n
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.lit(float(MOST)) * F.col("source_size")).alias("target"))


def plan_mix(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(source, source_size, target, copies, lim, part) from rows (source, size, h).

    Each document is taken `copies` times, and once more if h < lim: the
    threshold at which the documents' sizes come nearest to what the whole
    copies leave of the target. Histograms of sizes by source and hash bucket
    find it: each one resolves only the bucket in which the one before crossed
    the budget. Where rows of one hash, so of one doc_id and text, cross it, `part` of
    those with h = lim are taken once more, too.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    none = F.lit(0).cast("long")
    plan = cut(targets(sizes).withColumn("copies", whole).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("lim", none).withColumn("part", none).withColumn("shut", F.col("budget") <= 0))
    shift = 60
    while shift and not plan.where("not shut").isEmpty():
        # The bucket [lim, lim + width) holds the threshold; the next level splits it.
        above, shift = shift, max(0, shift - bits)
        p = small(plan.where("not shut").select(F.col("source").alias("s"), F.col("lim").alias("low"), "budget"), MOST_SOURCES)
        inside = rows.join(p, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", above) == F.shiftright("low", above)))
        sums = inside.groupBy("s", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("upto", F.sum("sum").over(upto))
        crossed = run.where(F.col("upto") > F.col("budget")).groupBy("s").agg(F.min(F.struct("bucket", "upto", "sum", "budget", "n")).alias("c"))
        # A bucket of one row, or of one hash, is split by rows: as many as come nearest.
        last = F.lit(shift == 0) | (F.col("c.n") == 1)
        left, each = F.col("c.budget") - (F.col("c.upto") - F.col("c.sum")), F.col("c.sum") / F.col("c.n")
        fit = F.floor(left / each)
        rest = left - fit * each
        take = F.when(last, F.least(fit + (each - rest < rest).cast("long"), F.col("c.n"))).otherwise(0).cast("long")
        found = crossed.select(F.col("s").alias("s2"), F.lit(True).alias("found"), F.col("c.bucket").alias("bucket"), F.col("c.n").alias("n"), take.alias("take"), left.alias("left"), last.alias("last"))
        at = F.shiftleft(F.col("bucket") + (F.col("take") == F.col("n")).cast("long"), shift)
        # A budget that no bucket crosses takes every document of the source.
        plan = cut(
            plan.join(found, F.col("source").eqNullSafe(F.col("s2")), "left").select(
                "source", "source_size", "target", "copies",
                F.coalesce("left", "budget").alias("budget"),
                F.when(F.col("shut"), F.col("lim")).when(F.col("found"), at).otherwise(F.lit(1 << 60)).alias("lim"),
                F.when(F.col("last") & (F.col("take") < F.col("n")), F.col("take")).otherwise(F.col("part")).alias("part"),
                (F.col("shut") | F.coalesce("last", F.lit(True))).alias("shut"),
            )
        )
    return plan.select("source", "source_size", "target", "copies", "lim", "part")


def mix(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text, source, any others) with size, source_size, target, times and taken.

    times is how often the mix takes the document (0 to MOST), taken its words.
    A document's hash is that of its doc_id and text, so reruns agree; rows that
    have both in common are alike, and where the threshold falls among them it
    takes some of them, by the pieces in which they are stored. A null doc_id is
    like an empty one. Null texts have no words and weigh nothing; a null source
    is one of its own, the last. No rows give no rows. Input columns of the added
    names are replaced; all others stay, whatever they are called.
    """
    docs = docs.drop("size", "source_size", "target", "times", "taken")
    p = unused(docs)
    h = hash60(F.col("doc_id"), F.col("text"))
    rows = cut(docs.select("source", words(F.col("text")).alias("size"), h.alias("h")))
    plan = plan_mix(rows, bits)
    plan = cut(plan.select(*(F.col(c).alias(p + c) for c in plan.columns)))
    out = docs.withColumn(p + "size", words(F.col("text"))).withColumn(p + "h", h).join(small(plan, MOST_SOURCES), F.col("source").eqNullSafe(F.col(p + "source")), "left")
    more = (F.col(p + "h") < F.col(p + "lim")).cast("long")
    if not plan.where(F.col(p + "part") > 0).isEmpty():
        on = (F.col(p + "part") > 0) & (F.col(p + "h") == F.col(p + "lim"))
        tied = cut(out.where(on).withColumn(p + "piece", F.spark_partition_id()))
        of = [p + "source", p + "piece"]
        before = Window.partitionBy(of[0]).orderBy(of[1]).rowsBetween(Window.unboundedPreceding, -1)
        starts = tied.groupBy(*of).agg(F.count(F.lit(1)).alias("n")).select(F.col(of[0]).alias(p + "s"), F.col(of[1]).alias(p + "k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(p + "start"))
        own = F.row_number().over(Window.partitionBy(*of).orderBy(p + "h"))
        tied = tied.withColumn(p + "own", own).join(small(cut(starts), MOST_SOURCES), F.col(of[0]).eqNullSafe(F.col(p + "s")) & (F.col(of[1]) == F.col(p + "k")))
        tied = tied.withColumn(p + "more", (F.col(p + "start") + F.col(p + "own") <= F.col(p + "part")).cast("long"))
        rest = out.where(~F.coalesce(on, F.lit(False))).withColumn(p + "more", more)
        out = rest.unionByName(tied.select(*rest.columns))
        more = F.col(p + "more")
    named = [F.col(p + c).alias(c) for c in ("size", "source_size", "target")]
    return out.select(*docs.columns, *named, (F.col(p + "copies") + more).alias("times")).withColumn("taken", F.col("size") * F.col("times"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
a AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    (3 * coalesce(sum(source_size) OVER b, 0))::BIGINT AS capped, (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS weights
  FROM s WINDOW b AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - capped) / weights) FILTER ((total - capped) / weights * w <= 3 * source_size) AS rest FROM a),
t AS (
  SELECT source, source_size, least(w * rest, 3.0::DOUBLE * source_size) AS target,
    CASE WHEN source_size > 0 THEN floor(least(w * rest, 3.0::DOUBLE * source_size) / source_size)::BIGINT ELSE 0 END AS copies
  FROM a, l),
r AS (
  SELECT d.*, source_size, target, copies, target - copies * source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN before + size <= budget OR before <= budget AND size - (budget - before) < budget - before THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
