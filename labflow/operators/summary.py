"""Severity, buckets and the grouped summary of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labflow.functions import patterns as P
from labflow.functions import text as T


def severity(value: Column, flag: Column, low: Column, high: Column, corrected: bool = False) -> Column:
    """A flag decides; then the number against its range, the high side first (with corrected, the low bound before that)."""
    n = T.numeric_prefix(value)
    by_flag = F.element_at(T.lit_map(P.FLAG_SEVERITY), F.lower(T.strip(flag)))
    out = F.when(by_flag.isNotNull(), by_flag).when(n.isNull(), "skipped")
    below = ((low > 0) & (n <= low * 0.5), "critical-low"), (n < low, "low")
    above = ((high > 0) & (n >= high * 2.0), "critical-high"), (n > high, "high"), ((high > 0) & (n >= high * (1 - 0.05)), "borderline-high")
    for where, name in (*(below if corrected else ()), *above, *(() if corrected else below), ((low > 0) & (n <= low * (1 + 0.05)), "borderline-low")):
        out = out.when(where, name)
    return out.otherwise("normal")


def bucket(severity_: Column, uncertain: Column) -> Column:
    return F.when(severity_ == "skipped", "skipped").when(uncertain, "uncertain").when(severity_ != "normal", "abnormal").otherwise("normal")


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(P.SEVERITIES) for x in (s, i))), c), F.lit(len(P.SEVERITIES)))


def findings(entries: DataFrame, corrected: bool = False) -> DataFrame:
    """entries (value, flag, low, high, uncertain, unit, and range_text or not) with severity, bucket, shown_severity and interpretation."""
    s = severity(F.col("value"), F.col("flag"), F.col("low"), F.col("high"), corrected)
    out = entries.withColumn("severity", s).withColumn("bucket", bucket(F.col("severity"), F.col("uncertain")))
    # An uncertain entry in range is listed as high.
    shown = F.when((F.col("bucket") == "uncertain") & (F.col("severity") == "normal"), "high").otherwise(F.col("severity"))
    said = T.interpretation(F.col("severity"), F.col("low"), F.col("high"), F.col("range_text") if "range_text" in entries.columns else F.lit(None).cast("string"), F.col("unit"))
    return out.withColumn("shown_severity", shown).withColumn("interpretation", said)


def counts(found: DataFrame, *by: str) -> DataFrame:
    one = lambda b: F.count_if(F.col("bucket") == b).alias(f"{b}_count")
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("total_entries"), one("abnormal"), one("normal"), one("uncertain"), one("skipped"))


def ranked(found: DataFrame) -> DataFrame:
    """Abnormal findings with their place in their category, by severity and then as they came."""
    place = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy(severity_rank(F.col("severity")), "ord"))
    return found.where("bucket = 'abnormal'").withColumn("place", place)


def ranked_normals(found: DataFrame) -> DataFrame:
    """Normal entries with their place in their category, by name in dictionary order."""
    place = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy(F.collate("test_name", "UNICODE"), "ord"))
    return found.where("bucket = 'normal'").withColumn("place", place)


def grouped(found: DataFrame) -> DataFrame:
    """(doc_id, category, findings): the abnormal findings of a category as a list in order, for sinks."""
    item = F.struct("place", "test_name", "value", "severity", "interpretation")
    return ranked(found).groupBy("doc_id", "category").agg(F.array_sort(F.collect_list(item)).alias("findings"))


def overview(summary: DataFrame) -> DataFrame:
    """summary (counts, patient_name, report_date, confidence) with an overview sentence."""
    n = F.col("total_entries") - F.col("skipped_count")
    name, date = T.strip(F.col("patient_name")), F.col("report_date")
    has_name, has_date = F.coalesce(F.length(name) > 0, F.lit(False)), date.isNotNull()
    head = F.when(has_name & has_date, F.concat(F.lit("Report for "), name, F.lit(" (dated "), date, F.lit(")"))).when(has_name, F.concat(F.lit("Report for "), name)).when(has_date, F.concat(F.lit("Report dated "), date)).otherwise("Report summary")
    s = F.when(n == 1, "").otherwise("s")
    fine = F.concat(F.lit(": All "), n, F.lit(" test result"), s, F.when(n == 1, " is").otherwise(" are"), F.lit(" within normal range."))
    out = F.concat(F.lit(": "), F.col("abnormal_count"), F.lit(" of "), n, F.lit(" test result"), s, F.when(F.col("abnormal_count") == 1, " is").otherwise(" are"), F.lit(" outside the normal range."))
    unsure = F.when((n > 0) & (F.col("uncertain_count") > 0), F.concat(F.col("uncertain_count"), F.when(F.col("uncertain_count") == 1, " result").otherwise(" results"), F.lit(" could not be fully verified.")))
    low = F.when((n > 0) & (F.col("confidence") < 0.7), "Note: the extraction confidence for this report is low; some values may be inaccurate.")
    first = F.concat(head, F.when(n == 0, ": No evaluable test results found.").when(F.col("abnormal_count") == 0, fine).otherwise(out))
    return summary.withColumn("overview", F.concat_ws(" ", first, unsure, low))
