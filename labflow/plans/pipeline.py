"""The whole analysis: text to findings, audit and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labflow.functions import text as T
from labflow.operators import entries as E
from labflow.operators import extraction as X
from labflow.operators import layout as L
from labflow.operators import semantic as S
from labflow.operators import sequence as Q
from labflow.operators import summary as R
from labflow.operators.once import Once
from labflow.plans.settings import Settings, client, settings
from labflow.sources import ingest

# What a report is told about itself.
FAILED = "Extraction failed"
LOW = "Low confidence parse: the report may be a scanned image. Results may be incomplete."
INVALID = "Report structure failed validation. Some data may be missing or incorrect."
BY_LABELS = "Report parsed via the LLM-assisted extraction stage (Phase 6)."


@dataclass
class Results:
    entries: DataFrame
    metadata: DataFrame
    quality: DataFrame
    findings: DataFrame
    audit: DataFrame
    summary: DataFrame
    #: What all of them share: the rows found.
    found: DataFrame
    once: Once

    def release(self) -> None:
        """Let go of what is kept; the tables stay good, and are computed anew."""
        self.once.release()


def _scrubbed(texts: Column) -> Column:
    """Lines without what the metadata say of the patient."""
    known = F.array(*(F.col(c).cast("string") for c in ("patient_name", "patient_age", "report_date", "sample_date", "lab_name", "report_id")))
    values = F.filter(known, lambda v: v.isNotNull())
    return F.when(F.size(F.filter(values, lambda v: F.length(v) >= 3)) > 0, F.transform(texts, lambda t: T.scrub(t, values))).otherwise(texts)


def analyze(docs: DataFrame, items: DataFrame | None = None, synonyms: dict[str, str] | None = None, own: Settings | None = None) -> Results:
    """docs (doc_id, text, and extraction_status and warnings or not) to Results.

    With items (doc_id, page, item_id, text, x, y, width, height), lines come from
    the layout instead, for documents that it finds any in. With labelled
    extraction enabled, a document's results come from the labels of its blocks,
    unless they yield too little. A document without a text has failed: its
    report is empty, and says so. Metadata are those of the text, before layout.
    What follows from a line, a row's text, a heading or a name alone is found
    once for each different one; for that, lines and rows are found at once, and
    kept on the executors (in memory, or on disk where that is short; a lost part
    is computed anew) until release(). doc_id is a key, and not null.
    """
    own, once = own or settings(docs.sparkSession), Once()
    status = F.col("extraction_status") if "extraction_status" in docs.columns else ingest.status(F.col("text"))
    state = docs.select("doc_id", "text", status.alias("status"), (F.col("warnings") if "warnings" in docs.columns else F.lit(None).cast("array<string>")).alias("told"))
    # A row for each line, and one for a document without any.
    texts = F.when(F.col("status") != "failed", F.split("text", "\n"))
    base = once.hold(state.select("doc_id", F.posexplode_outer(texts).alias("line_ix", "line")))
    ids = base.where("coalesce(line_ix, 0) = 0").select("doc_id")
    cleaned = once.hold(Q.clean(Q.drop_repeated_block(base.where("line_ix is not null"), once), once))
    lines = cleaned
    if items is not None:
        laid = L.to_lines(items).join(state.where("status <> 'failed'").select("doc_id"), "doc_id", "left_semi")
        lines = Q.clean(laid, once).unionByName(cleaned.join(laid.select("doc_id").distinct(), "doc_id", "left_anti"))
    found = Q.detect(Q.carry_category(lines, once), once)
    said_of = Q.metadata(cleaned, once=once)
    about = cleaned.select("doc_id").distinct().join(said_of, "doc_id", "left")
    parsed = once.each(found.where("classification is not null"), "raw_text", E.fields)
    warned = found.where("exceeded").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", Q.merge_warning().alias("t")))), lambda x: x.t).alias("warnings"))
    ready = parsed.where(E.is_entry(parsed))
    counts = E.quality(parsed)
    sure = counts.select("doc_id", "confidence")
    quality = counts.join(about, "doc_id", "left").withColumn("ambiguous_lines", _scrubbed(F.col("ambiguous_lines"))).drop(*(c for c in about.columns if c != "doc_id"))
    quality = quality.join(warned, "doc_id", "full")
    columns = ["doc_id", "line_ix", "category", "test_name", "value", "unit", "flag", "low", "high", "range_text", "notes", "uncertain", "uncertainty_reason"]
    by_rules, used = ready.select(*columns), docs.select("doc_id").limit(0).withColumn("labelled", F.lit(True))
    if own.enabled:
        other = X.extract(state.where("status <> 'failed'"), lines, client(own), own.threshold)
        used = other.runs.where("used and not low_yield").select("doc_id").withColumn("labelled", F.lit(True))
        rest = lambda df: df.join(used, "doc_id", "left_anti")
        by_rules = rest(by_rules).unionByName(other.entries.join(used, "doc_id", "left_semi").select(*columns))
        quality = rest(quality).unionByName(other.quality.join(used, "doc_id", "left_semi"), allowMissingColumns=True)
        sure = rest(sure).unionByName(other.quality.join(used, "doc_id", "left_semi").select("doc_id", "confidence"))
        said = other.metadata.join(used, "doc_id", "left_semi")
        about = said_of = X.merge_metadata(about.withColumns({c: F.col(c).cast("string") for c in ("report_date", "sample_date")}), said)
    broken = E.violations(by_rules.withColumn("ord", F.col("line_ix"))).select("doc_id").distinct().withColumn("invalid", F.lit(True))
    quality = E.with_empty(docs, quality).join(state.select("doc_id", "status", "told"), "doc_id").join(broken, "doc_id", "left").join(used, "doc_id", "left")
    low, invalid = F.col("status") == "scanned_fallback", F.coalesce("invalid", F.lit(False))
    texts = lambda where, text: F.when(where, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    warnings = F.concat(texts(F.col("labelled").isNotNull(), BY_LABELS), F.coalesce("told", F.array().cast("array<string>")), texts(F.col("status") == "failed", FAILED), F.coalesce("warnings", F.array().cast("array<string>")), texts(low, LOW), texts(invalid, INVALID))
    quality = quality.withColumns({"warnings": warnings, "low_confidence": low, "validation_failed": invalid}).drop("status", "told", "invalid", "labelled")
    entries = by_rules.select("doc_id", F.col("line_ix").alias("ord"), F.col("test_name").alias("raw_name"), F.col("category").alias("raw_category"), "value", "unit", "flag", "low", "high", "range_text", "notes", "uncertain", "uncertainty_reason")
    named = S.deduplicate(S.normalise(entries, synonyms, once))
    kept = R.findings(named.where("fate = 'kept'"), own.corrected)
    summary = E.with_empty(ids, R.counts(kept, "doc_id")).join(said_of, "doc_id", "left").join(sure, "doc_id", "left").fillna(0.0, ["confidence"])
    summary = R.overview(summary.withColumn("report_date", F.col("report_date").cast("string")))
    return Results(named, about, quality, kept, S.audit(named), summary, found, once)
