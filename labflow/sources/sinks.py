"""Reports as JSON, HTML rows and PDF."""

from __future__ import annotations

import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labflow.functions import text as T
from labflow.operators.semantic import KINDS
from labflow.operators.summary import severity_rank


# The headings and texts of a report.
TITLE, DISCLAIMER_LABEL = "Medical Report Summary", "MEDICAL DISCLAIMER"
UNSURE = "The following entries could not be parsed confidently or are missing required information."
DISCLAIMER = "This report is generated by an automated system and may contain errors. It is NOT intended to be a substitute for professional medical advice, diagnosis, or treatment. Always seek the advice of your physician or other qualified health provider with any questions you may have regarding a medical condition or laboratory results."
#: What the fonts of a PDF lack.
PLAIN = {ord("≤"): "<=", ord("≥"): ">=", ord("μ"): "µ", ord("⁶"): "^6"}


def nested(summary: DataFrame, groups: DataFrame, quality: DataFrame | None = None, audit: DataFrame | None = None) -> DataFrame:
    """One row for each document: its summary, its groups of findings as a list, its warnings, and its audit: how many events of each kind, and the events in order."""
    lists = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("category", "findings"))).alias("groups"))
    out = summary.join(lists, "doc_id", "left")
    if quality is not None:
        out = out.join(quality.select("doc_id", "warnings", "low_confidence", "validation_failed", "ambiguous_lines"), "doc_id", "left")
    if audit is not None:
        events = F.array_sort(F.collect_list(F.struct("stage", "ord", "kind", "raw_name", "test_name", "raw_category", "category"))).alias("events")
        own = audit.groupBy("doc_id").agg(F.struct(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), events).alias("semantic_qa"))
        out = out.join(own, "doc_id", "left")
    return out


def report_lines(summary: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, lines): a report in its sections: metadata, overview, abnormal findings by category, uncertain ones, normal ones by category, disclaimer."""
    table = findings_table(found.withColumn("_row", F.struct("bucket", "ord", severity_rank(F.col("severity")).alias("rank"))), "_row")
    line = F.concat_ws("  ", F.lit("   "), "test_name", "result", F.concat(F.lit("("), F.col("reference"), F.lit(")")), "remark")
    bucket, rank = F.col("_row.bucket"), F.col("_row.rank")
    own = table.where(bucket.isin("abnormal", "uncertain", "normal")).groupBy("doc_id", bucket.alias("bucket"), F.when(bucket != "uncertain", F.col("category")).alias("category")).agg(F.array_sort(F.collect_list(F.struct(F.when(bucket == "abnormal", rank).otherwise(0).alias("rank"), F.when(bucket == "normal", F.col("test_name")).otherwise("").alias("name"), F.col("_row.ord").alias("ord"), line.alias("line")))).alias("l"))
    part = F.concat(F.when(F.col("category").isNotNull(), F.array(F.concat(F.lit("  "), T.pdf_text(F.col("category"))))).otherwise(F.array().cast("array<string>")), F.transform("l", lambda x: x.line))
    parts = own.groupBy("doc_id").pivot("bucket", ["abnormal", "uncertain", "normal"]).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("category", part.alias("lines")))), lambda x: x.lines)))
    none = F.array().cast("array<string>")
    section = lambda title, lines, more=None: F.when(F.size(F.coalesce(lines, none)) > 0, F.concat(F.array(F.lit(""), F.lit(title), *([F.lit(more)] if more else [])), lines)).otherwise(none)
    shown = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A")))
    head = F.array(F.lit(TITLE), shown("Patient", "patient_name"), shown("Age", "patient_age"), shown("Gender", "patient_gender"), shown("Report date", "report_date"), shown("Laboratory", "lab_name"), shown("Report ID", "report_id"))
    lines = F.concat(head, section("Overview", F.array(T.pdf_text(F.col("overview")))), section("Abnormal Findings", F.col("abnormal")), section("Uncertain or Unparsable Entries", F.col("uncertain"), UNSURE), section("Normal Findings", F.col("normal")), F.array(F.lit(""), F.lit(DISCLAIMER_LABEL), F.lit(DISCLAIMER)))
    return summary.join(parts, "doc_id", "left").select("doc_id", lines.alias("lines"))


def export(summary: DataFrame, found: DataFrame, path: str) -> None:
    """Write a PDF of each report to path, as rows (doc_id, content); a summary has to have its metadata."""
    missing = [c for c in ("patient_name", "report_date", "overview") if c not in summary.columns]
    if missing:
        raise ValueError(f"a summary without {', '.join(missing)}")
    pdf_files(report_lines(summary, found)).write.mode("errorifexists").parquet(path)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").json(path)


def findings_table(found: DataFrame, *more: str) -> DataFrame:
    """(doc_id, category, test_name, result, reference, remark, and more columns) as the report's tables show them."""
    low, high = T.two_decimals(F.col("low")), T.two_decimals(F.col("high"))
    text = F.nullif(F.col("range_text"), F.lit("")) if "range_text" in found.columns else F.lit(None).cast("string")
    reference = F.coalesce(text, F.concat(low, F.lit("-"), high), F.concat(F.lit("> "), low), F.concat(F.lit("< "), high), F.lit("N/A"))
    return found.select("doc_id", "category", "test_name", F.concat_ws(" ", "value", F.nullif(F.col("unit"), F.lit(""))).alias("result"), T.pdf_text(reference).alias("reference"), T.pdf_text(F.col("interpretation")).alias("remark"), *more)


def html_rows(found: DataFrame) -> DataFrame:
    """(doc_id, row): table rows in HTML."""
    t = findings_table(found)
    cell = lambda c: F.concat(F.lit("<td>"), T.escape_html(F.coalesce(F.col(c), F.lit(""))), F.lit("</td>"))
    return t.select("doc_id", F.concat(F.lit("<tr>"), *(cell(c) for c in ("test_name", "result", "reference", "remark")), F.lit("</tr>")).alias("row"))


def pdf(lines: list[str]) -> bytes:
    """A plain A4 file with the lines, 60 on a page; long ones go on below, and what its fonts lack is spelled out."""
    lines = [part for x in lines for part in (textwrap.wrap(x.translate(PLAIN), 110, drop_whitespace=False) or [""])]
    sheets = [lines[i : i + 60] for i in range(0, len(lines), 60)] or [[]]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(sheets)} /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(sheets)))}] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, sheet in enumerate(sheets):
        shown = "".join(f"({x.translate({40: r'\(', 41: r'\)', 92: r'\\'})}) Tj T*\n" for x in sheet)
        body = f"BT /F1 9 Tf 12 TL 40 800 Td\n{shown}ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents {5 + 2 * i} 0 R /Resources << /Font << /F1 3 0 R >> >> >>", f"<< /Length {len(body.encode('cp1252', 'replace'))} >>\nstream\n{body}\nendstream"]
    out, at = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects):
        at.append(len(out))
        out += f"{i + 1} 0 obj\n{o}\nendobj\n".encode("cp1252", "replace")
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())


def pdf_files(reports: DataFrame) -> DataFrame:
    """(doc_id, content) from (doc_id, lines array<string>): a PDF for each report."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": [pdf(list(x)) for x in frame["lines"]]})

    kind = dict(reports.dtypes)["doc_id"]
    return reports.select("doc_id", "lines").mapInPandas(each, f"doc_id {kind}, content binary")
