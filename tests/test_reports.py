"""Whole reports: cleaning, quality, audit, labels and what comes out."""

import json

import pytest
from pyspark.sql import functions as F

from labflow.functions import text as T
from labflow.operators import extraction as X
from labflow.operators import semantic as S
from labflow.operators import sequence as Q
from labflow.operators import summary as R
from labflow.plans.pipeline import FAILED, LOW, analyze
from labflow.plans.settings import CLIENTS, Settings, settings
from labflow.sources import sinks


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def lines_of(spark, *texts):
    return Q.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))


def test_glued_tokens(spark):
    cases = {
        "mg/dL97": "mg/dL 97", "mg/dL112IMMUNOASSAYAPOLIPOPROTEIN - A1": "mg/dL 112 IMMUNOASSAY APOLIPOPROTEIN - A1", "ng/mL68E.C.L.I.A25-OH VITAMIN D": "ng/mL 68 E.C.L.I.A 25-OH VITAMIN D", "(HS-CRP)PHOTOMETRY": "(HS-CRP) PHOTOMETRY", "Urine Protein.NEGATIVENEGATIVE": "Urine Protein NEGATIVE NEGATIVE", "KetoneAbsentAbsentAbsent": "Ketone Absent Absent Absent",
        "Ph5.04.6-8.0": "Ph 5.0 4.6-8.0", "Specific Gravity1.0201.005-1.030": "Specific Gravity 1.020 1.005-1.030", "Pus Cells3-4/HPF 0-3": "Pus Cells 3-4/HPF 0-3", "CA19-9": "CA 1 9-9", "HEMOGLOBIN 14.5 g/dL 12.0-16.0": "HEMOGLOBIN 14.5 g/dL 12.0-16.0",
    }
    assert column(spark, list(cases), T.split_glued) == list(cases.values())


def test_column_layouts(spark):
    cases = {
        "mg/dL\n110\nGLUCOSE\n70-100": ["GLUCOSE 110 mg/dL 70-100"], "mg/dL\n 110\n70-100\nGLUCOSE": ["GLUCOSE 110 mg/dL 70-100"], "mg/dL\n110\nGLUCOSE\nnote on it": ["GLUCOSE 110 mg/dL", "note on it"], "mg/dL\n110\n< 30 mg/dl\nnote": ["110 mg/dL < 30 mg/dl", "note"], "mg/dL\n110": ["110 mg/dL"], "mg/dL": ["mg/dL"],
        "E.C.L.I.A\nFREE THYROXINE\n0.5-5": ["FREE THYROXINE 0.5-5"], "CLIA\nPROLACTIN\nother text here": ["PROLACTIN", "other text here"], "CLIA\nPROLACTIN": ["CLIA", "PROLACTIN"], "ng/mL 68 E.C.L.I.A 25-OH VITAMIN D": ["25-OH VITAMIN D 68 ng/mL"], "mg/dL\n1\nmg/dL\n2\nUREA": ["1 mg/dL", "UREA 2 mg/dL"], "a\n\n-----\nPage : 1 of 2\nscan the QR code\nb": ["a", "b"],
    }
    got = {}
    for r in Q.clean(lines_of(spark, *cases)).collect():
        got.setdefault(r["doc_id"], []).append((r["line_ix"], r["line"]))
    assert [[x for _, x in sorted(got[i])] for i in range(len(cases))] == list(cases.values())
    assert all([i for i, _ in sorted(x)] == list(range(len(x))) for x in got.values())


def test_noise_is_told_by_kind(spark):
    cases = {"CALCULATED": "label", "Test  Name": "label", "12 Long Road": "address", "a.b@mail.example.com": "contact", "Barcode : 12": "metadata", "Platelets 250000": "address", "please correlate with clinical findings": "boilerplate", "CHOL - Cholesterol Oxidase": "methodology", "HEMOGLOBIN 14.5 g/dL 12.0-16.0": None, "  ": None, "": None, None: None}
    assert column(spark, list(cases), T.noise_kind) == list(cases.values())
    names = {"UNITS 25-OH VITAMIN D (TOTAL)": "25-OH VITAMIN D (TOTAL)", "TC/ HDL CHOLESTEROL RATIO CALCULATED": "TC/ HDL CHOLESTEROL RATIO", "Flow Cytometry CD4": "CD4", "Calculated": "", "UREA (CALCULATED) CALCULATEDAdult": "UREA", "GLUCOSE <": "GLUCOSE"}
    assert column(spark, list(names), T.clean_name) == list(names.values())
    assert column(spark, [900, 2048, 3 << 20], T.size_text, "long") == ["900 B", "2.0 KB", "3.00 MB"]


def test_merges_that_go_on_are_told(spark):
    lines = lines_of(spark, "GLUCOSE 5 mg/dL\n1-2 mg\n2-3 mg\n3-4 mg", "(a name)\n(by a)\n(and b)\n5 mg/dL", "(a name)\n5 mg/dL\n1-9 x")
    got = {(r["doc_id"], r["line_ix"]): (r["classification"], r["raw_text"], r["exceeded"]) for r in Q.detect(lines).collect()}
    assert got[0, 0] == ("lab", "GLUCOSE 5 mg/dL 1-2 mg 2-3 mg", True) and got[2, 0] == ("lab", "(a name) 5 mg/dL 1-9 x", False)
    assert got[1, 0][0] is None and got[1, 0][2] and got[1, 1][:2] == ("lab", "(by a) (and b) 5 mg/dL")


def test_metadata_by_each_way(spark):
    texts = ["Patient Name : Some One Age : 30", "Name : Test Person (30y/f)\nName : Test Person (41Y/f)", " Mrs. Any Body\nGender: Female Age: 26 Yrs Patient ID: 174", "Age/Gender : 24 YRS /M\nBarcode : B-1\nReport ID : R-2", "Reported on : 31/02/2026\nReport Date : 09/03/2026", "Sample Collected : 9 Mar 2026 Report Date : 10/03/2026", "the Example Labs"]
    got = {r["doc_id"]: r.asDict() for r in Q.metadata(lines_of(spark, *texts)).collect()}
    assert got[0]["patient_name"] == "Some One" and got[1]["patient_name"] == "Test Person (30y/f)"
    assert (got[2]["patient_name"], got[2]["patient_age"], got[2]["patient_gender"], got[2]["report_id"]) == ("Any Body", 26, "F", "174")
    assert (got[3]["patient_age"], got[3]["patient_gender"], got[3]["report_id"]) == (24, "M", "B-1")
    assert got[4]["report_date"] is None and str(got[5]["sample_date"]) == "2026-03-09" and str(got[5]["report_date"]) == "2026-03-10"
    assert got[6]["lab_name"] == "the Example Labs"


def test_quality_counts_what_is_skipped(spark):
    text = "LIPID PROFILE\nCHOLESTEROL 220 mg/dL 150-200\nUREA 30 mg/dL 10-50\nQ 5 mg/dL 1-9\n12.5 and more\n16.5 ng/mL"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "short"), (4, "x" * 60)], "doc_id int, text string")
    got = analyze(docs)
    q = {r["doc_id"]: r for r in got.quality.collect()}
    assert (q[1]["total_rows_detected"], q[1]["successfully_parsed"], q[1]["uncertain_rows"], q[1]["skipped_rows"], q[1]["confidence"]) == (5, 2, 0, 3, 0.4)
    assert q[1]["ambiguous_lines"] == ["Q 5 mg/dL 1-9", "12.5 and more", "16.5 ng/mL"]
    assert {r["raw_name"] for r in got.entries.collect()} == {"CHOLESTEROL", "UREA"}
    assert q[2]["warnings"] == [FAILED] and q[3]["warnings"] == [LOW] and q[3]["low_confidence"] and q[4]["warnings"] == [] and q[4]["total_rows_detected"] == 0
    assert {r["doc_id"] for r in got.summary.collect()} == {1, 2, 3, 4}


def test_decisions_are_told(spark):
    rows = [(0, "hb", "Test Asked"), (1, "Urea", "Test Asked"), (2, "hb", "Aarogyam Pro"), (3, "Odd Thing", "Aarogyam Pro"), (4, "Odd Thing", "LIPID PROFILE"), (5, "Urea", "Renal Function Test")]
    entries = spark.createDataFrame([(1, i, n, c, "1", None, None, None, None, False) for i, n, c in rows], "doc_id int, ord int, raw_name string, raw_category string, value string, unit string, flag string, low double, high double, uncertain boolean")
    done = S.deduplicate(S.normalise(entries))
    events = [(r["stage"], r["ord"], r["kind"], r["category"]) for r in S.audit(done).orderBy("stage", "ord").collect()]
    assert events == [(1, 0, "entry_suppressed", None), (1, 1, "entry_suppressed", None), (1, 2, "section_reclassified", "Uncategorized"), (1, 3, "section_reclassified", "Uncategorized"), (1, 4, "category_normalized", "Lipid Profile"), (2, 0, "section_suppressed", None), (3, 2, "name_canonicalized", None), (4, 2, "category_normalized", "Complete Blood Count"), (6, 3, "duplicate_merged", "Uncategorized")]
    assert [r["ord"] for r in done.where("fate = 'kept'").orderBy("name_order", "group_order").collect()] == [2, 4, 5]


def test_a_range_in_words_is_shown(spark):
    row = spark.createDataFrame([("abc", None, None, None, "see note", None, False), ("5", None, None, None, "see note", "mg", False)], "value string, flag string, low double, high double, range_text string, unit string, uncertain boolean")
    assert [r["interpretation"] for r in R.findings(row).collect()] == ["Non-numeric result — manual review recommended", "Within normal range (ref: see note mg)"]


def test_answers_of_a_model():
    item = {"label": "lab_result", "evidence": "UREA 5 mg", "confidence": 7, "reason": 1, "normalized": {"testName": "UREA", "value": 5, "unit": "mg", "referenceRange": {"text": "1-9"}}}
    got = X.parse_answer("```json\n" + json.dumps({"items": [item, "odd", {"label": "odd"}]}) + "\n```", 3)
    assert got[0] == {"label": "lab_result", "evidence": "UREA 5 mg", "confidence": 1.0, "reason": "no-reason", "test_name": "UREA", "value": "", "unit": "mg", "flag": None, "item_category": None, "range_text": "1-9"}
    assert got[1]["label"] == "uncertain" and got[2] == {"label": "uncertain", "evidence": "", "confidence": 0.0, "reason": "no-reason"}
    assert X.parse_answer("{}", 0) is None and X.parse_answer("no json", 1) is None and X.parse_answer('{"items": []}', 1) is None


def fixed():
    """A classifier that says the same of each line, or fails where a line says so; its class travels with it."""

    class Fixed:
        def classify(self, texts):
            if any("FAIL" in t for t in texts):
                return None
            return json.dumps({"items": [{"label": "lab_result", "evidence": t, "confidence": 0.9, "normalized": {"testName": "UREA", "value": "30", "unit": "mg/dL"}} if t.startswith("UREA") else {"label": "metadata", "evidence": t, "confidence": 1, "metadataField": "patientAge", "metadataValue": "44 years"} for t in texts]})

    return Fixed()


def test_labelled_extraction(spark, monkeypatch):
    monkeypatch.setitem(CLIENTS, "fixed", fixed)
    text = "LIPID PROFILE\nUREA 30 mg/dL\nUREA 40 mg/dL\nAND MORE TEXT " + "x" * 40
    docs = spark.createDataFrame([(1, text), (2, "FAIL here\nSODIUM 140 mEq/L 135-145\n" + "y" * 60)], "doc_id int, text string").repartition(2, "doc_id")
    own = Settings(enabled=True, client="fixed")
    blocks = Q.candidates(Q.clean(Q.lines(docs)))
    runs = {r["doc_id"]: (r["used"], r["low_yield"]) for r in X.extract(docs, Q.clean(Q.lines(docs)), fixed()).runs.collect()}
    assert runs[2] == (False, True) and (runs[1] == (True, False) or blocks.rdd.getNumPartitions() == 1)
    got = analyze(docs, own=own)
    names = {(r["doc_id"], r["raw_name"], r["value"]) for r in got.entries.collect()}
    assert (2, "SODIUM", "140") in names
    if runs[1][0]:
        q = got.quality.where("doc_id = 1").first()
        assert (1, "UREA", "30") in names and q["warnings"][0].startswith("Report parsed via") and "value not found verbatim in evidence" in q["warnings"][1]
        assert got.metadata.where("doc_id = 1").first()["patient_age"] == 44
    stub = X.extract(docs, Q.clean(Q.lines(docs)))
    assert {(r["doc_id"], r["test_name"], r["notes"]) for r in stub.entries.collect()} >= {(1, "UREA", "phase6:llm; line 2"), (2, "SODIUM", "phase6:llm; line 2")}


def test_settings(spark):
    assert settings(spark) == Settings()
    spark.conf.set("labflow.semantics", "corrected")
    try:
        assert settings(spark).corrected
        docs = spark.createDataFrame([(1, "ABG PANEL\nPH BLOOD 7.10 % 7.35-7.45\n" + "z" * 50)], "doc_id int, text string")
        assert [r["severity"] for r in analyze(docs).findings.collect()] == ["low"]
        spark.conf.set("labflow.semantics", "odd")
        with pytest.raises(ValueError, match="labflow.semantics"):
            settings(spark)
    finally:
        spark.conf.unset("labflow.semantics")


def test_report_files(spark, tmp_path):
    text = "EXAMPLE DIAGNOSTICS LABORATORY\nName : Test Person (30Y/F)\nReport Date : 09/03/2026\nLIPID PROFILE\nCHOLESTEROL 220 mg/dL 150-200\nTRIGLYCERIDES 120 mg/dL 0-150\nUREA 3 mg/dL ≤ 5\nALPHA 5 mg/dL 1-9"
    got = analyze(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    lines = sinks.report_lines(got.summary, got.findings).first()["lines"]
    for part in ("Medical Report Summary", "Patient: Test Person", "Overview", "Abnormal Findings", "Normal Findings", "MEDICAL DISCLAIMER"):
        assert part in lines
    assert lines.index("Abnormal Findings") < lines.index("Normal Findings") and any("Total Cholesterol" in x and "220 mg/dL" in x for x in lines)
    sinks.export(got.summary, got.findings, f"{tmp_path}/out")
    assert bytes(spark.read.parquet(f"{tmp_path}/out").first()["content"]).startswith(b"%PDF-1.4")
    with pytest.raises(ValueError, match="patient_name"):
        sinks.export(got.summary.drop("patient_name"), got.findings, f"{tmp_path}/other")
    assert b"<= 5 \xb5 ^6" in sinks.pdf(["≤ 5 μ ⁶"])
    nested = sinks.nested(got.summary, R.grouped(got.findings), got.quality, got.audit).first()
    assert nested["semantic_qa"]["category_normalized"] >= 3 and nested["warnings"] == [] and [g["category"] for g in nested["groups"]] == ["Lipid Profile"]
