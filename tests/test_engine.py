"""The report engine on small examples."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labflow.functions import text as T
from labflow.operators import entries as E
from labflow.operators import extraction as X
from labflow.operators import layout as L
from labflow.operators import semantic as S
from labflow.operators import sequence as Q
from labflow.operators import summary as R
from labflow.plans.pipeline import analyze
from labflow.sources import ingest, sinks


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def lines_of(spark, text):
    return Q.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_scalars(spark):
    assert column(spark, ["09/03/2026", "31/02/2026", "9 Mar 2026, 10:00", "Mar 9, 2026", "x"], lambda c: T.iso_date(c).cast("string")) == ["2026-03-09", None, "2026-03-09", "2026-03-09", None]
    assert column(spark, ["3-4/HPF", "<5", " 1.5e2 x"], T.numeric_prefix) == [3.0, None, 150.0]
    assert [tuple(x) if x else None for x in column(spark, ["12.0-16.0", "< 30", "≥ 5", "197-771 pg/ml", ""], T.parse_range)] == [(12.0, 16.0, "12.0-16.0"), (None, 30.0, "< 30"), (5.0, None, "≥ 5"), (None, None, "197-771 pg/ml"), None]
    assert column(spark, ["kidney function and the heart"], T.title_case) == ["Kidney Function and the Heart"]
    assert column(spark, [" mg/dl ", "furlong"], T.canonical_unit) == ["mg/dL", "furlong"]
    assert column(spark, ["mg/dL 110 PHOTOMETRY GLUCOSE"], T.reorder) == ["GLUCOSE 110 mg/dL"]
    assert column(spark, [1.0, 2.5, 1.005, 1234.5], T.two_decimals, "double") == ["1", "2.5", "1", "1234.5"]
    assert column(spark, ["LIPID PROFILE", "GLUCOSE 100", "Page : 1 of 2", "Lipid Profile"], T.is_header) == [True, False, False, True]


@pytest.mark.parametrize(("value", "flag", "low", "high", "want"), [("10", None, 1.0, 10.0, "borderline-high"), ("20", None, 1.0, 10.0, "critical-high"), ("0.5", None, 1.0, 10.0, "critical-low"), ("12", "L", 1.0, 10.0, "low"), ("abc", None, 1.0, 10.0, "skipped"), ("5", None, None, None, "normal"), ("7.10", None, 7.35, 7.45, "borderline-high")])
def test_severity(spark, value, flag, low, high, want):
    row = spark.createDataFrame([(value, flag, low, high)], "value string, flag string, low double, high double")
    assert row.select(R.severity(F.col("value"), F.col("flag"), F.col("low"), F.col("high"))).first()[0] == want


def test_low_comes_first_if_corrected(spark):
    assert spark.range(1).select(R.severity(F.lit("7.10"), F.lit(None).cast("string"), F.lit(7.35), F.lit(7.45), corrected=True)).first()[0] == "low"


def test_rows_and_fields(spark):
    text = "LIPID PROFILE\nHEMOGLOBIN 14.5 g/dL H 12.0-16.0 venous\nGLUCOSE 100 mg/dL XYZ 70-100\nTRIGLYCERIDES\n120 mg/dL\n0-150\n12.5"
    found = Q.detect_rows(Q.carry_category(lines_of(spark, text))).orderBy("line_ix")
    assert [(r["classification"], r["raw_text"], r["category"]) for r in found.collect()] == [("lab", "HEMOGLOBIN 14.5 g/dL H 12.0-16.0 venous", "LIPID PROFILE"), ("lab", "GLUCOSE 100 mg/dL XYZ 70-100", "LIPID PROFILE"), ("lab", "TRIGLYCERIDES 120 mg/dL 0-150", "LIPID PROFILE"), ("ambiguous", "12.5", "TRIGLYCERIDES")]
    got = [(r["test_name"], r["value"], r["unit"], r["flag"], r["low"], r["high"], r["notes"]) for r in E.fields(found).orderBy("line_ix").collect()][:3]
    assert got == [("HEMOGLOBIN", "14.5", "g/dL", "H", 12.0, 16.0, "venous"), ("GLUCOSE", "100", "mg/dL", None, 70.0, 100.0, "XYZ"), ("TRIGLYCERIDES", "120", "mg/dL", None, 0.0, 150.0, None)]


def brute_greedy(starts):
    free, out = 0, []
    for at, took in starts:
        if at >= free:
            out.append(at)
            free = at + took
    return out


def test_greedy_as_a_walk(spark):
    import random

    r = random.Random(1)
    docs = {d: [(i, r.randint(1, 3)) for i in range(r.randint(1, 30))] for d in range(40)} | {100: [(i, 3 - i % 2) for i in range(Q.STEP * 3 + 1)]}
    rows = spark.createDataFrame([(d, i, t) for d, x in docs.items() for i, t in x], "doc_id int, line_ix int, took int")
    got = {}
    for row in Q.greedy(rows).collect():
        got.setdefault(row["doc_id"], []).append(row["line_ix"])
    assert {d: sorted(x) for d, x in got.items()} == {d: brute_greedy(x) for d, x in docs.items()}


def test_repeated_block(spark):
    text = "EXAMPLE LABORATORY\n1 Road\nHEMOGLOBIN 1\nEXAMPLE LABORATORY\n1 Road\nUREA 2\nEXAMPLE LABORATORY\n1 Road"
    kept = [r["line"] for r in Q.drop_repeated_block(lines_of(spark, text)).orderBy("line_ix").collect()]
    assert kept == ["EXAMPLE LABORATORY", "1 Road", "HEMOGLOBIN 1", "UREA 2"]


def test_semantics(spark):
    rows = [(1, 0, "hb", "Uncategorized", "1", None, None, None, None, False), (1, 1, "Hemoglobin", "CBC", "2", "g/dL", None, 1.0, None, False), (1, 2, "Odd Thing", "Uncategorized", "1", None, None, None, None, False), (1, 3, "Odd Thing", "Lipid Profile", "1", None, None, None, None, True)]
    entries = spark.createDataFrame(rows, "doc_id int, ord int, raw_name string, raw_category string, value string, unit string, flag string, low double, high double, uncertain boolean")
    out = S.deduplicate(S.normalise(entries))
    assert {r["ord"]: r["fate"] for r in out.collect()} == {0: "duplicate_merged", 1: "kept", 2: "cross_section", 3: "kept"}
    assert {r["ord"]: r["category"] for r in out.collect()} == {0: "Complete Blood Count", 1: "Complete Blood Count", 2: "Uncategorized", 3: "Lipid Profile"}
    report = S.audit_report(S.audit(out)).first()
    assert report["duplicate_merged"] == 2 and report["name_canonicalized"] == 1 and report["category_normalized"] == 2


def test_report(spark):
    text = "EXAMPLE DIAGNOSTICS LABORATORY\nName : Test Person (30Y/F)\nReport Date : 09/03/2026\nPage : 1 of 2\nLIPID PROFILE\nCHOLESTEROL 220 mg/dL 150-200\nTRIGLYCERIDES\n120 mg/dL\n0-150"
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id int, text string")
    got = analyze(docs)
    assert {r["test_name"]: (r["severity"], r["category"]) for r in got.findings.collect()} == {"Total Cholesterol": ("high", "Lipid Profile"), "Triglycerides": ("normal", "Lipid Profile")}
    about = got.metadata.where("doc_id = 1").first()
    assert (about["patient_name"], about["patient_age"], about["patient_gender"], str(about["report_date"])) == ("Test Person", 30, "F", "2026-03-09")
    assert got.summary.where("doc_id = 1").first()["overview"] == "Report for Test Person (dated 2026-03-09): 1 of 2 test results is outside the normal range."
    assert {r["doc_id"]: r["total_rows_detected"] for r in got.quality.collect()} == {1: 2, 2: 0, 3: 0}


def test_layout(spark):
    items = [(1, 0, i, x, y, 30.0, 8.0, t) for i, (x, y, t) in enumerate([(10.0, 700.0, "HEMOGLOBIN"), (110.0, 699.0, "14.5"), (210.0, 698.0, "g/dL"), (10.0, 690.0, "GLUCOSE"), (110.0, 690.0, "100"), (210.0, 690.0, "mg/dL")])]
    rows = spark.createDataFrame(items, "doc_id int, page int, item_id int, x double, y double, width double, height double, text string")
    assert [r["line"] for r in L.to_lines(rows).orderBy("line_ix").collect()] == ["HEMOGLOBIN 14.5 g/dL", "GLUCOSE 100 mg/dL"]
    one = spark.createDataFrame([(1, 0, i, float(i), y, 1.0, 1.0, "x") for i, y in enumerate([700.0, 699.0, 695.0])], rows.schema)
    assert {r["y"]: r["row_ix"] for r in L.rows(one).collect()} == {700.0: 0, 699.0: 0, 695.0: 1}


def test_gate(spark):
    rows = [("HEMOGLOBIN 14.5 g/dL", "HEMOGLOBIN", "14.5", "g/dL", None, None), ("HEMOGLOBIN 14.5", "HEMOGLOBIN", "14.5", None, None, None), ("abc abc abc 5 mg", "abcabcabc", "5", "mg", None, None), ("GLUCOSE 5 mg", "GLUCOSE", "6", "mg", None, None)]
    r = spark.createDataFrame([(t, "lab_result", t, *x) for t, *x in rows], "text string, label string, evidence string, test_name string, value string, unit string, flag string, range_text string")
    assert [x[0] for x in r.select(X.rejection(r)).collect()] == [None, "numeric value without unit or reference range (not a clinical measurement)", 'repeated-token artefact "abcabcabc"', "value not found verbatim in evidence"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join(json.dumps(x) for x in ({"doc_id": "1", "extracted_text": "x" * 60, "extraction_status": "success", "layout_pages": [{"page": 0, "items": [{"str": "a", "transform": [1, 0, 0, 1, 5, 6]}, {"str": ""}]}]}, {"doc_id": "2", "extraction_status": "success"}, {"doc_id": "3", "extracted_text": "y", "extraction_status": "odd"})))
    fine, rejected = ingest.read_json(spark, str(tmp_path / "in.json"))
    assert fine.count() == 1 and rejected.count() == 2
    assert [tuple(r) for r in ingest.items(fine).collect()] == [("1", 0, "p0-i0", "a", 5.0, 6.0, 0.0, 0.0)]
    made = sinks.pdf_files(spark.createDataFrame([(1, ["a (b)", "c"])], "doc_id int, lines array<string>")).first()
    assert bytes(made["content"]).startswith(b"%PDF-1.4") and b"(a \\(b\\)) Tj" in bytes(made["content"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["LIPID PROFILE", "UREA 5 mg/dL 1-9", "", "Thyroid Panel", "note: x"]), max_size=12))
def test_category_is_the_last_heading(spark, lines):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, line_ix int, line string")
    want, now = [], "Uncategorized"
    for x in lines:
        want.append(now)
        now = x if x in ("LIPID PROFILE", "Thyroid Panel") else now
    assert [r["category"] for r in Q.carry_category(rows).orderBy("line_ix").collect()] == want


def test_stitched_lines_are_taken_once_across_gaps(spark):
    text = "PHOTOMETRY\n\nSERUM UREA\n-----\n4.5-5.5\nmg/dL\n\n110\nPage : 1 of 2\nGLUCOSE\n\n70-100"
    assert [r["line"] for r in Q.clean(lines_of(spark, text)).orderBy("line_ix").collect()] == ["SERUM UREA 4.5-5.5", "GLUCOSE 110 mg/dL 70-100"]


def test_greedy_counts_rows_not_numbers(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 4, 1), (1, 9, 1), (1, 10, 2), (1, 30, 1)], "doc_id int, line_ix int, took int")
    assert sorted(r["line_ix"] for r in Q.greedy(rows).collect()) == [0, 10]


def test_once_as_on_each_row(spark):
    """What follows from a line alone is found once for each different line, and the results are those of each row (F1)."""
    import random

    from labflow.operators.once import Once
    from labflow.plans.views import LINES, RUNS

    r = random.Random(3)
    parts = [(x,) for x in LINES] + list(RUNS)
    texts = ["\n".join(x.replace("#", str(r.randint(1, 3))) for _ in range(r.randint(0, 9)) for x in r.choice(parts)) for _ in range(60)]
    texts += ["EXAMPLE LABORATORY\n1 Road\nUREA 5 mg/dL 1-9\nEXAMPLE LABORATORY\n1 Road\nUREA 5 mg/dL 1-9", "\n".join(["120 mg/dL 1-5"] * 40), "UREA"]
    rows = Q.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    once = Once()
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "string")
    all_ = sum(1 for x in once.each(rows, "line", lambda df: df.withColumn("same", count("line"))).collect() if x["same"] == x["line"])
    assert all_ == rows.count() and seen.value <= rows.select("line").distinct().count() < all_ / 2
    bag = lambda df: sorted(map(repr, df.collect()))
    for most in (200_000, 1):
        once = Once(most)
        whole, own = Q.drop_repeated_block(rows), Q.drop_repeated_block(rows, once)
        assert bag(own) == bag(whole)
        whole, own = Q.clean(whole), Q.clean(own, once)
        assert bag(own) == bag(whole)
        told = [c for c in Q.metadata(whole).columns if c != "doc_id"]
        said = lambda df: bag(df.where(F.coalesce(*(F.col(c).cast("string") for c in told)).isNotNull()))
        assert said(Q.metadata(own, once=once)) == said(Q.metadata(whole))
        assert bag(Q.detect(Q.carry_category(own, once), once)) == bag(Q.detect(Q.carry_category(whole)))
        once.release()


def test_untangled_as_a_walk(spark):
    import random

    from labflow.operators.once import Once

    r = random.Random(2)
    docs = {d: [(i, r.randint(1, 4)) for i in range(r.randint(1, 30))] for d in range(40)} | {100: [(i, 3) for i in range(Q.STEP * 3 + 1)]}
    rows = spark.createDataFrame([(d, i, t) for d, x in docs.items() for i, t in x], "doc_id int, line_ix int, took int")
    got = {}
    for row in Q.untangled(rows, Once()).collect():
        got.setdefault(row["doc_id"], []).append(row["line_ix"])
    assert {d: sorted(x) for d, x in got.items()} == {d: brute_greedy(x) for d, x in docs.items()}
