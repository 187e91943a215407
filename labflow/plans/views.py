"""Report-shaped views over plain tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("hb", "Hemoglobin", "sgot", "tsh", "Total Body Fat", "fbs", "ldl", "AST")
SECTIONS = ("cbc", "LIPID PROFILE", "Test Asked", "Full Body Checkup", "Uncategorized", "lft")
LINES = (
    "LIPID PROFILE", "CHOLESTEROL # mg/dL 150-200", "TRIGLYCERIDES", "# mg/dL", "0-150", "", "Page : 1 of 2", "-----", "HEMOGLOBIN # g/dL H 12.0-16.0 venous",
    "Complete Blood Count", "GLUCOSE # mg/dL XYZ 70-100", "#", "Method: CLIA", "SODIUM # mEq/L < 145", "HIV Non-Reactive", "Report Date : 09/03/2026", "Name : Test Person (30Y/F)", "Phone : 555 0100", "EXAMPLE DIAGNOSTICS LABORATORY",
    "SERUM UREA", "(BY ENZYME)", "10-50", "4.5-5.5", "> 240", "Negative", "# IU/L", "CALCULATED", "FREE T3 # pg/mL 2.0 - 4.4", "URIC ACID # mg/dL * 3.5-7.2 CALCULATED", "KETONES Negative Negative", "VITAMIN B12 # pg/mL > 200 repeat", "UNITS CREATININE # mg/dL 0.6-1.2", "160-189 : High Risk", "Dr. Some One", "within range", "CHLORIDE # U/L H", "E.C.L.I.A ng/dL 80-200",
)
#: Runs of lines as column layouts leave them.
RUNS = (
    ("mg/dL", "#", "GLUCOSE", "70-100"), ("mg/dL", "#", "150-200", "CHOLESTEROL"), ("g/dL", "#", "HEMOGLOBIN"), ("%", "#", "4.0-5.6"), ("mg/dL", "#"), ("E.C.L.I.A", "FREE THYROXINE", "0.5-5.0"), ("CLIA", "PROLACTIN"), ("pg/mL # E.C.L.I.A VITAMIN B-12",), ("SODIUM # mEq/L 135-145",), ("U/L",), ("#",), ("UREA", "# mg/dL", "10-50"), ("EXAMPLE DIAGNOSTICS LABORATORY", "12 Long Lane", "Phone : 555 0100"), ("LIPID PROFILE",), ("ng/mL", "Negative", "HEPATITIS SCREEN", "< 30 mg/dl"), ("IU/L", "#", "ng/mL", "#"),
)


def case(expression: str, values: tuple[str, ...]) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


LAB_ENTRIES = f"""
SELECT user_id AS doc_id, event_id AS ord, {case("event_id % 8", NAMES)} AS raw_name, {case("event_id % 6", SECTIONS)} AS raw_category,
  CASE WHEN event_id % 11 = 0 THEN 'Negative' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS value,
  CASE WHEN event_id % 3 = 0 THEN 'MG/DL' WHEN event_id % 3 = 1 THEN 'furlong' END AS unit,
  CASE event_id % 13 WHEN 0 THEN 'H' WHEN 1 THEN 'L' WHEN 2 THEN 'CRITICAL' END AS flag,
  CASE WHEN event_id % 5 <> 0 THEN 20.0e0 END AS low, CASE WHEN event_id % 4 <> 0 THEN 60.0e0 END AS high,
  event_id % 7 = 0 AS uncertain
FROM events"""

REPORT_LINES = f"""
SELECT doc_id, CAST(n - 1 AS INT) AS line_ix, replace(line, '#', CAST(CAST(q AS BIGINT) AS STRING)) AS line FROM (
  SELECT l_orderkey AS doc_id, l_quantity AS q, {case(f"(l_partkey + l_linenumber) % {len(LINES)}", LINES)} AS line,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n
  FROM lineitem) AS numbered"""

_BY_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_RUNS = f"SELECT l_orderkey AS doc_id, l_quantity AS q, (l_partkey + l_linenumber) % {len(RUNS)} AS run, row_number() OVER (PARTITION BY l_orderkey {_BY_ORDER}) AS n FROM lineitem"
_PARTS = " UNION ALL ".join(f"SELECT doc_id, n, {k} AS k, q, {case('run', tuple(r[k] if k < len(r) else '' for r in RUNS))} AS line FROM ({_RUNS}) AS r{k}" for k in range(4))
COLUMN_LINES = f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS INT) AS line_ix, replace(line, '#', CAST(CAST(q AS BIGINT) AS STRING)) AS line
FROM ({_PARTS}) AS parts WHERE line <> ''"""

#: What stands in each column of a page.
CELLS = ("CHOLESTEROL", "#", "mg/dL", "150-200", "H", "Total Panel", "SERUM")

SPATIAL_ITEMS = f"""
SELECT doc_id, CAST(n % 2 AS INT) AS page, CAST(n AS INT) AS item_id, CAST((l_partkey % 7) * 60 + l_suppkey % 3 AS DOUBLE) AS x,
  CAST(700 - (l_suppkey % 9) * 9 - l_linenumber AS DOUBLE) AS y, 30.0e0 AS width, 8.0e0 AS height, replace({case('l_partkey % 7', CELLS)}, '#', CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS text FROM (
  SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_linenumber, l_quantity,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n
  FROM lineitem) AS numbered"""

DOC_LINES_SPARK = "SELECT doc_id, line_ix, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) AS line_ix, line"
DOC_LINES = "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line_ix, unnest(string_split(text, chr(10))) AS line FROM documents"


def read(spark: SparkSession, sf_dir: str, table: str, sql: str, by: str | None = None) -> DataFrame:
    """The view that sql makes of a table's Parquet file, whose rows are dealt out by a column or not."""
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=source.repartition(by) if by else source)


def lab_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events", LAB_ENTRIES)


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are dealt out by order before the view's SQL, so that its lines are partitioned by doc_id as well, and no text is shuffled."""
    return read(spark, sf_dir, "lineitem", REPORT_LINES, "l_orderkey")


def column_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", COLUMN_LINES)


def spatial_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", SPATIAL_ITEMS)
