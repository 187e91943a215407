"""Queries of the engine's operators over the given tables, and the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labflow.functions import patterns as P
from labflow.functions import text as T
from labflow.operators import entries as E
from labflow.operators import extraction as X
from labflow.operators import layout as L
from labflow.operators import semantic as S
from labflow.operators import sequence as Q
from labflow.operators import summary as R
from labflow.plans import views as V
from labflow.plans.pipeline import analyze
from labflow.sources import sinks
from labflow.sources.ingest import from_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ENTRIES, LINES, COLUMNS, ITEMS, DOCS = (f"WITH v AS ({sql}) " for sql in (V.LAB_ENTRIES, V.REPORT_LINES, V.COLUMN_LINES, V.SPATIAL_ITEMS, V.DOC_LINES))
quoted = lambda text: "'" + text.replace("'", "''") + "'"
values = lambda d: ", ".join(f"({quoted(k)}, {quoted(str(v))})" for k, v in d.items())


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.lines(table(spark, sf_dir, "documents"))


# RE2 has no look-behind, and its word boundary and case folding know ASCII only: the patterns below hold for both.
UNIT_RE2 = f"(?:^|[^A-Za-z0-9_]){P.UNIT}(?:[^A-Za-z0-9_]|$)"
VALUE_RE2 = f"{P.NUMBER}|(?i:\\b{P.QUALITATIVE}\\b)"
RANGE_RE2 = f"(?i){P.SPAN}|{P.COMPARISON}|\\b{P.QUALITATIVE}\\b"
has_value_sql, has_unit_sql, has_range_sql, has_flag_sql = (f"regexp_matches(line, {quoted(p)})" for p in (VALUE_RE2, UNIT_RE2, RANGE_RE2, P.FLAG_INSIDE))
header_sql = f"(trim(line) <> '' AND regexp_matches(trim(line), {quoted(P.HEADER_SHAPE)}) AND NOT regexp_matches(line, {quoted(P.NUMBER)}) AND NOT {has_unit_sql})"
lab_sql = f"({has_value_sql} AND ({has_unit_sql} OR {has_range_sql} OR {has_flag_sql}))"
SEVERITY_SQL = f"""CASE WHEN f.s IS NOT NULL THEN f.s WHEN n IS NULL THEN 'skipped'
  WHEN high > 0 AND n >= high * 2.0e0 THEN 'critical-high' WHEN n > high THEN 'high' WHEN high > 0 AND n >= high * (1 - 0.05e0) THEN 'borderline-high'
  WHEN low > 0 AND n <= low * 0.5e0 THEN 'critical-low' WHEN n < low THEN 'low' WHEN low > 0 AND n <= low * (1 + 0.05e0) THEN 'borderline-low' ELSE 'normal' END"""
FOUND = ENTRIES + f""", flags(k, s) AS (VALUES {values(P.FLAG_SEVERITY)}),
 found AS (SELECT *, CASE WHEN severity = 'skipped' THEN 'skipped' WHEN uncertain THEN 'uncertain' WHEN severity <> 'normal' THEN 'abnormal' ELSE 'normal' END AS bucket
  FROM (SELECT v.*, {SEVERITY_SQL} AS severity FROM (SELECT *, try_cast(regexp_extract(value, '^\\s*([-+]?[0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS n FROM v) v LEFT JOIN flags f ON f.k = lower(trim(flag)))) """
def named_sql(view: str, has_range: str = "low IS NOT NULL OR high IS NOT NULL") -> str:
    """Names, sections, categories and fates of a view of entries."""
    either = lambda patterns: quoted("(?i)" + "|".join(f"(?:{x})" for x in patterns))
    norm, listed = "regexp_replace(lower(trim(raw_category)), '\\s+', ' ', 'g')", ", ".join(map(quoted, P.KNOWN_SECTIONS))
    title = f"array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND w[i] IN ({', '.join(map(quoted, P.SMALL_WORDS))}) THEN w[i] ELSE upper(w[i][1]) || w[i][2:] END), ' ')"
    return f"""names(k, c) AS (VALUES {values(S.lookup_table())}), own(k, c) AS (VALUES {values(S.true_categories())}), alias(k, c) AS (VALUES {values(P.SECTION_ALIASES)}),
 prefixes AS (SELECT k, len(string_split(k, ' ')) AS words, c FROM names),
 resolved AS (SELECT r.raw_name, arg_max(p.c, p.words) AS c FROM (SELECT DISTINCT raw_name FROM {view}) r LEFT JOIN prefixes p ON lower(r.raw_name) = p.k OR starts_with(lower(r.raw_name), p.k || ' ') GROUP BY 1),
 sections AS (SELECT raw_category, section_kind, CASE section_kind WHEN 'noise' THEN 'Suppressed' WHEN 'pseudo' THEN 'Uncategorized' ELSE coalesce(c, {title}) END AS section FROM (
   SELECT raw_category, a.c, string_split_regex(lower(trim(raw_category)), '\\s+') AS w, CASE WHEN regexp_matches(trim(raw_category), {either(P.NOISE_SECTIONS)}) THEN 'noise' WHEN regexp_matches(trim(raw_category), {either(P.PSEUDO_SECTIONS)}) THEN 'pseudo'
     WHEN a.c IS NOT NULL OR {norm} IN ({listed}) OR len(list_filter([{listed}], lambda y: length(y) > 4 AND contains({norm}, y))) > 0 THEN 'medical' ELSE 'pseudo' END AS section_kind
   FROM (SELECT DISTINCT raw_category FROM {view}) d LEFT JOIN alias a ON a.k = {norm})),
 named AS (SELECT v.*, section_kind, section, coalesce(r.c, trim(v.raw_name)) AS test_name, coalesce(o.c, section) AS category, section_kind = 'noise' AS suppressed
   FROM {view} v JOIN sections s USING (raw_category) JOIN resolved r USING (raw_name) LEFT JOIN own o ON o.k = coalesce(r.c, trim(v.raw_name))),
 scored AS (SELECT *, CAST(8 * (NOT uncertain)::INT + 4 * ({has_range})::INT + 2 * (coalesce(unit, '') <> '')::INT + (coalesce(value, '') <> '')::INT AS INT) AS score FROM named),
 fated AS (SELECT *, CASE WHEN suppressed THEN 'suppressed' WHEN row_number() OVER (PARTITION BY suppressed, doc_id, lower(test_name), lower(category) ORDER BY score DESC, ord) > 1 THEN 'duplicate_merged'
   WHEN category = 'Uncategorized' AND bool_or(category <> 'Uncategorized') OVER (PARTITION BY suppressed, doc_id, lower(test_name)) THEN 'cross_section' ELSE 'kept' END AS fate FROM scored) """


NAMED = ENTRIES + ", " + named_sql("v")


@query("severity_classify", FOUND + "SELECT ord, severity, bucket FROM found")
def severity_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.findings(V.lab_entries(spark, sf_dir)).select("ord", "severity", "bucket")


@query("bucket_counts", FOUND + "SELECT doc_id, count(*) AS total_entries, " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}_count" for b in ("abnormal", "normal", "uncertain", "skipped")) + " FROM found GROUP BY doc_id")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts(R.findings(V.lab_entries(spark, sf_dir)), "doc_id")


@query("synonym_join", NAMED + "SELECT ord, raw_name, n.c AS canonical FROM v LEFT JOIN names n ON n.k = lower(trim(raw_name))")
def synonym_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(S.lookup_table().items()), "key string, canonical string")
    return S.exact_name(V.lab_entries(spark, sf_dir), names).select("ord", "raw_name", "canonical")


@query("prefix_resolve", NAMED + "SELECT ord, c AS canonical FROM v JOIN resolved USING (raw_name)")
def prefix_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lab_entries(spark, sf_dir).select("ord", S.canonical_name(F.col("raw_name")).alias("canonical"))


@query("section_classify", NAMED + "SELECT ord, section_kind, section FROM v JOIN sections USING (raw_category)")
def section_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.classify_sections(V.lab_entries(spark, sf_dir)).select("ord", "section_kind", "section")


@query("true_category_override", NAMED + "SELECT ord, test_name, category FROM named")
def true_category_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalise(V.lab_entries(spark, sf_dir)).select("ord", "test_name", "category")


@query("dedup_best", NAMED + "SELECT ord, score, fate FROM fated")
def dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deduplicate(S.normalise(V.lab_entries(spark, sf_dir))).select("ord", "score", "fate")


@query("dedup_cross_section", NAMED + "SELECT category, fate, count(*) AS n FROM fated GROUP BY ALL")
def dedup_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deduplicate(S.normalise(V.lab_entries(spark, sf_dir))).groupBy("category", "fate").agg(F.count(F.lit(1)).alias("n"))


EVENTS_SQL = (
    ("entry_suppressed", 1, "suppressed", "NULL"), ("section_reclassified", 1, "section_kind = 'pseudo'", "'Uncategorized'"), ("category_normalized", 1, "section_kind = 'medical' AND section <> raw_category", "section"),
    ("name_canonicalized", 3, "NOT suppressed AND test_name <> raw_name", "NULL"), ("category_normalized", 4, "NOT suppressed AND category <> section", "category"), ("duplicate_merged", 5, "fate = 'duplicate_merged'", "category"), ("duplicate_merged", 6, "fate = 'cross_section'", "category"),
)
EVENTS = NAMED + ", events AS (" + " UNION ALL ".join(f"SELECT doc_id, ord::BIGINT AS ord, {stage} AS stage, '{k}' AS kind, raw_name, test_name, raw_category, {c}::VARCHAR AS category FROM fated WHERE {w}" for k, stage, w, c in EVENTS_SQL) + " UNION ALL SELECT doc_id, min(ord)::BIGINT, 2, 'section_suppressed', NULL, NULL, raw_category, NULL FROM fated WHERE suppressed GROUP BY doc_id, raw_category) "


@query("qa_event_counts", EVENTS + "SELECT doc_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in S.KINDS) + " FROM events GROUP BY doc_id")
def qa_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.audit_report(S.audit(S.deduplicate(S.normalise(V.lab_entries(spark, sf_dir)))))


@query("qa_events", EVENTS + "SELECT * FROM events")
def qa_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.audit(S.deduplicate(S.normalise(V.lab_entries(spark, sf_dir))))


KEPT_SQL = """SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY name_ord, group_ord) AS place FROM (
  SELECT *, min(ord) OVER (PARTITION BY doc_id, lower(test_name)) AS name_ord, min(ord) OVER (PARTITION BY doc_id, lower(test_name), lower(category)) AS group_ord FROM fated WHERE NOT suppressed) WHERE fate = 'kept'"""


@query("kept_order", NAMED + KEPT_SQL)
def kept_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = S.deduplicate(S.normalise(V.lab_entries(spark, sf_dir))).where("fate = 'kept'")
    return kept.select("doc_id", "ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("name_order", "group_order")).alias("place"))


RANK_SQL = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(P.SEVERITIES)) + " ELSE 6 END"


@query("category_groups_ranked", FOUND + f"SELECT ord, severity, row_number() OVER (PARTITION BY doc_id, raw_category ORDER BY {RANK_SQL}, ord) AS place FROM found WHERE bucket = 'abnormal'")
def category_groups_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.findings(V.lab_entries(spark, sf_dir)).withColumn("category", F.col("raw_category"))
    return R.ranked(found).select("ord", "severity", "place")


@query("normal_groups_ranked", FOUND + "SELECT ord, row_number() OVER (PARTITION BY doc_id, raw_category ORDER BY list_position(['AST', 'fbs', 'hb', 'Hemoglobin', 'ldl', 'sgot', 'Total Body Fat', 'tsh'], raw_name), ord) AS place FROM found WHERE bucket = 'normal'")
def normal_groups_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.findings(V.lab_entries(spark, sf_dir)).withColumn("category", F.col("raw_category")).withColumn("test_name", F.col("raw_name"))
    return R.ranked_normals(found).select("ord", "place")


MEANING_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.MEANINGS.items()) + " END"


@query("interpretation_text", FOUND + f"SELECT ord, CASE WHEN severity = 'skipped' THEN CASE WHEN low IS NULL AND high IS NULL THEN 'Unable to interpret — reference range not available' ELSE 'Non-numeric result — manual review recommended' END WHEN low IS NULL AND high IS NULL THEN {MEANING_SQL} ELSE {MEANING_SQL} || ' (ref: ' || CASE WHEN low IS NULL THEN 'up to 60' WHEN high IS NULL THEN '20 or above' ELSE '20 – 60' END || coalesce(' ' || unit, '') || ')' END AS interpretation FROM found")
def interpretation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.findings(V.lab_entries(spark, sf_dir)).select("ord", "interpretation")


@query("findings_table", FOUND + "SELECT ord, concat_ws(' ', value, unit) AS result, CASE WHEN low IS NULL AND high IS NULL THEN 'N/A' WHEN low IS NULL THEN '< 60' WHEN high IS NULL THEN '> 20' ELSE '20-60' END AS reference FROM found")
def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.findings(V.lab_entries(spark, sf_dir)).withColumn("category", F.col("ord")).withColumn("test_name", F.col("raw_name"))
    return sinks.findings_table(found).select(F.col("category").alias("ord"), "result", "reference")


@query("overview_counts", FOUND + "SELECT doc_id, CASE WHEN n = 0 THEN 'Report summary: No evaluable test results found.' WHEN a = 0 THEN 'Report summary: All ' || n || ' test result' || CASE WHEN n = 1 THEN ' is' ELSE 's are' END || ' within normal range.' ELSE 'Report summary: ' || a || ' of ' || n || ' test result' || CASE WHEN n = 1 THEN '' ELSE 's' END || CASE WHEN a = 1 THEN ' is' ELSE ' are' END || ' outside the normal range.' END || CASE WHEN n > 0 AND u > 0 THEN ' ' || u || CASE WHEN u = 1 THEN ' result' ELSE ' results' END || ' could not be fully verified.' ELSE '' END AS overview FROM (SELECT doc_id, count(*) - count(*) FILTER (bucket = 'skipped') AS n, count(*) FILTER (bucket = 'abnormal') AS a, count(*) FILTER (bucket = 'uncertain') AS u FROM found GROUP BY doc_id)")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.counts(R.findings(V.lab_entries(spark, sf_dir)), "doc_id")
    c = c.withColumn("patient_name", F.lit(None).cast("string")).withColumn("report_date", F.lit(None).cast("string")).withColumn("confidence", F.lit(1.0))
    return R.overview(c).select("doc_id", "overview")


@query("unit_canonicalize", ENTRIES + f", units(k, u) AS (VALUES {values(P.UNITS)}) SELECT ord, coalesce(u, trim(unit)) AS unit FROM v LEFT JOIN units ON k = upper(trim(unit))")
def unit_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lab_entries(spark, sf_dir).select("ord", T.canonical_unit(F.col("unit")).alias("unit"))


@query("quality_counters", NAMED + "SELECT doc_id, count(*) AS total_rows_detected, count(*) FILTER (ok AND NOT uncertain) AS successfully_parsed, count(*) FILTER (ok AND uncertain) AS uncertain_rows, count(*) FILTER (NOT ok) AS skipped_rows, count(*) FILTER (ok AND NOT uncertain) / count(*) AS confidence FROM (SELECT *, regexp_matches(raw_name, '[A-Za-z]{3}') AS ok FROM v) GROUP BY doc_id")
def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.quality(V.lab_entries(spark, sf_dir).withColumn("test_name", F.col("raw_name")))


@query("scan_status", "SELECT doc_id, CASE WHEN text IS NULL THEN 'failed' WHEN length(trim(text, ' ')) < 50 THEN 'scanned_fallback' ELSE 'success' END AS extraction_status FROM documents")
def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "extraction_status")


@query("lines_explode", DOCS + "SELECT doc_id, line_ix, line FROM v")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir)


@query("noise_contact_lines", DOCS + f"SELECT doc_id, line_ix FROM v WHERE regexp_matches(line, {quoted(P.NOISE['contact'])}) OR regexp_matches(line, {quoted(P.MAIL)})")
def noise_contact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).where(T.is_contact(F.col("line"))).select("doc_id", "line_ix")


def noise_sql(x: str) -> str:
    """noise_kind() of an expression."""
    label = f"WHEN lower(regexp_replace(trim({x}), '\\s+', ' ', 'g')) IN ({', '.join(map(quoted, (*P.DESCRIPTORS, *P.COLUMN_LABELS, *P.PANELS)))}) THEN 'label'"
    kinds = {k: f"regexp_matches(trim({x}), {quoted(p)})" for k, p in P.NOISE.items()}
    kinds["contact"] = f"({kinds['contact']} OR regexp_matches(trim({x}), {quoted(P.MAIL)}))"
    return f"CASE {label} " + " ".join(f"WHEN {w} THEN '{k}'" for k, w in kinds.items()) + " END"


def interpretation_sql(x: str) -> str:
    return f"(regexp_matches(trim({x}), {quoted('|'.join(P.INTERPRETATIONS))}) OR (regexp_matches(trim({x}), {quoted(P.GLUED_RANGE[0])}) AND regexp_matches(trim({x}), {quoted(P.GLUED_RANGE[1])})))"


PROSE_SQL = f"(regexp_matches(t, '^v\\s{{2,}}') OR (length(t) >= 80 AND NOT regexp_matches(substr(t, 1, 30), '[0-9]')) OR (length(t) >= 60 AND ends_with(t, '.') AND regexp_matches(t, {quoted(P.PROSE)})) OR " + " OR ".join(f"contains(lower(line), '{x}')" for x in P.DISCLAIMERS) + ")"
METHOD_SQL = "(" + " OR ".join(f"starts_with(lower(t), {quoted(x)})" for x in P.NO_DATA) + ")"


@query("noise_bank_counts", LINES + f"SELECT {noise_sql('line')} AS noise, count(*) AS n FROM v GROUP BY 1")
def noise_bank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.report_lines(spark, sf_dir).groupBy(T.noise_kind(F.col("line")).alias("noise")).agg(F.count(F.lit(1)).alias("n"))


@query("disclaimer_prose_lines", DOCS + f"SELECT doc_id, line_ix FROM (SELECT *, regexp_replace(line, '^[\\s\\x0B\\x{{00A0}}]+|[\\s\\x0B\\x{{00A0}}]+$', '', 'g') AS t FROM v) WHERE {PROSE_SQL}")
def disclaimer_prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).where(T.is_disclaimer(F.col("line"))).select("doc_id", "line_ix")


@query("line_flags", LINES + f"SELECT doc_id, line_ix, {has_value_sql} AS has_value, {has_unit_sql} AS has_unit, {has_range_sql} AS has_range, {has_flag_sql} AS has_flag, {lab_sql} AS is_lab, {header_sql} AS is_header FROM v")
def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("line")
    return V.report_lines(spark, sf_dir).select("doc_id", "line_ix", T.has_value(c).alias("has_value"), T.has_unit(c).alias("has_unit"), T.has_range(c).alias("has_range"), T.has_flag(c).alias("has_flag"), T.is_lab_line(c).alias("is_lab"), T.is_header(c).alias("is_header"))


@query("category_carry_forward", LINES + f"SELECT doc_id, line_ix, coalesce(last_value(CASE WHEN {header_sql} THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Uncategorized') AS category FROM v")
def category_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.carry_category(V.report_lines(spark, sf_dir)).select("doc_id", "line_ix", "category")


CANDIDATES_SQL = f""", r AS (SELECT *, regexp_matches(trim(line), {quoted(f'^{P.NUMBER}$|^(?i:{P.QUALITATIVE})$')}) AS value_only, regexp_matches(line, '[A-Za-z]{{3,}}') AS letters FROM v WHERE trim(line) <> ''),
 s AS (SELECT *, value_only AND coalesce(lag(letters AND NOT value_only) OVER w, false) AS taken, letters AND NOT value_only AND coalesce(lead(value_only) OVER w, false) AS joins, lead(line) OVER w AS nxt, lead(line_ix) OVER w AS nxt_ix FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line_ix))
SELECT doc_id, line_ix AS line_start, CASE WHEN joins THEN nxt_ix ELSE line_ix END AS line_end, CASE WHEN joins THEN trim(line) || ' ' || trim(nxt) ELSE trim(line) END AS text FROM s WHERE NOT taken"""


@query("candidate_blocks", LINES + CANDIDATES_SQL)
def candidate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.candidates(V.report_lines(spark, sf_dir)).drop("first_line")


@query("range_parse", LINES + ", t AS (SELECT doc_id, line_ix, regexp_extract(line, '(\\S+)$', 1) AS t FROM v), p AS (SELECT *, regexp_matches(t, '^[0-9]+(\\.[0-9]+)?[-–][0-9]+(\\.[0-9]+)?$') AS pair FROM t) SELECT doc_id, line_ix, CASE WHEN pair THEN CAST(regexp_extract(t, '^([0-9.]+)', 1) AS DOUBLE) END AS low, CASE WHEN pair THEN CAST(regexp_extract(t, '([0-9.]+)$', 1) AS DOUBLE) END AS high FROM p")
def range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = T.parse_range(F.regexp_extract("line", "(\\S+)$", 1))
    return V.report_lines(spark, sf_dir).select("doc_id", "line_ix", span["low"].alias("low"), span["high"].alias("high"))


@query("iso_date_parse", "SELECT l_orderkey, l_linenumber, l_partkey, try_strptime(lpad(CAST(l_partkey % 33 AS VARCHAR), 2, '0') || '/' || lpad(CAST(l_suppkey % 14 AS VARCHAR), 2, '0') || '/2024', '%d/%m/%Y')::DATE AS day FROM lineitem")
def iso_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("l_partkey") % 33, F.lit("/"), F.col("l_suppkey") % 14, F.lit("/2024, 10:00"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.iso_date(raw).alias("day"))


GLUED = ("GLUCOSE # mg/dL#", "#ECLIA", "(HS-CRP)PHOTOMETRY", "CLIA#", "HPLCHEMOGLOBIN", "Protein.NEGATIVE", "NEGATIVENEGATIVE", "KetoneABSENT", "Ph5.04.6-8.0", "Cells3-4/HPF", "UREA # mg/dL 10-50")
GLUED_RULES = ((f"({P.GLUED_UNIT})(\\d)", "\\1 \\2"), (f"(\\d)({P.TECHNOLOGY})", "\\1 \\2"), (f"([A-Za-z\\])])({P.TECHNOLOGY})", "\\1 \\2"), (f"({P.TECHNOLOGY})(\\d)", "\\1 \\2"), (f"({P.TECHNOLOGY})([A-Z]{{4}})", "\\1 \\2"), (f"(?i)(\\w)\\.({P.QUALITATIVE})", "\\1 \\2"), (f"(?i)({P.QUALITATIVE})({P.QUALITATIVE})", "\\1 \\2"), ("(?i)([a-z])(Negative|Positive|Reactive|Present|Absent)", "\\1 \\2"), ("([A-Za-z])(\\d+(?:\\.\\d+)?)(\\d+(?:\\.\\d+)?[-–]\\d+(?:\\.\\d+)?)", "\\1 \\2 \\3"), ("(?i)([A-Za-z])(\\d+[-–]\\d+/HPF)", "\\1 \\2"))
GLUED_SQL = f"replace({V.case(f'l_partkey % {len(GLUED)}', GLUED)}, '#', CAST(l_partkey AS VARCHAR))"
for _pattern, _to in GLUED_RULES:
    GLUED_SQL = f"regexp_replace({GLUED_SQL}, {quoted(_pattern)}, '{_to}', 'g')"


@query("glued_token_split", f"SELECT l_orderkey, l_partkey, l_linenumber, {GLUED_SQL} AS line FROM lineitem")
def glued_token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.replace(F.expr(V.case(f"l_partkey % {len(GLUED)}", GLUED)), F.lit("#"), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", T.split_glued(raw).alias("line"))


NUMBERS = ("#.5-6/HPF", " -#e2x", "+.5#", "<#", "#", "", "x#", "# 7", "#.")


@query("numeric_prefix", f"SELECT event_id, CASE event_id % {len(NUMBERS)} WHEN 0 THEN event_id + 0.5e0 WHEN 1 THEN event_id * -100.0e0 WHEN 2 THEN ('0.5' || event_id)::DOUBLE WHEN 4 THEN event_id WHEN 7 THEN event_id WHEN 8 THEN event_id END::DOUBLE AS n FROM events")
def numeric_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.replace(F.expr(V.case(f"event_id % {len(NUMBERS)}", NUMBERS)), F.lit("#"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.numeric_prefix(raw).alias("n"))


@query("first_label_match", LINES + "SELECT doc_id, max(CASE WHEN line_ix < 30 AND starts_with(line, 'Name') THEN 'Test Person' END) AS patient_name, max(CASE WHEN line_ix < 30 AND starts_with(line, 'Name') THEN 30 END)::INT AS patient_age, max(CASE WHEN line_ix < 30 AND starts_with(line, 'Name') THEN 'F' END) AS patient_gender, max(CASE WHEN starts_with(line, 'Report') THEN DATE '2026-03-09' END) AS report_date, max(CASE WHEN line_ix < 30 AND starts_with(line, 'EXAMPLE') THEN line END) AS lab_name FROM v GROUP BY doc_id")
def first_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.metadata(V.report_lines(spark, sf_dir)).select("doc_id", "patient_name", "patient_age", "patient_gender", "report_date", "lab_name")


@query("pii_scrub", "SELECT doc_id, trim(regexp_replace(replace(replace(text, source, ''), lang || 'x', ''), '[\\s\\x0B\\x{00A0}]+', ' ', 'g')) AS text FROM documents")
def pii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.scrub(F.col("text"), F.array("source", F.concat("lang", F.lit("x")))).alias("text"))


@query("repeated_lines", DOCS + "SELECT line, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS docs FROM v WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) > 1")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).where(F.trim("line") != "")
    return rows.groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.count_distinct("doc_id").alias("docs")).where("docs > 1")


only_sql = lambda x, p: f"regexp_full_match(trim({x}), {quoted(p)})"
VALUE_ONLY, UNIT_ONLY = f"{P.NUMBER}|(?i:{P.QUALITATIVE})", f"(?i:{P.UNIT})"
CLEAN_SQL = f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_ix) - 1 AS INT) AS line_ix, line FROM v WHERE {header_sql}
 OR NOT (trim(line) = '' OR {only_sql('line', P.SEPARATOR)} OR {only_sql('line', P.PAGE_MARKER)} OR (regexp_matches(line, {quoted(P.FOOTERS)}) AND NOT regexp_matches(line, {quoted(P.NUMBER)}) AND NOT {has_unit_sql}))"""


def detect_sql(view: str) -> str:
    """detect()'s rows over a view (doc_id, line_ix, line), as the walk of a recursive query over what each line would take."""
    ahead = lambda c, n: f"coalesce(lead({c}, {n}) OVER d, false)"
    return f"""f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_ix) AS k, trim(line) AS t FROM {view}),
 g AS (SELECT *, {has_value_sql} AS val, {has_unit_sql} AS uni, {has_range_sql} AS rng, {has_flag_sql} AS flg, regexp_matches(t, {quoted(P.LEADING + '|(?i:^' + P.QUALITATIVE + chr(92) + 'b)')}) AS leads, {only_sql('line', UNIT_ONLY)} AS only_unit, {header_sql} AS head,
   trim(line) = '' OR {only_sql('line', P.SEPARATOR)} OR {only_sql('line', P.PAGE_MARKER)} AS void, {METHOD_SQL} OR {PROSE_SQL} OR {interpretation_sql('line')} OR {noise_sql('line')} IS NOT NULL AS noise,
   regexp_matches(t, '^[0-9]+[-–][0-9]+$|^[0-9]+\\.[0-9]+[-–][0-9]+\\.[0-9]+$|^[<>]\\s*[0-9]{{3}}$|^[0-9]+\\s+[-–]\\s+[0-9]+$|^[0-9]+:[0-9]+[-–][0-9]+:[0-9]+$') AS orphan FROM f),
 h AS (SELECT *, val AND (uni OR rng OR flg) AS lab, void OR noise OR (head AND NOT val) AS stop FROM g),
 i AS (SELECT *, NOT stop AND rng AND leads AS span, NOT stop AND NOT (lab AND NOT leads) AS goes, (val OR uni) AND leads AS brings FROM h),
 j AS (SELECT *, goes AND brings AS takes, goes AND NOT brings AND NOT only_unit AS other, goes AND (brings OR NOT only_unit) AS late FROM i),
 l AS (SELECT *, {ahead('span', 1)} AS s1, {ahead('span', 2)} AS s2, {ahead('span', 3)} AS s3, {ahead('takes', 1)} AS v1, {ahead('takes', 2)} AS v2, {ahead('other', 1)} AS o1, {ahead('other', 2)} AS o2, {ahead('late', 3)} AS l3, lead(t, 1) OVER d AS t1, lead(t, 2) OVER d AS t2 FROM j WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
 m AS (SELECT *, CASE WHEN void OR noise OR (lab AND orphan) THEN 'skip' WHEN lab THEN 'lab' WHEN NOT val AND NOT uni THEN 'name' ELSE 'ambiguous' END AS c, CASE WHEN s1 AND s2 THEN 3 WHEN s1 THEN 2 ELSE 1 END AS folded, CASE WHEN v1 AND s2 THEN 3 WHEN v1 THEN 2 WHEN o1 AND v2 THEN 3 END AS merged FROM l),
 o AS (SELECT *, CASE WHEN c = 'lab' THEN folded WHEN c = 'name' THEN coalesce(merged, 1) ELSE 1 END AS took, CASE WHEN c = 'lab' THEN folded = 3 AND s3 WHEN c = 'name' AND merged IS NULL THEN o1 AND o2 AND l3 WHEN c = 'name' THEN merged = 3 AND s3 ELSE false END AS exceeded FROM m),
 walk AS (WITH RECURSIVE w(doc_id, k, took) AS (SELECT doc_id, k, took FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.k, o.took FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + w.took) SELECT doc_id, k FROM w),
 p AS (SELECT o.*, CASE WHEN c = 'ambiguous' THEN 'ambiguous' WHEN c = 'lab' OR (c = 'name' AND merged IS NOT NULL) THEN 'lab' END AS classification, CASE WHEN c = 'ambiguous' THEN line ELSE concat_ws(' ', t, CASE WHEN took > 1 THEN t1 END, CASE WHEN took > 2 THEN t2 END) END AS raw_text FROM o JOIN walk USING (doc_id, k)),
 found AS (SELECT doc_id, line_ix, classification, raw_text, exceeded FROM p WHERE classification = 'ambiguous' OR (classification = 'lab' AND {noise_sql('raw_text')} IS NULL AND NOT (c = 'name' AND {interpretation_sql('raw_text')})))"""


@query("detect_rows", LINES + ", " + detect_sql("v") + " SELECT * FROM found")
def detect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.detect_rows(V.report_lines(spark, sf_dir))


def stitch_sql(view: str) -> str:
    """stitch_columns()'s lines of a view (doc_id, line_ix, line), as a walk over what each line would take."""
    return f"""sf AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_ix) AS k, {only_sql('line', UNIT_ONLY)} AS u, {only_sql('line', VALUE_ONLY)} AS a,
   regexp_full_match(trim(line), {quoted(P.SPAN + '|' + P.COMPARISON + '|(?:<=|>=|<|>|≤|≥)' + chr(92) + 's*' + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?(?:' + chr(92) + 's+[A-Za-z%/]+)?')}) AS r, length(trim(line)) >= 3 AND {header_sql} AND NOT {has_range_sql} AS n, {only_sql('line', P.TECHNOLOGY)} AS g,
   regexp_extract(trim(line), {quoted('(?i)^(' + P.UNIT + ')' + chr(92) + 's+([-+]?[0-9]+(?:' + chr(92) + '.[0-9]+)?)' + chr(92) + 's+' + P.TECHNOLOGY + chr(92) + 's+(..+)$')}, ['unit', 'value', 'name']) AS m FROM {view}),
 sh AS (SELECT *, lead(line, 1) OVER d AS n1, lead(line, 2) OVER d AS n2, lead(line, 3) OVER d AS n3, coalesce(lead(a, 1) OVER d, false) AS a1, coalesce(lead(n, 1) OVER d, false) AS w1, coalesce(lead(n, 2) OVER d, false) AS w2, coalesce(lead(n, 3) OVER d, false) AS w3, coalesce(lead(r, 2) OVER d, false) AS r2, coalesce(lead(r, 3) OVER d, false) AS r3 FROM sf WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
 so AS (SELECT *, CASE WHEN m.name <> '' THEN struct_pack(took := 1, line := m.name || ' ' || m.value || ' ' || m.unit)
   WHEN u AND a1 THEN CASE WHEN w2 AND r3 THEN struct_pack(took := 4, line := concat_ws(' ', n2, n1, line, n3)) WHEN r2 AND w3 THEN struct_pack(took := 4, line := concat_ws(' ', n3, n1, line, n2)) WHEN w2 THEN struct_pack(took := 3, line := concat_ws(' ', n2, n1, line)) WHEN r2 THEN struct_pack(took := 3, line := concat_ws(' ', n1, line, n2)) ELSE struct_pack(took := 2, line := concat_ws(' ', n1, line)) END
   WHEN g AND n2 IS NOT NULL AND w1 THEN CASE WHEN r2 THEN struct_pack(took := 3, line := concat_ws(' ', n1, n2)) ELSE struct_pack(took := 2, line := n1) END ELSE struct_pack(took := 1, line := line) END AS s FROM sh),
 stitched AS (WITH RECURSIVE w(doc_id, k, took, line_ix, line) AS (SELECT doc_id, k, s.took, line_ix, s.line FROM so WHERE k = 1 UNION ALL SELECT o.doc_id, o.k, o.s.took, o.line_ix, o.s.line FROM w JOIN so AS o ON o.doc_id = w.doc_id AND o.k = w.k + w.took) SELECT doc_id, line_ix, line FROM w)"""


CLEANED_SQL = f"filtered AS ({CLEAN_SQL}), " + stitch_sql("filtered") + ", cleaned AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_ix) - 1 AS INT) AS line_ix, line FROM stitched)"


@query("merge_value_continuation", LINES + ", " + CLEANED_SQL + ", " + detect_sql("cleaned") + " SELECT raw_text, count(*) AS n FROM found WHERE classification = 'lab' GROUP BY 1")
def merge_value_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.detect_rows(Q.clean(V.report_lines(spark, sf_dir))).where("classification = 'lab'").groupBy("raw_text").agg(F.count(F.lit(1)).alias("n"))


@query("column_stitch", COLUMNS + ", " + stitch_sql("v") + " SELECT * FROM stitched")
def column_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.stitch_columns(V.column_lines(spark, sf_dir))


BLOCK_SQL = f""", r AS (SELECT *, line_ix + 1 AS p FROM v),
 runs AS (""" + " UNION ALL ".join(f"SELECT doc_id, p, {k} AS n, concat_ws(chr(1), {', '.join('lead(line, ' + str(i) + ') OVER d' for i in range(k))}) AS run, line FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY p) QUALIFY lead(line, {k - 1}) OVER d IS NOT NULL" for k in range(2, 6)) + f"""),
 block AS (SELECT doc_id, p, n, run FROM runs a WHERE regexp_matches(line, {quoted(P.BLOCK_KEYWORD)}) AND EXISTS (SELECT 1 FROM runs b WHERE b.doc_id = a.doc_id AND b.n = a.n AND b.run = a.run AND b.p >= a.p + a.n) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p, n DESC) = 1),
 step AS (SELECT r.doc_id, r.p, r.line_ix, r.line, m.p IS NOT NULL AS copy, CASE WHEN m.p IS NULL THEN 1 ELSE block.n END AS took FROM r LEFT JOIN block ON block.doc_id = r.doc_id LEFT JOIN runs m ON m.doc_id = r.doc_id AND m.p = r.p AND m.n = block.n AND m.run = block.run AND m.p >= block.p + block.n),
 walk AS (WITH RECURSIVE w(doc_id, p, took, line_ix, line, copy) AS (SELECT doc_id, p, took, line_ix, line, copy FROM step WHERE p = 1 UNION ALL SELECT s.doc_id, s.p, s.took, s.line_ix, s.line, s.copy FROM w JOIN step s ON s.doc_id = w.doc_id AND s.p = w.p + w.took) SELECT * FROM w)
SELECT doc_id, line_ix, line FROM walk WHERE NOT copy"""


@query("repeated_block_dedup", COLUMNS + BLOCK_SQL)
def repeated_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.drop_repeated_block(V.column_lines(spark, sf_dir))


def name_sql(x: str) -> str:
    """clean_name() of an expression."""
    longest = lambda words: T.escaped(tuple(sorted(words, key=len, reverse=True))).replace(" ", "\\s+")
    own, heads = longest(P.DESCRIPTORS), longest((*P.COLUMN_LABELS, *P.DESCRIPTORS))
    x = f"regexp_replace(trim({x}), '\\s+', ' ', 'g')"
    leak = quoted(f"(?i)^(.+?(?:\\s|\\())(?:{own})\\b")
    x = f"CASE WHEN regexp_extract({x}, {leak}, 1) <> '' THEN regexp_replace(regexp_extract({x}, {leak}, 1), '[\\s(]+$', '') ELSE {x} END"
    for _ in range(2):
        x = f"regexp_replace(regexp_replace({x}, {quoted(f'(?i)^(?:{heads}(?:{chr(92)}s+|$))+')}, ''), {quoted(f'(?i)(?:(?:^|{chr(92)}s+){own})+$')}, '')"
    return f"trim(regexp_replace({x}, '\\s*[<>]\\s*$', ''))"


def field_sql(view: str, x: str = "line") -> str:
    """The fields of each row of a view, token by token."""
    full = lambda e, pattern: f"regexp_full_match({e}, {quoted(pattern)})"
    unit = " ".join(f"WHEN len(r) >= {n} AND {full("array_to_string(r[1:" + str(n) + "], ' ')", UNIT_ONLY)} THEN {n}" for n in (4, 3, 2, 1))
    generic = f"(v > 0 AND (lower(test_name) IN ({', '.join(map(quoted, P.GENERIC_NAMES))}) OR lower(regexp_replace(test_name, '\\s+', ' ', 'g')) IN ({', '.join(map(quoted, P.DESCRIPTORS))}) OR {full('test_name', UNIT_ONLY)}))"
    return f"""wa AS (SELECT *, trim({x}) AS raw, list_filter(string_split_regex(trim({x}), '\\s+'), lambda y: y <> '') AS w FROM {view}),
 wb AS (SELECT *, coalesce(list_position(list_transform(w, lambda y: {full('y', VALUE_ONLY)}), true), 0) AS v FROM wa),
 wc AS (SELECT *, CASE WHEN v > 0 THEN w[v + 1:len(w)] ELSE []::VARCHAR[] END AS r, CASE WHEN v > 1 THEN array_to_string(w[1:v - 1], ' ') WHEN v = 0 THEN raw ELSE '' END AS named FROM wb),
 wd AS (SELECT *, CASE {unit} ELSE 0 END AS u, {name_sql('named')} AS nm FROM wc),
 we AS (SELECT *, r[u + 1] AS t FROM wd),
 wg AS (SELECT *, CASE WHEN {full('t', P.FLAG)} THEN t END AS flag, CASE WHEN NOT {full('t', P.FLAG)} AND NOT regexp_matches(t, '^[-+0-9<>≤≥]') AND NOT {full('t', '(?i:' + P.QUALITATIVE + ')')} THEN t END AS note FROM we),
 wh AS (SELECT *, u + (flag IS NOT NULL OR note IS NOT NULL)::INT AS i FROM wg),
 wk AS (SELECT *, r[i + 1] AS one, array_to_string(r[i + 1:i + 2], ' ') AS two, array_to_string(r[i + 1:i + 3], ' ') AS three, len(r) - i AS rest FROM wh),
 wm AS (SELECT *, CASE WHEN rest < 1 THEN 0 WHEN {full('one', P.SPAN + '|' + P.COMPARISON + '|(?i:' + P.QUALITATIVE + ')')} THEN 1 WHEN rest >= 2 AND {full('two', P.COMPARISON)} THEN 2 WHEN rest >= 3 AND {full('three', P.SPAN)} THEN 3 ELSE 0 END AS n FROM wk),
 wn AS (SELECT *, CASE n WHEN 1 THEN one WHEN 2 THEN two WHEN 3 THEN three END AS range_text, nullif(array_to_string(r[i + n + 1:len(r)], ' '), '') AS tail, CASE WHEN u > 0 THEN array_to_string(r[1:u], ' ') END AS own_unit, v > 0 AND nm = '' AS missing, CASE WHEN v = 0 THEN array_to_string(w, ' ') WHEN nm = '' THEN raw ELSE nm END AS test_name FROM wm),
 units(k, canonical) AS (VALUES {values(P.UNITS)}),
 fields AS (SELECT wn.* EXCLUDE (test_name), regexp_replace(trim(test_name), '\\s+', ' ', 'g') AS test_name, coalesce(w[v], '') AS value, coalesce(canonical, own_unit) AS unit,
   CASE WHEN {full('range_text', P.SPAN)} THEN regexp_extract(range_text, {quoted(P.SPAN)}, 1)::DOUBLE WHEN {full('range_text', P.COMPARISON)} AND regexp_matches(range_text, '^(?:>|≥)') THEN regexp_extract(range_text, {quoted(P.COMPARISON)}, 2)::DOUBLE END AS low,
   CASE WHEN {full('range_text', P.SPAN)} THEN regexp_extract(range_text, {quoted(P.SPAN)}, 2)::DOUBLE WHEN {full('range_text', P.COMPARISON)} AND regexp_matches(range_text, '^(?:<|≤)') THEN regexp_extract(range_text, {quoted(P.COMPARISON)}, 2)::DOUBLE END AS high,
   nullif(concat_ws(' ', note, tail), '') AS notes, missing OR v = 0 OR {generic} AS uncertain,
   CASE WHEN v = 0 AND raw <> '' AND (nm = '' OR lower(nm) IN ({', '.join(map(quoted, P.DESCRIPTORS))})) THEN 'Ambiguous test name; raw: ''' || {x} || ''''
     ELSE nullif(concat_ws(' | ', CASE WHEN {generic} THEN 'Generic test name "' || test_name || '"; raw: ''' || {x} || '''' END, CASE WHEN missing OR raw = '' THEN 'Missing testName; raw: ''' || {x} || '''' END, CASE WHEN v = 0 THEN 'Missing value; raw: ''' || {x} || '''' END), '') END AS uncertainty_reason
   FROM wn LEFT JOIN units ON k = upper(own_unit))"""


FIELDS = ("test_name", "value", "unit", "flag", "low", "high", "range_text", "notes", "uncertain", "uncertainty_reason")


@query("field_extract", LINES + ", " + field_sql("v") + f" SELECT doc_id, line_ix, {', '.join(FIELDS)} FROM fields")
def field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fields(V.report_lines(spark, sf_dir), "line").select("doc_id", "line_ix", *FIELDS)


def stub_sql(view: str, x: str) -> str:
    """The labels of the rules for a view's texts, and the fields of those that look like results."""
    full = lambda e, pattern: f"regexp_full_match({e}, {quoted(pattern)})"
    unit = " ".join(f"WHEN len(r) >= {n} AND {full("array_to_string(r[1:" + str(n) + "], ' ')", UNIT_ONLY)} THEN {n}" for n in (4, 3, 2, 1))
    return f"""sa AS (SELECT *, trim({x}) AS txt, list_filter(string_split_regex(trim({x}), '\\s+'), lambda y: y <> '') AS w FROM {view}),
 sb AS (SELECT *, coalesce(list_position(list_transform(w, lambda y: {full('y', VALUE_ONLY)}), true), 0) AS v FROM sa),
 sc AS (SELECT *, w[v + 1:len(w)] AS r, CASE WHEN v > 1 THEN {name_sql("array_to_string(w[1:v - 1], ' ')")} ELSE '' END AS nm FROM sb),
 sd AS (SELECT *, CASE {unit} ELSE 0 END AS u FROM sc),
 se AS (SELECT *, CASE WHEN {full('r[u + 1]', P.FLAG)} THEN r[u + 1] END AS s_flag FROM sd),
 sg AS (SELECT *, r[u + 1 + (s_flag IS NOT NULL)::INT:len(r)] AS rest FROM se),
 sh AS (SELECT *, list_filter(list_transform(range(1, len(rest) + 1), lambda j: array_to_string(rest[j:j + 2], ' ')), lambda y: regexp_matches(y, {quoted(RANGE_RE2)}))[1] AS s_range,
   v > 1 AND (regexp_matches(txt, {quoted(P.NUMBER)}) OR {full('txt', '(?i:' + P.QUALITATIVE + ')')}) AND nm <> '' AND lower(nm) NOT IN ({', '.join(map(quoted, P.DESCRIPTORS))}) AND regexp_matches(nm, '[A-Za-z]{{3,}}') AS lab FROM sg),
 labelled AS (SELECT *, CASE WHEN regexp_matches(txt, '(?i)^(?:Patient\\s+)?Name\\s*:\\s*(.+?)$') THEN 'metadata' WHEN txt = '' OR {noise_sql('txt')} IS NOT NULL THEN 'noise' WHEN regexp_matches(txt, {quoted(P.STUB_LAB)}) AND len(w) <= 6 THEN 'metadata' WHEN lab THEN 'lab_result' ELSE 'uncertain' END AS label FROM sh)"""


CONFIDENCE_SQL = "CASE WHEN label = 'metadata' THEN 0.7e0 WHEN label = 'noise' THEN 0.95e0 WHEN label = 'lab_result' THEN 0.75e0 ELSE 0.3e0 END"


@query("stub_labels", LINES + ", " + stub_sql("v", "line") + f" SELECT doc_id, line_ix, label, {CONFIDENCE_SQL} AS confidence FROM labelled")
def stub_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.classify(V.report_lines(spark, sf_dir).withColumn("text", F.col("line"))).select("doc_id", "line_ix", "label", "confidence")


BLOCKS = LINES + CANDIDATES_SQL.replace("SELECT doc_id, line_ix AS line_start", ", blocks AS (SELECT doc_id, line_ix AS line_start") + "), "
REJECTION_SQL = f"""CASE WHEN label <> 'lab_result' THEN 'not a lab_result label (' || label || ')' WHEN regexp_full_match(nm, {quoted(UNIT_ONLY)}) THEN 'unit-only testName "' || nm || '"' WHEN lower(nm) IN ({', '.join(map(quoted, (*P.COLUMN_LABELS, *P.PANELS)))}) THEN 'section/header/column-label testName "' || nm || '"'
 WHEN ends_with(nm, ':') THEN 'label-like testName "' || nm || '" (trailing colon)' WHEN lower(nm) IN ({', '.join(map(quoted, P.STATUS_WORDS))}) THEN 'status-word testName "' || nm || '"' WHEN len(list_filter(string_split_regex(nm, '\\s+'), lambda y: regexp_full_match(y, '[a-z]{{3,}}'))) > 0 THEN 'prose-like testName "' || nm || '"'
 WHEN len(list_filter(string_split_regex(lower(nm), '\\s+'), lambda y: NOT contains(lower(txt), y))) > 0 THEN 'testName tokens not found in evidence' WHEN u = 0 AND s_range IS NULL AND NOT regexp_full_match(w[v], {quoted('(?i:' + P.QUALITATIVE + ')')}) THEN 'numeric value without unit or reference range (not a clinical measurement)' END"""


@query("gate_reject_reasons", BLOCKS + stub_sql("blocks", "text") + f" SELECT {REJECTION_SQL} AS rejection, count(*) AS n FROM labelled GROUP BY 1")
def gate_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = X.guard(X.classify(Q.candidates(V.report_lines(spark, sf_dir))))
    return items.groupBy(X.rejection(items).alias("rejection")).agg(F.count(F.lit(1)).alias("n"))


OUTCOMES_SQL = f"(SELECT *, {REJECTION_SQL} AS why FROM labelled)"


@query("extraction_yield", BLOCKS + stub_sql("blocks", "text") + f", n AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (why IS NULL) AS entries FROM {OUTCOMES_SQL} GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM v) SELECT doc_id, coalesce(blocks, 0) AS blocks, coalesce(entries, 0) AS entries, true AS used, CASE WHEN blocks IS NULL THEN false ELSE entries = 0 OR entries < 0.05 * blocks OR (blocks >= 8 AND entries < 2) END AS low_yield FROM d LEFT JOIN n USING (doc_id)")
def extraction_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.report_lines(spark, sf_dir)
    return X.extract(rows.select("doc_id").distinct(), rows).runs


@query("labelled_entries", BLOCKS + stub_sql("blocks", "text") + f""", heads AS (SELECT *, last_value(CASE WHEN {header_sql.replace('line', 'first_line')} THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_start ROWS UNBOUNDED PRECEDING) AS head, {REJECTION_SQL} AS why FROM (SELECT l.*, v.line AS first_line FROM labelled l JOIN v ON v.doc_id = l.doc_id AND v.line_ix = l.line_start)),
 units(k, canonical) AS (VALUES {values(P.UNITS)})
 SELECT doc_id, line_start AS line_ix, coalesce(nullif(head, 'Uncategorized'), 'Uncategorized') AS category, regexp_replace(nm, '\\s+', ' ', 'g') AS test_name, w[v] AS value, coalesce(canonical, own_unit) AS unit, s_flag AS flag, s_range AS range_text, 'phase6:llm; line ' || (line_start + 1) AS notes FROM (SELECT *, CASE WHEN u > 0 THEN array_to_string(r[1:u], ' ') END AS own_unit FROM heads) LEFT JOIN units ON k = upper(own_unit) WHERE why IS NULL""")
def labelled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.report_lines(spark, sf_dir)
    return X.extract(rows.select("doc_id").distinct(), rows).entries.select("doc_id", "line_ix", "category", "test_name", "value", "unit", "flag", "range_text", "notes")


BANDS_SQL = ITEMS + """, n AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) > 18, true)::INT AS new FROM v),
 b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY x) - 1 AS band FROM n),
 g AS (SELECT doc_id, band, min(x) AS x_min, max(x) AS x_max, count(*) AS n FROM b GROUP BY ALL),
 bands AS (SELECT doc_id, band::BIGINT AS band, x_min, x_max, n FROM g QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2) """


@query("column_bands", BANDS_SQL + "SELECT * FROM bands")
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.column_bands(V.spatial_items(spark, sf_dir), "doc_id")


@query("nearest_band", BANDS_SQL + ", q AS (SELECT doc_id, item_id, x + 35 AS x FROM v), d AS (SELECT q.*, band, greatest(x_min - q.x, q.x - x_max, 0) AS away FROM q LEFT JOIN bands USING (doc_id)) SELECT doc_id, item_id, CASE WHEN away <= 80 THEN band END AS band FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY away, band) = 1")
def nearest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.spatial_items(spark, sf_dir)
    return L.nearest_band(items.withColumn("x", F.col("x") + 35), L.column_bands(items, "doc_id"), "doc_id").select("doc_id", "item_id", "band")


ROWS_SQL = ITEMS + """, h AS (SELECT doc_id, page, y, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS k FROM (SELECT DISTINCT doc_id, page, y FROM v)),
 walk AS (WITH RECURSIVE w(doc_id, page, y, k, anchor, row_ix) AS (SELECT doc_id, page, y, k, y, 0 FROM h WHERE k = 1 UNION ALL SELECT h.doc_id, h.page, h.y, h.k, CASE WHEN w.anchor - h.y <= 4 THEN w.anchor ELSE h.y END, CASE WHEN w.anchor - h.y <= 4 THEN w.row_ix ELSE w.row_ix + 1 END FROM w JOIN h ON h.doc_id = w.doc_id AND h.page = w.page AND h.k = w.k + 1) SELECT * FROM w),
 placed AS (SELECT v.*, row_ix FROM v JOIN walk USING (doc_id, page, y)) """


@query("anchor_rows", ROWS_SQL + "SELECT doc_id, page, item_id, row_ix FROM placed")
def anchor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rows(V.spatial_items(spark, sf_dir)).select("doc_id", "page", "item_id", "row_ix")


TITLE_SQL = f"(length(trim(text)) <= 70 AND regexp_matches(trim(text), {quoted(P.TITLE)}) AND NOT regexp_matches(trim(text), '[0-9]') AND NOT regexp_matches(trim(text), {quoted(P.TITLE_UNIT)}))"
BLOCKS_SQL = ROWS_SQL + f""", pieces AS (SELECT *, coalesce(x - lag(x + width) OVER o > 0.33e0 * (height + lag(height) OVER o) / 2, false) AS apart FROM placed WINDOW o AS (PARTITION BY doc_id, page, row_ix ORDER BY x, item_id)),
 lines AS (SELECT doc_id, page, row_ix, string_agg(CASE WHEN apart THEN ' ' ELSE '' END || text, '' ORDER BY x, item_id) AS text, list(y ORDER BY x, item_id)[count(*) // 2 + 1] AS y FROM pieces GROUP BY ALL),
 near AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY row_ix) <= 4 AS top, row_number() OVER (PARTITION BY doc_id, page ORDER BY row_ix DESC) <= 4 AS low, floor(y / 15 + 0.5) * 15 AS step, left(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), 60) AS said FROM lines),
 edged AS (SELECT a.doc_id, page, row_ix, text, y, (top AND EXISTS (SELECT 1 FROM near b WHERE b.doc_id = a.doc_id AND b.step = a.step AND b.said = a.said AND b.top AND b.page <> a.page)) OR (low AND EXISTS (SELECT 1 FROM near b WHERE b.doc_id = a.doc_id AND b.step = a.step AND b.said = a.said AND b.low AND b.page <> a.page)) OR regexp_matches(trim(text), {quoted(P.PAGE_HEADERS)}) OR regexp_matches(trim(text), {quoted(P.PAGE_FOOTERS)}) AS at_edge FROM near a) """
TYPED_SQL = f"""parted AS (SELECT *, (lag(page) OVER o IS NULL OR lag(page) OVER o <> page OR abs(y - lag(y) OVER o) > 14 OR {TITLE_SQL} OR regexp_matches(trim(text), {quoted(P.BLOCK_BOILERPLATE)}))::INT AS new FROM edged WINDOW o AS (PARTITION BY doc_id ORDER BY page, row_ix)),
 numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page, row_ix ROWS UNBOUNDED PRECEDING) - 1 AS block_ix FROM parted),
 types AS (SELECT doc_id, block_ix, CASE WHEN regexp_matches(trim(first), {quoted(P.BLOCK_BOILERPLATE)}) THEN 'boilerplate' WHEN n = 1 AND {TITLE_SQL.replace('text', 'first')} THEN 'section_title' WHEN lab >= 1 AND lab >= 0.4 * n THEN 'lab_table' WHEN prose THEN 'paragraph' WHEN regexp_matches(trim(first), {quoted(P.BLOCK_METADATA)}) THEN 'metadata' ELSE 'unknown' END AS type, block_text
   FROM (SELECT doc_id, block_ix, count(*) AS n, count(*) FILTER (regexp_matches(text, {quoted(P.LAB_ROW)})) AS lab, first(text ORDER BY page, row_ix) AS first, bool_or(length(text) >= 60 AND NOT regexp_matches(left(text, 20), '[0-9]')) AS prose, string_agg(text, chr(10) ORDER BY page, row_ix) AS block_text FROM numbered GROUP BY ALL)) """


@query("row_gap_blocks", BLOCKS_SQL + ", " + TYPED_SQL + "SELECT doc_id, page, row_ix, block_ix::BIGINT AS block_ix, type, at_edge, text, block_text FROM numbered JOIN types USING (doc_id, block_ix)")
def row_gap_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.blocks(L.edges(L.row_lines(L.rows(V.spatial_items(spark, sf_dir)))))
    return lines.join(L.block_types(lines).drop("page"), ["doc_id", "block_ix"]).select("doc_id", "page", "row_ix", "block_ix", "type", "at_edge", "text", "block_text")


@query("anti_excluded_rows", ROWS_SQL + "SELECT doc_id, page, item_id FROM placed p WHERE EXISTS (SELECT 1 FROM placed o WHERE o.doc_id = p.doc_id AND o.page = p.page AND o.row_ix = p.row_ix AND o.text <> 'SERUM')")
def anti_excluded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_edges(L.rows(V.spatial_items(spark, sf_dir)), F.col("text") == "SERUM").select("doc_id", "page", "item_id")


@query("page_width", ITEMS + "SELECT doc_id, page, max(x + width) AS width FROM v GROUP BY ALL")
def page_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.width(V.spatial_items(spark, sf_dir))


@query("page_text", ROWS_SQL + ", l AS (SELECT doc_id, page, row_ix, string_agg(text, ' ' ORDER BY x, item_id) AS line FROM placed GROUP BY ALL) SELECT doc_id, page, string_agg(line, chr(10) ORDER BY row_ix) AS text FROM l GROUP BY ALL")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_text(V.spatial_items(spark, sf_dir))


LAYOUT_SQL = f""", kept AS (SELECT * FROM edged WHERE NOT at_edge), {TYPED_SQL.replace('FROM edged', 'FROM kept')},
 tables AS (SELECT doc_id, page, row_ix, block_ix, (NOT coalesce(regexp_matches(trim(text), '^[0-9<>≤≥+\\-.±]') AND lag(page) OVER o = page AND abs(y - lag(y) OVER o) <= 14, false))::INT AS begins FROM numbered JOIN types USING (doc_id, block_ix) WHERE type = 'lab_table' WINDOW o AS (PARTITION BY doc_id, block_ix ORDER BY page, row_ix)),
 entries AS (SELECT doc_id, page, row_ix, block_ix, sum(begins) OVER (PARTITION BY doc_id, block_ix ORDER BY page, row_ix ROWS UNBOUNDED PRECEDING) - 1 AS entry_ix FROM tables),
 inside AS (SELECT p.*, block_ix, entry_ix FROM placed p JOIN entries USING (doc_id, page, row_ix)),
 banded AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, block_ix ORDER BY x) - 1 AS band FROM (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY doc_id, block_ix ORDER BY x) > 18, true)::INT AS new FROM inside)),
 bands AS (SELECT doc_id, block_ix, band, min(x) AS x_min, max(x) AS x_max FROM banded GROUP BY doc_id, block_ix, band QUALIFY count(*) OVER (PARTITION BY doc_id, block_ix) >= 2),
 sample AS (SELECT b.doc_id, b.block_ix, b.band, i.text FROM bands b JOIN inside i ON i.doc_id = b.doc_id AND i.block_ix = b.block_ix AND i.x BETWEEN b.x_min - 5 AND b.x_max + 5 QUALIFY row_number() OVER (PARTITION BY b.doc_id, b.block_ix, b.band ORDER BY item_id) <= 10),
 roles AS (SELECT doc_id, block_ix, band, CASE WHEN band = 0 THEN 'testName' WHEN bool_or({only_sql('text', P.FLAG)}) THEN 'flag' WHEN bool_or({only_sql('text', P.SPAN + '|' + P.COMPARISON)}) THEN 'referenceRange' WHEN bool_or({only_sql('text', UNIT_ONLY)}) THEN 'unit' WHEN bool_or({only_sql('text', VALUE_ONLY)}) THEN 'value' ELSE 'unknown' END AS role FROM sample GROUP BY doc_id, block_ix, band),
 cells AS (SELECT i.*, CASE WHEN greatest(x_min - i.x, i.x - x_max, 0) <= 80 THEN role ELSE 'unknown' END AS role FROM inside i JOIN bands b USING (doc_id, block_ix) JOIN roles USING (doc_id, block_ix, band) QUALIFY row_number() OVER (PARTITION BY i.doc_id, item_id, i.page ORDER BY greatest(x_min - i.x, i.x - x_max, 0), band) = 1),
 slots AS (SELECT doc_id, block_ix, entry_ix, {', '.join(f"string_agg(text, ' ' ORDER BY page, row_ix, x, text) FILTER (role = '{r}') AS {r}" for r in ('testName', 'value', 'unit', 'referenceRange', 'flag'))} FROM cells GROUP BY ALL),
 both_ AS (SELECT doc_id, block_ix, entry_ix AS k, concat_ws(' ', testName, value, unit, referenceRange, flag) AS line FROM slots WHERE testName IS NOT NULL OR value IS NOT NULL
  UNION ALL SELECT doc_id, block_ix, row_ix, CASE WHEN type IN ('metadata', 'unknown') AND regexp_matches(trim(text), {quoted(P.COLUMN_HEAD)}) THEN trim(regexp_replace(trim(text), {quoted(P.COLUMN_HEADS)}, '')) ELSE trim(text) END FROM numbered JOIN types USING (doc_id, block_ix) WHERE type NOT IN ('boilerplate', 'paragraph') AND NOT EXISTS (SELECT 1 FROM bands WHERE bands.doc_id = numbered.doc_id AND bands.block_ix = numbered.block_ix))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_ix, k, line) - 1 AS INT) AS line_ix, line FROM both_ WHERE line <> ''"""


@query("layout_lines", BLOCKS_SQL + LAYOUT_SQL)
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.to_lines(V.spatial_items(spark, sf_dir))


@query("quality_by_label", "SELECT quality, toxic, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def quality_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


ANALYZE_SQL = f"""{LINES}, {CLEANED_SQL}, {detect_sql('cleaned')},
 carried AS (SELECT doc_id, line_ix, coalesce(last_value(CASE WHEN {header_sql} THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Uncategorized') AS category FROM cleaned),
 rows_ AS (SELECT f.*, category FROM found f JOIN carried USING (doc_id, line_ix)), {field_sql('rows_', 'raw_text')},
 checked AS (SELECT *, classification = 'lab' AND NOT starts_with(coalesce(uncertainty_reason, ''), 'Ambiguous test name') AND test_name <> '' AND lower(test_name) NOT IN ({', '.join(map(quoted, P.DESCRIPTORS))}) AND NOT regexp_full_match(test_name, {quoted(UNIT_ONLY)}) AND regexp_matches(test_name, '[A-Za-z]{{3}}') AS ok FROM fields),
 quality AS (SELECT doc_id, count(*) FILTER (ok AND NOT uncertain) / count(*) AS confidence FROM checked GROUP BY 1),
 ready AS (SELECT doc_id, line_ix AS ord, test_name AS raw_name, category AS raw_category, value, unit, flag, low, high, range_text, uncertain FROM checked WHERE ok),
 {named_sql('ready', 'range_text IS NOT NULL')},
 flags(k, s) AS (VALUES {values(P.FLAG_SEVERITY)}),
 rated AS (SELECT fated.*, {SEVERITY_SQL} AS severity FROM (SELECT *, try_cast(regexp_extract(value, '^\\s*([-+]?[0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS n FROM fated WHERE fate = 'kept') fated LEFT JOIN flags f ON f.k = lower(trim(flag))),
 buckets AS (SELECT doc_id, CASE WHEN severity = 'skipped' THEN 'skipped' WHEN uncertain THEN 'uncertain' WHEN severity <> 'normal' THEN 'abnormal' ELSE 'normal' END AS bucket FROM rated),
 counted AS (SELECT doc_id, count(*) AS total_entries, {', '.join(f"count(*) FILTER (bucket = '{b}') AS {b}_count" for b in ('abnormal', 'normal', 'uncertain', 'skipped'))} FROM buckets GROUP BY 1),
 about AS (SELECT doc_id, max(CASE WHEN line_ix < 30 AND starts_with(line, 'Name') THEN 'Test Person' END) AS patient_name, max(CASE WHEN line_ix < 30 AND starts_with(line, 'Name') THEN 30 END) AS patient_age, max(CASE WHEN line_ix < 30 AND starts_with(line, 'Name') THEN 'F' END) AS patient_gender, max(CASE WHEN starts_with(line, 'Report') THEN '2026-03-09' END) AS report_date, max(CASE WHEN line_ix < 30 AND starts_with(line, 'EXAMPLE') THEN line END) AS lab_name FROM cleaned GROUP BY 1),
 report AS (SELECT d.doc_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('total_entries', 'abnormal_count', 'normal_count', 'uncertain_count', 'skipped_count'))}, patient_name, patient_age, patient_gender, report_date, lab_name, coalesce(confidence, 0) AS confidence FROM (SELECT DISTINCT doc_id FROM v) d LEFT JOIN counted USING (doc_id) LEFT JOIN about USING (doc_id) LEFT JOIN quality USING (doc_id))
SELECT *, concat_ws(' ', CASE WHEN patient_name IS NOT NULL AND report_date IS NOT NULL THEN 'Report for ' || patient_name || ' (dated ' || report_date || ')' WHEN patient_name IS NOT NULL THEN 'Report for ' || patient_name WHEN report_date IS NOT NULL THEN 'Report dated ' || report_date ELSE 'Report summary' END
   || CASE WHEN t = 0 THEN ': No evaluable test results found.' WHEN abnormal_count = 0 THEN ': All ' || t || ' test result' || CASE WHEN t = 1 THEN ' is' ELSE 's are' END || ' within normal range.' ELSE ': ' || abnormal_count || ' of ' || t || ' test result' || CASE WHEN t = 1 THEN '' ELSE 's' END || CASE WHEN abnormal_count = 1 THEN ' is' ELSE ' are' END || ' outside the normal range.' END,
   CASE WHEN t > 0 AND uncertain_count > 0 THEN uncertain_count || CASE WHEN uncertain_count = 1 THEN ' result' ELSE ' results' END || ' could not be fully verified.' END, CASE WHEN t > 0 AND confidence < 0.7 THEN 'Note: the extraction confidence for this report is low; some values may be inaccurate.' END) AS overview
FROM (SELECT *, total_entries - skipped_count AS t FROM report)"""


@query("analyze_report", f"SELECT * EXCLUDE (t) FROM ({ANALYZE_SQL})")
def analyze_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.report_lines(spark, sf_dir)
    docs = rows.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line_ix", "line")))["line"], "\n").alias("text"))
    return analyze(docs.withColumn("extraction_status", F.lit("success"))).summary.drop("sample_date", "report_id")


FLAGSHIP_SQL = (
    NAMED
    + f""", flags(k, s) AS (VALUES {values(P.FLAG_SEVERITY)}), kept AS (SELECT *, try_cast(regexp_extract(value, '^\\s*([-+]?[0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS n FROM fated WHERE fate = 'kept')
SELECT category, {SEVERITY_SQL} AS severity, count(*) AS n FROM kept LEFT JOIN flags f ON f.k = lower(trim(flag)) GROUP BY 1, 2"""
)


def severity_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: names and sections resolved, duplicates merged, severities counted."""
    kept = S.deduplicate(S.normalise(V.lab_entries(spark, sf_dir)).where("not suppressed")).where("fate = 'kept'")
    return R.findings(kept).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


query("severity_by_category", FLAGSHIP_SQL)(severity_by_category)
