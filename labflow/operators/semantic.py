"""Names and sections against an ontology, duplicates with an audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labflow.functions import patterns as P
from labflow.functions import text as T
from labflow.operators.once import Once

#: Names that are looked up in a literal map at most; beyond it the table is joined.
MOST_LITERAL = 2_000


def lookup_table(synonyms: dict[str, str] | None = None) -> dict[str, str]:
    """Keys of all names: each canonical name in lower case, and its synonyms."""
    own = {name.lower(): name for names in P.CATEGORIES.values() for name in names}
    return own | {k.lower(): v for k, v in (synonyms if synonyms is not None else P.SYNONYMS).items()}


def true_categories() -> dict[str, str]:
    return {name: category for category, names in P.CATEGORIES.items() for name in names}


def canonical_name(raw: Column, synonyms: dict[str, str] | None = None) -> Column:
    """The name of the longest leading run of words that the table has, or null; no join, no shuffle."""
    found = T.lit_map(lookup_table(synonyms))
    words = F.split(T.ontology_key(raw), " ")
    runs = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.element_at(found, F.array_join(F.slice(words, 1, n), " ")))
    return F.get(F.filter(runs, lambda x: x.isNotNull()), F.lit(0))


def exact_name(entries: DataFrame, names: DataFrame, on: str = "raw_name") -> DataFrame:
    """Left join with a name table (key, canonical) of any size on the normalised name; the engine broadcasts it if it is small."""
    return entries.withColumn("name_key", T.ontology_key(F.col(on))).join(names.withColumnRenamed("key", "name_key"), "name_key", "left").drop("name_key")


def section_kind(raw: Column) -> Column:
    """noise, pseudo or medical."""
    t = T.strip(raw)
    norm = T.collapse(F.lower(t))
    known = F.array(*(F.lit(k) for k in P.KNOWN_SECTIONS))
    either = lambda patterns: t.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    inside = F.exists(F.filter(known, lambda k: F.length(k) > 4), lambda k: norm.contains(k))
    return F.when(either(P.NOISE_SECTIONS), "noise").when(either(P.PSEUDO_SECTIONS), "pseudo").when(norm.isin(*P.SECTION_ALIASES) | F.array_contains(known, norm) | inside, "medical").otherwise("pseudo")


def section_category(raw: Column) -> Column:
    """The category that a heading stands for: an alias, the heading in title case, Uncategorized or Suppressed."""
    t = T.strip(raw)
    kind = section_kind(raw)
    alias = F.element_at(T.lit_map(P.SECTION_ALIASES), T.collapse(F.lower(t)))
    return F.when(kind == "noise", "Suppressed").when(kind == "pseudo", "Uncategorized").otherwise(F.coalesce(alias, T.title_case(t)))


def classify_sections(entries: DataFrame, column: str = "raw_category", once: Once | None = None) -> DataFrame:
    """Each distinct heading classified once, then joined back."""
    if once is not None:
        return once.each(entries, column, lambda df: df.withColumn("section_kind", section_kind(F.col(column))).withColumn("section", section_category(F.col(column))))
    kinds = entries.select(column).distinct().withColumn("section_kind", section_kind(F.col(column))).withColumn("section", section_category(F.col(column)))
    return entries.join(kinds, entries[column].eqNullSafe(kinds[column]), "left").drop(kinds[column])


def normalise(entries: DataFrame, synonyms: dict[str, str] | None = None, once: Once | None = None) -> DataFrame:
    """entries (doc_id, ord, raw_name, raw_category, ...) with section_kind, section, test_name and category.

    A known name's own category overrides the heading; what stands under a noise
    heading is marked suppressed.
    """
    entries = classify_sections(entries, once=once)
    name = F.coalesce(canonical_name(F.col("raw_name"), synonyms), T.strip(F.col("raw_name")))
    named = lambda df: df.withColumn("test_name", name)
    entries = named(entries) if once is None else once.each(entries, "raw_name", named)
    return entries.withColumn("category", F.coalesce(F.element_at(T.lit_map(true_categories()), F.col("test_name")), F.col("section"))).withColumn("suppressed", F.col("section_kind") == "noise")


def score(uncertain: Column, has_range: Column, unit: Column, value: Column) -> Column:
    """How complete an entry is: 8 certain, 4 range, 2 unit, 1 value."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False)).cast("int")
    return 8 * (~uncertain).cast("int") + 4 * has_range.cast("int") + 2 * has(unit) + has(value)


def deduplicate(entries: DataFrame) -> DataFrame:
    """entries with score, fate (kept, duplicate_merged, cross_section or suppressed), and name_order and group_order.

    Of one name and category the most complete entry stays, the first of equals.
    A name that has a category loses its uncategorized copies. Suppressed
    entries take no part. What is kept comes in the order of its name's first
    entry, then of its name and category's. One shuffle by doc_id and name serves
    all windows.
    """
    gone = F.coalesce(F.col("suppressed"), F.lit(False)) if "suppressed" in entries.columns else F.lit(False)
    has_range = F.col("low").isNotNull() | F.col("high").isNotNull()
    if "range_text" in entries.columns:
        has_range = has_range | F.col("range_text").isNotNull()
    s = score(F.col("uncertain"), has_range, F.col("unit"), F.col("value"))
    entries = entries.withColumns({"score": s, "_gone": gone, "_name": F.lower("test_name"), "_category": F.lower("category")})
    by_name = Window.partitionBy("doc_id", "_name", "_gone")
    by_both = Window.partitionBy("doc_id", "_name", "_gone", "_category")
    entries = entries.withColumns({"_place": F.row_number().over(by_both.orderBy(F.desc("score"), "ord")), "group_order": F.min("ord").over(by_both)})
    entries = entries.withColumns({"_some": F.max((F.col("_category") != "uncategorized").cast("int")).over(by_name), "name_order": F.min("ord").over(by_name)})
    fate = F.when(F.col("_gone"), "suppressed").when(F.col("_place") > 1, "duplicate_merged").when((F.col("_some") == 1) & (F.col("_category") == "uncategorized"), "cross_section").otherwise("kept")
    return entries.withColumn("fate", fate).drop("_gone", "_name", "_category", "_place", "_some")


#: Decisions that an audit tells of.
KINDS = ("entry_suppressed", "section_reclassified", "category_normalized", "section_suppressed", "name_canonicalized", "duplicate_merged")


def audit(entries: DataFrame) -> DataFrame:
    """(doc_id, ord, stage, kind, raw_name, test_name, raw_category, category): an event for each decision on normalised and deduplicated entries, suppressed ones included.

    stage is the step that decided, so (stage, ord) is the order of a report's
    events: 1 sections, 2 noise sections as a whole (once each, at the ord of
    their first entry), 3 names, 4 a known name's own category, 5 duplicates,
    6 uncategorized copies. All events of an entry come from one pass over it.
    """
    noise, pseudo = F.col("section_kind") == "noise", F.col("section_kind") == "pseudo"
    uncategorized, same = F.lit("Uncategorized"), F.col("category")
    events = (
        (noise, 1, "entry_suppressed", F.lit(None).cast("string")),
        (pseudo, 1, "section_reclassified", uncategorized),
        (~noise & ~pseudo & (F.col("section") != F.col("raw_category")), 1, "category_normalized", F.col("section")),
        (~noise & (F.col("test_name") != T.strip(F.col("raw_name"))), 3, "name_canonicalized", F.lit(None).cast("string")),
        (~noise & (F.col("category") != F.col("section")), 4, "category_normalized", same),
        (F.col("fate") == "duplicate_merged", 5, "duplicate_merged", same),
        (F.col("fate") == "cross_section", 6, "duplicate_merged", same),
    )
    told = F.array(*(F.when(where, F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), category.alias("category"))) for where, stage, kind, category in events))
    out = entries.select("doc_id", F.col("ord").cast("long").alias("ord"), "raw_name", "test_name", "raw_category", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("e"))
    out = out.select("doc_id", "ord", "e.stage", "e.kind", "raw_name", "test_name", "raw_category", "e.category")
    none = F.lit(None).cast("string")
    sections = entries.where(noise).groupBy("doc_id", "raw_category").agg(F.min("ord").cast("long").alias("ord"))
    return out.unionByName(sections.select("doc_id", "ord", F.lit(2).alias("stage"), F.lit("section_suppressed").alias("kind"), none.alias("raw_name"), none.alias("test_name"), "raw_category", none.alias("category")))


def audit_report(events: DataFrame) -> DataFrame:
    """(doc_id, and how many events of each kind)."""
    return events.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
