"""Scalar functions and predicates over report text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from labflow.functions import patterns as P

BLANKS = "[\\s\\u00A0]+"


def lit_map(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))


def strip(c: Column) -> Column:
    """Trim any white space, no-break spaces included."""
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), BLANKS, " ")


def tokens(c: Column) -> Column:
    return F.filter(F.split(strip(c), BLANKS), lambda x: F.length(x) > 0)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def is_number(c: Column) -> Column:
    return matches(c, f"^{P.NUMBER}$")


def is_qualitative(c: Column) -> Column:
    return matches(c, f"(?i)^{P.QUALITATIVE}$")


def is_value(c: Column) -> Column:
    return is_number(c) | is_qualitative(c)


def has_number(c: Column) -> Column:
    return matches(c, P.NUMBER)


def has_value(c: Column) -> Column:
    return matches(c, P.NUMBER) | matches(c, f"(?i)\\b{P.QUALITATIVE}\\b")


def has_unit(c: Column) -> Column:
    return matches(c, f"(?<!\\w){P.UNIT}(?!\\w)")


def is_unit(c: Column) -> Column:
    return matches(strip(c), f"(?iu)^{P.UNIT}$")


def has_range(c: Column) -> Column:
    return matches(c, f"(?i){P.SPAN}|{P.COMPARISON}|\\b{P.QUALITATIVE}\\b")


def is_range(c: Column) -> Column:
    return matches(strip(c), f"^(?:{P.SPAN}|{P.COMPARISON})$")


def has_flag(c: Column) -> Column:
    return matches(c, P.FLAG_INSIDE)


def is_flag(c: Column) -> Column:
    return matches(c, f"^{P.FLAG}$")


def is_blank(c: Column) -> Column:
    return matches(c, "^\\s*$")


def is_separator(c: Column) -> Column:
    return matches(c, P.SEPARATOR)


def is_page_marker(c: Column) -> Column:
    return matches(strip(c), P.PAGE_MARKER)


def is_header(c: Column) -> Column:
    """A section heading: its shape, without a number or a unit."""
    t = strip(c)
    return (F.length(t) > 0) & matches(t, P.HEADER_SHAPE) & ~has_number(t) & ~has_unit(t)


def is_row_header(c: Column) -> Column:
    return is_header(c) & ~has_value(strip(c))


def is_footer(c: Column) -> Column:
    return matches(c, P.FOOTERS) & ~has_number(c) & ~has_unit(c)


def is_lab_line(c: Column) -> Column:
    return has_value(c) & (has_unit(c) | has_range(c) | has_flag(c))


def is_contact(c: Column) -> Column:
    """Ways to reach someone; an address of mail is looked for only where there is an @."""
    return matches(c, P.NOISE["contact"]) | (c.contains("@") & matches(c, P.MAIL))


def noise_kind(c: Column) -> Column:
    """Which kind of noise a line is, or null; one alternation for each kind."""
    t = strip(c)
    kind = F.when(is_label(t), "label")
    for name, pattern in P.NOISE.items():
        kind = kind.when(is_contact(t) if name == "contact" else matches(t, pattern), name)
    return kind


def is_descriptor(c: Column) -> Column:
    """Nothing but a word of an assay."""
    return F.lower(collapse(c)).isin(*P.DESCRIPTORS)


def is_label(c: Column) -> Column:
    """Nothing but a word of an assay, a column's head or a panel."""
    return F.lower(collapse(c)).isin(*P.DESCRIPTORS, *P.COLUMN_LABELS, *P.PANELS)


def is_disclaimer(c: Column) -> Column:
    t, low = strip(c), F.lower(c)
    said = F.lit(False)
    for part in P.DISCLAIMERS:
        said = said | low.contains(part)
    prose = (F.length(t) >= 60) & t.endswith(".") & matches(t, P.PROSE)
    return said | matches(t, "^v\\s{2,}") | ((F.length(t) >= 80) & ~matches(F.substring(t, 1, 30), "\\d")) | prose


def escaped(words: tuple[str, ...]) -> str:
    """An alternation of the words as they are."""
    return "(?:" + "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in words) + ")"


def is_method(c: Column) -> Column:
    """A line that begins as one without data does."""
    return matches(F.lower(strip(c)), "^" + escaped(P.NO_DATA))


def is_interpretation(c: Column) -> Column:
    """A line of an interpretation table."""
    t = strip(c)
    return matches(t, "|".join(P.INTERPRETATIONS)) | (matches(t, P.GLUED_RANGE[0]) & matches(t, P.GLUED_RANGE[1]))


def starts_with_value(c: Column) -> Column:
    return matches(strip(c), f"{P.LEADING}|(?i)^{P.QUALITATIVE}\\b")


def is_value_continuation(c: Column) -> Column:
    return (has_value(c) | has_unit(c)) & starts_with_value(c)


def is_range_continuation(c: Column) -> Column:
    return has_range(c) & starts_with_value(c)


def is_value_only(c: Column) -> Column:
    return is_value(strip(c))


def is_name_only(c: Column) -> Column:
    """A block that may be a name: letters, and no value by itself."""
    return matches(strip(c), "[A-Za-z]{3,}") & ~is_value_only(c)


def is_range_only(c: Column) -> Column:
    """A range by itself; one with a sign may have a unit behind it."""
    return is_range(c) | matches(strip(c), r"^(?:<=|>=|<|>|≤|≥)\s*\d+(?:\.\d+)?(?:\s+[A-Za-z%/]+)?$")


def is_name_line(c: Column) -> Column:
    """A name by itself, as column layouts have it: a heading's shape without number, unit or range."""
    t = strip(c)
    return (F.length(t) >= 3) & ~has_number(t) & ~has_unit(t) & ~has_range(t) & matches(t, P.HEADER_SHAPE)


def is_technology_only(c: Column) -> Column:
    return matches(strip(c), f"^{P.TECHNOLOGY}$")


def is_meaningful_name(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) > 0) & ~is_descriptor(t) & ~is_unit(t) & matches(t, "[A-Za-z]{3}")


def split_glued(c: Column) -> Column:
    """Part tokens that a column layout has glued together.

    In this order: a unit from a digit; a digit, a letter or a bracket from a
    technology, and that from a digit or a name; a qualitative value from a dot,
    from another one, and from a letter; a name from its value and range, and
    from a count. Rules that consume both sides run as often as tokens may chain.
    """
    tech, said, word = P.TECHNOLOGY, P.QUALITATIVE, "(?:Negative|Positive|Reactive|Present|Absent)"
    rules = [(f"({P.GLUED_UNIT})(?=\\d)", "$1 ", 2), (f"(\\d)(?={tech})", "$1 ", 1), (f"(?<=[A-Za-z\\])])({tech})", " $1", 1), (f"({tech})(?=\\d)", "$1 ", 2), (f"({tech})(?=[A-Z]{{4}})", "$1 ", 2)]
    rules += [(f"(?i)(\\w)\\.({said})", "$1 $2", 1), (f"(?i)({said})({said})", "$1 $2", 3), (f"(?i)([a-z])({word})", "$1 $2", 1)]
    rules += [("([A-Za-z])(\\d+(?:\\.\\d+)?)(\\d+(?:\\.\\d+)?[-–]\\d+(?:\\.\\d+)?)", "$1 $2 $3", 1), ("(?i)([A-Za-z])(\\d+[-–]\\d+/HPF)", "$1 $2", 1)]
    for pattern, to, times in rules:
        for _ in range(times):
            c = F.regexp_replace(c, pattern, to)
    return c


def reorder(c: Column) -> Column:
    """`<unit> <value> <technology> <name>` as `<name> <value> <unit>`; other lines as they are."""
    pattern = f"(?i)^({P.UNIT})\\s+([-+]?\\d+(?:\\.\\d+)?)\\s+{P.TECHNOLOGY}\\s+(.+)$"
    t = strip(c)
    name = strip(F.regexp_extract(t, pattern, 3))
    return F.when(matches(t, pattern) & (F.length(name) >= 2), F.concat_ws(" ", name, F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 1))).otherwise(c)


def stitch(name: Column, value: Column, unit: Column, span: Column) -> Column:
    return collapse(F.concat_ws(" ", name, value, unit, span))


def canonical_unit(c: Column, units: dict[str, str] | None = None) -> Column:
    t = strip(c)
    return F.coalesce(F.element_at(lit_map(units or P.UNITS), F.upper(t)), t)


def parse_range(c: Column) -> Column:
    """(low, high, text) of a reference range."""
    t = strip(c)
    both, one = f"^{P.SPAN}$", f"^{P.COMPARISON}$"
    number = lambda g, p: F.regexp_extract(t, p, g).try_cast("double")
    sign = F.regexp_extract(t, one, 1)
    low = F.when(matches(t, both), number(1, both)).when(sign.isin(">", ">=", "≥"), number(2, one))
    high = F.when(matches(t, both), number(2, both)).when(sign.isin("<", "<=", "≤"), number(2, one))
    return F.when(F.length(t) > 0, F.struct(low.alias("low"), high.alias("high"), t.alias("text")))


def clean_name(c: Column) -> Column:
    """A name without what an assay leaked into it, without labels and descriptors in front and descriptors behind."""
    longest = lambda words: tuple(sorted(words, key=len, reverse=True))
    own, heads = (escaped(longest(w)).replace(" ", "\\s+") for w in (P.DESCRIPTORS, (*P.COLUMN_LABELS, *P.DESCRIPTORS)))
    c = collapse(c)
    leak = F.regexp_extract(c, f"(?i)^(.+?(?:\\s|\\())(?:{own})\\b", 1)
    c = F.when(F.length(leak) > 0, F.regexp_replace(leak, "[\\s(]+$", "")).otherwise(c)
    for _ in range(2):
        c = F.regexp_replace(c, f"(?i)^(?:{heads}(?:\\s+|$))+", "")
        c = F.regexp_replace(c, f"(?i)(?:(?:^|\\s+){own})+$", "")
    return strip(F.regexp_replace(c, "\\s*[<>]\\s*$", ""))


def iso_date(c: Column) -> Column:
    """A day-first date, or one with a month's name, as a date; null if there is no such day."""
    tail = "(?:,?\\s+.*)?$"
    forms = (("^\\s*(\\d{1,2})/(\\d{1,2})/(\\d{4})" + tail, 1, 2, 3), ("^\\s*(\\d{1,2})-(\\d{1,2})-(\\d{4})" + tail, 1, 2, 3), ("^\\s*(\\d{1,2})\\s+([A-Za-z]{3,}),?\\s+(\\d{4})" + tail, 1, 2, 3), ("^\\s*(\\d{1,2})/([A-Za-z]{3,})/(\\d{4})" + tail, 1, 2, 3), ("^\\s*([A-Za-z]{3,})\\s+(\\d{1,2}),?\\s+(\\d{4})" + tail, 2, 1, 3))
    months = F.create_map(*(F.lit(x) for k, v in P.MONTHS.items() for x in (k, str(v))))
    found = []
    for pattern, d, m, y in forms:
        month = F.regexp_extract(c, pattern, m)
        month = F.coalesce(F.when(matches(month, "^\\d+$"), month), F.element_at(months, F.lower(month)))
        found.append(F.when(matches(c, pattern), F.try_to_date(F.concat_ws("-", F.regexp_extract(c, pattern, y), F.lpad(month, 2, "0"), F.lpad(F.regexp_extract(c, pattern, d), 2, "0")), "yyyy-MM-dd")))
    return F.coalesce(*found)


def name_and_age(c: Column) -> Column:
    """(name, age, gender) of `Name (30Y/F)`."""
    note = "\\((\\d+)Y/([A-Za-z])\\)\\s*$"
    gender = F.upper(F.regexp_extract(c, note, 2))
    return F.struct(strip(F.regexp_replace(c, note, "")).alias("name"), F.regexp_extract(c, note, 1).try_cast("int").alias("age"), F.when(gender.isin("M", "F", "O"), gender).alias("gender"))


def scrub(c: Column, values: Column) -> Column:
    """The text without each value of at least three characters, the longest first."""
    longest = F.array_sort(F.array_distinct(F.filter(values, lambda v: F.length(v) >= 3)), lambda a, b: F.length(b) - F.length(a))
    return collapse(F.aggregate(longest, c, lambda text, v: F.replace(text, v, F.lit(""))))


def title_case(c: Column) -> Column:
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    return F.array_join(F.transform(F.split(F.lower(c), "\\s+"), lambda w, i: F.when((i > 0) & w.isin(*P.SMALL_WORDS), w).otherwise(cap(w))), " ")


def ontology_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "\\s*\\(", " ("), "\\s+", " ")


def numeric_prefix(c: Column) -> Column:
    """The number a text begins with, as a double."""
    return F.regexp_extract(c, "^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)", 1).try_cast("double")


def two_decimals(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.format_number(c, 2), F.lit(","), F.lit("")), "\\.?0+$", "")


def display_range(low: Column, high: Column, text: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(two_decimals(low), F.lit(" – "), two_decimals(high))).when(high.isNotNull(), F.concat(F.lit("up to "), two_decimals(high))).when(low.isNotNull(), F.concat(two_decimals(low), F.lit(" or above"))).when(F.length(strip(text)) > 0, strip(text))


def interpretation(severity: Column, low: Column, high: Column, text: Column, unit: Column) -> Column:
    base = F.element_at(lit_map(P.MEANINGS), severity)
    shown = display_range(low, high, text)
    tail = F.when(F.length(strip(unit)) > 0, F.concat(F.lit(" "), strip(unit))).otherwise("")
    skipped = F.when(low.isNull() & high.isNull() & text.isNull(), F.lit("Unable to interpret — reference range not available")).otherwise("Non-numeric result — manual review recommended")
    return F.when(severity == "skipped", skipped).when(shown.isNotNull(), F.concat(base, F.lit(" (ref: "), shown, tail, F.lit(")"))).otherwise(base)


def pdf_text(c: Column) -> Column:
    c = F.translate(c, "–—−µμ‘’“”", "---uu''\"\"")
    return F.replace(c, F.lit("10^6"), F.lit("10⁶"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def size_text(bytes_: Column) -> Column:
    """A file's size as a reader wants it."""
    shown = lambda n, digits, unit: F.concat(F.replace(F.format_number(bytes_ / n, digits), F.lit(","), F.lit("")), F.lit(unit))
    return F.when(bytes_ < 1024, F.concat(bytes_.cast("string"), F.lit(" B"))).when(bytes_ < 1 << 20, shown(1 << 10, 1, " KB")).otherwise(shown(1 << 20, 2, " MB"))


def without_heads(c: Column) -> Column:
    """A row of a page without the heads of columns in front of it."""
    t = strip(c)
    return F.when(matches(t, P.COLUMN_HEAD), strip(F.regexp_replace(t, P.COLUMN_HEADS, ""))).otherwise(t)


def leading_name(c: Column) -> Column:
    return strip(F.regexp_extract(c, "^([^\\d<>≤≥]+)", 1))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def all_tokens_in(needle: Column, haystack: Column) -> Column:
    hay = F.lower(haystack)
    return F.forall(tokens(F.lower(needle)), lambda t: hay.contains(t))
