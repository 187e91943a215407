"""Positioned text items to rows, blocks, tables and candidate lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labflow.functions import patterns as P
from labflow.functions import text as T

#: Units on a page: items of one row, a gap that parts blocks, one that parts columns, and the reach of a column.
ROW, BLOCK_GAP, COLUMN_GAP, REACH, EDGE_ROWS, EDGE_STEP = 4.0, 14.0, 18.0, 80.0, 4, 15.0


def rows(items: DataFrame) -> DataFrame:
    """items (doc_id, page, item_id, x, y, width, height, text) with row_ix.

    From top to bottom, an item belongs to the row whose first item is at most
    ROW above it. That anchor moves only where a row begins, so a page's
    distinct heights are walked in order; a page, not a document, is the unit.
    """
    heights = items.select("doc_id", "page", "y").distinct()
    step = F.aggregate(
        F.reverse(F.array_sort(F.collect_list("y"))),
        F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<struct<y:double,row:int>>").alias("out")),
        lambda a, y: F.when(
            a.anchor.isNotNull() & (F.abs(a.anchor - y) <= ROW),
            F.struct(a.anchor.alias("anchor"), a.row.alias("row"), F.concat(a.out, F.array(F.struct(y.alias("y"), a.row.alias("row")))).alias("out")),
        ).otherwise(F.struct(y.alias("anchor"), (a.row + 1).alias("row"), F.concat(a.out, F.array(F.struct(y.alias("y"), (a.row + 1).alias("row")))).alias("out"))),
    )
    found = heights.groupBy("doc_id", "page").agg(step.alias("s")).select("doc_id", "page", F.explode("s.out").alias("o")).select("doc_id", "page", F.col("o.y").alias("y"), F.col("o.row").alias("row_ix"))
    return items.join(found, ["doc_id", "page", "y"])


def row_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, row_ix, text, y, x_start, x_end, n_items): a line for each row, a blank where a gap is over a third of the height."""
    own = Window.partitionBy("doc_id", "page", "row_ix").orderBy("x", "item_id")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(own)
    blank = F.when(F.coalesce(gap > 0.33 * (F.col("height") + F.lag("height").over(own)) / 2, F.lit(False)), " ").otherwise("")
    r = items.withColumn("piece", F.concat(blank, F.col("text")))
    item = F.array_sort(F.collect_list(F.struct("x", "item_id", "piece", "y")))
    out = r.groupBy("doc_id", "page", "row_ix").agg(item.alias("i"), F.min("x").alias("x_start"), F.max(F.col("x") + F.col("width")).alias("x_end"))
    return out.select("doc_id", "page", "row_ix", F.array_join(F.col("i.piece"), "").alias("text"), F.get(F.col("i.y"), F.floor(F.size("i") / 2).cast("int")).alias("y"), "x_start", "x_end", F.size("i").alias("n_items"))


def is_title(c: Column) -> Column:
    t = T.strip(c)
    return (F.length(t) <= 70) & t.rlike(P.TITLE) & ~t.rlike("\\d") & ~t.rlike(P.TITLE_UNIT)


def is_boilerplate(c: Column) -> Column:
    return T.strip(c).rlike(P.BLOCK_BOILERPLATE)


def edges(lines: DataFrame) -> DataFrame:
    """lines with at_edge: texts of headers and footers, and rows that come at about the same height among the first four of two pages, or among the last four."""
    page = Window.partitionBy("doc_id", "page")
    step = F.floor(F.col("y") / EDGE_STEP + 0.5) * EDGE_STEP
    r = lines.withColumns({"_top": F.row_number().over(page.orderBy("row_ix")) <= EDGE_ROWS, "_low": F.row_number().over(page.orderBy(F.desc("row_ix"))) <= EDGE_ROWS, "_y": step, "_text": F.substring(T.collapse(F.lower("text")), 1, 60)})
    key = Window.partitionBy("doc_id", "_y", "_text")
    twice = lambda where: F.col(where) & F.coalesce(F.min(F.when(F.col(where), F.col("page"))).over(key) < F.max(F.when(F.col(where), F.col("page"))).over(key), F.lit(False))
    t = T.strip(F.col("text"))
    return r.withColumn("at_edge", twice("_top") | twice("_low") | t.rlike(P.PAGE_HEADERS) | t.rlike(P.PAGE_FOOTERS)).drop("_top", "_low", "_y", "_text")


def blocks(lines: DataFrame) -> DataFrame:
    """lines with block_ix: a new block at a page's end, a wide gap, a boilerplate line or a title."""
    own = Window.partitionBy("doc_id").orderBy("page", "row_ix")
    gap = F.abs(F.col("y") - F.lag("y").over(own)) > BLOCK_GAP
    new = F.lag("page").over(own).isNull() | (F.lag("page").over(own) != F.col("page")) | gap | is_title(F.col("text")) | is_boilerplate(F.col("text"))
    return lines.withColumn("block_ix", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(own) - 1)


def block_types(lines: DataFrame) -> DataFrame:
    """(doc_id, block_ix, type, page, n_rows, block_text): what kind of block the lines make, and their texts, line by line."""
    c = F.col("text")
    prose = (F.length(c) >= 60) & ~F.substring(c, 1, 20).rlike("\\d")
    texts = F.array_sort(F.collect_list(F.struct("page", "row_ix", "text")))
    agg = lines.groupBy("doc_id", "block_ix").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c.rlike(P.LAB_ROW)).alias("lab"), texts.alias("all"), F.max(prose).alias("prose"))
    first = T.strip(F.get("all", F.lit(0))["text"])
    kind = F.when(is_boilerplate(first), "boilerplate").when((F.col("n_rows") == 1) & is_title(first), "section_title").when((F.col("lab") >= 1) & (F.col("lab") >= 0.4 * F.col("n_rows")), "lab_table").when(F.col("prose"), "paragraph").when(first.rlike(P.BLOCK_METADATA), "metadata").otherwise("unknown")
    return agg.select("doc_id", "block_ix", kind.alias("type"), F.get("all", F.lit(0))["page"].alias("page"), "n_rows", F.array_join(F.transform("all", lambda x: x.text), "\n").alias("block_text"))


def width(items: DataFrame, *by: str) -> DataFrame:
    """(by, width): where the last item of each page, or block, ends."""
    by = by or ("doc_id", "page")
    return items.groupBy(*by).agg(F.max(F.col("x") + F.col("width")).alias("width"))


def column_bands(items: DataFrame, *by: str) -> DataFrame:
    """(by, band, x_min, x_max, n): where items begin, parted at gaps over COLUMN_GAP; blocks of one band have none."""
    by = by or ("doc_id", "block_ix")
    own = Window.partitionBy(*by).orderBy("x")
    new = F.coalesce(F.col("x") - F.lag("x").over(own) > COLUMN_GAP, F.lit(True)).cast("int")
    banded = items.withColumn("new", new).withColumn("band", F.sum("new").over(own) - 1)
    out = banded.groupBy(*by, "band").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("bands", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("bands >= 2").drop("bands")


def band_roles(items: DataFrame, bands: DataFrame, *by: str) -> DataFrame:
    """bands with role, by the first ten items within 5 of each: the first band holds names."""
    by = by or ("doc_id", "block_ix")
    near = items.join(bands, list(by)).where((F.col("x") >= F.col("x_min") - 5) & (F.col("x") <= F.col("x_max") + 5))
    some = near.withColumn("k", F.row_number().over(Window.partitionBy(*by, "band").orderBy("item_id"))).where("k <= 10")
    c = F.col("text")
    votes = some.groupBy(*by, "band").agg(F.count_if(T.is_flag(c)).alias("flag"), F.count_if(T.is_range(c)).alias("range"), F.count_if(T.is_unit(c)).alias("unit"), F.count_if(T.is_value(c)).alias("value"))
    role = F.when(F.col("band") == 0, "testName").when(F.col("flag") > 0, "flag").when(F.col("range") > 0, "referenceRange").when(F.col("unit") > 0, "unit").when(F.col("value") > 0, "value").otherwise("unknown")
    return bands.join(votes, [*by, "band"], "left").withColumn("role", role).select(*bands.columns, "role")


def nearest_band(items: DataFrame, bands: DataFrame, *by: str) -> DataFrame:
    """items with the band (and its role) nearest to x, at most REACH away, the first of equals; a block's bands travel as one array, so nothing is compared across blocks."""
    by = by or ("doc_id", "block_ix")
    extra = ["role"] if "role" in bands.columns else []
    arrays = bands.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("band", "x_min", "x_max", *extra))).alias("bands"))
    x = F.col("x")
    away = lambda b: F.greatest(b.x_min - x, x - b.x_max, F.lit(0.0))
    best = F.array_min(F.transform("bands", lambda b: F.struct(away(b).alias("away"), b.band.alias("band"), *(b[e].alias(e) for e in extra))))
    r = items.join(arrays, list(by), "left").withColumn("best", best)
    near = F.col("best.away") <= REACH
    out = r.withColumn("band", F.when(near, F.col("best.band")))
    if extra:
        out = out.withColumn("role", F.coalesce(F.when(near, F.col("best.role")), F.lit("unknown")))
    return out.drop("bands", "best")


def entry_groups(lines: DataFrame) -> DataFrame:
    """lines with entry_ix: a row that begins with a number and follows closely goes on the entry above."""
    own = Window.partitionBy("doc_id", "block_ix").orderBy("page", "row_ix")
    goes_on = T.strip(F.col("text")).rlike("^[\\d<>≤≥+\\-.±]") & (F.lag("page").over(own) == F.col("page")) & (F.abs(F.col("y") - F.lag("y").over(own)) <= BLOCK_GAP)
    return lines.withColumn("entry_ix", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(own) - 1)


def table_rows(items: DataFrame) -> DataFrame:
    """items (doc_id, block_ix, entry_ix, role, ...) as one row for each entry: test_name, value, unit, range_text, flag."""
    part = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("page", "row_ix", "x", "text")))), lambda s: s.text), " ")
    return items.groupBy("doc_id", "block_ix", "entry_ix").agg(part("testName").alias("test_name"), part("value").alias("value"), part("unit").alias("unit"), part("referenceRange").alias("range_text"), part("flag").alias("flag"))


def candidate_lines(tables: DataFrame) -> DataFrame:
    """(doc_id, block_ix, entry_ix, line) of `name value unit range flag`, without those that have neither name nor value."""
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    has = (F.length("test_name") > 0) | (F.length("value") > 0)
    return tables.where(has).select("doc_id", "block_ix", "entry_ix", F.concat_ws(" ", part("test_name"), part("value"), part("unit"), part("range_text"), part("flag")).alias("line"))


def without_edges(items: DataFrame, excluded: Column, *row: str) -> DataFrame:
    """Items of rows of which not every item is excluded."""
    row = row or ("doc_id", "page", "row_ix")
    every = F.min(excluded.cast("int")).over(Window.partitionBy(*row))
    return items.withColumn("_every", every).where("_every = 0").drop("_every")


def page_text(items: DataFrame) -> DataFrame:
    """(doc_id, page, text) of positioned items: their rows from top to bottom, items joined by a blank, empty rows left out."""
    own = rows(items).groupBy("doc_id", "page", "row_ix").agg(F.array_sort(F.collect_list(F.struct("x", "item_id", "text"))).alias("i"))
    lines = own.select("doc_id", "page", "row_ix", F.array_join(F.transform("i", lambda s: s.text), " ").alias("line")).where(F.length(T.strip(F.col("line"))) > 0)
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ix", "line"))), lambda s: s.line), "\n").alias("text"))


def to_lines(items: DataFrame) -> DataFrame:
    """(doc_id, line_ix, line) of positioned items: tables rebuilt by columns, other rows as they are, headers and footers gone."""
    placed = rows(items)
    lines = row_lines(placed)
    marked = placed.join(edges(lines).select("doc_id", "page", "row_ix", "at_edge"), ["doc_id", "page", "row_ix"])
    placed = without_edges(marked, F.col("at_edge")).drop("at_edge")
    lines = blocks(edges(lines).where("not at_edge"))
    kinds = block_types(lines).select("doc_id", "block_ix", "type")
    table = entry_groups(lines.join(kinds.where("type = 'lab_table'").select("doc_id", "block_ix"), ["doc_id", "block_ix"]))
    inside = placed.join(table.select("doc_id", "page", "row_ix", "block_ix", "entry_ix"), ["doc_id", "page", "row_ix"])
    bands = column_bands(inside)
    roles = nearest_band(inside, band_roles(inside, bands))
    built = candidate_lines(table_rows(roles)).join(bands.select("doc_id", "block_ix").distinct(), ["doc_id", "block_ix"])
    plain = lines.join(bands.select("doc_id", "block_ix").distinct(), ["doc_id", "block_ix"], "left_anti").join(kinds.where("type not in ('boilerplate', 'paragraph')"), ["doc_id", "block_ix"])
    line = F.when(F.col("type").isin("metadata", "unknown"), T.without_heads(F.col("text"))).otherwise(T.strip(F.col("text")))
    plain = plain.withColumn("line", line).where(F.length("line") > 0)
    both = built.select("doc_id", "block_ix", F.col("entry_ix").alias("k"), "line").unionByName(plain.select("doc_id", "block_ix", F.col("row_ix").alias("k"), "line"))
    return both.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("block_ix", "k", "line")) - 1).alias("line_ix"), "line")
