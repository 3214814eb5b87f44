"""Workbooks in long form: one row per cell, keyed by file, sheet, row and column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import cell_text, parse_cell_ref
from quire.operators.ranks import numbered

# Limits of grids, widths and pages.
MAX_GRID_COLUMNS, MAX_GRID_ROWS = 200, 5000
LEAST_WIDTH, MOST_WIDTH = 8, 50
FIRST_PAGE_ROWS, PAGE_ROWS = 54, 55
SHEET = ["file_id", "sheet_no"]


#: Rows that one task numbers at a time; what is known at the end of one lot is carried to the next.
LOT = 1 << 13


def _numbered_rows(rows: DataFrame) -> DataFrame:
    """rows(file_id, sheet_no, row_pos, row_no) -> row: numbers within lots of rows, and the last number known before each lot."""
    lots = rows.withColumn("_lot", F.floor(F.col("row_pos") / LOT))
    inside = Window.partitionBy(*SHEET, "_lot").orderBy("row_pos")
    held = inside.rowsBetween(Window.unboundedPreceding, 0)
    lots = lots.withColumn("_n", F.row_number().over(inside))
    lots = lots.withColumn("_set", F.last(F.when(F.col("row_no").isNotNull(), F.struct("row_no", "_n")), ignorenulls=True).over(held))
    ends = lots.groupBy(*SHEET, "_lot").agg(F.count("*").alias("_rows"), F.max_by("_set", "_n").alias("_end"))
    before = Window.partitionBy(*SHEET).orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    carried = F.last(F.when(F.col("_end").isNotNull(), F.struct(F.col("_end.row_no").alias("no"), (F.col("_before") + F.col("_end._n")).alias("n"))), ignorenulls=True).over(before)
    ends = ends.withColumn("_carried", carried).select(*SHEET, "_lot", "_before", "_carried")
    at = F.col("_before") + F.col("_n")
    row = F.coalesce(F.col("_set.row_no") - 1 + F.col("_n") - F.col("_set._n"), F.col("_carried.no") - 1 + at - F.col("_carried.n"), at - 1)
    return lots.join(ends, [*SHEET, "_lot"]).select(*SHEET, "row_pos", row.cast("int").alias("_row"))


def fill_positions(cells: DataFrame) -> DataFrame:
    """cells(file_id, sheet_no, pos, row_no, ref, ...) -> row and col: a cell without reference follows the one before.

    row_no is the row's own number or null; a row without one follows the row before it. row_pos orders
    the rows of a sheet, pos the cells. A sheet of any length is numbered in lots of rows.
    """
    at = parse_cell_ref(F.col("ref"))
    rows = _numbered_rows(cells.select(*SHEET, "row_pos", "row_no").distinct())
    out = cells.join(rows, [*SHEET, "row_pos"]).withColumn("_col", at["col"]).withColumn("_own", at["row"])
    c = Window.partitionBy(*SHEET, "row_pos").orderBy("pos")
    held = c.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_n", F.row_number().over(c)).withColumn("_set", F.last(F.when(F.col("_col").isNotNull(), F.struct("_col", "_n")), ignorenulls=True).over(held))
    col = F.coalesce(F.col("_set._col") + F.col("_n") - F.col("_set._n"), F.col("_n") - 1).cast("int")
    return out.withColumn("row", F.coalesce("_own", "_row")).withColumn("col", col).drop("_row", "_own", "_col", "_n", "_set")


def dedupe_cells(cells: DataFrame) -> DataFrame:
    """The last cell in document order wins its address."""
    w = Window.partitionBy(*SHEET, "row", "col").orderBy(F.desc("pos"))
    return cells.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def resolve_cells(cells: DataFrame, shared: DataFrame) -> DataFrame:
    """cells and text: shared strings looked up by (file_id, index); lost marks references without a string."""
    index = F.when(F.col("raw_type") == "s", F.col("raw_value").try_cast("int"))
    strings = shared.select("file_id", F.col("idx").alias("_idx"), F.col("text").alias("_string"))
    out = cells.withColumn("_idx", index).join(strings, ["file_id", "_idx"], "left")
    out = out.withColumn("text", cell_text(F.col("raw_type"), F.col("raw_value"), F.col("_string")))
    lost = (F.col("raw_type") == "s") & F.col("raw_value").isNotNull() & (F.col("text") == "")
    return out.withColumn("lost", F.coalesce(lost, F.lit(False))).drop("_idx", "_string")


def lost_strings(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("file_id").agg(F.count_if("lost").alias("lost"), F.count("*").alias("cells"))


def grid_bounds(cells: DataFrame) -> DataFrame:
    """First and last row and column per sheet, cut to 200 columns and 5000 rows; too_large marks what was cut."""
    b = cells.groupBy(*SHEET).agg(F.min("row").alias("top"), F.max("row").alias("_bottom"), F.min("col").alias("left"), F.max("col").alias("_right"))
    b = b.withColumn("bottom", F.least("_bottom", F.col("top") + MAX_GRID_ROWS - 1)).withColumn("right", F.least("_right", F.col("left") + MAX_GRID_COLUMNS - 1))
    return b.withColumn("too_large", (F.col("bottom") < F.col("_bottom")) | (F.col("right") < F.col("_right"))).drop("_bottom", "_right")


def column_widths(ranges: DataFrame, bounds: DataFrame) -> DataFrame:
    """ranges(file_id, sheet_no, ord, min, max, width) -> (file_id, sheet_no, col, points) of the columns in bounds.

    A range covers 200 columns at most; of ranges that overlap the later holds. Points are 7 a unit and 5, within 20 and 400.
    """
    col = F.explode(F.sequence(F.col("min") - 1, F.least("max", F.col("min") + 200) - 1)).alias("col")
    each = ranges.filter("max >= min").select(*SHEET, "ord", "width", col)
    points = F.least(F.greatest(F.col("width") * 7 + 5, F.lit(20.0)), F.lit(400.0))
    inside = each.join(bounds.select(*SHEET, "left", "right"), SHEET).filter("col between left and right")
    return inside.groupBy(*SHEET, "col").agg(F.max_by(points, "ord").alias("points"))


def grid_rows(cells: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """cells(…, row, col, text) -> dense rows: (file_id, sheet_no, row, cells), rows and columns from 0, gaps are empty text.

    Without given bounds a sheet's are those of grid_bounds, taken from its rows: cells are read once, and
    each row fills the gap up to the next.
    """
    filled = cells.groupBy(*SHEET, "row").agg(F.collect_list(F.struct("col", "text")).alias("found"), F.min("col").alias("_left"), F.max("col").alias("_right"))
    if bounds is None:
        sheet = Window.partitionBy(*SHEET)
        rows = filled.withColumns({"top": F.min("row").over(sheet), "_last": F.max("row").over(sheet), "left": F.min("_left").over(sheet), "_most": F.max("_right").over(sheet), "_next": F.lead("row").over(sheet.orderBy("row"))})
        rows = rows.withColumn("bottom", F.least("_last", F.col("top") + MAX_GRID_ROWS - 1)).withColumn("right", F.least("_most", F.col("left") + MAX_GRID_COLUMNS - 1)).filter("row <= bottom")
        upto = F.least(F.coalesce(F.col("_next") - 1, F.col("row")), F.col("bottom"))
        out = rows.withColumn("_at", F.explode(F.sequence("row", upto))).withColumn("found", F.when(F.col("_at") == F.col("row"), F.col("found"))).withColumn("row", F.col("_at"))
    else:
        rows = bounds.select(*SHEET, "top", "left", "right", F.explode(F.sequence("top", "bottom")).alias("row"))
        out = rows.join(filled, [*SHEET, "row"], "left")
    found = F.map_from_entries("found")
    values = F.transform(F.sequence("left", "right"), lambda c: F.coalesce(F.try_element_at(found, c), F.lit("")))
    return out.select(*SHEET, (F.col("row") - F.col("top")).alias("row"), values.alias("cells"))


def output_widths(grid: DataFrame) -> DataFrame:
    """Width of each column: its longest value and 2, within 8 and 50."""
    each = grid.select(*SHEET, F.posexplode("cells").alias("col", "text"))
    return each.groupBy(*SHEET, "col").agg(F.least(F.greatest(F.max(F.length("text")) + 2, F.lit(LEAST_WIDTH)), F.lit(MOST_WIDTH)).alias("width"))


def shared_strings(cells: DataFrame) -> DataFrame:
    """cells(file_id, sheet_no, pos, text) -> each file's distinct strings in first-use order, with references.

    Counted per string first, so that only distinct strings are numbered; those of one giant workbook are
    numbered by ranges.
    """
    found = cells.filter("text != ''").groupBy("file_id", "text").agg(F.min(F.struct("sheet_no", "pos")).alias("_first"), F.count("*").alias("refs"))
    return numbered(found, ["file_id"], ["_first", "text"], "idx").drop("_first")


def dictionary_totals(strings: DataFrame) -> DataFrame:
    return strings.groupBy("file_id").agg(F.sum("refs").alias("refs"), F.count("*").alias("unique"))


def _named(book: pd.DataFrame) -> pd.DataFrame:
    book = book.sort_values("sheet_no")
    used, names = set(), []
    for bare in book["bare"]:
        name, n = bare, 2
        while name.lower() in used:
            tail = f" ({n})"
            name, n = bare[: 31 - len(tail)] + tail, n + 1
        used.add(name.lower())
        names.append(name)
    return book.assign(name=names)[["file_id", "sheet_no", "name"]]


def sheet_names(sheets: DataFrame) -> DataFrame:
    """sheets(file_id, sheet_no, name) -> names that a workbook may hold: 31 characters, none of : \\ / ? * [ ], no two alike but for case."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("name", F.lit("")), r"[:\\/?*\[\]\x00-\x1F]", " "), r"\s+", " "))
    clean = F.when(clean.startswith("'") | clean.endswith("'"), F.replace(clean, F.lit("'"), F.lit(""))).otherwise(clean)
    bare = F.when(clean == "", F.concat(F.lit("Sheet"), (F.col("sheet_no") + 1).cast("string"))).otherwise(F.substring(clean, 1, 31))
    slim = sheets.select(F.col("file_id").cast("string").alias("file_id"), F.col("sheet_no").cast("int").alias("sheet_no"), bare.alias("bare"))
    return slim.groupBy("file_id").applyInPandas(_named, "file_id string, sheet_no int, name string")


def paginate_sheet(grid: DataFrame) -> DataFrame:
    """Dense rows -> (…, page, line, row, cells): row 0 heads every page; the first page is a row shorter."""
    body = grid.filter("row > 0").withColumn("_n", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row")) - 1)
    first = FIRST_PAGE_ROWS - 1
    page = F.when(F.col("_n") < first, 0).otherwise(F.floor((F.col("_n") - first) / (PAGE_ROWS - 1)) + 1).cast("int")
    line = F.when(F.col("_n") < first, F.col("_n") + 1).otherwise((F.col("_n") - first) % (PAGE_ROWS - 1) + 1).cast("int")
    body = body.select(*SHEET, page.alias("page"), line.alias("line"), "row", "cells")
    pages = grid.select(*SHEET).distinct().join(body.groupBy(*SHEET).agg(F.max("page").alias("last")), SHEET, "left")
    pages = pages.select(*SHEET, F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("page"))
    heads = grid.filter("row = 0").join(pages, SHEET).select(*SHEET, "page", F.lit(0).alias("line"), "row", "cells")
    return heads.unionByName(body)
