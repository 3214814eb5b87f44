"""Lines, cells, tables, headings and paragraphs from positioned runs of text.

A page is the largest that any step gathers: a row with its runs from the top as an array, as readers of
PDF hand it back. All that is made of it up to its blocks is expressions on that array, so that no row, sort
or window is needed for a word or a line. Rules that depend on their own decisions (lines go by a running
mean, paragraphs by the first indent) are folds; a page whose lines stand clearly apart needs none for them.
Rows of runs are gathered by their page in one exchange, and in none where the caller's rows lie by document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.arrays import let, median, parts, places

# Fixed values of the layout rules.
LINE_TOLERANCE = 2.0
HEADING_RATIO = 1.15
HEADING_BANDS = (1.35, 1.6, 1.9, 2.3, 2.8)
MAX_HEADING_WORDS = 20
MIN_CELL_GAP = 8.0
MAX_CELL_WORDS = 6
PARAGRAPH_GAP = 1.5
INDENT = 0.8
LONE_WORD = 25
NEARLY_EMPTY = 24
SENTENCE_END = r'[.!?:;]["\)\]]?$'

#: Distance from LINE_TOLERANCE beyond which no rounding of a mean can matter, and the largest place for which that holds.
CLEARLY, FARTHEST = 0.001, 1e6

PAGE = ["doc_id", "page_no"]
#: White space that is not one plain space already; a text without any is left as it is.
SPACES = r"(?U) \s+|[\s&&[^ ]]\s*"


def _shows(text: Column) -> Column:
    """Whether there is more than white space; a visible first letter tells without a pattern."""
    return F.ascii(text).between(33, 126) | text.rlike(r"(?U)\S")


def _run(item: Callable[[str], Column]) -> dict[str, Column]:
    """What a run keeps of an item: bad coordinates are 0, bad sizes 0."""

    def finite(x: Column) -> Column:
        return F.when(F.abs(x) < float("inf"), x).otherwise(0.0)  # neither of null nor of NaN

    def positive(x: Column) -> Column:
        return F.greatest(finite(x), F.lit(0.0))

    place = item("transform")
    return {"text": F.coalesce(item("str"), F.lit("")), "x": finite(F.get(place, F.lit(4))), "y": finite(F.get(place, F.lit(5))), "width": positive(item("width")), "height": positive(item("height"))}


def text_runs(text_items: DataFrame) -> DataFrame:
    """Clean runs: bad coordinates are 0, bad sizes 0, runs of white space only are dropped."""
    out = text_items.select(*PAGE, "item_no", *(c.alias(name) for name, c in _run(F.col).items()))
    return out.filter(_shows(F.col("text")))


def _ordered(run: dict[str, Column], item_no: Column) -> Column:
    """A run as it stands in a page's array, which sorts from the top and the left."""
    return F.struct((-run["y"]).alias("down"), run["x"].alias("x"), item_no.cast("int").alias("item_no"), run["text"].alias("text"), run["width"].alias("width"), run["height"].alias("height"))


def _typed(pages: DataFrame, runs: Column) -> DataFrame:
    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), runs.alias("runs"))


def page_runs(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_no, items) -> (doc_id, page_no, runs): each page's clean runs in order.

    No filter stands behind this or what follows, and no array is exploded that is a column: what they ask for
    would be made a second time below, and inside a lambda once an element.
    """
    made = F.transform("items", lambda i: _ordered(_run(lambda c: i[c]), i["item_no"]))
    return _typed(pages, F.sort_array(F.filter(made, lambda r: _shows(r["text"]))))


def gathered_runs(runs: DataFrame) -> DataFrame:
    """Rows of text_runs -> the rows of page_runs."""
    own = {c: F.col(c) for c in ("text", "x", "y", "width", "height")}
    return _typed(runs.groupBy(*PAGE).agg(F.sort_array(F.collect_list(_ordered(own, F.col("item_no")))).alias("runs")), F.col("runs"))


def reading_order(runs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Pages in order, each in its own; in so many tasks, if told."""
    return runs.repartition(*([tasks] if tasks else []), *PAGE).sortWithinPartitions(*PAGE, F.desc("y"), "x", "item_no")


def item_boxes(text_items: DataFrame, pages: DataFrame) -> DataFrame:
    """Box of each item: sizes of 0 count as missing."""

    def or_else(x: Column, y: Column) -> Column:
        return F.when(F.coalesce(x, F.lit(0.0)) != 0, x).otherwise(y)

    t = [F.get("transform", F.lit(i)) for i in range(6)]
    size = or_else(F.hypot(t[2], t[3]), or_else(F.abs(t[0]), F.lit(10.0)))
    out = text_items.join(pages.select(*PAGE, F.col("height").alias("page_height")), PAGE).withColumn("size", size)
    width = or_else(F.col("width"), F.col("size") * 0.5 * F.length("str"))
    return out.select(*PAGE, "item_no", "size", t[4].alias("left"), (F.col("page_height") - t[5] - F.col("size") * 0.9).alias("top"), width.alias("width"), (F.col("size") * 1.25).alias("height"))


def _folded_line_starts(runs: Column) -> Column:
    """The places of _line_starts by a fold over all runs, for pages on which a mean may decide."""

    def take(s: Column, run: Column) -> Column:
        y, at = -run["down"], s["at"] + 1
        stays = F.struct((s["total"] + y).alias("total"), (s["n"] + 1).alias("n"), at.alias("at"), s["starts"].alias("starts"))
        begins = F.struct(y.alias("total"), F.lit(1).alias("n"), at.alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))
        return F.when((s["n"] > 0) & (s["total"] / s["n"] - y <= LINE_TOLERANCE), stays).otherwise(begins)

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(runs, start, take, lambda s: s["starts"])


def _line_starts(runs: Column) -> Column:
    """Places where lines begin among a page's runs from the top: a run joins the open line while it is at most 2 below the line's mean.

    The mean is no lower than the last run and no higher than the first. So the runs' gaps alone tell, if each is
    clearly too wide, or its line not high enough to matter.
    """

    def told(down: Column) -> Column:
        def clear(starts: Column) -> Column:
            def line(s: Column, i: Column) -> Column:
                end = F.coalesce(F.get(starts, i + 1), F.size(down)) - 1
                apart = F.coalesce(F.get(down, end + 1) - F.get(down, end) > LINE_TOLERANCE + CLEARLY, F.lit(True))
                return apart & (F.get(down, end) - F.get(down, s) < LINE_TOLERANCE - CLEARLY)

            in_reach = (F.abs(F.get(down, F.lit(0))) < FARTHEST) & (F.abs(F.get(down, F.size(down) - 1)) < FARTHEST)
            return F.when(in_reach & F.forall(F.transform(starts, line), lambda x: x), starts).otherwise(_folded_line_starts(runs))

        return let(places(down, lambda i: (i == 0) | (F.get(down, i) - F.get(down, i - 1) > LINE_TOLERANCE)), clear)

    return let(F.transform(runs, lambda r: r["down"]), told)


def _line_runs(runs: Column) -> Column:
    """A page's runs -> its lines' runs."""
    return let(_line_starts(runs), lambda starts: parts(runs, starts))


def assign_lines(runs: DataFrame) -> DataFrame:
    """runs and line_no: from the top, a run joins the open line while it is at most 2 below the line's mean."""
    each = gathered_runs(runs).select(*PAGE, F.posexplode(_line_runs(F.col("runs"))).alias("line_no", "runs")).select(*PAGE, "line_no", F.explode("runs").alias("r"))
    return each.select(*PAGE, "r.item_no", "r.text", "r.x", (-F.col("r.down")).alias("y"), "r.width", "r.height", "line_no")


def _space(runs: Column) -> Column:
    """Width of a character on the page: the exact median over its runs."""
    return F.coalesce(median(F.transform(runs, lambda r: F.when(r["width"] > 0, r["width"] / F.length(r["text"])))), F.lit(0.0))


def _line(runs: Column, line_no: Column, space: Column) -> Column:
    """A line's runs -> its number, y, size, left, text and cells."""

    def joined(pieces: Column) -> Column:
        return F.trim(F.regexp_replace(F.array_join(pieces, ""), SPACES, " "))

    def made(along: Column, gaps: Column) -> Column:
        pieces = F.zip_with(along, gaps, lambda r, gap: F.when((gap >= space * 0.5) & (gap > 0), F.concat(F.lit(" "), r["text"])).otherwise(r["text"]))
        starts = places(gaps, lambda i: (i == 0) | (F.get(gaps, i) > F.greatest(F.lit(MIN_CELL_GAP), space * 2)))

        def cells(pieces: Column, starts: Column, text: Column) -> Column:
            return F.when(F.size(starts) == 1, F.array(text)).otherwise(F.filter(F.transform(parts(pieces, starts), joined), lambda c: c != ""))

        def line(pieces: Column, text: Column) -> Column:
            return F.struct(
                line_no.alias("line_no"), (F.aggregate(along, F.lit(0.0), lambda total, r: total - r["down"]) / F.size(along)).alias("y"), F.array_max(F.transform(along, lambda r: r["height"])).alias("size"),
                F.get(along, F.lit(0))["x"].alias("left"), text.alias("text"), let(starts, lambda at: cells(pieces, at, text)).alias("cells"),
            )

        return let(pieces, lambda p: let(joined(p), lambda text: line(p, text)))

    def gap(along: Column) -> Column:
        return F.transform(along, lambda r, i: F.when(i > 0, let(F.get(along, i - 1), lambda before: r["x"] - (before["x"] + before["width"]))))

    along = F.sort_array(F.transform(runs, lambda r: F.struct(r["x"], r["down"], r["item_no"], r["text"], r["width"], r["height"])))
    return let(along, lambda a: let(gap(a), lambda g: made(a, g)))


def _parted(pages: DataFrame) -> DataFrame:
    """Rows of page_runs -> (doc_id, page_no, space, parts): the runs of each page's lines."""
    return pages.select(*PAGE, _space(F.col("runs")).alias("space"), _line_runs(F.col("runs")).alias("parts"))


def _lines() -> Column:
    """The lines of a row of _parted, from the top."""
    return F.transform("parts", lambda part, i: _line(part, i, F.col("space")))


def line_cells(runs: DataFrame) -> DataFrame:
    """runs with line_no -> one row per line: y, size, left, text and cells.

    A gap of half a character is a space; one over 8 and two characters starts a new cell.
    """
    each = F.when(F.col("width") > 0, F.col("width") / F.length("text"))
    r = runs.withColumn("space", F.coalesce(F.median(each).over(Window.partitionBy(*PAGE)), F.lit(0.0)))
    run = F.struct((-F.col("y")).alias("down"), "x", "item_no", "text", "width", "height")
    lines = r.groupBy(*PAGE, "line_no").agg(F.first("space").alias("space"), F.collect_list(run).alias("runs")).filter(F.exists("runs", lambda r: _shows(r["text"])))
    return lines.select(*PAGE, _line(F.col("runs"), F.col("line_no"), F.col("space")).alias("l")).select(*PAGE, "l.*")


def text_lines(pages: DataFrame) -> DataFrame:
    """Rows of page_runs -> the rows of line_cells, and space."""
    return _parted(pages).select(*PAGE, "space", F.explode(_lines()).alias("l")).select(*PAGE, "l.*", "space")


def _words(text: Column) -> Column:
    """Words of a line's text or cell, whose white space is single spaces."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def is_row(cells: Column) -> Column:
    """A line that may be a table's row: several cells of at most six words."""
    return (F.size(cells) > 1) & F.forall(cells, lambda c: _words(c) <= MAX_CELL_WORDS)


def heading_level(ratio: Column) -> Column:
    return sum(((ratio >= band).cast("int") for band in HEADING_BANDS), F.lit(1))


def _kind(row: Column, table: Column, body: Column, size: Column, text: Column) -> Column:
    """Kind of a line that may be a table's row, stands in a table, on a page with that body size."""
    heading = ~row & (body > 0) & (size >= body * HEADING_RATIO) & (_words(text) <= MAX_HEADING_WORDS)
    return F.when(table, "table").when(heading, "heading").otherwise("body")


def _level(kind: Column, size: Column, body: Column) -> Column:
    return F.when(kind == "heading", heading_level(size / body))


def classify_lines(lines: DataFrame) -> DataFrame:
    """lines and kind (table, heading, body), level, table_no and the page's body size.

    Tables are runs of two candidate rows or more with nothing in between; a lone candidate is body text,
    never a heading.
    """
    page = Window.partitionBy(*PAGE)
    order = page.orderBy("line_no")
    out = lines.withColumn("body", F.median("size").over(page)).withColumn("row", is_row(F.col("cells")))
    out = out.withColumn("_n", F.row_number().over(order))
    out = out.withColumn("_island", F.col("_n") - F.row_number().over(Window.partitionBy(*PAGE, "row").orderBy("line_no")))
    island = Window.partitionBy(*PAGE, "row", "_island")
    out = out.withColumn("kind", _kind(F.col("row"), F.col("row") & (F.count("*").over(island) > 1), F.col("body"), F.col("size"), F.col("text")))
    out = out.withColumn("level", _level(F.col("kind"), F.col("size"), F.col("body")))
    out = out.withColumn("table_no", F.when(F.col("kind") == "table", F.min("line_no").over(island)))
    return out.drop("_n", "_island", "row")


def _classified(lines: Column) -> Column:
    """A page's lines, with kind, level and the page's body size, by the rules of classify_lines."""

    def told(body: Column, rows: Column) -> Column:
        def line(l: Column, i: Column) -> Column:
            row = F.get(rows, i)
            table = row & (F.coalesce(F.get(rows, F.when(i > 0, i - 1)), F.lit(False)) | F.coalesce(F.get(rows, i + 1), F.lit(False)))
            return let(_kind(row, table, body, l["size"], l["text"]), lambda kind: F.struct(*(l[c].alias(c) for c in ("y", "left", "text", "cells")), kind.alias("kind"), _level(kind, l["size"], body).alias("level"), body.alias("body")))

        return F.transform(lines, line)

    return let(median(F.transform(lines, lambda l: l["size"])), lambda body: let(F.transform(lines, lambda l: is_row(l["cells"])), lambda rows: told(body, rows)))


def _paragraphs(lines: Column) -> Column:
    """A number for each of a page's classified lines: that of its paragraph, -1 for others.

    A paragraph is broken by a wide gap (the page's first gap is the measure), an ended sentence or another indent than the first line's.
    """

    def told(l: Column, i: Column) -> Column:
        def behind(before: Column) -> Column:
            after = (l["kind"] == "body") & F.coalesce(before["kind"] == "body", F.lit(False))
            ended = F.when(after, F.coalesce(before["text"].rlike(SENTENCE_END), F.lit(False))).otherwise(False)
            return F.struct((l["kind"] == "body").alias("is_body"), after.alias("after"), F.when(after, before["y"] - l["y"]).otherwise(0.0).alias("gap"), ended.alias("ended"), l["left"].alias("left"), l["body"].alias("body"))

        return let(F.get(lines, F.when(i > 0, i - 1)), behind)

    def take(s: Column, l: Column) -> Column:
        def next_(spacing: Column) -> Column:
            wide = (spacing > 0) & (l["gap"] > spacing * PARAGRAPH_GAP) & (l["gap"] > l["body"] * 1.25)
            stays = F.coalesce(l["after"] & ~l["ended"] & ~wide & (F.abs(l["left"] - s["first"]) <= l["body"] * INDENT), F.lit(False))
            return let(F.when(stays | ~l["is_body"], s["last"]).otherwise(s["last"] + 1), lambda last: F.struct(spacing.alias("spacing"), F.when(stays, s["first"]).otherwise(l["left"]).alias("first"), last.alias("last"), F.concat(s["out"], F.array(F.when(l["is_body"], last).otherwise(-1))).alias("out")))

        return let(F.when((s["spacing"] == 0) & (l["gap"] > 0), l["gap"]).otherwise(s["spacing"]), next_)

    start = F.struct(F.lit(0.0).alias("spacing"), F.lit(None).cast("double").alias("first"), F.lit(-1).alias("last"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.transform(lines, told), start, take, lambda s: s["out"])


def assign_paragraphs(lines: DataFrame) -> DataFrame:
    """classified lines and paragraph (-1 for others): broken by a wide gap, an ended sentence or another indent than the first line's."""
    rest = [c for c in lines.columns if c not in (*PAGE, "line_no")]
    pages = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line_no", F.struct(*rest).alias("rest")))).alias("lines"))
    paragraphs = let(_paragraphs(F.transform("lines", lambda l: l["rest"])), lambda p: F.transform("lines", lambda l, i: F.struct(l.alias("l"), F.get(p, i).alias("paragraph"))))
    return pages.select(*PAGE, F.explode(paragraphs).alias("x")).select(*PAGE, "x.l.line_no", "x.l.rest.*", "x.paragraph").select(*lines.columns, "paragraph")


def _blocks(lines: Column, paragraphs: Column) -> Column:
    """A page's classified lines, and the numbers of their paragraphs -> its blocks in order: type, level, text and rows."""

    def block(p: Column) -> Column:
        def padded(widest: Column) -> Column:
            return F.transform(p, lambda l: F.concat(l["cells"], F.array_repeat(F.lit(""), widest - F.size(l["cells"]))))

        kind = F.get(p, F.lit(0))["kind"]
        rows = F.when(kind == "table", let(F.array_max(F.transform(p, lambda l: F.size(l["cells"]))), padded))
        text = F.when(kind != "table", F.array_join(F.transform(p, lambda l: l["text"]), " "))
        return F.struct(F.when(kind == "body", "paragraph").otherwise(kind).alias("type"), F.get(p, F.lit(0))["level"].alias("level"), text.alias("text"), rows.alias("rows"))

    def begins(i: Column) -> Column:
        kind, before = F.get(lines, i)["kind"], F.get(lines, F.when(i > 0, i - 1))["kind"]
        return F.when(kind == "body", (i == 0) | (F.get(paragraphs, i) != F.get(paragraphs, F.greatest(i - 1, F.lit(0))))).otherwise((kind == "heading") | F.coalesce(before != "table", F.lit(True)))

    return let(places(lines, begins), lambda at: F.transform(parts(lines, at), block))


def _lone_words_joined(blocks: Column) -> Column:
    """A paragraph of one short word joins the paragraph before it on its page; elsewhere it stays."""

    def stands(i: Column) -> Column:
        own = F.get(blocks, i)
        lone = (own["type"] == "paragraph") & (F.length(own["text"]) < LONE_WORD) & ~F.contains(own["text"], F.lit(" "))
        return ~F.coalesce(lone & (F.get(blocks, F.when(i > 0, i - 1))["type"] == "paragraph"), F.lit(False))

    def block(p: Column) -> Column:
        first = F.get(p, F.lit(0))
        text = F.when(first["type"] != "table", F.array_join(F.transform(p, lambda b: b["text"]), " "))
        return F.struct(first["type"].alias("type"), first["level"].alias("level"), text.alias("text"), first["rows"].alias("rows"))

    return let(places(blocks, stands), lambda at: F.when(F.size(at) == F.size(blocks), blocks).otherwise(F.transform(parts(blocks, at), block)))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Rows of page_runs -> blocks of every page in order: (doc_id, page_no, block_no, type, level, text, rows)."""
    lines = _parted(pages).select(*PAGE, _lines().alias("lines")).select(*PAGE, _classified(F.col("lines")).alias("lines"))
    blocks = lines.withColumn("paragraphs", _paragraphs(F.col("lines"))).select(*PAGE, _blocks(F.col("lines"), F.col("paragraphs")).alias("blocks"))
    return blocks.select(*PAGE, F.posexplode(_lone_words_joined(F.col("blocks"))).alias("block_no", "b")).select(*PAGE, "block_no", "b.*")


def structure(text_items: DataFrame) -> DataFrame:
    """Positioned text, a row an item -> blocks of every page."""
    return page_blocks(gathered_runs(text_runs(text_items)))


def _characters() -> Column:
    """Characters of a block: its text and its cells, each trimmed."""
    cells = F.aggregate(F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))), F.lit(0), lambda a, c: a + F.length(F.trim(c)))
    return F.coalesce(F.length(F.trim("text")), F.lit(0)) + cells


def emptiness(counts: DataFrame) -> DataFrame:
    state = F.when(F.col("characters") == 0, "empty").when(F.col("characters") < NEARLY_EMPTY, "nearly empty").otherwise("ok")
    return counts.withColumn("state", state)


def structure_report(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks and characters per document, blank pages counted; blocks are read once, and met by their pages only as counts."""
    kinds = ("heading", "paragraph", "table")
    per = blocks.groupBy(*PAGE).agg(*[F.count_if(F.col("type") == k).alias(f"{k}s") for k in kinds], F.sum(_characters()).cast("long").alias("characters"))
    all_pages = pages.select(*PAGE).join(per, PAGE, "left")
    with_tables = F.array_sort(F.collect_set(F.when(F.col("tables") > 0, F.col("page_no"))))
    counts = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("headings", "paragraphs", "tables", "characters")]
    out = all_pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count("tables").alias("with_text"), with_tables.alias("table_pages"), *counts)
    return emptiness(out.withColumn("blank", F.col("pages") - F.col("with_text")).withColumn("refused", F.col("with_text") == 0))
