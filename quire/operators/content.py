"""What packages hold as content blocks: Word elements and slides' boxes in order, and the characters in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import heading_level
from quire.operators.arrays import let, parts, places

BLOCK = "file_id string, block_no int, depth int, slide_no int, type string, level int, text string, items array<string>, rows array<array<string>>"


def _laid_out(df: DataFrame, **given: Column) -> DataFrame:
    """df with the columns of BLOCK: those given, those it has, nulls for the rest."""
    kinds = dict(c.split(" ") for c in BLOCK.split(", "))
    return df.select(*[given.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _rows(pieces: Column) -> Column:
    """A table's pieces of text in order -> its rows of cells; a cell's pieces are its lines."""

    def cell(p: Column) -> Column:
        return F.array_join(F.filter(F.transform(p, lambda x: x["text"]), lambda t: t != ""), "\n")

    def grouped(whole: Column, by: str, made: Callable[[Column], Column]) -> Column:
        fresh = places(whole, lambda i: (i == 0) | ~F.get(whole, i)[by].eqNullSafe(F.get(whole, F.greatest(i - 1, F.lit(0)))[by]))
        return F.transform(parts(whole, fresh), made)

    return grouped(pieces, "row_no", lambda row: grouped(row, "cell_no", cell))


def _blocks_in_order(flow: Column) -> Column:
    """A file's headings, paragraphs, list items, tables and pictures by their places -> its blocks by theirs."""
    after_all = F.lit((1 << 63) - 1)

    def block(p: Column, ends: Column) -> Column:
        first = F.get(p, F.lit(0))
        is_list, kind = first["type"] == "list", first["type"]
        return F.struct(
            F.when(is_list, ends - 1).otherwise(first["at"]).alias("at"), F.lit(1).alias("k"), kind.alias("type"), first["level"].alias("level"), F.when(kind.isin("heading", "paragraph"), first["text"]).alias("text"),
            F.when(is_list, F.transform(p, lambda x: x["text"])).alias("items"), first["rows"].alias("rows"),
        )

    def listed(solid: Column) -> Column:
        fresh = places(solid, lambda i: (i == 0) | (F.get(solid, i)["type"] != "list") | (F.get(solid, F.greatest(i - 1, F.lit(0)))["type"] != "list"))
        return let(parts(solid, fresh), lambda each: F.transform(each, lambda p, i: block(p, F.coalesce(F.get(F.get(each, i + 1), F.lit(0))["at"], after_all))))

    none = F.lit(None).cast("array<string>")
    pictures = F.transform(F.filter(flow, lambda x: x["type"] == "image"), lambda x: F.struct(x["at"].alias("at"), F.lit(0).alias("k"), x["type"].alias("type"), x["level"].alias("level"), x["text"].alias("text"), none.alias("items"), x["rows"].alias("rows")))
    return F.sort_array(F.concat(F.coalesce(let(F.filter(flow, lambda x: x["type"] != "image"), listed), F.slice(pictures, 1, 0)), pictures))


def word_blocks(elements: DataFrame) -> DataFrame:
    """Rows of word.docx_elements -> BLOCK rows: headings, paragraphs, lists, tables and pictures in document order.

    A picture in the middle of a paragraph parts its text; what is empty is no block. Items in a row are
    one list, whatever pictures stand among them; a list ends, and takes its place, where the next
    heading, paragraph or table begins, so pictures up to there come before it. A table stands where it begins, and one inside another is a block of
    its own after it; a cell's paragraphs are its lines. Files that could not be read have no blocks.
    The elements are read once: paragraphs, tables and files are gathered one after the other, all of them by file.
    """
    plain = elements.filter("kind != 'problem'")
    here = Window.partitionBy("file_id", "para").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    said = plain.withColumn("_cut", F.sum((F.col("kind") == "image").cast("int")).over(here)).withColumn("_item", F.max((F.col("kind") == "item").cast("int")).over(here))
    is_text, place = F.col("kind") != "image", ["table_no", "row_no", "cell_no"]
    pieces = said.groupBy("file_id", "para", "_cut").agg(
        F.min(F.when(is_text, F.col("at"))).alias("at"), F.max(F.when(~is_text, F.struct("at", "text", "table_no"))).alias("picture"), F.max("_item").alias("item"), F.first("style").alias("style"),
        *(F.first(F.when(is_text, F.col(c)), ignorenulls=True).alias(c) for c in place), F.sort_array(F.collect_list(F.when(is_text & F.col("text").isNotNull(), F.struct("at", "text")))).alias("texts"),
    )
    pieces = pieces.withColumn("text", F.array_join(F.transform("texts", lambda x: x["text"]), ""))
    none = [F.lit(None).cast("long").alias(c) for c in place]
    text = F.struct("at", *place, "item", "style", "text")
    picture = F.struct(F.col("picture.at").alias("at"), *none, F.lit(None).cast("int").alias("item"), F.lit(None).cast("string").alias("style"), F.col("picture.text").alias("text"))
    both = F.array(
        F.when(F.col("at").isNotNull() & (F.col("table_no").isNotNull() | (F.col("text") != "")), F.struct(text.alias("e"), F.lit(True).alias("is_text"))),
        F.when(F.col("picture").isNotNull() & F.col("picture.table_no").isNull(), F.struct(picture.alias("e"), F.lit(False).alias("is_text"))),
    )
    each = pieces.select("file_id", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("file_id", "x.is_text", "x.e.*")
    alone = F.when(F.col("table_no").isNull(), F.col("at"))
    flow = each.groupBy("file_id", "table_no", alone.alias("_alone")).agg(
        F.min("at").alias("at"), F.first("is_text").alias("is_text"), F.first("item").alias("item"), F.first("style").alias("style"), F.sort_array(F.collect_list(F.struct("row_no", "cell_no", "at", "text"))).alias("pieces")
    )
    level, is_table = F.when(F.col("is_text") & F.col("table_no").isNull() & (F.col("item") == 0), heading_level(F.col("style"))), F.col("table_no").isNotNull()
    kind = F.when(is_table, "table").when(~F.col("is_text"), "image").when(F.col("item") == 1, "list").when(level.isNotNull(), "heading").otherwise("paragraph")
    flow = flow.select("file_id", F.struct("at", kind.alias("type"), level.alias("level"), F.when(~is_table, F.get("pieces", F.lit(0))["text"]).alias("text"), F.when(is_table, _rows(F.col("pieces"))).alias("rows")).alias("x"))
    files = flow.groupBy("file_id").agg(F.sort_array(F.collect_list("x")).alias("flow"))
    out = files.select("file_id", F.posexplode(_blocks_in_order(F.col("flow"))).alias("block_no", "b")).select("file_id", "block_no", "b.*")
    return _laid_out(out, depth=F.lit(0))


def slide_blocks(boxes: DataFrame) -> DataFrame:
    """Rows of slides.pptx_elements -> BLOCK rows: a block per slide (depth 0), and what it holds (depth 1): a paragraph for each that has text, tables and pictures, by their boxes."""
    said = F.transform("paragraphs", lambda p: F.array_join(F.transform(p["runs"], lambda r: r["text"]), ""))
    texts = F.filter(said, lambda t: t != "")
    made = F.when(F.col("kind") == "text", F.transform(texts, lambda t: F.struct(F.lit("paragraph").alias("type"), t.alias("text")))).when(F.col("kind") == "imageRef", F.array(F.struct(F.lit("image").alias("type"), F.col("text").alias("text"))))
    made = made.when(F.col("kind") == "table", F.array(F.struct(F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"))))
    inside = boxes.select("file_id", "slide_no", "box_no", F.when(F.col("kind") == "table", F.col("rows")).alias("rows"), F.posexplode(made).alias("k", "b")).select("file_id", "slide_no", "box_no", "k", F.lit(1).alias("depth"), "b.type", "b.text", "rows")
    heads = boxes.filter("kind != 'problem'").select("file_id", "slide_no").distinct().select("*", F.lit(-1).alias("box_no"), F.lit(0).alias("k"), F.lit(0).alias("depth"), F.lit("slide").alias("type"))
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("slide_no", "box_no", "k")) - 1
    return _laid_out(heads.unionByName(inside, allowMissingColumns=True).withColumn("block_no", number))


def characters(spaces: str | None = None) -> Column:
    """Characters of a block, each text trimmed: its text, its items and its cells; pictures have none, and what a slide holds are blocks of their own.

    Trimmed are the characters of `spaces`, or all white space.
    """
    told = F.concat(F.coalesce(F.array("text"), F.array().cast("array<string>")), F.coalesce("items", F.array().cast("array<string>")), F.coalesce(F.flatten("rows"), F.array().cast("array<string>")))

    def bare(t: Column) -> Column:
        return F.regexp_replace(t, r"(?U)^\s+|\s+\z", "") if spaces is None else F.btrim(t, F.lit(spaces))

    every = F.aggregate(told, F.lit(0), lambda n, t: n + F.coalesce(F.length(bare(t)), F.lit(0)))
    return F.when(F.col("type") == "image", 0).otherwise(every)


def count_text(blocks: DataFrame, files: DataFrame | None = None, spaces: str | None = None) -> DataFrame:
    """BLOCK rows -> (file_id, blocks, characters): what there is to read in each file; of `files` (file_id), those without a block, too."""
    each = blocks.select("file_id", F.lit(1).alias("block"), characters(spaces).alias("characters"))
    if files is not None:
        each = each.unionByName(files.select("file_id"), allowMissingColumns=True)
    return each.groupBy("file_id").agg(F.count("block").alias("blocks"), F.coalesce(F.sum("characters"), F.lit(0)).cast("long").alias("characters"))
