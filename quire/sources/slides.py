"""Slides as boxes with absolute places, paragraphs and tables, from their elements as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.markup import enclosing, name, outermost, parent, shown, xml_nodes

# Lengths are 12,700 to a point; where boxes without a place go; font sizes.
EMU = 12700
STEP, LEFT, HEIGHT = 40.0, 24.0, 400.0
SIZE, CELL_SIZE, LEAST_SIZE, MOST_SIZE = 18.0, 12.0, 4.0, 400.0
ALIGNED = {"ctr": "center", "r": "right", "just": "both"}

BOXES = ("p:sp", "p:pic", "p:graphicFrame")
RUNS = ("a:r", "a:fld", "a:br")
PLACES = {"a:off": ("x", "y"), "a:ext": ("cx", "cy"), "a:chOff": ("x", "y"), "a:chExt": ("cx", "cy")}
WANTED = {"p:spTree", "p:grpSp", *BOXES, *RUNS, *PLACES, "a:p", "a:pPr", "a:rPr", "a:t", "a:tr", "a:tc", "a:blip"}
KEYS = ["file_id", "slide_no"]


def _attr(key: str) -> Column:
    return F.try_element_at("attrs", F.lit(key))


def _points(key: str) -> Column:
    return F.coalesce(_attr(key).try_cast("double"), F.lit(0.0)) / EMU


def _at(depth: int) -> Column:
    return F.try_element_at("tags", F.lit(-depth))


def _first(value: Column) -> Column:
    """The value of the first node in document order that has one."""
    return F.min_by(value, F.when(value.isNotNull(), F.col("pre")))


def _mapped(maps: Column, low: str, low_inside: str, size: str, size_inside: str, at: Column) -> tuple[Column, Column]:
    """(place, scale) of a length from the innermost group outwards: each group puts what its inside measures where it stands itself."""

    def outward(a: Column, m: Column) -> Column:
        scale = F.when((m[size_inside] != 0) & m[size].isNotNull(), m[size] / m[size_inside]).otherwise(1.0)
        moved = F.when(m[low].isNotNull(), m[low] + (a["at"] - F.coalesce(m[low_inside], F.lit(0.0))) * scale).otherwise(a["at"])
        return F.struct(moved.alias("at"), (a["scale"] * scale).alias("scale"))

    out = F.aggregate(maps, F.struct(at.alias("at"), F.lit(1.0).alias("scale")), outward)
    return out["at"], out["scale"]


def pptx_elements(slides: DataFrame, slide_width: float = 720.0) -> DataFrame:
    """slides(file_id, slide_no, xml) -> boxes in order, in points, with paragraphs and runs.

    What groups hold is placed and scaled by all groups around it, innermost first, and marked as
    grouped. Shapes without a place are stacked down the slide. Of alternative contents the first is
    read. Frames without a table are boxes of kind unsupported; a slide that is no XML, or null, is one of
    kind problem. One exchange on the slide serves all of it.
    """
    parts = slides.select("file_id", F.col("slide_no").cast("int").alias("slide_no"), "xml")
    nodes = xml_nodes(parts, WANTED).filter(F.col("problem").isNotNull() | (F.array_contains("tags", "p:spTree") & shown())).repartition(*KEYS)
    tag, box = name(), outermost(*BOXES)
    own_group = F.array_max(F.transform(F.filter(F.arrays_zip("tags", "path"), lambda x: x["tags"] == "p:grpSp"), lambda x: x["path"]))
    groups = F.array_sort(F.transform(F.filter(F.arrays_zip("tags", "path"), lambda x: x["tags"] == "p:grpSp"), lambda x: x["path"]))
    of_group = (_at(3) == "p:grpSpPr") & (_at(4) == "p:grpSp") & box.isNull()
    spot = F.struct(_points("x").alias("x"), _points("y").alias("y"), _points("cx").alias("cx"), _points("cy").alias("cy"))
    kind_at = {x: F.element_at("path", F.array_position("tags", x).cast("int")) for x in ("a:tr", "a:tc")}
    in_table = F.array_contains("tags", "a:tr")
    run = F.when(F.array_contains("tags", "a:p"), enclosing(*RUNS))
    nodes = nodes.select(
        *KEYS, "pre", "problem", tag.alias("tag"), F.coalesce(box, own_group).alias("unit"), box.isNotNull().alias("is_box"), groups.alias("groups"), parent().alias("parent"),
        F.when(tag.isin(*PLACES) & (of_group | box.isNotNull()) & F.coalesce(parent().isin("a:xfrm", "p:xfrm"), F.lit(False)), spot).alias("spot"),
        F.when(in_table, kind_at["a:tr"]).alias("tr"), F.when(in_table & F.array_contains("tags", "a:tc"), kind_at["a:tc"]).alias("tc"), enclosing("a:p").alias("p"), run.alias("run"),
        F.when((tag == "a:t") & parent().isin("a:r", "a:fld"), F.col("text")).when(tag == "a:br", "\n").alias("text"), F.when(tag == "a:pPr", F.coalesce(_attr("algn"), F.lit(""))).alias("algn"),
        F.when((tag == "a:rPr") & parent().isin(*RUNS), F.struct((_attr("sz").try_cast("double") / 100).alias("sz"), (F.coalesce(_attr("b"), F.lit("0")).isin("1", "true")).alias("b"), (F.coalesce(_attr("i"), F.lit("0")).isin("1", "true")).alias("i"))).alias("style"),
        F.when(tag == "a:blip", _attr("r:embed")).alias("embed"),
    )

    # from runs to paragraphs, cells, rows and boxes: every grouping is finer than the slide
    inside = [*KEYS, "unit", "tr", "tc", "p"]
    carried = [F.min("problem").alias("problem"), F.max("is_box").alias("is_box"), F.min("groups").alias("groups"), F.min(F.when(F.col("pre") == F.col("unit"), F.col("tag"))).alias("tag"), _first(F.col("embed")).alias("embed")]
    carried += [_first(F.when(F.col("tag") == k, F.col("spot"))).alias(k[2:]) for k in PLACES]
    runs = nodes.groupBy(*inside, "run").agg(
        F.min("pre").alias("pre"), *carried, F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pre", "text")))), lambda x: x["text"]), "").alias("text"), _first(F.col("style")).alias("style"), _first(F.col("algn")).alias("algn")
    )

    def up(df: DataFrame, by: list[str], *more: Column) -> DataFrame:
        kept = [F.min("problem").alias("problem"), F.max("is_box").alias("is_box"), F.min("groups").alias("groups"), F.min("tag").alias("tag"), *[_first(F.col(c)).alias(c) for c in ("embed", "off", "ext", "chOff", "chExt")]]
        return df.groupBy(*by).agg(F.min("pre").alias("pre"), *kept, *more)

    def in_order(value: Column, of: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(of, F.struct("pre", value.alias("v"))))), lambda x: x["v"])

    size = F.when(F.col("style.sz") > 0, F.least(F.greatest("style.sz", F.lit(LEAST_SIZE)), F.lit(MOST_SIZE))).otherwise(F.when(F.col("tr").isNotNull(), CELL_SIZE).otherwise(SIZE))
    one = F.struct("text", size.alias("size"), F.coalesce("style.b", F.lit(False)).alias("bold"), F.coalesce("style.i", F.lit(False)).alias("italic"))
    paragraphs = up(runs, inside, in_order(one, F.col("run").isNotNull() & (F.col("text") != "")).alias("runs"), _first(F.col("algn")).alias("algn"))
    aligned = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIGNED.items() for x in kv]), F.coalesce("algn", F.lit(""))), F.lit("left"))
    cells = up(paragraphs, inside[:-1], in_order(F.struct(aligned.alias("align"), "runs"), F.col("p").isNotNull()).alias("paragraphs"))
    said = F.transform("paragraphs", lambda p: F.array_join(F.transform(p["runs"], lambda r: r["text"]), ""))
    rows = up(cells, inside[:-2], in_order(F.array_join(said, " "), F.col("tc").isNotNull()).alias("cells"), F.max(F.when(F.col("tr").isNull(), F.col("paragraphs"))).alias("paragraphs"))
    units = up(rows, inside[:-3], in_order(F.col("cells"), F.col("tr").isNotNull() & (F.size("cells") > 0)).alias("rows"), F.max("paragraphs").alias("paragraphs"))

    # each box meets the maps of the groups around it: one row per box and group, beside the group's own
    table, around = F.col("rows"), F.when(F.col("is_box"), F.col("groups")).otherwise(F.array("unit"))
    said = F.array_join(said, "\n")
    kind = (
        F.when(F.col("problem").isNotNull(), "problem").when((F.col("tag") == "p:sp") & F.exists("paragraphs", lambda p: F.size(p["runs"]) > 0), "text")
        .when((F.col("tag") == "p:pic") & (F.coalesce("embed", F.lit("")) != ""), "imageRef").when((F.col("tag") == "p:graphicFrame") & (F.size(table) > 0), "table").when(F.col("tag") == "p:graphicFrame", "unsupported")
    )
    units = units.withColumn("kind", kind).filter(F.col("kind").isNotNull() | ~F.col("is_box"))
    met = units.withColumn("group", F.explode_outer(around))
    own = F.struct(F.col("off.x").alias("x"), F.col("off.y").alias("y"), F.col("ext.cx").alias("cx"), F.col("ext.cy").alias("cy"), F.col("chOff.x").alias("ix"), F.col("chOff.y").alias("iy"), F.col("chExt.cx").alias("icx"), F.col("chExt.cy").alias("icy"))
    met = met.withColumn("map", F.max(F.when(~F.col("is_box"), own)).over(Window.partitionBy(*KEYS, "group"))).filter(F.col("kind").isNotNull())
    maps = F.transform(F.sort_array(F.collect_list(F.when(F.col("map").isNotNull(), F.struct("group", "map"))), asc=False), lambda x: x["map"])
    boxes = met.groupBy(*KEYS, "unit", "kind").agg(maps.alias("maps"), *[F.first(c).alias(c) for c in ("problem", "groups", "embed", "off", "ext", "rows", "paragraphs")])
    placed = F.col("off").isNotNull() & F.col("ext").isNotNull()
    waits = ~placed & F.col("kind").isin("text", "imageRef", "table")
    order = Window.partitionBy(*KEYS).orderBy("unit")
    boxes = boxes.withColumns({"stacked": F.sum(waits.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "box_no": F.row_number().over(order) - 1})
    x, wide = _mapped(F.col("maps"), "x", "ix", "cx", "icx", F.col("off.x"))
    y, high = _mapped(F.col("maps"), "y", "iy", "cy", "icy", F.col("off.y"))
    shows = F.col("kind").isin("text", "imageRef", "table")

    def spot_of(given: Column, stacked: Column) -> Column:
        return F.when(shows & placed, given).when(shows, stacked)

    return boxes.select(
        *KEYS, F.col("box_no").cast("int").alias("box_no"), "kind", (F.size("groups") > 0).alias("grouped"),
        spot_of(x, F.lit(LEFT)).alias("x"), spot_of(y, LEFT + STEP * (F.col("stacked") - 1)).alias("y"), spot_of(F.col("ext.cx") * wide, F.lit(slide_width - 2 * LEFT)).alias("width"), spot_of(F.col("ext.cy") * high, F.lit(HEIGHT)).alias("height"),
        F.when(F.col("kind") == "text", said).when(F.col("kind") == "imageRef", F.col("embed")).when(F.col("kind") == "problem", F.col("problem")).alias("text"),
        F.when(F.col("kind") == "text", F.col("paragraphs")).alias("paragraphs"), F.when(F.col("kind") == "table", table).alias("rows"),
    )
