"""Plans over files and pages, event logs, and the reports on what was kept, skipped or lost."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.scalars import HELVETICA_DIGIT, OUTSIDE_LATIN, is_image, is_pdf, natural_key, office_kind, page_file_name

FORMATS = ("pdf", "docx", "xlsx", "pptx")
MOST_IMAGES = 400


def accept(files: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Files that a mode (pdf, pdf-office, image) takes, and those that it skips."""
    name, mime = F.col("name"), F.col("mime")
    takes = {"pdf": is_pdf(name, mime), "pdf-office": is_pdf(name, mime) | office_kind(name).isNotNull(), "image": is_image(name, mime)}[mode]
    return files.filter(takes), files.filter(~takes)


def gather_files(loose: DataFrame, entries: DataFrame) -> DataFrame:
    """Loose files and archive entries in one order: an archive's entries stand at its place, by natural order of their full names.

    Only names and places are sorted; contents are joined to their numbers. entries(..., entry_name) may
    hold several rows of an archive (file_id) under one name: equal ones stay together.
    """
    keys = ["batch_id", "ord", *[c for c in ("file_id",) if c in loose.columns], "entry_name"]
    both = loose.withColumn("entry_name", F.lit("")).unionByName(entries, allowMissingColumns=True)
    slim = both.groupBy(*keys).agg(F.count("*").alias("n"))
    order = Window.partitionBy("batch_id").orderBy("ord", natural_key(F.col("entry_name")), "entry_name", *keys[2:-1])
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    twin = F.row_number().over(Window.partitionBy(*keys).orderBy(F.monotonically_increasing_id())) - 1
    slim = slim.select(*keys, before.alias("before"), "n")
    once = both.join(slim.filter("n = 1").drop("n"), keys).withColumn("twin", F.lit(0))
    again = both.join(slim.filter("n > 1").drop("n"), keys).withColumn("twin", twin)
    return once.unionByName(again).withColumn("ord", (F.col("before") + F.col("twin")).cast("int")).drop("before", "twin", "entry_name")


def refused(files: DataFrame, accepted: DataFrame) -> DataFrame:
    return files.join(files.select("file_id").exceptAll(accepted.select("file_id")), "file_id")


def first_offender(files: DataFrame) -> DataFrame:
    """files(batch_id, ord, name, bad) -> the first bad file of each batch."""
    return files.filter("bad").groupBy("batch_id").agg(F.min_by("name", "ord").alias("first_bad"), F.count("*").alias("bad"))


def ordered_parts(listed: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """listed(file_id, at, rel_id), rels(file_id, rel_id, target), parts(file_id, part) -> parts in the list's order; entries without target or part go."""
    found = listed.join(rels.select("file_id", "rel_id", F.col("target").alias("part")), ["file_id", "rel_id"]).join(parts, ["file_id", "part"])
    return found.withColumn("no", F.row_number().over(Window.partitionBy("file_id").orderBy("at")) - 1)


def resolve_images(refs: DataFrame, rels: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs(file_id, ref_no, rel_id) -> usable pictures, and counts of unsupported and missing ones; refs without relationship are skipped."""
    found = refs.join(rels.select("file_id", "rel_id", F.col("target").alias("part")), ["file_id", "rel_id"])
    found = found.join(parts.select("file_id", "part", F.col("content").alias("bytes")), ["file_id", "part"], "left")
    kind = F.when(F.substring("bytes", 1, 4) == F.unhex(F.lit("89504E47")), "png").when(F.substring("bytes", 1, 2) == F.unhex(F.lit("FFD8")), "jpeg")
    state = F.when(F.col("bytes").isNull(), "missing").when(kind.isNull(), "unsupported").otherwise("ok")
    found = found.withColumn("kind", kind).withColumn("state", state)
    counts = found.groupBy("file_id").agg(F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "unsupported").alias("unsupported"))
    return found.filter("state = 'ok'").drop("state"), counts


def merge_pages(files: DataFrame, pages: DataFrame) -> DataFrame:
    """files(batch_id, ord, file_id, page_count), pages(file_id, page_no) -> each page's place in its batch's merged document."""
    w = Window.partitionBy("batch_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("batch_id", "ord", "file_id", F.coalesce(F.sum("page_count").over(w), F.lit(0)).alias("_before"))
    return pages.join(before, "file_id").select("batch_id", "ord", "file_id", "page_no", (F.col("_before") + F.col("page_no")).alias("global_page"))


def merge_summary(plan: DataFrame) -> DataFrame:
    """plan(batch_id, ord, name, size, converted, flattened) -> totals per batch."""
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("flattened"), F.struct("ord", "name")))), lambda x: x["name"])
    return plan.groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if("converted").alias("converted"), names.alias("flattened"))


def extract_pages(plan: DataFrame) -> DataFrame:
    """plan(doc_id, page_no, selected) -> selected pages renumbered."""
    return plan.filter("selected").withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")) - 1)


def split_pages(plan: DataFrame) -> DataFrame:
    """One output file per page, named page-001.pdf and so on."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    return plan.withColumn("file_name", page_file_name(n))


def number_pages(pages: DataFrame, start: int = 1, size: float = 11.0, position: str = "bottom", margin: float = 28.0) -> DataFrame:
    """pages(doc_id, page_no, width, height) -> label and its place: centred, at the foot or the head."""
    if not 1 <= start <= 999999:
        raise ValueError("start must be 1 to 999999")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")) - 1 + start
    label = n.cast("string")
    y = F.lit(margin) if position == "bottom" else F.col("height") - margin - size
    return pages.select("doc_id", "page_no", label.alias("label"), ((F.col("width") - F.length(label) * size * HELVETICA_DIGIT) / 2).alias("x"), y.alias("y"))


def remove_watermarks(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations without /Watermark in their order, and a report per document, those without any included."""
    mark = F.coalesce(F.col("subtype") == "/Watermark", F.lit(False))
    kept = annotations.filter(~mark).withColumn("annot_no", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("annot_no")) - 1)
    report = annotations.groupBy("doc_id").agg(F.count_if(mark).alias("removed"), F.count("*").alias("annotations"))
    return kept, report.withColumn("rewritten", F.col("removed") > 0)


def current_edits(events: DataFrame) -> DataFrame:
    """events(doc_id, seq, kind, page, item, text) -> each item's last apply after its page's last revert and the last discard.

    Clears are aggregated first, so the log meets two small tables.
    """
    reverts = events.filter("kind = 'revert'").groupBy("doc_id", "page").agg(F.max("seq").alias("_reverted"))
    discards = events.filter("kind = 'discard'").groupBy("doc_id").agg(F.max("seq").alias("_discarded"))
    last = events.filter("kind = 'apply'").groupBy("doc_id", "page", "item").agg(F.max("seq").alias("seq"), F.max_by("text", "seq").alias("text"))
    out = last.join(reverts, ["doc_id", "page"], "left").join(discards, "doc_id", "left")
    return out.filter("seq > coalesce(_reverted, -1) and seq > coalesce(_discarded, -1)").drop("_reverted", "_discarded")


def apply_edits(edits: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Edits with the boxes that they cover; pages that are not there are skipped."""
    there = edits.join(pages.select("doc_id", F.col("page_no").alias("page")).distinct(), ["doc_id", "page"], "left_semi")
    return there.join(boxes.select("doc_id", F.col("page_no").alias("page"), F.col("item_no").alias("item"), "left", "top", "width", "height"), ["doc_id", "page", "item"])


def drawable(edits: DataFrame, pages: DataFrame) -> DataFrame:
    """edits(doc_id, page, text, fonts) and what becomes of each: drawn text, fallback, dropped and skipped.

    fonts are the patterns of what each font lacks, the chosen one first. The first font that draws the
    whole text is taken, and is a fallback if it isn't the chosen one; where none does, the last one
    draws what it can and the rest is dropped. An edit on a page that is not there is skipped.
    """
    there = pages.select("doc_id", F.col("page_no").alias("page"), F.lit(True).alias("there")).distinct()
    out = edits.join(there, ["doc_id", "page"], "left").withColumn("skipped", F.col("there").isNull())
    able = F.array_position(F.transform("fonts", lambda f: F.regexp_count(F.col("text"), f) == 0), True)
    left = F.regexp_replace(F.col("text"), F.element_at("fonts", -1), F.lit(""))
    out = out.withColumn("drawn", F.when(~F.col("skipped"), F.when(able > 0, F.col("text")).otherwise(left)))
    return out.withColumn("fallback", F.col("drawn").isNotNull() & (able != 1)).withColumn("dropped", F.coalesce(F.length("text") - F.length("drawn"), F.lit(0))).drop("there")


def edit_summary(edits: DataFrame) -> DataFrame:
    """edits(doc_id, page, ...) -> edits and pages touched; of drawn edits also the fallbacks, characters dropped and edits skipped."""
    drawn = [F.count_if("fallback").alias("fallbacks"), F.sum("dropped").cast("long").alias("dropped"), F.count_if("skipped").alias("skipped")] if "skipped" in edits.columns else []
    return edits.groupBy("doc_id").agg(F.count("*").alias("edits"), F.count_distinct("page").alias("pages"), *drawn)


def page_plan(items: DataFrame, ops: DataFrame) -> DataFrame:
    """items(doc_id, item_id, ord, kind) and ops(doc_id, seq, item_id, op) -> the pages left, their order, rotation and crop.

    rotate turns by 90 and clears an earlier crop of a PDF page; replace resets crop and rotation; a
    delete that would leave no page is refused, so of a document whose pages were all deleted the one
    deleted last stays.
    """
    w = ["doc_id", "item_id"]
    marks = ops.groupBy(*w).agg(
        F.max(F.when(F.col("op") == "replace", F.col("seq"))).alias("replaced"), F.max(F.when(F.col("op") == "crop", F.col("seq"))).alias("cropped"),
        F.max(F.when(F.col("op") == "rotate", F.col("seq"))).alias("rotated"), F.min(F.when(F.col("op") == "delete", F.col("seq"))).alias("deleted"),
    )
    turns = ops.filter("op = 'rotate'").join(marks.select(*w, "replaced"), w).filter("seq > coalesce(replaced, -1)").groupBy(*w).agg(F.count("*").alias("turns"))
    p = items.join(marks, w, "left").join(turns, w, "left")
    doc = Window.partitionBy("doc_id")
    p = p.withColumn("_last", F.max("deleted").over(doc)).withColumn("_all", F.count("deleted").over(doc) == F.count("*").over(doc))
    p = p.filter("deleted is null or (_all and deleted = _last)")
    crop = F.col("cropped").isNotNull() & (F.col("cropped") > F.coalesce("replaced", F.lit(-1))) & ~((F.col("kind") == "pdf") & (F.coalesce("rotated", F.lit(-1)) > F.col("cropped")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return p.select(*w, place.alias("place"), (F.coalesce("turns", F.lit(0)) * 90 % 360).cast("int").alias("rotation"), crop.alias("cropped"), F.col("replaced").isNotNull().alias("replaced"))


def flattened_count(plan: DataFrame) -> DataFrame:
    return plan.groupBy("doc_id").agg(F.count_if("cropped").alias("flattened"), F.count("*").alias("pages"))


def _moved(items: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
    order = items.sort_values("ord").item_id.tolist()
    known = set(order)
    for item, to in zip(*(moves.sort_values("seq")[c].tolist() for c in ("item_id", "to")), strict=True):
        if item in known:
            order.remove(item)
            order.insert(min(max(int(to), 0), len(order)), item)
    doc = items.doc_id.iloc[0] if len(items) else None
    return pd.DataFrame({"doc_id": pd.Series([doc] * len(order), dtype="Int64"), "item_id": np.array(order, np.int64), "place": np.arange(len(order), dtype=np.int32)})


def reorder(items: DataFrame, moves: DataFrame) -> DataFrame:
    """items(doc_id, item_id, ord), moves(doc_id, seq, item_id, to) -> places after all moves in turn; targets are clamped, moves of items that are not there are ignored.

    A move names its item, so where it takes it from depends on all moves before: a document's items and
    its moves meet once, side by side, and are walked in turn.
    """
    sides = items.select("doc_id", "item_id", "ord").groupBy("doc_id").cogroup(moves.select("doc_id", "seq", "item_id", F.col("to").cast("int").alias("to")).groupBy("doc_id"))
    return sides.applyInPandas(_moved, "doc_id long, item_id long, place int")


def conversion_pairs(spark: SparkSession) -> DataFrame:
    """The twelve conversions between the four formats."""
    f = spark.createDataFrame([(x,) for x in FORMATS], "source string")
    return f.crossJoin(f.withColumnRenamed("source", "target")).filter("source != target")


def check_pairs(requests: DataFrame) -> DataFrame:
    """Requests that are no conversion."""
    return requests.join(conversion_pairs(requests.sparkSession), ["source", "target"], "left_anti")


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """warnings(doc_id, seq, message) -> distinct ones in first-seen order."""
    first = warnings.groupBy("doc_id", "message").agg(F.min("seq").alias("seq"), F.count("*").alias("times"))
    return first.withColumn("no", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "message")) - 1)


def union_warnings(*warnings: DataFrame) -> DataFrame:
    return distinct_warnings(reduce(DataFrame.unionByName, warnings))


def compression_ledger(sizes: DataFrame) -> DataFrame:
    """sizes(file_id, level, before, after) and saved, outcome."""
    outcome = F.when(F.col("after") < F.col("before"), "smaller").when(F.col("after") == F.col("before"), "same").otherwise("bigger")
    return sizes.withColumn("saved", F.greatest(F.lit(0), F.col("before") - F.col("after"))).withColumn("outcome", outcome)


def ledger_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("level", "outcome").agg(F.count("*").alias("files"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum("saved").alias("saved"))


def batch_outcome(results: DataFrame, mode: str = "convert") -> DataFrame:
    """results(batch_id, ord, ok, message) -> done, failed and the first failure; in a merge one failure fails the batch."""
    out = results.groupBy("batch_id").agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.min_by(F.when(~F.col("ok"), F.col("message")), F.when(~F.col("ok"), F.col("ord"))).alias("first_failure"))
    return out.withColumn("batch_ok", F.col("failed") == 0 if mode == "merge" else F.col("done") > 0)


def char_coverage(texts: DataFrame, top: int = 5) -> DataFrame:
    """texts(doc_id, text) -> lost characters per document and its commonest ones; only those outside the Latin font are exploded."""
    lost = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(OUTSIDE_LATIN), F.lit(0))).alias("char"))
    counts = lost.groupBy("doc_id", "char").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "char")))
    chars = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "char")))), lambda x: x["char"])
    return ranked.groupBy("doc_id").agg(F.sum("n").alias("lost"), F.count("*").alias("kinds"), chars.alias("commonest"))


def dedupe_images(images: DataFrame) -> DataFrame:
    """images(doc_id, ref_no, signature) -> media_no of each reference: the first of a signature is written, at most 400 a document.

    Once 400 are held, later references get none, even repeats. Only signatures are shuffled.
    """
    first = F.min("ref_no").over(Window.partitionBy("doc_id", "signature"))
    r = images.select("doc_id", "ref_no", "signature").withColumn("_first", first)
    w = Window.partitionBy("doc_id").orderBy("ref_no")
    r = r.withColumn("_new", (F.col("_first") == F.col("ref_no")).cast("int")).withColumn("_held", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = r.filter(F.col("_held") < MOST_IMAGES)
    media = r.filter("_new = 1").select("doc_id", "signature", F.col("_held").alias("media_no"))
    return r.join(media, ["doc_id", "signature"]).select("doc_id", "ref_no", "signature", "media_no")


#: What cannot stand in a part that is read to its end, by the way it fails.
XML_FAULTS = ("empty", "truncated", "badly nested")
_ROOT, _BEHIND = r"^(?:<\?[\s\S]*?\?>|<!--[\s\S]*?-->|\s)*<([^\s/><?!]+)", r"(?:\s|<!--(?:(?!-->)[\s\S])*-->|<\?(?:(?!\?>)[\s\S])*\?>)*$"


def xml_fault(xml: Column) -> Column:
    """Why a part is no well-formed XML, as Spark's XML reader finds it; null if it is.

    Empty: null, or nothing but white space. Truncated: the text does not end as its first element has
    to. Badly nested: it does, and still cannot be read. Text or another element behind the first counts
    as truncated; document types with entities are refused, as packages may not hold any.
    """
    text = F.regexp_replace(xml, "^\ufeff", "")
    unread = F.from_xml(text, "_unread string", {"columnNameOfCorruptRecord": "_unread", "mode": "PERMISSIVE"})["_unread"].isNotNull()
    body = F.regexp_replace(text, _BEHIND, "")
    root = F.regexp_extract(text, _ROOT, 1)
    closed = F.when(body.endswith("/>"), F.position(F.lit("<"), F.substr(body, F.position(F.concat(F.lit("<"), root), body) + 1)) == 0).otherwise(F.rlike(body, F.concat(F.lit("</"), F.regexp_replace(root, r"([^\w:-])", r"\\$1"), F.lit(r"\s*>$"))))
    ends = (root != "") & (F.coalesce(closed, F.lit(False)))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\s*$"), XML_FAULTS[0]).when(~ends, XML_FAULTS[1]).when(unread, XML_FAULTS[2])


def verify_package(parts: DataFrame, characters: DataFrame) -> DataFrame:
    """parts(file_id, part, xml) and characters(file_id, characters) -> ok: four parts, all XML readable, some text; and how many parts fail in which way."""
    fault = F.when(F.col("part").rlike(r"(?i)\.(xml|rels)$"), xml_fault(F.col("xml")))
    told = [F.count_if(F.col("_fault") == f).alias(f.replace(" ", "_")) for f in XML_FAULTS]
    seen = parts.filter(~F.col("part").endswith("/")).withColumn("_fault", fault).groupBy("file_id").agg(F.count("*").alias("parts"), (F.count("_fault") == 0).alias("readable"), *told)
    out = seen.join(characters, "file_id", "left").na.fill(0, ["characters"])
    return out.withColumn("ok", (F.col("parts") >= 4) & F.col("readable") & (F.col("characters") > 0))
