"""Mixing sources to target weights by a low-discrepancy source schedule.

Slot k of the mix takes the golden-ratio point frac(k * phi), which falls into one source's stretch of
the cumulative weights; the r-th slot of a source takes the r-th block of equally many words of that
source's shuffled stream. What a source gives is what its slots draw: within a few blocks of its target,
since the points leave no stretch short or over by more. A small source has small blocks, a 64th of its
target at most: the sources with blocks of one length share a schedule, and the schedules run side by
side, each over the whole of the mix.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import n_words, running_total, stored

#: The golden ratio's fraction in units of 2**-31, odd, so the points are a permutation of the grid.
GOLDEN, GRID = 1327217885, 1 << 31
CELLS = 4096


class Mix(NamedTuple):
    """sources: source_no, source, source_size, target, want, block_words. rows: one per document with its
    place in the source's stream. schedule: turn (when, from 0 to 1), slot, source_no, block. pieces: turn, slot, source_no, block, start,
    epoch, k1, k2, size, first (words of the document before the piece), length. k1 and k2 name a document's row."""

    sources: DataFrame
    rows: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2) -> DataFrame:
    """(source, size) rows -> one row per source with its target.

    Sources are numbered by code point, null last, and weigh `weights`, repeating. They share
    share[0]/share[1] of all words; a target stops at `epochs` times its source's size and the excess
    goes to the others by weight. One row per source is all that the unpartitioned windows see.
    """
    num, den = share
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("source_no", F.row_number().over(ordered).cast("long"))
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("source_size") * epochs / F.col("weight"), "source_no")
    before, onward = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("_all", F.sum("source_size").over(everything))
    out = out.withColumn("_left", num * F.col("_all") - den * epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    out = out.withColumn("_weights", den * F.sum("weight").over(onward)).withColumn("_ord", F.row_number().over(filled))
    full = F.col("_left").cast("double") * F.col("weight") / F.col("_weights") >= F.col("source_size") * epochs
    out = out.withColumn("_open", F.min(F.when(~full, F.col("_ord"))).over(everything))
    out = out.withColumn("_l", F.max(F.when(F.col("_ord") == F.col("_open"), F.col("_left"))).over(everything))
    out = out.withColumn("_w", F.max(F.when(F.col("_ord") == F.col("_open"), F.col("_weights"))).over(everything))
    cap = (F.col("source_size") * epochs).cast("double")
    target = F.when(F.col("_open").isNull() | (F.col("_ord") < F.col("_open")), cap).otherwise((F.col("weight") * F.col("_l")).cast("double") / F.col("_w"))
    out = out.withColumn("target", target).withColumn("want", F.floor(F.col("target") + 0.5).cast("long"))
    return out.select("source_no", "source", "source_size", "target", "want")


#: A source has this many blocks at least, unless its blocks are of one word.
LEAST_BLOCKS = 64


def with_blocks(sources: DataFrame, block_words: int) -> DataFrame:
    """sources and the length of each one's blocks: a power of two, a 64th of what it gives at most, and block_words at most."""
    power = F.expr(f"shiftleft(1L, length(bin(want div {LEAST_BLOCKS})) - 1)")
    return sources.withColumn("block_words", F.least(power, F.lit(block_words).cast("long")))


def slot_schedule(sources: DataFrame) -> DataFrame:
    """source_no, want, block_words -> turn, slot, source_no, block: the source of each slot, and how many of its slots came before.

    Sources of one block length share their slots. Points and cumulative weights meet by an equi-join on a
    fixed grid over [0, 1), so neither the slots nor the sources are sent whole to any task.
    """
    length = Window.partitionBy("block_words")
    s = sources.filter("want > 0").select("source_no", "want", "block_words", F.sum("want").over(length.orderBy("source_no")).alias("to"), F.sum("want").over(length).alias("all"))
    s = s.withColumn("lo", (F.col("to") - F.col("want")) / F.col("all")).withColumn("hi", F.col("to") / F.col("all"))
    cells = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    slots = sources.sparkSession.range(0).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("block_words"), F.lit(0.0).alias("turn"))
    for r in sources.groupBy("block_words").agg(F.sum("want").alias("words")).filter("words > 0").orderBy("block_words").collect():  # nine lengths at most
        n = -(-r["words"] // r["block_words"])
        slots = slots.unionByName(sources.sparkSession.range(n).select(F.col("id").alias("slot"), F.lit(r["block_words"]).cast("long").alias("block_words"), ((F.col("id") + 0.5) / n).alias("turn")))
    slots = slots.withColumn("u", ((F.col("slot") % GRID) * GOLDEN) % GRID / GRID).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = slots.join(cells.select("block_words", "cell", "source_no", "lo", "hi"), ["block_words", "cell"]).filter("u >= lo and u < hi")
    hit = hit.select("turn", "slot", "source_no", F.shiftright("slot", 16).alias("chunk"))
    return running_total(hit, ["source_no"], "chunk", ["slot"], F.lit(1), "block").select("turn", "slot", "source_no", "block")


def _row_names(size: Column) -> list[Column]:
    """Two hashes of a row of docs: rows with one name are equal in doc_id, source and text."""
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.coalesce("source", F.lit("\0")), F.coalesce("text", F.lit("")), size]
    return [F.xxhash64(F.lit(i), *parts).alias(f"k{i}") for i in (1, 2)]


def mix_sources(
    docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2, block_words: int | None = None, seed: str = "mix"
) -> Mix:
    """docs(doc_id, text, source, ...) -> Mix.

    A block has block_words words; None makes them a 2**20th of the mix, but one word at least and 256 at
    most. Sources of less than 64 such blocks have smaller ones.
    Null texts and texts of spaces have size 0 and are never taken; a null source is a source of its
    own; an empty table gives empty results; repeated rows are documents of their own (equal ones lie
    side by side in the stream and may differ in what is taken of them); other columns are ignored.
    A source repeats its stream in the same shuffled order, so no document comes back before all
    others of its source were taken; slots beyond its last epoch stay empty. Rows are ordered by md5 of
    doc_id and seed: reruns agree.
    """
    size = n_words(F.col("text"))
    sizes = stored(docs.select("doc_id", "source", size.alias("size"), *_row_names(size)), "mix-sizes")
    sources = stored(source_targets(sizes, weights, share, epochs), "mix-sources")
    words = sources.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0]
    block_words = block_words or min(256, max(1, words >> 20))
    sources = with_blocks(sources, block_words)
    schedule = stored(slot_schedule(sources), "mix-schedule")
    drawn = schedule.groupBy("source_no").agg(F.count("*").alias("slots"))
    known = sources.join(drawn, "source_no", "left").select("source_no", "source", "source_size", "target", "block_words", (F.coalesce("slots", F.lit(0)) * F.col("block_words")).alias("drawn"))
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    rows = sizes.alias("z").join(known.alias("s"), F.expr("z.source <=> s.source")).select("doc_id", "k1", "k2", "size", "source_no", "source_size", "target", "block_words", "drawn", order.alias("h"))
    rows = running_total(rows.withColumn("bucket", F.substring("h", 1, 3)), ["source_no"], "bucket", ["h", "doc_id", "size", "k1"], F.col("size"), "start")
    rows = stored(rows.drop("h", "bucket"), "mix-rows")
    b = F.col("block_words")
    seen = rows.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    seen = seen.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("end", F.least(F.col("at") + F.col("size"), F.col("drawn"))).filter("at < end")
    seen = seen.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("end") - 1) / b))))
    low, high = F.greatest(F.col("at"), F.col("block") * b), F.least(F.col("end"), (F.col("block") + 1) * b)
    seen = seen.withColumn("first", low - F.col("at")).withColumn("length", high - low)
    pieces = seen.join(schedule, ["source_no", "block"])
    return Mix(sources, rows.drop("drawn", "block_words"), schedule, pieces.select("turn", "slot", "source_no", "block", "start", "epoch", "k1", "k2", "size", "first", "length"))


def words_taken(mix: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words in the mix, repeats counted)."""
    got = mix.pieces.groupBy("source_no", "start").agg(F.sum("length").alias("taken"))
    nonempty = mix.rows.filter("size > 0").join(got, ["source_no", "start"], "left")
    empty = mix.rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return nonempty.select(*cols).unionByName(empty.select(*cols))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, in the order of their first turns: a row for each time that a document is taken, with docs' columns.

    A document taken in part (at most one per source and epoch) keeps the first words taken, cut at a
    space; n_chars, if there, is the length of the new text. Of rows equal in doc_id, source and text
    each is taken as often as its place in the stream says. Null and blank texts are never taken; an
    empty table stays empty; columns may have any names.
    """
    mix = mix_sources(docs, **options)
    taken = mix.pieces.groupBy("k1", "k2", "start", "size", "epoch").agg(F.sum("length").alias("taken"), F.min("turn").alias("turn"))
    taken = stored(taken.withColumn("copy", F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("start"))), "mix-taken")
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.filter(F.col("text").isNotNull()).select(*_row_names(n_words(F.col("text"))), F.struct(*others).alias("rest"), "text")
    twins = taken.filter("copy > 1").select("k1", "k2").distinct()
    once = rows.join(taken.join(twins, ["k1", "k2"], "left_anti"), ["k1", "k2"])
    again = rows.join(twins, ["k1", "k2"], "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("text")))
    out = once.unionByName(again.join(taken, ["k1", "k2", "copy"]))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    out = out.withColumn("text", F.when(F.col("taken") >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(pieces, 1, F.col("taken").cast("int")), "")))
    own = {"text": F.col("text")} | {c: F.col("rest")[c] for c in others}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.orderBy("turn", "start", "epoch", "k1").select(*[own[c].alias(c) for c in docs.columns])
