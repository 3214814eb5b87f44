"""WARC fixity: Merkle trees over records and their ordered offset ranges, compared replica by replica.

A leaf is a record's length and SHA-256; a node hashes the ordered nodes below it, `fanout` at most, each
with the length of its range of offsets. Replicas whose roots agree are not looked at further; elsewhere only
the children of nodes that differ are compared, level by level, down to the records. Ranges are hashed
by length, so a record that grew is one that differs, and those behind it have only moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

FANOUT = 16
LEVELS = 3  # at least: 16 ** 3 records a file


def warc_record(url: Column, body: Column, number: Column) -> Column:
    """A response record with its header; null parts are empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    ).cast("binary")


def parse_warc(content: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, record, body) of each whole record of a WARC file; bytes that start no record end the file.

    Of a file of gzip members the offsets are those of the members, each of which holds a record or more.
    """
    if content.startswith(b"\x1f\x8b"):
        yield from _members(content)
        return
    at = 0
    while content.startswith(b"WARC/", at):
        head = content.find(b"\r\n\r\n", at)
        if head < 0:
            return
        fields = dict(line.split(b":", 1) for line in content[at:head].split(b"\r\n")[1:] if b":" in line)
        size = next((int(v) for k, v in fields.items() if k.strip().lower() == b"content-length" and v.strip().isdigit()), 0)
        end = head + 4 + size
        yield at, content[at : end + 4], content[head + 4 : end]
        at = end + 4


def _members(content: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    at = 0
    while at < len(content):
        member = zlib.decompressobj(31)
        try:
            whole = member.decompress(content[at:])
        except zlib.error:
            return
        if not member.eof:
            return
        yield from ((at, record, body) for _, record, body in parse_warc(whole) if not whole.startswith(b"\x1f\x8b"))
        at = len(content) - len(member.unused_data)


def read_records(files: DataFrame) -> DataFrame:
    """files(file_no, content) -> (file_no, ord, offset, record) of WARC files, each opened where its bytes are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, content in zip(batch.column("file_no").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = [(no, i, at, record) for i, (at, record, _) in enumerate(parse_warc(content or b""))]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["file_no", "ord", "offset", "record"])

    return files.select(F.col("file_no").cast("long"), "content").mapInArrow(run, "file_no long, ord long, offset long, record binary")


def leaves(records: DataFrame) -> DataFrame:
    """records(file_no, key, record) -> (file_no, ord, key, offset, length, hash); records lie in the order of key, equal keys in that of their hashes.

    Only lengths and hashes are sorted, never the records.
    """
    slim = records.select("file_no", "key", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    w = Window.partitionBy("file_no").orderBy(F.col("key").asc_nulls_first(), "hash")
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return slim.select("file_no", (F.row_number().over(w) - 1).cast("long").alias("ord"), "key", before.alias("offset"), "length", "hash")


def levels_of(*leaf_rows: DataFrame) -> int:
    """The levels above the leaves that bring the largest file of all tables to one node."""
    most = max((x.agg(F.max("ord")).first()[0] or 0 for x in leaf_rows), default=0) + 1
    levels = LEVELS
    while FANOUT**levels < most:
        levels += 1
    return levels


def merkle_tree(leaf_rows: DataFrame, levels: int | None = None) -> DataFrame:
    """Leaves -> nodes (file_no, level, node, first, last, hash): level 0 are the leaves, the highest has one node a file.

    levels must be those of the largest file of all replicas (levels_of); no node hashes more than 16 others.
    """
    level = leaf_rows.select("file_no", F.col("ord").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), F.sha2(F.concat_ws(":", "length", "hash").cast("binary"), 256).alias("hash"))
    tree = level.withColumn("level", F.lit(0))
    for k in range(1, (levels or levels_of(leaf_rows)) + 1):
        below = F.transform(F.array_sort(F.collect_list(F.struct("node", (F.col("last") - F.col("first")).alias("length"), "hash"))), lambda x: F.concat_ws(":", x["length"].cast("string"), x["hash"]))
        level = level.withColumn("_p", F.floor(F.col("node") / FANOUT)).groupBy("file_no", "_p").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(F.array_join(below, ";").cast("binary"), 256).alias("hash")).withColumnRenamed("_p", "node")
        tree = tree.unionByName(level.withColumn("level", F.lit(k)))
    return tree.select("file_no", "level", "node", "first", "last", "hash")


def audit(mine: DataFrame, theirs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Two replicas' trees -> the leaves that differ: (file_no, ord, first, last, state); state is changed, missing or extra.

    Each level joins only the children of nodes that differed on the level above.
    """
    wrong = None
    for level in range(levels, -1, -1):
        a = mine.filter(F.col("level") == level).select("file_no", "node", "first", "last", "hash")
        b = theirs.filter(F.col("level") == level).select("file_no", "node", F.col("first").alias("first2"), F.col("last").alias("last2"), F.col("hash").alias("hash2"))
        if wrong is not None:
            parent = F.floor(F.col("node") / FANOUT)
            above = wrong.select("file_no", F.col("node").alias("_p"))
            a, b = (x.withColumn("_p", parent).join(above, ["file_no", "_p"], "left_semi").drop("_p") for x in (a, b))
        both = a.join(b, ["file_no", "node"], "full_outer").filter(~F.col("hash").eqNullSafe(F.col("hash2")))
        wrong = stored(both, f"fixity-level{level}")
    state = F.when(F.col("hash").isNull(), "extra").when(F.col("hash2").isNull(), "missing").otherwise("changed")
    return wrong.select("file_no", F.col("node").alias("ord"), F.coalesce("first", "first2").alias("first"), F.coalesce("last", "last2").alias("last"), state.alias("state"))


def audit_replica(records: DataFrame, replica: DataFrame) -> DataFrame:
    """records and replica (file_no, key, record) -> the records' leaves and state (intact, moved, changed, missing, extra).

    Null records are no bytes; null keys come first; an empty table gives an empty result, or all records
    extra. A record that grew or shrank is changed, and those behind it that are whole but not where they
    were have moved; only files whose roots differ are looked through for these.
    """
    own = stored(leaves(records), "fixity-leaves")
    other = stored(leaves(replica), "fixity-replica")
    levels = levels_of(own, other)
    trees = [stored(merkle_tree(x, levels), "fixity-tree") for x in (own, other)]
    found = audit(*trees, levels).select("file_no", "ord", "state")
    torn = found.select("file_no").distinct()
    places = other.join(torn, "file_no").select("file_no", "ord", F.col("offset").alias("_place"))
    whole = F.when(F.col("_place") != F.col("offset"), "moved").otherwise("intact")
    both = own.join(found, ["file_no", "ord"], "left").join(places, ["file_no", "ord"], "left").withColumn("state", F.coalesce("state", whole)).drop("_place")
    extra = other.join(found.filter("state = 'extra'"), ["file_no", "ord"])
    return both.unionByName(extra)


def page_records(pages: DataFrame, per_file: int = 4096) -> DataFrame:
    """pages(page_id, url, html, ...) -> (file_no, key, record): a WARC file per per_file page ids; pages without one are dealt over the files -1 to -4096 by what they hold."""
    nowhere = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(4096))
    file_no = F.coalesce(F.floor(F.col("page_id") / per_file), nowhere).cast("long")
    return pages.select(file_no.alias("file_no"), F.col("page_id").alias("key"), warc_record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))
