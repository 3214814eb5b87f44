"""What several operators share: word rules, shared-folder tables, prefix sums over hot groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import shared_dir

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, group: list[str], chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before it in its group, by (chunk, order).

    A group may hold a third of all rows: only one chunk of it is sorted in a task, and the chunks'
    totals are summed in a second, small window. chunk must follow the order.
    """
    totals = df.groupBy(*group, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(totals, [*group, chunk]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_before")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node that each node reaches.

    Rounds of large and small stars, each written to the shared folder; they end when a round changes
    nothing. Only minima per node are gathered, so a node with very many edges is no burden.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.join(least, "a")
        if small:  # a > b: all smaller neighbours and the node itself hang on the least
            out = out.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
        else:
            out = out.filter("b > a").select(F.col("b").alias("x"), "m")
        return out.filter("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = stored(star(star(now, False), True), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows from batches sorted by keys (long columns without nulls); rows equal in keys are never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pa.Table.from_batches(held)
        columns = [table[k].to_numpy() for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        if len(new):
            cut = int(new[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)
