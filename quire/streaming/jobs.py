"""Streams: files taken in once each as they arrive, and an edit log kept current."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.functions.scalars import is_pdf, is_zip, office_kind, wrong_file_reason
from quire.sources.files import guard_archive

ARRIVING = "path string, modificationTime timestamp, length long, content binary"
#: What opening a file is reckoned at when files are dealt to tasks: some 1,900 small ones to a task of 128 MB, not 32.
OPENING = 64 * 1024
#: Tasks that list files, for each that runs at once; by default Spark takes one a path, up to 10,000.
LISTING_TASKS = 4
STATE_STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings that hold for what is started inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def classified(files: DataFrame, wanted: str = "pdf", name: Column | None = None) -> DataFrame:
    """files(path, length, content) -> name, size, kind, accepted and the reason why not, and what the guard says of archives (null for others); no state, so it runs in batches and streams alike.

    The name is the path's last part, unless the caller tells where it stands.
    """
    name, mime = F.element_at(F.split("path", "/"), -1) if name is None else name, F.lit("")
    kind = F.when(is_pdf(name, mime), "pdf").when(office_kind(name).isNotNull(), office_kind(name)).when(is_zip(name, mime), "zip").otherwise("other")
    reason = wrong_file_reason(name, mime, F.lit(wanted))
    packed = ~kind.isin("pdf", "other")
    guarded = guard_archive(files.withColumn("content", F.when(packed & (F.substring("content", 1, 2) == F.unhex(F.lit("504B"))), F.col("content"))))
    return guarded.select(name.alias("name"), F.col("length").alias("size"), kind.alias("kind"), reason.isNull().alias("accepted"), reason.alias("reason"), F.when(packed, F.col("verdict")).alias("verdict"))


def stream_intake(spark: SparkSession, path: str, wanted: str = "pdf", name: Column | None = None) -> DataFrame:
    """A folder's files, and those of the folders in it, as they arrive."""
    reader = spark.readStream.format("binaryFile").schema(ARRIVING).option("recursiveFileLookup", "true")
    return classified(reader.load(path), wanted, name)


def take_in(spark: SparkSession, path: str, table: str, progress: str, wanted: str = "pdf", name: Column | None = None) -> None:
    """Takes in what has arrived in `path` since the last call, and ends: rows go to table/batch=n, what was taken is kept in `progress`.

    A call that was broken off is made up for by the next: its batch is written anew in its own place, so
    that each file is in the table once. A call that finds nothing new writes nothing. Spark's file
    sources do not report empty files.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    listing = spark.sparkContext.defaultParallelism * LISTING_TASKS
    with settings(spark, {"spark.sql.files.openCostInBytes": OPENING, "spark.sql.sources.parallelPartitionDiscovery.parallelism": listing}):
        stream = stream_intake(spark, path, wanted, name).writeStream.foreachBatch(write).option("checkpointLocation", progress)
        stream.trigger(availableNow=True).start().awaitTermination()


CHANGE = "doc_id long, kind string, page int, item int, seq long, text string"


_change = Row("doc_id", "kind", "page", "item", "seq", "text")


class EditState(StatefulProcessor):
    """Per document its edits and the last seq taken, as one value: read once and written once a batch.

    A batch's events count by their seq, whatever their order. Those without a seq, or with one at or below
    the last seq of an earlier batch, are late: they change nothing and come out as such. What comes out
    besides is the difference that the batch makes: a set for each item that was edited and is still, a
    clear for each that no longer is. Of a batch's events only the last of each item and page are held.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.document = handle.getValueState("document", "last long, edits array<struct<page:int,item:int,seq:long,text:string>>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        was = self.document.get()
        last, edits = (was[0], {(page, item): (seq, text) for page, item, seq, text in was[1]}) if was else (None, {})
        newest, discarded, reverted, applied = None, None, {}, {}
        for _, seq, kind, page, item, text in rows:
            if seq is None or (last is not None and seq <= last):
                yield _change(key[0], "late", page, item, seq, text)
                continue
            newest = seq if newest is None else max(newest, seq)
            if kind == "discard":
                discarded = seq if discarded is None else max(discarded, seq)
            elif kind == "revert" and page is not None:
                reverted[page] = max(reverted.get(page, seq), seq)
            elif kind == "apply" and seq >= applied.get((page, item), (seq,))[0]:
                applied[page, item] = seq, text
        if newest is None:
            return
        cleared = {page: max(x for x in (discarded, reverted.get(page)) if x is not None) for page, _ in (*edits, *applied) if discarded is not None or page in reverted}
        for page, item in [at for at in edits if at[0] in cleared]:
            del edits[page, item]
            yield _change(key[0], "clear", page, item, cleared[page], None)
        for (page, item), (seq, text) in applied.items():
            if seq > max(-1, cleared.get(page, -1)):
                edits[page, item] = seq, text
                yield _change(key[0], "set", page, item, seq, text)
        self.document.update((newest, [(*at, *edit) for at, edit in edits.items()]))

    def close(self) -> None:
        pass


def _typed(events: DataFrame) -> DataFrame:
    return events.select(F.col("doc_id").cast("long"), F.col("seq").cast("long"), "kind", F.col("page").cast("int"), F.col("item").cast("int"), "text")


def stream_edits(events: DataFrame) -> DataFrame:
    """A stream of edit events(doc_id, seq, kind, page, item, text) -> CHANGE rows: set, clear and late; needs the RocksDB state store."""
    return _typed(events).groupBy("doc_id").transformWithState(EditState(), CHANGE, "Append", "None")


#: What is kept of an edit log between batches: a row for each item with an edit, and one for each document with the last seq taken.
KEPT = "doc_id long, page int, item int, edit struct<seq:long,text:string>, last long"


def told_late(events: DataFrame, kept: DataFrame) -> DataFrame:
    """A batch's events with `late`: without a seq, or at or below the last seq of an earlier batch."""
    last = kept.filter("last IS NOT NULL").select(F.col("doc_id").alias("_doc"), "last")
    rows = events.join(last, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return rows.withColumn("late", F.col("seq").isNull() | F.coalesce(F.col("seq") <= F.col("last"), F.lit(False))).drop("_doc", "last")


def met_edits(told: DataFrame, kept: DataFrame) -> DataFrame:
    """A batch's events in time and what is kept -> a row for each item of either: `was`, `cleared` and `now`, its edit before, the seq that cleared its page, its edit after, `is_set` if that is new, and `last`, as far as the item knows it.

    The rules are those of EditState; of one item's edits with the same seq the one of largest text counts.
    """
    kind, seq = F.col("kind"), F.col("seq")
    applied, reverted = F.when(kind == "apply", F.struct("seq", "text")), F.when((kind == "revert") & F.col("page").isNotNull(), seq)
    events = told.filter("NOT late").select("doc_id", "page", "item", applied.alias("applied"), F.when(kind == "discard", seq).alias("discarded"), reverted.alias("reverted"), seq.alias("last"))
    both = events.unionByName(kept.withColumnRenamed("edit", "was"), allowMissingColumns=True)
    items = both.groupBy("doc_id", "page", "item").agg(*(F.max(c).alias(c) for c in ("was", "applied", "discarded", "reverted", "last")))
    of_document, of_page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page")
    items = items.withColumn("cleared", F.greatest(F.max("discarded").over(of_document), F.max("reverted").over(of_page)))
    items = items.withColumn("is_set", F.coalesce(F.col("applied.seq") > F.greatest(F.lit(-1), "cleared"), F.lit(False)))
    now = F.when(F.col("is_set"), F.col("applied")).when(F.col("cleared").isNull(), F.col("was"))
    return items.select("doc_id", "page", "item", "was", "cleared", "is_set", now.alias("now"), "last")


def keep_edits(spark: SparkSession, events: DataFrame, table: str, progress: str) -> None:
    """Takes the events that have come since the last call, and ends: changes are added to table/batch=n, a folder per kind; what is kept and what was taken lie in `progress`.

    A batch is joins and aggregates over its events and what is kept, without Python or a state store, so
    it costs in proportion to both; a stream that never ends and has small batches is better off with
    stream_edits. What batch n keeps is written beside what it reads, in the place of what batch n - 2 kept,
    so a call that was broken off is made up for by the next, with each change in the table once.
    """

    def write(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        kept = session.read.schema(KEPT).parquet(f"{progress}/kept/{(batch - 1) % 2}") if batch else session.createDataFrame([], KEPT)
        told = told_late(rows, kept)
        met = met_edits(told, kept).persist(StorageLevel.DISK_ONLY)
        late = told.filter("late").select("doc_id", F.lit("late").alias("kind"), "page", "item", "seq", "text")
        clear = met.filter("was IS NOT NULL AND cleared IS NOT NULL").select("doc_id", F.lit("clear").alias("kind"), "page", "item", F.col("cleared").alias("seq"), F.lit(None).cast("string").alias("text"))
        set_ = met.filter("is_set").select("doc_id", F.lit("set").alias("kind"), "page", "item", "now.seq", "now.text")
        late.unionByName(clear).unionByName(set_).write.mode("overwrite").partitionBy("kind").parquet(f"{table}/batch={batch}")
        items = met.filter("now IS NOT NULL").select("doc_id", "page", "item", F.col("now").alias("edit"))
        last = met.groupBy("doc_id").agg(F.max("last").alias("last")).filter("last IS NOT NULL")
        items.unionByName(last, allowMissingColumns=True).write.mode("overwrite").parquet(f"{progress}/kept/{batch % 2}")
        met.unpersist()

    log = _typed(events).writeStream.foreachBatch(write).option("checkpointLocation", progress)
    log.trigger(availableNow=True).start().awaitTermination()


def edits_of(changes: DataFrame) -> DataFrame:
    """CHANGE rows -> each item's edit as it stands: its last change, if that is a set."""
    last = changes.filter("kind != 'late'").groupBy("doc_id", "page", "item").agg(F.max(F.struct("seq", "kind", "text")).alias("x"))
    return last.filter("x.kind = 'set'").select("doc_id", "page", "item", "x.seq", "x.text")


def late_events(changes: DataFrame) -> DataFrame:
    """CHANGE rows -> per document how many events came too late, and the first and last of them."""
    return changes.filter("kind = 'late'").groupBy("doc_id").agg(F.count("*").alias("late"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
