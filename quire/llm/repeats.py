"""Suffix-array deduplication of exact repeated passages, built column by column.

Every string of `length` bytes has an anchor: its k-byte piece with the smallest hash, the leftmost of
equals. Neighbouring strings share anchors, so a document becomes runs of strings around anchors, and
equal strings have equal anchors at the same place. Runs whose anchor occurs once are dropped. The
others are laid under each other by their anchors, and a shard of them is built column-wise: each round
inserts one symbol of every row in front of its suffix, which updates the order of the suffixes (that
column's part of the collection's Burrows-Wheeler transform) and the common prefixes of neighbours.
Columns, orders and prefixes go through sequential files of the task. Neighbours with a common prefix
of `length` or more are repeats; of each such class the earliest stays.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.shingles import in_chunks, mixed

#: Rows without a doc_id come last.
NO_ID = (1 << 63) - 1
#: No byte of UTF-8 text has this value.
PAD = 255
_BASE = 0x9DDFEA08EB382D69
_PLACE = (1 << 24) - 1


def _piece_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte pieces, from those of power-of-two spans."""
    with np.errstate(over="ignore"):
        h, step = np.zeros(len(data) - k + 1, np.uint64), data.astype(np.uint64) + np.uint64(1)
        span, base, weight, done = 1, _BASE, 1, 0
        while True:
            if k & span:
                h += step[done : done + len(h)] * np.uint64(weight)
                weight, done = weight * base % (1 << 64), done + span
            if span * 2 > k:
                return mixed(h)
            step = step[:-span] + step[span:] * np.uint64(base)
            base, span = base * base % (1 << 64), span * 2


def anchor_runs(data: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Texts laid end to end -> per run of strings with one anchor: text, anchor's hash and place, first and last start."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none, none
    h = _piece_hashes(data, k)
    low = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - k + 1, 1
    while size * 2 <= width:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < width:
        low = np.minimum(low[: size - width], low[width - size :])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(np.arange(len(low)) + length <= np.cumsum(sizes)[owner[: len(low)]])
    if not len(start):
        return none, none.astype(np.uint64), none, none, none
    low = low[start]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1)))
    first, last = start[new], start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
    place = (low[new] & np.uint64(_PLACE)).astype(np.int64)
    text = owner[first]
    base = (np.cumsum(sizes) - sizes)[text]
    return text, h[place], place - base, first - base, last - base


def _runs_of(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """anchor_runs of texts of any size, taken in stretches that overlap by length - 1 bytes."""
    if sum(map(len, texts)) < _PLACE:
        return anchor_runs(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64), length, k)
    parts, stride = [], 1 << 22
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), stride):
            cut = np.frombuffer(t[at : at + stride + length - 1], np.uint8)
            own, anchor, place, first, last = anchor_runs(cut, np.array([len(cut)]), length, k)
            parts.append((own + i, anchor, place + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return place << 24 | (place - first) << 12 | (last - first)


def _unpacked(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor's place, first and last start."""
    place = run >> 24
    first = place - (run >> 12 & 4095)
    return place, first, first + (run & 4095)


def repeated_anchors(docs: DataFrame, length: int, k: int, anchors: int) -> DataFrame:
    """docs(_id, _key, text) -> (_id, _key, run) of the runs whose anchor occurs again.

    Candidates are found by counting anchors, in buckets of about 2**20 of them. An anchor that a chunk
    of texts holds more than once is known to be repeated: its runs go on at once, and one entry stands
    for them where anchors are counted, so a frequent one is no burden.
    """
    buckets = max(8, anchors // (1 << 20))
    schema = pa.schema([("bucket", pa.int64())] + [(name, pa.binary()) for name in ("ids", "keys", "counts", "anchors", "runs", "others")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in in_chunks(batches, most=1 << 22):
            own, anchor, place, first, last = _runs_of(texts, length, k)
            ids, keys, run = np.array(rest["_id"], np.int64), np.array(rest["_key"], np.int64), _packed(place, first, last)
            values, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
            solo = counts[inverse] == 1
            bucket, bucket_of = (anchor % np.uint64(buckets)).astype(np.int64), (values % np.uint64(buckets)).astype(np.int64)
            place_of = np.where(solo, bucket, -1)  # -1: repeated in this chunk
            mine, again = np.argsort(place_of, kind="stable"), np.flatnonzero(counts > 1)
            again = again[np.argsort(bucket_of[again], kind="stable")]
            names = np.unique(np.concatenate((place_of, bucket_of[again])))
            cuts = [np.searchsorted(x, names, side) for x in (place_of[mine], bucket_of[again]) for side in ("left", "right")]
            rows = []
            for b, i, j, i2, j2 in zip(names.tolist(), *cuts, strict=True):
                part, others = mine[i:j], values[again[i2:j2]]
                name = b if b >= 0 else buckets + abs(hash((int(ids[0]), len(ids)))) % (1 << 40)
                doc, each = np.unique(own[part], return_counts=True)
                parts = (ids[doc], keys[doc], each.astype(np.uint32), anchor[part], run[part], others)
                rows.append({"bucket": name} | {c: x.tobytes() for c, x in zip(schema.names[1:], parts, strict=True)})
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        def whole(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(rows[name]), kind)

        anchor, others, each = whole("anchors", np.uint64), whole("others", np.uint64), whole("counts", np.uint32)
        out = {"_id": np.repeat(whole("ids", np.int64), each), "_key": np.repeat(whole("keys", np.int64), each), "run": whole("runs", np.int64)}
        if rows.bucket.iloc[0] < buckets:
            _, inverse, counts = np.unique(np.concatenate((anchor, others, others)), return_inverse=True, return_counts=True)
            keep = np.flatnonzero(counts[inverse[: len(anchor)]] > 1)
            out = {name: v[keep] for name, v in out.items()}
        return pd.DataFrame(out)

    sent = docs.select("_id", "_key", "text").mapInArrow(send, "bucket long, ids binary, keys binary, counts binary, anchors binary, runs binary, others binary")
    return sent.groupBy("bucket").applyInPandas(count, "_id long, _key long, run long")


def _later_starts(rows: pd.DataFrame, length: int, k: int) -> pd.DataFrame:
    """Runs with their bytes -> (_id, _key, from, to): the starts whose string also starts earlier."""
    m, left = len(rows), length - k
    place, first, last = _unpacked(rows.run.to_numpy())
    ids, keys = rows["_id"].to_numpy(), rows["_key"].to_numpy()
    age = np.empty(m, np.int32)
    age[np.lexsort((place, keys, ids))] = np.arange(m, dtype=np.int32)
    low, high = first - place + left, last - place + left  # columns of the valid starts
    sizes = (last - first + length).astype(np.int64)
    data = np.frombuffer(b"".join(rows.bytes), np.uint8)
    width = left + length
    table = np.full((width, m), PAD, np.uint8)
    row = np.repeat(np.arange(m), sizes)
    table[np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[row], row] = data
    later = np.zeros((left + 1, m), bool)
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as states:
        table[::-1].tofile(columns)  # in the order of the rounds
        del table, row, data
        columns.seek(0)
        np.arange(m, dtype=np.int32).tofile(states)
        np.zeros(m, np.int32).tofile(states)
        for column in range(width - 1, -1, -1):
            symbols = np.fromfile(columns, np.uint8, m)
            states.seek(0)
            order, common = np.fromfile(states, np.int32, m), np.fromfile(states, np.int32, m)
            transform = symbols[order]
            to = np.argsort(transform, kind="stable")
            prefix = np.zeros(m, np.int32)
            at = 0
            for c in np.bincount(transform, minlength=256):
                if c > 1:
                    where = to[at : at + c]
                    prefix[at + 1 : at + c] = np.minimum.reduceat(common[: where[-1] + 1], where[:-1] + 1) + 1
                at += c
            order, common = order[to], np.minimum(prefix, length)
            states.seek(0)
            order.tofile(states)
            common.tofile(states)
            if column <= left:
                heads = np.flatnonzero(common < length)
                ages = age[order]
                oldest = np.repeat(np.minimum.reduceat(ages, heads), np.diff(heads, append=m))
                hit = order[ages > oldest]
                later[column, hit] = (low[hit] <= column) & (column <= high[hit])
    flags = np.zeros((m, left + 3), np.int8)
    flags[:, 1:-1] = later.T
    edge = np.diff(flags, axis=1)
    r, c = np.nonzero(edge == 1)
    r2, c2 = np.nonzero(edge == -1)
    start = place[r] - left
    return pd.DataFrame({"_id": ids[r], "_key": keys[r], "from": start + c, "to": start + c2 - 1})


def drop_repeated_passages(docs: DataFrame, *, length: int = 100, k: int = 32, runs_per_shard: int = 60000) -> DataFrame:
    """docs(doc_id, text, ...) -> docs and n_bytes, n_removed, n_spans, kept (binary).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id,
    or earlier in the same document. Strings are judged on the input, overlaps count, and none crosses
    documents. A null text is empty; texts shorter than `length` are kept whole. Rows with a null
    doc_id come last; of equal texts the row with the smallest doc_id is the first, and rows equal in
    doc_id and text are one document and fare alike; rows that share a doc_id but not a text are
    ordered by a hash. Empty tables stay empty; other columns pass through, whatever they are called,
    but for those named like the four new ones, which these replace. k is at most length, and length
    less than k + 4096.
    """
    if not 0 < k <= length < k + 4096:
        raise ValueError("k must be 1 to length, and length less than k + 4096")
    body = F.coalesce("text", F.lit(""))
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    others = [c for c in docs.columns if c not in ("doc_id", "text", *new)]
    rest = F.struct(*others) if others else F.lit(None)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(body).alias("_key"), "text", rest.alias("_rest"))
    keys = base.select("_id", "_key", F.xxhash64(F.lit(1), body).alias("_key2"), F.octet_length(body).cast("long").alias("_n")).distinct()
    keys = stored(keys, "passage-keys")
    firsts = keys.groupBy("_key", "_key2", "_n").agg(F.min("_id").alias("_rep"))
    keys = stored(keys.join(firsts, ["_key", "_key2", "_n"]), "passage-classes")
    size = keys.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    runs = stored(repeated_anchors(base, length, k, 2 * size // (length - k + 2)), "passage-runs")
    reps = keys.filter("_id = _rep").select("_id", "_key").distinct()
    shards = max(8, -(-runs.count() // runs_per_shard))
    wanted = runs.groupBy("_id", "_key").agg(F.collect_set("run").alias("runs")).join(reps, ["_id", "_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in in_chunks(batches, most=1 << 21):
            rows, first_of = [], {}
            for i, key, found, t in sorted(zip(rest["_id"], rest["_key"], rest["runs"], texts, strict=True), key=lambda x: x[:2]):
                runs = np.sort(np.array(found, np.int64))  # in the order of their places
                for run, place, first, last in zip(runs.tolist(), *map(np.ndarray.tolist, _unpacked(runs)), strict=True):
                    stretch = t[first : last + length]
                    own = first_of.setdefault((run & _PLACE, stretch), (i, key, run))
                    if own == (i, key, run):
                        rows.append((zlib.crc32(t[place : place + k]) % shards, i, key, run, stretch))
                    else:  # all its strings start later than those of its equal: it need not travel
                        rows.append((-1 - i % shards, i, key, run, None))
            if rows:
                cols = [pa.array(c, pa.binary() if j == 4 else pa.int64()) for j, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "_id", "_key", "run", "bytes"])

    # the texts are dealt by the same keys here and in the last join, so that Spark does it once for both
    pieces = base.select("_id", "_key", "text").join(wanted.hint("merge"), ["_id", "_key"]).mapInArrow(cut, "shard long, _id long, _key long, run long, bytes binary")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["shard"].iloc[0] < 0:
            _, first, last = _unpacked(rows.run.to_numpy())
            return pd.DataFrame({"_id": rows["_id"], "_key": rows["_key"], "from": first, "to": last})
        rows = rows.drop_duplicates(["_id", "_key", "run"])  # rows equal in doc_id and text are one document
        place, first, last = _unpacked(rows.run.to_numpy())
        rows = rows.assign(place=place, first=first, last=last, around=rows.run & _PLACE).sort_values(["_id", "_key", "place"])
        copy = rows.duplicated(["around", "bytes"]).to_numpy()  # of equal stretches around an anchor the first one is built; all strings of the others start later
        later = _later_starts(rows[~copy].reset_index(drop=True), length, k)
        return pd.concat([later, rows.loc[copy, ["_id", "_key", "first", "last"]].rename(columns={"first": "from", "last": "to"})])

    later = pieces.groupBy("shard").applyInPandas(build, "_id long, _key long, from long, to long")
    spans = later.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("_spans"))
    verdicts = keys.join(spans, ["_id", "_key"], "left").select("_id", "_key", "_n", (F.col("_id") != F.col("_rep")).alias("_copy"), "_spans")

    @F.pandas_udf("kept binary, removed long, spans long")
    def apply(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(text, spans, strict=True):
            if found is None or not len(found):
                out.append((None, 0, 0))
                continue
            data, kept, at, n = t.encode(), [], 0, 0
            for s in found:
                if s["from"] > at or not n:
                    n += 1
                    kept.append(data[at : s["from"]])
                at = max(at, s["to"] + length)
            kept.append(data[at:])
            kept = b"".join(kept)
            out.append((kept, len(data) - len(kept), n))
        return pd.DataFrame(out, columns=["kept", "removed", "spans"])

    out = base.join(verdicts.hint("merge"), ["_id", "_key"])
    gone = F.col("_copy") & (F.col("_n") >= length)
    touched = ~gone & F.col("_spans").isNotNull()
    out = out.withColumn("_cut", apply(F.when(touched, F.col("text")), F.when(touched, F.col("_spans"))))
    doc_id = F.when(F.col("_id") != NO_ID, F.col("_id")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return out.select(
        *[doc_id if c == "doc_id" else F.col(c) if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns if c not in new], F.col("_n").alias("n_bytes"),
        F.when(gone, F.col("_n")).when(touched, F.col("_cut.removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(gone, 1).when(touched, F.col("_cut.spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.lit(b"")).when(touched, F.col("_cut.kept")).otherwise(body.cast("binary")).alias("kept"),
    )
