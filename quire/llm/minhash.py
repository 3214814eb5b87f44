"""Near-duplicates by SuperMinHash, banding, verification and union-find.

Every shingle carries a random permutation of the signature's places and takes them one rank a round,
with a fraction of its own in each: a place belongs to the shingle that comes first. The places of one
shingle are all different, so they cover the signature more evenly than independent hashes would, and a
text is done with the round that fills its last place: most texts after a few.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import connected_components, stored, whole_runs
from quire.llm.ngram_join import _linked_across, _set_key
from quire.llm.shingles import in_chunks, mixed, shingle_sets

#: Rows a band and bands. At a similarity of 0.85 no band of two texts agrees once in 2.3 million pairs, at 0.8 once in 29,000.
ROWS, BANDS = 5, 26


class Grouped(NamedTuple):
    """documents: doc_id, n_shingles, class_id, component_id, one per row. links: a, b (class ids), overlap, a_size, b_size."""

    documents: DataFrame
    links: DataFrame


def _rounds(elements: np.ndarray, owner: np.ndarray, sets: int, places: int) -> np.ndarray:
    """(sets, places): the least rank << 48 | fraction of any element of a set at each place."""
    never = np.iinfo(np.uint64).max
    out = np.full(sets * places, never, np.uint64)
    left = np.arange(len(elements))
    order = np.zeros((0, places), np.uint8)
    for rank in range(places):
        with np.errstate(over="ignore"):
            draw = mixed(elements[left] + np.uint64(rank + 1) * np.uint64(0x9E3779B97F4A7C15))
            fraction = mixed(draw ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(16)
        swap = rank + ((draw >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
        if rank:  # one step of every element's shuffle
            rows = np.arange(len(left))
            place = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[:, rank]
            order[:, rank] = place
        else:
            place = swap
        at = owner[left] * places + place
        empty = out[at] >> np.uint64(48) >= np.uint64(rank) if rank else np.ones(len(left), bool)
        np.minimum.at(out, at[empty], np.uint64(rank) << np.uint64(48) | fraction[empty])
        go_on = (out.reshape(sets, places) == never).any(axis=1)[owner[left]]
        if not go_on.any():
            break
        if rank:
            order = order[go_on]
        else:
            order = np.tile(np.arange(places, dtype=np.uint8), (int(go_on.sum()), 1))
            rows = np.arange(len(order))
            first = swap[go_on]
            order[rows, first] = 0
            order[rows, 0] = first
        left = left[go_on]
    return out.reshape(sets, places)


def super_minhash(sets: list[np.ndarray], places: int, most: int = 1 << 16) -> np.ndarray:
    """Signatures (sets x places, at most 256) of sets of 64-bit hashes; an empty set has all ones. Texts are taken together up to `most` hashes, a larger one alone."""
    out, at = np.empty((len(sets), places), np.uint64), 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= most):
            size += len(sets[to])
            to += 1
        if to == at + 1 and size > most:  # in pieces: the least of each is the least of all
            out[at] = np.min([_rounds(sets[at][i : i + most], np.zeros(min(most, size - i), np.int64), 1, places)[0] for i in range(0, size, most)], axis=0)
        else:
            out[at:to] = _rounds(np.concatenate(sets[at:to]), np.repeat(np.arange(to - at), [len(x) for x in sets[at:to]]), to - at, places)
        at = to
    return out


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(sets x bands) of 64-bit hashes, different from band to band."""
    bands = signatures.shape[1] // rows
    cut = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), cut.shape[:2]).copy()
        for i in range(rows):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return out.view(np.int64)


def signed_sets(docs: DataFrame, n: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, k1, k2, bands, prints): size and 128-bit key of each row's shingle set, its band hashes, and two bytes of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in in_chunks(batches, most=1 << 21):
            sets = list(shingle_sets(texts, n))
            signatures = super_minhash(sets, ROWS * BANDS)
            keys = list(zip(*((len(s), *_set_key(s)) for s in sets), strict=True))
            bands = pa.FixedSizeListArray.from_arrays(pa.array(band_hashes(signatures, ROWS).ravel()), BANDS).cast(pa.list_(pa.int64()))
            prints = pa.array([x.tobytes() for x in mixed(signatures).astype(np.uint16)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rest["doc_id"], pa.int64()), *(pa.array(c, pa.int64()) for c in keys), bands, prints], ["doc_id", "n", "k1", "k2", "bands", "prints"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, prints binary")


def whole_sets(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """reps(doc_id, n, k1, k2) -> (doc_id, n, tokens): the whole shingle sets of these texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in in_chunks(batches):
            rows = [(i, len(s), s.view(np.int64)) for i, a, b, s in zip(rest["doc_id"], rest["k1"], rest["k2"], shingle_sets(texts, n), strict=True) if _set_key(s) == (a, b)]
            if rows:
                ids, sizes, sets = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "n", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(reps.select("doc_id", "k1", "k2"), "doc_id")
    return texts.mapInArrow(run, "doc_id long, n long, tokens array<long>").dropDuplicates(["doc_id"])


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) whose whole sets link: a, b, overlap, a_size, b_size."""
    for side in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("n").alias(f"{side}_size"), F.col("tokens").alias(f"{side}_tokens")), side)
    both = pairs.withColumn("overlap", F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long"))
    return both.filter(F.col("overlap") * (100 + percent) >= percent * (F.col("a_size") + F.col("b_size"))).select("a", "b", "overlap", "a_size", "b_size")


def _heads(buckets: DataFrame, turn: int, percent: int) -> DataFrame:
    """buckets(band, doc_id, n) -> pairs (a, b): each text b and the head a that it shares most bands with. A bucket's head is one of its texts, dealt anew each turn."""
    u = F.xxhash64("doc_id", F.lit(turn))
    heads = buckets.groupBy("band").agg(F.min(F.struct(u.alias("u"), "doc_id", "n")).alias("h"), F.count("*").alias("k")).filter("k > 1").select("band", F.col("h.doc_id").alias("a"), F.col("h.n").alias("a_n"))
    near = buckets.join(heads, "band").filter((F.col("doc_id") != F.col("a")) & _sizes_fit(F.col("n"), F.col("a_n"), percent))
    shared = near.groupBy(F.col("doc_id").alias("b"), "a").agg(F.count("*").alias("bands"))
    return shared.groupBy("b").agg(F.min(F.struct(-F.col("bands"), "a")).alias("h")).select("h.a", "b")


def _dealt(rows: DataFrame, by: str, block: int) -> DataFrame:
    """rows(band, ...) dealt for comparison inside each band: blocks of about `block` rows by a hash of `by`, and a task for each pair of blocks, which gets both. Sorted by band and task; right: the second block's; both: one block with itself."""
    loads = rows.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").select("band", F.ceil(F.col("k") / block).alias("blocks"))
    out = rows.join(loads, "band").withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    out = out.select(*rows.columns, task.alias("task"), (F.col("own") > F.col("other")).alias("right"), (F.col("own") == F.col("other")).alias("both"))
    return out.repartition("band", "task").sortWithinPartitions("band", "task", "right", by)


def crossing_pairs(members: DataFrame, percent: int, least_equal: float, block: int = 1024, dense: int = 4) -> DataFrame:
    """members(band, g, low, high, prints) -> (a, b, band): pairs of groups that share a bucket and may link; or a band alone, where they are too many to be told.

    prints is null where a group has several texts in the bucket. Groups of one text whose signatures
    agree in less than least_equal of their places are no candidates. A task that finds more than `dense`
    pairs a row gives its bucket's band instead: such a bucket is compared by crossing_links.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["band", "task"], 1 << 14):
            band, task, g, low, high = (table[c].to_numpy() for c in ("band", "task", "g", "low", "high"))
            right, both = (table[c].to_numpy(zero_copy_only=False) for c in ("right", "both"))
            single = table["prints"].is_valid().to_numpy()
            prints = np.zeros((len(g), ROWS * BANDS), np.uint16)
            if single.any():
                prints[single] = np.frombuffer(b"".join(table["prints"].drop_null().to_pylist()), np.uint16).reshape(-1, ROWS * BANDS)
            starts = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (task[1:] != task[:-1])))
            ends = np.append(starts[1:], len(g))
            run = np.repeat(np.arange(len(starts)), ends - starts)
            later = ends[run] - np.arange(len(g)) - 1
            upto, at, found = np.cumsum(later), 0, [np.zeros((2, 0), np.int64)]
            while at < len(g):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 18), "right")))
                a = np.repeat(np.arange(at, to), later[at:to])
                b = np.arange(len(a)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to]) + a + 1
                fit = (both[a] | (right[a] != right[b])) & (g[a] != g[b]) & (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
                a, b = a[fit], b[fit]
                near = np.ones(len(a), bool)
                for i in range(0, len(a), 1 << 16):
                    x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                    near[i : i + (1 << 16)] = ~(single[x] & single[y]) | ((prints[x] == prints[y]).mean(axis=1) >= least_equal)
                found.append(np.stack([a[near], b[near]]))
                at = to
            a, b = np.concatenate(found, axis=1)
            many = np.bincount(run[a], minlength=len(starts)) > dense * (ends - starts)
            few = ~many[run[a]]
            pairs = np.unique(np.sort(np.stack([g[a[few]], g[b[few]]]), axis=0), axis=1)
            bands = np.unique(band[starts[many]])
            none = pa.nulls(len(bands), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(pairs[0]), none]), pa.concat_arrays([pa.array(pairs[1]), none]), pa.concat_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(bands)])], ["a", "b", "band"])

    return _dealt(members, "g", block).mapInArrow(compare, "a long, b long, band long").distinct()


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs (a, b) that connect all that the pairs connect, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(i)
    return np.array(kept, np.int64)


def crossing_links(rows: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """rows(band, doc_id, g) -> links between texts of different groups in a band: a, b, overlap, a_size, b_size.

    Whole sets are compared inside tasks, block by block, as products of 0-1 matrices; a task gives links
    that connect the groups it finds linked, fewer than its rows.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["band", "task"], block):
            keys = [table[c].to_numpy() for c in ("band", "task")]
            starts = np.flatnonzero(np.append(True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])))
            for lo, hi in zip(starts, np.append(starts[1:], len(keys[0])), strict=True):
                part = table.slice(lo, hi - lo).combine_chunks()
                doc, g, n = (part[c].to_numpy() for c in ("doc_id", "g", "n"))
                right, both = (part[c].to_numpy(zero_copy_only=False) for c in ("right", "both"))
                tokens = part["tokens"].combine_chunks()
                _, column, times = np.unique(tokens.flatten().to_numpy(), return_inverse=True, return_counts=True)
                row = np.repeat(np.arange(len(n)), np.diff(tokens.offsets.to_numpy()))
                shared = times[column] > 1
                row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
                order = np.argsort(column, kind="stable")
                row, column = row[order], column[order]
                overlap = np.zeros((len(n), len(n)), np.float32)
                for first in range(0, int(column.max(initial=-1)) + 1, 4096):
                    i, j = np.searchsorted(column, (first, first + 4096))
                    x = np.zeros((len(n), 4096), np.float32)
                    x[row[i:j], column[i:j] - first] = 1
                    overlap += x @ x.T
                near = np.triu(overlap * (100 + percent) >= percent * (n[:, None] + n[None, :]), 1) & (g[:, None] != g[None, :]) & (both[:, None] | (right[:, None] != right[None, :]))
                a, b = np.nonzero(near)
                if len(a):
                    kept = _spanning(g[a], g[b])
                    a, b = a[kept], b[kept]
                    a, b = np.where(doc[a] < doc[b], a, b), np.where(doc[a] < doc[b], b, a)
                    cols = (doc[a], doc[b], overlap[a, b].astype(np.int64), n[a], n[b])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "overlap", "a_size", "b_size"])

    dealt = _dealt(rows.join(sets, "doc_id").select("band", "doc_id", "g", "n", "tokens"), "doc_id", block)
    return dealt.mapInArrow(compare, "a long, b long, overlap long, a_size long, b_size long").dropDuplicates(["a", "b"])


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, turns: int = 4) -> Grouped:
    """docs(doc_id, text, ...) -> Grouped: texts whose sets of n-word shingles have a Jaccard of percent/100 or more are linked, and groups are what links connect.

    Words are runs without ASCII white space, A-Z lowered; a text with fewer than n words is one
    shingle; null and blank texts have none and link with nothing. Texts equal in shingles are one class,
    known by its smallest doc_id; component_id is the smallest doc_id reachable. A candidate shares one of
    26 bands of 5 places; links are confirmed on whole sets. Near copies first hang on heads of their
    buckets, in up to `turns` turns; then only what lies in different groups is compared: pair by pair
    where few share a bucket, and inside tasks, set against set, where many do. So links is a spanning
    set: it connects all classes of a group, and their number grows with the rows. Rows that share a doc_id are one node; a row with a null doc_id is counted but links with nothing and
    has a null component_id. Empty tables give empty results; other columns are ignored.
    """
    keys = stored(signed_sets(docs, n), "minhash-signed")
    named = keys.filter("doc_id is not null and n > 0")
    classes = stored(named.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("prints").alias("prints")), "minhash-classes")
    bands = classes.select(F.explode("bands").alias("band"), F.col("rep").alias("doc_id"), "n")
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x != y").select("band")
    buckets = stored(bands.join(shared, "band").distinct(), "minhash-buckets")
    reps = classes.join(buckets.select(F.col("doc_id").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "n", "k1", "k2")
    sets = stored(whole_sets(docs, reps, n), "minhash-sets")

    links = stored(_verified(_heads(buckets, 0, percent), sets, percent), "minhash-links")
    for turn in range(1, turns):
        linked = links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        more = stored(_verified(_heads(buckets.join(linked, "doc_id", "left_anti"), turn, percent), sets, percent), "minhash-links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
    gathered = connected_components(links.select("a", "b"))

    prints = classes.select(F.col("rep").alias("doc_id"), "prints")
    grouped = buckets.join(gathered.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("g", F.coalesce("component", "doc_id"))
    split = grouped.groupBy("band").agg(F.min("g").alias("x"), F.max("g").alias("y")).filter("x != y").select("band")
    members = grouped.join(split, "band").groupBy("band", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    members = members.join(prints, "doc_id").select("band", "g", "low", "high", F.when(F.col("doc_id") == F.col("last"), F.col("prints")).alias("prints"))
    spread = (percent / 100 * (1 - percent / 100) / (ROWS * BANDS)) ** 0.5
    pairs = stored(crossing_pairs(members, percent, percent / 100 - 5 * spread), "minhash-pairs")
    links = links.unionByName(stored(_linked_across(pairs.filter("band is null").select("a", "b"), sets, gathered, percent), "minhash-bridges"))
    dense = pairs.filter("band is not null").select("band")
    if not dense.isEmpty():
        links = links.unionByName(stored(crossing_links(grouped.join(dense, "band").select("band", "doc_id", "g"), sets, percent), "minhash-dense"))
    groups = connected_components(links.select("a", "b"))

    rows = keys.select("doc_id", "n", "k1", "k2").join(classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"], "left")
    rows = rows.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    rows = rows.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("component_id")), "rep", "left")
    return Grouped(rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id")), links)
