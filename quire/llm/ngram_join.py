"""N-gram Jaccard join by several global token orders.

Texts with equal shingle sets are one class, known by its smallest doc_id. A text links only if at
least t of its shingles occur elsewhere, so a count of unique shingles leaves few texts. Their shingles
are put in several global orders (rarest first, ties and frequency steps dealt differently); two texts
that link share a shingle within their prefixes under each order, so the orders' candidates are
intersected before whole sets are compared. Groups of near copies are first gathered around their
least altered text; then only pairs across what is gathered so far are candidates, so that no group
gives all its pairs and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import connected_components, stored
from quire.llm.shingles import in_chunks, mixed, shingle_sets


class Joined(NamedTuple):
    """documents: doc_id, n_shingles, class_id, component_id, one per row. links: a, b (class ids), overlap, a_size, b_size."""

    documents: DataFrame
    links: DataFrame


def _set_key(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mixed(s).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)).astype(np.int64))


def shingle_keys(docs: DataFrame, n: int, sampled: float) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, k1, k2, sample): size and 128-bit key of each row's shingle set, and its sampled shingles.

    Shingles are sampled by their hash, so a shingle is in the samples of all rows that hold it or of none.
    """
    bar = np.uint64(int(sampled * 65536))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in in_chunks(batches, most=1 << 21):
            keys, samples = [], []
            for s in shingle_sets(texts, n):
                keys.append((len(s), *_set_key(s)))
                samples.append(s[s >> np.uint64(48) < bar])
            offsets = np.cumsum([0, *map(len, samples)])
            sample = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(samples).view(np.int64)))
            cols = list(zip(*keys, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(rest["doc_id"], pa.int64()), *(pa.array(c, pa.int64()) for c in cols), sample], ["doc_id", "n", "k1", "k2", "sample"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sample array<long>")


def _least(n: Column, percent: int) -> Column:
    """The fewest shingles of a set of n that a linked set shares."""
    return F.floor((n * percent + 99) / 100).cast("long")


def unique_counts(keys: DataFrame) -> DataFrame:
    """(k1, unique): how many of the sampled shingles of the sets with that key are in no other set.

    Counted by Spark's aggregates alone: a frequent shingle is combined before it is sent, and the rows
    that leave are one per shingle, whatever the number of documents or partitions.
    """
    rows = keys.filter("doc_id is not null").select("k1", F.explode("sample").alias("token"))
    own = rows.groupBy("token").agg(F.min("k1").alias("k1"), F.max("k1").alias("last")).filter("k1 = last")
    return own.groupBy("k1").agg(F.count("*").alias("unique"))


def shared_shingles(docs: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """reps(doc_id, n, k1, k2) -> (doc_id, n, c, tokens): of the texts with enough shared shingles, those, rarest first.

    c is how many; a text's other shingles are in no other text of reps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in in_chunks(batches):
            rows = [(i, s.view(np.int64)) for i, a, b, s in zip(rest["doc_id"], rest["k1"], rest["k2"], shingle_sets(texts, n), strict=True) if _set_key(s) == (a, b)]
            if rows:
                ids, sets = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(reps.select("doc_id", "k1", "k2").hint("merge"), "doc_id")
    rows = texts.mapInArrow(run, "doc_id long, tokens array<long>").select("doc_id", F.explode("tokens").alias("token"))
    rows = stored(rows, "ngram-tokens")
    common = rows.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    lists = rows.join(common, "token").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("f", "token"))).alias("t")).join(reps.select("doc_id", "n"), "doc_id")
    return lists.withColumn("c", F.size("t").cast("long")).filter(F.col("c") >= _least(F.col("n"), percent))


def _orders(lists: DataFrame, percent: int) -> DataFrame:
    """Adds each order's prefix of shared shingles; in every order the unshared ones come first."""
    long = (F.col("c") - _least(F.col("n"), percent) + 1).cast("int")
    second = F.sort_array(F.transform("t", lambda x: F.struct(F.floor(F.log2(x["f"])).cast("int").alias("s"), F.xxhash64(x["token"]).alias("h"), x["token"].alias("token"))))
    return lists.select(
        "doc_id", "n", "c", F.transform("t", lambda x: x["token"]).alias("tokens"),
        F.array(F.transform(F.slice("t", 1, long), lambda x: x["token"]), F.transform(F.slice(second, 1, long), lambda x: x["token"])).alias("prefixes"),
    )


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    na, nb, least = F.col(f"{a}.n"), F.col(f"{b}.n"), F.least(F.col(f"{a}.c"), F.col(f"{b}.c"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (least * (100 + percent) >= percent * (na + nb))


def _verified(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) that link: a, b, overlap, a_size, b_size. Only the side b is moved once per pair."""
    right = pairs.join(lists.select(F.col("doc_id").alias("b"), F.col("n").alias("b_size"), F.col("tokens").alias("b_tokens"), F.col("prefixes").alias("b_prefixes")), "b")
    both = right.join(lists.select(F.col("doc_id").alias("a"), F.col("n").alias("a_size"), F.col("tokens").alias("a_tokens"), F.col("prefixes").alias("a_prefixes")), "a")
    passes = [F.arrays_overlap(F.col("a_prefixes")[k], F.col("b_prefixes")[k]) for k in (0, 1)]
    both = both.filter(passes[0] & passes[1]).withColumn("overlap", F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long"))
    return both.filter(F.col("overlap") * (100 + percent) >= percent * (F.col("a_size") + F.col("b_size"))).select("a", "b", "overlap", "a_size", "b_size")


def _stars(free: DataFrame, turn: int, percent: int) -> DataFrame:
    """free (rows of lists) -> pairs (a, b): each text and the head that it shares most prefix shingles with.

    A shingle's head is one of its texts: the least altered in the first turn, then any by a hash, so
    that a text that links with nobody can't stand before the others for ever.
    """
    u = F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("n") - F.col("c")
    post = free.select(F.explode(F.col("prefixes")[0]).alias("token"), "doc_id", "n", "c", u.alias("u"))
    heads = post.groupBy("token").agg(F.min(F.struct("u", "doc_id", "n", "c")).alias("h"), F.count("*").alias("k")).filter("k > 1").select("token", "h.*")
    near = post.alias("x").join(heads.alias("h"), "token").filter((F.col("x.doc_id") != F.col("h.doc_id")) & _sizes_fit("x", "h", percent))
    shared = near.groupBy(F.col("x.doc_id").alias("b"), F.col("h.doc_id").alias("a")).agg((-F.count("*")).alias("s"), F.min("h.u").alias("u"))
    return shared.groupBy("b").agg(F.min(F.struct("s", "u", "a")).alias("h")).select(F.col("h.a").alias("a"), "b")


def _linked_across(pairs: DataFrame, lists: DataFrame, gathered: DataFrame, percent: int, block: int = 512, most_asked: int = 2048) -> DataFrame:
    """pairs(a, b) of groups -> a link between their texts, if there is any: a, b, overlap, a_size, b_size.

    The texts of the smaller group are held against the larger one block by block; a group of any size
    is so many blocks, and one that many ask is dealt in as many copies. A pair of groups gives one link.
    """
    members = lists.select("doc_id", "n", "tokens").join(gathered, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", "tokens", F.coalesce("component", "doc_id").alias("g"))
    sizes = stored(members.groupBy("g").agg(F.count("*").alias("size")), "ngram-sizes")
    both = pairs.join(sizes.select(F.col("g").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("g").alias("b"), F.col("size").alias("sb")), "b")
    asking = F.when(F.struct("sa", "a") <= F.struct("sb", "b"), F.struct(F.col("a").alias("g"), F.col("b").alias("target"), F.col("sa").alias("size"), F.col("sb").alias("room"))).otherwise(F.struct(F.col("b").alias("g"), F.col("a").alias("target"), F.col("sb").alias("size"), F.col("sa").alias("room")))
    ask = stored(both.select(asking.alias("x")).select("x.*"), "ngram-asks")
    load = ask.groupBy("target").agg(F.sum("size").alias("load"), F.first("room").alias("room"))
    load = load.select("target", F.ceil(F.col("load") / most_asked).alias("chunks"), F.ceil(F.col("room") / block).alias("blocks"))
    spread = ask.join(load, "target").join(members, "g").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = members.join(load, F.col("g") == F.col("target")).withColumn("blk", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    spread = spread.select(F.col("target").alias("q_target"), F.col("blk").alias("q_blk"), F.col("chunk").alias("q_chunk"), F.col("g").alias("q_g"), F.col("doc_id").alias("q_doc"), F.col("n").alias("q_n"), F.col("tokens").alias("q_tokens"))

    def compare(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(near):
            near = near.sort_values("doc_id")
            tokens = np.concatenate(near.tokens.to_numpy())
            owner = np.repeat(np.arange(len(near)), near.tokens.map(len))
            order = np.argsort(tokens, kind="stable")
            tokens, owner, sizes, ids = tokens[order], owner[order], near.n.to_numpy(), near.doc_id.to_numpy()
            linked = set()
            for q in asked.sort_values(["q_g", "q_doc"]).itertuples():
                if q.q_g in linked:
                    continue
                lo, hi = np.searchsorted(tokens, q.q_tokens, "left"), np.searchsorted(tokens, q.q_tokens, "right")
                each = hi - lo
                at = np.repeat(lo - np.cumsum(each) + each, each) + np.arange(each.sum())
                overlap = np.bincount(owner[at], minlength=len(near))
                hit = np.flatnonzero(overlap * (100 + percent) >= percent * (sizes + q.q_n))
                if len(hit):
                    h = hit[0]
                    linked.add(q.q_g)
                    out.append((q.q_g, q.q_target, min(q.q_doc, ids[h]), max(q.q_doc, ids[h]), overlap[h], *((q.q_n, sizes[h]) if q.q_doc < ids[h] else (sizes[h], q.q_n))))
        return pd.DataFrame(out, columns=["g", "target", "a", "b", "overlap", "a_size", "b_size"]).astype("int64")

    sides = spread.groupBy("q_target", "q_blk", "q_chunk").cogroup(held.select("target", "blk", "chunk", "doc_id", "n", "tokens").groupBy("target", "blk", "chunk"))
    found = sides.applyInPandas(compare, "g long, target long, a long, b long, overlap long, a_size long, b_size long")
    return found.groupBy("g", "target").agg(F.min(F.struct("a", "b", "overlap", "a_size", "b_size")).alias("x")).select("x.*")


def ngram_jaccard_join(docs: DataFrame, *, n: int = 5, percent: int = 80, turns: int = 6) -> Joined:
    """docs(doc_id, text, ...) -> Joined: texts whose sets of n-word shingles have a Jaccard of percent/100 or more link.

    Words are runs without ASCII white space, A-Z lowered; a text with fewer than n words is one
    shingle; null and blank texts have none and link with nothing. component_id is the smallest
    doc_id reachable over links. Rows that share a doc_id are one node of the graph; a row with a
    null doc_id is counted but links with nothing and has a null component_id. Empty tables give
    empty results; other columns are ignored. links is a spanning set: it holds links that connect all
    classes of a component, not every pair, and at most one between two groups of near copies. Near
    copies gather in up to `turns` turns; what is still single is compared the exact way.
    """
    keys = stored(shingle_keys(docs, n, min(1.0, 1.6 * (1 - percent / 100))), "ngram-keys")
    named = keys.filter("doc_id is not null and n > 0")
    classes = stored(named.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "ngram-classes")
    maybe = classes.join(unique_counts(keys), "k1", "left").filter(F.coalesce("unique", F.lit(0)) <= F.col("n") - _least(F.col("n"), percent))
    reps = stored(maybe.select(F.col("rep").alias("doc_id"), "n", "k1", "k2"), "ngram-reps")
    lists = stored(_orders(shared_shingles(docs, reps, n, percent), percent), "ngram-lists")

    inner = F.col("c") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1  # of a pair, the smaller text's prefix is shorter

    def posted(order: int) -> DataFrame:
        return lists.select(F.posexplode(F.col("prefixes")[order]).alias("at", "token"), "doc_id", "n", "c", inner.alias("inner")).withColumn("inner", F.col("at") < F.col("inner")).drop("at")

    links = stored(_verified(_stars(lists, 0, percent), lists, percent), "ngram-stars")
    for turn in range(1, turns):
        nodes = links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        more = stored(_verified(_stars(lists.join(nodes, "doc_id", "left_anti"), turn, percent), lists, percent), "ngram-stars")
        if more.isEmpty():
            break
        links = links.unionByName(more)
    gathered = connected_components(links.select("a", "b"))

    fits = F.floor(F.col("c") * (100 + percent) / percent) - F.col("n")  # the largest text that one with c shared shingles links with
    crossing = None
    for order in (0, 1):
        rows = posted(order).join(gathered, F.col("doc_id") == F.col("node"), "left").select("token", "n", "inner", _least(F.col("n"), percent).alias("least"), fits.alias("most"), F.coalesce("component", "doc_id").alias("g"))
        own = F.col("inner")
        groups = rows.groupBy("token", "g").agg(
            F.min(F.when(own, F.col("n"))).alias("a_low"), F.max(F.when(own, F.col("n"))).alias("a_high"), F.max(F.when(own, F.col("most"))).alias("a_most"),
            F.min("n").alias("low"), F.max("n").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"),
        )
        groups = stored(groups, "ngram-groups")
        open_ = groups.groupBy("token").agg(F.count("*").alias("k"), F.count("a_low").alias("own")).filter("k > 1 and own > 0").select("token")
        groups = groups.join(open_, "token")
        small = groups.filter("a_low is not null").select("token", F.col("g").alias("a"), "a_low", "a_high", "a_most")
        met = small.join(groups.select("token", F.col("g").alias("b"), "low", "high", "least", "most"), "token")
        met = met.filter("a != b and a_low <= most and a_high >= least and low <= a_most and a_low <= high")
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        crossing = met if crossing is None else crossing.join(met, ["a", "b"], "left_semi")
    more = stored(_linked_across(crossing, lists, gathered, percent), "ngram-crossing")

    def at(side: str) -> DataFrame:
        return gathered.select(F.col("node").alias(side), F.col("component").alias(f"{side}_g"))

    bridges = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_g", "a").alias("a"), F.coalesce("b_g", "b").alias("b")).filter("a != b").distinct()
    merged = connected_components(bridges)
    final = gathered.select(F.col("node"), "component").unionByName(bridges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(gathered, "node", "left_anti").select("node", F.col("node").alias("component")))
    final = final.join(merged.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select(F.col("node").alias("rep"), F.coalesce("whole", "component").alias("component_id"))

    rows = keys.alias("k").join(classes, ["n", "k1", "k2"], "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    rows = rows.join(final, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id"))
    return Joined(rows, links.unionByName(more))


def one_per_group(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows of near-duplicate groups but one: the smallest doc_id of each stays.

    Rows without a doc_id or without words stay. Of several rows with the doc_id that stays, all stay
    if their texts are equal in shingles; columns and texts are docs' own.
    """
    groups = ngram_jaccard_join(docs, n=n, percent=percent).documents
    gone = groups.filter("doc_id is not null and component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
