"""Ranked lexical search by the Best Position Algorithm.

Documents are searched where they lie: a task cuts its documents into shards, and each shard has one
impact list per term, its documents by falling impact. An item reads its lists from the top, side by
side; a document met in one list is looked up in all others, and every place where it stands there
counts as seen. The best position of a list is the end of its unbroken run of seen places, further down
than what was read; no document unseen so far can score more than the impacts behind the best positions
add up to, and the search ends as soon as this bound is below the k-th score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

#: Bytes of letters, digits and everything beyond ASCII; A-Z are lowered before.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return TERM.findall(data.translate(_LOWER))


def item_blocks(items: DataFrame, most_terms: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """The items in blocks whose distinct terms are about most_terms at most (one item's at least)."""
    block, seen = [], set()
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator(prefetchPartitions=False):
        counts = Counter(terms_of(row["text"]))
        if block and len(seen | counts.keys()) > most_terms:
            yield block
            block, seen = [], set()
        if counts:
            block.append((row["item_id"], counts))
            seen |= counts.keys()
    if block:
        yield block


def term_matches(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, terms, tfs): a row's number of terms, and those that are asked for with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers, counts, offsets = [], [], [], [0]
            for text in batch.column("text").cast("binary"):
                found = terms_of(text.as_py())
                tf = Counter(found)
                lengths.append(len(found))
                for term in tf.keys() & terms.keys():
                    numbers.append(terms[term])
                    counts.append(tf[term])
                offsets.append(len(numbers))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (numbers, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Impact lists of some documents: for each term its documents by falling impact, and where each document stands."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, stats: tuple[int, int]):
        docs, total = stats
        m = 75 + 25 * n * docs // total
        doc = np.repeat(np.arange(len(n)), sizes)
        impact = 10**9 * tfs // (1000 * tfs + 12 * m[doc])
        used, row = np.unique(terms, return_inverse=True)
        by = np.lexsort((doc, -impact, row))
        row, doc, impact = row[by], doc[by], impact[by]
        self.lengths = np.bincount(row, minlength=len(used))
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        width = int(self.lengths.max(initial=0)) + 1
        self.row_of = {int(t): i for i, t in enumerate(used)}
        self.at_place = np.full((len(used), width), len(n), np.int32)  # len(n): behind the end of the list
        self.at_place[row, place] = doc
        self.falling = np.zeros((len(used), width), np.int32)
        self.falling[row, place] = impact
        self.of_doc = np.zeros((len(used), len(n)), np.int32)
        self.of_doc[row, doc] = impact
        self.docs = len(n)

    def best(self, asked: dict[int, int], least: int, k: int, tie_order: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the k best with at least `least` and over 0, and how many documents were looked up; asked: weight by term."""
        rows = np.array([self.row_of[t] for t in asked if t in self.row_of], np.int64)
        weight = np.array([w for t, w in asked.items() if t in self.row_of], np.int64)
        rows, weight = rows[weight > 0], weight[weight > 0]
        places, seen = self.at_place[rows], np.zeros(self.docs + 1, bool)  # what is behind the end of a list is never seen
        docs, scores, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        width = int(self.lengths[rows].max(initial=0))
        while read < width:
            new = np.unique(places[:, read : read + step])
            new = new[(new < self.docs) & ~seen[new]]
            read += step
            step *= 2
            if len(new):  # direct access: every other list says what the document has there
                seen[new] = True
                docs = np.append(docs, new)
                scores = np.append(scores, weight @ self.of_doc[np.ix_(rows, new)].astype(np.int64))
                if len(docs) > k:
                    keep = np.lexsort((tie_order[docs], -scores))[:k]
                    docs, scores = docs[keep], scores[keep]
            position = np.argmin(seen[places], axis=1)  # the first place not seen: one behind the best position
            bound = int(weight @ self.falling[rows, position].astype(np.int64))
            if bound < max(least, int(scores.min()) if len(docs) >= k else 0):
                break
        good = (scores > 0) & (scores >= least)
        return docs[good], scores[good], int(seen.sum())


def _best_of_block(matches: DataFrame, block: list[tuple[int | None, dict[int, int]]], n_terms: int, stats: tuple[int, int], k: int) -> DataFrame:
    """(item, doc_id, score): for each item the k best of each task's documents."""
    most = max(256, (1 << 23) // max(1, n_terms))  # documents a shard: its lists stay under 100 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in block]
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                ids, no_id = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                lists = [part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs")]
                sizes = np.diff(part.column("terms").offsets.to_numpy())
                shard = Shard(part.column("n").to_numpy(), sizes, *lists, stats)
                order = np.empty(len(ids), np.int64)
                order[np.lexsort((ids, no_id))] = np.arange(len(ids))
                for i, (_, asked) in enumerate(block):
                    doc, score, none = top[i]
                    found, reached, _ = shard.best(asked, int(score[-1]) if len(score) >= k else 0, k, order)
                    doc, score, none = np.append(doc, ids[found]), np.append(score, reached), np.append(none, no_id[found])
                    keep = np.lexsort((doc, none, -score))[:k]
                    top[i] = doc[keep], score[keep], none[keep]
        item = np.repeat(np.arange(len(block)), [len(x) for x, _, _ in top])
        doc, score, none = (np.concatenate(x) for x in zip(*top, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=none), pa.array(score)], ["item", "doc_id", "score"])

    return matches.mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 20, block_terms: int = 1 << 12) -> DataFrame:
    """docs(doc_id, text, ...), items(item_id, text, ...) -> (item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    A term is a run of ASCII letters and digits and of anything beyond ASCII, A-Z lowered. With N
    documents that have terms, L terms in them, and df documents holding a term, its weight is
    floor(1000 * ln((2N + 2) / (2df + 1))); a document of n terms, tf of them this one, adds weight *
    (10**9 * tf div (1000 * tf + 12 * (75 + 25 * n * N div L))) for each time that the item has the term.
    Equal scores go by ascending doc_id, null last. Each row of docs is a document of its own and each
    row of items an item of its own, repeated ids included; null and blank texts have no terms: such
    documents are counted nowhere, such items find nothing. Empty tables give empty results; other
    columns are ignored. Items are taken in blocks of about block_terms distinct terms, each held against
    all documents; only a block's terms and their counts are ever on the driver.
    """
    spark = docs.sparkSession
    results = None
    for block in item_blocks(items, block_terms):
        terms = {t: i for i, t in enumerate(sorted({t for _, counts in block for t in counts}))}
        matches = stored(term_matches(docs, terms), "search-matches")
        n_docs, total = matches.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(matches.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect())
        weight = {i: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) for i in df}
        asked = [(item, {terms[t]: c * weight[terms[t]] for t, c in counts.items() if terms[t] in weight}) for item, counts in block]
        found = _best_of_block(matches.filter(F.size("terms") > 0), asked, len(terms), (n_docs, total), k)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], "item long, item_id long")
        ranked = ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")
        results = stored(ranked, "search-ranked") if results is None else results.unionByName(stored(ranked, "search-ranked"))
    if results is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return results
