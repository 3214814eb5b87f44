"""A quality classifier of supervised subword embeddings.

Words, word pairs and byte n-grams of a text are hashed to rows of a table of learned vectors; their
mean goes through a softmax over the labels. Table and output layer are trained together by plain
stochastic gradient descent in numpy on a bounded sample of labelled rows. For scoring the two are
multiplied out, so each feature has one learned weight and a text's logit is their mean.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shingles import in_chunks, mixed, word_hashes

GRAMS = (3, 5)
_BASE = np.uint64(0x9DDFEA08EB382D69)


class Model(NamedTuple):
    """weight: one per hashed feature. bias: of a text without features too."""

    weight: np.ndarray
    bias: float


def features(texts: list[bytes], buckets: int) -> Iterator[np.ndarray]:
    """Hashed features of each text: its words, pairs of neighbouring words and byte n-grams, in case as they are. buckets: a power of two."""
    mask = np.uint64(buckets - 1)
    words, per_text = word_hashes(texts, lower=False)
    with np.errstate(over="ignore"):
        pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) else words
        pairs = np.where(words[:-1] == words[1:], np.uint64(1), pairs)  # a word after itself is one feature, whatever the word
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
        grams = {}
        for n in GRAMS:
            h = np.zeros(max(0, len(data) - n + 1), np.uint64)
            for i in range(n):
                h = h * _BASE + data[i : i + len(h)]
            grams[n] = (mixed(h + np.uint64(n)) & mask).astype(np.int32)
    words, pairs = (words & mask).astype(np.int32), (pairs & mask).astype(np.int32)
    at = byte = 0
    for t, c in zip(texts, per_text, strict=True):
        parts = [words[at : at + c], pairs[at : at + max(0, c - 1)]]
        yield np.concatenate(parts + [grams[n][byte : byte + max(0, len(t) - n + 1)] for n in GRAMS])
        at, byte = at + c, byte + len(t)


def train(texts: list[bytes], labels: np.ndarray, *, buckets: int = 1 << 17, dim: int = 8, epochs: int = 6, rate: float = 10.0, longest: float = 1.0, bound: float = 16.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, a document at a time, with a falling rate; steps and weights are bounded, so it can't diverge. Reruns agree."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    rows = []
    for k in range(0, len(texts), 64):
        for f in features(texts[k : k + 64], buckets):
            at, n = np.unique(f, return_counts=True)
            rows.append((at.astype(np.int32), (n / max(1, len(f))).astype(np.float32)))
    if len(labels):
        share = np.clip(labels.mean(), 0.01, 0.99)
        bias[:] = np.log([1 - share, share])
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, share = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            vectors = table[at]
            mean = share @ vectors
            z = mean @ out + bias
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[labels[i]] -= 1
            step = np.minimum(lr * share * len(at) ** 0.5, longest)  # a short text has few features of large shares
            table[at] = np.clip(vectors - step[:, None] * (out @ error)[None, :], -bound, bound)
            out = np.clip(out - lr * 0.1 * np.outer(mean, error), -bound, bound)
            bias -= lr * 0.01 * error
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, *, most_rows: int = 4000, most_bytes: int = 32768) -> DataFrame:
    """(doc_id, text, label) of the labelled documents to learn from: at most most_rows, each at most most_bytes long.

    Rows whose crc32(doc_id as text) leaves 2 when divided by 4 are held out; of the rest those with
    the least hash are taken, so the sample is even over the corpus. A doc_id with several labels has
    the largest, one with several texts the text with the least hash; rows without doc_id or label are
    no examples.
    """
    usable = labels.filter("doc_id is not null and label is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    usable = usable.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select("doc_id", "text").filter((F.octet_length("text") <= most_bytes) & F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), "doc_id")  # most_rows bounds what is broadcast
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("x")).select("doc_id", "x.text", "x.label")


def fit(docs: DataFrame, labels: DataFrame, *, most_total: int = 1 << 24, **options) -> Model:
    """docs(doc_id, text), labels(doc_id, label 0 or 1) -> Model. Without examples every score is 0.5.

    The sample is learned in one task, of which the driver gets the weights only: documents in the
    order of their hash while their texts have most_total bytes in all.
    """

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode() for t in rows.text]
        order = sorted(range(len(rows)), key=lambda i: (zlib.crc32(str(rows.doc_id[i]).encode()), rows.doc_id[i]))
        total = np.cumsum([len(texts[i]) for i in order])
        taken = order[: max(1, int(np.searchsorted(total, most_total, "right")))]
        model = train([texts[i] for i in taken], rows.label.to_numpy(np.int64)[taken])
        return pd.DataFrame({"weight": [model.weight.astype("<f4").tobytes()], "bias": [model.bias]})

    sample = training_sample(docs.select("doc_id", "text"), labels.select("doc_id", "label"), **options)
    found = sample.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "weight binary, bias double").collect()
    return Model(np.frombuffer(found[0].weight, "<f4"), found[0].bias) if found else Model(np.zeros(1, np.float32), 0.0)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs -> (row, score): each row as a struct of its columns, and its score (0 to 1, higher: label 1 likelier) by text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))  # of fixed size

    @F.pandas_udf("double")
    def logit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, bias = shared.value
        for batch in batches:
            out: list[float] = []
            for _, texts in in_chunks([pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], ["text"])], most=1 << 19):
                out += [float(weight[f].mean(dtype=np.float64)) + bias if len(f) else bias for f in features(texts, len(weight))]
            yield pd.Series(out, dtype="float64")

    return docs.select(F.struct(*docs.columns).alias("row"), logit(F.col("text")).alias("z")).select("row", (1 / (1 + F.exp(-F.col("z")))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """docs(doc_id, text, ...) -> docs with held_out, score and predicted (1 if score >= threshold, else 0).

    Labels, lang, source and doc_id are never inputs of a score. Null and empty texts are scored like
    texts without features, repeated rows alike, and empty tables stay empty. Columns of docs named like
    the three new ones are replaced by them; others pass through, whatever they are called.
    """
    out = scored(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("held_out", "score", "predicted")]
    return out.select(*own, held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """docs without those that the classifier rejects; docs' own columns, whatever they are called.

    A null or empty text has no features and gets the score of the labels' share, so whether such rows
    stay depends on the labels; repeated rows go or stay together; an empty table stays empty.
    """
    return scored(docs, fit(docs, labels)).filter(F.col("score") >= threshold).select("row.*")
