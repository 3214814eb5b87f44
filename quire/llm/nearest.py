"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors to a few random directions, spreads every coordinate evenly, shifts the
grid and orders the vectors by their Hilbert index. Spark partitions and sorts the curves by range of
their keys, which gives each vector its rank; a query is held against the window of ranks around its own
place, and the windows' best are merged over the curves and reranked by whole vectors. Equal vectors are
one point with the smallest of its ids, so a frequent vector is one place on each curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

DIMS, BITS = 6, 10
_ERF = np.array([0.5 * (1 + erf(x / 2**0.5)) for x in np.linspace(-5, 5, 4001)])


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of cells (n x dims, under 2**bits), by the transposed-axes method."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(vectors: np.ndarray, curve: int, scale: float, seed: int = 11) -> np.ndarray:
    """Hilbert keys on one curve. scale: the root mean square of a component over all vectors."""
    rng = np.random.default_rng([seed, curve])
    directions = np.linalg.qr(rng.standard_normal((vectors.shape[1], min(DIMS, vectors.shape[1]))))[0]
    z = vectors @ directions / scale
    even = np.interp(z, np.linspace(-5, 5, 4001), _ERF)
    shifted = (even + rng.random(directions.shape[1])) / 2
    return hilbert_index(np.minimum((shifted * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _usable(v: Column) -> Column:
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def window_best(q: np.ndarray, q_place: np.ndarray, v: np.ndarray, place: np.ndarray, ids: np.ndarray, half: int, most: int) -> tuple[np.ndarray, ...]:
    """Per query the `most` best of its window, largest score first, ties to the smaller id: places in q and v, and scores.

    A product of matrices finds all that can be among them, those as good as the last included; their
    scores are then summed one component after the other, as Spark does it, before any tie is settled.
    """
    about = q @ v.T
    about[np.abs(q_place[:, None] - place[None, :]) > half] = -np.inf
    if about.shape[1] > most:
        last = np.partition(about, about.shape[1] - most, axis=1)[:, about.shape[1] - most]
    else:
        last = np.full(len(q), -np.inf)
    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0.0)
    a, b = np.nonzero((about >= (last - slack)[:, None]) & (about > -np.inf))
    score = np.zeros(len(a))
    for d in range(q.shape[1]):
        score += q[a, d] * v[b, d]
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, np.arange(len(q)))
    keep = np.arange(len(a)) - first[a] < most
    return a[keep], b[keep], score[keep]


def curve_ranks(keys: DataFrame) -> DataFrame:
    """(curve, key, point) -> (curve, point, rank): ranges of (curve, key, point), sorted where they lie; one row per range and curve gives the ranks before it."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("curve"), batch.column("point"), pa.array(np.arange(at, at + len(batch)))], ["part", "curve", "point", "at"])
            at += len(batch)

    ranged = keys.repartitionByRange("curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    places = stored(ranged.select(F.spark_partition_id().alias("part"), "curve", "point").mapInArrow(numbered, "part int, curve int, point long, at long"), "nearest-ranges")
    ranges = places.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("curve", "part", (before - F.col("from")).alias("shift"))
    return places.join(ranges, ["curve", "part"]).select("curve", "point", (F.col("at") + F.col("shift")).alias("rank"))


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, curves: int = 28, share: float = 0.03, least_window: int = 256) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): each query's k nearest by inner product.

    Queries are the rows whose vec_id is divisible by `every`; all other rows are candidates, and so are
    other queries. A window holds `share` of all distinct vectors, least_window at least: vectors without
    any structure need windows that grow with the table to keep their recall. Ties go to the smaller
    vec_id, within windows and between them; scores are sums in double precision over the given
    components. Vectors null, zero or with null or non-finite components take no part, nor do those with
    another number of components than most have, nor rows without vec_id; of rows that share a vec_id
    each is a candidate, and a query of its own where the id is a query's. A query with fewer than k candidates gets them all; empty tables stay empty;
    other columns are ignored.
    """
    good = vectors.select("vec_id", F.col("embedding").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & _usable(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.sum(_dot("v", "v")).alias("squares")).orderBy(F.desc("rows"), "n").limit(1).collect()
    width, rows, squares = sizes[0] if sizes else (1, 1, 1.0)
    scale = max((squares / rows / width) ** 0.5, 1e-30)
    good = good.filter(F.size("v") == width).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    good = stored(good.withColumn("row", F.monotonically_increasing_id()), "nearest-vectors")
    is_query = F.col("vec_id") % every == 0
    ids = good.select("k1", "k2", "vec_id", "row").withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id", "row"))).filter(F.col("r") <= k + 1)
    classes = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.max(is_query).alias("asks"), F.first("v").alias("v"))
    points = stored(classes.select("k1", "k2", F.xxhash64("k1", "k2").alias("point"), "least", "asks", "v"), "nearest-points")
    half = max(least_window, int(share * points.count())) // 2
    block = max(4 * half, 2048)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(curve_keys(x, c, scale)), batch.column("point")], ["curve", "key", "point"])

    ranked = stored(curve_ranks(points.select("v", "point").mapInArrow(keyed, "curve int, key long, point long")), "nearest-ranks")
    placed = ranked.join(points.select("point", "least", "asks", "v"), "point")
    asked = placed.filter("asks").withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("rank") - half) / block), F.floor((F.col("rank") + half) / block))))

    def best(queries: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"asker": pd.Series(dtype="int64"), "point": pd.Series(dtype="int64"), "least": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if len(near):
            v, place, name, least = np.stack(near.v.to_numpy()).astype(np.float64), near["rank"].to_numpy(), near.point.to_numpy(), near.least.to_numpy()
            for at in range(0, len(queries), 512):
                some = queries.iloc[at : at + 512]
                a, b, score = window_best(np.stack(some.q_v.to_numpy()).astype(np.float64), some.q_rank.to_numpy(), v, place, least, half, k + 1)
                out.append(pd.DataFrame({"asker": some.q_point.to_numpy()[a], "point": name[b], "least": least[b], "score": score}))
        return pd.concat(out)

    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("curve", "block", "point", "rank", "v")])
    sides = asked.groupBy("q_curve", "q_block").cogroup(placed.withColumn("block", F.floor(F.col("rank") / block)).select("curve", "block", "point", "least", "rank", "v").groupBy("curve", "block"))
    merged = sides.applyInPandas(best, "asker long, point long, least long, score double").groupBy("asker", "point").agg(F.min("least").alias("least"), F.max("score").alias("score"))
    merged = merged.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "least"))).filter(F.col("r") <= k + 1)
    scored = merged.join(points.select("point", "k1", "k2", "v"), "point").join(points.select(F.col("point").alias("asker"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("v").alias("w")), "asker")
    scored = scored.select("q1", "q2", "k1", "k2", _dot("w", "v").alias("score"))
    hits = scored.join(ids.select("k1", "k2", "vec_id", "row"), ["k1", "k2"])
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id", "row"))).filter(F.col("r") <= k + 1)
    askers = good.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("row").alias("asker"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    answers = askers.join(hits.select("q1", "q2", "vec_id", "row", "score", "r"), ["q1", "q2"]).filter("row != asker")
    answers = answers.withColumn("rank", F.row_number().over(Window.partitionBy("asker").orderBy("r"))).filter(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
