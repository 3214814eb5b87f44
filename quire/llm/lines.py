"""Line deduplication through a sharded minimal perfect hash over distinct line hashes.

The index has one row per shard: a minimal perfect hash of the shard's line keys and, by its slots,
compact arrays of fingerprints, document counts and keepers. Documents send only 16-byte line hashes
to the shards and get verdicts back; line texts are never joined or shuffled on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACES, ascii_lower, stored

_SPACES = SPACES.encode()
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
NO_ID = -(1 << 63)


def _slot_hash(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level) * np.uint64(0xD1B54A32D192ED03))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(h1: np.ndarray, h2: np.ndarray, room: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes and all levels' bits, for distinct (h1, h2). A key sets a bit in the first level in which no other key wants it."""
    sizes, levels, left = [], [], np.arange(len(h1))
    while len(left):
        size = int(room * len(left)) + 1
        at = (_slot_hash(h1[left], h2[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    return np.array(sizes, np.int64), np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)


def look_up(sizes: np.ndarray, bits: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The slot (0 to n - 1) of each key; -1 for some that are not in the hash, any slot for others."""
    flags = np.unpackbits(bits, count=int(sizes.sum())) if len(sizes) else np.zeros(0, np.uint8)
    rank = np.cumsum(flags, dtype=np.int64) - 1
    out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = base + (_slot_hash(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
        hit = flags[at] == 1
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + int(size)
    return out


def _shard_arrays(keys: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = keys.h1.to_numpy(np.int64).view(np.uint64), keys.h2.to_numpy(np.int64).view(np.uint64)
    sizes, bits = build_hash(h1, h2)
    slot = look_up(sizes, bits, h1, h2)
    prints, counts, keepers = np.empty(len(slot), np.uint32), np.empty(len(slot), np.int64), np.empty(len(slot), np.int64)
    prints[slot], counts[slot], keepers[slot] = h2 >> np.uint64(32), keys.n_docs.to_numpy(), keys.keeper.to_numpy()
    row = {"shard": keys.shard.iloc[0], "load": int(counts.sum()), "sizes": sizes.tobytes(), "bits": bits.tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes(), "keepers": keepers.tobytes()}
    return pd.DataFrame([row])


INDEX = "shard long, load long, sizes binary, bits binary, prints binary, counts binary, keepers binary"


def line_hashes(text: Column, min_chars: int) -> Column:
    """Distinct (h1, h2) of the keys of a text's lines that are long enough to be judged."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(ascii_lower(x), F.lit(SPACES)))
    keys = F.filter(keys, lambda x: F.length(x) >= min_chars)
    return F.array_distinct(F.transform(keys, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))))


def line_occurrences(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, h1, h2), one per document and distinct line key."""
    return docs.select("doc_id", F.explode(line_hashes(F.col("text"), min_chars)).alias("k")).select("doc_id", "k.h1", "k.h2")


def line_index(occurrences: DataFrame, keys_per_shard: int = 1 << 15) -> DataFrame:
    """(doc_id, h1, h2) -> the index, one row per shard of about keys_per_shard keys; load: the probes it will get."""
    keys = occurrences.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("keeper"))
    keys = stored(keys, "line-keys")
    shards = max(1, -(-keys.count() // keys_per_shard))
    return keys.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(_shard_arrays, INDEX).withColumn("shards", F.lit(shards))


def repeated_lines(occurrences: DataFrame, index: DataFrame, min_docs: int = 5, probes_per_group: int = 1 << 18) -> DataFrame:
    """(doc_id, drop): per document the h1 of the keys that it loses.

    A shard with a frequent line gets as many copies of its arrays as keep each group of probes under
    about probes_per_group rows.
    """
    meta = index.select("shard", F.ceil(F.col("load") / probes_per_group).alias("copies"))
    shards = index.agg(F.coalesce(F.max("shards"), F.lit(1))).first()[0]
    probes = occurrences.withColumn("shard", F.pmod("h1", F.lit(shards))).join(meta, "shard")
    probes = probes.withColumn("copy", F.pmod(F.xxhash64("doc_id", "h2"), F.col("copies"))).drop("copies")
    copies = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("load") / probes_per_group) - 1)))

    def probe(arrays: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if arrays.empty or asked.empty:
            return pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "h1": pd.Series(dtype="int64")})
        a = arrays.iloc[0]
        h1, h2 = asked.h1.to_numpy(np.int64), asked.h2.to_numpy(np.int64).view(np.uint64)
        slot = look_up(np.frombuffer(a.sizes, np.int64), np.frombuffer(a.bits, np.uint8), h1.view(np.uint64), h2)
        prints, counts, keepers = np.frombuffer(a.prints, np.uint32), np.frombuffer(a.counts, np.int64), np.frombuffer(a.keepers, np.int64)
        own = asked.doc_id.to_numpy(np.int64)
        drop = (slot >= 0) & (prints[slot] == (h2 >> np.uint64(32))) & (counts[slot] >= min_docs) & (keepers[slot] != own)
        return pd.DataFrame({"doc_id": own[drop], "h1": h1[drop]})

    probes = probes.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    sides = copies.groupBy("shard", "copy").cogroup(probes.select("shard", "copy", "doc_id", "h1", "h2").groupBy("shard", "copy"))
    return sides.applyInPandas(probe, "doc_id long, h1 long").groupBy("doc_id").agg(F.collect_set("h1").alias("drop"))


def _kept_text(text: str, drop: set[int], min_chars: int) -> tuple[str, int]:
    kept, lines = [], text.split("\n")
    for line in lines:
        key = line.encode().translate(_LOWER).strip(_SPACES)
        if len(key) < min_chars or len(key.decode()) < min_chars or xxhash.xxh64_intdigest(key, 42) not in drop:
            kept.append(line)
    return "\n".join(kept), len(lines) - len(kept)


def drop_repeated_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs(doc_id, text, ...) -> docs with text replaced, and n_lines (before) and n_dropped added.

    A line's key is the line without ASCII white space at its ends, A-Z lowered. Keys of min_chars code
    points or more found in min_docs documents or more lose all their lines but those of the largest
    doc_id holding them. Null and empty texts are one empty line (a null text becomes empty). Each row
    counts as a document; rows that share the largest doc_id all keep the line; a null doc_id is taken
    for the least integer, -2**63. Empty tables stay empty; other columns pass through, whatever they
    are called, but for those named like the two new ones, which these replace.
    """
    new = ("n_lines", "n_dropped")
    others = [c for c in docs.columns if c not in ("text", *new)]
    docs_columns = [c for c in docs.columns if c not in new]
    occurrences = stored(line_occurrences(docs, min_chars), "line-hashes")
    index = stored(line_index(occurrences), "line-index")
    drops = repeated_lines(occurrences, index, min_docs).withColumnRenamed("doc_id", "_id").withColumnRenamed("drop", "_drop")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "text", F.struct(*others).alias("_rest"))

    @F.pandas_udf("kept string, n long")
    def applied(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
        rows = [_kept_text(t, {int(h) & 0xFFFFFFFFFFFFFFFF for h in d}, min_chars) if d is not None else (None, 0) for t, d in zip(text, drop, strict=True)]
        return pd.DataFrame(rows, columns=["kept", "n"])

    out = rows.join(drops, "_id", "left")
    touched = F.col("_drop").isNotNull()
    out = out.withColumn("_new", applied(F.when(touched, F.col("text")), F.col("_drop")))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        *[F.when(touched, F.col("_new.kept")).otherwise(text).alias(c) if c == "text" else F.col("_rest")[c].alias(c) for c in docs_columns],
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.when(touched, F.col("_new.n")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )
