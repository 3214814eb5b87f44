"""Language identification by Bayesian evidence fusion.

The posterior of a page's language multiplies what four pieces of evidence say: the text (byte 4-gram
likelihoods learned from documents of known language), the language that the markup declares, the
suffix of the address, and the host. Suffix and host speak through grouped counts of what the texts of
all other pages say; a host's shares lean on its domain's, and these on all pages'.

Every language of the documents competes. One that only markup names competes for the pages that declare
it: its text likelihood is that of no counts, its prior the shares of other pages that declare it and
whose texts no learned language explains better.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.shingles import in_chunks, mixed

BUCKETS, GRAM = 1 << 15, 4
#: Neighbouring n-grams are not independent: a text weighs as much as this many at most.
MOST_EVIDENCE = 60.0
#: Languages counted at a time in a task, and of a broadcast.
BLOCK = 64


class Model(NamedTuple):
    """Log shares of n-grams, a row of BUCKETS per language: of languages with documents enough, and of rare ones."""

    langs: list[str]
    weights: np.ndarray
    rare: list[str]
    rare_weights: np.ndarray


def gram_counts(text: bytes) -> np.ndarray:
    data = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(data) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        h = h << np.uint64(8) | data[i : i + len(h)]
    return (mixed(h) & np.uint64(BUCKETS - 1)).astype(np.int32)


def train(docs: DataFrame, min_docs: int = 5) -> Model:
    """docs(text, lang) -> all languages and log shares of their n-grams, counted over all documents.

    A language of fewer than min_docs documents is rare: its shares lean on the mean of the others', by
    its number of different n-grams, so that what it never showed does not speak for it.
    """
    found = docs.filter("lang is not null and lang != ''").groupBy("lang").agg(F.count("*").alias("n")).collect()
    langs = sorted(r.lang for r in found if r.n >= min_docs)
    rare = sorted(r.lang for r in found if r.n < min_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            at = [np.flatnonzero(s) for s in sums.values()]
            counts = [s[k].tobytes() for s, k in zip(sums.values(), at, strict=True)]
            columns = [pa.array(list(sums), pa.string()), pa.array([k.tobytes() for k in at], pa.binary()), pa.array(counts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "buckets", "counts"])

        for rest, texts in in_chunks(batches):
            for lang, t in zip(rest["lang"], texts, strict=True):
                if not lang:
                    continue
                if lang not in sums and len(sums) == BLOCK:
                    yield out()
                    sums.clear()
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(gram_counts(t), minlength=BUCKETS)
        yield out()

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(BUCKETS, np.int64)
        for k, v in zip(rows["buckets"], rows["counts"], strict=True):
            c[np.frombuffer(k, np.int64)] += np.frombuffer(v, np.int64)
        at = np.flatnonzero(c)
        return pd.DataFrame({"lang": rows.lang.iloc[:1], "buckets": [at.tobytes()], "counts": [c[at].tobytes()]})

    weights, rare_weights = (np.full((len(x), BUCKETS), -np.log(BUCKETS), np.float32) for x in (langs, rare))
    if found:
        schema = "lang string, buckets binary, counts binary"
        parts = docs.select("lang", "text").mapInArrow(count, schema).groupBy("lang").applyInPandas(total, schema)
        rows, thin = {x: i for i, x in enumerate(langs)}, {}
        for r in parts.collect():  # a row per language
            at, n = np.frombuffer(r["buckets"], np.int64), np.frombuffer(r["counts"], np.int64)
            if r["lang"] in rows:
                c = np.full(BUCKETS, 0.5)
                c[at] += n
                weights[rows[r["lang"]]] = np.log(c / c.sum())
            else:
                thin[r["lang"]] = at, n
        mean = sum((np.exp(w.astype(np.float64)) for w in weights), np.zeros(BUCKETS)) / len(langs) if langs else np.full(BUCKETS, 1 / BUCKETS)
        for i, x in enumerate(rare):
            at, n = thin.get(x, (np.zeros(0, np.int64),) * 2)
            c = mean * max(1, len(at))
            c[at] += n
            rare_weights[i] = np.log(c / c.sum())
    return Model(langs, weights, rare, rare_weights)


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, host, domain, suffix, declared, text (tags, scripts and styles taken out)."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"&#?[A-Za-z0-9]+;", " "), r"\s+", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    meta = F.lower(F.regexp_extract(html, r"(?i)content-language[\"']?\s+content\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    out = pages.select("page_id", host.alias("host"), F.when(declared != "", declared).when(meta != "", meta).alias("declared"), text.alias("text"))
    return out.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))


def _one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def identify(pages: DataFrame, model: Model, *, strength: float = 5.0) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, lang, probability, text_lang, declared, host, n_chars; one row per page.

    A page never counts as evidence for itself. A null or empty page, or one without address or declared
    language, rests on what is left; without any evidence it gets the commonest language. Pages equal in
    all columns fare alike; other columns are ignored. A declared language that the model lacks is one more
    candidate for the page, and text_lang is null where it explains the text better than all others. A
    model without languages leaves the declared one, with the trust of no evidence, or null.
    """
    langs = model.langs + model.rare
    n = len(langs)
    found = page_evidence(pages)
    if not n:
        return found.select("page_id", F.col("declared").alias("lang"), F.when(F.col("declared").isNotNull(), 0.5).alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", F.length("text").cast("long").alias("n_chars"))
    blocks = [w[k : k + BLOCK] for w in (model.weights, model.rare_weights) for k in range(0, len(w), BLOCK)]
    shared = [pages.sparkSession.sparkContext.broadcast(w) for w in blocks]

    @F.pandas_udf("array<double>")
    def likelihood(texts: pd.Series) -> pd.Series:  # of each language, and of one without counts
        out = []
        for t in texts:
            g = gram_counts((t or "").encode())
            weigh = min(len(g), MOST_EVIDENCE)
            s = np.concatenate([w.value[:, g].mean(axis=1, dtype=np.float64) for w in shared]) * weigh if len(g) else np.zeros(n)
            out.append([*(s - s.max()).tolist(), -np.log(BUCKETS) * weigh - s.max()])
        return pd.Series(out)

    names = F.array(*[F.lit(x) for x in langs])
    rows = found.select("page_id", "host", "domain", "suffix", "declared", F.length("text").cast("long").alias("n_chars"), likelihood(F.col("text")).alias("ll"))
    rows = rows.withColumn("other_ll", F.get("ll", F.lit(n))).withColumn("ll", F.slice("ll", 1, n))
    rows = rows.withColumn("other", F.when(~F.array_contains(names, F.col("declared")), F.col("declared")))  # a language the model lacks
    rows = rows.withColumn("own_other", F.col("other").isNotNull() & (F.col("n_chars") > 1) & (F.col("other_ll") > 0))
    rows = stored(rows.withColumn("best", F.when((F.col("n_chars") > 1) & ~F.col("own_other"), F.array_position("ll", F.lit(0.0)).cast("int") - 1)), "language-evidence")

    def counts(key: str | None, name: str) -> DataFrame:
        sums = F.array(*[F.count_if(F.col("best") == i).cast("double") for i in range(n)]).alias(name)
        return rows.agg(sums) if key is None else rows.groupBy(key).agg(sums)

    overall = counts(None, "c").first()[0]
    def other_counts(key: str | None, name: str) -> DataFrame:
        return rows.filter("own_other").groupBy(*([key] if key else []), "other").agg(F.count("*").cast("double").alias(name))

    agree = rows.filter("declared is not null and best is not null").agg(F.count("*").alias("n"), F.count_if(F.col("declared") == F.get(names, F.col("best"))).alias("k")).first()
    trust = min(0.99, (agree["k"] + 1) / (agree["n"] + 2))

    out = rows.join(counts("host", "host_n"), "host").join(counts("domain", "domain_n"), "domain").join(counts("suffix", "suffix_n"), "suffix")
    for key, name in (("host", "host_k"), ("domain", "domain_k"), ("suffix", "suffix_k"), (None, "all_k")):
        out = out.join(other_counts(key, name), [key, "other"] if key else ["other"], "left")
    out = out.withColumn("own", F.coalesce(_one_hot(F.col("best"), n), F.array_repeat(F.lit(0.0), n)))
    everything = F.array(*[F.lit(float(c)) for c in overall])

    def shares(of: Column, parent: Column) -> Column:
        """Shares of counts without the page itself, with `strength` pages of the parent's shares."""
        rest = F.zip_with(of, F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return F.zip_with(rest, parent, lambda a, p: a + strength * p)

    uniform = F.array_repeat(F.lit(1.0 / n), n)
    for name, source, parent in (("all_s", everything, uniform), ("domain_s", F.col("domain_n"), F.col("all_s")), ("host_s", F.col("host_n"), F.col("domain_s")), ("suffix_s", F.col("suffix_n"), F.col("all_s"))):
        out = out.withColumn("_raw", shares(source, parent)).withColumn("_sum", F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x))
        out = out.withColumn(name, F.zip_with("_raw", F.array_repeat(F.col("_sum"), n), lambda a, s: a / s)).drop("_raw", "_sum")
    for level, source in (("all", everything), ("domain", F.col("domain_n")), ("host", F.col("host_n")), ("suffix", F.col("suffix_n"))):
        k = F.coalesce(F.col(f"{level}_k"), F.lit(0.0)) - F.col("own_other").cast("double")
        rest = F.aggregate(source, F.lit(0.0), lambda a, x: a + x) - F.aggregate("own", F.lit(0.0), lambda a, x: a + x)
        parent = F.lit(1.0 / (n + 1)) if level == "all" else F.col("domain_p") if level == "host" else F.col("all_p")
        out = out.withColumn(f"{level}_p", (k + strength * parent) / (rest + k + strength))
    # a suffix is evidence by how far its shares are from those of all pages
    suffix = F.zip_with("suffix_s", "all_s", lambda a, p: F.ln(a / p) / 2)
    declared = F.transform(names, lambda x: F.when(F.col("declared").isNull(), 0.0).when(x == F.col("declared"), F.ln(F.lit(trust))).when(F.col("other").isNotNull(), F.ln(F.lit((1 - trust) / n))).otherwise(F.ln(F.lit((1 - trust) / max(1, n - 1)))))
    out = out.withColumn("_d", declared).withColumn("_x", suffix).withColumn("_h", F.transform("host_s", lambda v: F.ln(v)))
    out = out.withColumn("_l", F.zip_with(F.zip_with("ll", "_d", lambda a, b: a + b), F.zip_with("_x", "_h", lambda a, b: a + b), lambda a, b: a + b))
    other = F.col("other_ll") + F.ln(F.lit(trust)) + F.ln(F.col("suffix_p") / F.col("all_p")) / 2 + F.ln("host_p")
    out = out.withColumn("_l", F.when(F.col("other").isNotNull(), F.concat("_l", F.array(other))).otherwise(F.col("_l")))
    out = out.withColumn("_top", F.array_max("_l")).withColumn("_z", F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top"))))
    lang = F.get(F.concat(names, F.array("other")), F.array_position("_l", F.col("_top")).cast("int") - 1)
    return out.select("page_id", lang.alias("lang"), (1 / F.col("_z")).alias("probability"), F.get(names, F.col("best")).alias("text_lang"), "declared", "host", "n_chars")
