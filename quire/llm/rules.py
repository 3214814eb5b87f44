"""Quality rules: base counts, and the distance of a document's distributions from its language's.

A language's references are the character classes and the commonest words over all its documents. A
document's own histograms are held against them by Jensen-Shannon distance (the root of the divergence
in bits, 0 to 1); texts that are too short to have a histogram are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACES, stored

#: Character classes beside white space, a-z and what is left, other ASCII.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": r"[.,;:!?'\"()-]", "other": r"[^\x00-\x7F]"}
_BITS = 21


def _words(text: Column) -> Column:
    """Words by white space: splitting at one plain character is several times as fast as matching words."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def _covered(places: str) -> Column:
    """Words covered by 3-word windows that start at the sorted places."""
    steps = F.transform(places, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def with_repeats(df: DataFrame) -> DataFrame:
    """df(words, ...) -> df and n_repeat_words: words in 3-word windows that the text has twice or more.

    Windows are found again by sorting longs of hash and place together; where two hashes agree in the
    bits kept, or a text has over two million words, whole hashes are sorted instead.
    """
    place = F.lit((1 << _BITS) - 1).cast("long")
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_w", F.when(F.size("_h") >= 4, F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2))))).drop("_h")
    df = df.withColumn("_dup", F.size(F.array_distinct("_w")) < F.size("_w"))
    df = df.withColumn("_p", F.when(F.col("_dup") & (F.size("_w") < 1 << _BITS), F.sort_array(F.transform("_w", lambda h, i: h.bitwiseAND(F.lit(-(1 << _BITS)).cast("long")).bitwiseOR(i.cast("long"))))))

    def whole(x: Column) -> Column:
        return F.get("_w", x.bitwiseAND(place).cast("int"))

    def near(x: Column, y: Column) -> Column:
        return F.shiftright(x, _BITS) == F.shiftright(y, _BITS)

    clash = F.exists(F.transform("_p", lambda x, j: F.coalesce(near(x, F.get("_p", j + 1)) & (whole(x) != whole(F.get("_p", j + 1))), F.lit(False))), lambda b: b)
    df = df.withColumn("_slow", F.col("_dup") & F.coalesce(clash, F.lit(True)))
    pairs = F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    df = df.withColumn("_s", F.when(F.col("_slow"), pairs))
    fast = F.filter("_p", lambda x, j: F.coalesce(near(x, F.get("_p", j - 1)), F.lit(False)) | F.coalesce(near(x, F.get("_p", j + 1)), F.lit(False)))
    slow = F.filter("_s", lambda x, j: F.coalesce(x["h"] == F.get("_s", j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_s", j + 1)["h"], F.lit(False)))
    found = F.when(F.col("_slow"), F.transform(slow, lambda x: x["i"])).otherwise(F.transform(fast, lambda x: x.bitwiseAND(place)))
    df = df.withColumn("_at", F.when(F.col("_dup"), F.sort_array(found)))
    return df.withColumn("n_repeat_words", F.coalesce(_covered("_at"), F.lit(0).cast("long"))).drop("_w", "_dup", "_p", "_slow", "_s", "_at")


def common_words(docs: DataFrame, top: int = 12) -> DataFrame:
    """docs(lang, text) -> (lang, common): each language's `top` most frequent words over all its documents, in lower case."""
    words = docs.select("lang", F.explode(_words(F.lower("text"))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= top)
    return ranked.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("common"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def jensen_shannon(p: str, q: str) -> Column:
    """Distance of two columns of shares."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    each = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x)))


def quality_rules(
    docs: DataFrame, *, top: int = 12, min_words: int = 50, min_class_chars: int = 200, most_class: float = 0.3,
    min_common_words: int = 100, most_common: float = 0.3, min_reference_words: int = 2000,
) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    class_distance, common_distance, base_failed, kept; one row per row of docs.

    base_failed: under min_words words, or over half of the words in repeated 3-word windows. Others are
    kept unless a distance is above its limit; class_distance is null under min_class_chars characters,
    common_distance under min_common_words words, and both where the language has under
    min_reference_words words in all (so a rare or wrong language tag condemns nothing). Null texts are
    empty; a null lang is a language of its own; repeated rows fare alike; empty tables stay empty; other
    columns are ignored.
    """
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    common = stored(common_words(own, top), "rules-common")
    df = own.join(common, "lang", "left").withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    df = df.withColumn("_lines", lines).withColumn("_chars", F.length("text").cast("long")).withColumn("_dense", F.array_join("words", "")).drop("text")
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = df.withColumn("word_chars", F.length("_dense").cast("long")).withColumn("_rest", F.regexp_replace("_dense", "[a-z]+", "")).drop("_dense")
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("n_symbols", F.regexp_count("_rest", F.lit(r"[#*$%&|<>]")).cast("long"))
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"_{name}", F.regexp_count("_rest", F.lit(pattern)).cast("long"))
    df = df.withColumn("_left", F.length("_rest").cast("long")).drop("_rest")
    ascii_left = F.col("_left") - sum((F.col(f"_{name}") for name in CLASSES), F.lit(0))
    df = df.withColumn("classes", F.array(F.col("_chars") - F.col("word_chars"), F.col("word_chars") - F.col("_left"), *[F.col(f"_{name}") for name in ("upper", "digit", "stop")], ascii_left, F.col("_other")))
    df = with_repeats(df)
    # no letter gets shorter in lower case, so longer words than the longest common one need no look
    df = df.withColumn("_longest", F.coalesce(F.array_max(F.transform("common", lambda w: F.length(w))), F.lit(0)))
    df = df.withColumn("_short", F.filter("words", lambda w: F.length(w) <= F.col("_longest")))
    # each word as a letter for its place among the common ones: counting letters is cheap, comparing words again is not
    letters = F.lit("_" + "".join(chr(ord("a") + i) for i in range(top)))
    mark = F.transform("_short", lambda w: F.substring(letters, F.coalesce(F.array_position("common", F.lower(w)), F.lit(0)).cast("int") + 1, F.lit(1)))
    df = df.withColumn("_marks", F.array_join(mark, ""))
    each = [(F.length("_marks") - F.length(F.replace("_marks", F.lit(chr(ord("a") + i)), F.lit("")))).cast("long") for i in range(top)]
    df = df.withColumn("_each", F.array(*each))
    df = df.withColumn("commons", F.concat("_each", F.array(F.col("n_words") - F.aggregate("_each", F.lit(0).cast("long"), lambda a, x: a + x))))
    features = stored(df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "commons"), "rules-features")

    size = 7
    sums = [F.coalesce(F.sum(F.get("classes", F.lit(i))), F.lit(0)) for i in range(size)]
    words = [F.coalesce(F.sum(F.get("commons", F.lit(i))), F.lit(0)) for i in range(top + 1)]
    langs = features.groupBy("lang").agg(F.array(*sums).alias("ref_classes"), F.array(*words).alias("ref_commons"), F.sum("n_words").alias("ref_words"))
    out = features.join(langs, "lang")
    out = out.withColumn("p1", _shares(F.col("classes"))).withColumn("q1", _shares(F.col("ref_classes"))).withColumn("p2", _shares(F.col("commons"))).withColumn("q2", _shares(F.col("ref_commons")))
    enough = F.col("ref_words") >= min_reference_words
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("class_distance", F.when(enough & (chars >= min_class_chars), jensen_shannon("p1", "q1")))
    out = out.withColumn("common_distance", F.when(enough & (F.col("n_words") >= min_common_words), jensen_shannon("p2", "q2")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > most_class) | (F.coalesce("common_distance", F.lit(0.0)) > most_common)
    return out.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "common_distance", failed.alias("base_failed"), (~failed & ~far).alias("kept"))
