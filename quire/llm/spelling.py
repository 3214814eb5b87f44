"""Spelling variants by dynamic programming along the sorted vocabulary.

Two words that differ by one edit agree before or behind the middle of the shorter one. So each word is
sorted into lists of words that agree outside one half, and a list is scanned in order: the rows of the
banded edit matrix that belong to a prefix are made once for the whole range of words that share it (the
ranges come from the longest common prefixes of neighbours), and a range whose prefix already takes more
than one edit is never entered. Lists that grow too long are halved again, down to one code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, stored, whole_runs

#: Edit distances are counted up to here: more than one is too far, however much.
FAR = 2


def lower_runs(docs: DataFrame, pattern: str, least: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, run): every maximal run of `pattern` (a class of characters) of at least `least` of them, A-Z lowered."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"{pattern}{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(runs).alias("run")).withColumn("run", ascii_lower(F.col("run")))


def counted(words: DataFrame, least: int = 1) -> DataFrame:
    """words(word) -> (word, n): the words that stand there `least` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _bounds(n: Column, part: Column, parts: Column) -> tuple[Column, Column]:
    return F.floor(part * n / parts).cast("int"), F.floor((part + 1) * n / parts).cast("int")


def _listed(rows: DataFrame) -> DataFrame:
    """rows(word, n, short, part, parts) with k1, k2 (what the word is outside that part of a word of `short` code points) and inner (what it is inside)."""
    low, high = _bounds(F.col("short"), F.col("part"), F.col("parts"))
    more = F.length("word") - F.col("short")
    before, inner, behind = F.expr("substring(word, 1, low)"), F.expr("substring(word, low + 1, high - low + more)"), F.expr("substring(word, high + more + 1)")
    out = rows.withColumns({"low": low, "high": high, "more": more}).filter("low < high")
    outside = F.struct("short", "part", "parts", before, behind)
    return out.withColumns({"inner": inner, "k1": F.xxhash64(outside), "k2": F.xxhash64(F.lit(1), outside)}).drop("low", "high", "more")


def vocabulary_lists(words: DataFrame, most: int) -> DataFrame:
    """words(word, n) -> (k1, k2, last, room, inner, word, n): every list of words equal outside a part of them.

    A word is listed as one of its own length and as one with a code point more than the shorter word.
    No list has over `most` rows but those whose part is one code point: longer ones are dealt anew, by
    halves of their part, as often as it takes.
    """
    shorts = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short")
    halves = F.explode(F.array(F.lit(0), F.lit(1))).alias("part")
    open_ = words.select("word", "n", shorts).filter("short > 0").select("*", halves).withColumn("parts", F.lit(2))
    done = None
    while True:
        rows = _listed(open_)
        long = stored(rows.groupBy("k1", "k2").agg(F.count("*").alias("rows"), F.max("short").alias("s"), F.max("parts").alias("p")).filter((F.col("rows") > most) & (F.col("p") < F.col("s"))).select("k1", "k2"), "spelling-long")
        none = long.isEmpty()
        fine = (rows if none else rows.join(long, ["k1", "k2"], "left_anti")).select(
            "k1", "k2", (F.col("part") + 1 == F.col("parts")).alias("last"), (_bounds(F.col("short"), F.col("part"), F.col("parts"))[1] - _bounds(F.col("short"), F.col("part"), F.col("parts"))[0]).alias("room"), "inner", "word", "n"
        )
        done = fine if done is None else done.unionByName(fine)
        if none:
            return done
        open_ = rows.join(long, ["k1", "k2"]).select("word", "n", "short", F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)).alias("part"), (F.col("parts") * 2).alias("parts"))
        open_ = stored(open_, "spelling-halved")


def near_pairs(codes: np.ndarray, lens: np.ndarray, first: np.ndarray, chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a < b, of all words of one list that are exactly one edit apart.

    codes: a row of code points a word, -1 behind its end, sorted within each list; first: whether a row
    begins a list. A prefix is the range of rows that share it, numbered by depth; a state is a word a,
    a prefix and the three cells of the edit matrix around its diagonal.
    """
    rows, width = codes.shape
    lcp = np.full(rows, -1, np.int64)
    if rows > 1:
        lcp[1:] = np.where(first[1:], -1, np.logical_and.accumulate(codes[1:] == codes[:-1], axis=1).sum(axis=1))
    wide = np.concatenate([codes, np.full((rows, 2), -2, codes.dtype)], axis=1)
    wide[wide == -1] = -2  # what is behind the end of a equals nothing
    levels = []  # per depth: each row's range, and each range's first row
    for d in range(width + 1):
        begins = lcp < d
        levels.append((np.cumsum(begins) - 1, np.flatnonzero(begins)))
    out_a, out_b = [], []
    for at in range(0, rows, chunk):
        asks = np.arange(at, min(rows, at + chunk))
        a, prefix, cells = asks[:0], asks[:0], np.zeros((0, 3), np.int8)
        for d in range(width):
            of_row, starts = levels[d]
            ends = np.append(starts[1:], rows)
            next_of, next_starts = levels[d + 1]
            next_ends = np.append(next_starts[1:], rows)
            symbol = codes[next_starts, d]
            # words whose prefix is still a's own: all later ranges beside a's own one level deeper
            asks = asks[lens[asks] >= d]
            own = next_of[asks]
            n_later = next_of[ends[of_row[asks]] - 1] - own
            # states with an edit behind them go on by one of three code points only
            key = of_row[next_starts].astype(np.int64) << 21 | (symbol.astype(np.int64) + 1)
            options = [wide[a, d - 1] if d else np.full(len(a), -2, codes.dtype), wide[a, d], wide[a, d + 1]]
            found = []
            for k, c in enumerate(options):
                use = (c >= 0) & (cells[:, k] <= 1)
                for j, other in enumerate(options[:k]):
                    use &= (c != other) | (cells[:, j] > 1)
                i = np.flatnonzero(use)
                want = prefix[i] << 21 | (c[i].astype(np.int64) + 1)
                hit = np.searchsorted(key, want)
                good = (hit < len(key)) & (key[np.minimum(hit, len(key) - 1)] == want)
                found.append((i[good], hit[good]))
            i = np.concatenate([x for x, _ in found])
            grown_a = np.concatenate([np.repeat(asks, n_later), a[i]])
            offset = np.arange(n_later.sum()) - np.repeat(np.cumsum(n_later) - n_later, n_later)
            grown_prefix = np.concatenate([np.repeat(own, n_later) + 1 + offset, np.concatenate([x for _, x in found])])
            fresh = np.full((int(n_later.sum()), 3), 1, np.int8)
            fresh[:, 1] = 0
            fresh[:, 0] = 1 if d else FAR
            before = np.concatenate([fresh, cells[i]])
            c = symbol[grown_prefix]
            now = np.empty_like(before)
            now[:, 0] = np.minimum(before[:, 0] + (wide[grown_a, d - 1] != c if d else 1), before[:, 1] + 1)
            now[:, 1] = np.minimum(np.minimum(before[:, 1] + (wide[grown_a, d] != c), before[:, 2] + 1), now[:, 0] + 1)
            now[:, 2] = np.minimum(before[:, 2] + (wide[grown_a, d + 1] != c), now[:, 1] + 1)
            for k in range(3):  # no cells behind the end of a
                now[d + k > lens[grown_a], k] = FAR
            live = (now.min(axis=1) <= 1) & (c >= 0) & (next_ends[grown_prefix] > grown_a + 1)
            a, prefix, cells = grown_a[live], grown_prefix[live], np.minimum(now[live], FAR)
            b = next_starts[prefix]
            behind = lens[a] - d  # the cell of the whole of a
            ended = (lens[b] == d + 1) & (behind >= 0) & (behind <= 2) & (b > a)
            ended[ended] = cells[ended, behind[ended]] == 1
            out_a.append(a[ended])
            out_b.append(b[ended])
    return np.concatenate([asks[:0], *out_a]), np.concatenate([asks[:0], *out_b])


def _code_matrix(inner: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, inner), np.int64, len(inner))
    flat = np.frombuffer("".join(inner).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    codes = np.full((len(inner), int(lens.max(initial=0)) + 1), -1, np.int32)
    row = np.repeat(np.arange(len(inner)), lens)
    codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return codes, lens


def _nearest_of(table: pa.Table) -> pa.RecordBatch:
    """Whole lists -> (word, n_near, best_n, best): what each word's lists here say of it."""
    k1, k2 = table["k1"].to_numpy(), table["k2"].to_numpy()
    first = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
    group = np.cumsum(first) - 1
    several = np.bincount(group)[group] > 1
    room, last = table["room"].to_numpy(), table["last"].to_numpy(zero_copy_only=False)
    pairs = []
    for size in np.unique(np.ceil(np.log2(room[several] + 1))):  # alike in length, so that no long word widens the rest
        at = np.flatnonzero(several & (np.ceil(np.log2(room + 1)) == size))
        codes, lens = _code_matrix(table["inner"].take(pa.array(at)).to_pylist())
        # long words need few rows a step; a list is never cut
        a, b = near_pairs(codes, lens, first[at], chunk=max(256, (1 << 20) // codes.shape[1]))
        m = room[at]
        short = np.minimum(lens[a], lens[b])
        behind = (lens[a] != lens[b]) & (codes[a, short - 1] == codes[b, short - 1])
        whole = np.zeros(len(a), bool)  # the shorter begins the longer: the edit belongs to the next part
        whole[behind] = [(codes[x, :s] == codes[y, :s]).all() for x, y, s in zip(a[behind], b[behind], short[behind], strict=True)]
        keep = (short == m[a]) & (last[at][a] | ~whole)
        pairs.append(np.stack([at[a[keep]], at[b[keep]]]))
    a, b = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    n = table["n"].to_numpy()
    words = table["word"]
    used = np.unique(b)
    order = np.empty(table.num_rows, np.int64)
    order[used[np.argsort(np.array(words.take(pa.array(used)).to_pylist(), object), kind="stable")]] = np.arange(len(used))
    by = np.lexsort((order[b], -n[b], a))
    a, b = a[by], b[by]
    one = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(a[one])).combine_chunks(), pa.array(np.diff(np.append(one, len(a)))), pa.array(n[b[one]]), words.take(pa.array(b[one])).combine_chunks()], ["word", "n_near", "best_n", "best"]
    )


def _roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root): each word's last form. Every turn doubles the steps that a word has gone."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        now = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, *, times: int = 2, most: int = 1 << 15) -> DataFrame:
    """words(word, n) -> (word, form, root, n, n_near, form_n): each word's commoner spelling, if it has one.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest n, ties to the smallest by code points, if that n is `times` (over 1) its own or more; its
    root is the last form reached from it, or itself. Words are distinct: rows that repeat a word count
    as one with their n summed; null and empty words and null n take no part. Words may be of any length.
    Empty tables give empty results; other columns are ignored.
    """
    words = words.filter("word is not null and word != '' and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = stored(words, "spelling-words")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["k1", "k2"], 1 << 17):
            yield _nearest_of(table)

    lists = vocabulary_lists(words, most).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "inner")
    near = lists.mapInArrow(compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    told = words.join(near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best), "word", "left")
    common = -F.col("best.n") >= times * F.col("n")
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.word")).alias("form"), F.when(common, -F.col("best.n")).alias("form_n")), "spelling-forms")
    roots = _roots(told.filter("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
