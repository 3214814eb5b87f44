"""SuperMinHash groups, ranked search and spelling variants against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quire.llm import minhash, mixing, nearest, packing, search, spelling
from quire.llm.shingles import shingle_sets

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words, times=2):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= times * words[w]}
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("most", [3, 40, 1 << 15])
def test_spelling_variants_are_those_of_all_pairs(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 6))): rng.randint(1, 60) for _ in range(260)}
    words |= {"x" * 3000: 9, "x" * 2999 + "y": 2, "x" * 3001: 40, "𝔘nicode": 3, "unicode": 12}
    rows = [(w, n, "other") for w, n in words.items()] + [(None, 5, ""), ("", 5, ""), ("lost", None, "")]
    out = spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long, form string"), most=most).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out}
    assert len(out) == len(got)
    assert got == variants(words)


def test_spelling_chains_repeats_and_empty_tables(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc"]
    rows = [(w, 3**i) for i, w in enumerate(chain)] + [("aaaaa", 0), ("split", 2), ("split", 3)]
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {got[w]["root"] for w in chain} == {chain[-1]}
    assert (got["split"]["n"], got["split"]["form"], got["split"]["root"], got["split"]["n_near"]) == (5, None, "split", 0)
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_near_pairs_are_found_inside_lists_only():
    words = sorted(["abc", "abd", "ab", "bab"])
    codes, lens = spelling._code_matrix(words + words)
    first = np.array([True, False, False, False] * 2)
    a, b = spelling.near_pairs(codes, lens, first, chunk=3)
    want = {(i + s, j + s) for s in (0, 4) for i in range(4) for j in range(i + 1, 4) if one_edit(words[i], words[j])}
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(want)


def ranking(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, Counter(ts), len(ts)) for i, ts in terms if ts]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("block_terms", [1, 4096])
def test_search_ranks_like_a_full_scan(spark, block_terms):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "naïve", "x_y", "A-b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 80)))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(30)] + [(None, docs[7][1]), (3, docs[7][1]), (900, None), (901, ""), (902, " ... "), (903, "w1 " * 5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(12)] + [(50, docs[7][1]), (51, None), (52, ""), (53, "nowhere at all"), (50, "w3 w3 w3 w1")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, item_id int").repartition(5)
    out = search.ranked_search(frame, spark.createDataFrame(items, "item_id long, text string").coalesce(1), k=9, block_terms=block_terms).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, ranking(docs, items, 9)))


def test_search_stops_early_and_never_too_early():
    rng = np.random.default_rng(3)
    n = np.full(3000, 50)
    tfs = np.maximum(1, rng.pareto(1.0, 6000)).astype(np.int64)
    terms = np.tile([0, 1], 3000)
    shard = search.Shard(n, np.full(3000, 2), terms, tfs, (3000, 150000))
    order = np.arange(3000)
    docs, scores, looked = shard.best({0: 900, 1: 700}, 0, 10, order)
    full = 900 * shard.of_doc[0].astype(np.int64) + 700 * shard.of_doc[1]
    want = np.lexsort((order, -full))[:10]
    assert docs.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    assert looked < 1500
    assert len(shard.best({0: 900, 1: 700}, int(full.max()) + 1, 10, order)[0]) == 0


def test_search_over_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert search.ranked_search(docs, asked).collect() == [] == search.ranked_search(full, items).collect()


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 40000).astype(np.uint64)
    errors = []
    for i in range(60):
        base = rng.choice(pool, 300, replace=False)
        other = np.concatenate([base[: 300 - 2 * i], rng.choice(pool, 2 * i + 1, replace=False)])
        a, b = minhash.super_minhash([np.unique(base), np.unique(other)], 130)
        true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        errors.append((a == b).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def test_signatures_are_least_ranks_whatever_they_are_made_with():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (0, 1, 2, 5, 40, 700, 3000)]
    whole = minhash.super_minhash(sets, 130)
    assert (whole[0] == np.iinfo(np.uint64).max).all()
    assert sorted((whole[1] >> np.uint64(48)).tolist()) == list(range(130))  # one element takes every place, a rank each
    for i, s in enumerate(sets):
        assert (minhash.super_minhash([s], 130)[0] == whole[i]).all()
        assert (minhash.super_minhash(sets, 130, most=256)[i] == whole[i]).all()
    union = np.minimum(whole[4], whole[5])
    assert (minhash.super_minhash([np.union1d(sets[4], sets[5])], 130)[0] == union).all()


def components(docs, n, percent):
    sets = [(i, set(s.tolist())) for (i, _), s in zip(docs, shingle_sets([(t or "").encode() for _, t in docs], n), strict=True)]
    least = {i: i for i, _ in sets if i is not None}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                least[max(p, q)] = min(p, q)
    return {(i, len(s), find(i) if i is not None else None) for i, s in sets}


@pytest.mark.parametrize("turns", [1, 4])
def test_near_duplicates_are_those_of_all_pairs(spark, turns):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]

    def prose(k):
        return rng.choices(vocabulary, k=k)

    docs = [(i, " ".join(prose(rng.randint(5, 150)))) for i in range(60)]
    walk = prose(200)
    for i in range(100, 160):  # a chain: neighbours link, ends do not
        walk = list(walk)
        walk[rng.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(walk)))
    base = prose(180)
    for i in range(200, 260):  # copies altered in places of their own
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(180)] = f"y{rng.random()}"
        docs.append((i, " ".join(w)))
    docs += [(300, docs[0][1].upper()), (301, docs[0][1].replace(" ", "\n")), (302, ""), (303, None), (304, " \t"), (305, "one two"), (306, "One two"), (307, "one"), (None, docs[0][1]), (None, "one"), (61, docs[1][1])]
    docs.append((400, " ".join(prose(60000))))
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n long, band string")
    out = minhash.near_duplicates(frame, n=5, percent=85, turns=turns)
    rows = out.documents.collect()
    assert len(rows) == len(docs)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows} == components(docs, 5, 85)
    assert all(100 * r["overlap"] >= 85 * (r["a_size"] + r["b_size"] - r["overlap"]) for r in out.links.collect())


def test_large_buckets_are_compared_in_blocks(spark):
    def print_of(i):
        return i % 7 if i % 3 == 0 else i

    rng = np.random.default_rng(4)
    rows, prints = [], rng.integers(0, 2**16, (40, 130)).astype(np.uint16)
    for i in range(40):
        rows.append((5, i, 100, 100 + i % 2, bytearray(prints[print_of(i)].tobytes()) if i != 39 else None))
    members = spark.createDataFrame(rows, "band long, g long, low long, high long, prints binary")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if b == 39 or print_of(a) == print_of(b)}
    for block in (3, 8, 1024):
        assert {(r.a, r.b) for r in minhash.crossing_pairs(members, 80, 0.7, block=block, dense=1000).collect()} == want
    assert [tuple(r) for r in minhash.crossing_pairs(members, 80, 0.7, dense=1).collect()] == [(None, None, 5)]


@pytest.mark.parametrize("block", [4, 512])
def test_dense_buckets_give_links_that_connect_what_all_pairs_connect(spark, block):
    rng = random.Random(8)
    sets = {i: sorted(rng.sample(range(40), 30)) for i in range(60)}
    groups = {i: min(i, 20) for i in sets}  # the last forty are one group already
    rows = [(band, i, groups[i]) for i in sets for band in (1, 2)]
    frame = spark.createDataFrame([(i, len(t), t) for i, t in sets.items()], "doc_id long, n long, tokens array<long>")
    out = minhash.crossing_links(spark.createDataFrame(rows, "band long, doc_id long, g long"), frame, 68, block=block).collect()
    assert all(len(set(sets[r.a]) & set(sets[r.b])) == r.overlap and 100 * r.overlap >= 68 * (60 - r.overlap) and groups[r.a] != groups[r.b] for r in out)

    def parts(pairs):
        least = {g: g for g in groups.values()}

        def find(g):
            while least[g] != g:
                g = least[g]
            return g

        for a, b in pairs:
            p, q = find(groups[a]), find(groups[b])
            least[max(p, q)] = min(p, q)
        return {g: find(g) for g in least}

    every = [(a, b) for a in sets for b in sets if a < b and groups[a] != groups[b] and 100 * (k := len(set(sets[a]) & set(sets[b]))) >= 68 * (60 - k)]
    assert parts(every) == parts([(r.a, r.b) for r in out]) and len(set(parts(every).values())) > 1


def test_near_duplicates_of_an_empty_table(spark):
    out = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.documents.collect() == [] == out.links.collect()


def test_vectors_that_share_an_id_are_queries_and_candidates_of_their_own(spark):
    rng = np.random.default_rng(9)
    rows = [(i // 2, rng.standard_normal(8).astype(np.float32).tolist(), i, 0) for i in range(120)]  # every id twice
    rows += [(40, rows[80][1], 200, 0), (7, rows[80][1], 201, 0)]  # and one vector three times, twice under one id
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row long, asker int")
    got = nearest.nearest(frame, every=20, k=5).collect()
    want = Counter()
    for i, (q, v, *_) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-float(sum(float(a) * float(b) for a, b in zip(v, w, strict=True))), other) for j, (other, w, *_) in enumerate(rows) if j != i)
            want.update((q, r + 1, other) for r, (_, other) in enumerate(scored[:5]))
    assert Counter((r.query_id, r.rank, r.vec_id) for r in got) == want


def test_packing_deals_runs_of_rows_whatever_their_keys(spark):
    rows = [(None, 0, 0, 1 + i % 50) for i in range(3000)] + [(i, 0, 0, 1 + i % 70) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long").repartition(7)
    out = packing.pack(frame, capacity=100, pieces_per_shard=500).collect()
    shards = Counter(r.sequence_id >> 20 for r in out)
    assert sorted(shards) == list(range(12)) and set(shards.values()) == {500}
    assert Counter((r.doc_id, r.length) for r in out) == Counter((i, n) for i, _, _, n in rows)
    fills = Counter()
    for r in out:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 100 and len(fills) <= 1.01 * sum(fills.values()) / 100 + 12


def test_documents_are_packed_in_the_mix_that_they_come_in(spark):
    rows = [(i, f"word{i % 7} " * (20 + i % 30), f"s{i % 3}") for i in range(900)]
    mixed = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    pieces = packing.token_pieces(mixed, public_tokenizers.path("word_bpe_49k.json"), 4096, 1).select("doc_id", "piece", "start", "length")
    out = packing.pack(pieces, capacity=4096, pieces_per_shard=200).collect()
    words, want = {}, {r.source: r.want for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).sources.collect()}
    for r in out:
        words.setdefault(r.sequence_id >> 20, Counter())[f"s{r.doc_id % 3}"] += r.length
    full = [c for c in words.values() if c.total() > 4000]
    assert len(full) >= 4
    for c in full:
        assert all(abs(c[s] / c.total() - want[s] / sum(want.values())) < 0.12 for s in want)
