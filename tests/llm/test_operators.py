from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import lines, mixing, nearest, ngram_join, packing, quality, repeats, rules
from quire.llm.common import connected_components
from quire.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema=DOCS):
    full = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows] if schema == DOCS else rows
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages and lines, a long text, blank, null and repeated rows."""
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)] + ["Ünï", "the", "The", "of"]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    base, passage, line = prose(220), prose(60), "This line stands in many of the documents, word for word."
    rows = [(i, prose(rng.randint(30, 160)), f"s{i % 4}") for i in range(30)]
    rows += [(30 + i, base, "s0") for i in range(8)]
    for i in range(40):
        w = base.split(" ")
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(10**6)
        rows.append((100 + i, " ".join(w), "s0"))
    rows += [(200 + i, f"{prose(25)} {passage} {prose(25)}", None) for i in range(6)]
    rows += [(300 + i, f"{prose(12)}\n  {line.upper() if i % 2 else line}\t\n{prose(9)}\n{line}", "s1") for i in range(7)]
    rows += [(400, "", "s2"), (401, None, "s2"), (402, " \t\n ", "s2"), (403, "one two", "s2"), (404, "one two", "s9"), (500, prose(3000), "s3"), (501, "ab" * 400, "s3"), (502, "ab" * 400, "s3")]
    return rows


def test_mixing_meets_its_targets(spark, corpus):
    mix = mixing.mix_sources(frame(spark, corpus), block_words=16)
    rows = mixing.words_taken(mix).collect()
    assert len(rows) == len(corpus)
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in corpus}
    by_source = defaultdict(int)
    for i, t, s in corpus:
        by_source[s] += sizes[i]
    got, target = defaultdict(int), {}
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.taken <= 2 * r.size
        s = next(s for i, _, s in corpus if i == r.doc_id)
        assert r.source_size == by_source[s]
        got[s] += r.taken
        target[s] = r.target
    assert all(abs(got[s] - target[s]) <= 4 * 16 for s in got)  # a few blocks: what a source gets is what its slots draw
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(target[s] <= 2 * by_source[s] + 1e-9 for s in target)
    again = {r.doc_id: r.taken for r in mixing.words_taken(mixing.mix_sources(frame(spark, corpus), block_words=16)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mix_is_even_all_along(spark, corpus):
    mix = mixing.mix_sources(frame(spark, corpus), block_words=16)
    want, block = ({r.source_no: r[c] for r in mix.sources.collect()} for c in ("want", "block_words"))
    assert set(block.values()) > {16}
    slots = sorted((r.turn, r.source_no) for r in mix.schedule.collect())
    seen, total = Counter(), sum(want.values())
    for turn, s in slots:
        seen[s] += block[s]
        if turn < 0.9:
            assert all(abs(seen[x] - sum(seen.values()) * want[x] / total) <= 6 * 16 for x in want)


def test_small_sources_meet_their_targets_in_large_blocks(spark):
    rows = [(i, "w " * 3000, "big") for i in range(30)] + [(1000 + i, "w " * (50 + 7 * i), f"small{i:02d}") for i in range(12)]
    out = mixing.words_taken(mixing.mix_sources(frame(spark, rows), block_words=256)).collect()
    small = [r for r in out if r.doc_id >= 1000]
    assert len(small) == 12
    assert all(abs(r.taken - r.target) <= max(4, 0.07 * r.target) for r in small)
    big = [r for r in out if r.doc_id < 1000]
    assert abs(sum(r.taken for r in big) - big[0].target) <= 4 * 256


def test_the_schedule_decides_what_is_taken(spark, corpus, monkeypatch):
    def run():
        return {r.doc_id: r.taken for r in mixing.words_taken(mixing.mix_sources(frame(spark, corpus), block_words=16)).collect()}

    before = run()
    monkeypatch.setattr(mixing, "GOLDEN", 1)  # all slots of the first source come first, and none of the last
    assert run() != before


def test_the_mix_is_delivered_in_the_order_of_its_slots(spark):
    rows = [(i, f"d{i} " * 40, f"s{i % 3}") for i in range(300)]
    out = mixing.mixed_documents(frame(spark, rows)).collect()
    want = {r.source: r.want for r in mixing.mix_sources(frame(spark, rows)).sources.collect()}
    seen, total = Counter(), sum(want.values())
    for k, r in enumerate(out[: int(len(out) * 0.9)], 1):
        seen[r.source] += len(r.text.split())
        assert all(abs(seen[s] - sum(seen.values()) * want[s] / total) <= 6 * 40 for s in want)
    assert len(out) > 400 and set(seen) == set(want)


def test_rows_equal_in_all_are_taken_as_often_as_they_come(spark):
    rows = [(1, "one two three four", "s")] * 3 + [(2, "five six", "s"), (3, "seven", "t")]
    out = Counter(r.doc_id for r in mixing.mixed_documents(frame(spark, rows), block_words=1, share=(2, 1)).collect())
    assert out[1] == 6 and out[2] == 2


def test_mixed_documents_hold_what_is_taken(spark, corpus):
    docs = frame(spark, corpus)
    taken = {r.doc_id: r.taken for r in mixing.words_taken(mixing.mix_sources(docs)).collect()}
    out = Counter()
    for r in mixing.mixed_documents(docs).collect():
        out[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert out == Counter({i: n for i, n in taken.items() if n})


def expected_lines(corpus):
    trans = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(x):
        return x.translate(trans).strip(" \t\n\x0b\x0c\r")

    held = defaultdict(set)
    for i, t, _ in corpus:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    out = {}
    for i, t, _ in corpus:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(held[key(x)]) >= 5 and max(held[key(x)]) != i)]
        out[i] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_against_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.drop_repeated_lines(frame(spark, corpus)).collect()}
    assert got == expected_lines(corpus)
    assert sum(n for _, n, _ in got.values()) > 10


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**32))
def test_minimal_perfect_hash(n, seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 2**63, (n, 2), dtype=np.int64), axis=0).view(np.uint64)
    sizes, bits = lines.build_hash(h[:, 0].copy(), h[:, 1].copy())
    assert sorted(lines.look_up(sizes, bits, h[:, 0].copy(), h[:, 1].copy())) == list(range(len(h)))


def components(sets, percent):
    ids = sorted(i for i, s in sets.items() if s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            o = len(sets[a] & sets[b])
            if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def sets_of(corpus, n):
    out = {}
    for i, t, _ in corpus:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_against_brute_force(spark, corpus, n, percent):
    sets = sets_of(corpus, n)
    want = components(sets, percent)
    joined = ngram_join.ngram_jaccard_join(frame(spark, corpus), n=n, percent=percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in joined.documents.collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    for r in joined.links.collect():
        o = len(sets[r.a] & sets[r.b])
        assert r.overlap == o and 100 * o >= percent * (r.a_size + r.b_size - o)


def test_ngram_join_of_a_large_near_group(spark):
    rng = random.Random(9)
    base = ["b%d" % i for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "e%d" % rng.randrange(10**7)
        rows.append((i, " ".join(w), "s"))
    want = components(sets_of(rows, 4), 85)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(frame(spark, rows), n=4, percent=85).documents.collect()}
    assert got == want
    assert len(set(want.values())) > 1


def test_links_of_a_large_group_stay_few(spark):
    base = ["b%d" % i for i in range(100)]
    found = {}
    for m in (60, 120):
        rows = [(0, " ".join(base), "s")]
        for i in range(m):
            one, two = list(base), list(base)
            one[5 + i % 80] = f"own{i}"
            two[20], two[60], two[80] = "c1", "c2", f"x{i}"
            rows += [(1 + i, " ".join(one), "s"), (10000 + i, " ".join(two), "s")]
        joined = ngram_join.ngram_jaccard_join(frame(spark, rows), n=4, percent=85)
        assert {r.doc_id: r.component_id for r in joined.documents.collect()} == components(sets_of(rows, 4), 85)
        found[m] = joined.links.count()
    assert found[120] < 2.5 * found[60] and found[120] < 3 * 240


def test_rows_that_share_a_doc_id_lose_no_link(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(7, text, "s"), (7, other, "s"), (9, text + " more", "s")]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(frame(spark, rows)).documents.collect()}
    assert got == {7: 7, 9: 7}


def test_one_per_group_keeps_the_rest(spark, corpus):
    want = components(sets_of(corpus, 5), 80)
    kept = sorted(r.doc_id for r in ngram_join.one_per_group(frame(spark, corpus)).collect())
    assert kept == sorted(i for i, c in want.items() if i == c)


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert all(got.get(x, x if x in loops else None) == find(x) for x in root)


def test_passages_against_brute_force(spark, corpus):
    got = {r.doc_id: r for r in repeats.drop_repeated_passages(frame(spark, corpus), runs_per_shard=500).collect()}
    seen = set()
    for i, t, _ in sorted(corpus, key=lambda r: r[0]):
        data = (t or "").encode()
        mask = bytearray(len(data))
        for at in range(len(data) - 99):
            s = data[at : at + 100]
            if s in seen:
                mask[at : at + 100] = b"\1" * 100
            seen.add(s)
        r = got[i]
        kept = bytes(c for c, m in zip(data, mask, strict=True) if not m)
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(data), sum(mask), len(re.findall(b"\1+", bytes(mask))), kept)


def test_passages_of_many_copies_and_of_long_texts(spark):
    rng = random.Random(12)
    shared = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))
    rows = [(i, f"{rng.randrange(10**9)} {shared} {rng.randrange(10**9)}", "s") for i in range(400)]
    long = " ".join(f"l{i}" for i in range(400_000)) + " " + shared
    rows.append((1000, long, "s"))
    got = {r.doc_id: r for r in repeats.drop_repeated_passages(frame(spark, rows), runs_per_shard=300).collect()}
    first = rows[0][1]
    assert got[0].n_removed == 0 and got[1000].n_removed >= len(shared) and bytes(got[1000].kept).startswith(long[: len(long) - len(shared) - 20].encode())
    for i, t, _ in rows[1:400]:
        mask = bytearray(len(t))
        for at in range(len(t) - 99):
            if any(t[at : at + 100] in u for _, u, _ in rows[: min(i, 3)]) or t[at : at + 100] in first:
                mask[at : at + 100] = b"\1" * 100
        assert got[i].n_removed >= sum(mask) > len(shared) - 2
    with pytest.raises(ValueError):
        repeats.drop_repeated_passages(frame(spark, rows), length=20, k=32)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), max_size=4), st.integers(3, 12))
def test_anchor_runs_cover_every_string_once(texts, k):
    length = k + 7
    data = [t.encode() for t in texts]
    own, anchor, place, first, last = repeats._runs_of(data, length, k) if data else ([],) * 5
    starts = sorted((o, s) for o, f, l in zip(own, first, last, strict=True) for s in range(f, l + 1))
    assert starts == [(i, s) for i, t in enumerate(data) for s in range(len(t) - length + 1)]
    at = {}
    for o, p, f, l in zip(own, place, first, last, strict=True):
        for s in range(f, l + 1):
            assert f <= p <= s + length - k or s <= p <= s + length - k
            assert at.setdefault(data[o][s : s + length], p - s) == p - s  # equal strings have equal anchors


def test_rules_against_brute_force(spark, corpus):
    more = corpus + [(600, "a b c " * 40, "s"), (601, "x y\n\nx y\n z # | $\nx y", "s")]
    for r in rules.quality_rules(frame(spark, more)).collect():
        t = next(t for i, t, _ in more if i == r.doc_id) or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {i + d for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for d in range(3)}
        filled = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(filled) - len(set(filled)), len(marked))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_rules_distance_tells_shouting_from_prose(spark):
    rng = random.Random(2)
    words = ["the", "of", "and", "river", "stone", "house", "a", "to", "green", "walks"]
    rows = [(i, " ".join(rng.choices(words, k=150)) + ".", "s") for i in range(40)]
    rows.append((99, " ".join(f"{rng.choice('QXZ')}{rng.randrange(999)}!! ##" for _ in range(120)), "s"))
    got = {r.doc_id: r for r in rules.quality_rules(frame(spark, rows)).collect()}
    assert not got[99].kept and not got[99].base_failed
    assert sum(r.kept or r.base_failed for r in got.values()) == len(rows) - 1


def test_packing_round_trip(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = [(700, "Don't STOP 3.5kg | ||| x,,. Ünïcode é \x1c y <|endoftext|>", "s")]
    rows = packing.pack_documents(frame(spark, corpus + odd)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, t, _ in corpus + odd:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        got = sorted(pieces[i], key=lambda r: r.piece)
        assert len(got) == -(-len(ids) // 4096)
        for k, r in enumerate(got):
            cut = ids[k * 4096 : (k + 1) * 4096]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, k * 4096, len(cut), zlib.crc32(cut.tobytes()))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))]
        assert sum(n for _, n in b) <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_words_asked_of_the_model_are_encoded_as_whole_texts():
    import public_tokenizers

    words = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    letters = {c for i in range(0x250) for x in (chr(i), chr(i).upper(), chr(i).lower()) for c in x if c.isalpha()}
    for c in sorted(letters):
        for text in (c, f"{c}li", f"Sto{c}", f"a{c}{c}b.", f"{c}\u00c9,;"):
            assert words.encode(text) == words.whole(text), text


def test_only_what_has_no_letters_of_a_word_is_encoded_whole():
    import public_tokenizers

    words = packing._Words(public_tokenizers.path("word_bpe_49k.json"), remembered=20)
    text = " ".join(f"{w}{tail}" for w in ("are", "Stra\u00dfe", "\u00c9t\u00e9") for tail in ("", ".***", "###", "'", "$$$", "<|", "|>", '".)', "_-@", "&&&", "\\`~^", "{}[]=+/"))
    text += " it's don't' a<|endoftext|> <|endoftext|>. (b) c.d 4.** \u0130a% \u018f$ \u03a3\u03a3! e\u0301# q\u037e ***"
    want, asked, whole = words.whole(text), [], words.whole
    words.whole = lambda part: asked.append(part) or whole(part)
    for _ in range(3):  # more parts and words than are remembered
        assert words.encode(text) == want
    assert not [p for p in asked if p.rstrip(packing._Words.MARKS) in ("are", "Stra\u00dfe", "\u00c9t\u00e9")]
    assert len(words) <= 8 and len(words.words) <= 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_local_search_never_overfills_or_loses(sizes):
    lengths = np.array(sizes, np.int64)
    first = packing.best_fit(lengths, 100)
    done = packing.local_search([list(b) for b in first], lengths, 100)
    assert sorted(i for b in done for i in b) == list(range(len(sizes)))
    assert all(lengths[b].sum() <= 100 for b in done) and len(done) <= len(first)
    assert sum(int(lengths[b].sum()) ** 2 for b in done) >= sum(int(lengths[b].sum()) ** 2 for b in first)


def test_local_search_empties_a_bin():
    lengths = np.array([50, 50, 30, 30, 40, 60, 40], np.int64)
    done = packing.local_search([[0, 2], [1, 3], [5], [4, 6]], lengths, 100)
    assert len(done) == 3


@pytest.mark.parametrize(("low", "high", "over"), [(500, 1500, 2), (700, 2200, 20)])
def test_local_search_trades_between_all_underfull_bins(low, high, over):
    lengths = np.random.default_rng(1).integers(low, high + 1, 3000)
    first = packing.best_fit(lengths, 4096)
    assert sum(lengths[b].sum() < 4096 for b in first) > 300
    done = packing.local_search([list(b) for b in first], lengths, 4096)
    assert sorted(i for b in done for i in b) == list(range(3000))
    assert len(done) <= -(-lengths.sum() // 4096) + over
    short = [b for b in done if lengths[b].sum() < 4096]
    for b in short:  # no piece for nothing or for one piece would raise the sum of squares
        fill, back = lengths[b].sum(), np.array([0, *lengths[b]])
        for a in short:
            d = lengths[a][:, None] - back
            assert a is b or not ((d > 0) & (fill + d <= 4096) & (fill + d > lengths[a].sum())).any()


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(4)
    good, bad = ["house", "river", "green", "walks", "slowly", "under"], ["BUY!!", "NOW!!", "click", "$$$", "free"]
    rows = [(i, " ".join(rng.choices(good if i % 5 else bad, k=60)), "s") for i in range(400)] + [(900, "", "s"), (901, None, "s")]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)], "doc_id long, label int")
    out = quality.classify(frame(spark, rows), labels).collect()
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert held and all(r.predicted == int(r.doc_id % 5 > 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    sample = quality.training_sample(frame(spark, rows), labels).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in sample)


def test_scores_are_the_means_of_the_features(spark, corpus):
    model = quality.train([(t or "").encode() for _, t, _ in corpus], np.array([i % 2 for i, _, _ in corpus]), buckets=1 << 10)
    got = {r.row.doc_id: r.score for r in quality.scored(frame(spark, corpus), model).collect()}
    for i, t, _ in corpus:
        f = next(quality.features([(t or "").encode()], 1 << 10))
        z = model.bias + (float(model.weight[f].astype(np.float64).mean()) if len(f) else 0.0)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_training_stays_finite_and_its_sample_bounded(spark):
    rows = [(i % 5, f"tiny {i % 5}", "s") for i in range(3000)] + [(50 + i, "a", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, label int")
    sample = quality.training_sample(frame(spark, rows), labels, most_rows=40).collect()
    assert len(sample) == len({r.doc_id for r in sample}) <= 40
    model = quality.fit(frame(spark, rows), labels)
    assert np.isfinite(model.weight).all() and np.isfinite(model.bias)


@pytest.mark.parametrize("flat", [False, True])
def test_nearest_settles_ties_by_id_whatever_the_window(spark, flat):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 4)).astype(np.float32)
    if flat:
        v[:, 0] = 1.0
    v[0] = [1, 0, 0, 0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    out = [r for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=400, least_window=900).collect()]
    score = v.astype(np.float64) @ v[0].astype(np.float64)
    want = [int(i) for i in np.lexsort((np.arange(400), -score)) if i][:20]
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"])] == want


def test_nearest_recall_with_its_defaults(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((4000, 32))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    out = defaultdict(set)
    for r in nearest.nearest(rows, every=40).collect():
        out[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 40):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(out[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / 2000 >= 0.9


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 16)).astype(np.float32)
    v[200:320] = v[200]  # a frequent vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, 2.0]), (None, v[0].tolist())]
    out = defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), least_window=600).collect():
        out[r.query_id].append(r)
    x = v.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        got = sorted(out[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in got)
        assert all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id) for a, b in zip(got, got[1:], strict=False))
        hits += len({r.vec_id for r in got} & set(want.tolist()))
    assert hits / (75 * 20) >= 0.9
    assert [r.vec_id for r in sorted(out[200], key=lambda r: r["rank"])] == list(range(201, 221))
    assert set(out) == set(range(0, 1500, 20))


def test_hilbert_curve_steps_to_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = grid[np.argsort(nearest.hilbert_index(grid, 3))]
    assert sorted(nearest.hilbert_index(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_shingles_of_short_texts():
    sets = list(shingle_sets([b"a b c", b"A  B\tC\n", b"", b"a b c d e", b"a b"], 4))
    assert sets[0] == sets[1] and len(sets[2]) == 0 and len(sets[3]) == 2 and len(sets[4]) == 1


def test_empty_tables_and_clashing_columns(spark):
    none = frame(spark, [])
    assert mixing.words_taken(mixing.mix_sources(none)).count() == 0
    assert lines.drop_repeated_lines(none).count() == 0
    assert ngram_join.ngram_jaccard_join(none).documents.count() == 0
    assert repeats.drop_repeated_passages(none).count() == 0
    assert rules.quality_rules(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert quality.classify(none, spark.createDataFrame([], "doc_id long, label int")).count() == 0
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    odd = frame(spark, [(1, "a b c", "s"), (None, "a b c", None), (None, None, None), (1, "a b c", "s")])
    names = (
        "token size rank n key block words shard a b g u h x k1 k2 epoch slot copy taken rest row score start at end chunk drawn source_no target want id new drop "
        "_id _key _key2 _n _rep _copy _cut _spans _new _drop _doc _size _source _taken _rest z label unique rep c tokens prefixes class_id piece length ids _shard v point least"
    )
    for i, name in enumerate(names.split()):
        odd = odd.withColumn(name, F.lit(i))
    mine = {"n_lines": -1, "n_dropped": -2, "n_bytes": -3, "n_removed": -4, "n_spans": -5, "kept": -6, "held_out": -7, "predicted": -8}
    for name, i in mine.items():
        odd = odd.withColumn(name, F.lit(i))

    def same(df, replaced=()):
        rows = df.collect()
        assert set(df.columns) == set(odd.columns) and len(df.columns) == len(odd.columns)
        assert all(r[name] == i for r in rows for i, name in enumerate(names.split()) if name not in replaced)
        assert all(r[name] == i for r in rows for name, i in mine.items() if name not in replaced)
        return rows

    assert mixing.words_taken(mixing.mix_sources(odd)).count() == 4
    assert {r.n_lines for r in same(lines.drop_repeated_lines(odd), ("n_lines", "n_dropped"))} == {1}
    joined = ngram_join.ngram_jaccard_join(odd).documents.collect()
    assert sorted((r.doc_id or 0, r.n_shingles) for r in joined) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert len(same(ngram_join.one_per_group(odd))) == 4
    assert {r.n_bytes for r in same(repeats.drop_repeated_passages(odd), ("n_bytes", "n_removed", "n_spans", "kept"))} == {0, 5}
    assert rules.quality_rules(odd).count() == 4
    assert packing.pack_documents(odd).count() == 4
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, label int")
    assert len(same(quality.classify(odd, labels), ("held_out", "score", "predicted"))) == 4
    same(quality.keep_good(odd, labels))
    assert len(same(mixing.mixed_documents(odd))) > 0


def test_kept_hash_matches_text(spark, corpus):
    out = lines.drop_repeated_lines(frame(spark, corpus)).select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.h for r in out.collect())
