from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad prose, near copies, a line that many share, null, empty and repeated rows."""
    rng, at = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    good, bad = ["house", "river", "green", "walks", "slowly", "under", "stone", "hill"], ["BUY!!", "NOW!!", "click", "$$$", "free"]
    line = "This line stands in many of the documents, word for word, to the end."
    rows = []
    for i in range(120):
        text = " ".join(f"{w}{rng.randrange(40)}" for w in rng.choices(good, k=80)) if i % 4 else " ".join(rng.choices(bad, k=80))
        rows.append((i, f"{text}\n{line}" if i % 3 == 0 else text, f"s{i % 3}"))
    for i in range(20):  # near copies of document 1
        w = rows[1][1].split(" ")
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((200 + i, " ".join(w), "s1"))
    rows += [(300, "", "s0"), (301, None, "s0"), (302, rows[2][1], "s2"), (302, rows[2][1], "s2")]
    docs = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scores = {r.row.doc_id: r.score for r in quality.scored(docs, quality.fit(docs, labels)).collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard", "source_mixing", "packing"]

    kept = stages["quality_classifier"](spark, docs, folder)
    assert kept.columns == docs.columns
    want = sorted((r for r in docs.collect() if scores[r.doc_id] >= 0.7), key=str)
    assert sorted(kept.collect(), key=str) == want
    assert {r.doc_id for r in want} >= {i for i in range(120) if i % 4} and not {r.doc_id for r in want} & set(range(0, 120, 4))

    lined = stages["line_dedup"](spark, kept, folder)
    assert lined.columns == docs.columns
    held: dict[str, set] = {}
    for r in want:
        for x in (r.text or "").split("\n"):
            held.setdefault(x.strip().lower(), set()).add(r.doc_id)
    gone = {k for k, ids in held.items() if len(k) >= 40 and len(ids) >= 5}
    texts = {}
    for r in want:
        texts[r.doc_id] = "\n".join(x for x in (r.text or "").split("\n") if x.strip().lower() not in gone or max(held[x.strip().lower()]) == r.doc_id)
    found = lined.collect()
    assert gone and len(found) == len(want) and all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in found)

    single = stages["ngram_jaccard"](spark, lined, folder)
    assert single.columns == docs.columns
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = sorted((r for r in found if find(r.doc_id) == r.doc_id), key=str)
    assert sorted(single.collect(), key=str) == rows and len(rows) < len(found) - 15

    mixed = stages["source_mixing"](spark, single, folder)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.words_taken(mixing.mix_sources(single)).collect()}
    words: dict[int, int] = {}
    for r in mixed.collect():
        assert texts[r.doc_id].startswith(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert words == {i: n for i, n in taken.items() if n}

    packed = stages["packing"](spark, mixed, folder).collect()
    assert len(packed) == mixed.count()  # no text here is over a sequence
    fill: dict[int, list] = {}
    for r in packed:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in fill.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:k]) for k, (o, _) in enumerate(spans)) and sum(n for _, n in spans) <= 4096


def test_the_whole_pipeline_and_empty_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 50 and "sequence_id" in out.columns
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
