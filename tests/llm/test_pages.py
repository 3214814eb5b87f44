from __future__ import annotations

import gzip
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import fixity, language

RECORDS = "file_no long, key long, record binary"
PAGES = "page_id long, url string, html string"


def tree_of(hashes):
    """Root of a file's leaves, in plain Python: a node hashes the lengths of the ranges below it, and their hashes."""
    level = [(n, hashlib.sha256(f"{n}:{h}".encode()).hexdigest()) for _, n, h in hashes]
    for k in range(1, fixity.LEVELS + 1):
        step = fixity.FANOUT if k < fixity.LEVELS else max(1, len(level))
        parts = [level[i : i + step] for i in range(0, len(level), step)]
        level = [(sum(n for n, _ in p), hashlib.sha256(";".join(f"{n}:{h}" for n, h in p).encode()).hexdigest()) for p in parts]
    return level[0][1]


@pytest.fixture(scope="module")
def records():
    rng = random.Random(6)
    return [(f, k, bytes(rng.randrange(256) for _ in range(rng.randint(0, 40)))) for f in range(3) for k in range(300)]


def test_roots_against_brute_force(spark, records):
    tree = fixity.merkle_tree(fixity.leaves(spark.createDataFrame(records, RECORDS)))
    roots = {r.file_no: r.hash for r in tree.filter(F.col("level") == fixity.LEVELS).collect()}
    for f in range(3):
        own, at = [], 0
        for _, _, b in sorted((r for r in records if r[0] == f), key=lambda r: r[1]):
            own.append((at, len(b), hashlib.sha256(b).hexdigest()))
            at += len(b)
        assert roots[f] == tree_of(own)


def test_audit_finds_exactly_the_damage(spark, records):
    hurt = {(0, 7), (2, 299)}
    other = [(f, k, bytes([b[0] ^ 1]) + b[1:] if (f, k) in hurt and b else b) for f, k, b in records]
    hurt = {(f, k) for f, k, b in records if (f, k) in hurt and b}
    out = fixity.audit_replica(spark.createDataFrame(records, RECORDS), spark.createDataFrame(other, RECORDS)).collect()
    assert len(out) == len(records)
    assert {(r.file_no, r.key) for r in out if r.state != "intact"} == hurt
    assert {r.state for r in out} == {"intact", "changed"} if hurt else {"intact"}


def test_audit_of_missing_and_extra_records(spark, records):
    one = spark.createDataFrame(records, RECORDS)
    out = fixity.audit_replica(one, one.filter("not (file_no = 1 and key >= 290)")).collect()
    assert {(r.file_no, r.key) for r in out if r.state == "missing"} == {(1, k) for k in range(290, 300)}
    out = fixity.audit_replica(one.filter("file_no != 2"), one).collect()
    assert sum(r.state == "extra" for r in out) == 300 and len(out) == len(records)
    none = spark.createDataFrame([], RECORDS)
    assert fixity.audit_replica(none, none).count() == 0


def test_a_file_of_many_records_has_more_levels(spark, monkeypatch):
    monkeypatch.setattr(fixity, "LEVELS", 1)
    rows = [(0, k, b"%d" % k) for k in range(300)]
    own = fixity.leaves(spark.createDataFrame(rows, RECORDS))
    assert fixity.levels_of(own) == 3
    top = fixity.merkle_tree(own).filter("level = 3").collect()
    assert len(top) == 1 and (top[0].first, top[0].last) == (0, sum(len(b) for _, _, b in rows))
    rows[250] = (0, 250, b"xyz")
    out = fixity.audit_replica(spark.createDataFrame(rows, RECORDS), fixity.leaves(spark.createDataFrame([], RECORDS)).select("file_no", "key", F.lit(b"").alias("record")))
    assert {r.state for r in out.collect()} == {"missing"}
    other = [(f, k, b"abc" if k == 250 else b) for f, k, b in rows]
    out = fixity.audit_replica(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(other, RECORDS)).collect()
    assert {r.key for r in out if r.state != "intact"} == {250}


def test_only_mismatching_branches_are_compared(spark, records):
    trees = [fixity.merkle_tree(fixity.leaves(spark.createDataFrame(rows, RECORDS))) for rows in (records, records)]
    assert fixity.audit(*trees).count() == 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/é", "<p>é</p>"), (2, None, None), (None, "u", "x\r\n\r\ny"), (2, "u", "<p>")], PAGES).withColumn("record", F.lit(0)).withColumn("key", F.lit(0))
    records = fixity.page_records(pages, per_file=10)
    files = records.groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct(F.col("key"), F.hex("record").alias("hex")))).alias("r"))
    files = files.select("file_no", F.unhex(F.array_join(F.transform("r", lambda x: x["hex"]), "")).alias("content"))
    found = fixity.read_records(files).collect()
    assert sorted(bytes(r.record) for r in found) == sorted(bytes(r.record) for r in records.collect())
    leaves = {bytes.fromhex(r.hash): r for r in fixity.leaves(records).collect()}
    assert len(leaves) == 4 and {r.offset for r in found if r.file_no == 0} == {r.offset for r in leaves.values() if r.file_no == 0}
    assert list(fixity.parse_warc(b"not a record")) == []


WORDS = {"en": "the house and the river with green stones under the hill", "fr": "la maison et la rivière avec des pierres vertes sous le pont", "de": "das haus und der fluss mit grünen steinen unter dem berg"}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    docs = [(" ".join(rng.choices(w.split(), k=60)), x) for x, w in WORDS.items() for _ in range(10)] + [("zz", "rare"), (None, None), ("", "en")]
    return language.train(spark.createDataFrame(docs, "text string, lang string"))


def page(i, lang, n=40, declared=None, host="h.example.org"):
    text = " ".join(random.Random(i).choices(WORDS[lang].split(), k=n)) if n else ""
    return i, f"http://{host}/{i}", f'<html lang="{declared or lang}"><script>var the = 1;</script><body><p>{text}</p></body></html>'


def test_language_by_text(spark, model):
    assert model[0] == ["de", "en", "fr"]
    rows = [page(i, ("en", "fr", "de")[i % 3]) for i in range(30)]
    got = {r.page_id: (r.lang, r.text_lang) for r in language.identify(spark.createDataFrame(rows, PAGES), model).collect()}
    assert got == {i: (("en", "fr", "de")[i % 3],) * 2 for i in range(30)}


def test_evidence_beside_the_text(spark, model):
    rows = [page(i, "fr", host="a.site.fr") for i in range(20)] + [page(20 + i, "en", host="b.site.com") for i in range(20)]
    rows += [page(90, "fr", 0, "fr", "a.site.fr"), page(91, "en", 0, "en", "b.site.com"), (92, "http://a.site.fr/x", "<p></p>"), page(93, "en", 60, "fr", "b.site.com")]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, PAGES), model).collect()}
    assert (got[90].lang, got[90].text_lang, got[91].lang) == ("fr", None, "en")
    assert got[92].lang == "fr" and got[92].declared is None
    assert got[93].lang == "en"  # text and host outweigh a wrong declaration
    assert all(0 < r.probability <= 1 for r in got.values())


def test_pages_without_anything(spark, model):
    rows = [(1, None, None), (None, "", ""), (2, "no address", "<"), (2, "no address", "<")]
    odd = spark.createDataFrame(rows, PAGES)
    for name in ("lang", "text", "host", "best", "ll", "own"):
        odd = odd.withColumn(name, F.lit(1))
    out = language.identify(odd, model).collect()
    assert len(out) == 4 and all(r.lang in model[0] for r in out)
    assert language.identify(spark.createDataFrame([], PAGES), model).count() == 0
    empty = language.train(spark.createDataFrame([], "text string, lang string"))
    assert [r.lang for r in language.identify(spark.createDataFrame(rows, PAGES), empty).collect()] == [None] * 4


def words_of_language(k):
    rng = random.Random(1000 + k)
    return ["".join(rng.choices("abcdefghijklmnoprstuvyz", k=rng.randint(3, 8))) for _ in range(40)]


def test_every_language_of_the_documents_is_known(spark):
    many = {f"{chr(97 + k // 26)}{chr(97 + k % 26)}": words_of_language(k) for k in range(70)}
    rng = random.Random(3)
    docs = [(" ".join(rng.choices(w, k=80)), x) for k, (x, w) in enumerate(many.items()) for _ in range(4 if k == 69 else 1 if k == 68 else 6)]
    model = language.train(spark.createDataFrame(docs, "text string, lang string"))
    rows = [(k, f"http://h{k}.example.org/", f"<p>{' '.join(rng.choices(w, k=60))}</p>") for k, w in enumerate(many.values())]
    got = {r.page_id: (r.lang, r.text_lang) for r in language.identify(spark.createDataFrame(rows, PAGES), model).collect()}
    assert got == {k: (x, x) for k, x in enumerate(many)}


def test_a_language_only_markup_names(spark, model):
    other = words_of_language(99)
    rows = [page(i, "en", host="a.site.com") for i in range(30)]
    rows += [(100 + i, f"http://b.site.xx/{i}", f'<html lang="xx"><p>{" ".join(random.Random(i).choices(other, k=60))}</p>') for i in range(20)]
    rows += [page(200, "en", 60, "xx", "a.site.com"), (201, "http://b.site.xx/empty", '<html lang="xx"></html>'), (202, "http://c.site.yy/", f'<html lang="yy"><p>{" ".join(other)}</p>')]
    out = language.identify(spark.createDataFrame(rows, PAGES), model).collect()
    got = {r.page_id: (r.lang, r.text_lang) for r in out}
    assert len(out) == len(rows) and all(0 < r.probability <= 1 for r in out)
    assert all(got[i] == ("en", "en") for i in range(30)) and all(got[100 + i] == ("xx", None) for i in range(20))
    assert got[200] == ("en", "en") and got[201] == ("xx", None) and got[202] == ("yy", None)


def test_a_record_that_grew_is_told_from_those_it_moved(spark):
    rows = [(f, k, b"WARC/1.1 %d %d" % (f, k) * 5) for f in (1, 2) for k in range(100)]
    other = [(f, k, r + b"x" if (f, k) == (1, 10) else r) for f, k, r in rows]
    out = fixity.audit_replica(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(other, RECORDS)).collect()
    assert {(r.file_no, r.key): r.state for r in out} == {(f, k): "changed" if (f, k) == (1, 10) else "moved" if f == 1 and k > 10 else "intact" for f, k, _ in rows}


def test_gzip_members_are_records(spark):
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"b" * n) for n in (0, 5, 9000)]
    packed = [gzip.compress(r) for r in records]
    content = b"".join(packed)
    found = list(fixity.parse_warc(content))
    assert [(r, len(b)) for _, r, b in found] == [(r, n) for r, n in zip(records, (0, 5, 9000), strict=True)]
    assert [at for at, *_ in found] == [0, len(packed[0]), len(packed[0]) + len(packed[1])]
    assert len(list(fixity.parse_warc(content[:-3]))) == 2 and list(fixity.parse_warc(b"\x1f\x8bno")) == []
    rows = fixity.read_records(spark.createDataFrame([(1, content), (2, None)], "file_no long, content binary")).collect()
    assert [(r.file_no, r.ord, r.record) for r in rows] == [(1, i, r) for i, r in enumerate(records)]


def test_posteriors_against_a_plain_computation(spark, model):
    rng = random.Random(21)
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "en", "fr", "de"])
        rows.append(page(i, lang, rng.choice([0, 1, 3, 60]), rng.choice([None, None, lang, "fr"]), rng.choice(["a.site.fr", "b.site.fr", "www.x.com", "y.de", "one.y.de"])))
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, PAGES), model, strength=3.0).collect()}
    seen = {r.page_id: r for r in language.page_evidence(spark.createDataFrame(rows, PAGES)).collect()}
    langs, weights = model.langs + model.rare, [*model.weights, *model.rare_weights]
    n = len(langs)
    scores, best = {}, {}
    for i, r in seen.items():
        grams = language.gram_counts(r.text.encode()).tolist()
        means = [sum(float(w[g]) for g in grams) / len(grams) * min(len(grams), 60.0) if grams else 0.0 for w in weights]
        scores[i] = [m - max(means) for m in means]
        best[i] = max(range(n), key=lambda k: (scores[i][k], -k)) if len(r.text) > 1 else None
    told = [i for i, r in seen.items() if r.declared is not None and best[i] is not None]
    trust = min(0.99, (sum(seen[i].declared == langs[best[i]] for i in told) + 1) / (len(told) + 2))

    def shares(i, same, parent):
        counts = [sum(1 for j in seen if j != i and best[j] == k and same(seen[j])) for k in range(n)]
        raw = [c + 3.0 * p for c, p in zip(counts, parent, strict=True)]
        return [x / sum(raw) for x in raw]

    for i, r in seen.items():
        everywhere = shares(i, lambda _: True, [1 / n] * n)
        domain = shares(i, lambda o, r=r: o.domain == r.domain, everywhere)
        host, suffix = shares(i, lambda o, r=r: o.host == r.host, domain), shares(i, lambda o, r=r: o.suffix == r.suffix, everywhere)
        logs = []
        for k, x in enumerate(langs):
            said = 0.0 if r.declared is None else math.log(trust) if r.declared == x else math.log((1 - trust) / (n - 1))
            logs.append(scores[i][k] + said + math.log(suffix[k] / everywhere[k]) / 2 + math.log(host[k]))
        top = max(logs)
        assert got[i].lang == langs[logs.index(top)]
        assert got[i].probability == pytest.approx(1 / sum(math.exp(v - top) for v in logs), rel=1e-4)
        assert got[i].text_lang == (langs[best[i]] if best[i] is not None else None)
