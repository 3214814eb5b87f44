"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import fixity, language, lines, minhash, mixing, nearest, ngram_join, packing, quality, repeats, rules, search, spelling


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(mixing.mix_sources(_table(spark, sf_dir, "documents")))


def op2_drop_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=4, percent=85)
    return joined.documents.select("doc_id", "n_shingles", "component_id")


def op4_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archive against a replica in which one byte of every 97th page is damaged."""
    pages = _table(spark, sf_dir, "pages")
    hurt = F.concat(F.lit("?"), F.expr("substring(html, 2)"))
    replica = pages.withColumn("html", F.when(F.col("page_id") % 97 == 13, hurt).otherwise(F.col("html")))
    out = fixity.audit_replica(fixity.page_records(pages), fixity.page_records(replica))
    return out.select(F.col("key").alias("page_id"), "file_no", "offset", "length", F.col("hash").alias("sha256"), "state")


def op9_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(_table(spark, sf_dir, "documents"))
    return language.identify(_table(spark, sf_dir, "pages"), model)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_drop_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.drop_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    out = quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=5, percent=85).documents
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents, one run in 97 of them (chosen by a hash) misspelt by a letter left out."""
    runs = spelling.lower_runs(_table(spark, sf_dir, "documents"), r"[A-Za-z\u00C0-\u00FF]", 5)
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % 97 == 0, short).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= 5)
    return spelling.spelling_variants(spelling.counted(words, 3))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_drop_repeated_lines": op2_drop_repeated_lines,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_fixity_audit": op4_fixity_audit,
    "op5_quality_rules": op5_quality_rules,
    "op6_pack_documents": op6_pack_documents,
    "op7_drop_repeated_passages": op7_drop_repeated_passages,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_identify_language": op9_identify_language,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_ranked_search": op11_ranked_search,
    "op12_near_duplicates": op12_near_duplicates,
    "op13_spelling_variants": op13_spelling_variants,
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op4_fixity_audit": r"""
WITH r AS (
  SELECT page_id, page_id // 4096 AS file_no, chr(13) || chr(10) AS nl, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), w AS (
  SELECT page_id, file_no, html, 'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:record:' || page_id || '>' || nl || 'WARC-Target-URI: ' || url || nl ||
    'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS record FROM r
), h AS (SELECT page_id, file_no, html, strlen(record)::BIGINT AS length, sha256(record) AS sha256 FROM w)
SELECT page_id, file_no, coalesce(sum(length) OVER (PARTITION BY file_no ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length, sha256,
  CASE WHEN page_id % 97 = 13 AND html <> '' AND left(html, 1) <> '?' THEN 'changed' ELSE 'intact' END AS state
FROM h
""",
    "op1_mix_sources": r"""
WITH z AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM z GROUP BY source
), w AS (
  SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, (sum(source_size) OVER ())::BIGINT AS total FROM s
), f AS (
  SELECT *, row_number() OVER o AS ord,
    3 * total - 4 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS l,
    2 * (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws
  FROM w WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, no)
), g AS (
  SELECT *, min(CASE WHEN NOT (l::DOUBLE * weight / ws >= source_size * 2) THEN ord END) OVER () AS open FROM f
), t AS (
  SELECT no, source, source_size,
    CASE WHEN open IS NULL OR ord < open THEN (source_size * 2)::DOUBLE
      ELSE (weight * max(CASE WHEN ord = open THEN l END) OVER ())::DOUBLE / max(CASE WHEN ord = open THEN ws END) OVER () END AS target
  FROM g
), v AS (
  SELECT *, least(least(256, greatest(1, (sum(want) OVER ())::BIGINT // 1048576)), 1::BIGINT << (length(bin(want // 64)) - 1)) AS block FROM (SELECT *, floor(target + 0.5)::BIGINT AS want FROM t) WHERE want > 0
), c AS (
  SELECT *, (sum(want) OVER (PARTITION BY block ORDER BY no))::BIGINT AS upto, (sum(want) OVER (PARTITION BY block))::BIGINT AS words FROM v
), slots AS (
  SELECT block, k % 2147483648 * 1327217885 % 2147483648 / 2147483648.0::DOUBLE AS u FROM (SELECT block, unnest(range((words + block - 1) // block)) AS k FROM (SELECT DISTINCT block, words FROM c))
), drawn AS (
  SELECT no, count(*) * any_value(c.block) AS drawn FROM slots JOIN c ON slots.block = c.block AND u >= (upto - want)::DOUBLE / words AND u < upto::DOUBLE / words GROUP BY no
), p AS (
  SELECT z.doc_id, z.size, t.source_size, t.target, coalesce(d.drawn, 0) AS drawn,
    coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY md5(coalesce(z.doc_id::VARCHAR, '') || ':mix'), z.doc_id, z.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN drawn d ON d.no = t.no
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(place + size, drawn) - place) + greatest(0, least(source_size + place + size, drawn) - (source_size + place)))::BIGINT AS taken
FROM p
""",
    "op2_drop_repeated_lines": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPACES}) AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), d AS (
  SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
""",
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 85 * (x.n + y.n - o)
), r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id
""",
    "op5_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3)
), d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM t) WHERE k > 1
), rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY doc_id
), x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
), dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), c1 AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS dense FROM w
), c2 AS (SELECT *, regexp_replace(dense, '[a-z]+', '', 'g') AS r0 FROM c1
), c3 AS (SELECT *, regexp_replace(r0, '[A-Z]+', '', 'g') AS r1 FROM c2
), c4 AS (SELECT *, regexp_replace(r1, '[0-9]+', '', 'g') AS r2 FROM c3
), c5 AS (SELECT *, regexp_replace(r2, '[.,;:!?''"()-]+', '', 'g') AS r3 FROM c4
), c6 AS (SELECT *, regexp_replace(r3, '[\x00-\x7F]+', '', 'g') AS r4 FROM c5
), b AS (
  SELECT c6.doc_id, lang, len(ws)::BIGINT AS n_words, length(dense)::BIGINT AS word_chars, length(regexp_replace(r0, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(text) AS chars,
    [length(text) - length(dense), length(dense) - length(r0), length(r0) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4), length(r4)] AS cls
  FROM c6 LEFT JOIN dl ON dl.doc_id = c6.doc_id LEFT JOIN rep ON rep.doc_id = c6.doc_id
), lw AS (SELECT doc_id, lang, unnest(string_split(lower(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), ' ')) AS word FROM w
), cw AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM lw WHERE word <> '' GROUP BY lang, word
), hits AS (SELECT l.doc_id, c.r, count(*) AS k FROM lw l JOIN cw c ON c.lang = l.lang AND c.word = l.word AND c.r <= 12 GROUP BY l.doc_id, c.r
), spread AS (
  SELECT doc_id, lang, 1 AS kind, i AS r, cls[i] AS k FROM (SELECT *, unnest(range(1, 8)) AS i FROM b)
  UNION ALL SELECT b.doc_id, lang, 2, h.r, h.k FROM b JOIN hits h ON h.doc_id = b.doc_id
  UNION ALL SELECT b.doc_id, lang, 2, 99, n_words - coalesce(h.k, 0) FROM b LEFT JOIN (SELECT doc_id, sum(k) AS k FROM hits GROUP BY doc_id) h ON h.doc_id = b.doc_id
), q AS (SELECT lang, kind, r, sum(k) / sum(sum(k)) OVER (PARTITION BY lang, kind) AS q FROM spread GROUP BY lang, kind, r
), tot AS (SELECT doc_id, kind, greatest(sum(k), 1) AS n FROM spread GROUP BY doc_id, kind
), js AS (
  SELECT doc_id, kind, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d
  FROM (SELECT b.doc_id, q.kind, q.q, coalesce(s.k, 0) / t.n AS p FROM b JOIN q ON q.lang = b.lang JOIN tot t ON t.doc_id = b.doc_id AND t.kind = q.kind LEFT JOIN spread s ON s.doc_id = b.doc_id AND s.kind = q.kind AND s.r = q.r) z GROUP BY doc_id, kind
), lt AS (SELECT lang, sum(n_words) AS n FROM b GROUP BY lang
), v AS (
  SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    lt.n >= 2000 AND ((chars >= 200 AND sqrt(greatest(j1.d, 0)) > 0.3) OR (n_words >= 100 AND sqrt(greatest(j2.d, 0)) > 0.3)) AS far
  FROM b JOIN lt ON lt.lang = b.lang LEFT JOIN js j1 ON j1.doc_id = b.doc_id AND j1.kind = 1 LEFT JOIN js j2 ON j2.doc_id = b.doc_id AND j2.kind = 2
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(far, false) AS kept FROM v
""",
    "op11_ranked_search": r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), d AS (SELECT doc_id, row_no, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0
), z AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM d
), q AS (
  SELECT item_id, item_no, term, count(*) AS times FROM (
    SELECT item_id, row_number() OVER () AS item_no, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, item_no, term
), p AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row_no, term
), w AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN z GROUP BY term
), i AS (
  SELECT p.row_no, p.term, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + (25 * d.n * z.n_docs) // z.total))) AS part
  FROM p JOIN d ON d.row_no = p.row_no JOIN w ON w.term = p.term CROSS JOIN z
), s AS (SELECT q.item_id, q.item_no, i.row_no, sum(q.times * i.part)::BIGINT AS score FROM q JOIN i ON i.term = q.term GROUP BY q.item_id, q.item_no, i.row_no
), r AS (SELECT s.item_id, d.doc_id, s.score, row_number() OVER (PARTITION BY s.item_no ORDER BY s.score DESC, d.doc_id NULLS LAST) AS rank FROM s JOIN d ON d.row_no = s.row_no WHERE s.score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
""",
    "op12_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 85 * (x.n + y.n - o)
), r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE bit AS (
  SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) FROM bit WHERE k < 8
), tab AS (SELECT list(c ORDER BY b) AS t FROM bit WHERE k = 8
), o AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), u AS (SELECT doc_id, run, count(*) AS times FROM o WHERE length(run) >= 5 GROUP BY doc_id, run
), y AS (SELECT run, times, hex(encode(doc_id || ':' || run)) AS hx FROM u
), z AS (SELECT run, times, list_transform(range(1, len(hx) + 1, 2), lambda i: (instr('0123456789ABCDEF', hx[i]) * 16 + instr('0123456789ABCDEF', hx[i + 1]) - 17)::BIGINT) AS bytes FROM y
), h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM z CROSS JOIN tab
), v AS (
  SELECT word, sum(times)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), e AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), g AS (
  SELECT a.word AS a, b.word AS b FROM e a JOIN e b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word FROM e a JOIN v b ON a.less = b.word
  UNION SELECT b.word, a.word FROM e a JOIN v b ON a.less = b.word
), f AS (SELECT g.a, count(*)::BIGINT AS n_near, max(v.n) AS top FROM g JOIN v ON v.word = g.b GROUP BY g.a
), m AS (SELECT f.a, min(g.b) AS form FROM f JOIN g ON g.a = f.a JOIN v ON v.word = g.b AND v.n = f.top JOIN v x ON x.word = f.a WHERE f.top >= 2 * x.n GROUP BY f.a
), c AS (SELECT word, word AS reached, 0 AS k FROM v UNION ALL SELECT c.word, m.form, c.k + 1 FROM c JOIN m ON m.a = c.reached
), r AS (SELECT word, arg_max(reached, k) AS root FROM c GROUP BY word)
SELECT v.word, m.form, r.root, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, CASE WHEN m.form IS NOT NULL THEN f.top END AS form_n
FROM v LEFT JOIN f ON f.a = v.word LEFT JOIN m ON m.a = v.word JOIN r ON r.word = v.word
""",
}
