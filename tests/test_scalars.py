from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import scalars as S


def column(spark, values, schema, expr):
    rows = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in rows.select(expr.alias("out")).collect()]


def test_sizes(spark):
    values = [0, 1, 1023, 1024, 1536, 1048575, 1048576, 5767168]
    assert column(spark, values, "b long", S.format_size(F.col("b"))) == ["0 B", "1 B", "1023 B", "1 KB", "2 KB", "1024 KB", "1.0 MB", "5.5 MB"]


def test_kinds(spark):
    rows = [("a.PDF", ""), ("x.docx?v=1", ""), ("b.zip", ""), ("c.docx", "application/zip"), ("d", "application/pdf"), ("e.doc", ""), ("f.jpeg", "")]
    n, m = F.col("n"), F.col("m")
    assert column(spark, rows, "n string, m string", S.is_pdf(n, m)) == [True, False, False, False, True, False, False]
    assert column(spark, rows, "n string, m string", S.office_kind(n)) == [None, "docx", None, "docx", None, None, None]
    assert column(spark, rows, "n string, m string", S.is_zip(n, m)) == [False, False, True, False, False, False, False]
    assert column(spark, rows, "n string, m string", S.is_legacy_office(n))[5]
    assert column(spark, rows, "n string, m string", S.is_image(n, m))[6]
    assert column(spark, rows, "n string, m string", S.wrong_file_reason(n, m, F.lit("pdf"))) == [None, "other:docx", "zip", "other:docx", None, "legacy", "unknown"]


@pytest.mark.parametrize(
    ("name", "message", "kind"),
    [
        ("AbortError", "stopped", "interrupted"), ("PasswordException", "No password given", "password"), ("Error", "Array buffer allocation failed", "memory"),
        ("TypeError", "Failed to fetch", "network"), ("InvalidPDFException", "bad", "invalid"), ("Error", "Unsupported filter", "unsupported"),
        ("Error", "Choose one page at least.", "passthrough"), ("Error", "x is not a function", "generic"), ("Error", "y" * 300, "generic"),
    ],
)
def test_error_classes(spark, name, message, kind):
    assert column(spark, [(name, message)], "n string, m string", S.classify_error(F.col("n"), F.col("m"))) == [kind]
    assert column(spark, [(name, message)], "n string, m string", S.explain_error(F.col("n"), F.col("m")))[0]


def test_cell_refs_and_columns(spark):
    assert column(spark, ["A1", "Z9", "AA10", "$B$2", "1A", ""], "r string", S.parse_cell_ref(F.col("r"))) == [(0, 0), (8, 25), (9, 26), (1, 1), None, None]
    assert column(spark, [0, 25, 26, 701, 702, 16383], "i int", S.column_name(F.col("i"))) == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert column(spark, [(3, 28)], "r int, c int", S.dimension_ref(F.col("r"), F.col("c"))) == ["A1:AB3"]


def test_numbers_stay_as_typed(spark):
    values = ["007", "1.50", "0.1234567890123456", "abc", "1e3", "-2.5", ""]
    assert column(spark, values, "v string", S.format_number(F.col("v"))) == ["7", "1.5", "0.123456789012", "abc", "1000", "-2.5", ""]
    rows = [("s", "0", "x"), ("b", "1", None), ("b", "0", None), ("inlineStr", "007", None), (None, "3.0", None), ("s", "9", None)]
    assert column(spark, rows, "t string, v string, s string", S.cell_text(F.col("t"), F.col("v"), F.col("s"))) == ["x", "TRUE", "FALSE", "007", "3", ""]


def test_names_and_text(spark):
    assert column(spark, ["a/b\\c.tar.gz", "", None, ".hidden"], "p string", S.base_name(F.col("p"))) == ["c.tar", "document", "document", "document"]
    rows = [("My file (1).pdf", 7, 1, 1), ("?.pdf", 1234, 2, 3)]
    assert column(spark, rows, "n string, p int, f int, k int", S.page_image_name(*(F.col(c) for c in "npfk"))) == ["My-file-1-page-007.png", "02-document-page-1234.png"]
    files = spark.createDataFrame([("10.pdf",), ("2.pdf",), ("A1.pdf",), ("a.pdf",)], "n string")
    assert [r.n for r in files.orderBy(S.natural_key(F.col("n"))).collect()] == ["2.pdf", "10.pdf", "a.pdf", "A1.pdf"]
    clean = S.sanitize(F.col("t"))["text"]
    once = column(spark, ["a\x01b\tc\n", None], "t string", clean)
    assert once == ["ab\tc\n", ""] and column(spark, once, "t string", clean) == once
    # fixed values: drawn signs are private codes by their place, others are spelled, the rest is lost
    assert column(spark, ["5 ≤ 6 中", "√x ≟ ‴ € é – \x85", "\ue004"], "t string", S.sanitize(F.col("t"), False)) == [("5 \ue004 6 ?", 1), ("\ue000x =? ''' € é – ?", 1), ("\ue004", 0)]
    assert column(spark, ["5 ≤ 6 中 é"], "t string", S.sanitize(F.col("t")))[0] == ("5 ≤ 6 中 é", 2)
    assert column(spark, [("Symbol", "F061"), ("symbol", "a3"), ("Wingdings", "F061"), ("Symbol", "zz")], "f string, c string", S.symbol_char(F.col("f"), F.col("c"))) == ["α", "≤", "", ""]
    assert column(spark, ["<a & 'b'>"], "t string", S.xml_escape(F.col("t"))) == ["&lt;a &amp; &apos;b&apos;&gt;"]
    assert column(spark, ["a\r\nb\rc\nd", ""], "t string", S.lines_of(F.col("t"))) == [["a", "b", "c", "d"], [""]]
    assert column(spark, ["Heading 2", "title", "Normal"], "s string", S.heading_level(F.col("s"))) == [2, 1, None]
    assert column(spark, [".DOCX; a=b", "zzz"], "e string", S.mime_for(F.col("e")))[1] == "application/octet-stream"
    assert column(spark, ["Times-BoldItalic"], "n string", S.font_style(F.col("n"))) == [("times", True, True)]


def test_pdf_bytes_and_boxes(spark):
    rows = [(b"%PDF-1.7 " + b"x" * 3000 + b"%%EOF",), (b"%PDF-1.7 " + b"%%EOF" + b"x" * 3000,), (b"short",)]
    assert column(spark, rows, "content binary", S.looks_like_pdf(F.col("content"))) == [True, False, True]
    got = column(spark, [(200.0, 100.0)], "w double, h double", S.fit_page(F.col("w"), F.col("h"), F.lit(100.0), F.lit(100.0), F.lit(10.0)))[0]
    assert tuple(got) == pytest.approx((10, 30, 80, 40))
    assert tuple(column(spark, [(90, 5, 50, 50)], "x int, y int, w int, h int", S.clamp_crop(*(F.col(c) for c in "xywh"), F.lit(100), F.lit(40)))[0]) == (90, 5, 10, 35)
    assert tuple(column(spark, [(90, 5, 50, 50)], "x int, y int, w int, h int", S.clamp_drag(*(F.col(c) for c in "xywh"), F.lit(100), F.lit(40)))[0]) == (68, 5, 32, 35)
    assert tuple(column(spark, [(8192, 10)], "w int, h int", S.target_pixels(F.col("w"), F.col("h")))[0]) == (4096, 5)


def test_whole_texts_are_escaped(spark, tmp_path):
    import hashlib

    from quire.plans.queries import QUERIES

    texts = [(1, "a" * 300 + "<b & 'c'>\x01" + '"' * 500), (2, None), (3, "é" * 250 + "&")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t in texts:
        e = (t or "").replace("\x01", "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")
        want[i] = (len(e), hashlib.sha256(e.encode()).hexdigest())
    assert {r.doc_id: (r.escaped_chars, r.escaped_sha256) for r in QUERIES["escaped_text"](spark, str(tmp_path)).collect()} == want
