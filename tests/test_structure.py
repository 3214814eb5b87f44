from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from quire.operators import structure as T
from quire.plans import inputs as I

ITEMS = "doc_id long, page_no int, item_no int, str string, transform array<double>, width double, height double, font_name string"
PAGES = "doc_id long, page_no int, width double, height double"


def items(spark, runs):
    """runs: (text, x, y, width, height)"""
    return spark.createDataFrame([(1, 0, i, t, [h, 0.0, 0.0, h, x, y], w, h, "F") for i, (t, x, y, w, h) in enumerate(runs)], ITEMS)


def row(texts, y, start=50.0, gap=0.0, size=10.0):
    out, x = [], start
    for t in texts:
        out.append((t, x, y, len(t) * 5.0, size))
        x += len(t) * 5.0 + gap
    return out


def lines(spark, runs):
    return T.line_cells(T.assign_lines(T.text_runs(items(spark, runs)))).orderBy("line_no").collect()


def test_touching_glyphs_join_and_gaps_are_spaces(spark):
    assert [r.text for r in lines(spark, row(list("√(x2+y2)=(a+b)/2c"), 700.0))] == ["√(x2+y2)=(a+b)/2c"]
    assert [r.text for r in lines(spark, row(["x", "=", "1"], 700.0, gap=3.0))] == ["x = 1"]


def test_blank_runs_leave_no_trace(spark):
    runs = row(["a", "≤", "b", "≥", "c"], 700.0) + [("  ", 60.0, 700.0, 5.0, 10.0)]
    assert [r.text for r in lines(spark, runs)] == ["a≤b≥c"]


def test_jittered_baselines_are_one_line(spark):
    runs = [("a", 50.0, 700.0, 5.0, 10.0), ("b", 60.0, 698.5, 5.0, 10.0), ("c", 70.0, 697.9, 5.0, 10.0), ("d", 50.0, 690.0, 5.0, 10.0)]
    assert [r.text for r in lines(spark, runs)] == ["a b c", "d"]


def test_bad_numbers(spark):
    runs = [("a", float("nan"), 10.0, -3.0, 10.0), ("b", 5.0, float("inf"), 4.0, float("nan"))]
    got = {r.text: (r.x, r.y, r.width, r.height) for r in T.text_runs(items(spark, runs)).collect()}
    assert got == {"a": (0.0, 10.0, 0.0, 10.0), "b": (5.0, 0.0, 4.0, 0.0)}


def test_grid_is_one_table_and_a_lone_row_is_text(spark):
    runs = [x for k in range(3) for x in row([f"a{k}", f"b{k}", f"c{k}"], 700.0 - 16 * k, gap=40.0)]
    runs += [("Plain words follow here", 50.0, 600.0, 115.0, 10.0)] + row(["left", "right"], 560.0, gap=60.0)
    blocks = T.structure(items(spark, runs)).orderBy("block_no").collect()
    assert blocks[0].type == "table" and blocks[0].rows == [[f"{c}{k}" for c in "abc"] for k in range(3)]
    assert [(b.type, b.text) for b in blocks[1:]] == [("paragraph", "Plain words follow here left right")]


def test_prose_with_headings(spark):
    runs = [("A big title", 50.0, 760.0, 130.0, 24.0)]
    text = ["The first line goes on", "and ends here.", "Another sentence starts", "and is long"]
    runs += [(t, 50.0, 720.0 - 16 * k, len(t) * 5.0, 10.0) for k, t in enumerate(text)]
    runs += [("after a wide gap it is new", 50.0, 600.0, 130.0, 10.0), ("indented line stands alone", 80.0, 584.0, 130.0, 10.0), ("12", 80.0, 568.0, 10.0, 10.0)]
    source = items(spark, runs)
    blocks = T.structure(source).orderBy("block_no").collect()
    assert [(b.type, b.level) for b in blocks[:1]] == [("heading", 5)]
    assert [b.text for b in blocks[1:]] == ["The first line goes on and ends here.", "Another sentence starts and is long", "after a wide gap it is new", "indented line stands alone 12"]
    words = Counter(w for b in blocks for w in b.text.split())
    assert words == Counter(w for t, *_ in runs for w in t.split())


def test_result_is_the_same_however_dealt(spark):
    runs = [x for k in range(30) for x in row([f"w{k}a", f"w{k}b"], 700.0 - 16 * k, gap=5.0)]
    got = [sorted(map(str, T.structure(items(spark, runs).repartition(n)).collect())) for n in (1, 16)]
    assert got[0] == got[1]


def test_census_counts_blank_pages(spark):
    blocks = T.structure(items(spark, row(["some", "words"], 700.0, gap=5.0)))
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0), (1, 1, 600.0, 800.0), (2, 0, 600.0, 800.0)], PAGES)
    got = {r.doc_id: r for r in T.structure_report(blocks, pages).collect()}
    assert (got[1].pages, got[1].blank, got[1].refused, got[1].characters, got[1].state) == (2, 1, False, 10, "nearly empty")
    assert (got[2].blank, got[2].refused, got[2].state) == (1, True, "empty")


def test_page_windows_share_one_exchange(spark):
    """After the line helper one repartition on the page serves all windows up to the lines."""
    runs = T.assign_lines(T.text_runs(items(spark, row(["a", "b"], 700.0))))
    plan = T.classify_lines(T.line_cells(runs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_item_boxes(spark):
    source = items(spark, [("abcd", 10.0, 700.0, 0.0, 10.0)])
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], PAGES)
    r = T.item_boxes(source, pages).first()
    assert (r.size, r.left, r.top, r.width, r.height) == (10.0, 10.0, 91.0, 20.0, 12.5)
    assert T.reading_order(T.text_runs(source)).select(F.col("text")).first()[0] == "abcd"


def looped_lines(ys):
    line, total, n, numbers = -1, 0.0, 0, []
    for y in ys:
        if n and total / n - y <= 2.0:
            total, n = total + y, n + 1
        else:
            line, total, n = line + 1, y, 1
        numbers.append(line)
    return numbers


def looped_paragraphs(rows):
    spacing, indent, before, ended, number, numbers = 0.0, None, None, False, -1, []
    for kind, y, left, body, text in rows:
        if kind != "body":
            indent, before, ended = None, None, False
            numbers.append(-1)
            continue
        gap = before - y if before is not None else 0.0
        spacing = spacing or max(gap, 0.0)
        if indent is None or (spacing > 0 and gap > spacing * 1.5 and gap > body * 1.25) or ended or abs(left - indent) > body * 0.8:
            number, indent = number + 1, left
        before, ended = y, text.endswith(".")
        numbers.append(number)
    return numbers


def test_jittered_pages_agree_with_a_plain_loop(spark):
    rng = random.Random(3)
    pages = {}
    for page in range(40):
        y, rows = 780.0, []
        for i in range(rng.randint(1, 60)):
            y -= rng.choice([0.0, 0.5, 0.9, 1.9, 2.0, 2.1, 14.0]) * rng.choice([1.0, 1.0, 0.37])
            rows.append((1, page, i, "w", 10.0 * i, y, 5.0, 10.0))
        pages[page] = rows
    frame = spark.createDataFrame([r for rows in pages.values() for r in rows], "doc_id long, page_no int, item_no int, text string, x double, y double, width double, height double")
    got = {(r.page_no, r.item_no): r.line_no for r in T.assign_lines(frame).collect()}
    assert got == {(page, r[2]): n for page, rows in pages.items() for r, n in zip(rows, looped_lines([r[5] for r in rows]), strict=True)}
    assert max(max(n.values()) for n in [Counter(looped_lines([r[5] for r in rows])) for rows in pages.values()]) > 3


def test_shifted_lines_agree_with_a_plain_loop(spark):
    rng = random.Random(4)
    pages = {}
    for page in range(40):
        y, rows = 780.0, []
        for i in range(rng.randint(1, 40)):
            y -= rng.choice([12.0, 12.0, 12.0, 19.0, 40.0, 0.0])
            rows.append((1, page, i, rng.choice(["body"] * 8 + ["heading", "table"]), y, 50.0 + rng.choice([0.0, 0.0, 5.0, 7.9, 8.0, 8.1, 16.0]), 10.0, rng.choice(["on"] * 6 + ["end."])))
        pages[page] = rows
    frame = spark.createDataFrame([r for rows in pages.values() for r in rows], "doc_id long, page_no int, line_no int, kind string, y double, left double, body double, text string")
    got = {(r.page_no, r.line_no): r.paragraph for r in T.assign_paragraphs(frame).collect()}
    assert got == {(page, r[2]): n for page, rows in pages.items() for r, n in zip(rows, looped_paragraphs([r[3:] for r in rows]), strict=True)}


def test_no_python_stands_between_items_and_blocks(spark):
    plan = T.structure(items(spark, row(["a", "b"], 700.0)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_pages_as_arrays_are_the_rows_and_no_step_sorts_words(spark):
    """A page is read as one row up to its blocks: no word or line is a row of a sort, a window or an aggregate."""
    sf = "/root/testdata/sf0.001"
    every = I.page_items(spark, sf).select("doc_id", "page_no", F.inline("items"))
    words = I.text_items(spark, sf).select(every.columns)
    assert sorted(every.collect(), key=str) == sorted(words.collect(), key=str)
    blocks = T.page_blocks(T.page_runs(I.page_items(spark, sf)))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Sort [" not in plan
    assert sorted(map(str, blocks.collect())) == sorted(map(str, T.structure(words).select(blocks.columns).collect()))


def test_lines_near_the_tolerance_are_folded(spark):
    ys = [700.1, 700.1, 700.1, 698.1, 690.0, 688.6, 687.2, 500.0]
    pages = T.page_runs(items(spark, [("w", 10.0 * i, y, 5.0, 10.0) for i, y in enumerate(ys)]).groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("item_no", "str", "transform", "width", "height")).alias("items")))
    got = {x["item_no"]: n for n, part in enumerate(T._parted(pages).first().parts) for x in part}
    assert got == dict(enumerate(looped_lines(ys)))


def test_pages_of_blanks_have_no_blocks(spark):
    assert T.structure(items(spark, [(" ", 0.0, 700.0, 5.0, 10.0)])).collect() == []
    blank = items(spark, [(" ", 0.0, 700.0, 5.0, 10.0)]).groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("item_no", "str", "transform", "width", "height")).alias("items"))
    assert T.page_blocks(T.page_runs(blank)).collect() == [] and T.text_lines(T.page_runs(blank)).collect() == []
