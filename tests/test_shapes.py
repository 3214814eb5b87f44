from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.operators import plans, ranks, shape, workbook
from quire.plans import queries


def pieces_of(text, limit):
    """Greedy pieces, in plain Python: as far as the last space in reach, if that is in the second half."""
    out, at = [], text.strip()
    while len(at) > limit:
        spaces = [k for k in range(limit + 1) if at[k] == " " and 2 * k >= limit]
        k = spaces[-1] if spaces else limit
        out, at = [*out, at[:k].strip()], at[k:].strip()
    return [*out, at] if at or not out else out


BLOCKS = "doc_id long, block_no int, depth int, type string, level int, text string, items array<string>, rows array<array<string>>, sheet_name string"


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, r.get("depth", 0), r["type"], r.get("level"), r.get("text"), r.get("items"), r.get("rows"), r.get("sheet_name")) for i, r in enumerate(rows)], BLOCKS)


def test_sheets_from_blocks(spark):
    b = blocks(spark, [
        {"type": "heading", "text": "H"}, {"type": "paragraph", "text": "a"}, {"type": "list", "items": ["x", " ", "y"]}, {"type": "heading", "text": "end"},
        {"type": "table", "rows": [["1", "2"], ["3"]]}, {"type": "sheet", "rows": [["s"]], "sheet_name": "S"}, {"type": "paragraph", "text": "z"},
    ])
    got = [(r.sheet_no, r.row_no, r.name, r.cells) for r in shape.to_sheets(b).orderBy("sheet_no", "row_no").collect()]
    assert got == [(0, 0, "Sheet", ["H"]), (0, 1, "Sheet", ["a", "• x", "• y", "end"]), (0, 2, "Sheet", ["1", "2"]), (0, 3, "Sheet", ["3"]), (1, 0, "S", ["s"]), (2, 0, "Sheet", ["z"])]


def test_linear_document_puts_slide_content_last(spark):
    b = blocks(spark, [{"type": "slide", "text": "One"}, {"type": "paragraph", "text": "inside", "depth": 1}, {"type": "sheet", "rows": [["c"]], "sheet_name": "S"}])
    got = [(r.type, r.level, r.text) for r in shape.linearize(b).orderBy("at").collect()]
    assert got == [("heading", 2, "One"), ("heading", 2, "S"), ("table", None, None), ("paragraph", None, "inside")]


def test_packing_slides_against_a_loop(spark):
    rng = random.Random(1)
    rows = [{"type": "paragraph", "text": "word " * rng.randint(1, 200)} for _ in range(40)] + [{"type": "table", "rows": [["a"]] * 30}, {"type": "paragraph", "text": "after"}]
    rng.shuffle(rows)
    slide, used, want = 0, 0.0, []
    for i, r in enumerate(rows):
        if r["type"] == "table":
            pieces = [1.0] * 3
        else:
            weight = max(0.2, len(r["text"]) / 620)
            pieces = [1.0] * len(pieces_of(r["text"], 1200)) if weight > 1 and len(r["text"]) > 1200 else [weight]
        for k, w in enumerate(pieces):
            if used and (used + w > 1 or k or len(pieces) > 1 or r["type"] == "table"):
                slide, used = slide + 1, 0.0
            want.append((i, k, slide))
            used += w
    got = sorted((r.block_no, r.piece, r.slide_no) for r in shape.pack_slides(blocks(spark, rows)).collect())
    assert got == want


def test_text_is_split_and_wrapped_without_loss(spark):
    text = "alpha beta gamma " * 40 + "x" * 90
    texts = [text, "", "short", "x" * 120, "a b " + "y" * 70, "ab " * 40 + "z" * 55 + " end"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(shape.split_text(F.col("t"), 50)).collect()]
    assert got == [pieces_of(t, 50) for t in texts]
    assert "".join(got[0]).replace(" ", "") == text.replace(" ", "") and all(len(p) <= 50 for p in got[0])
    lines = spark.createDataFrame([(text + "\n\n\nlast",)], "t string").select(shape.wrap_text(F.col("t"), 110.0)).first()[0]
    assert all(len(x) <= 20 for x in lines) and lines[-1] == "last"
    assert "".join(lines).replace(" ", "") == (text + "last").replace(" ", "")


def test_long_texts_are_split_like_a_loop_over_the_rest(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        words = ["".join(rng.choices("ab", k=rng.choice([1, 3, 9, 30, 60]))) for _ in range(rng.randint(1, 900))]
        texts.append(rng.choice(["", "  ", "\t "]) + "".join(w + rng.choice([" ", "  ", "\n", "\t\xa0", ""]) for w in words) + rng.choice(["", " " * 70, "\n\t" * 40]))
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(shape.split_text(F.col("t"), 20)).collect()]

    def looped(rest, limit):
        out = []
        while len(rest) > limit:
            k = rest[: limit + 1].rfind(" ")
            k = k if 2 * k >= limit else limit
            out, rest = [*out, rest[:k].strip(shape.BLANKS)], rest[k:].strip(shape.BLANKS)
        return [*out, rest] if rest or not out else out

    assert got == [looped(t, 20) for t in texts]
    assert max(map(len, texts)) > 5 * 64 * 20


def test_moves_to_any_place_are_made_in_turn(spark):
    rng = random.Random(6)
    items = [(d, i, (i * 7) % 11) for d in range(20) for i in range(rng.choice([1, 5, 11]))] + [(99, 1, 0)]
    moves = [(d, s, rng.randrange(12), rng.randint(-2, 13)) for d in range(20) for s in range(rng.choice([0, 3, 40]))] + [(500, 1, 1, 0)]
    want = {}
    for d in {x[0] for x in items}:
        order = [i for _, i in sorted((o, i) for e, i, o in items if e == d)]
        for _, _, i, to in sorted(m for m in moves if m[0] == d):
            if i in order:
                order.remove(i)
                order.insert(max(0, min(to, len(order))), i)
        want |= {(d, i): k for k, i in enumerate(order)}
    out = plans.reorder(spark.createDataFrame(items, "doc_id long, item_id long, ord long"), spark.createDataFrame(moves, "doc_id long, seq long, item_id long, to int")).collect()
    assert {(r.doc_id, r.item_id): r.place for r in out} == want and len(out) == len(want)


def test_wide_tables_become_text(spark):
    wide = spark.createDataFrame([(1, 0, [[str(c) for c in range(12)]] * 20), (2, 0, [["a"]])], "doc_id long, block_no int, rows array<array<string>>")
    got = shape.wide_table_text(wide).orderBy("piece").collect()
    assert {r.doc_id for r in got} == {1} and [len(r.text.split("\n")) for r in got] == [8, 8, 4]


def test_runs_and_lists(spark):
    runs = spark.createDataFrame([(1, 0, 0, "a", True, False), (1, 0, 1, "b", True, False), (1, 0, 2, "c", False, False), (1, 1, 0, "d", False, False)], "doc_id long, block_no int, run_no int, text string, bold boolean, italic boolean")
    got = [(r.block_no, r.text, r.bold, r.plain) for r in shape.merge_runs(runs).orderBy("block_no", "run_no").collect()]
    assert got == [(0, "ab", True, False), (0, "c", False, False), (1, "d", False, True)]
    paras = spark.createDataFrame([(1, 0, "text", "p"), (1, 1, "item", "a"), (1, 2, "text", " "), (1, 3, "image", None), (1, 4, "item", "b"), (1, 5, "text", "q")], "doc_id long, para_no int, kind string, text string")
    got = [(r.type, r.items) for r in shape.group_lists(paras).orderBy("block_no").collect()]
    assert got == [("paragraph", None), ("image", None), ("list", ["a", "b"]), ("paragraph", None)]


def test_sheet_names_never_collide(spark):
    long = "n" * 40
    rows = [("f", i, n) for i, n in enumerate(["Data", "data", "DATA (2)", "a/b:c", "'q'", None, long, long])]
    got = [r.name for r in workbook.sheet_names(spark.createDataFrame(rows, "file_id string, sheet_no int, name string")).orderBy("sheet_no").collect()]
    assert got == ["Data", "data (2)", "DATA (2) (2)", "a b c", "q", "Sheet6", "n" * 31, "n" * 27 + " (2)"]


def test_column_widths_later_range_wins(spark):
    ranges = spark.createDataFrame([("f", 0, 0, 1, 3, 10.0), ("f", 0, 1, 2, 500, 1.0)], "file_id string, sheet_no int, ord int, min int, max int, width double")
    bounds = spark.createDataFrame([("f", 0, 0, 3)], "file_id string, sheet_no int, left int, right int")
    got = {r.col: r.points for r in workbook.column_widths(ranges, bounds).collect()}
    assert got == {0: 75.0, 1: 20.0, 2: 20.0, 3: 20.0}


def test_plans(spark):
    items = spark.createDataFrame([(1, i, i) for i in range(4)] + [(2, 9, 0)], "doc_id long, item_id long, ord int")
    moves = spark.createDataFrame([(1, 0, 3, 0), (1, 1, 0, 99)], "doc_id long, seq long, item_id long, to int")
    got = [(r.doc_id, r.item_id) for r in plans.reorder(items, moves).orderBy("doc_id", "place").collect()]
    assert got == [(1, 3), (1, 1), (1, 2), (1, 0), (2, 9)]
    loose = spark.createDataFrame([(1, 0, "a.pdf"), (1, 2, "z.pdf")], "batch_id long, ord int, name string")
    inside = spark.createDataFrame([(1, 1, "10.pdf", "in/10.pdf"), (1, 1, "2.pdf", "in/2.pdf")], "batch_id long, ord int, name string, entry_name string")
    assert [r.name for r in plans.gather_files(loose, inside).orderBy("ord").collect()] == ["a.pdf", "2.pdf", "10.pdf", "z.pdf"]
    requests = spark.createDataFrame([("pdf", "docx"), ("pdf", "pdf"), ("txt", "pdf")], "source string, target string")
    assert plans.check_pairs(requests).count() == 2
    parts = spark.createDataFrame([("f", f"p{i}.xml", "<a/>") for i in range(4)] + [("g", f"p{i}.xml", "<a>" if i else None) for i in range(4)], "file_id string, part string, xml string")
    counts = spark.createDataFrame([("f", 5), ("g", 5)], "file_id string, characters long")
    assert {r.file_id: r.ok for r in plans.verify_package(parts, counts).collect()} == {"f": True, "g": False}
    images = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a")], "doc_id long, ref_no int, signature string")
    assert [r.media_no for r in plans.dedupe_images(images).orderBy("ref_no").collect()] == [0, 1, 0]
    marks = spark.createDataFrame([(1, 0, 0, "/Watermark"), (1, 0, 1, None), (1, 0, 2, "/Link")], "doc_id long, page_no int, annot_no int, subtype string")
    kept, report = plans.remove_watermarks(marks)
    assert [(r.annot_no, r.subtype) for r in kept.orderBy("annot_no").collect()] == [(0, None), (1, "/Link")] and report.first().removed == 1
    chosen = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True)], "doc_id long, page_no int, selected boolean")
    assert [r.new_page for r in plans.extract_pages(chosen).orderBy("page_no").collect()] == [0, 1]
    w = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b")], "doc_id long, seq long, message string")
    assert [r.message for r in plans.union_warnings(w, w).orderBy("no").collect()] == ["b", "a"]


def test_numbers_of_one_group_come_from_many_ranges(spark):
    rows = [("big", (i * 7919) % 5003, i) for i in range(5003)] + [("small", 3, 1), ("small", 1, 2), (None, 5, 3), (None, 4, 4)]
    frame = spark.createDataFrame(rows, "g string, k long, v int").repartition(6)
    out = ranks.numbered(frame, ["g"], ["k"], "no")
    got = {(r.g, r.k): r.no for r in out.collect()}
    assert got == {(g, k): sum(1 for h, j, _ in rows if h == g and j < k) for g, k, _ in rows if g != "big"} | {("big", k): k for _, k, _ in rows[:5003]}
    assert ranks.numbered(frame.filter("false"), ["g"], ["k"], "no").collect() == []
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and "windowspecdefinition(_range" in plan


def test_every_query_runs_to_its_end_on_the_smallest_tables(spark):
    for name, run in queries.QUERIES.items():
        df = run(spark, "/root/testdata/sf0.001")
        assert df.columns, name
        df.write.format("noop").mode("overwrite").save()  # a count would prune the columns


def test_every_page_is_a_conversion_request(spark, tmp_path):
    from quire.plans.queries import QUERIES

    spark.range(200).selectExpr("id as page_id", "concat('http://a/', id) as url", "'' as html").write.parquet(str(tmp_path / "pages.parquet"))
    exts, formats = ["pdf", "docx", "xlsx", "pptx", "zip", "png", "doc", "csv", "pdf", "txt"], ["pdf", "docx", "xlsx", "pptx"]
    asked = [(i, exts[i % 10], formats[i // 10 % 4]) for i in range(200)]
    want = [r for r in asked if r[1] not in formats or r[1] == r[2]]
    assert sorted(map(tuple, QUERIES["rejected_requests"](spark, str(tmp_path)).collect())) == want


def test_grids_without_bounds_are_those_of_their_bounds(spark):
    rng = random.Random(12)
    rows = {(s, rng.randrange(3, 60), rng.randrange(2, 9)) for s in range(5) for _ in range(25)} | {(7, 4, 1), (7, 6000, 300), (8, 0, 0)}
    cells = spark.createDataFrame([("f", s, r, c, f"{s}.{r}.{c}") for s, r, c in rows], "file_id string, sheet_no int, row int, col int, text string")
    got, want = (sorted(map(str, workbook.grid_rows(cells, b).collect())) for b in (None, workbook.grid_bounds(cells)))
    assert got == want and len(got) > 5000
