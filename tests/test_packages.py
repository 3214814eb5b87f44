from __future__ import annotations

import io
import random
import struct
import zipfile
from collections import Counter

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import content, plans, workbook
from quire.plans import office
from quire.sources import equations, markup, sheets, slides, word
from quire.sources import files as S
from quire.streaming import jobs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
FILES = "batch_id long, ord int, file_id string, name string, mime string, size long, content binary"


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries:
            z.writestr(name, body)
    return out.getvalue()


def table(spark, named):
    return spark.createDataFrame([(1, i, str(i), n, "", len(b), b) for i, (n, b) in enumerate(named)], FILES)


def test_archives_open_in_natural_order(spark):
    good = archive([("in/10.pdf", "a"), ("in/2.pdf", "b"), ("__MACOSX/2.pdf", "c"), (".x.pdf", "d"), ("note.txt", "e"), ("deep.zip", "f")])
    batch = table(spark, [("first.pdf", b"x"), ("many.zip", good), ("broken.zip", b"PK but not an archive at all"), ("none.zip", archive([("a.txt", "z")])), ("last.pdf", b"y")])
    out, problems, skipped = S.expand_zips(batch, F.col("name").rlike(r"(?i)\.pdf$"))
    assert [r.name for r in out.orderBy("ord", "entry_ord").collect()] == ["first.pdf", "2.pdf", "10.pdf", "last.pdf"]
    assert sorted(r.name for r in problems.collect()) == ["broken.zip", "none.zip"]
    assert {r.file_id: r.skipped for r in skipped.collect()} == {"1": 2, "3": 1}


def test_damaged_entries_are_problems_and_the_rest_is_read(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("a.pdf", "b.pdf"):
            z.writestr(name, "text that is deflated " * 50)
        at = z.infolist()[0].header_offset + 30 + len("a.pdf")
    hurt = bytearray(out.getvalue())
    hurt[at : at + 8] = b"\xff" * 8
    found = S.expand_zips(table(spark, [("x.zip", bytes(hurt)), ("y.zip", bytes(hurt[:90]))]), F.col("name").endswith(".pdf"))
    assert [r.name for r in found.files.collect()] == ["b.pdf"]
    assert sorted(r.name for r in found.problems.collect()) == ["x.zip", "y.zip"]
    assert S.zip_entries(table(spark, [("n.zip", None or b"")])).first().problem


def test_guard(spark):
    many = archive([(f"{i}", "") for i in range(6001)])
    bomb = bytearray(archive([("big", b"0")]))
    at = bomb.rfind(b"PK\x01\x02")
    bomb[at + 24 : at + 28] = struct.pack("<I", 400 * 1024 * 1024)
    got = S.guard_archive(table(spark, [("a", archive([("x", "y")])), ("b", many), ("c", bytes(bomb)), ("d", b"no"), ("e", b"PK")])).orderBy("ord").collect()
    assert [r.verdict for r in got] == ["ok", "too-many", "too-large", "not-zip", "ok"]


def test_workbook_end_to_end(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"""<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c t="inlineStr"><is><t>007</t></is></c></row>
<row><c t="b"><v>1</v></c><c><v>2.50</v></c><c r="D3" t="str"><v>sum</v></c><c r="D3" t="str"><v>again</v></c><c t="s"><v>9</v></c></row></sheetData></worksheet>"""
    strings = f"<sst {ns}><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>"
    rels = '<Relationships><Relationship Id="rId1" Target="../xl/worksheets/odd.xml"/><Relationship Id="rId2" Target="http://x" TargetMode="External"/></Relationships>'
    book = archive([("xl/worksheets/odd.xml", sheet), ("xl/sharedStrings.xml", strings), ("xl/_rels/workbook.xml.rels", rels)])
    parts = S.package_parts(table(spark, [("b.xlsx", book)]))
    found = S.relationships(parts).collect()
    assert [(r.base_part, r.rel_id, r.target) for r in found] == [("xl/workbook.xml", "rId1", "xl/worksheets/odd.xml")]
    listed = spark.createDataFrame([("0", 0, "rId2"), ("0", 1, "rId1")], "file_id string, at int, rel_id string")
    ordered = plans.ordered_parts(listed, S.relationships(parts), parts)
    sheets = ordered.select("file_id", F.col("no").alias("sheet_no"), "xml")
    cells = workbook.dedupe_cells(workbook.fill_positions(S.raw_cells(sheets)))
    resolved = workbook.resolve_cells(cells, S.shared_strings_of(parts))
    got = {(r.row, r.col): r.text for r in resolved.collect()}
    assert got == {(1, 1): "one", (1, 2): "007", (2, 0): "TRUE", (2, 1): "2.5", (2, 3): "again", (2, 4): ""}
    assert [r.lost for r in workbook.lost_strings(resolved).collect()] == [1]
    filled = resolved.filter("text != ''")
    assert [r.cells for r in workbook.grid_rows(filled).orderBy("row").collect()] == [["", "one", "007", ""], ["TRUE", "2.5", "", "again"]]


def cells_of(spark, entries, size):
    fragments = sheets.part_fragments(table(spark, entries), r"sheet\d+\.xml$", "row", size=size)
    cells = sheets.fragment_cells(fragments)
    again = workbook.fill_positions(cells.drop("row", "col").withColumn("sheet_no", F.dense_rank().over(Window.orderBy("part"))))
    assert {(r.part, r.row, r.col) for r in again.collect()} == {(r.part, r.row, r.col) for r in cells.collect()}
    return {(r.file_id, r.part, r.row, r.col): r.raw_value for r in cells.collect()}, [(r.file_id, r.part) for r in fragments.filter("problem is not null").collect()], fragments.count()


def test_sheets_in_fragments_are_the_whole_sheets(spark):
    ns = 'xmlns:s="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    numbered = {0: 5, 40: 90, 41: 95, 77: 300}
    rows, want, no = [], {}, 1
    for i in range(120):
        no = numbered.get(i, no)
        r = f' r="{no}"' if i in numbered else ""
        body = "" if i % 9 == 4 else f"<s:c><s:v>{i}é</s:v></s:c><!-- <row> --><s:c r='F{no}'><s:v><![CDATA[<row/>]]></s:v></s:c><s:c><s:v>x</s:v></s:c>"
        if body:
            want |= {("0", "sheet1.xml", no - 1, 0): f"{i}é", ("0", "sheet1.xml", no - 1, 5): "<row/>", ("0", "sheet1.xml", no - 1, 6): "x"}
        rows.append(f"<s:row{r}>{body}</s:row>")
        no += 1
    xml = f"<s:worksheet {ns}><s:dimension/><s:sheetData>{' '.join(rows)}</s:sheetData><s:row><s:c><s:v>no row</s:v></s:c></s:row></s:worksheet>"
    for size, data in ((1, xml.encode()), (700, xml.encode()), (1 << 20, xml.encode()), (300, b"\xff\xfe" + xml.encode("utf-16-le"))):
        got, problems, n = cells_of(spark, [("a", archive([("sheet1.xml", data)]))], size)
        assert got == want and problems == []
        assert (n > 50) == (size == 1)


def test_sheets_beyond_the_limit_are_read_and_bombs_are_not(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_EXPANDED", 4000)
    rows = "".join(f"<row><c><v>{i}</v></c></row>" for i in range(300))
    bomb = bytearray(archive([("sheet1.xml", "<worksheet/>")]))
    at = bomb.rfind(b"PK\x01\x02")
    bomb[at + 24 : at + 28] = struct.pack("<I", 400 * 1024 * 1024)
    large = archive([("sheet1.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")])
    assert [r.verdict for r in S.guard_archive(table(spark, [("a", large), ("b", bytes(bomb))])).orderBy("ord").collect()] == ["too-large", "too-large"]
    got, problems, _ = cells_of(spark, [("a", large), ("b", bytes(bomb))], 700)
    assert got == {("0", "sheet1.xml", i, 0): str(i) for i in range(300)} and problems == []


def test_sheets_that_break_off_give_what_came_before(spark):
    good = "".join(f"<row><c><v>{i}</v></c></row>" for i in range(9))
    broken = f"<worksheet><sheetData>{good}<row><c><v>9</c>"
    book = [("broken", archive([("sheet1.xml", broken), ("sheet2.xml", "<worksheet><sheetData/></worksheet>"), ("sheet3.xml", ""), ("other.xml", "<a>")])), ("no archive", b"PK but none"), ("null", b"")]
    got, problems, _ = cells_of(spark, book, 20)
    assert got == {("0", "sheet1.xml", i, 0): str(i) for i in range(9)}
    assert sorted(problems, key=str) == [("0", "sheet1.xml"), ("0", "sheet3.xml"), ("1", None)]


def test_strings_in_fragments(spark):
    xml = "<sst>" + "".join(f"<si><t>{i} </t></si><si><r><t>a</t></r><r><t>{i}</t></r></si><si/>" for i in range(30)) + "</sst>"
    got = sheets.fragment_strings(sheets.part_fragments(table(spark, [("a", archive([("xl/sharedStrings.xml", xml)]))]), "sharedStrings", "si", size=64)).collect()
    assert {r.idx: r.text for r in got} == {i: (f"{i // 3} ", f"a{i // 3}", "")[i % 3] for i in range(90)}


def test_rows_are_numbered_across_lots(spark, monkeypatch):
    monkeypatch.setattr(workbook, "LOT", 7)
    numbered, rows, no = {3: 10, 4: 11, 30: 200}, [], 0
    for i in range(60):
        no = numbered[i] if i in numbered else no + 1
        rows.append(("f", 0, i, numbered.get(i), i, None, no - 1))
    frame = spark.createDataFrame(rows, "file_id string, sheet_no int, row_pos int, row_no int, pos long, ref string, want int")
    out = workbook.fill_positions(frame).collect()
    assert len(out) == 60 and all(r.row == r.want and r.col == 0 for r in out)


def test_docx_reads_inserted_and_deleted_text(spark):
    body = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:ins><w:r><w:t> in</w:t></w:r></w:ins><w:del><w:r><w:t> out</w:t></w:r></w:del>
<m:oMath><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
    rows = word.docx_elements(S.package_parts(table(spark, [("d.docx", archive([("word/document.xml", body)]))]))).orderBy("at").collect()
    assert [(r.kind, r.text) for r in rows if r.text] == [("text", "Title"), ("text", "bold"), ("text", " in"), ("text", " out"), ("equation", "(1) / (2)"), ("text", "cell")]
    assert [r.bold for r in rows if r.text][:3] == [False, True, False] and rows[0].style == "Heading1"
    assert [(r.table_no, r.row_no, r.cell_no) for r in rows if r.text == "cell"] == [(0, 0, 0)]


def test_equations_on_one_line(spark):
    def e(tag, body, text=True):
        return f"<m:{tag}>" + (f"<m:r><m:t>{body}</m:t></m:r>" if text else body) + f"</m:{tag}>"

    # expected values are fixed by the format's one-line form
    cases = {
        "<m:sSup>" + e("e", "x") + e("sup", "n+1") + "</m:sSup>": "x^(n+1)",
        "<m:sSubSup>" + e("e", "a") + e("sub", "i,j") + e("sup", "2") + "</m:sSubSup>": "a_(i,j)^(2)",
        "<m:rad><m:radPr><m:degHide m:val='0'/></m:radPr>" + e("deg", "3") + e("e", "x") + "</m:rad>": "³√(x)",
        "<m:rad>" + e("deg", "3") + e("e", "x") + "</m:rad>": "√(x)",
        "<m:rad><m:radPr><m:degHide m:val='0'/></m:radPr>" + e("deg", "n") + e("e", "x") + "</m:rad>": "√(n)(x)",
        "<m:f><m:fPr><m:type m:val='lin'/></m:fPr>" + e("num", "a") + e("den", "b") + "</m:f>": "(a)/(b)",
        "<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr>" + e("sub", "i=1") + e("sup", "n") + e("e", "i") + "</m:nary>": "∑_(i=1)^(n) i",
        "<m:d>" + e("e", "x") + e("e", "y") + "</m:d>": "(x|y)",
        "<m:func>" + e("fName", "sin") + e("e", "x") + "</m:func>": "sin x",
        "<m:acc><m:accPr><m:chr m:val='\u0303'/></m:accPr>" + e("e", "x") + "</m:acc>": "x\u0303",
        "<m:bar>" + e("e", "x") + "</m:bar>": "(x)\u0305",
        "<m:sPre>" + e("sub", "n") + e("sup", "m") + e("e", "X") + "</m:sPre>": "n ^(m) X",
        "<m:m><m:mr>" + e("e", "1") + e("e", "0") + "</m:mr><m:mr>" + e("e", "0") + e("e", "1") + "</m:mr></m:m>": "(1, 0; 0, 1)",
        "<m:eqArr>" + e("e", "x=1") + e("e", "y=2") + "</m:eqArr>": "x=1; y=2",
        "<m:groupChr>" + e("e", "x") + "</m:groupChr>": "⏟(x)",
        "<m:box>" + e("e", "x") + "</m:box>": "x",
        "<m:limLow>" + e("e", "max") + e("lim", " x in A ") + "</m:limLow>": "max_(x in A)",
        "<m:limUpp>" + e("e", "x") + e("lim", "def") + "</m:limUpp>": "x^(def)",
        "<m:acc><m:accPr><m:chr m:val='\u20d7'/></m:accPr>" + e("e", "v") + "</m:acc>": "v\u20d7",
        "<m:acc>" + e("e", "v") + "</m:acc>": "v\u0302",
        "<m:sPre>" + e("sub", "n") + e("e", "X") + "</m:sPre>": "n X",
        "<m:bar><m:barPr><m:pos m:val='bot'/></m:barPr>" + e("e", "x") + "</m:bar>": "\u0332(x)",
        "<m:groupChr><m:groupChrPr><m:chr m:val='⏞'/><m:pos m:val='top'/></m:groupChrPr>" + e("e", "x") + "</m:groupChr>": "⏞(x)",
        "<m:nary><m:sub/><m:sup/>" + e("e", "f") + "</m:nary>": "∫ f",
        "<m:d><m:dPr><m:begChr m:val=''/><m:sepChr m:val=','/></m:dPr>" + e("e", "x") + e("e", "<m:d>" + e("e", "y") + "</m:d>", False) + "</m:d>": "x,(y))",
        "<m:rad>" + e("deg", "<m:rad><m:radPr><m:degHide m:val='0'/></m:radPr>" + e("deg", "9") + e("e", "z") + "</m:rad>", False) + e("e", " x  y ") + "</m:rad>": "√(x y)",
        "<m:f><m:fPr><m:type m:val='bar'/></m:fPr><m:fPr><m:type m:val='lin'/></m:fPr>" + e("num", "") + e("den", "b") + "</m:f>": "() / (b)",
        "<m:strange>" + e("e", "kept") + "</m:strange>": "kept",
    }
    schema = "file_id string, part string, xml string"
    bodies = [(b, "word/document.xml", f"<w:document {W}><w:body><w:p><m:oMath>{b}</m:oMath></w:p></w:body></w:document>") for b in cases]
    rows = word.docx_elements(spark.createDataFrame(bodies, schema)).filter("kind = 'equation'").collect()
    assert {r.file_id: r.text for r in rows} == cases


def test_word_bodies_keep_every_text_once(spark):
    more = ' xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'

    def p(text, props=""):
        return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"

    def box(text):
        return f"<w:txbxContent>{p(text)}</w:txbxContent>"

    inner = f"<w:tbl><w:tr><w:tc>{p('deep')}</w:tc></w:tr><w:sdt><w:sdtContent><w:tr><w:tc>{p('low')}</w:tc></w:tr></w:sdtContent></w:sdt></w:tbl>"
    body = (
        f"<w:tbl><w:tr><w:tc>{p('a')}{inner}{p('b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr><w:tr><w:tc>{p('d')}</w:tc></w:tr></w:tbl>"
        f"<w:p><w:r><mc:AlternateContent><mc:Choice>{box('one')}</mc:Choice><mc:Fallback>{box('one')}</mc:Fallback></mc:AlternateContent><w:t>after</w:t></w:r></w:p>"
        f"<w:p><w:r><mc:AlternateContent><mc:Fallback><w:pict><v:imagedata r:id='old'/></w:pict></mc:Fallback></mc:AlternateContent></w:r></w:p>"
        "<m:oMathPara><m:oMath><m:r><m:t>x=1</m:t></m:r></m:oMath></m:oMathPara><m:oMath><m:r><m:t>y</m:t></m:r></m:oMath>"
        f"{p('right', '<w:pPr><w:jc w:val=%sright%s/><w:pPrChange><w:pPr><w:jc w:val=%scenter%s/></w:pPr></w:pPrChange></w:pPr>' % (('\"',) * 4))}"
    )
    rows = word.docx_elements(spark.createDataFrame([("f", "word/document.xml", f"<w:document {W}{more}><w:body>{body}</w:body></w:document>"), ("bad", "word/document.xml", "<w:document><w:body>"), ("none", "word/document.xml", None)], "file_id string, part string, xml string")).collect()
    found = sorted((r for r in rows if r.file_id == "f"), key=lambda r: r.at)
    assert [r.text for r in found if r.kind == "text"] == ["a", "deep", "low", "b", "c", "d", "one", "after", "right"]
    assert {r.text: (r.table_no, r.row_no, r.cell_no, r.nesting) for r in found if r.kind == "text" and r.table_no is not None} == {"a": (0, 0, 0, 0), "deep": (1, 0, 0, 1), "low": (1, 1, 0, 1), "b": (0, 0, 0, 0), "c": (0, 0, 1, 0), "d": (0, 1, 0, 0)}
    assert [(r.kind, r.text, r.align) for r in found if r.kind in ("image", "equation")] == [("image", "old", "left"), ("equation", "x=1", "center"), ("equation", "y", "left")]
    assert next(r.align for r in found if r.text == "right") == "right"
    assert [r.para for r in found if r.kind == "paragraph"] == list(range(12)) and [r.at for r in found] == list(range(len(found)))
    assert sorted((r.file_id, r.kind) for r in rows if r.file_id != "f") == [("bad", "problem"), ("none", "problem")]


def test_markup_too_deep_is_a_problem(spark):
    deep = "<a>" * (markup.MOST_DEPTH + 1) + "</a>" * (markup.MOST_DEPTH + 1)
    rows = markup.xml_nodes(spark.createDataFrame([("x", deep), ("y", "<a><b/><c>t</c><b k='1'/></a>")], "id string, xml string"), {"b", "c"}).collect()
    assert [r.problem is not None for r in rows if r.id == "x"] == [True]
    assert [(r.tags[-1], r.child, r.twin, r.text, r.pre < r.post, len(r.path)) for r in rows if r.id == "y"] == [("b", 0, 0, "", True, 2), ("c", 1, 0, "t", True, 2), ("b", 2, 1, "", True, 2)]
    assert equations.TAGS >= {"m:oMath", "m:t"}


def test_elements_are_numbered_in_their_scopes_and_small_parts_share_batches(spark):
    xml = "<a><t><r><c/></r><r><c k='1'/><c><t><r><c/></r></t></c></r></t><f><t/><f/></f><c/></a>"
    parts = spark.createDataFrame([(str(i), xml) for i in range(3)] + [("bad", "<")], "id string, xml string").coalesce(1)
    places = markup.xml_places(parts, {"t", "r", "c", "f"}, {"t": None, "r": "t", "c": "r"}, {"f"}, ("k",))
    got = [(r.tag, r.over, r.twin, r.no_t, r.in_t, r.no_r, r.no_c, r.a_k, r.outermost is not None) for r in places.filter("id = '1'").orderBy("pre").collect()]
    assert got == [
        ("t", "a", 0, 0, 0, None, None, None, False), ("r", "t", 0, 0, 0, 0, None, None, False), ("c", "r", 0, 0, 0, 0, 0, None, False), ("r", "t", 1, 0, 0, 1, None, None, False), ("c", "r", 0, 0, 0, 1, 0, "1", False),
        ("c", "r", 1, 0, 0, 1, 1, None, False), ("t", "c", 0, 1, 1, None, None, None, False), ("r", "t", 0, 1, 1, 0, None, None, False), ("c", "r", 0, 1, 1, 0, 0, None, False),
        ("f", "a", 0, None, None, None, None, None, True), ("t", "f", 0, None, None, None, None, None, True), ("f", "f", 0, None, None, None, None, None, True), ("c", "a", 0, None, None, None, None, None, False),
    ]
    assert places.filter("problem is not null").select("id").collect() == [("bad",)]
    cells = [pa.array(["x", "y"]), pa.array([xml.encode(), xml.encode()])]
    batches = markup._in_batches(iter([pa.RecordBatch.from_arrays(cells, ["id", "xml"])]), "xml", ["id"], markup._ARROW, lambda data: markup._nodes(data, frozenset("c")))
    assert [b.num_rows for b in batches] == [10]


def test_documents_that_are_no_xml(spark):
    parts = spark.createDataFrame([("a", "word/document.xml", None), ("b", "word/document.xml", "<w:document>"), ("c", "word/other.xml", "<")], "file_id string, part string, xml string")
    assert sorted((r.file_id, r.kind) for r in word.docx_elements(parts).collect()) == [("a", "problem"), ("b", "problem")]
    decks = spark.createDataFrame([("a", 0, None), ("b", 1, "<p")], "file_id string, slide_no int, xml string")
    assert sorted((r.file_id, r.kind, r.x) for r in slides.pptx_elements(decks).collect()) == [("a", "problem", None), ("b", "problem", None)]


def test_pptx_boxes(spark):
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    shape = '<p:sp><p:spPr>{}</p:spPr><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sp>'
    xml = f'<p:sld xmlns:a="{a}" xmlns:p="{p}"><p:cSld><p:spTree><p:grpSp>' + shape.format('<a:xfrm><a:off x="12700" y="25400"/><a:ext cx="127000" cy="12700"/></a:xfrm>', "placed") + "</p:grpSp>" + shape.format("", "one") + shape.format("", "two") + "</p:spTree></p:cSld></p:sld>"
    rows = slides.pptx_elements(spark.createDataFrame([("f", 0, xml)], "file_id string, slide_no int, xml string")).orderBy("box_no").collect()
    assert [(r.text, r.x, r.y, r.width) for r in rows] == [("placed", 1.0, 2.0, 10.0), ("one", 24.0, 24.0, 672.0), ("two", 24.0, 64.0, 672.0)]
    assert [r.grouped for r in rows] == [True, False, False] and rows[0].paragraphs[0].runs[0].size == 18.0


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\x01\x2c\x02\x58\x03"
    filled = b"\xff\xd8\xff\xff\xe0\0\x04ab\x00\xff\xd0\xff\x01\xff\xc2\0\x11\x08\x01\x2c\x02\x58\x03\0\0"
    rows = S.image_info(spark.createDataFrame([(4, filled)], "n int, bytes binary")).collect()
    assert [(r.width, r.height) for r in rows] == [(600, 300)]
    rows = S.image_info(spark.createDataFrame([(1, png), (2, jpeg), (3, b"GIF8")], "n int, bytes binary")).orderBy("n").collect()
    assert [(r.kind, r.width, r.height) for r in rows] == [("png", 640, 480), ("jpeg", 600, 300), (None, 300, 200)]
    assert spark.createDataFrame([(b"a",)], "b binary").select(S.fnv1a32("b")).first()[0] == "1:e40c292c"


def test_written_and_read_back(spark, tmp_path):
    grid = spark.createDataFrame([("f", 0, 1, ["c"]), ("f", 0, 0, ["a", "b"])], "file_id string, sheet_no int, row int, cells array<string>")
    S.write_sheets(grid, str(tmp_path / "sheets"))
    assert spark.read.csv(str(tmp_path / "sheets")).count() == 2
    S.write_table(grid, str(tmp_path / "table"), ["file_id"])
    assert S.read_text_items(spark, str(tmp_path / "table")).count() == 2
    (tmp_path / "in").mkdir()
    for name in ("10.pdf", "2.pdf"):
        (tmp_path / "in" / name).write_bytes(b"%PDF-")
    assert [r.name for r in S.read_files(spark, str(tmp_path / "in")).orderBy("ord").collect()] == ["2.pdf", "10.pdf"]


def test_intake_takes_each_file_once(spark, tmp_path):
    for name in ("a.pdf", "b.docx", "c.zip"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x")
    where = [str(tmp_path / x) for x in ("in", "table", "progress")]
    jobs.take_in(spark, *where)
    (tmp_path / "in" / "more").mkdir()
    (tmp_path / "in" / "more" / "d.xlsx").write_bytes(archive([("a", "b")]))
    (tmp_path / "in" / "e.txt").write_bytes(b"y")
    for _ in range(2):
        jobs.take_in(spark, *where)
    got = {(r.batch, r.name, r.kind, r.accepted, r.reason, r.verdict) for r in spark.read.parquet(where[1]).collect()}
    assert got == {
        (0, "a.pdf", "pdf", True, None, None), (0, "b.docx", "docx", False, "other:docx", "not-zip"), (0, "c.zip", "zip", False, "zip", "not-zip"),
        (1, "d.xlsx", "xlsx", False, "other:xlsx", "ok"), (1, "e.txt", "other", False, "unknown", None),
    }


def test_small_files_share_tasks_and_folders(spark, tmp_path):
    n, odd = 400, {3: "", 5: None, 7: "é\nz\n"}
    rows = [(i % 2, f"file-{i}.pdf", odd.get(i, "x" * i)) for i in range(n)]
    texts = spark.createDataFrame(rows, "folder int, name string, value string").repartition(4, "folder")
    for _ in range(2):  # a second writing changes nothing
        S.write_texts(texts, f"file://{tmp_path}/in")
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["0", "1"]
    assert {p.name: p.read_bytes() for p in (tmp_path / "in").glob("*/*")} == {name: (value or "").encode() + b"\n" for _, name, value in rows}
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    jobs.take_in(spark, f"file://{tmp_path}/in", str(tmp_path / "table"), str(tmp_path / "progress"))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert {(r.name, r.size) for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {(name, len((value or "").encode()) + 1) for _, name, value in rows}
    assert len(list((tmp_path / "table" / "batch=0").glob("part-*"))) <= 4
    S.write_texts(texts.filter("name = 'file-7.pdf'"), str(tmp_path / "elsewhere"))
    assert [p.read_text() for p in (tmp_path / "elsewhere").glob("folder=1/name=file-7.pdf/part-*")] == ["é\nz\n\n"]


def test_edit_stream_agrees_with_the_batch_over_restarts(spark, tmp_path):
    schema = "doc_id long, seq long, kind string, page int, item int, text string"
    log = [(d, s, "discard" if s % 31 == 0 else "revert" if s % 11 == 0 else "apply", s % 3, s % 5, f"t{s}") for d in (1, 2) for s in range(d, 80)] + [(3, 1, "apply", 0, 0, None), (3, 2, "revert", 1, 0, None)]
    late = [(1, 7, "discard", 0, 0, None), (2, 77, "apply", 0, 0, "never"), (2, None, "apply", 0, 0, "no place")]
    parts = [[e for e in log if e[1] < 40], [e for e in log if e[1] >= 40], [*late, (2, 200, "apply", 9, 9, "in time"), (4, 5, "apply", 0, 1, "new")]]
    where = [str(tmp_path / x) for x in ("log", "changes", "progress")]
    changes = None
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where[0])
        jobs.keep_edits(spark, spark.readStream.schema(schema).parquet(where[0]), *where[1:])
        changes = spark.read.schema(jobs.CHANGE).parquet(where[1])
    whole = [e for e in [*log, *parts[2]] if e not in late]
    want = {(r.doc_id, r.page, r.item, r.seq, r.text) for r in plans.current_edits(spark.createDataFrame(whole, schema)).collect()}
    assert {tuple(r) for r in jobs.edits_of(changes).collect()} == want and len(want) > 5
    assert {tuple(r) for r in jobs.late_events(changes).collect()} == {(1, 1, 7, 7), (2, 2, 77, 77)}


class _Value:
    """A state value that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_edit_state_is_read_and_written_once_a_document_and_batch():
    kept, state = _Value(), jobs.EditState()
    state.init(kept)
    lots = [
        ([(1, s, "apply", s % 10, s % 100, f"t{s}") for s in range(5000)], 100, 4999),
        ([(1, 5002, "revert", 3, 0, ""), (1, 4999, "apply", 0, 0, "late"), (1, 5001, "apply", 3, 3, "gone"), (1, 5003, "apply", 3, 3, "new"), (1, 5000, "apply", None, None, "nowhere")], 92, 5003),
        ([(1, 5003, "discard", 0, 0, "late"), (1, None, "apply", 0, 0, "late")], 92, 5003),
        ([(1, 6000, "discard", None, None, None)], 0, 6000),
    ]
    out = []
    for i, (rows, n, last) in enumerate(lots):
        kept.calls = 0
        out.append([tuple(r) for r in state.handleInputRows((1,), iter(rows), None)])
        assert kept.calls == (1 if i == 2 else 2) and len(kept.value[1]) == n and kept.value[0] == last
    assert [len(x) for x in out] == [100, 13, 2, 92] and {x[1] for x in out[3]} == {"clear"}
    assert {x for x in out[1] if x[1] != "clear"} == {(1, "late", 0, 0, 4999, "late"), (1, "set", 3, 3, 5003, "new"), (1, "set", None, None, 5000, "nowhere")}


def test_edits_without_a_place_go_through_the_stream(spark, tmp_path):
    schema = "doc_id long, seq long, kind string, page int, item int, text string"
    lots = [[(1, 1, "apply", None, None, "a"), (1, 2, "apply", 0, 0, None), (2, 1, "apply", None, 4, "b")], [(1, 3, "discard", None, None, None), (2, 2, "revert", None, None, None), (2, 3, "apply", 5, None, "c")]]
    where = [str(tmp_path / x) for x in ("log", "changes", "progress")]
    for rows in lots:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where[0])
        jobs.keep_edits(spark, spark.readStream.schema(schema).parquet(where[0]), *where[1:])
    got = {tuple(r) for r in jobs.edits_of(spark.read.schema(jobs.CHANGE).parquet(where[1])).collect()}
    want = {(r.doc_id, r.page, r.item, r.seq, r.text) for r in plans.current_edits(spark.createDataFrame(sum(lots, []), schema)).collect()}
    assert got == want == {(2, None, 4, 1, "b"), (2, 5, None, 3, "c")}


def test_edits_are_kept_without_a_state_store_and_batches_broken_off_are_made_up_for(spark, tmp_path):
    schema, draw, lots, states = "doc_id long, seq long, kind string, page int, item int, text string", random.Random(5), [], {}
    for lot in range(4):
        seqs = draw.sample(range(-3 + 40 * lot, 60 + 40 * lot), 45)
        places = (None, 0, 1, 2)
        lots.append([(draw.choice((None, 0, 1, 2)), q, draw.choice(("apply",) * 6 + ("revert", "discard")), draw.choice(places), draw.choice(places), draw.choice((None, f"t{q}"))) for q in (*seqs, None)])
    want = Counter()
    for rows in lots:
        for doc in {r[0] for r in rows}:
            if doc not in states:
                states[doc] = jobs.EditState()
                states[doc].init(_Value())
            want.update(tuple(r) for r in states[doc].handleInputRows((doc,), iter([r for r in rows if r[0] == doc]), None))
    at, columns = {x: str(tmp_path / x) for x in ("log", "changes", "progress")}, ["doc_id", "kind", "page", "item", "seq", "text"]
    for rows in lots:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at["log"])
        for _ in range(2):
            jobs.keep_edits(spark, spark.readStream.schema(schema).parquet(at["log"]), at["changes"], at["progress"])
            max((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda x: int(x.name)).unlink()  # as if it had been broken off at the end
            for checksum in (tmp_path / "progress" / "commits").glob(".*.crc"):
                checksum.unlink()
        jobs.keep_edits(spark, spark.readStream.schema(schema).parquet(at["log"]), at["changes"], at["progress"])
    got = Counter(tuple(r) for r in spark.read.schema(jobs.CHANGE).parquet(at["changes"]).select(*columns).collect())
    assert got == want and {k for _, k, *_ in want} == {"set", "clear", "late"}
    assert not (tmp_path / "progress" / "state").exists() and sorted(p.name for p in (tmp_path / "progress" / "kept").iterdir()) == ["0", "1"]


def test_edits_kept_by_batches_and_by_state_are_the_same(spark, tmp_path):
    schema = "doc_id long, seq long, kind string, page int, item int, text string"
    lots = [[(d, s, "discard" if s % 31 == 0 else "revert" if s % 11 == 0 else "apply", s % 3, s % 5, f"t{s}") for d in (1, 2) for s in range(lot * 40 - lot * 5 + d, 40 + lot * 40)] for lot in range(2)]
    log, out = str(tmp_path / "log"), {}
    for rows in lots:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        events = spark.readStream.schema(schema).parquet(log)
        jobs.keep_edits(spark, events, str(tmp_path / "kept"), str(tmp_path / "kept-progress"))
        with jobs.settings(spark, {jobs.STATE_STORE: jobs.ROCKS}):
            state = jobs.stream_edits(events).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state-progress"))
            state.trigger(availableNow=True).start(str(tmp_path / "state")).awaitTermination()
    for name in ("kept", "state"):
        out[name] = Counter(tuple(r) for r in spark.read.schema(jobs.CHANGE).parquet(str(tmp_path / name)).select("doc_id", "kind", "page", "item", "seq", "text").collect())
    assert out["kept"] == out["state"] and {k for _, k, *_ in out["kept"]} == {"set", "clear", "late"}


def test_an_empty_edit_log_leaves_an_empty_table(spark, tmp_path):
    schema = "doc_id long, seq long, kind string, page int, item int, text string"
    spark.createDataFrame([], schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    for _ in range(2):
        jobs.keep_edits(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "log")), str(tmp_path / "changes"), str(tmp_path / "progress"))
    assert jobs.edits_of(spark.read.schema(jobs.CHANGE).parquet(str(tmp_path / "changes"))).count() == 0


def test_faults_of_xml_parts_are_told_apart(spark):
    cases = {
        "<a/>": None, " <!-- c --><?p x?><a>x</a> \n<!-- d -->": None, '<?xml version="1.0"?><x:a xmlns:x="u"><b/></x:a >': None, "﻿<a.b><![CDATA[<]]></a.b>": None, '<a b="<"/>'.replace("<\"", "&lt;\""): None,
        "": "empty", " \n": "empty", "<a>": "truncated", "<a><b/>": "truncated", "<a/": "truncated", "<a><b>text</b></": "truncated", "<a>x</a>trailing": "truncated", "<a></a><b/>": "truncated", "text": "truncated",
        "<a><b></a>": "badly nested", "<a><b></c></a>": "badly nested", "<a>&bad;</a>": "badly nested", '<a b="1" b="2"/>': "badly nested", "<a>\x01</a>": "badly nested",
    }
    frame = spark.createDataFrame([(c, w) for c, w in cases.items()] + [(None, "empty")], "xml string, want string")
    got = frame.select("xml", "want", plans.xml_fault(F.col("xml")).alias("got")).collect()
    assert [(r.xml, r.got) for r in got] == [(r.xml, r.want) for r in got]
    parts = frame.select(F.lit("f").alias("file_id"), F.lit("a.xml").alias("part"), "xml")
    out = plans.verify_package(parts, parts.select("file_id", F.lit(1).alias("characters")).distinct())
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and not out.first().ok


def test_word_elements_become_blocks_in_order(spark):
    more = ' xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:v="urn:schemas-microsoft-com:vml"'

    def p(text, props="", picture=""):
        cut = f"<w:r><w:pict><v:imagedata r:id='{picture}'/></w:pict></w:r><w:r><w:t>{text} more</w:t></w:r>" if picture else ""
        return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r>{cut}</w:p>"

    item = "<w:numPr/>"
    inner = f"<w:tbl><w:tr><w:tc>{p('deep')}</w:tc></w:tr></w:tbl>"
    body = (
        p("Head", "<w:pStyle w:val='heading 2'/>") + p("") + p("one", item) + p("two", item, "pic1") + p("", "", "pic2").replace(" more", "") + p("text", "", "pic3")
        + f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}{inner}</w:tc><w:tc>{p('')}</w:tc></w:tr><w:tr><w:tc>{p('c')}</w:tc></w:tr></w:tbl>" + p("last", item)
    )
    elements = word.docx_elements(spark.createDataFrame([("f", "word/document.xml", f"<w:document {W}{more}><w:body>{body}</w:body></w:document>"), ("bad", "word/document.xml", "<")], "file_id string, part string, xml string"))
    blocks = content.word_blocks(elements).orderBy("block_no").collect()
    assert [(b.type, b.level, b.text or b["items"] or b["rows"]) for b in blocks] == [
        ("heading", 2, "Head"), ("image", None, "pic1"), ("image", None, "pic2"), ("list", None, ["one", "two", "two more"]), ("paragraph", None, "text"), ("image", None, "pic3"), ("paragraph", None, "text more"),
        ("table", None, [["a\nb", ""], ["c"]]), ("table", None, [["deep"]]), ("list", None, ["last"]),
    ]
    assert [tuple(r) for r in content.count_text(content.word_blocks(elements)).collect()] == [("f", 10, 4 + 14 + 13 + 8 + 4)]


def test_files_without_blocks_are_counted_and_only_plain_spaces_trimmed(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "\x01\x02"), (4, " a b\t"), (5, "\u00a0a\u2003"), (6, " \r"), (7, "a\n b\r\nc \u0085")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = office.word_characters(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("1", 0, 0), ("2", 0, 0), ("3", 0, 0), ("4", 1, 3), ("5", 1, 3), ("6", 1, 0), ("7", 4, 1 + 2 + 3)]


def test_slides_become_blocks(spark):
    boxes = spark.createDataFrame(
        [("f", 0, 0, "text", None, [("left", [("a", 1.0, False, False), ("b", 1.0, True, False)]), ("left", []), ("left", [("c ", 1.0, False, False)])], None), ("f", 0, 1, "table", None, None, [["x", "yz"]]), ("f", 0, 2, "imageRef", "r1", None, None), ("f", 2, 0, "unsupported", None, None, None)],
        "file_id string, slide_no int, box_no int, kind string, text string, paragraphs array<struct<align:string,runs:array<struct<text:string,size:double,bold:boolean,italic:boolean>>>>, rows array<array<string>>",
    )
    out = content.slide_blocks(boxes)
    assert [(b.block_no, b.depth, b.slide_no, b.type, b.text) for b in out.orderBy("block_no").collect()] == [
        (0, 0, 0, "slide", None), (1, 1, 0, "paragraph", "ab"), (2, 1, 0, "paragraph", "c "), (3, 1, 0, "table", None), (4, 1, 0, "image", "r1"), (5, 0, 2, "slide", None),
    ]
    assert [tuple(r) for r in content.count_text(out).collect()] == [("f", 6, 6)]
