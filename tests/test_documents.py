"""Decoders and operators over files made in the test."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom import dims
from paperloom.functions import numbering, sheets, text
from paperloom.operators import edit, html, tree
from paperloom.plans import builders
from paperloom.sources import containers, csvdoc, decode, detect, files, fonts, legacy, svm


def table(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_id long, content binary")


def odt(body, styles=""):
    content = f'<office:document-content {builders._ODF} xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:fo="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0"><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>'
    return containers.write_zip([("mimetype", b"application/vnd.oasis.opendocument.text", None), ("content.xml", content.encode(), 6)])


LIST_STYLE = '<text:list-style style:name="L"><text:list-level-style-number text:level="1" style:num-format="1" style:num-suffix="."/><text:list-level-style-number text:level="2" style:num-format="a" style:num-suffix=")" text:display-levels="2"/></text:list-style>'


def docx(body, numbering_part=""):
    parts = [("word/document.xml", f'<w:document {builders._W} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>{body}</w:body></w:document>'.encode(), 6)]
    if numbering_part:
        parts.append(("word/numbering.xml", f"<w:numbering {builders._W}>{numbering_part}</w:numbering>".encode(), 6))
    return containers.write_zip(parts)


def item(level, words):
    return f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{words}</w:t></w:r></w:p>'


NUMBERING = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'


def markers(spark, content):
    return [r.list_marker for r in decode.elements(table(spark, content)).where("element_type = 'list_item'").orderBy("element_id").collect()]


def test_formats_agree_on_list_markers(spark):
    a = odt('<text:list text:style-name="L"><text:list-item><text:p>a</text:p><text:list><text:list-item><text:p>b</text:p></text:list-item><text:list-item><text:p>c</text:p></text:list-item></text:list></text:list-item><text:list-item><text:p>d</text:p></text:list-item></text:list>', LIST_STYLE)
    b = docx(item(0, "a") + item(1, "b") + item(1, "c") + item(0, "d"), NUMBERING)
    assert markers(spark, a) == ["1.", "1.a)", "1.b)", "2."]
    assert markers(spark, b) == ["1.", "1.a)", "1.b)", "2."]


def test_text_runs_spaces_and_unknown_elements(spark):
    content = odt('<text:p text:style-name="P">a<text:s text:c="3"/>b<text:tab/>c<text:span>d</text:span><text:unknown>gone</text:unknown><text:line-break/><text:a xlink:href="http://x">e</text:a></text:p><text:h>t</text:h>')
    rows = decode.elements(table(spark, content)).orderBy("element_id").collect()
    assert [(r.element_type, r.text) for r in rows if r.element_type in ("text", "line_break", "link")] == [("text", "a   b\tc"), ("text", "d"), ("line_break", None), ("link", None), ("text", "e"), ("text", "t")]
    assert rows[2].path == "/child:0/child:0" and next(r for r in rows if r.element_type == "link").href == "http://x"
    assert tree.text_of(decode.elements(table(spark, content))).first().text == "a   b\tcd\ne\nt"


def test_styles_resolve_through_parents(spark):
    named = '<style:style style:name="A" style:family="paragraph"><style:text-properties fo:font-size="12pt" fo:color="#ff0000"/></style:style><style:style style:name="B" style:family="paragraph" style:parent-style-name="A"><style:text-properties fo:font-size="14pt"/></style:style><style:style style:name="C" style:parent-style-name="C"/>'
    rows = {r.style_name: r.resolved for r in decode.styles(table(spark, odt("<text:p/>", named))).collect()}
    assert rows["B"] == {"fo:font-size": "14pt", "fo:color": "#ff0000"} and rows["C"] == {}


def test_text_tables_and_spans(spark):
    body = '<w:tbl><w:tblGrid><w:gridCol w:w="1440"/><w:gridCol/></w:tblGrid><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p/></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    rows = decode.elements(table(spark, docx(body))).where("element_type = 'table_cell'").orderBy("element_id").collect()
    assert [(r.col_span, r.is_covered) for r in rows] == [(2, False), (1, True)]


def test_sheets_of_both_formats(spark):
    rows = [["k", "v"], [1, "x"], [2.5, None], [None, "y"]]
    got = decode.cells(table(spark, builders.xlsx(rows), builders.ods(rows))).orderBy("file_id", "row_ix", "col_ix").collect()
    for i in (0, 1):
        assert [(r.ref, r.text, r.value_type, r.num) for r in got if r.file_id == i] == [("A1", "k", "string", None), ("B1", "v", "string", None), ("A2", "1", "float", 1.0), ("B2", "x", "string", None), ("A3", "2.5", "float", 2.5), ("B4", "y", "string", None)]
    assert [(r.name, r.used_rows, r.used_cols) for r in decode.sheets(table(spark, builders.xlsx(rows), builders.ods(rows))).orderBy("file_id").collect()] == [("rows", 4, 2)] * 2


def test_repeats_merges_and_dates(spark):
    body = '<office:spreadsheet><table:table table:name="t"><table:table-row table:number-rows-repeated="1000"><table:table-cell table:number-columns-repeated="9"/></table:table-row><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2" office:value-type="date"><text:p>1 May</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet>'
    got = decode.cells(table(spark, builders._odf(body, "spreadsheet"))).orderBy("row_ix", "col_ix").collect()
    assert [(r.ref, r.value_type) for r in got] == [("A1001", "string"), ("B1001", "string"), ("A1002", "string"), ("B1002", "string")]
    source = zipfile.ZipFile(io.BytesIO(builders.xlsx([["a", "b"], ["c", "d"]])))
    parts = [(n, source.read(n).replace(b"</sheetData>", b'</sheetData><mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="D1:E1"/></mergeCells>'), 6) for n in source.namelist()]
    got = decode.cells(table(spark, containers.write_zip(parts))).orderBy("row_ix", "col_ix").collect()
    assert [(r.row_span, r.col_span, r.is_covered) for r in got] == [(2, 2, False), (1, 1, True), (1, 1, True), (1, 1, True)]


def test_presentation(spark):
    p = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    slide = lambda t: f"<p:sld {p}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>".encode()
    relations = "".join(f'<Relationship Id="r{n}" Target="slides/s{n}.xml"/>' for n in (1, 2))
    made = containers.write_zip([("ppt/presentation.xml", f'<p:presentation {p}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>'.encode(), 6), ("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{builders._RELS}">{relations}</Relationships>'.encode(), 6), ("ppt/slides/s1.xml", slide("one"), 6), ("ppt/slides/s2.xml", slide("two"), 6)])
    assert [r.text for r in decode.elements(table(spark, made)).where("element_type = 'text'").orderBy("element_id").collect()] == ["two", "one"]
    assert [r.name for r in html.html_views(table(spark, made)).orderBy("view_ix").collect()] == ["document", "slide1", "slide2"]


def test_legacy_workbook(spark):
    long = "é" * 20
    sst = struct.pack("<II", 2, 2) + struct.pack("<HB", 2, 0) + b"ab" + struct.pack("<HB", 20, 0) + long.encode("latin-1")[:8]
    rest = b"\x01" + long[8:].encode("utf-16-le")
    cells = builders.record(0xFD, struct.pack("<HHHI", 0, 0, 0, 1)) + builders.record(0x27E, struct.pack("<HHHI", 1, 0, 0, 42 << 2 | 2)) + builders.record(0x203, struct.pack("<HHHd", 2, 1, 0, 0.1)) + builders.record(0x205, struct.pack("<HHHBB", 3, 0, 0, 7, 1)) + builders.record(0x06, struct.pack("<HHH", 4, 0, 0) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 6) + builders.record(0x207, struct.pack("<HB", 3, 0) + b"str")
    cells += builders.record(0xBD, struct.pack("<HH", 5, 1) + struct.pack("<HI", 0, 300 << 2 | 3) + struct.pack("<HI", 0, 8 | 2) + struct.pack("<H", 2)) + builders.record(0xE5, struct.pack("<HHHHH", 1, 0, 1, 0, 0))
    name = builders.record(0x85, struct.pack("<IBB", 0, 0, 0) + struct.pack("<BB", 2, 0) + b"S1")
    start = builders.record(0x809, b"\0" * 16)
    head = lambda at: start + builders.record(0x85, struct.pack("<IBB", at, 0, 0) + struct.pack("<BB", 2, 0) + b"S1") + builders.record(0xFC, sst) + builders.record(0x3C, rest) + builders.record(0x0A, b"")
    book = head(len(head(0))) + start + cells + builders.record(0x0A, b"")
    data = builders.compound({"Workbook": book})
    assert detect.candidates(data) == ["cfb", "xls"] and name
    got = decode.cells(table(spark, data)).orderBy("row_ix", "col_ix").collect()
    assert [(r.ref, r.text, r.is_covered) for r in got] == [("A1", long, False), ("A2", "42", True), ("B3", "0.1", False), ("A4", "#DIV/0!", False), ("A5", "str", False), ("B6", "3", False), ("C6", "2", False)]
    assert {r.value_type for r in got} == {"string"} and decode.sheets(table(spark, data)).first().name == "S1"


def test_legacy_text(spark):
    body = "One \x13 HYPERLINK x \x14link\x15\x1ea\rTwo\x0bmore\x01\r"
    at = 0x400
    main = bytearray(at + len(body) + 10)
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<I", main, 0x4C, len(body))
    main[at : at + len(body)] = body.encode("cp1252")
    pieces = struct.pack("<II", 0, len(body)) + struct.pack("<HIH", 0, at * 2 | 0x40000000, 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    data = builders.compound({"WordDocument": bytes(main), "0Table": clx})
    assert tree.text_of(decode.elements(table(spark, data))).first().text == "One link-a\nTwo\nmore"
    struct.pack_into("<H", main, 0x0A, 0x0100)
    with pytest.raises(legacy.Encrypted):
        legacy.TextDocument(builders.compound({"WordDocument": bytes(main), "0Table": clx}))


def test_archives(spark):
    data = containers.write_zip([("/a-b", b"1", 6), ("/a/c", b"22", None), ("/a/", None, None), ("/d.png", b"x" * 3000, 6)])
    rows = containers.entries(table(spark, data, b"no archive", b"PK\3\4broken"))
    got = rows.where("file_id = 0").orderBy("entry_ix").collect()
    assert [(r.entry_path, r.is_file, r.method) for r in got] == [("/a-b", True, "deflated"), ("/a/c", True, "stored"), ("/a", False, "stored"), ("/d.png", True, "deflated")]
    assert bytes(got[1].content) == b"22" and got[3].mimetype == "image/png"
    assert rows.where("file_id = 2").first().error
    assert [r.entry_path for r in containers.walk(rows.where("file_id = 0")).collect()] == ["/a", "/a/c", "/a-b", "/d.png"]
    assert {r.path for r in containers.directories(rows.where("file_id = 0")).collect()} == {"/", "/a"}
    assert [r.human_size for r in containers.listing(rows).collect()] == ["2 B", "1 B", "2.9 KiB"]


def test_pdf_pages_segments_and_links(spark):
    made = builders.pdf("\n".join(f"line {i} (x) \\ é" for i in range(130)))
    pages = decode.pdf_pages(table(spark, made, b"%PDF-1.4 broken")).orderBy("page_ix").collect()
    assert len(pages) == 3 and pages[0].text.split("\n")[5] == "line 5 (x) \\ é" and (pages[0].width, pages[0].height) == (595.0, 842.0)
    assert decode.pdf_pages(table(spark, made), (1, 2)).count() == 1
    lines = decode.group_lines(decode.pdf_segments(table(spark, made))).groupBy("page_ix").agg(F.max("line_ix").alias("n")).orderBy("page_ix").collect()
    assert [r.n for r in lines] == [59, 59, 9]
    assert decode.meta(table(spark, made)).first().entry_count == 3
    broken = made.replace(b"startxref\n", b"startxref\n9")
    assert decode.pdf_pages(table(spark, broken)).count() == 3


def test_edit_and_save(spark):
    made = [odt("<text:p>one<text:s/>two</text:p><text:p>b<text:span>c</text:span>d</text:p>"), docx("<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>"), builders.xlsx([["a"]])]
    changes = spark.createDataFrame([(0, "/child:0/child:0", "new  text\tend"), (0, "/child:1/child:2", "D"), (1, "/child:0/child:0/child:0", "a  b\tc"), (2, "/x", "y")], "file_id long, path string, new_text string")
    diffs = edit.generate_diff(changes)
    saved = {r.file_id: r for r in edit.save_documents(table(spark, *made), diffs).collect()}
    for i, want in ((0, "new  text\tend\nbcD"), (1, "a  b\tc")):
        assert tree.text_of(decode.elements(table(spark, bytes(saved[i].content)))).first().text == want
    assert "cannot be saved" in saved[2].error
    assert zipfile.ZipFile(io.BytesIO(bytes(saved[0].content))).infolist()[0].filename == "mimetype"
    rows = decode.elements(table(spark, *made))
    edited, errors = edit.apply_diff(rows, edit.parse_diffs(diffs))
    assert edited.where("file_id = 0 and path = '/child:1/child:2'").first().text == "D" and errors.count() == 1


def test_html_views(spark):
    made = [odt('<text:p> a &lt;b&gt;</text:p><text:p/>'), b"x\n y  z\n", builders.xlsx([["h", 2]]), b"<r><a k='1'>t</a><b><c/></b></r>", b"\x89PNG\r\n\x1a\n", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"]
    rows = {(r.file_id, r.view_ix): r for r in html.html_views(table(spark, *made)).collect()}
    assert "<x-p><x-s>&nbsp;a &lt;b&gt;</x-s></x-p><x-p><br></x-p>" in rows[0, 0].html
    assert '<div class="line" data-line="2">&nbsp;y &nbsp;z</div>' in rows[1, 0].html
    assert '<td class="value-type-float"><x-s>2</x-s></td>' in rows[2, 1].html and rows[2, 1].path == "sheet0.html"
    assert '&lt;r&gt;\n  &lt;a k="1"&gt;t&lt;/a&gt;\n  &lt;b&gt;\n    &lt;c/&gt;\n  &lt;/b&gt;\n&lt;/r&gt;' in rows[3, 0].html
    assert "data:image/png;base64," in rows[4, 0].html and rows[5, 0].error
    assert "sheet" in html.views_of(made[2], html.HtmlConfig(sheet_limit=(1, 1)))[1][1]


def test_offline_and_cli(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a,b\n1,2\n")
    found = files.from_disk(spark, str(tmp_path / "in"))
    assert found.count() == 1 and files.spread(found).count() == 1
    assert html.bring_offline(html.html_views(found), f"file://{tmp_path}/out").count() == 2
    from paperloom import cli

    assert cli.main(["meta", str(tmp_path / "in"), str(tmp_path / "meta")]) == 0
    assert '"fileType":"csv"' in spark.read.json(str(tmp_path / "meta")).first().json


def test_detection_table(spark):
    made = [builders.docx("x"), builders.ods([[1]]), b"a,b\n1,2\n", b"PK\3\4broken", builders.pdf("x")]
    rows = detect.detect(table(spark, *made)).orderBy("file_id").collect()
    assert [(r.file_types, r.mimetype) for r in rows][2:4] == [(["txt", "csv"], "text/csv"), ([], None)]
    assert [r.file_type for r in rows] == ["docx", "ods", "csv", "unknown", "pdf"] and rows[3].error
    caps = detect.file_capabilities(detect.detect(table(spark, *made))).where("file_id = 0").first().capabilities
    assert caps.edit and caps.save and not caps.decrypt
    same = table(spark, *made).select("file_id", detect.magic_type(F.col("content")).alias("m")).orderBy("file_id").collect()
    assert [r.m for r in same] == ["zip", "zip", "unknown", "zip", "pdf"]
    assert [r.m for r in table(spark, *made).select("file_id", detect.detect_mimetype(F.col("content")).alias("m")).orderBy("file_id").collect()][4] == "application/pdf"


def test_csv_values(spark):
    made = b"n,t,m,e\n1,a,5,\n 2 ,b,x,\n,c,,\n007,d,1,\n"
    ok = b"n,t\n1,a\n-2.5e3,b\n,c\n"
    rows = csvdoc.csv_cells(table(spark, made, ok)).collect()
    kinds = {(r.file_id, r.row_ix, r.col_ix): r.value_type for r in rows}
    assert kinds[0, 1, 0] == "string" and kinds[0, 1, 2] == "string"
    assert (kinds[1, 0, 0], kinds[1, 1, 0], kinds[1, 2, 0], kinds[1, 3, 0], kinds[1, 1, 1]) == ("string", "float", "float", "string", "string")
    assert {r.num for r in rows if r.file_id == 1 and r.value_type == "float"} == {1.0, -2500.0}


def test_native_expressions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert [get(text.count_hits(F.lit("Élan elan ELAN straße"), n)) for n in ("elan", "é", "", "ss", "ß")] == [3, 4, 0, 0, 1]
    assert get(text.escape_text(F.lit(" a  b\t<"))) == "&nbsp;a &nbsp;b&emsp;&lt;"
    assert get(text.token_runs(F.lit("a b  c\t\td "))) == ["a b", "  ", "c", "\t\t", "d "]
    assert [get(text.print_number(F.lit(v))) for v in (1.5, 100.0, 0.1 + 0.2, 1234567.89, 1e-9)] == ["1.5", "100", "0.3", "1234568", "0"]
    assert get(text.to_pixels(F.lit(1.0), F.lit("in"))) == 96.0 and get(text.to_pixels(F.lit(1.0), F.lit("em"))) is None
    assert [get(sheets.to_number(F.lit(t))) for t in ("1,234.56", "1.234,56", "12", "x", "$ 5")] == [1234.56, 1234.56, 12.0, None, 5.0]
    assert [get(sheets.is_number(F.lit(t))) for t in ("0", "-42", "1.5E-3", "  42  ", ".", "1.", "1e", "42abc", "", "007", "1,234")] == [True] * 4 + [False] * 7
    assert get(sheets.parse_ref(F.lit("AA11"))) == (26, 10) and get(sheets.parse_ref(F.lit("a1"))) is None
    assert get(numbering.roman(F.lit(1994))) == "MCMXCIV"
    assert get(text.declared_encoding(F.lit(b'<?xml version="1.0" encoding="x"?>'))) == "x"
    m = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, "abcdef")])
    assert tuple(get(text.affine(m(1, 0, 0, 1, 2, 3), m(2, 0, 0, 2, 0, 0)))) == (2, 0, 0, 2, 4, 6)
    assert dims.file_types(spark).count() == 51 and dims.encodings(spark).count() == 40


def test_sheet_order(spark):
    rows = spark.createDataFrame([(0, "10", "float"), (1, "b2", "string"), (2, "", "string"), (3, "9", "float"), (4, "b10", "string"), (5, "7", "string")], "i int, t string, k string")
    order = lambda d: [r.i for r in sheets.sort_sheet(rows, "t", "k", "i", d).collect()]
    assert order(1) == [3, 0, 5, 1, 4, 2] and order(-1) == [4, 1, 5, 0, 3, 2] and order(0) == [0, 1, 2, 3, 4, 5]


def test_tree_navigation(spark):
    rows = decode.elements(table(spark, odt("<text:p>a</text:p><text:p><text:span/></text:p><text:p>c<text:line-break/></text:p>")))
    assert tree.at_path(rows, "/child:0/child:0").first().text == "a"
    assert [r.element_type for r in tree.descendants(rows, "/child:2").orderBy("element_id").collect()] == ["text", "line_break"]
    links = {r.path: r for r in tree.with_siblings(rows).collect()}
    assert links["/child:1"].previous_sibling == links["/child:0"].element_id and links[""].first_child == 1 and links["/child:2"].next_sibling is None
    seen = {r.element_id for r in tree.visible(rows).collect()}
    assert links["/child:1/child:0"].element_id not in seen and links["/child:0/child:0"].element_id in seen
    kids = tree.children_of(rows, rows.where("path = ''").select("file_id", "element_id"))
    assert kids.count() == 3 and tree.parent_of(rows, kids).count() == 1


def test_fonts(spark):
    row = fonts.fonts(table(spark, builders.sfnt(), b"no")).orderBy("file_id").collect()
    assert (row[0].name, row[0].n_glyphs, row[0].units_per_em, row[0].ascender, row[0].bbox) == ("Ab", 3, 2048, 800, [0, -10, 100, 200]) and row[1].error
    assert [(r.width, r.code_point) for r in fonts.glyphs(table(spark, builders.sfnt())).orderBy("glyph").collect()] == [(500, None), (600, 65), (600, 66)]


def test_metafile():
    box = lambda body: struct.pack("<HI", 1, len(body)) + body
    action = lambda kind, body: struct.pack("<H", kind) + box(body)
    head = box(struct.pack("<I", 0) + box(b"\0" * 4) + struct.pack("<ii", 100, 50) + struct.pack("<I", 3))
    actions = action(133, struct.pack("<I?", 0xFF0000, True)) + action(103, struct.pack("<iiii", 1, 2, 11, 22)) + action(112, struct.pack("<ii", 5, 6) + struct.pack("<H", 2) + b"a<" + struct.pack("<HH", 0, 2))
    out = svm.to_svg(b"VCLMTF" + head + actions)
    assert '<rect x="1" y="2" width="10" height="20" stroke="#000000" fill="#ff0000"/>' in out and "a&lt;</text>" in out and 'viewBox="0 0 100 50"' in out


def test_stream_and_data_source(spark, tmp_path):
    from paperloom.sources import datasource
    from paperloom.streaming.files import decode_stream, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "in" / "b.xlsx").write_bytes(builders.xlsx([["x", 3]]))
    query = decode_stream(watch(spark, str(tmp_path / "in")), decode.cells, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    datasource.register(spark)
    cells = spark.read.format("docs").option("table", "cells").load(str(tmp_path / "in"))
    assert cells.count() == 6 and cells.where(F.col("file_path") == str(tmp_path / "in" / "a.csv")).count() == 4


def test_sql_functions(spark):
    from paperloom.functions import registry

    registry.register(spark)
    assert spark.sql("SELECT list_number(4, 'roman_lower') AS r").first().r == "iv"
    assert [r.text for r in spark.sql("SELECT * FROM csv_records('a;\"b;c\"', ';')").collect()] == ["a", "b;c"]
    assert spark.sql("SELECT detect_file_types(cast('a,b\n1,2' AS binary)) AS t").first().t == ["txt", "csv"]


def test_workbook_looks(spark):
    source = zipfile.ZipFile(io.BytesIO(builders.xlsx([["a"]])))
    styles = f'<styleSheet {builders._S}><fonts><font/><font><b/><sz val="14"/><color rgb="FFFF0000"/></font></fonts><fills><fill/><fill><patternFill patternType="solid"><fgColor rgb="FF00FF00"/></patternFill></fill></fills><borders><border><left style="thin"/></border></borders><cellXfs><xf/><xf fontId="1" fillId="1"><alignment horizontal="center"/></xf></cellXfs></styleSheet>'
    parts = [(n, source.read(n).replace(b'r="A1"', b'r="A1" s="1"'), 6) for n in source.namelist()] + [("xl/styles.xml", styles.encode(), 6)]
    made = containers.write_zip(parts)
    look = decode.elements(table(spark, made)).where("element_type = 'sheet_cell'").first().attrs
    assert (look["font_weight"], look["font_size"], look["font_color"], look["fo:background-color"], look["fo:text-align"]) == ("bold", "14pt", "#ff0000", "#00ff00", "center")
    assert "font-weight:bold" in html.views_of(made)[1][2] and decode.styles(table(spark, made)).count() == 2


def test_paragraph_cascade(spark):
    styles = f'<w:styles {builders._W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:styleId="A"><w:pPr><w:jc w:val="both"/><w:spacing w:before="1440"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:b/></w:rPr></w:style></w:styles>'
    made = containers.write_zip([("word/document.xml", f'<w:document {builders._W}><w:body><w:p/></w:body></w:document>'.encode(), 6), ("word/styles.xml", styles.encode(), 6)])
    rows = {r.style_name: r.resolved for r in decode.styles(table(spark, made)).collect()}
    assert rows["B"] == {"font_size": "10pt", "fo:text-align": "justify", "fo:margin-top": "1in", "font_weight": "bold"}


def test_cff_and_type1(spark):
    rows = fonts.fonts(table(spark, builders.cff(), builders.type1())).orderBy("file_id").collect()
    assert [(r.format, r.name, r.n_glyphs) for r in rows] == [("cff", "Mini", 2), ("type1", "Tiny", 1)]
    font = fonts.Cff(builders.cff())
    assert [font.width(0), font.width(1)] == [500, 650] and fonts.Type1(builders.type1()).widths == {"A": 100}
