import io
import random
import struct
import zipfile
import zlib

import pandas as pd
import pytest
from plain_csv import plain_csv
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as X
from paperloom.operators import glyphs, grid, jobs, layout, numbering, ocr
from paperloom.plans import convert, routes
from paperloom.sinks import files as sinks
from paperloom.sinks import pdf
from paperloom.sources import containers, csv, decode, fixed_layout, images, ocr_tsv

# ---------------------------------------------------------------- geometry


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_boxes(spark):
    lit = [F.lit(float(v)) for v in (0, 0, 10, 10, 5, 5, 10, 10)]
    assert one(spark, G.intersection_area(*lit)) == 25.0
    assert one(spark, G.contains(*lit[:4], F.lit(10.1), F.lit(5.0), 0.2)) is True
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 10.0, 10.0)], "x double, y double, width double, height double")
    assert tuple(df.agg(*G.bounds(*[F.col(c) for c in df.columns])).first()) == (0.0, 0.0, 15.0, 15.0)
    with pytest.raises(Exception, match="invalid box"):
        one(spark, G.checked_box(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(1.0)))


def test_angles_and_curves(spark):
    assert one(spark, G.normal_degrees(F.lit(-90.0))) == 270.0
    m = one(spark, G.rotation_matrix(F.lit(90.0)))
    assert abs(m["a"]) < 1e-12 and m["b"] == 1.0 and m["c"] == -1.0
    pts = one(spark, G.flattened([F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)], 12))
    assert len(pts) == 13 and pts[0] == 0 and pts[-1] == pytest.approx(3)


# ---------------------------------------------------------------- tables

BASE = [(0, 0, 100, 0), (0, 20, 100, 20), (0, 40, 100, 40), (0, 0, 0, 40), (100, 0, 100, 40)]


def segments(spark, rows, page=1):
    return spark.createDataFrame([(1, page, i, *map(float, r)) for i, r in enumerate(rows)], "doc_id long, page_no int, seq int, x1 double, y1 double, x2 double, y2 double")


@pytest.mark.parametrize(
    ("rows", "cells"),
    [
        (BASE + [(50, 0, 50, 40)], {(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1)}),
        (BASE + [(50, 20, 50, 40)], {(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)}),
        ([(0, 0, 49.8, 0), (50.2, 0, 100, 0)] + BASE[1:] + [(50, 0, 50, 40)], {(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1)}),
        ([BASE[0], (50, 20, 100, 20), *BASE[2:], (50, 0, 50, 40)], {(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)}),
    ],
)
def test_grids(spark, rows, cells):
    got = grid.recognised_cells(segments(spark, rows)).collect()
    assert {(r["row"], r["col"], r["row_span"], r["col_span"]) for r in got} == cells
    assert {r["confidence"] for r in got} == {1.0}


def test_open_sides_and_odd_areas(spark):
    part = grid.recognised_cells(segments(spark, BASE[:4] + [(50, 0, 50, 40), (100, 0, 100, 15)])).collect()
    assert {round(r["confidence"], 6) for r in part} == {0.9125}
    lshape = BASE[:1] + BASE[2:] + [(50, 20, 50, 40), (50, 20, 100, 20)]
    assert grid.recognised_cells(segments(spark, lshape)).count() == 0
    values = spark.createDataFrame([(1, v) for v in (0.6, 5.0, 0.2, 0.0, 0.4)], "k int, v double")
    assert [r["axis"] for r in grid.axis_clusters(values, ["k"], "v").orderBy("cluster_no").collect()] == pytest.approx([0.1, 0.5, 5.0])


def test_rulings_join_by_the_mean_of_two_axes(spark):
    rows = [(0, 10.0, 30, 10.0), (30.5, 10.2, 60, 10.2), (60, 10.3, 90, 10.3), (0, 10.6, 90, 10.6), (0, 0, 50, 9), (5, 0, 5.2, 40), (5.1, 40.7, 5.1, 80)]
    got = sorted((r["flat"], round(r["axis"], 4), r["begin"], r["until"], r["seq"]) for r in grid.rulings(segments(spark, rows)).collect())
    assert got == [(False, 5.1, 0.0, 40.0, 5), (False, 5.1, 40.7, 80.0, 6), (True, 10.2, 0.0, 90.0, 0), (True, 10.6, 0.0, 90.0, 3)]


def test_several_tables_and_pages(spark):
    low = [(x1 + 200, y1 + 5, x2 + 200, y2 + 5) for x1, y1, x2, y2 in BASE]
    both = segments(spark, low + BASE).union(segments(spark, BASE, 2)).union(segments(spark, BASE[:2], 3))
    got = {(r["page_no"], r["table_no"], r["x"], r["y"]) for r in grid.recognised_cells(both).collect()}
    assert got == {(1, 1, 0.0, 0.0), (1, 1, 0.0, 20.0), (1, 2, 200.0, 5.0), (1, 2, 200.0, 25.0), (2, 1, 0.0, 0.0), (2, 1, 0.0, 20.0)}


def test_areas():
    assert grid.areas(1, 1, [True], [True]) == ([(0, 0, 1, 1)], True)
    assert grid.areas(2, 2, [False, True, False, True], [False] * 4) == ([(0, 0, 2, 2)], True)
    assert grid.areas(2, 2, [True, True, False, True], [False, True, True, True]) == ([(0, 0, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1), (0, 1, 1, 1)], False)


def test_recognised_text_that_a_page_has_already(spark):
    cols = "doc_id int, page_no int, x double, y double, width double, height double, text string"
    native = spark.createDataFrame([(1, 1, 10.0, 10.0, 200.0, 8.0, "Net sum 5"), (1, 2, 0.0, 0.0, 5.0, 5.0, "q")], cols)
    found = spark.createDataFrame([(1, 1, 500.0, 500.0, 9.0, 9.0, "Netsum\t5"), (1, 1, 60.0, 11.0, 20.0, 7.0, "a"), (1, 1, 205.0, 10.0, 20.0, 8.0, "b"), (1, 2, 10.0, 10.0, 200.0, 8.0, "Net sum 5"), (2, 1, 10.0, 10.0, 200.0, 8.0, "c")], cols)
    assert sorted((r["doc_id"], r["page_no"], r["text"]) for r in ocr.without_duplicates(found, native).collect()) == [(1, 1, "b"), (1, 2, "Net sum 5"), (2, 1, "c")]


def test_cell_text_and_rows(spark):
    cells = grid.recognised_cells(segments(spark, BASE + [(50, 0, 50, 40)]))
    blocks = spark.createDataFrame([(1, 1, 0, 5.0, 5.0, 15.0, 5.0, "姓名", 9.0), (1, 1, 1, 60.0, 25.0, 15.0, 5.0, " b", 29.0), (1, 1, 2, 52.0, 25.3, 5.0, 5.0, "a", 29.3)], "doc_id long, page_no int, seq int, x double, y double, width double, height double, text string, baseline double")
    lines = grid.table_rows(grid.cell_texts(blocks, cells)).orderBy("row").collect()
    assert [r["line"] for r in lines] == ["姓名", "\ta b"]


def test_votes_and_components(spark):
    cells = spark.createDataFrame([(1, 0, 1, True, a) for a in ("CENTER", "LEFT", "LEFT", "CENTER", "RIGHT")] + [(1, 1, 2, True, "LEFT"), (1, 1, 1, False, "RIGHT")], "t int, col int, col_span int, filled boolean, alignment string")
    assert [tuple(r) for r in grid.column_alignment(cells, ["t"]).collect()] == [(1, 0, "CENTER")]
    r = spark.createDataFrame([(1, 1, i, h, float(a), float(b), float(e)) for i, (h, a, b, e) in enumerate([(True, 0, 0, 10), (True, 10, 0, 10), (False, 0, 0, 10), (False, 10, 0, 10), (True, 50, 0, 10)])], "doc_id int, page_no int, seq int, flat boolean, axis double, begin double, until double")
    got = grid.components(r, grid.touching_pairs(r)).collect()
    assert sorted((x["seq"], x["component"]) for x in got) == [(0, 0), (1, 0), (2, 0), (3, 0)]


# ---------------------------------------------------------------- reading order


def helper_blocks(spark, rows, page=1):
    return spark.createDataFrame([(1, page, i, float(x), b - 4.0, 20.0, 5.0, t, float(b)) for i, (x, b, t) in enumerate(rows)], "doc_id int, page_no int, seq int, x double, y double, width double, height double, text string, baseline double")


def read(blocks):
    units = layout.segment_units(layout.column_segments(layout.visual_lines(blocks)))
    return layout.document_text(layout.page_texts(layout.reading_order(units))).first()["text"]


def test_reading_order(spark):
    assert read(helper_blocks(spark, [(12, 14, "heading"), (12, 31, "name:"), (38, 31, "value")])) == "heading\nname:value\n"
    columns = [(140, 61, "r2"), (22, 44, "l1"), (140, 44, "r1"), (22, 61, "l2"), (140, 78, "r3")]
    assert read(helper_blocks(spark, columns)) == "l1\nl2\nr1\nr2\nr3\n"
    two = helper_blocks(spark, [(30, 25, "first")]).union(helper_blocks(spark, [(30, 25, "second")], 2))
    assert read(two) == "first\n\n\f\nsecond\n"


def test_lines_are_anchored_on_their_first_block(spark):
    b = helper_blocks(spark, [(10, 10.0, "a"), (40, 11.0, "b"), (70, 12.0, "c")])
    assert [r["line_no"] for r in layout.visual_lines(b).orderBy("seq").collect()] == [1, 1, 2]
    assert [r["line_no"] for r in layout.paragraph_lines(b).orderBy("seq").collect()] == [1, 1, 2]


def test_paragraphs_of_words(spark):
    rows = [(70.0, 40.0, 30.0, "Annual ", 44.0), (99.0, 40.0, 40.0, "report", 44.0), (18.0, 60.0, 8.0, "A)", 64.0), (25.5, 60.0, 90.0, "scope", 64.0), (18.0, 75.0, 70.0, "method", 79.0)]
    b = spark.createDataFrame([(1, 1, i, x, y, w, 5.5, t, base) for i, (x, y, w, t, base) in enumerate(rows)], "doc_id int, page_no int, seq int, x double, y double, width double, height double, text string, baseline double")
    got = layout.paragraphs(layout.paragraph_lines(b), 0.0, 209.0).orderBy("y").collect()
    assert [r["text"] for r in got] == ["Annual report", "A)scope", "method"]
    assert [r["alignment"] for r in got[:2]] == ["CENTER", "LEFT"]


# ---------------------------------------------------------------- decoding and CSV


def test_decoding(spark):
    cases = [b"\xef\xbb\xbf" + "第一页\r\n第二行\f末页".encode(), b"\xff\xfe" + "中文 UTF16".encode("utf-16-le"), "简体中文编码".encode("gb18030"), b"\0" * 20, "一\f二\f三".encode(), None, b"\xff\xff\xff", b""]
    files = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cases)], "file_id int, content binary")
    got = {r["file_id"]: r for r in decode.decoded(files, max_pages=2).collect()}
    assert (got[0]["charset"], got[0]["text"]) == ("UTF-8", "第一页\n第二行\f末页")
    assert (got[1]["charset"], got[1]["text"]) == ("UTF-16LE", "中文 UTF16")
    assert (got[2]["charset"], got[2]["warning"], got[2]["text"]) == ("GB18030", "TEXT_ENCODING_GUESSED", "简体中文编码")
    assert [got[i]["error_code"] for i in (3, 4, 6)] == ["TEXT_BINARY_CONTENT", "PAGE_LIMIT_EXCEEDED", "TEXT_ENCODING_UNSUPPORTED"]
    assert got[5]["text"] is None and got[7]["text"] == ""


CSV_CASES = ["a,b\nc,d\n", '姓名,分数\r张三,98\n"李,四",88\r\n王五,77\r', "\n", "a,", '"x" ,y', '"a""b"\n\nq', "", 'a,b\n"open,b', 'a,b\ninvalid"quote,b', '"x"y', '""', '"""', '""""', '" ""\n,"" "\t,', ' "a"', '"a" "b"', "\x1a1,\x1a\n", '"\x1a\n\x1a0,"', "\x1a" * 3 + '",\n"']


def test_csv_rules_equal_the_plain_parser(spark):
    assert plain_csv(CSV_CASES[1]) == [["姓名", "分数"], ["张三", "98"], ["李,四", "88"], ["王五", "77"]]
    rng = random.Random(4)
    texts = CSV_CASES + ["".join(rng.choices('ab"",\t \n\r;|\x1a', k=rng.randrange(14))) for _ in range(1500)]
    # long cells with many quotes, and a long quoted one
    texts += ['"' + '""x' * 30_000 + '",1', '"' + "y\n" * 16_000 + '"', "z" * 32_767, "z" * 32_768, "😀" * 16_384]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")
    for d in (",", "\t", "|"):
        got = {}
        for r in csv.csv_rows(files, "file_id", d).orderBy("file_id", "row_no").collect():
            got.setdefault(r["file_id"], []).append(r["cells"] if r["error_code"] is None else "error")
        for i, text in enumerate(texts):
            try:
                want = plain_csv(text, d)
            except ValueError:
                want = ["error"]
            assert got.get(i, []) == want, (d, text[:50])


def test_csv_limits_and_detection(spark):
    with pytest.raises(ValueError, match="row limit"):
        plain_csv("a,b\nc,d\n", limits=csv.Limits(rows=1))
    files = spark.createDataFrame([(1, "名称;日期;公式\r\n甲;2026-08-09;=2+3\r\n"), (2, 'a,b\n"open'), (3, None), (4, "")], "file_id int, text string")
    got = csv.csv_rows(files, "file_id").orderBy("file_id", "row_no").collect()
    assert [r["cells"] for r in got] == [["名称", "日期", "公式"], ["甲", "2026-08-09", "=2+3"], None]
    assert got[2]["error_code"].startswith("CONVERSION_FAILED")


# ---------------------------------------------------------------- files in and out


def file_df(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_id int, content binary")


def test_csv_workbook_round_trip(spark):
    text = "序号,名称,值\n" + "".join(f"{i},项目{i},{3 * i}\n" for i in range(1, 2001)) + '=2+3,"李,四",\n'
    book = convert.convert(file_df(spark, text.encode()), "csv", "xlsx")
    rows = containers.xlsx_rows(book, "file_id").orderBy("row_no").collect()
    assert len(rows) == 2002 and rows[2000]["cells"][1] == "项目2000" and rows[2001]["cells"] == ["=2+3", "李,四", ""]
    back = convert.convert(book, "xlsx", "csv").first()["content"]
    assert bytes(back).decode() == text.replace("\n", "\r\n")


def test_several_sheets_become_an_archive(spark):
    book = sinks.workbook([("产品/数量", [["产品", "数量"]], [], {}, {}), ("B", [["A,款", "12"]], ["A1:B1"], {0: 20.0}, {0: 9.0})])
    out = bytes(convert.convert(file_df(spark, book), "xlsx", "csv").first()["content"])
    box = zipfile.ZipFile(io.BytesIO(out))
    assert box.namelist() == ["01-产品_数量.csv", "02-B.csv"] and box.read("02-B.csv").decode() == '"A,款",12\r\n'


def test_text_document_round_trip(spark):
    book = convert.convert(file_df(spark, "第一行\r\n\n第二行\f末页".encode()), "txt", "docx")
    assert convert.convert(book, "docx", "txt").first()["text"] == "第一行\n第二行\n末页\n"


def test_stories_in_order(spark):
    w = f'xmlns:w="{sinks.WORD_NS}"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    parts = {
        "word/header1.xml": f"<w:hdr {w}>{p('head')}</w:hdr>",
        "word/document.xml": f"<w:document {w}><w:body>{p('body')}<w:tbl><w:tr><w:tc>{p('l')}</w:tc><w:tc>{p('r')}</w:tc></w:tr></w:tbl><w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p></w:body></w:document>",
        "word/footnotes.xml": f'<w:footnotes {w}><w:footnote w:id="0">{p("no")}</w:footnote><w:footnote w:id="1">{p("note")}</w:footnote></w:footnotes>',
        "word/comments.xml": f'<w:comments {w}><w:comment w:id="0">{p("why")}</w:comment></w:comments>',
    }
    text = convert.convert(file_df(spark, sinks.archive([(k, v.encode()) for k, v in parts.items()])), "docx", "txt").first()["text"]
    assert text == "[页眉] head\nbody\nl\tr\nnewold\n[修订-插入] new\n[修订-删除] old\n[脚注] note\n[批注] why\n"


def test_unsafe_packages(spark):
    bad = [b"not a zip", sinks.archive([("../x", b"")]), sinks.archive([("word/document.xml", b'<!DOCTYPE x><a/>')]), sinks.archive([("other.xml", b"<a/>")]), sinks.archive([("big.bin", b"0" * 500_000)])]
    codes = [r["error_code"] for r in convert.errors(file_df(spark, *bad), "docx").orderBy("file_id").collect()]
    assert codes == ["INVALID_ARCHIVE", "UNSAFE_PATH", "UNSAFE_XML", "MISSING_PART", "EXPANSION_LIMIT"]


def package(page):
    ns = 'xmlns:ofd="http://www.ofdspec.org/2016"'
    return sinks.archive([(n, x.encode()) for n, x in (("OFD.xml", f"<ofd:OFD {ns}><ofd:DocBody><ofd:DocRoot>Doc_0/Document.xml</ofd:DocRoot></ofd:DocBody></ofd:OFD>"), ("Doc_0/Document.xml", f'<ofd:Document {ns}><ofd:CommonData><ofd:PageArea><ofd:PhysicalBox>0 0 100 60</ofd:PhysicalBox></ofd:PageArea></ofd:CommonData><ofd:Pages><ofd:Page ID="1" BaseLoc="Pages/P0.xml"/></ofd:Pages></ofd:Document>'), ("Doc_0/Pages/P0.xml", f"<ofd:Page {ns}><ofd:Content><ofd:Layer>{page}</ofd:Layer></ofd:Content></ofd:Page>"))])


def test_fixed_layout_to_text_and_workbook(spark):
    path = lambda d: f'<ofd:PathObject Boundary="0 0 100 60"><ofd:AbbreviatedData>{d}</ofd:AbbreviatedData></ofd:PathObject>'
    rules = "".join(path(f"M 10 {y} L 90 {y}") for y in (10, 20, 30)) + "".join(path(f"M {x} 10 L {x} 30") for x in (10, 50, 90))
    text = lambda x, y, t: f'<ofd:TextObject Boundary="{x} {y - 4} 20 5" Size="3.5"><ofd:TextCode X="0" Y="4">{t}</ofd:TextCode></ofd:TextObject>'
    words = text(15, 17, "甲") + text(55, 17, "乙") + text(15, 27, "丙") + text(55, 27, "丁")
    files = file_df(spark, package(rules + words), b"broken")
    assert convert.convert(files, "ofd", "txt").first()["text"] == "甲\t乙\n丙\t丁\n"
    book = convert.convert(files, "ofd", "xlsx").select("file_id", "content")
    assert [r["cells"] for r in containers.xlsx_rows(book, "file_id").orderBy("row_no").collect()] == [["甲", "乙"], ["丙", "丁"]]
    assert [tuple(r) for r in convert.errors(files, "ofd").collect()] == [(1, "INVALID_ARCHIVE")]
    assert convert.convert(convert.convert(files, "ofd", "docx"), "docx", "txt").first()["text"].splitlines() == ["甲\t乙", "丙\t丁"]


def test_deltas_and_paths():
    assert fixed_layout.expand_deltas("1 g 3 2.5 4", 7) == [1, 2.5, 2.5, 2.5, 4, 4, 4]
    assert fixed_layout.expand_deltas(None, 3) == [] and fixed_layout.expand_deltas("1 2 3", 2) == [1, 2]
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    assert len(fixed_layout.path_segments("M 0 0 Q 5 5 10 0 B 10 5 15 5 20 0 C", (0, 0, 1, 1), unit)) == 8 + 12 + 1
    assert fixed_layout.thin_box_line((0, 0, 40, 1)) == (0, 0.5, 40, 0.5) and fixed_layout.thin_box_line((0, 0, 4, 4)) is None


def test_image_metadata(spark):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 20, 8, 2, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", 11811, 11811, 1))
    jfif = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\1" + struct.pack(">HH", 150, 150) + b"\0\0"
    exif = b"Exif\0\0MM\0*" + struct.pack(">I", 8) + struct.pack(">HHHIHH", 1, 0x112, 3, 1, 6, 0)
    jpeg = jfif + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 20, 30, 1) + b"\0\0\0"
    got = [tuple(r)[1:] for r in images.image_metadata(file_df(spark, png, jpeg, b"junk"), "file_id").orderBy("file_id").collect()]
    assert got[0][:2] == (30, 20) and got[0][2] == pytest.approx(300, abs=0.1)
    assert got[1] == (30, 20, 150.0, 6) and got[2] == (None, None, 96.0, 1)


def test_images_become_pages(spark):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    rows = zlib.compress(b"".join(b"\0" + bytes([i % 256] * 300) for i in range(100)))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 100, 100, 8, 2, 0, 0, 0)) + chunk(b"IDAT", rows)
    alpha = png.replace(struct.pack(">IIBBBBB", 100, 100, 8, 2, 0, 0, 0), struct.pack(">IIBBBBB", 100, 100, 8, 6, 0, 0, 0))
    tiny = png.replace(struct.pack(">IIB", 100, 100, 8), struct.pack(">IIB", 2, 100, 8))
    files = file_df(spark, png, alpha, tiny, b"junk")
    out = convert.convert(files, "png", "pdf").collect()
    assert [r["file_id"] for r in out] == [0] and b"/MediaBox [0 0 75.0000 75.0000]" in bytes(out[0]["content"])
    assert bytes(out[0]["content"]).endswith(b"%%EOF\n")
    assert [r["error_code"] for r in convert.errors(files, "png").orderBy("file_id").collect()] == ["IMAGE_KIND_UNSUPPORTED", "PAGE_SIZE_UNSUPPORTED", "IMAGE_INVALID"]


def test_image_placement_agrees_with_pixel_orientation(spark):
    for o in range(1, 9):
        a, b, c_, d, e, f = pdf.placement(1, 1, o)
        p = one(spark, ocr.oriented(F.lit(0), F.lit(0), F.lit(2), F.lit(2), F.lit(o)))
        u, v = 0.25, 0.75  # the centre of the stored top left pixel
        assert (a * u + c_ * v + e, b * u + d * v + f) == pytest.approx((0.25 + p["x"] / 2, 0.75 - p["y"] / 2))


def test_glyph_runs(spark):
    rows = [(1, 1, i, ch, float(i), 0.0, 1.0, 2.0, fam, size, False, False, 0.0, "000000") for i, (ch, fam, size) in enumerate([("a", "F", 10.0), ("b", "F", 10.05), ("c", "F", 10.14), ("d", "G", 10.14)])]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, seq int, ch string, x double, y double, width double, height double, family string, size_pt double, bold boolean, italic boolean, direction double, color string")
    assert [(r["text"], r["width"]) for r in glyphs.glyph_runs(df).orderBy("run_no").collect()] == [("abc", 3.0), ("d", 1.0)]
    assert one(spark, glyphs.page_error("TEXT_EXTRACTION", F.lit(False), F.lit(0), F.lit(True))) == "OCR_REQUIRED"
    assert tuple(one(spark, glyphs.page_size(F.lit(72.0), F.lit(144.0), F.lit(1.0), F.lit(90.0)))) == pytest.approx((50.8, 25.4))


# ---------------------------------------------------------------- OCR, names, jobs


def test_ocr_words(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    rows = ["5\t1\t1\t1\t1\t1\t10\t10\t20\t10\t88\t中文，OCR", "5\t1\t1\t1\t1\t2\t40\t12\t20\t10\t92\t2026！", "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t", "5\t1\t1\t1\t2\t1\t10\t30\t0\t10\t90\tx", "5\t1\t1\t1\t2\t1\t10\t30\t5\t10\t-1\ty", "bad"]
    words = ocr_tsv.ocr_words(spark.createDataFrame([(1, "\n".join([head, *rows]))], "f int, tsv string"), "f")
    line = ocr_tsv.lines(words, ["f"]).collect()
    assert [(r["text"], r["left"], r["top"], r["width"], r["height"]) for r in line] == [("中文，OCR 2026！", 10, 10, 50, 12)]
    assert ocr_tsv.confidence(words, ["f"]).first()["confidence"] == pytest.approx(0.9)
    assert one(spark, ocr_tsv.verdict(F.lit(0.2), F.lit(1), 0.6)) == "OCR_LOW_CONFIDENCE"
    assert one(spark, ocr_tsv.verdict(F.lit(0.88), F.lit(3), 0.2, 0.9)) == "OCR_APPLIED,OCR_LOW_CONFIDENCE"
    assert tuple(one(spark, ocr.oriented(F.lit(1), F.lit(2), F.lit(10), F.lit(20), F.lit(6)))) == (17, 1)


def test_names_and_messages(spark):
    assert one(spark, X.clean_message(F.lit("读取 /Users/alice/private/source.pdf 和 C:\\Users\\alice\\secret.docx 失败\n下一行"))) == "读取 <path> 和 <path> 失败 下一行"
    assert len(one(spark, X.clean_message(F.lit("x" * 2000)))) == 1003
    name = lambda n: one(spark, X.display_name(F.lit(n), F.lit(0), F.lit("ofd")))
    assert name("..\\evil.txt") == "evil.txt" and name("folder/good.txt") == "good.txt" and name("a/..") == "document-1.ofd" and name("x:y?.txt") == "x_y_.txt"
    assert one(spark, X.nonblank_chars(F.lit("a\u3000b \tc"))) == 3
    assert one(spark, X.redact(F.lit("run --key=secret99  done"), ["secret99", "go"])) == "run --key=<argument> done"


def test_jobs(spark):
    files = spark.createDataFrame([(1, 0, 4, True, "a.docx", None, None), (1, 1, 4, True, "a.docx", None, None), (1, 2, 4, True, "a-2.docx", None, None), (2, 0, 4, False, None, "E1", "m"), (2, 1, 4, False, None, "E2", None)], "task_id int, idx int, size int, success boolean, output_name string, error_code string, error_message string").withColumn("target", F.lit("docx")).withColumn("file_name", F.concat(F.lit("f"), "idx"))
    assert [r["entry_name"] for r in jobs.archive_names(files).orderBy("idx").collect()] == ["a.docx", "a-2.docx", "a-2-2.docx"]
    got = {r["task_id"]: (r["status"], r["package"], r["error_code"]) for r in jobs.outcomes(files).collect()}
    assert got == {1: ("SUCCESS", "zip", None), 2: ("FAILED", None, "E1")}
    assert jobs.failure_report(files).first()["report"] == "f0\tE1\tm\nf1\tE2\t"
    assert not jobs.quotas(files.where("task_id = 2"), jobs.TaskLimits(upload_bytes=7)).first()["accepted"]
    assert one(spark, jobs.artifact_error(F.lit(True), F.lit(6), jobs.TaskLimits(output_bytes=5))) == "TASK_OUTPUT_LIMIT_EXCEEDED"
    assert one(spark, jobs.utf16_length(F.lit("a🙂"))) == 3
    with pytest.raises(ValueError, match="limits"):
        jobs.ParseLimits(entry_bytes=1 << 40)
    assert routes.duplicates(routes.registered(spark)).count() == 0
    with pytest.raises(KeyError):
        convert.convert(files, "pdf", "txt")


def test_numbering_repair(spark):
    rows = [(1, 1, 7, 0, "<a> <b>", False), (1, 2, 9, 0, "<a><b>", True), (1, 3, 7, 0, "<a><b>", False), (1, 4, 7, 0, "<a><b>", False), (1, 5, 7, 1, "<a><b>", False), (1, 6, None, 0, "", False)]
    df = spark.createDataFrame(rows, "doc_id int, seq int, num_id int, level int, signature string, restart boolean")
    assert [r["fixed_num_id"] for r in numbering.repaired_lists(df).orderBy("seq").collect()] == [7, 9, 9, 9, 7, None]


def test_streaming_tasks(spark, tmp_path):
    from paperloom.streaming import tasks

    rows = spark.createDataFrame([(1, "WAITING", "2026-01-01 10:00:00"), (1, "SUCCESS", "2026-01-01 10:05:00"), (2, "FAILED", "2026-01-01 10:07:00")], "task_id int, status string, at string").withColumn("at", F.to_timestamp("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = tasks.latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest_tasks").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["task_id"], r["status"]) for r in spark.table("latest_tasks").collect()} == {(1, "SUCCESS"), (2, "FAILED")}


def test_rows_heights_and_spacing(spark):
    t = spark.createDataFrame([(1, 1, 1, [0.0, 50.0, 100.0], [0.0, 20.0, 45.0]), (1, 1, 2, [0.0], [0.0, 5.0])], "doc_id int, page_no int, table_no int, xs array<double>, ys array<double>")
    cells = spark.createDataFrame([(1, 1, 1, 0, 1), (1, 1, 1, 0, 0)], "doc_id int, page_no int, table_no int, row int, col int")
    got = [(r["row"], r["y"], r["width"], r["height"], r["cols"]) for r in grid.physical_rows(t, cells).orderBy("row").collect()]
    assert got == [(0, 0.0, 100.0, 20.0, [0, 1]), (1, 20.0, 100.0, 25.0, [])]
    lined = helper_blocks(spark, [(10, 10, "a"), (40, 10, "b")]).withColumn("line_no", F.lit(1)).withColumn("size_pt", F.lit(72.0))
    assert layout.line_heights(lined).first()["line_height"] == pytest.approx(25.4)
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, layout.char_spacing(arr(2, 2), arr(1, 1, 1), F.lit(1.0), F.lit(4.0))) == 1.0
    assert one(spark, layout.char_spacing(arr(1.01, 1.01), arr(1, 1), F.lit(1.0), F.lit(4.0))) == 0.0
    assert one(spark, layout.char_spacing(arr(-9, -9), arr(1, 1), F.lit(1.0), F.lit(4.0))) == pytest.approx(-1.4)
    stored = spark.createDataFrame([(1, "b"), (1, "a")], "task_id int, path string")
    names = spark.createDataFrame([(1, 0, "first.ofd")], "task_id int, idx int, file_name string")
    assert [(r["path"], r["file_name"]) for r in jobs.recovered_inputs(stored, names).orderBy("idx").collect()] == [("a", "first.ofd"), ("b", "input-2")]


def test_units_of_utf_16_are_decoded_without_python(spark, monkeypatch):
    @F.pandas_udf("string")
    def refused(content: pd.Series, codec: pd.Series) -> pd.Series:
        assert content.isna().all()
        return content.map(lambda _: None).astype(object)

    texts = ["", "a\n", "\nx\r\ny\n", "\u00d8\ud7ff\ue000\ufffd\u0dd8", "d8" * 3000, "\ufeffa"]
    rows = [(f"{i}{m}", mark + t.encode(m)) for i, t in enumerate(texts) for m, mark in (("utf-16le", b"\xff\xfe"), ("utf-16be", b"\xfe\xff"))]
    odd = [("pair", b"\xff\xfe" + "a\U0001f600".encode("utf-16le")), ("half", b"\xff\xfe\x00\xd8"), ("odd", b"\xfe\xff\x00a\x00"), ("swapped", b"\xfe\xff\xde\x00\xd8\x00"), ("null", None)]
    got = {r["k"]: (r["text"], r["error_code"]) for r in decode.decoded(spark.createDataFrame(odd, "k string, content binary")).collect()}
    bad = (None, "TEXT_ENCODING_UNSUPPORTED")
    assert got == {"pair": ("a\U0001f600", None), "half": bad, "odd": bad, "swapped": bad, "null": (None, None)}
    monkeypatch.setattr(decode, "_marked", refused)
    got = {r["k"]: r["text"] for r in decode.decoded(spark.createDataFrame(rows, "k string, content binary")).collect()}
    assert got == {f"{i}{m}": t.replace("\r\n", "\n") for i, t in enumerate(texts) for m in ("utf-16le", "utf-16be")}
