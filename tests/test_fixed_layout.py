import io
import zipfile

from test_documents import file_df, package

from paperloom.plans import convert
from paperloom.sinks import files as sinks
from paperloom.sources import fixed_layout

NS = 'xmlns:ofd="http://www.ofdspec.org/2016"'
TEXT = '<ofd:TextObject Boundary="10 10 50 5" Size="4" {}><ofd:TextCode X="1" Y="4" DeltaX="g 2 4">abc</ofd:TextCode></ofd:TextObject>'


def test_horizontal_scale_widens_runs():
    rows = [fixed_layout.layout_rows(package(TEXT.format(x)))[1] for x in ("", 'HScale="0.5"', 'HScale="2" CTM="1 0 0 1 3 0"', 'HScale="0"', 'HScale="-1"')]
    assert [(r[3], r[5]) for r in rows] == [(11, 12), (10.5, 6), (15, 24), (11, 12), (11, 12)]
    assert {r[6] for r in rows} == {4.0}


def test_own_inherited_and_default_drawing():
    path = lambda attrs, inner="": f'<ofd:PathObject Boundary="0 0 50 50" {attrs}>{inner}<ofd:AbbreviatedData>M 0 0 L 9 0</ofd:AbbreviatedData></ofd:PathObject>'
    page = path("") + path('DrawParam="7"') + path('DrawParam="8"') + path('DrawParam="7" LineWidth="3"', '<ofd:StrokeColor Value="1 2 300" Alpha="16"/>') + path('DrawParam="9"')
    page += '<ofd:PathObject Boundary="0 0 40 1" Fill="true" Stroke="false"><ofd:FillColor Value="255 0 0"/><ofd:AbbreviatedData>M 0 0</ofd:AbbreviatedData></ofd:PathObject>'
    page += TEXT.format("").replace("<ofd:TextCode", '<ofd:FillColor Value="0 0 255"/><ofd:TextCode', 1)
    box = zipfile.ZipFile(io.BytesIO(package(page)))
    parts = {n: box.read(n).decode() for n in box.namelist()}
    parts["Doc_0/Document.xml"] = parts["Doc_0/Document.xml"].replace("</ofd:CommonData>", "<ofd:PublicRes>Res.xml</ofd:PublicRes></ofd:CommonData>")
    parts["Doc_0/Res.xml"] = f'<ofd:Res {NS}><ofd:DrawParams><ofd:DrawParam ID="7" LineWidth="0.5"><ofd:FillColor Value="0 255 0"/><ofd:StrokeColor Value="9 9 9"/></ofd:DrawParam><ofd:DrawParam ID="8" Relative="7" LineWidth="1"/><ofd:DrawParam ID="9" Relative="9"/></ofd:DrawParams></ofd:Res>'
    rows = fixed_layout.layout_rows(sinks.archive([(n, x.encode()) for n, x in parts.items()]))
    got = [r[-3:] for r in rows if r[1] == "line"]
    black = "000000FF"
    assert got == [(black, black, 0.2), ("00FF00FF", "090909FF", 0.5), ("00FF00FF", "090909FF", 1.0), ("00FF00FF", "0102FF10", 3.0), (black, black, 0.2), ("FF0000FF", "FF0000FF", 1.0)]
    assert [r[-3:] for r in rows if r[1] == "text"] == [("0000FFFF", None, None)]


def test_no_table_found(spark):
    path = lambda d: f'<ofd:PathObject Boundary="0 0 100 60"><ofd:AbbreviatedData>{d}</ofd:AbbreviatedData></ofd:PathObject>'
    rules = "".join(path(f"M 10 {y} L 90 {y}") for y in (10, 20, 30)) + "".join(path(f"M {x} 10 L {x} 30") for x in (10, 50, 90))
    files = file_df(spark, package(rules + TEXT.format("")), b"broken", package(TEXT.format("")))
    assert sorted(map(tuple, convert.errors(files, "ofd", target="xlsx").collect())) == [(1, "INVALID_ARCHIVE"), (2, "NO_TABLE_FOUND")]
    assert sorted(r["file_id"] for r in convert.convert(files, "ofd", "xlsx").collect()) == [0]
    assert [tuple(r) for r in convert.errors(files, "ofd", target="txt").collect()] == [(1, "INVALID_ARCHIVE")]


def test_tables_stay_tables_in_word_documents(spark):
    path = lambda d: f'<ofd:PathObject Boundary="0 0 100 60"><ofd:AbbreviatedData>{d}</ofd:AbbreviatedData></ofd:PathObject>'
    rules = "".join(path(f"M 10 {y} L 90 {y}") for y in (20, 30, 40)) + "".join(path(f"M {x} 20 L {x} 40") for x in (10, 90)) + path("M 50 30 L 50 40")
    text = lambda x, y, t: f'<ofd:TextObject Boundary="{x} {y - 4} 20 5" Size="3.5"><ofd:TextCode X="0" Y="4">{t}</ofd:TextCode></ofd:TextObject>'
    files = file_df(spark, package(rules + text(15, 12, "title") + text(15, 27, "wide") + text(15, 37, "a") + text(55, 37, "b")))
    made = convert.convert(files, "ofd", "docx").first()["content"]
    xml = zipfile.ZipFile(io.BytesIO(made)).read("word/document.xml").decode()
    assert xml.index("title") < xml.index("<w:tbl>") < xml.index("wide") < xml.index("</w:tbl>")
    assert xml.count("<w:tr>") == 2 and xml.count("<w:tc>") == 3 and xml.count('<w:gridSpan w:val="2"/>') == 1
