from paperloom.operators import jobs, rendering
from paperloom.sources import containers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_lines_break_before_the_margin(spark):
    glyphs = spark.createDataFrame([("a", 500, True, False), ("b", 250, False, True), ("?", 1000, True, False), (" ", 250, True, False)], "ch string, width int, latin boolean, cjk boolean")
    lines = spark.createDataFrame([(1, "aab a"), (2, ""), (3, "zzzz"), (4, "ab")], "k int, text string")
    page = rendering.TextPage(width=96 + 22.0)
    got = rendering.wrapped(lines, ["k"], glyphs, page).orderBy("k", "part_no").collect()
    assert [(r["k"], r["part_no"], r["text"]) for r in got] == [(1, 1, "aab a"), (2, 1, ""), (3, 1, "??"), (3, 2, "??"), (4, 1, "ab")]
    narrow = rendering.wrapped(lines.where("k = 3"), ["k"], glyphs, rendering.TextPage(width=96 + 5.0)).collect()
    assert [r["text"] for r in narrow] == ["?"] * 4
    runs = rendering.font_runs(rendering.glyphs_of(lines, ["k"], glyphs), ["k"]).where("k IN (1, 4)").orderBy("k", "run_no").collect()
    assert [(r["k"], r["font"], r["text"]) for r in runs] == [(1, "latin", "aa"), (1, "cjk", "b"), (1, "latin", " a"), (4, "latin", "a"), (4, "cjk", "b")]


def test_pages_fill_up(spark):
    assert rendering.TextPage().lines == 50
    lines = spark.createDataFrame([(1, p, i) for p, n in ((1, 101), (2, 1), (5, 50)) for i in range(n)], "doc_id int, logical_page int, seq int")
    got = rendering.paged(lines, ["seq"]).groupBy("logical_page", "page_no").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 50), (1, 2, 50), (1, 3, 1), (2, 4, 1), (5, 5, 50)]


def test_word_tables_of_a_grid(spark):
    tables = spark.createDataFrame([(1, 1, 1, [0.0, 10.0, 20.0], [0.0, 5.0, 10.0])], "doc_id int, page_no int, table_no int, xs array<double>, ys array<double>")
    cells = spark.createDataFrame([(1, 1, 1, 0, 0, 2, 1), (1, 1, 1, 1, 1, 1, 1)], "doc_id int, page_no int, table_no int, row int, col int, row_span int, col_span int")
    texts = spark.createDataFrame([(1, 1, 1, 0, 0, "a<b"), (1, 1, 1, 1, 1, "c")], "doc_id int, page_no int, table_no int, row int, col int, text string")
    xml = rendering.table_xml(rendering.overlay_grid(cells, tables), texts).first()["xml"]
    assert xml.count("<w:tr>") == 2 and xml.count("<w:tc>") == 4 and xml.count('w:w="567"') == 4
    assert '<w:vMerge w:val="restart"/>' in xml and '<w:vMerge w:val="continue"/>' in xml and xml.count("a&lt;b") == 1


def test_endnotes_begin_a_page(spark):
    doc = lambda body: f"<w:document {W}><w:body>{body}</w:body></w:document>".encode()
    notes = lambda kind, k: f'<w:endnotes {W}><w:endnote w:id="{k}" {kind}/></w:endnotes>'.encode()
    text = "<w:p><w:r><w:t>x</w:t></w:r></w:p>"
    real, changed = containers.endnotes_on_new_page(doc(text + "<w:p/>"), notes("", 2))
    assert changed and real.count(b'type="page"') == 1
    assert containers.endnotes_on_new_page(real, notes("", 2)) == (real, False)
    assert not containers.endnotes_on_new_page(doc(text), notes("", 1))[1]
    assert not containers.endnotes_on_new_page(doc(text), notes('w:type="separator"', 5))[1]
    assert not containers.endnotes_on_new_page(doc("<w:p/>"), notes("", 2))[1]
    rows = spark.createDataFrame([(1, bytearray(doc(text)), bytearray(notes("", 3))), (2, bytearray(doc(text)), None)], "k int, document binary, endnotes binary")
    assert {r["k"]: r["changed"] for r in containers.with_endnote_breaks(rows, "k").collect()} == {1: True, 2: False}


def test_manifests_on_disk(spark, tmp_path):
    tasks = spark.createDataFrame([("t1", "WAITING", 5, None, "2030-01-01"), ("t2", "SUCCESS", 100, None, "2030-01-01"), ("t3", "SUCCESS", 100, None, "2020-01-01")], "task_id string, status string, progress int, error_code string, expires_at string")
    from pyspark.sql import functions as F

    tasks = tasks.withColumn("expires_at", F.to_timestamp("expires_at"))
    jobs.write_manifests(tasks, f"file://{tmp_path}/m")
    (tmp_path / "m" / "bad.txt").write_text("{broken")
    got = jobs.from_manifests(jobs.read_manifests(spark, f"file://{tmp_path}/m"), tasks.schema, F.to_timestamp(F.lit("2025-01-01")))
    assert sorted((r["task_id"], r["status"], r["progress"], r["error_code"]) for r in got.collect()) == [("t1", "FAILED", 100, "SERVICE_RESTARTED"), ("t2", "SUCCESS", 100, None)]


def test_parts_of_a_package(spark):
    names = spark.createDataFrame([(1, n) for n in ("word/media/b.png", "word/media/a.png", "word/media/", "word/fonts/f.odttf", "word/document.xml")], "k int, name string")
    r = containers.package_parts(names, "k").first()
    assert (r["media"], r["fonts"]) == (["word/media/a.png", "word/media/b.png"], ["word/fonts/f.odttf"])
