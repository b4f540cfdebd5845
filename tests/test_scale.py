"""Plans that keep in proportion to their input: how often rows pass, and what is shuffled."""

import io
import random
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import grid, grouped, layout, numbering, ocr, paths, quality, rendering
from paperloom.plans.convert import convert
from paperloom.queries import QUERIES
from paperloom.sinks import files as sinks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_workbooks_are_read_once_and_dealt_to_all_parts(spark):
    rows = spark.range(300).select("id", F.explode(F.sequence(F.lit(1), 1 + F.col("id").cast("int") % 2)).alias("sheet_no")).select("id", "sheet_no", F.concat(F.lit("s"), "sheet_no").alias("sheet"), F.lit(0).alias("row_no"), F.array(F.col("id").cast("string"), F.lit("a,b")).alias("cells"))
    found = {r["id"]: bytes(r["content"]) for r in sinks.sheet_files(rows, "id").collect()}
    assert len(found) == 300 and found[4] == b'4,"a,b"\r\n'
    with zipfile.ZipFile(io.BytesIO(found[5])) as box:
        assert {n: box.read(n) for n in box.namelist()} == {"01-s1.csv": b'5,"a,b"\r\n', "02-s2.csv": b'5,"a,b"\r\n'}
    csvs = spark.range(300).select(F.col("id").alias("file_id"), F.encode(F.concat(F.lit("a,"), "id"), "UTF-8").alias("content"))
    books = convert(csvs, "csv", "xlsx")
    assert "FlatMapGroupsInPandas" not in plan(books) and books.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = convert(books, "xlsx", "csv")
    assert plan(back).count("MapInPandas") == 1
    assert {r["file_id"]: bytes(r["content"]) for r in back.collect()} == {i: f"a,{i}\r\n".encode() for i in range(300)}


def shuffles(df) -> list[str]:
    return [line for line in plan(df).splitlines() if "Exchange" in line]


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


DOCS = [(1, " ".join(f"w{i}" for i in range(205))), (1, "two texts  of one id"), (2, ""), (3, None), (4, " \t  a"), (5, "  ".join(["x", "\u3000", "y"] * 70)), (6, " " * 100), (None, "no id")]


def test_pages_of_words_are_those_of_their_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    words, pages = layout.word_blocks(docs), layout.word_pages(docs)
    lined = layout.visual_lines(words)
    assert rows(layout.visual_lines(pages).select(*lined.columns)) == rows(lined)
    whole = layout.paragraphs(layout.paragraph_lines(words))
    assert rows(layout.page_paragraphs(pages).select(*whole.columns)) == rows(whole) == rows(layout.page_paragraphs(words).select(*whole.columns))
    parted = layout.column_segments(lined.where("seq % 8 NOT IN (2, 3)")).select("doc_id", "page_no", "seq", "line_no", "segment_no")
    some = pages.withColumn("_blocks", F.filter("_blocks", lambda b: ~(b["seq"] % 8).isin(2, 3)))
    found = layout.page_segments(some).select("doc_id", "page_no", F.explode("_segments").alias("s")).select("doc_id", "page_no", F.explode("s.blocks.seq").alias("seq"), "s.line_no", "s.segment_no")
    assert rows(found) == rows(parted) and any(r["segment_no"] for r in found.collect())
    units = layout.segment_units(layout.column_segments(lined))
    place = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("y", "x", "line_no"))
    text = layout.page_texts(units.withColumn("place", place))
    assert rows(layout.simple_page_texts(pages)) == rows(layout.simple_page_texts(words)) == rows(text)
    # only texts are shuffled, by their ids
    shaken = pages.withColumn("_blocks", F.transform("_blocks", lambda b: b.withField("y", b["y"] + b["seq"] % 8)))
    for df in (layout.visual_lines(pages), layout.page_paragraphs(pages), layout.document_text(layout.simple_page_texts(pages)), layout.page_segments(pages), layout.beside(shaken)):
        assert len(shuffles(df)) == 1 and "page_no" not in shuffles(df)[0]


def test_blocks_beside_others_are_found_within_bands(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a"), (3, "a  b")], "doc_id long, text string")
    shaken = layout.word_blocks(docs).withColumn("y", F.col("y") + (F.col("seq") % 8) * 1.0)
    all_ = [r.asDict() for r in shaken.collect()]
    over = lambda a, n, b, m: max(0, min(a + n, b + m) - max(a, b))
    near = lambda a, b: over(a["y"], 5, b["y"], 5) > 1 and over(a["x"], 20, b["x"], 20) <= 4
    want = {(a["doc_id"], a["page_no"], a["seq"]) for a in all_ for b in all_ if a["doc_id"] == b["doc_id"] and a["seq"] != b["seq"] and near(a, b)}
    assert set(rows(layout.beside(shaken))) == want and len(want) == 12


def test_equal_texts_are_not_sorted(spark):
    pairs = [("a b", "ab", True), ("ab", "ba", True), ("ab", "abb", False), ("aab", "abb", False), (None, " ", True), ("é\U0001f600", "\U0001f600é", True)]
    df = spark.createDataFrame(pairs, "l string, r string, want boolean").withColumn("same", quality.same_characters(F.col("l"), F.col("r")))
    assert [r["same"] for r in df.collect()] == [p[2] for p in pairs]
    assert "CASE WHEN" in plan(df) and "array_sort" not in plan(df)


def test_paths_are_not_shuffled(spark):
    texts = ["M 0 0 L 1 0 L 1 1 C L 5 5", "L 5 5 M 1 1 X 2 Q 1 2 3 4 L 3 CM 1", None, "", "M 1 2 A 1 1 0 0 1 3 4 S 0 0 C"]
    df = spark.createDataFrame([(i, t, 0.0, 0.0, None) for i, t in enumerate(texts)], "id int, data string, x double, y double, ctm array<double>")
    lines, warned = paths.path_lines(df, ["id"]), paths.path_warnings(df, ["id"])
    assert not shuffles(lines) and not shuffles(warned)
    found = [r for r in rows(lines) if r[0] != 1]
    assert found == [(0, 0, 0.0, 0.0, 1.0, 0.0), (0, 1, 1.0, 0.0, 1.0, 1.0), (0, 2, 1.0, 1.0, 0.0, 0.0), (0, 3, 0.0, 0.0, 5.0, 5.0), (4, 0, 1.0, 2.0, 3.0, 4.0)]
    assert [r[1] for r in rows(lines) if r[0] == 1] == list(range(8))
    assert rows(warned) == [(1, "CM", 1), (1, "UNKNOWN", 1), (4, "ARC_AS_CHORD", 1)]


def test_segments_of_a_page_are_gathered_once(spark):
    sides = [(0, 0, 20, 0), (0, 10, 20, 10), (0, 0, 0, 10), (20, 0, 20, 10), (50, 50, 60, 50)]
    df = spark.createDataFrame([(d, 1, i, *map(float, s)) for d in range(3) for i, s in enumerate(sides)], "doc_id int, page_no int, seq int, x1 double, y1 double, x2 double, y2 double")
    found = grid.linked_lines(df)
    assert len(shuffles(found)) == 1 and "Window" not in plan(found)
    assert sorted((r["doc_id"], r["component"], len(r["lines"])) for r in found.collect()) == [(0, 0, 4), (1, 0, 4), (2, 0, 4)]


@pytest.fixture
def unbroadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def lineitems(spark, path, n=400):
    k = F.col("id")
    some = spark.range(n).select((k % 90).alias("l_orderkey"), (k % 7).cast("int").alias("l_linenumber"), (k % 11).alias("l_partkey"), (k % 13).alias("l_suppkey"), (k % 37).cast("double").alias("l_quantity"), k.cast("double").alias("l_extendedprice"))
    some.write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize(("name", "key"), [("numbering_repair", "l_partkey"), ("upright_pixels", "l_suppkey")])
def test_parts_follow_the_rows_and_are_kept(spark, tmp_path, monkeypatch, unbroadcast, name, key):
    path = lineitems(spark, tmp_path)
    whole = QUERIES[name](spark, path)
    monkeypatch.setattr(grouped, "PART_ROWS", 20)
    parted = QUERIES[name](spark, path)
    # every shuffle is by the one key into as many parts as the rows need, not into the session's
    assert shuffles(parted) and all(f"hashpartitioning({key}" in x and ", 20)" in x for x in shuffles(parted))
    assert rows(parted) == rows(whole)


def test_definitions_of_lists(spark):
    p = spark.createDataFrame([(1, 1, 7, None), (1, 2, 7, "1"), (1, 3, None, "0"), (1, 4, 8, " "), (1, 5, 9, "0"), (2, 1, 7, "0"), (None, 1, 7, "0")], "doc_id int, seq int, num_id int, level string")
    nums = spark.createDataFrame([(1, 7, 1), (1, 7, 0), (1, None, 1), (1, 8, None), (1, 9, 5), (None, 7, 1)], "doc_id int, num_id int, abstract_id int")
    levels = spark.createDataFrame([(1, 1, "0", "<a> <b>"), (1, 1, "0", "<a><a>"), (1, 1, None, "<n>"), (1, None, "0", "<m>"), (None, 1, "0", "<o>")], "doc_id int, abstract_id int, level string, xml string")
    ones = spark.createDataFrame([(1, 7, "0", 1), (1, 7, "0", 1), (1, 8, "0", 2), (1, None, "0", 1), (1, 9, "0", 1)], "doc_id int, num_id int, level string, start int")
    got = rows(numbering.numbered(p, nums, levels, ones))
    assert got == sorted([(1, 1, 7, "0", "<a><b>", True), (1, 2, 7, "1", None, False), (1, 3, None, "0", None, False), (1, 4, 8, "0", None, False), (1, 5, 9, "0", None, True), (2, 1, 7, "0", None, False), (None, 1, 7, "0", None, False)], key=repr)


def test_grids_are_made_of_rows_that_hold_their_cells(spark, unbroadcast):
    tables = spark.createDataFrame([(1, 1, 1, [0.0, 10.0, 30.0], [0.0, 1.0, 2.0, 3.0]), (2, 1, 1, [0.0, 10.0], [0.0, 1.0]), (3, 1, 1, [0.0], [0.0, 1.0])], "doc_id int, page_no int, table_no int, xs array<double>, ys array<double>")
    cells = spark.createDataFrame([(1, 1, 1, 0, 0, 2, 1), (1, 1, 1, 2, 0, 1, 2), (1, 1, 1, 2, 0, 1, 1), (1, 1, 1, 0, 1, 1, 2), (3, 1, 1, 0, 0, 1, 1), (4, 1, 1, 0, 0, 1, 1)], "doc_id int, page_no int, table_no int, row int, col int, row_span int, col_span int")
    grid_ = rendering.overlay_grid(cells, tables)
    # cells and tables once each; before, free places and the cells made of spans were shuffled too
    assert len(shuffles(grid_)) == 2
    one, two = 567, 1134
    want = [(0, 0, 1, "restart", True, one), (1, 0, 1, "continue", False, one), (2, 0, 2, None, True, one + two), (2, 0, 1, None, True, one), (0, 1, 2, None, True, two), (1, 1, 1, None, False, two)]
    assert rows(grid_) == sorted([(1, 1, 1, *w) for w in want] + [(2, 1, 1, 0, 0, 1, None, False, one)], key=repr)


def test_recognised_blocks_meet_native_ones_without_more_shuffles(spark, unbroadcast, monkeypatch):
    monkeypatch.setattr(ocr, "PAIRS", 7)
    rnd = random.Random(3)
    cols = "doc_id int, page_no int, seq int, x double, y double, width double, height double, text string"
    box = lambda: (rnd.choice([None, float("inf")] + [rnd.uniform(0, 30) for _ in range(30)]), *(rnd.uniform(*r) for r in ((0, 30), (0, 25), (0, 12))))
    side = lambda n, k: [(rnd.choice([1, 2, None]), rnd.randrange(3), i, *box(), rnd.choice([None, f"t{k}", f"t {rnd.randrange(40)}", "\t"])) for i in range(n)]
    mine, theirs = side(150, 1), side(90, 2)
    found, native = spark.createDataFrame(mine, cols), spark.createDataFrame(theirs, cols)

    def repeats(f, n):
        if None in f[:2] or f[:2] != n[:2]:
            return False
        if f[7] is not None and n[7] is not None and "".join(f[7].split()) == "".join(n[7].split()):
            return True
        if any(v is None or v == float("inf") for v in (f[3], n[3])):
            return False
        (ax, ay, aw, ah), (bx, by, bw, bh) = f[3:7], n[3:7]
        both = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
        return both / max(0.01, min(aw * ah, bw * bh)) > 0.7

    left = ocr.without_duplicates(found, native)
    # each side once; before, both were shuffled again for every join
    assert len(shuffles(left)) == 2
    assert rows(left) == sorted([f for f in mine if not any(repeats(f, n) for n in theirs)], key=repr) and 20 < left.count() < 130
    docs = spark.createDataFrame(DOCS[:2], "doc_id long, text string")
    pages = layout.word_pages(docs).select("doc_id", "page_no", F.col("_blocks").alias("_found"), F.slice("_blocks", 1, 3).alias("_native"))
    assert len(shuffles(ocr.new_blocks(pages))) == 1
