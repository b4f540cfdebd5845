import random

from pyspark.sql import functions as F

from paperloom.operators import glyphs, jobs, layout, numbering, objects, ocr, paths, pixels

REFS = "doc_id int, page_no int, parent_id int, object_id int, position int, kind string"


def test_object_tree_guards(spark):
    tree = [(None, 1, 0, "block"), (1, 2, 0, "block"), (2, 1, 0, "block"), (2, 3, 1, "text"), (1, 3, 5, "text"), (1, 4, 6, "video"), (None, 5, 9, "image"), (3, 6, 0, "text"), (None, 5, 9, "image"), (8, 9, 0, "text"), (9, 8, 0, "block")]
    rows = [(1, 1, *r) for r in tree] + [(None, 1, None, 1, 0, "text"), (2, 1, None, None, 0, "text")]
    # a chain of 131 blocks: its last two are too deep
    rows += [(3, 1, None if i == 0 else i - 1, i, 0, "block") for i in range(131)]
    rows += [(4, 1, None, i, None, "path") for i in range(11)]
    got = objects.object_tree(spark.createDataFrame(rows, REFS), most=200).collect()
    one = {(r["parent_id"], r["object_id"]): (r["status"], r["z"], r["depth"]) for r in got if r["doc_id"] == 1}
    assert one == {(None, 1): ("kept", None, 0), (1, 2): ("kept", None, 1), (2, 1): ("repeated", None, 2), (2, 3): ("kept", 0, 2), (1, 3): ("repeated", None, 1), (1, 4): ("unsupported", None, 1), (None, 5): ("kept", 1, 0)}
    deep = {r["object_id"]: r["status"] for r in got if r["doc_id"] == 3}
    assert deep == {i: "kept" if i < 129 else "too_deep" for i in range(130)}
    assert sorted(r["z"] for r in got if r["doc_id"] == 4) == list(range(11)) and {r["doc_id"] for r in got} == {1, 3, 4}
    few = objects.object_tree(spark.createDataFrame(rows, REFS).where("doc_id = 4"), most=10)
    assert {r["status"] for r in few.collect()} == {"refused"}
    assert objects.object_tree(spark.createDataFrame([], REFS)).count() == 0


def test_shared_objects_do_not_multiply(spark):
    # forty diamonds in a row have 2 ** 40 ways through
    rows = [(1, 1, None, 0, 0, "block")]
    for i in range(40):
        rows += [(1, 1, 3 * i, 3 * i + k, k, "block") for k in (1, 2)] + [(1, 1, 3 * i + k, 3 * i + 3, 0, "block") for k in (1, 2)]
    got = objects.object_tree(spark.createDataFrame(rows, REFS)).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"kept": 121, "repeated": 40}


def test_advances(spark):
    cases = [("1 g 3 2.5 4", 7, [1, 2.5, 2.5, 2.5, 4, 4, 4]), (None, 3, []), ("  ", 3, []), ("1 2 3", 2, [1, 2]), ("g 2", 3, None), ("g 2000 1", 3, None), ("g 2000 1", 500, [1.0] * 500), ("g -1 2", 3, None), ("g 0 2", 3, []), ("1 x", 2, None), ("G 2 1\n\tg 1 5", 9, [1, 1] + [5] * 7), ("1", 0, []), ("g 2147483647 1 g 2147483647 1", 5, None)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)], "i int, t string, n int")
    assert [r["a"] for r in df.select("i", paths.advances(F.col("t"), F.col("n")).alias("a")).orderBy("i").collect()] == [w for _, _, w in cases]


def test_paths(spark):
    data = {1: "M 0 0 Q 5 5 10 0 B 10 5 15 5 20 0 C", 2: "L 5 5 Q 1 1 2 2 M 1 1 L 1 1.0005 L 2 1", 3: "M 0 0 L 3 X 1 L 1e1 0", 4: None, 5: "", 6: "M 0 0 A 1 1 0 0 1 4 0 CM 1 0", 7: "M0,0L1-1C"}
    df = spark.createDataFrame([(k, d, 1.0, 2.0, None) for k, d in data.items()], "id int, data string, x double, y double, ctm array<double>")
    lines = {}
    for r in paths.path_lines(df, ["id"]).orderBy("id", "segment").collect():
        lines.setdefault(r["id"], []).append((r["segment"], round(r["x1"], 6), round(r["y1"], 6), round(r["x2"], 6), round(r["y2"], 6)))
    assert len(lines[1]) == 8 + 12 + 1 and lines[1][-1] == (20, 21.0, 2.0, 1.0, 2.0)
    assert lines[2] == [(1, 2.0, 3.0005, 3.0, 3.0)] and lines[3] == [(0, 1.0, 2.0, 11.0, 2.0)]
    assert lines[6] == [(0, 1.0, 2.0, 5.0, 2.0)] and lines[7] == [(0, 1.0, 2.0, 2.0, 1.0), (1, 2.0, 1.0, 1.0, 2.0)] and set(lines) == {1, 2, 3, 6, 7}
    assert sorted((r["id"], r["code"]) for r in paths.path_warnings(df, ["id"]).collect()) == [(3, "UNKNOWN"), (6, "ARC_AS_CHORD"), (6, "CM")]
    box = df.select(paths.box_line(F.lit(0.0), F.lit(0.0), F.lit(40.0), F.lit(1.0)).alias("a"), paths.box_line(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(4.0)).alias("b"), paths.box_line(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(4.0)).alias("c")).first()
    assert tuple(box["a"]) == (0, 0.5, 40, 0.5, 1) and tuple(box["b"]) == (0.5, 0, 0.5, 4, 1) and box["c"] is None


def test_path_limits(spark, monkeypatch):
    monkeypatch.setattr(paths, "MOST", 10)
    df = spark.createDataFrame([(1, "M 0 0 B 1 1 2 2 3 3", 0.0, 0.0, None), (2, "M 0 0 " + "L 1 1 L 0 0 " * 8, 0.0, 0.0, None)], "id int, data string, x double, y double, ctm array<double>")
    assert sorted(r["segment"] for r in paths.path_lines(df.where("id = 1"), ["id"]).collect()) == list(range(10))
    assert paths.path_lines(df.where("id = 2"), ["id"]).count() == 9
    assert sorted((r["id"], r["code"]) for r in paths.path_warnings(df, ["id"]).collect()) == [(1, "SEGMENTS_CUT"), (2, "OPERATIONS_CUT")]


def test_restart_holds_for_the_first_paragraph_of_a_list(spark):
    def fixed(*rows):
        df = spark.createDataFrame([(1, i, n, "0", s, r) for i, (n, s, r) in enumerate(rows)], "doc_id int, seq int, num_id int, level string, signature string, restart boolean")
        return [r["fixed_num_id"] for r in numbering.repaired_lists(df).orderBy("seq").collect()]

    assert fixed((1, "a", False), (2, "a", True), (2, "a", True), (1, "a", False)) == [1, 2, 2, 1]
    assert fixed((1, "a", False), (2, "a", True), (1, "a", False), (1, "a", False), (3, "a", False), (1, "a", False)) == [1, 2, 2, 2, 3, 1]
    assert fixed((1, "a", False), (2, "a", True), (1, "b", False), (1, "a", False)) == [1, 2, 1, 1]
    assert fixed((1, "a", False), (2, "a", True), (None, "a", False), (1, "a", False), (1, None, False)) == [1, 2, None, 1, None]


def cut(units, width):
    """The recursive cut in plain Python, on (x, y, width, height, id)."""
    if len(units) > 1:
        heights = sorted(u[3] for u in units)
        for axis, least in ((0, max(12.0, width * 0.06)), (1, max(5.0, heights[(len(units) - 1) // 2] * 1.8))):
            row, best, at = sorted(units, key=lambda u: u[axis]), least, None
            reach = row[0][axis] + row[0][axis + 2]
            for i, u in enumerate(row[1:], 1):
                if u[axis] - reach > best:
                    best, at = u[axis] - reach, i
                reach = max(reach, u[axis] + u[axis + 2])
            if at:
                inner = max(u[0] + u[2] for u in units) - min(u[0] for u in units)
                return cut(row[:at], inner) + cut(row[at:], inner)
    return sorted(units, key=lambda u: (u[1], u[0]))


def test_reading_order_equals_the_recursive_cut(spark):
    rng, rows, want = random.Random(5), [], {}
    for page in range(40):
        units = [(float(rng.randrange(0, 160, 3)), float(rng.randrange(0, 250, 5)), float(rng.choice([8, 20, 60])), float(rng.choice([4, 5, 9])), i) for i in range(rng.randrange(1, 14))]
        units = sorted({u[:2]: u for u in units}.values(), key=lambda u: u[4])
        rows += [(1, page, u[4], *u[:4]) for u in units]
        want[page] = [u[4] for u in cut(units, 210.0)]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, seq int, x double, y double, width double, height double")
    got = {}
    for r in layout.reading_order(df).orderBy("page_no", "place").collect():
        got.setdefault(r["page_no"], []).append(r["seq"])
    assert got == want


def test_pixels_upright_and_reduced(spark):
    # a 3 x 2 picture, values by place, in each orientation; what stands at the upright top left
    rows = [(o, x, y, 10 * y + x) for o in range(10) for y in range(2) for x in range(3)] + [(1, 5, 0, 99), (1, -1, 0, 99), (77, 0, 0, 1)]
    p = spark.createDataFrame(rows, "image_id int, x int, y int, v int")
    i = spark.createDataFrame([(o, 3, 2, o if o else None) for o in range(10)], "image_id int, width int, height int, orientation int")
    up, sizes = pixels.turned(p, i)
    assert {r["image_id"]: r["v"] for r in up.where("x = 0 AND y = 0").collect()} == {0: 0, 1: 0, 2: 2, 3: 12, 4: 10, 5: 0, 6: 10, 7: 12, 8: 2, 9: 0}
    assert {r["image_id"]: (r["width"], r["height"]) for r in sizes.collect()} == {o: (2, 3) if 5 <= o <= 8 else (3, 2) for o in range(10)}
    assert up.count() == 60
    small, sizes = pixels.reduced(p.where("image_id = 0"), i.where("image_id = 0"), 2)
    # halves of the middle column go to both sides; one row: (0 + 0.5 * 1) / 1.5 and so on, rows averaged
    assert [(r["x"], r["y"], r["v"]) for r in small.orderBy("x").collect()] == [(0, 0, 5), (1, 0, 7)] and tuple(sizes.first()) == (0, 2, 1)
    same, _ = pixels.reduced(p.where("image_id = 0"), i.where("image_id = 0"), 3)
    assert sorted(map(tuple, same.collect())) == sorted(r for r in rows if r[0] == 0)


def test_displayed_runs(spark):
    form = "doc_id int, page_no int, seq int, ch string, x double, y double, width double, height double, family string, size_pt double, bold boolean, italic boolean, direction double, color string"
    row = lambda seq, ch, x, y, at, page=1: (1, page, seq, ch, x, y, 10.0, 8.0, "F", 0.0, False, False, at, "0")
    rows = [row(1, "a", 72.0, 144.0, 0.0), row(2, "", 0.0, 0.0, 0.0), row(3, "b", 82.0, 144.0, 0.05), row(4, "c", 72.0, 200.0, 90.0), row(5, "d", 72.0, 190.0, 90.0), row(1, "e", 72.0, 72.0, 90.0, 2)]
    pages = spark.createDataFrame([(1, 1, None, None), (1, 2, 90, 2.0)], "doc_id int, page_no int, rotation int, user_unit double")
    got = {(r["page_no"], r["run_no"]): r for r in glyphs.displayed_runs(spark.createDataFrame(rows, form), pages).collect()}
    near = lambda r, *want: [round(r[k], 3) for k in ("x", "y", "width", "height")] == [round(v * 25.4 / 72, 3) for v in want]
    assert got[1, 1]["text"] == "ab" and round(got[1, 1]["degrees"], 2) == 359.95 and got[1, 1]["size_pt"] == 10.5
    # up the page: 20 along, 8 across, about the middle of the turned text
    assert got[1, 2]["text"] == "cd" and round(got[1, 2]["degrees"]) == 270 and near(got[1, 2], 72 - 4 - 10, 190 - 4, 20, 8)
    assert got[2, 1]["degrees"] == 0 and near(got[2, 1], 144, 144 - 16, 20, 16) and got[2, 1]["size_pt"] == 21


def test_totals_do_not_wrap(spark):
    files = spark.createDataFrame([(1, 1, 5), (1, 2, (1 << 63) - 1), (1, 3, None), (2, 1, 4)], "task_id int, idx int, size long")
    got = [(r["total_bytes"], r["over"]) for r in jobs.running_bytes(files, 10).orderBy("task_id", "idx").collect()]
    assert got == [(5, False), (None, True), (None, True), (4, False)]


def test_what_to_recognise(spark):
    df = spark.createDataFrame([(0, True, "PAGE"), (0, False, "NONE"), (3, True, "IMAGES"), (3, False, "IMAGES")], "n int, seen boolean, want string")
    assert all(r["p"] == r["want"] for r in df.withColumn("p", ocr.plan(F.col("n"), F.col("seen"))).collect())


def test_displayed_runs_round_halves_as_their_sql(spark, tmp_path):
    import duckdb

    from paperloom.queries import QUERIES, SQL

    # eight glyphs of one run whose mean baseline lies half-way between two millionths
    form = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame([(k, 7, 1, 1, 3.0, 1.0, "A") for k in (211, 212, 213, 214, 215, 216, 217, 223)], form).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["displayed_runs"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.execute(SQL["displayed_runs"]).fetchall() and got[0]["baseline"] == 114101562


def test_reading_order_stores_no_rounds(spark, monkeypatch):
    # evenly spaced lines that are all cut apart took a stored round of Spark each
    writes = []
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda *a, **k: writes.append(a))
    units = spark.range(300).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), F.col("id").alias("seq"), F.lit(10.0).alias("x"), (F.col("id") * 20.0).alias("y"), F.lit(50.0).alias("width"), F.lit(5.0).alias("height"))
    got = layout.reading_order(units.repartition(3))
    assert {r["seq"]: r["place"] for r in got.collect()} == {i: i + 1 for i in range(300)} and not writes


def test_reading_order_of_documents_together(spark):
    rng = random.Random(8)
    rows = [(doc, page, seq, float(rng.randrange(0, 160, 3)), float(rng.randrange(0, 250, 5)), 8.0, rng.choice([4.0, 9.0]), rng.choice(["a", None])) for doc in (1, 2, 3, None) for page in range(1, 6) for seq in range(rng.choice([1, 7, 30]))]
    # places without a value come first, in no cut
    rows += [(2, 1, 98, None, 7.0, 8.0, 4.0, "n"), (2, 1, 99, 50.0, None, 8.0, None, "n")]
    rng.shuffle(rows)
    form = "doc_id int, page_no int, seq int, x double, y double, width double, height double, text string"
    df = spark.createDataFrame(rows, form)
    want = sorted(map(str, layout.reading_order(df).collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        # documents and pages that go on over batches, and pages of one document that stand mixed
        for n in (7, 10000):
            spark.conf.set(size, n)
            found = layout.reading_order(layout.documents_together(df), together=True)
            assert found.columns == [*df.columns, "place"] and sorted(map(str, found.collect())) == want
    finally:
        spark.conf.set(size, before)
    pages = {}
    for r in layout.reading_order(df).collect():
        pages.setdefault((r["doc_id"], r["page_no"]), []).append(r["place"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in pages.values()) and sum(map(len, pages.values())) == len(rows)
