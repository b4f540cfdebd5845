from paperloom import queries

SF = "/root/testdata/sf0.001"


def test_all_pages_reach_the_required_pages(spark, monkeypatch):
    real, seen = queries.ocr.required_pages, []
    monkeypatch.setattr(queries.ocr, "required_pages", lambda w: seen.append(w) or real(w))
    got = {r["doc_id"]: r["pages"] for r in queries.QUERIES["ocr_required_pages"](spark, SF).collect()}
    pages = {tuple(r) for r in queries.blocks(spark, SF).select("doc_id", "page_no").distinct().collect()}
    assert {tuple(r) for r in seen[0].select("doc_id", "page_no").distinct().collect()} == pages
    want = {}
    for doc, page in sorted(pages):
        if page % 3 == 1:
            want.setdefault(doc, []).append(str(page))
    assert got == {k: "、".join(v) for k, v in want.items()}


def test_texts_are_split_once_a_document(spark):
    from paperloom import queries_objects

    for rows in (queries_objects._refs(spark, SF), queries_objects._paragraphs(spark, SF)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        made = [i for i, line in enumerate(plan) if "Generate" in line]
        # what stands above a generator is worked out for each of its rows
        assert made and not any("split(" in plan[i - k] for i in made for k in (1, 2) if i >= k and "Relation" not in plan[i - k] and plan[i - k].lstrip(" :+-").startswith(("Project", "Filter")))


def test_edge_coverage_of_odd_lines_equals_sql(spark, tmp_path):
    import duckdb

    nan, inf = float("nan"), float("inf")
    # no length, unknown or no finite ends, ends before begins, points that make gaps small; no ties, which the SQL leaves open
    orders = [[(5.0, 0)], [(None, 1)], [(5.0, None), (6.0, 2)], [(0.0, 4), (4.5, 0), (5.0, 1)], [(5.0, -2)], [(5.0, -2), (4.0, 3)], [(nan, 1), (2.0, 1)], [(inf, 1)], [(-inf, 1), (3.0, 1)], [(None, None), (1.0, 2), (9.0, 1)], [(1.0, 200)], [(1.0, 1), (2.6, 1)]]
    rows = [(k, *x) for k, lines in enumerate(orders) for x in lines] + [(None, 3.0, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(map(str, r)) for r in queries.QUERIES["edge_coverage"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert got == {tuple(map(str, r)) for r in c.execute(queries.SQL["edge_coverage"]).fetchall()} and len(got) == 13
