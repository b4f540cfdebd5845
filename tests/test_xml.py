from pyspark.sql import functions as F

from paperloom.operators import xml


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, xml string")


def test_tokens_and_entities(spark):
    rows = xml.tokens(frame(spark, "<?xml?><a:b c='<>'>x &amp;lt; &#65;&#x1F600;&bad;<!-- <q> --><![CDATA[<&amp;]]><d/></a:b>", None, ""), ["id"]).orderBy("no").collect()
    assert [(r["kind"], r["name"], r["text"]) for r in rows] == [("open", "b", None), ("text", None, "x &lt; A😀&bad;"), ("text", None, "<&amp;"), ("empty", "d", None), ("close", "b", None)]


def test_well_formed(spark):
    cases = {"<a><b/>x</a>": True, "<a></b>": False, "<a><b></a></b>": False, "<a>": False, "</a>": False, "<a/><b/>": False, "<a/>x": False, " <a></a>\n": True, "<a><a></a></a>": True, "<a><b></b><c></c></a>": True}
    got = xml.well_formed(xml.tokens(frame(spark, *cases), ["id"]), ["id"]).orderBy("id").collect()
    assert [r["ok"] for r in got] == list(cases.values())


def test_roots(spark):
    cases = {'<UOF xmlns="http://schemas.uof.org/x"/>': ("UOF", "http://schemas.uof.org/x", True), "<u:UOF xmlns='urn:a' xmlns:u = 'http://schemas.uof.org/cn'>": ("UOF", "http://schemas.uof.org/cn", True), "<UOF>": ("UOF", None, False), "<x:UOF xmlns='http://schemas.uof.org/'>": ("UOF", None, False), "<uof xmlns='http://schemas.uof.org/'>": ("uof", "http://schemas.uof.org/", False), "": None, None: None}
    got = frame(spark, *cases).select("id", xml.root(F.col("xml")).alias("r"), xml.valid_root(F.col("xml")).alias("v")).orderBy("id").collect()
    assert [(*r["r"], r["v"]) if r["r"] else None for r in got] == list(cases.values()) and not got[-1]["v"]


def test_stories(spark):
    one = "<w:body><w:p><w:r><w:t>a\n b</w:t></w:r><w:ins w:id='1'><w:t>new</w:t></w:ins><w:rPr><w:ins/></w:rPr></w:p><w:p/><w:p><w:t> </w:t></w:p><w:sdt><w:p><w:t>in</w:t><w:txbxContent><w:p><w:t>in</w:t></w:p></w:txbxContent><w:txbxContent><w:tbl><w:tr><w:tc><w:p><w:t>box</w:t></w:p></w:tc></w:tr></w:tbl></w:txbxContent></w:p></w:sdt><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc/><w:tc><w:p><w:t>c</w:t></w:p></w:tc></w:tr></w:tbl></w:body>"
    got = xml.stories(xml.tokens(frame(spark, one, "<a/>", None), ["id"]), ["id"]).orderBy("unit", "part", "item").collect()
    assert [(r["label"], r["text"]) for r in got] == [("", "a b new".replace(" new", "new")), ("修订-插入", "new"), ("", "in"), ("文本框", "box"), ("", "\tc")]


def test_stories_take_one_shuffle(spark):
    # stacked windows over all tokens kept several sorts of a task in memory at once
    toks = xml.tokens(frame(spark, "<w:p><w:t>a</w:t></w:p>"), ["id"])
    plan = xml.stories(toks, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1


def test_stories_of_texts_equal_those_of_tokens(spark):
    box = "<w:txbxContent><w:p><w:t>{}</w:t></w:p></w:txbxContent>"
    cases = [
        "<w:p><w:t>a&#65;&#x4e00;&#38;lt;&bad;&#xD800; </w:t><w:tab a='>'/><w:t>\t\n b</w:t><w:br/></w:p>",
        "<w:p><!-- <w:p> --><?w:p?><w:ins><w:t>x</w:t><w:del><w:delText>y</w:delText></w:del></w:ins><w:ins><w:t>z</w:t></w:ins></w:p>" * 2,
        f"<w:p><w:t>one two</w:t>{box.format('two')}{box.format('three')}<w:moveFrom><w:t>m</w:t></w:moveFrom></w:p>",
        "<w:tbl><w:t>before</w:t><w:tr><w:tc><w:p><w:t>1</w:t></w:p></w:tc><w:tc/><w:tc><w:tbl><w:tr><w:tc><w:t>2</w:t></w:tc></w:tr></w:tbl></w:tc></w:tr><w:tr/><w:tr><w:tc><w:t> </w:t></w:tc></w:tr></w:tbl><w:p/><w:p><w:t>after</w:t></w:p>",
        "</w:p></w:t></w:txbxContent><w:p><w:t>lost</w:t></w:p><w:p><w:t>one more</w:t></w:p>",
        "<w:p><w:t>open <b <w:p><w:t/>< c <![CDATA[d < &amp; ]]><![CDATA[e",
        "only text",
        "",
        None,
        "<w:t>outside</w:t><w:p><w:t>x!y</w:t><w:t a=\"<w:p>\">q</w:t></w:p>",
        "<p><t>no prefix</t></p><v:p><v:t>other</v:t></v:p>",
    ]
    parts = frame(spark, *cases)
    want = sorted(map(tuple, xml.stories(xml.tokens(parts.where("xml NOT LIKE '%D800%'"), ["id"]), ["id"]).collect()))
    found = xml.text_stories(parts.coalesce(1), ["id"])
    got = sorted(map(tuple, found.collect()))
    assert [r for r in got if r[0]] == want and {r[0] for r in want} == {1, 2, 3, 5, 9, 10}
    assert [r[-1] for r in got if not r[0]] == ["aA一<&bad;\ufffd b"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_xml_stories_of_equal_ids_are_texts_apart(spark, tmp_path):
    import duckdb

    from paperloom.queries import QUERIES, SQL

    rows = [(1, " ".join("abcdefghij") + " <k> l&m"), (1, "x  y"), (2, ""), (3, None), (4, " ".join(f"w{i}" for i in range(70)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["xml_stories"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == sorted(c.execute(SQL["xml_stories"]).fetchall())
