"""Queries of rendering preparation, recognised pages, settings, manifests and routes that run; see queries.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import jobs, ocr, quality, rendering
from .plans.convert import convert
from .registry import query, table
from .sources import images

c = F.col

# ---------------------------------------------------------------- rendering

#: A glyph table of the visible ASCII characters: by code, every fifth is missing and every third only in the CJK font.
GLYPHS = "SELECT chr(CAST(k AS INTEGER)) AS ch, CAST(300 + k % 7 * 60 AS INTEGER) AS width, k % 3 <> 0 AS latin, k % 3 = 0 AS cjk FROM generate_series(32, 126) AS g(k) WHERE k % 5 <> 0 OR k = 63 OR k = 32"


def _glyphs(spark):
    k = spark.range(32, 127).select(c("id").cast("int").alias("k")).where("k % 5 <> 0 OR k = 63 OR k = 32")
    return k.select(F.char("k").alias("ch"), (300 + c("k") % 7 * 60).cast("int").alias("width"), (c("k") % 3 != 0).alias("latin"), (c("k") % 3 == 0).alias("cjk"))


@query("font_runs", f"""WITH g AS ({GLYPHS}), n AS (SELECT p_partkey, unnest(string_split(p_name || ' x9~', '')) AS ch, unnest(range(1, length(p_name) + 5)) AS pos FROM part),
f AS (SELECT p_partkey, pos, CASE WHEN g.ch IS NULL THEN '?' ELSE n.ch END AS ch, CASE WHEN g.ch IS NULL OR latin THEN 'latin' ELSE 'cjk' END AS font FROM n LEFT JOIN g ON n.ch = g.ch),
r AS (SELECT *, CASE WHEN lag(font) OVER w = font THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY p_partkey ORDER BY pos)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY p_partkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS run_no FROM r)
SELECT p_partkey, run_no, any_value(font) AS font, string_agg(ch, '' ORDER BY pos) AS text FROM s GROUP BY 1, 2""")
def font_runs(spark, d):
    lines = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" x9~")).alias("text"))
    return rendering.font_runs(rendering.glyphs_of(lines, ["p_partkey"], _glyphs(spark)), ["p_partkey"])


@query("line_wrap", """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS r, regexp_replace(coalesce(text, ''), '[^ -~]', 'x', 'g') AS s FROM conversations)
SELECT conv_id, turn, CAST(r AS INTEGER) AS r, CAST(k AS INTEGER) AS part_no, substr(s, CAST((k - 1) * 75 + 1 AS BIGINT), 75) AS text FROM t, unnest(generate_series(1, greatest(1, CAST(ceil(length(s) / 75.0) AS BIGINT)))) AS g(k)""")
def line_wrap(spark, d):
    """Turns in a font whose glyphs are all 600 wide: 75 of them fill a line."""
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    lines = table(spark, d, "conversations").select("conv_id", "turn", place.alias("r"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "x").alias("text"))
    glyphs = spark.range(32, 127).select(F.char("id").alias("ch"), F.lit(600).alias("width"), F.lit(True).alias("latin"), F.lit(False).alias("cjk"))
    return rendering.wrapped(lines, ["conv_id", "turn", "r"], glyphs)


@query("page_fill", """WITH l AS (SELECT user_id AS doc_id, event_type AS logical_page, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS place FROM events),
n AS (SELECT doc_id, logical_page, ceil(count(*) / 50.0) AS pages FROM l GROUP BY 1, 2),
b AS (SELECT doc_id, logical_page, coalesce(sum(pages) OVER (PARTITION BY doc_id ORDER BY logical_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT doc_id, event_id, CAST(before + place // 50 + 1 AS INTEGER) AS page_no, CAST(place % 50 + 1 AS INTEGER) AS line_on_page FROM l JOIN b USING (doc_id, logical_page)""")
def page_fill(spark, d):
    lines = table(spark, d, "events").select(c("user_id").alias("doc_id"), c("event_type").alias("logical_page"), "event_id", "ts")
    return rendering.paged(lines, ["ts", "event_id"]).select("doc_id", "event_id", "page_no", "line_on_page")


@query("table_overlay", """WITH t AS (SELECT o_orderkey AS doc_id, 2 + o_orderkey % 3 AS nr, 2 + o_custkey % 3 AS nc FROM orders),
m AS (SELECT doc_id, 0 AS r, 0 AS k, 2 AS rs, 1 AS cs FROM t UNION ALL SELECT doc_id, nr - 1, nc - 2, 1, 2 FROM t WHERE nr > 2),
o AS (SELECT doc_id, r + i AS "row", k AS col, cs AS span, CASE WHEN rs > 1 THEN CASE WHEN i = 0 THEN 'restart' ELSE 'continue' END END AS merge, i = 0 AS filled FROM m, unnest(generate_series(0, rs - 1)) AS g(i)),
f AS (SELECT doc_id, r AS "row", k AS col, 1 AS span, NULL AS merge, false AS filled FROM t, unnest(generate_series(0, nr - 1)) AS a(r), unnest(generate_series(0, nc - 1)) AS b(k)
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = t.doc_id AND o.row = r AND k >= o.col AND k < o.col + o.span))
SELECT doc_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, CAST(span AS INTEGER) AS span, merge, filled, CAST(span * 567 AS BIGINT) AS width FROM (SELECT * FROM o UNION ALL SELECT * FROM f)""")
def table_overlay(spark, d):
    """Tables of orders with a cell over two rows and, in taller ones, one over two columns; all columns are a centimetre."""
    t = table(spark, d, "orders").select(c("o_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), (2 + c("o_orderkey") % 3).cast("int").alias("nr"), (2 + c("o_custkey") % 3).cast("int").alias("nc"))
    axis = lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: i * 10.0)
    tables = t.select("doc_id", "page_no", "table_no", axis(c("nc")).alias("xs"), axis(c("nr")).alias("ys"))
    keys = ["doc_id", "page_no", "table_no"]
    tall = t.select(*keys, F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(2).alias("row_span"), F.lit(1).alias("col_span"))
    wide = t.where("nr > 2").select(*keys, (c("nr") - 1).alias("row"), (c("nc") - 2).alias("col"), F.lit(1).alias("row_span"), F.lit(2).alias("col_span"))
    return rendering.overlay_grid(tall.union(wide), tables).drop("page_no", "table_no")


@query("tolerant_boxes", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(w + greatest(1.5, f * 0.8, CASE WHEN r < 1 THEN w * (1 / r - 1) ELSE 0 END + f * 0.5), 6) AS width
FROM (SELECT *, l_quantity * 2.0 AS w, (6 + l_linenumber) * 25.4 / 72 AS f, (60 + l_partkey % 60) / 100.0 AS r FROM lineitem)""")
def tolerant_boxes(spark, d):
    width = rendering.tolerant_width(c("l_quantity") * 2.0, (6 + c("l_linenumber")).cast("double"), (60 + c("l_partkey") % 60).cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(width, 6).alias("width"))


@query("overlay_order", """WITH e AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderkey % 4 AS z, CASE o_orderkey % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'image' ELSE 'text' END AS kind, CAST(o_orderkey % 90 AS DOUBLE) AS x FROM orders),
k AS (SELECT * FROM e WHERE NOT (x + 5 BETWEEN 29.75 AND 60.25))
SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY z, CASE kind WHEN 'line' THEN 1 WHEN 'image' THEN 2 ELSE 3 END, seq) AS INTEGER) AS place FROM k""")
def overlay_order(spark, d):
    """What lies in a page's table (x from 30 to 60) is dropped, the rest painted in order."""
    o, num = table(spark, d, "orders"), F.lit
    kind = F.element_at(F.array(num("line"), num("image"), num("text")), (c("o_orderkey") % 3 + 1).cast("int"))
    e = o.select(c("o_custkey").alias("doc_id"), num(1).alias("page_no"), c("o_orderkey").alias("seq"), (c("o_orderkey") % 4).alias("z"), kind.alias("kind"), (c("o_orderkey") % 90).cast("double").alias("x"), num(0.0).alias("y"), num(10.0).alias("width"), num(4.0).alias("height"))
    t = o.select(c("o_custkey").alias("doc_id"), num(1).alias("page_no"), num(30.0).alias("x"), num(0.0).alias("y"), num(30.0).alias("width"), num(50.0).alias("height")).distinct()
    return rendering.overlay(e, t).select("doc_id", "seq", "place")


# ---------------------------------------------------------------- recognised pages

W_SQL = "w AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS page_no, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS seq, CASE WHEN l_returnflag = 'R' THEN 'OCR_REQUIRED' WHEN l_returnflag = 'A' THEN 'FONT_SUBSTITUTED' ELSE 'IMAGE_EXTRACTION_FAILED' END AS code FROM lineitem)"


def _warnings(spark, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    code = F.when(c("l_returnflag") == "R", "OCR_REQUIRED").when(c("l_returnflag") == "A", "FONT_SUBSTITUTED").otherwise("IMAGE_EXTRACTION_FAILED")
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").cast("int").alias("page_no"), place.alias("seq"), code.alias("code"))


@query("ocr_page_warnings", f"""WITH {W_SQL}, n AS (SELECT DISTINCT doc_id, page_no FROM w WHERE code = 'OCR_REQUIRED')
SELECT doc_id, page_no, code FROM w WHERE code <> 'OCR_REQUIRED' UNION ALL SELECT doc_id, page_no, 'OCR_LOW_CONFIDENCE' FROM n WHERE page_no % 2 = 0""")
def ocr_page_warnings(spark, d):
    """Recognition takes the place of its demand; notes on pages that did not ask for it are left out."""
    w = _warnings(spark, d)
    notes = w.where("page_no % 2 = 0").select("doc_id", "page_no").distinct().withColumn("code", F.lit("OCR_LOW_CONFIDENCE"))
    none = w.limit(0).select("doc_id", "page_no", c("seq").alias("image_no"), "seq")
    return ocr.recognised_pages(w.limit(0).select("doc_id", "page_no", "seq"), w.select("doc_id", "page_no", "code"), none, notes)[1]


@query("ocr_page_blocks", f"""WITH {W_SQL}, n AS (SELECT DISTINCT doc_id, page_no FROM w WHERE code = 'OCR_REQUIRED'),
b AS (SELECT doc_id, page_no, seq, 0 AS origin FROM w UNION ALL SELECT w.doc_id, w.page_no, w.seq, 1 FROM w SEMI JOIN n ON w.doc_id = n.doc_id AND w.page_no = n.page_no)
SELECT doc_id, page_no, seq, origin, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY origin, seq) AS INTEGER) AS place FROM b""")
def ocr_page_blocks(spark, d):
    w = _warnings(spark, d)
    words = w.select("doc_id", "page_no", F.lit(1).alias("image_no"), "seq")
    found = ocr.recognised_pages(w.select("doc_id", "page_no", "seq"), w, words, w.limit(0).select("doc_id", "page_no", "code"))[0]
    return found.select("doc_id", "page_no", "seq", "origin", "place")


@query("ocr_images", f"""WITH {W_SQL}, n AS (SELECT DISTINCT doc_id, page_no FROM w WHERE code = 'OCR_REQUIRED')
SELECT w.doc_id, w.page_no, seq, CAST(row_number() OVER (PARTITION BY w.doc_id, w.page_no ORDER BY seq) AS INTEGER) AS image_no FROM w SEMI JOIN n ON w.doc_id = n.doc_id AND w.page_no = n.page_no WHERE code <> 'FONT_SUBSTITUTED' AND w.doc_id % 5 <> 0""")
def ocr_images(spark, d):
    """Every warning stands for an image: some are signatures (in either case), some empty."""
    w = _warnings(spark, d)
    pictures = w.withColumn("role", F.when(c("code") == "FONT_SUBSTITUTED", "Signature").otherwise("PICTURE")).withColumn("data", F.when(c("doc_id") % 5 == 0, "").otherwise("x").cast("binary"))
    return ocr.images_to_recognise(pictures, w).select("doc_id", "page_no", "seq", "image_no")


@query("ocr_unavailable", f"WITH {W_SQL} SELECT DISTINCT doc_id, page_no, CASE doc_id % 3 WHEN 1 THEN 'OCR_ENGINE_UNAVAILABLE' ELSE 'OCR_LANGUAGE_MISSING' END AS error_code FROM w WHERE code = 'OCR_REQUIRED' AND doc_id % 3 > 0")
def ocr_unavailable(spark, d):
    engine = F.when(c("doc_id") % 3 == 1, " ").when(c("doc_id") % 3 == 2, "OCR_LANGUAGE_MISSING")
    return ocr.availability_errors(_warnings(spark, d), engine)


@query("all_warnings", f"""WITH {W_SQL}, e AS (SELECT doc_id, 0 AS o, NULL AS page_no, seq + 10 * page_no AS seq, code FROM w WHERE page_no = 1 UNION ALL SELECT doc_id, 1, page_no, seq, code FROM w UNION ALL SELECT doc_id, 2, page_no, seq, code FROM w WHERE page_no > 3)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, page_no NULLS FIRST, seq) AS INTEGER) AS place, code, page_no FROM e""")
def all_warnings(spark, d):
    w = _warnings(spark, d)
    return ocr.all_warnings(w.where("page_no = 1").select("doc_id", (c("seq") + 10 * c("page_no")).alias("seq"), "code"), w, w.where("page_no > 3"))


@query("ocr_pixels", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN w * h > 25000000 THEN 'OCR_RESOURCE_EXHAUSTED' END AS image_error, CASE WHEN ceil(w / 20.0 * 300 / 25.4) * ceil(h / 20.0 * 300 / 25.4) > 25000000 THEN 'OCR_RESOURCE_EXHAUSTED' END AS page_error,
CAST(CASE WHEN greatest(w, h) <= 1600 THEN w ELSE greatest(1, floor(w * 1600.0 / greatest(w, h) + 0.5)) END AS INTEGER) AS width, CAST(CASE WHEN greatest(w, h) <= 1600 THEN h ELSE greatest(1, floor(h * 1600.0 / greatest(w, h) + 0.5)) END AS INTEGER) AS height
FROM (SELECT *, CAST(l_quantity * 170 AS BIGINT) AS w, CAST(l_suppkey % 90 * 97 + 3 AS BIGINT) AS h FROM lineitem)""")
def ocr_pixels(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_quantity") * 170).cast("long").alias("w"), (c("l_suppkey") % 90 * 97 + 3).cast("long").alias("h"))
    small = ocr.downscaled(c("w"), c("h"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ocr.ocr_pixel_error(c("w"), c("h")).alias("image_error"), ocr.render_pixel_error(c("w") / 20.0, c("h") / 20.0, F.lit(300)).alias("page_error"), small["width"].alias("width"), small["height"].alias("height"))


# ---------------------------------------------------------------- settings, logs, files


@query("settings", """WITH s AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN ' ' || (c_custkey % 700) || '.5 ' WHEN 4 THEN 'yes' ELSE 'On ' END AS v FROM customer),
n AS (SELECT c_custkey, v, trim(coalesce(v, '')) AS t, TRY_CAST(trim(v) AS DOUBLE) AS x, TRY_CAST(CASE WHEN v NOT LIKE '%.%' THEN trim(v) END AS BIGINT) AS i FROM s)
SELECT c_custkey, CASE WHEN t = '' THEN 160.0 WHEN x BETWEEN 36 AND 600 THEN x END AS dpi, CASE WHEN t <> '' AND NOT coalesce(x BETWEEN 36 AND 600, false) THEN 'INVALID_SETTING' END AS dpi_error,
CAST(CASE WHEN t = '' THEN 2 WHEN i BETWEEN 1 AND 64 THEN i END AS INTEGER) AS slots, CASE WHEN t <> '' AND NOT coalesce(i BETWEEN 1 AND 64, false) THEN 'INVALID_SETTING' END AS slots_error, lower(t) IN ('1', 'true', 'yes', 'on') AS switched FROM n""")
def settings(spark, d):
    k = c("c_custkey")
    v = F.when(k % 6 == 1, "  ").when(k % 6 == 2, k.cast("string")).when(k % 6 == 3, F.concat(F.lit(" "), (k % 700).cast("string"), F.lit(".5 "))).when(k % 6 == 4, "yes").when(k % 6 == 5, "On ")
    dpi, slots = jobs.dpi_setting(v), jobs.bounded_setting(v, 2, 1, 64)
    return table(spark, d, "customer").select(k, dpi["value"].alias("dpi"), dpi["error"].alias("dpi_error"), slots["value"].alias("slots"), slots["error"].alias("slots_error"), jobs.enabled(v).alias("switched"))


@query("density", "SELECT c_custkey, CAST(greatest(1, floor(x / 0.0254 + 0.5)) AS INTEGER) AS png, CAST(least(65535, greatest(1, floor(x + 0.5))) AS INTEGER) AS jpeg FROM (SELECT c_custkey, c_custkey * 0.25::DOUBLE + 0.125 AS x FROM customer)")
def density(spark, d):
    dpi = (c("c_custkey") * 0.25 + 0.125).cast("double")
    return table(spark, d, "customer").select("c_custkey", images.png_density(dpi).alias("png"), images.jpeg_density(dpi).alias("jpeg"))


@query("captured_log", "SELECT page_id, length(h) > 4000 AS truncated, substr(h, 1, 4000) AS kept FROM (SELECT page_id, hex(encode(html)) AS h FROM pages)")
def captured_log(spark, d):
    """Pages as a process's output, cut at 2,000 bytes."""
    out = jobs.captured(c("html").cast("binary"), 2000)
    return table(spark, d, "pages").select("page_id", out["truncated"].alias("truncated"), F.hex(out["kept"]).alias("kept"))


@query("page_files", """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 4 THEN 'cover.png' ELSE 'page-' || (CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE '' END) || l_linenumber * 7 % 12 || '.png' END AS name FROM lineitem),
n AS (SELECT *, CASE WHEN name = 'cover.png' THEN NULL ELSE CAST(regexp_extract(name, '-([0-9]+)[.]', 1) AS INTEGER) END AS number FROM f)
SELECT l_orderkey, l_partkey, l_suppkey, name, number, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY number NULLS LAST, name, l_partkey, l_suppkey, l_linenumber) AS INTEGER) AS place FROM n""")
def page_files(spark, d):
    k = c("l_linenumber")
    name = F.when(k == 4, "cover.png").otherwise(F.concat(F.lit("page-"), F.when(k % 2 == 0, "0").otherwise(""), (k * 7 % 12).cast("string"), F.lit(".png")))
    rows = table(spark, d, "lineitem").withColumn("name", name).withColumn("number", jobs.page_file_number(c("name")))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("number"), "name", "l_partkey", "l_suppkey", "l_linenumber"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "name", "number", place.alias("place"))


@query("entry_names", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'result' WHEN 1 THEN 'a_b_' || c_custkey || '.pdf' WHEN 2 THEN 'result' ELSE c_name END AS name FROM customer")
def entry_names(spark, d):
    name = F.element_at(F.array(F.lit("x/.."), F.concat(F.lit("dir\\a?b:"), c("c_custkey").cast("string"), F.lit(".pdf")), F.lit(" / "), F.concat(F.lit("/tmp/"), c("c_name"))), (c("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", X.entry_name(name).alias("name"))


# ---------------------------------------------------------------- tasks


def _tasks(spark, d):
    status = F.element_at(F.array(*[F.lit(s) for s in jobs.STATUSES]), (c("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("task_id"), status.alias("status"), (c("o_custkey") % 100).cast("int").alias("progress"), F.lit(None).cast("string").alias("error_code"), F.to_timestamp_ltz(F.concat(F.lit("2024-01-0"), (1 + c("o_orderkey") % 3).cast("string"), F.lit(" 12:00:00"))).alias("expires_at"))


STATUS_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'WAITING' WHEN 1 THEN 'CONVERTING' WHEN 2 THEN 'SUCCESS' WHEN 3 THEN 'FAILED' ELSE 'CANCELLED' END"


@query("manifest_recovery", f"""SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderkey % 5 < 2 THEN 'FAILED' ELSE {STATUS_SQL} END AS status, CAST(CASE WHEN o_orderkey % 5 < 2 THEN 100 ELSE o_custkey % 100 END AS INTEGER) AS progress, CASE WHEN o_orderkey % 5 < 2 THEN 'SERVICE_RESTARTED' END AS error_code
FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 7 > 0""")
def manifest_recovery(spark, d):
    """Tasks as JSON manifests, some cut off, read again on the second of January: expired and broken ones go."""
    t = _tasks(spark, d)
    m = jobs.manifest(t).withColumn("json", F.when(c("task_id").cast("long") % 7 == 0, F.substring("json", 1, 9)).otherwise(c("json")))
    return jobs.from_manifests(m, t.schema, F.to_timestamp_ltz(F.lit("2024-01-02 00:00:00"))).select("task_id", "status", "progress", "error_code")


@query("task_creation", """SELECT md5('create:' || l_orderkey) AS id, count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT) * 3000000) AS BIGINT) AS bytes, CASE WHEN l_orderkey % 9 = 0 THEN 'TARGET_REQUIRED' WHEN sum(CAST(l_quantity AS BIGINT) * 3000000) > 262144000 THEN 'TASK_UPLOAD_LIMIT_EXCEEDED' END AS error_code,
CASE WHEN l_orderkey % 9 = 0 OR sum(CAST(l_quantity AS BIGINT) * 3000000) > 262144000 THEN 'FAILED' ELSE 'WAITING' END AS status FROM lineitem GROUP BY l_orderkey""")
def task_creation(spark, d):
    u = table(spark, d, "lineitem").select(c("l_orderkey").alias("request_id"), c("l_linenumber").alias("idx"), (c("l_quantity").cast("long") * 3_000_000).alias("size"), F.when(c("l_orderkey") % 9 > 0, "pdf").alias("target"))
    return jobs.created(u).select(F.replace("task_id", F.lit("-"), F.lit("")).alias("id"), "files", "bytes", "error_code", "status")


@query("task_retry", f"SELECT CAST(o_orderkey AS VARCHAR) AS retry_of, md5('retry 1:' || o_orderkey) AS id, 'WAITING' AS status, count(*) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {STATUS_SQL} IN ('FAILED', 'CANCELLED') GROUP BY o_orderkey")
def task_retry(spark, d):
    files = table(spark, d, "lineitem").select(c("l_orderkey").cast("string").alias("task_id"), c("l_linenumber").alias("idx"))
    again, copies = jobs.retried(_tasks(spark, d), files)
    return again.join(copies.groupBy("task_id").agg(F.count(F.lit(1)).alias("files")), "task_id").select("retry_of", F.replace("task_id", F.lit("-"), F.lit("")).alias("id"), "status", "files")


@query("task_downloads", f"SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_custkey % 2 = 0 THEN 'all.zip' ELSE 'one.pdf' END AS download_name, CASE WHEN o_custkey % 2 = 0 THEN 'application/zip' ELSE 'application/pdf' END AS content_type FROM orders WHERE {STATUS_SQL} = 'SUCCESS' AND o_custkey % 11 > 0")
def task_downloads(spark, d):
    name = F.when(c("o_custkey") % 11 > 0, F.when(c("o_custkey") % 2 == 0, "all.zip").otherwise("one.pdf"))
    t = table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("task_id"), name.alias("download_name"), F.lit("pdf").alias("target")).join(_tasks(spark, d).select("task_id", "status"), "task_id")
    return jobs.downloads(t, F.create_map(F.lit("pdf"), F.lit("application/pdf")))


@query("task_deletion", "SELECT CAST(o_orderkey AS VARCHAR) AS task_id, 'stays' AS what FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT 'u' || c_custkey, 'unknown' FROM customer")
def task_deletion(spark, d):
    t = _tasks(spark, d)
    ids = t.where(c("task_id").cast("long") % 4 == 0).select("task_id").union(table(spark, d, "customer").select(F.concat(F.lit("u"), c("c_custkey").cast("string"))))
    stays, unknown = jobs.deleted(t, ids)
    return stays.select("task_id", F.lit("stays").alias("what")).union(unknown.select("task_id", F.lit("unknown")))


@query("raster_gate", """WITH p AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS w, CAST(l_quantity AS INTEGER) + CASE WHEN l_partkey % 17 = 0 THEN 2 ELSE l_partkey % 3 - 1 END AS e, l_suppkey % 41 = 0 AS blank, l_extendedprice AS s, l_quantity * 259 AS n, l_linenumber = 7 AS lone FROM lineitem)
SELECT l_orderkey, NOT bool_or(lone) AS pages_match, bool_and(NOT lone AND abs(w - e) <= 1) AS sizes_match, bool_and(NOT blank) AS no_blank, round(sum(s) / sum(n), 6) AS mean_error,
 NOT bool_or(lone) AND bool_and(NOT lone AND abs(w - e) <= 1) AND bool_and(NOT blank) AND sum(s) / sum(n) <= 8.0 AS passed FROM p GROUP BY 1""")
def raster_gate(spark, d):
    w = c("l_quantity").cast("int")
    e = w + F.when(c("l_partkey") % 17 == 0, 2).otherwise(c("l_partkey") % 3 - 1)
    lone = c("l_linenumber") == 7
    p = table(spark, d, "lineitem").select("l_orderkey", w.alias("width"), w.alias("height"), F.when(~lone, e).alias("expected_width"), F.when(~lone, e).alias("expected_height"), (c("l_suppkey") % 41 == 0).alias("blank"), c("l_extendedprice").alias("error_sum"), (c("l_quantity") * 259).alias("values"))
    return quality.raster_gate(p, ["l_orderkey"]).withColumn("mean_error", F.round("mean_error", 6))


# ---------------------------------------------------------------- routes that run, there and back


@query("route_csv_xlsx_csv", "SELECT c_custkey AS file_id, c_name || ',' || c_mktsegment || ',' || c_nationkey || chr(13) || chr(10) || 'x,,\"a,\"\"b\"\"\"' || chr(13) || chr(10) AS text FROM customer")
def route_csv_xlsx_csv(spark, d):
    """A CSV file of each customer, as a workbook and back."""
    text = F.concat(F.concat_ws(",", "c_name", "c_mktsegment", c("c_nationkey").cast("string")), F.lit('\nx,,"a,""b"""\n'))
    files = table(spark, d, "customer").select(c("c_custkey").alias("file_id"), F.encode(text, "UTF-8").alias("content"))
    back = convert(convert(files, "csv", "xlsx"), "xlsx", "csv")
    return back.select("file_id", F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", "").alias("text"))


@query("route_txt_docx_txt", "SELECT page_id AS file_id, 'page ' || page_id || chr(10) || 'second line' AS text FROM pages")
def route_txt_docx_txt(spark, d):
    text = F.concat(F.lit("page "), c("page_id").cast("string"), F.lit("\nsecond line"))
    files = table(spark, d, "pages").select(c("page_id").alias("file_id"), F.encode(text, "UTF-8").alias("content"))
    return convert(convert(files, "txt", "docx"), "docx", "txt").select("file_id", F.rtrim(F.regexp_replace("text", "\n+$", "")).alias("text"))
