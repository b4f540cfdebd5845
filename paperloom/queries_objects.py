"""Queries of page objects, glyph advances, vector paths, list numbers and columns; see queries.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import glyphs, grouped, layout, numbering, objects, paths, pixels, xml
from .registry import query, table
from .sources import csv

c = F.col

# ---------------------------------------------------------------- object tree

#: Words as objects: every tenth document a chain, others in threes; blocks hold others, and every eleventh its grandparent
#: again; every thirteenth leaf is in a second block.
REFS = """w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i, len(string_split(text, ' ')) AS n FROM documents),
o AS (SELECT *, doc_id % 10 = 0 AS chain, CASE WHEN i = 0 THEN NULL WHEN doc_id % 10 = 0 THEN i - 1 ELSE (i - 1) // 3 END AS up,
  CASE WHEN CASE WHEN doc_id % 10 = 0 THEN i < n - 1 ELSE 3 * i + 1 < n END THEN 'block' WHEN length(word) % 4 = 0 THEN 'text' WHEN length(word) % 4 = 1 THEN 'path' WHEN length(word) % 4 = 2 THEN 'image' ELSE 'other' END AS kind FROM w),
refs AS (SELECT doc_id, up AS parent_id, i AS object_id, length(word) AS position, kind FROM o
  UNION ALL SELECT a.doc_id, a.i, CASE WHEN chain THEN up - 1 ELSE (up - 1) // 3 END, -1, 'block' FROM o a WHERE a.kind = 'block' AND i % 11 = 5 AND up > 0
  UNION ALL SELECT doc_id, up - 1, i, 1000, kind FROM o WHERE kind <> 'block' AND i % 13 = 6 AND NOT chain AND up > 0)"""


def _refs(spark, d):
    # counted below the generator: beside it the text would be split again for each word
    words = table(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("w")).select("doc_id", "w", F.size("w").alias("n"))
    o = words.select("doc_id", "n", F.posexplode("w").alias("i", "word"))
    chain, i, up = c("doc_id") % 10 == 0, c("i"), c("up")
    o = o.withColumn("up", F.when(i == 0, F.lit(None)).when(chain, i - 1).otherwise(F.floor((i - 1) / 3).cast("int")))
    leaf = F.get(F.array(*[F.lit(x) for x in ("text", "path", "image", "other")]), F.length("word") % 4)
    o = o.withColumn("kind", F.when(F.when(chain, i < c("n") - 1).otherwise(3 * i + 1 < c("n")), "block").otherwise(leaf))
    again = o.where((c("kind") == "block") & (i % 11 == 5) & (up > 0)).select("doc_id", i, F.when(chain, up - 1).otherwise(F.floor((up - 1) / 3).cast("int")), F.lit(-1), F.lit("block"))
    shared = o.where((c("kind") != "block") & (i % 13 == 6) & ~chain & (up > 0)).select("doc_id", up - 1, i, F.lit(1000), "kind")
    rows = o.select("doc_id", up, i, F.length("word"), "kind").union(again).union(shared)
    return rows.toDF("doc_id", "parent_id", "object_id", "position", "kind").withColumn("page_no", F.lit(1))


@query("object_tree", f"""WITH RECURSIVE {REFS},
step AS (SELECT *, printf('/%06d:%08d', position + 5, object_id) AS s FROM refs),
ways AS (SELECT doc_id, object_id, kind, 0 AS depth, s AS way FROM step WHERE parent_id IS NULL
  UNION ALL SELECT r.doc_id, r.object_id, r.kind, w.depth + 1, w.way || r.s FROM ways w JOIN step r ON r.doc_id = w.doc_id AND r.parent_id = w.object_id
  WHERE w.kind = 'block' AND w.depth < 128 AND NOT contains(w.way || '/', printf(':%08d/', r.object_id))),
met AS (SELECT doc_id, object_id, min(way) AS way, arg_min(kind, way) AS kind, arg_min(depth, way) AS depth FROM ways GROUP BY 1, 2),
size AS (SELECT doc_id, count(*) AS n FROM met GROUP BY 1),
seen AS (SELECT r.*, coalesce(p.depth, -1) AS up, coalesce(p.way, '') || r.s AS way FROM step r LEFT JOIN met p ON p.doc_id = r.doc_id AND p.object_id = r.parent_id AND p.kind = 'block'
  WHERE r.parent_id IS NULL OR p.doc_id IS NOT NULL),
st AS (SELECT seen.*, CASE WHEN n > 3000 THEN 'refused' WHEN up >= 128 THEN 'too_deep' WHEN seen.way IS DISTINCT FROM m.way THEN 'repeated' WHEN seen.kind <> 'other' THEN 'kept' ELSE 'unsupported' END AS status
  FROM seen JOIN size USING (doc_id) LEFT JOIN met m ON m.doc_id = seen.doc_id AND m.object_id = seen.object_id)
SELECT doc_id, 1 AS page_no, CAST(parent_id AS INTEGER) AS parent_id, CAST(object_id AS INTEGER) AS object_id, CAST(position AS INTEGER) AS position, kind, CAST(up + 1 AS INTEGER) AS depth, status,
  CASE WHEN status = 'kept' AND kind <> 'block' THEN CAST(sum(CASE WHEN status = 'kept' AND kind <> 'block' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY way) - 1 AS INTEGER) END AS z FROM st""")
def object_tree(spark, d):
    """Objects met from the page, in document order, over trees with shared and circular references and over 128 levels."""
    return objects.object_tree(_refs(spark, d), most=3000)


# ---------------------------------------------------------------- advances and paths

LINE_TEXTS = """l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r,
    l_linenumber % 7 AS k, CAST(l_quantity AS INTEGER) AS q, l_suppkey % 60 AS s, l_partkey % 70 AS p FROM lineitem)"""


def _line_texts(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbers = [(c("l_linenumber") % 7).alias("k"), c("l_quantity").cast("int").alias("q"), (c("l_suppkey") % 60).alias("s"), (c("l_partkey") % 70).alias("p")]
    return table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("r"), *numbers)


#: One SQL expression for both: texts of advances with repeats, limits, negative counts and words that are no numbers.
ADVANCES = "CASE k WHEN 0 THEN concat(q, ' g ', p, ' ', s, '.5 ', q) WHEN 1 THEN concat('  g 3 ', s, '.25   G 2 -', p, '  ') WHEN 2 THEN concat('G 5000 ', q) WHEN 3 THEN concat(q, ' g ', p, ' 2 g 2') WHEN 4 THEN concat('g ', s - 30, ' 2.5') WHEN 5 THEN CASE WHEN p < 35 THEN '' END ELSE concat(p, '.125 x', q) END"
PATHS = """CASE k WHEN 1 THEN concat('M ', q, ' 0 L ', s, ' ', p, ' L ', p, ' ', q, ' C L 1 1') WHEN 2 THEN concat('L 5 5 M ', q, ' ', s, ' Q ', p, ' 10 ', s, ' -', q, ' L 3')
 WHEN 3 THEN concat('S ', q, ' ', s, ' B ', p, ' 1.5 2 ', s, ' 9 9 A 1 1 0 0 1 ', p, ' ', s) WHEN 4 THEN concat('M 1 Q 1 2 3 4 M ', p, ' ', p, ' L ', p, ' ', p, ' C L ', s, ' 7 M 0 0 C')
 WHEN 5 THEN concat('M ', q, ' ', q, ' CM 1 0 0 1 0 0 Z 4 L ', p, ' ', s) WHEN 6 THEN 'C L 1 2' WHEN 0 THEN NULL END"""


@query("glyph_advances", f"""WITH RECURSIVE {LINE_TEXTS},
t AS (SELECT l_orderkey, r, q - 5 AS gaps, list_filter(string_split_regex({ADVANCES}, '\\s+'), lambda w: w <> '') AS w FROM l),
f AS (SELECT l_orderkey, r, gaps, w, 1 AS i, []::DOUBLE[] AS out, false AS bad FROM t WHERE gaps > 0 AND len(w) > 0
  UNION ALL SELECT l_orderkey, r, gaps, w, i + used, CASE WHEN fine THEN out || list_transform(range(n), lambda x: v) ELSE [] END, NOT fine FROM (
    SELECT *, coalesce(n >= 0 AND v IS NOT NULL AND len(out) + n <= greatest(1024, 4 * gaps), false) AS fine FROM (
      SELECT *, CASE WHEN rep THEN 3 ELSE 1 END AS used, CASE WHEN rep THEN TRY_CAST(w[i + 1] AS INTEGER) ELSE 1 END AS n, TRY_CAST(w[CASE WHEN rep THEN i + 2 ELSE i END] AS DOUBLE) AS v
      FROM (SELECT *, lower(w[i]) = 'g' AND i + 2 <= len(w) AS rep FROM f WHERE i <= len(w) AND NOT bad)))),
e AS (SELECT * FROM f WHERE bad OR i > len(w))
SELECT t.l_orderkey, CAST(t.r AS INTEGER) AS r, CASE WHEN e.bad THEN NULL WHEN coalesce(len(out), 0) = 0 THEN '' ELSE
  array_to_string(list_transform(range(1, t.gaps + 1), lambda x: CAST(CAST(round(1000 * out[least(x, len(out))]) AS BIGINT) AS VARCHAR)), ' ') END AS thousandths
FROM t LEFT JOIN e ON e.l_orderkey = t.l_orderkey AND e.r = t.r""")
def glyph_advances(spark, d):
    """Advances by which glyphs follow each other, in thousandths; null where the text is refused."""
    texts = _line_texts(spark, d).select("l_orderkey", "r", (c("q") - 5).alias("gaps"), F.expr(ADVANCES).alias("text"))
    found = texts.select("l_orderkey", "r", paths.advances(c("text"), c("gaps")).alias("a"))
    return found.select("l_orderkey", "r", F.array_join(F.transform("a", lambda x: F.round(x * 1000).cast("bigint").cast("string")), " ").alias("thousandths"))


def _paths(spark, d):
    ctm = F.when(c("k") % 2 == 0, F.array(*[F.lit(x) for x in (1.0, 0.5, 0.0, 2.0, 3.0, 4.0)]))
    return _line_texts(spark, d).select("l_orderkey", "r", F.expr(PATHS).alias("data"), c("q").cast("double").alias("x"), c("s").cast("double").alias("y"), ctm.alias("ctm"))


PATH_OPS = f"""{LINE_TEXTS},
d AS (SELECT l_orderkey, r, k, q, s, regexp_extract_all({PATHS}, '[A-Z]+[^A-Z]*') AS ops FROM l),
o AS (SELECT l_orderkey, r, k, q, s, i, regexp_extract(ops[i], '[A-Z]+') AS op, list_transform(regexp_extract_all(ops[i], '[-0-9.]+'), lambda x: CAST(x AS DOUBLE)) AS v FROM d, unnest(range(1, len(ops) + 1)) AS g(i)),
pen AS (SELECT l_orderkey, r, 0::BIGINT AS i, '' AS op, []::DOUBLE[] AS v, NULL::DOUBLE AS px, NULL::DOUBLE AS py, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS sx, NULL::DOUBLE AS sy, 0 AS n, 0 AS steps FROM d
  UNION ALL SELECT l_orderkey, r, i, op, v, x, y, CASE WHEN ok THEN gx ELSE x END, CASE WHEN ok THEN gy ELSE y END, CASE WHEN ok AND op IN ('S', 'M') THEN gx ELSE sx END, CASE WHEN ok AND op IN ('S', 'M') THEN gy ELSE sy END,
    n + steps, CASE WHEN NOT ok OR op IN ('S', 'M') THEN 0 WHEN op = 'Q' THEN 8 WHEN op = 'B' THEN 12 ELSE 1 END FROM (
    SELECT *, coalesce(len(v) >= need AND (op IN ('S', 'M') OR x IS NOT NULL), false) AS ok, CASE WHEN op = 'C' THEN sx ELSE v[goal] END AS gx, CASE WHEN op = 'C' THEN sy ELSE v[goal + 1] END AS gy FROM (
      SELECT o.l_orderkey, o.r, o.i, o.op, o.v, x, y, sx, sy, n, steps, CASE o.op WHEN 'S' THEN 2 WHEN 'M' THEN 2 WHEN 'L' THEN 2 WHEN 'Q' THEN 4 WHEN 'B' THEN 6 WHEN 'A' THEN 7 WHEN 'C' THEN 0 END AS need,
        CASE o.op WHEN 'Q' THEN 3 WHEN 'B' THEN 5 WHEN 'A' THEN 6 ELSE 1 END AS goal FROM pen JOIN o ON o.l_orderkey = pen.l_orderkey AND o.r = pen.r AND o.i = pen.i + 1))),"""


@query("path_lines", f"""WITH RECURSIVE {PATH_OPS}
b AS (SELECT pen.*, j, n + j - 1 AS segment FROM pen, unnest(generate_series(1, steps)) AS g(j)),
t AS (SELECT *, (j - 1) / CAST(steps AS DOUBLE) AS t0, j / CAST(steps AS DOUBLE) AS t1 FROM b),
u AS (SELECT *, 1.0::DOUBLE - t0 AS i0, 1.0::DOUBLE - t1 AS i1 FROM t),
e AS (SELECT l_orderkey, r, segment, {", ".join(
    f"CASE op WHEN 'Q' THEN i{e} * i{e} * p{a} + 2.0::DOUBLE * i{e} * t{e} * v[{k}] + t{e} * t{e} * {a} WHEN 'B' THEN i{e} * i{e} * i{e} * p{a} + 3.0::DOUBLE * i{e} * i{e} * t{e} * v[{k}] + 3.0::DOUBLE * i{e} * t{e} * t{e} * v[{k + 2}] + t{e} * t{e} * t{e} * {a} ELSE {('p' + a) if e == 0 else a} END AS {a}{e}"
    for e in (0, 1) for a, k in (("x", 1), ("y", 2)))} FROM u),
m AS (SELECT e.l_orderkey, e.r, segment, {", ".join(
    f"q + CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE * x{e} + 0.0::DOUBLE * y{e} + 3.0::DOUBLE ELSE x{e} END AS x{e + 1}, s + CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE * x{e} + 2.0::DOUBLE * y{e} + 4.0::DOUBLE ELSE y{e} END AS y{e + 1}" for e in (0, 1))}
  FROM e JOIN l ON l.l_orderkey = e.l_orderkey AND l.r = e.r)
SELECT l_orderkey, CAST(r AS INTEGER) AS r, CAST(segment AS INTEGER) AS segment, {", ".join(f"CAST(round(1000 * {x}) AS BIGINT) AS {x}" for x in ("x1", "y1", "x2", "y2"))} FROM m WHERE sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) > 0.001""")  # fmt: skip
def path_lines(spark, d):
    """Straight pieces of paths made from line items, in thousandths."""
    lines = paths.path_lines(_paths(spark, d), ["l_orderkey", "r"])
    return lines.select("l_orderkey", "r", "segment", *[F.round(c(x) * 1000).cast("bigint").alias(x) for x in ("x1", "y1", "x2", "y2")])


@query("path_warnings", f"""WITH RECURSIVE {PATH_OPS}
w AS (SELECT l_orderkey, r, CASE WHEN op = 'A' AND steps > 0 THEN 'ARC_AS_CHORD' WHEN op = 'CM' THEN 'CM' WHEN op NOT IN ('S', 'M', 'L', 'Q', 'B', 'A', 'C', '') THEN 'UNKNOWN' END AS code FROM pen)
SELECT l_orderkey, CAST(r AS INTEGER) AS r, code, count(*) AS n FROM w WHERE code IS NOT NULL GROUP BY 1, 2, 3""")
def path_warnings(spark, d):
    return paths.path_warnings(_paths(spark, d), ["l_orderkey", "r"])


# ---------------------------------------------------------------- list numbers

PARAGRAPHS = """p AS (SELECT l_partkey AS doc_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS seq,
  CASE WHEN CAST(l_quantity AS INTEGER) % 11 <> 0 THEN l_suppkey % 5 END AS num_id, CASE WHEN l_linenumber = 5 THEN '' WHEN CAST(l_quantity AS INTEGER) % 9 = 0 THEN '1' ELSE '0' END AS level FROM lineitem)"""


@query("numbering_repair", f"""WITH RECURSIVE {PARAGRAPHS},
s AS (SELECT doc_id, seq, num_id, CASE WHEN level = '' THEN '0' ELSE level END AS level, (doc_id + num_id) % 2 = 0 AND level <> '1' AS restart,
  CASE WHEN num_id = 4 AND doc_id % 2 = 0 THEN NULL WHEN level = '1' THEN CASE num_id % 2 WHEN 0 THEN '<l><a/></l>' ELSE '<l><b/></l>' END WHEN num_id IS NOT NULL THEN '<l><n/></l>' END AS sig FROM p),
f AS (SELECT doc_id, 0::BIGINT AS seq, NULL::BIGINT AS num_id, []::BIGINT[] AS seen, NULL::BIGINT AS fixed, NULL::VARCHAR AS plevel, NULL::VARCHAR AS psig, false AS prun FROM (SELECT DISTINCT doc_id FROM p)
  UNION ALL SELECT doc_id, seq, num_id, CASE WHEN has THEN list_append(seen, num_id) ELSE seen END, CASE WHEN goes THEN fixed WHEN has THEN num_id END, CASE WHEN has THEN level END, CASE WHEN has THEN sig END,
    goes OR (has AND restart AND NOT list_contains(seen, num_id)) FROM (
    SELECT *, coalesce(has AND prun AND plevel = level AND psig = sig AND fixed <> num_id AND list_contains(seen, num_id), false) AS goes FROM (
      SELECT s.doc_id, s.seq, s.num_id, s.level, s.sig, s.restart, seen, fixed, plevel, psig, prun, s.num_id IS NOT NULL AND s.sig IS NOT NULL AS has FROM f JOIN s ON s.doc_id = f.doc_id AND s.seq = f.seq + 1)))
SELECT doc_id, CAST(seq AS INTEGER) AS seq, num_id, fixed AS fixed_num_id FROM f WHERE seq > 0""")
def numbering_repair(spark, d):
    """Paragraphs of lists whose numbers, levels and overrides come from a document's numbering tables."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    q = c("l_quantity").cast("int")
    level = F.when(c("l_linenumber") == 5, "").when(q % 9 == 0, "1").otherwise("0")
    lines = grouped.dealt_by_rows(table(spark, d, "lineitem"), ["l_partkey"])
    p = lines.select(c("l_partkey").alias("doc_id"), F.row_number().over(order).alias("seq"), F.when(q % 11 != 0, c("l_suppkey") % 5).alias("num_id"), level.alias("level"))
    used = p.where("num_id IS NOT NULL").select("doc_id", "num_id").distinct()
    nums = used.where("num_id <> 4 OR doc_id % 2 <> 0").select("doc_id", "num_id", (c("num_id") % 2).alias("abstract_id"))
    forms = F.explode(F.array(F.struct(F.lit("0").alias("level"), F.when(c("abstract_id") == 0, "<l> <n/>\n</l> ").otherwise("<l><n/></l>").alias("xml")), F.struct(F.lit("1").alias("level"), F.when(c("abstract_id") == 0, "<l><a/></l>").otherwise("<l><b/> </l>").alias("xml"))))
    levels = nums.select("doc_id", "abstract_id").distinct().select("doc_id", "abstract_id", forms.alias("f")).select("doc_id", "abstract_id", "f.*")
    overrides = used.select("doc_id", "num_id", F.lit("0").alias("level"), (1 + (c("doc_id") + c("num_id")) % 2).alias("start"))
    return numbering.repaired_lists(numbering.numbered(p, nums, levels, overrides))


# ---------------------------------------------------------------- columns

COLUMN_BLOCKS = """w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS text, CAST(unnest(range(len(string_split(text, ' ')))) AS INTEGER) AS seq FROM documents),
b AS (SELECT doc_id, CAST(1 + (seq // 8) // 10 AS INTEGER) AS page_no, seq, seq % 8 AS col, (seq // 8) % 10 AS line FROM w WHERE text <> '')"""


@query("column_order", f"""WITH {COLUMN_BLOCKS}
SELECT doc_id, page_no, seq, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE WHEN page_no % 6 = 0 AND line >= 5 THEN 1 ELSE 0 END, CASE WHEN page_no % 3 = 0 AND line = 0 THEN 0 ELSE 1 END,
  CASE WHEN page_no % 3 = 0 AND line = 0 THEN 0 ELSE col // 4 END, line, col) AS INTEGER) AS place FROM b""")
def column_order(spark, d):
    """Pages of two columns, parts of them below a gap; on every third page a heading over both keeps columns from being cut first."""
    b = layout.word_blocks(layout.documents_together(table(spark, d, "documents").select("doc_id", "text")))
    col, line = c("seq") % 8, F.floor(c("seq") / 8) % 10
    heading = c("page_no") % 3 == 0
    x = c("x") + F.when(col >= 4, 30.0).otherwise(0.0)
    y = c("y") + F.when(heading & (line > 0), 12.0).otherwise(0.0) + F.when((c("page_no") % 2 == 0) & (line >= 5), 20.0).otherwise(0.0)
    width = F.when(heading & (line == 0), 230.0 - x).otherwise(c("width"))
    units = b.select("doc_id", "page_no", "seq", x.alias("x"), y.alias("y"), width.alias("width"), "height")
    return layout.reading_order(units, together=True).select("doc_id", "page_no", "seq", "place")


# ---------------------------------------------------------------- logical records


@query("csv_records", """WITH l AS (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS row_no, l_linenumber AS k, l_returnflag,
  CASE l_suppkey % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END AS d FROM lineitem)
SELECT l_suppkey, CAST(row_no AS BIGINT) AS row_no, d AS delimiter, CAST(CASE WHEN k % 5 = 0 THEN 4 WHEN k % 5 = 1 THEN 1 ELSE 3 END AS INTEGER) AS n,
  CASE WHEN k % 5 = 1 THEN '' ELSE l_orderkey || '~a' || d || ',;|"' || k || '"' || CASE WHEN k % 3 = 0 THEN chr(10) ELSE '' END || 'z~' || l_returnflag || CASE WHEN k % 5 = 0 THEN '~' ELSE '' END END AS cells FROM l""")
def csv_records(spark, d):
    """Files of a supplier's line items: ragged and blank records, quotes, delimiters and line ends in cells, over 32 records."""
    at = c("l_suppkey") % 4
    sep = F.coalesce(*[F.when(at == i, x) for i, x in enumerate(csv.DELIMITERS)])
    odd = F.concat(F.lit("a"), sep, F.lit(',;|"'), c("l_linenumber").cast("string"), F.lit('"'), F.when(c("l_linenumber") % 3 == 0, "\r\n").otherwise(""), F.lit("z"))
    cells = F.array(c("l_orderkey").cast("string"), odd, c("l_returnflag"))
    cells = F.when(c("l_linenumber") % 5 == 0, F.array_append(cells, "")).when(c("l_linenumber") % 5 == 1, F.array(F.lit(""))).otherwise(cells)
    line = F.coalesce(*[F.when(at == i, X.csv_line(cells, x)) for i, x in enumerate(csv.DELIMITERS)])
    lines = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", line.alias("line")))).alias("l"))
    files = lines.select("l_suppkey", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\r\n"), F.lit("\n")).alias("text"))
    found = files.select("l_suppkey", csv.detected_delimiter(c("text")).alias("delimiter"))
    rows = csv.csv_rows(files, "l_suppkey")
    return rows.join(found, "l_suppkey").select("l_suppkey", "row_no", "delimiter", F.size("cells").alias("n"), F.array_join("cells", "~").alias("cells"))


# ---------------------------------------------------------------- XML

#: Eight words `w`, the last of them fewer, as a paragraph (with revisions and a text box) or, every fourth, as a table.
WORDS = [f"replace(replace(coalesce(get(w, {i}), ''), '&', '&amp;'), '<', '&lt;')" for i in range(7)]
PARAGRAPH = (
    "CASE WHEN n % 4 = 3 THEN concat('<w:tbl><w:tr><w:tc><w:p><w:t>', {0}, '</w:t></w:p><w:p><w:t>', {1}, '</w:t></w:p></w:tc><w:tc/><w:tc><w:p/></w:tc><w:tc><w:tbl><w:tr><w:tc><w:p><w:t>', {2}, '</w:t></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr><w:tr><w:tc><w:p><w:t>', {3},"
    " '</w:t></w:p></w:tc></w:tr></w:tbl>') ELSE concat('<w:p w:a=\"x>y\"><!-- <w:p> --><w:r><w:t xml:space=\"preserve\">', {0}, ' </w:t><w:tab/><w:t>', {1}, '&#33;</w:t></w:r><w:ins w:id=\"1\"><w:r><w:t>', {2}, '</w:t></w:r></w:ins><w:del><w:delText> ', {3}, '</w:delText></w:del><w:br/>',"
    " '<w:moveTo><w:t>', {4}, '</w:t></w:moveTo><w:pict><w:txbxContent><w:p><w:t>', {5}, '</w:t></w:p><w:p><w:t>&#x4e00;', {6}, '</w:t></w:p></w:txbxContent></w:pict><w:t><![CDATA[<', coalesce(get(w, 7), ''), ']]></w:t></w:p>') END"
).format(*WORDS)
WORDS_SQL = """w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
n AS (SELECT doc_id, CAST(k AS INTEGER) AS n, """ + ", ".join(f"coalesce(w[8 * k + {i + 1}], '') AS w{i}" for i in range(8)) + " FROM w, unnest(range((len(w) + 7) // 8)) AS g(k))"


def _eights(spark, d):
    """doc_id, g: a document's words in eights; only its text is shuffled, so that few files are no few tasks."""
    eights = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) + 7) / 8).cast("int") - 1), lambda n: F.slice(w, n * 8 + 1, F.lit(8)))
    texts = grouped.dealt(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])
    # in an array of one, so that a text is split once and not again for each eight
    return texts.select("doc_id", F.transform(F.array(F.split("text", " ", -1)), eights)[0].alias("g"))


def _paragraphs(spark, d):
    """The paragraphs as rows."""
    return _eights(spark, d).select("doc_id", F.posexplode("g").alias("n", "w")).select("doc_id", "n", F.expr(PARAGRAPH).alias("xml"))


def _bodies(spark, d):
    """doc_id, xml: the paragraphs of each document as one text, made within its row."""
    body = F.expr(f"array_join(transform(g, (w, n) -> {PARAGRAPH}), '\\n')")
    return _eights(spark, d).select("doc_id", F.concat(F.lit('<?xml version="1.0"?><w:document><w:body>'), body, F.lit("</w:body></w:document>")).alias("xml"))


LINE = "trim(regexp_replace(regexp_replace({0}, '[\\r\\n]', ' ', 'g'), '[ \\t]+', ' ', 'g'))"


@query("xml_stories", f"""WITH {WORDS_SQL},
t AS (SELECT *, {LINE.format("w0 || ' ' || chr(9) || w1 || '!' || w2 || ' ' || w3 || ' ' || w4 || '<' || w7")} AS body, {LINE.format("w5 || chr(19968) || w6")} AS box FROM n),
l AS (SELECT doc_id, n, 0 AS part, 0 AS item, '' AS label, body AS text FROM t WHERE n % 4 <> 3
  UNION ALL SELECT doc_id, n, 1, 1, '文本框', box FROM t WHERE n % 4 <> 3 AND NOT contains(body, box)
  UNION ALL SELECT doc_id, n, 2, 1, '修订-插入', {LINE.format("w2")} FROM t WHERE n % 4 <> 3
  UNION ALL SELECT doc_id, n, 3, 1, '修订-删除', {LINE.format("w3")} FROM t WHERE n % 4 <> 3
  UNION ALL SELECT doc_id, n, 5, 1, '修订-移入', {LINE.format("w4")} FROM t WHERE n % 4 <> 3
  UNION ALL SELECT doc_id, n, 0, 1, '', CASE WHEN {LINE.format("w0 || w1 || w2")} <> '' THEN {LINE.format("w0 || ' ' || w1")} || chr(9) || chr(9) || chr(9) || {LINE.format("w2")} ELSE '' END FROM t WHERE n % 4 = 3
  UNION ALL SELECT doc_id, n, 0, 2, '', {LINE.format("w3")} FROM t WHERE n % 4 = 3)
SELECT doc_id, CAST(n + 1 AS BIGINT) AS unit, CAST(part AS INTEGER) AS part, CAST(item AS INTEGER) AS item, label, text FROM l WHERE text <> ''""")
def xml_stories(spark, d):
    """Lines of word-processing XML made of all words: paragraphs, revisions, text boxes and nested tables."""
    return xml.text_stories(_bodies(spark, d), ["doc_id"])


@query("xml_roots", """WITH t AS (SELECT page_id, page_id % 8 AS k, coalesce(url, '') AS u FROM pages)
SELECT page_id, CASE k WHEN 7 THEN NULL WHEN 6 THEN 'UOX' ELSE 'UOF' END AS name, CASE WHEN k IN (0, 1, 2, 5, 6) THEN 'http://schemas.uof.org/' || u WHEN k = 3 THEN 'urn:' || u END AS namespace,
  k IN (0, 1, 2, 5) AS valid, k IN (0, 1, 2, 3, 6) AS well_formed FROM t""")
def xml_roots(spark, d):
    """Root names and namespaces of made documents: prefixes, quotes, comments, missing roots and unclosed elements."""
    u = F.replace(F.replace(F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))
    at = F.concat(F.lit("http://schemas.uof.org/"), u)
    forms = ['<?xml version="1.0"?><uof:UOF a="1" xmlns:x="urn:x" xmlns:uof="~"><a/></uof:UOF>', "<!-- <b xmlns='urn:b'> --><UOF xmlns='~'>text<a></a></UOF>", '<UOF xmlns="~"/>', '<UOF xmlns="urn:^"></UOF>', "<UOF><a></UOF></a>", '<UOF xmlns="~"><a></UOF>', '<UOX xmlns="~"></UOX>', "only text"]
    form = F.get(F.array(*[F.lit(x) for x in forms]), (c("page_id") % 8).cast("int"))
    parts = table(spark, d, "pages").select("page_id", F.replace(F.replace(form, F.lit("~"), at), F.lit("^"), u).alias("xml"))
    found = parts.select("page_id", xml.root(c("xml")).alias("r"), xml.valid_root(c("xml")).alias("valid"))
    ok = xml.well_formed(xml.tokens(parts, ["page_id"]), ["page_id"])
    return found.join(ok, "page_id").select("page_id", c("r.name").alias("name"), xml.unescaped(c("r.namespace")).alias("namespace"), "valid", c("ok").alias("well_formed"))


# ---------------------------------------------------------------- pixels and glyphs

#: A picture for each supplier: its line items as pixels, row by row.
PIXELS = """i AS (SELECT l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, CAST(l_quantity AS BIGINT) * 5 AS r, l_partkey % 256 AS g FROM lineitem),
s AS (SELECT image_id, 17 + image_id % 9 AS width, greatest(1, count(*) // (17 + image_id % 9)) AS height, image_id % 10 AS o FROM i GROUP BY image_id),
p AS (SELECT image_id, i % width AS x, i // width AS y, r, g, width, height, o FROM i JOIN s USING (image_id) WHERE i // width < height)"""


@query("upright_pixels", f"""WITH {PIXELS},
t AS (SELECT image_id, r, g, CASE WHEN o IN (2, 3) THEN width - 1 - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN height - 1 - y ELSE x END AS x,
  CASE WHEN o IN (3, 4) THEN height - 1 - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN width - 1 - x ELSE y END AS y,
  CASE WHEN o BETWEEN 5 AND 8 THEN height ELSE width END AS w, CASE WHEN o BETWEEN 5 AND 8 THEN width ELSE height END AS h FROM p),
n AS (SELECT *, CASE WHEN greatest(w, h) <= 16 THEN w ELSE greatest(1, CAST(floor(w * 16 / greatest(w, h) + 0.5) AS BIGINT)) END AS tw, CASE WHEN greatest(w, h) <= 16 THEN h ELSE greatest(1, CAST(floor(h * 16 / greatest(w, h) + 0.5) AS BIGINT)) END AS th FROM t),
m AS (SELECT *, (least((x + 1) * tw, (a + 1) * w) - greatest(x * tw, a * w)) * (least((y + 1) * th, (b + 1) * h) - greatest(y * th, b * h)) AS part FROM n, range(16) AS ca(a), range(16) AS cb(b)
  WHERE a < tw AND b < th AND x * tw < (a + 1) * w AND (x + 1) * tw > a * w AND y * th < (b + 1) * h AND (y + 1) * th > b * h)
SELECT image_id, CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y, CAST(floor(sum(part * r) / sum(part) + 0.5) AS INTEGER) AS r, CAST(floor(sum(part * g) / sum(part) + 0.5) AS INTEGER) AS g FROM m GROUP BY 1, 2, 3""")
def upright_pixels(spark, d):
    """Pictures in all orientations, upright and at most 16 pixels long."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    lines = grouped.dealt_by_rows(table(spark, d, "lineitem"), ["l_suppkey"])
    i = lines.select(c("l_suppkey").alias("image_id"), (F.row_number().over(order) - 1).alias("i"), (c("l_quantity").cast("bigint") * 5).alias("r"), (c("l_partkey") % 256).alias("g"))
    width = (17 + c("image_id") % 9).cast("int")
    s = i.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).select("image_id", width.alias("width"), F.greatest(F.lit(1), F.floor(c("n") / width)).cast("int").alias("height"), (c("image_id") % 10).cast("int").alias("orientation"))
    p = i.select("image_id", (c("i") % width).alias("x"), F.floor(c("i") / width).cast("int").alias("y"), "r", "g")
    return pixels.reduced(*pixels.turned(p, s), 16)[0]


@query("displayed_runs", """WITH g AS (SELECT l_suppkey AS doc_id, row_number() OVER w AS seq, l_partkey % 500 + 0.25 AS x, l_orderkey % 700 + 0.5 AS y, 1 + l_linenumber AS width, 2 + CAST(l_quantity AS INTEGER) % 7 AS height, l_returnflag AS family,
    [0, 0.05, 90, 33, 180, 270][(row_number() OVER w) // 6 % 6 + 1] AS direction, CAST(l_linenumber AS VARCHAR) AS ch FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
n AS (SELECT *, CASE WHEN family = lag(family) OVER w AND abs(direction - lag(direction) OVER w) < 0.1 THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY seq) AS run_no, 1 + doc_id % 2 * 0.5 AS unit, doc_id % 4 * 90 AS turn FROM n),
a AS (SELECT *, (turn - last_value(direction) OVER (PARTITION BY doc_id, run_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + 360) % 360 AS degrees FROM r),
e AS (SELECT doc_id, run_no, string_agg(ch, '' ORDER BY seq) AS text, any_value(degrees) AS degrees, min(unit * (x * cos(radians(degrees)) + y * sin(radians(degrees)))) AS a, max(unit * (x * cos(radians(degrees)) + y * sin(radians(degrees)) + width)) AS b,
  min(unit * (x * sin(radians(degrees)) - y * cos(radians(degrees)))) AS c, max(unit * (x * sin(radians(degrees)) - y * cos(radians(degrees)) + height)) AS d, avg(unit * y) AS base FROM a GROUP BY 1, 2)
SELECT doc_id, CAST(run_no AS INTEGER) AS run_no, text, CAST(round(1000000 * degrees) AS BIGINT) AS degrees, CAST(round(1000000 * 25.4 / 72 * (cos(radians(degrees)) * (a + b) / 2 + sin(radians(degrees)) * (c + d) / 2 - (b - a) / 2)) AS BIGINT) AS x,
  CAST(round(1000000 * 25.4 / 72 * (sin(radians(degrees)) * (a + b) / 2 - cos(radians(degrees)) * (c + d) / 2 - (d - c) / 2)) AS BIGINT) AS y, CAST(round(1000000 * 25.4 / 72 * (b - a)) AS BIGINT) AS width, CAST(round(1000000 * 25.4 / 72 * (d - c)) AS BIGINT) AS height,
  CAST(round(1000000 * 25.4 / 72 * base) AS BIGINT) AS baseline FROM e""")
def displayed_runs(spark, d):
    """Glyphs in six directions on pages of four rotations and two units, boxes in millionths of a millimetre."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    seq = F.row_number().over(order)
    g = table(spark, d, "lineitem").select(c("l_suppkey").alias("doc_id"), F.lit(1).alias("page_no"), seq.alias("seq"), (c("l_partkey") % 500 + 0.25).alias("x"), (c("l_orderkey") % 700 + 0.5).alias("y"), (1 + c("l_linenumber")).cast("double").alias("width"),
        (2 + c("l_quantity").cast("int") % 7).cast("double").alias("height"), c("l_returnflag").alias("family"), c("l_linenumber").cast("string").alias("ch"), F.lit(12.0).alias("size_pt"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("000000").alias("color"),
        F.get(F.array(*[F.lit(x) for x in (0.0, 0.05, 90.0, 33.0, 180.0, 270.0)]), (F.floor(seq / 6) % 6).cast("int")).alias("direction"))
    pages = g.select("doc_id", "page_no").distinct().select("doc_id", "page_no", (c("doc_id") % 4 * 90).alias("rotation"), (1 + c("doc_id") % 2 * 0.5).alias("user_unit"))
    millionths = [F.round(c(x)).cast("bigint").alias(x) for x in ("x", "y", "width", "height", "baseline")]
    return glyphs.displayed_runs(g, pages, 25.4 * 1_000_000).select("doc_id", "run_no", "text", F.round(c("degrees") * 1_000_000).cast("bigint").alias("degrees"), *millionths)
