import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import sharding
from paperloom.llm.sharding import place, write_shards


def plain(rows, shards):
    """(key, size) in order -> (shard, slot, start), by the rule read from the contract."""
    every, start, out, seen = sum(n for _, n in rows), 0, [], {}
    for key, n in rows:
        k = min((2 * start + n) * shards // (2 * every), shards - 1)
        out.append((key, n, start, k, seen.setdefault(k, 0)))
        seen[k] += 1
        start += n
    return out


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_equals_plain_prefix_sums(spark, shards):
    texts = [(i * 7 % 501, None if i % 50 == 7 else "é" * (i % 13) + "x" * (9000 if i == 250 else i % 5)) for i in range(501)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = sorted(map(tuple, place(docs, shards).select("doc_id", "size", "start", "shard", "slot").collect()))
    assert got == plain(sorted((i, len((t or "").encode()) + 1) for i, t in texts), shards)


def test_one_key_with_many_rows_is_cut(spark):
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 WHEN id % 3 = 1 THEN NULL ELSE id END AS doc_id", "'same' AS text", "id AS other", "'own' AS slot", "1 AS SHARD", "'r' AS _ROW")
    out = place(docs)
    assert out.columns == ["doc_id", "text", "other", "size", "start", "shard", "slot"]
    rows = out.collect()
    assert sorted(r["other"] for r in rows) == list(range(3000))
    for k in range(16):
        mine = sorted((r["slot"], r["start"], r["doc_id"] is not None, r["doc_id"] or 0) for r in rows if r["shard"] == k)
        assert [x[0] for x in mine] == list(range(len(mine))) and len(mine) in (187, 188)
        assert mine == sorted(mine, key=lambda x: x[1]) and [x[2:] for x in mine] == sorted(x[2:] for x in mine)


def test_few_long_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b" * 3_000_000), (3, None), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in place(docs).orderBy("start").select("doc_id", "size", "shard", "slot").collect()] == [(1, 2, 0, 0), (2, 3_000_001, 8, 0), (3, 1, 15, 0), (3, 1, 15, 1)]
    empty = place(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "size", "start", "shard", "slot"]
    assert place(docs.selectExpr("doc_id", "0 AS n"), size=F.col("n")).where("shard <> 0").count() == 0


def test_written_shards_hold_what_place_says(spark, tmp_path):
    docs = spark.createDataFrame([(i // 2, "x" * (i % 40), i) for i in range(400)], "doc_id long, text string, other long").repartition(5)
    report = write_shards(docs, f"file://{tmp_path}/out", 6).collect()
    back = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r["doc_id"], r["text"], r["other"]) for r in back) == sorted(map(tuple, docs.collect()))
    want = {r["shard"]: (r["n"], r["b"]) for r in place(docs, 6).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    assert {r["shard"]: (r["n_docs"], r["n_bytes"]) for r in report} == want
    found = {k: [r for r in back if r["shard"] == k] for k in want}
    assert {k: (len(v), sum(len(r["text"]) + 1 for r in v)) for k, v in found.items()} == want
    tops = [(min(r["doc_id"] for r in found[k]), max(r["doc_id"] for r in found[k])) for k in sorted(found)]
    assert all(a[1] <= b[0] for a, b in zip(tops, tops[1:]))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op11_byte_shards(spark, sf).collect()
    want = plain(sorted((i, len(t) + 1) for i, t in texts.items()), 16)
    assert sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows) == [(a, b, d, e) for a, b, _, d, e in want]
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    sizes = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
