"""Operator 11: contiguous shards of nearly equal bytes, from per-partition totals, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Columns that place() adds; columns of these names (any case) in its input are left out.
ADDED = ("size", "start", "shard", "slot")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text and one for its end; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _numbered(rows: DataFrame, size: Column) -> DataFrame:
    """The rows with their size and a number that tells equal rows apart, in a table: the numbers hold for every later read."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ADDED and c.lower() != "_row"]
    return written(rows.select(*kept, size.cast("bigint").alias("size"), F.monotonically_increasing_id().alias("_row")))


def _placed(numbered: DataFrame, shards: int, order: list[str]) -> DataFrame:
    """numbered with start, shard and slot: three steps of prefix sums, none of which gathers rows.

    Rows are dealt to partitions by ranges of (order, _row), so that a key with very many rows is cut like any other.
    Sums within a partition follow from a window over it, sums before it from the table of partition totals.
    """
    keys = [*[F.col(f"`{c}`").asc_nulls_first() for c in order], F.col("_row").asc()]
    dealt = numbered.repartitionByRange(shuffle_partitions(numbered, 16 << 20), *keys).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt)
    # one row a partition: its totals, then the sums of those before it
    totals = dealt.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"))
    every = dealt.agg(F.sum("size")).first()[0] or 0
    own = Window.partitionBy("_part").orderBy(*keys)
    run = dealt.withColumn("_start", F.sum("size").over(own) - F.col("size")).withColumn("_no", F.row_number().over(own) - 1)
    run = run.join(F.broadcast(offsets), "_part").withColumn("start", F.col("_bytes") + F.col("_start")).withColumn("_no", F.col("_rows") + F.col("_no"))
    # a row belongs to the target interval that its middle lies in: every cut is the row boundary nearest to its target
    wide = lambda c: c.cast("decimal(19,0)")
    middle = (F.col("start") * 2 + F.col("size")).cast("decimal(19,0)") * wide(F.lit(shards))
    shard = F.least(F.call_function("div", middle, wide(F.lit(2 * every))), F.lit(shards - 1)) if every else F.lit(0)
    run = run.withColumn("shard", shard.cast("int"))
    first = run.groupBy("shard").agg(F.min("_no").alias("_first"))
    return run.join(F.broadcast(first), "shard").withColumn("slot", F.col("_no") - F.col("_first"))


def place(rows: DataFrame, shards: int = 16, order: list[str] | None = None, size: Column | None = None) -> DataFrame:
    """Cut rows, in ascending order of `order` (doc_id), into contiguous shards of nearly equal total size.

    Adds size (default: bytes of `text` and one), start (bytes before the row in the whole order), shard (from 0) and
    slot (place in its shard, without gaps from 0). Cut k is the row boundary nearest to k/shards of all bytes, so a
    shard differs from its target by at most the largest row, whatever copies, sources or very long texts there are.

    Nulls: order columns sort nulls first, a null text has no bytes. Repeated rows and ties of `order` follow the
    table's own order and each take a slot; which of them comes first may differ between calls, shards' sizes don't.
    Very long texts are one row each, never split; shards in which no row's middle lies stay empty. An empty table
    gives an empty result. Columns named as the added ones (any case) are replaced, all others pass through. Groups of
    equal texts aren't held together, for one may be larger than a shard.

    Rows pass two shuffles: give only the columns that are needed; write_shards moves whole texts once.
    """
    order = order or ["doc_id"]
    numbered = _numbered(rows, text_size(F.col("text")) if size is None else size)
    return _placed(numbered, shards, order).select(*[F.col(f"`{c}`") for c in numbered.columns if c not in ("size", "_row")], *ADDED)


def write_shards(docs: DataFrame, path: str, shards: int = 16, order: list[str] | None = None) -> DataFrame:
    """Write docs below path, a folder `shard=k` for each shard of place(); returns shard, n_docs, n_bytes, first.

    Only sizes and keys are placed; the texts then find their shard by comparing their key with the first keys of the
    shards (a table of at most `shards` rows, broadcast) and are shuffled once. Files hold their rows in order.
    """
    order = order or ["doc_id"]
    numbered = _numbered(docs, text_size(F.col("text")))
    keys = [f"`{c}`" for c in order]
    narrow = _placed(numbered.select(*keys, "size", "_row"), shards, order)
    firsts = written(narrow.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("n_bytes"), F.min(F.struct(*keys, "_row")).alias("first")))
    # one row: the first keys by shard
    bounds = firsts.agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("_bounds"))
    own = F.struct(*keys, "_row")
    shard = F.aggregate("_bounds", F.lit(0), lambda at, b: F.when(b["first"] <= own, b["shard"]).otherwise(at))
    dealt = numbered.crossJoin(F.broadcast(bounds)).withColumn("shard", shard).drop("_bounds", "size")
    by = ["shard", *keys, "_row"]
    dealt.repartitionByRange(max(shards, shuffle_partitions(numbered)), *by).sortWithinPartitions(*by).drop("_row").write.partitionBy("shard").parquet(path)
    return firsts


def op11_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of nearly equal bytes, in order of doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    facts = docs.select("doc_id", text_size(F.col("text")).alias("n"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = place(facts, 16, ["doc_id"], F.col("n"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB: the table of CRC-32 (a rule over 0 to 255) and its fold over a list of bytes.
CRC_SQL = """crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM range(256) AS r(i)))"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text that is not null, where crc_table is joined."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::BIGINT)), "
        "lambda x, b: xor(tab[(xor(x, b) & 255) + 1], x >> 8)), 4294967295)"
    )


OP11_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size, coalesce(text, '') AS text FROM documents),
r AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS every FROM d),
s AS (SELECT *, CAST(least((2 * start + size) * 16 // (2 * every), 15) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, {crc_sql("text")}::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s, crc_table
"""
