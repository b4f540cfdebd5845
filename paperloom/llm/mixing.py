"""Operator 10: mix sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source statistics are broadcast up to this many sources, else joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Rates over this are inverted from about their mode; steps of a distribution function gathered at a time.
FROM_MODE, STEPS = 400, 512
#: Copies of a document that one row makes; more are dealt out first.
SPREAD = 1000


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of seed and keys; null keys count as empty."""
    return _bits(seed, keys, 13).cast("double") / F.lit(float(1 << 52))


def _bits(seed: int, keys: tuple[Column, ...], digits: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def _window(rate: Column) -> tuple[Column, Column]:
    """The counts at which the distribution function is not 0 or 1 in double precision: first, last."""
    first = F.when(rate > FROM_MODE, F.floor(rate - 12 * F.sqrt(rate) - 25)).otherwise(F.lit(0)).cast("bigint")
    return first, (rate + 12 * F.sqrt(rate) + 25).cast("bigint")


def _cdf(rate: Column) -> Column:
    """The Poisson distribution function over _window(rate).

    Small rates begin with exp(-rate) at 0. For others terms are taken relative to that of the mode and divided by
    their sum. Sums are gathered in short arrays, so that the cost follows the window, about 24 times the rate's root.
    """
    first, last = _window(rate)
    mode = F.floor(rate).cast("bigint")
    ratio = lambda k: F.log(rate) - F.log(k.cast("double"))
    below = F.aggregate(F.sequence(first + 1, F.greatest(mode, first + 1)), F.lit(0.0), lambda x, k: x - ratio(k))
    start = F.when(first > 0, below).otherwise(-rate)

    def step(acc: Column, k: Column) -> Column:
        logp = F.when(k == first, acc["logp"]).otherwise(acc["logp"] + ratio(F.greatest(k, F.lit(1))))
        return F.transform(F.array(logp), lambda p: F.struct(p.alias("logp"), (acc["sum"] + F.exp(p)).alias("sum"), F.concat(acc["cdf"], F.array(acc["sum"] + F.exp(p))).alias("cdf")))[0]

    def some(acc: Column, block: Column) -> Column:
        zero = F.struct(acc["now"]["logp"].alias("logp"), acc["now"]["sum"].alias("sum"), F.array().cast("array<double>").alias("cdf"))
        counts = F.sequence(block, F.least(block + (STEPS - 1), last))
        return F.struct(F.aggregate(counts, zero, step).alias("now"), F.concat(acc["done"], F.array(acc["now"]["cdf"])).alias("done"))

    zero = F.struct(F.struct(start.alias("logp"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf")).alias("now"), F.array().cast("array<array<double>>").alias("done"))
    every = F.aggregate(F.sequence(first, last, F.lit(STEPS).cast("bigint")), zero, some, lambda x: F.struct(F.flatten(F.concat(x["done"], F.array(x["now"]["cdf"]))).alias("cdf"), F.when(first > 0, x["now"]["sum"]).otherwise(F.lit(1.0)).alias("all")))
    scaled = F.transform(F.array(every), lambda x: F.transform(x["cdf"], lambda c: c / x["all"]))[0]
    return F.when(rate > 0, scaled).otherwise(F.array().cast("array<double>"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """_mix_source, n_docs, rate, first, cdf (from count `first` on): rate = size * all rows * share of the source / its rows.

    weights: target shares by source, normalised to sum 1; a source that they don't name gets 0.
    None: equal shares. The share of null sources is that of the key "" in weights.
    """
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_mix_source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        share = F.lit(1.0)
    elif weights:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("_mix_source")), F.lit(0.0))
    else:
        share = F.lit(0.0)
    shares = counts.withColumn("share", share)
    totals = shares.agg(F.sum("n_docs").alias("all_docs"), F.sum("share").alias("all_shares"))
    # one row: every source's total, not a product of two large sides
    rated = shares.crossJoin(F.broadcast(totals))
    rate = F.when(F.col("all_shares") > 0, F.lit(float(size)) * F.col("all_docs") * F.col("share") / F.col("all_shares") / F.col("n_docs")).otherwise(F.lit(0.0))
    return rated.select("_mix_source", "n_docs", rate.alias("rate")).withColumn("first", _window(F.col("rate"))[0]).withColumn("cdf", _cdf(F.col("rate")))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 17, shuffle: bool = True) -> DataFrame:
    """Each document n times, n drawn by inverting its source's Poisson distribution at a hash of (seed, doc_id).

    Adds copy_no (from 1), n_copies and shuffle_key (a hash of seed, doc_id and copy_no); with shuffle the rows
    are dealt by that key and sorted by it within each partition, which is a global random order. The draw depends
    on seed and doc_id alone: a retried task makes the same rows, and rows with the same doc_id get the same count.
    Null doc_id hashes as empty; null source is a source of its own (""); an empty table stays empty; other columns
    pass through, and columns named copy_no, n_copies or shuffle_key are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("copy_no", "n_copies", "shuffle_key")]
    rates = source_rates(docs, weights, size)
    most = rates.agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("rate")).first()
    rates = F.broadcast(rates) if most["n"] <= BROADCAST_SOURCES else rates
    base = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("_mix_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    drawn = base.join(rates.select("_mix_source", F.col("first").alias("_mix_first"), F.col("cdf").alias("_mix_cdf")), "_mix_source")
    u = uniform(seed, F.col("doc_id"))
    count = F.aggregate("_mix_cdf", F.col("_mix_first"), lambda n, p: n + F.when(p <= F.col("_mix_u"), 1).otherwise(0)).cast("int")
    drawn = drawn.withColumn("_mix_u", u).withColumn("n_copies", F.when(F.size("_mix_cdf") > 0, count).otherwise(0)).where("n_copies > 0").drop("_mix_cdf")
    copies = lambda rows, first, last: rows.withColumn("copy_no", F.explode(F.sequence(first, last)))
    # no count is over the end of its rate's window
    if (most["rate"] or 0) <= SPREAD / 2:
        copies = copies(drawn, F.lit(1), F.col("n_copies"))
    else:
        blocks = drawn.where(F.col("n_copies") > SPREAD).withColumn("_mix_from", F.explode(F.sequence(F.lit(1), F.col("n_copies"), F.lit(SPREAD))))
        blocks = blocks.repartition(F.xxhash64("doc_id", "_mix_from"))
        dealt = copies(blocks, F.col("_mix_from"), F.least(F.col("_mix_from") + (SPREAD - 1), F.col("n_copies"))).drop("_mix_from")
        copies = copies(drawn.where(F.col("n_copies") <= SPREAD), F.lit(1), F.col("n_copies")).unionByName(dealt)
    out = copies.select(*[F.col(f"`{c}`") for c in kept], "copy_no", "n_copies", _bits(seed + 1, (F.col("doc_id"), F.col("copy_no")), 15).alias("shuffle_key"))
    if shuffle:
        out = out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
    return out


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each source to an equal share of a mix as large as the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return poisson_mix(docs.select("doc_id", "text", "lang", "source", "n_chars"))


OP10_SQL = """
WITH s AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT src, (SELECT sum(n) FROM s) * 1.0::DOUBLE / (SELECT count(*) FROM s) / n AS rate FROM s),
p AS (SELECT src, k, exp(-rate + k * ln(rate) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END) AS pk
      FROM r, unnest(generate_series(0, CAST(floor(rate + 12 * sqrt(rate) + 25) AS BIGINT))) AS g(k)),
c AS (SELECT src, sum(pk) OVER (PARTITION BY src ORDER BY k) AS cdf FROM p),
a AS (SELECT src, list(cdf) AS cdfs FROM c GROUP BY src),
d AS (SELECT doc_id, text, lang, source, n_chars, cdfs,
        ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM documents JOIN a ON coalesce(source, '') = src),
n AS (SELECT *, len(list_filter(cdfs, lambda x: x <= u)) AS n_copies FROM d)
SELECT doc_id, text, lang, source, n_chars, CAST(k AS INTEGER) AS copy_no, CAST(n_copies AS INTEGER) AS n_copies,
  ('0x' || substr(md5('18:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || k), 1, 15))::BIGINT AS shuffle_key
FROM n, unnest(generate_series(1, n_copies)) AS g(k)
"""
