"""Operator 4: exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt by falling length into buckets of at most BUCKET rows. For a query with k-th best score theta so
far, a bucket whose longest vector is p has the local cosine threshold theta / (|q| |p|): above 1 the bucket is
skipped; when it is high, the query's largest coordinate bounds that of any fitting vector (coordinate pruning); when
it is low, only vectors that are long enough are looked at (length pruning). What is left gets its exact product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch_dir, shuffle_partitions, written

#: Vectors of a bucket; queries of a pass and the bytes of their components, which are broadcast; the cosine from which coordinates prune.
BUCKET, PASS, PASS_BYTES, COSINE = 4096, 16_384, 32 << 20, 0.5
SLACK = 1 - 1e-9


class Bucket:
    """Vectors of similar length, longest first, with the coordinate order of each dimension made when it is needed."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        wide = rows.astype(np.float64)
        lengths = np.sqrt((wide * wide).sum(1))
        order = np.lexsort((ids, -lengths))
        self.ids, self.rows, self.lengths = ids[order], rows[order], lengths[order]
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.where(self.lengths[:, None] > 0, wide[order] / self.lengths[:, None], 0)
        self.by_axis: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.safe = bool(np.abs(wide).max(initial=0) ** 2 * max(1, rows.shape[1]) < 2**50)
        self.wide = wide[order]

    def axis(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.by_axis:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.by_axis[f] = order, self.unit[order, f]
        return self.by_axis[f]

    def fitting(self, q: np.ndarray, length: float, theta: float) -> np.ndarray | slice | None:
        """The rows that may score theta or more; None: none."""
        longest = self.lengths[0] if len(self.lengths) else 0.0
        if not np.isfinite(theta) or theta <= 0:
            return slice(None)
        if length * longest < theta * SLACK:
            return None
        cosine = min(1.0, theta * SLACK / (length * longest))
        if cosine < COSINE:
            return slice(0, int(np.searchsorted(-self.lengths, -theta * SLACK / length, "right")))
        f = int(np.abs(q).argmax())
        angle, spread = np.arccos(np.clip(q[f] / length, -1, 1)), np.arccos(cosine)
        low, high = np.cos(min(np.pi, angle + spread)), np.cos(max(0.0, angle - spread))
        order, values = self.axis(f)
        return order[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, "right")]

    def products(self, q: np.ndarray, which: np.ndarray | slice) -> np.ndarray:
        if self.safe and float(np.abs(q).max(initial=0)) ** 2 * max(1, len(q)) < 2**50:
            return (self.wide[which] @ q.astype(np.float64)).astype(np.int64)
        exact = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in self.rows[which]]
        return np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by falling score, then rising id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(1024 * x) of each component; rows without id or vector, or with a null or non-finite component, left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x * 1024)).alias("v"))


PACKED = "part int, place int, size int, width int, ids binary, rows binary"


def _packed(vectors: DataFrame) -> DataFrame:
    """Buckets of vectors by falling length; equal lengths are dealt by a hash of the id. Shorter vectors end in zeros."""
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ranged = vectors.withColumn("_l", -length).withColumn("_h", F.xxhash64("vec_id"))
    ranged = ranged.repartitionByRange(shuffle_partitions(vectors), "_l", "_h").sortWithinPartitions("_l", "_h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, BUCKET):
                ids, lists = batch.column(0).slice(i, BUCKET), batch.column(1).slice(i, BUCKET)
                sizes = lists.value_lengths().to_numpy().astype(np.int64)
                width = int(sizes.max(initial=0))
                rows = np.zeros((len(sizes), width), np.int64)
                rows[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (place, pa.int32()), (len(sizes), pa.int32()), (width, pa.int32()), (ids.to_numpy().astype(np.int64).tobytes(), pa.binary()), (rows.tobytes(), pa.binary()))], ["part", "place", "size", "width", "ids", "rows"])
                place += 1

    return written(map_arrow(ranged.select("vec_id", "v"), pack, PACKED))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64).reshape(row["size"], row["width"])


def _search(buckets: DataFrame, shared, k: int) -> DataFrame:
    """q (place of the query), query_id, vec_id, score: of each task, each query's k best that reach its theta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, theta = shared.value
        lengths = [float(np.sqrt((q.astype(np.float64) ** 2).sum())) for q in queries]
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        theta = theta.copy()
        for batch in batches:
            for row in batch.to_pylist():
                bucket = Bucket(*_unpacked(row))
                width = bucket.rows.shape[1]
                for n, q in enumerate(queries):
                    q = np.pad(q, (0, max(0, width - len(q))))[:width]
                    which = bucket.fitting(q, lengths[n], theta[n])
                    if which is None:
                        continue
                    names, score = bucket.ids[which], bucket.products(q, which)
                    ok = (names != ids[n]) & (score >= theta[n])
                    names, score = np.concatenate([held[n][0], names[ok]]), np.concatenate([held[n][1], score[ok]])
                    top = best(score, names, k)
                    held[n] = names[top], score[top]
                    if len(top) == k:
                        theta[n] = max(theta[n], float(score[top[-1]]))
        sizes = [len(x) for x, _ in held]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), sizes).astype(np.int32)), pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([x for x, _ in held])), pa.array(np.concatenate([s for _, s in held]))], ["q", "query_id", "vec_id", "score"])

    return map_arrow(buckets, run, "q int, query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _passes(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The query set in passes of at most `most` distinct queries or PASS_BYTES, streamed to the driver one pass at a time."""
    ids, rows, size = [], [], 0
    for row in queries.distinct().toLocalIterator():
        ids.append(row["vec_id"])
        rows.append(np.array(row["v"], np.int64))
        size += rows[-1].nbytes
        if len(ids) == most or size >= PASS_BYTES:
            yield np.array(ids, np.int64), rows
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), rows


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pass_size: int = PASS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with rows of another vec_id.

    vectors, queries: vec_id, v (array<long>), see integer_vectors(). Ties go to the smaller vec_id. Fewer than k
    candidates: all of them. Vectors of unequal lengths are compared as if the shorter ended in zeros. Rows that
    repeat a vec_id are candidates each; a repeated query is asked once. Empty tables give no rows.
    Each pass is a bounded block of the query set against all buckets. A first look at one bucket of every partition
    gives the thresholds that prune the rest.
    """
    buckets = _packed(vectors)
    spark = vectors.sparkSession
    schema, paths = "query_id long, rank int, vec_id long, score long", []
    for ids, rows in _passes(queries, pass_size):
        theta = np.full(len(ids), -np.inf)
        shared = spark.sparkContext.broadcast((ids, rows, theta))
        first = written(_ranked(_search(buckets.where("place = 0"), shared, k), k))
        for r in first.where(F.col("rank") == k).select("q", "score").toLocalIterator():
            theta[r["q"]] = r["score"]
        sharper = spark.sparkContext.broadcast((ids, rows, theta))
        rest = _search(buckets.where("place > 0"), sharper, k)
        found = _ranked(first.select("q", "query_id", "vec_id", "score").union(rest), k).select("query_id", "rank", "vec_id", "score")
        # each pass writes its own results once
        paths.append(scratch_dir(spark))
        found.write.parquet(paths[-1])
        shared.unpersist()
        sharper.unpersist()
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best candidates of every hundredth vector among all; see top_k()."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP4_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
      FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
