"""Operator 5: near duplicates by MinHash bands, sequential Bayesian verification and exact sets.

1. Documents with equal shingle sets form classes, represented by their smallest doc_id.
2. Representatives that share a band of their signature are candidates. Each band bucket links its members to one, and
   the components of those links say which documents must meet in a task, in bounded blocks.
3. There, of pairs that share a band, batches of the signature are compared, and a pair is dropped once
   P(similarity >= threshold | matches so far) falls below the miss probability.
4. Pairs that are left are confirmed on their full shingle sets; only links that join two parts are emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, map_arrow, mix64, span_hashes, word_spans, written
from .graph import connected_components

U64 = np.uint64
#: Bands x rows: two documents at similarity 0.8 share no band with probability (1 - 0.8**6)**50 < 3e-7.
BANDS, ROWS = 50, 6
BATCH = 30
#: Members and shingles of a block of a candidate component; larger components are compared block by block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 400, 1 << 20
#: Members of a larger component, about, with which all its blocks are compared first.
PIVOTS = 24


@lru_cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32), rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(text: pa.Array, size: int) -> list[np.ndarray]:
    """Per text: the sorted distinct 64-bit hashes of its shingles of `size` words; the whole text if it has fewer."""
    raw, starts, ends, per_row = word_spans(text)
    words = span_hashes(raw, starts, ends)
    with np.errstate(over="ignore"):
        mult = [U64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) | 1) for j in range(size)]
        n = len(words)
        grams = np.zeros(max(0, n - size + 1), U64)
        for j in range(size):
            grams += words[j : j + len(grams)] * mult[j]
        grams = mix64(grams)
        out, at = [], 0
        for k in per_row.tolist():
            if k >= size:
                out.append(np.unique(grams[at : at + k - size + 1]))
            elif k:
                whole = sum((words[at + j : at + j + 1] * mult[j] for j in range(k)), np.zeros(1, U64))
                out.append(mix64(whole + U64(k) * U64(0x94D049BB133111EB)))
            else:
                out.append(np.zeros(0, U64))
            at += k
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of BANDS x ROWS minima."""
    flip, mult = _family()
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> U64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] ^ flip
        part *= mult
        np.minimum(low, part.min(0), out=low)
    # mixed, so that the kept bits are not those that the minimum makes small
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """After 1, 2, ... batches: the fewest matches m of n with P(s >= threshold | m of n) >= miss, flat prior.

    The posterior of s is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            log = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold)
            tail += math.exp(log)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _survivors(sigs: np.ndarray, i: int, among: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """The rows of `among` not pruned against row i by any batch."""
    hits = np.zeros(len(among), np.int64)
    for b, want in enumerate(least):
        part = slice(b * BATCH, (b + 1) * BATCH)
        hits += (sigs[among, part] == sigs[i, part]).sum(1)
        ok = hits >= want
        if not ok.all():
            among, hits = among[ok], hits[ok]
        if not len(among):
            break
    return among


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """The hash of each band of each signature."""
    sigs = sigs.reshape(len(sigs), BANDS, ROWS).astype(U64)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93), (len(sigs), BANDS)).copy()
        for r in range(ROWS):
            keys = mix64(keys ^ sigs[:, :, r])
    return keys


def links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, side: np.ndarray, percent: int, miss: float) -> list[tuple[int, int]]:
    """Exact links that join all parts that they can, of pairs that share a band.

    labels: rows of one label are joined already. side: 0 or 1; with both present only pairs across sides are compared.
    """
    least = least_matches(percent / 100, miss)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, out = sizes[order], []
    sigs, side = sigs[order], side[order]
    keys = band_keys(sigs)
    across = side.min() != side.max()
    ends = np.searchsorted(sizes * percent, sizes * 100, "right")
    label = np.unique(labels, return_inverse=True)[1][order]
    for i in range(len(ids)):
        among = np.arange(i + 1, ends[i])
        if across:
            among = among[side[among] != side[i]]
        among = among[label[among] != label[i]]
        if not len(among):
            continue
        among = among[(keys[among] == keys[i]).any(1)]
        for j in _survivors(sigs, i, among, least).tolist() if len(among) else ():
            if label[i] == label[j]:
                continue
            x, y = sets[order[i]], sets[order[j]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                label[label == label[j]] = label[i]
                out.append((int(ids[order[i]]), int(ids[order[j]])))
    return out


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (of the set), sig of every row."""

    def make(text: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(text, size)
        fps = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([(f >> 64) - (1 << 63) for f in fps], pa.int64()), pa.array([(f & (1 << 64) - 1) - (1 << 63) for f in fps], pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]

    return append_columns(docs, ["doc_id"], ["text"], "n_shingles long, fp1 long, fp2 long, sig binary", make)


def _band_edges(reps: DataFrame, parts: int) -> DataFrame:
    """u, v: each band bucket's members linked to one of them. Buckets are first reduced within each task."""

    def reduce(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        heads = ids[first][np.cumsum(first) - 1]
        rest = ~first & (ids != heads)
        return keys[first], ids[first], ids[rest], heads[rest]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            if not len(ids):
                continue
            keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), -1))
            keys, heads, u, v = reduce(keys.ravel(), np.repeat(ids, BANDS))
            to = (keys % U64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(parts + 1))
            rows = [(p, keys[o].tobytes(), heads[o].tobytes(), b"", b"") for p in range(parts) if len(o := order[cuts[p] : cuts[p + 1]])]
            if len(u):
                pair = np.unique(np.stack([u, v]), axis=1)
                rows.append((int(ids[0]) % parts, b"", b"", pair[0].tobytes(), pair[1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["p", "keys", "heads", "u", "v"])

    def merge(table: pa.Table) -> pa.Table:
        keys, heads, u, v = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in (("keys", U64), ("heads", np.int64), ("u", np.int64), ("v", np.int64)))
        _, _, u2, v2 = reduce(keys, heads) if len(keys) else (None, None, u[:0], v[:0])
        pair = np.unique(np.stack([np.concatenate([u, u2]), np.concatenate([v, v2])]), axis=1)
        return pa.table({"u": pair[0], "v": pair[1]})

    packed = map_arrow(reps.select("rep", "sig"), local, "p int, keys binary, heads binary, u binary, v binary")
    return packed.groupBy("p").applyInArrow(merge, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-7, keep: list[str] | None = None) -> DataFrame:
    """Columns of docs with n_shingles, component_id (smallest doc_id reachable by links) and kept (is that document).

    Linked: 100 * common shingles >= percent * all shingles, on distinct shingles of `size` words (the whole text as
    one if it has fewer). Null and wordless texts are empty and linked with nothing. Rows of one doc_id are one node;
    a row without doc_id is linked with nothing, has no component and is kept. An empty table gives no rows.
    keep: the columns to return beside doc_id; such as have the new columns' names are replaced.
    """
    signed = written(_signed(docs.select("doc_id", "text"), size))
    linked = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linked.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    classes = written(classes)
    reps = linked.select("fp1", "fp2", F.col("doc_id").alias("rep"), "sig").join(classes.select("fp1", "fp2", "rep"), ["fp1", "fp2", "rep"], "left_semi")
    parts = classes.count() * BANDS * 16 // (16 << 20) + 1
    candidate = connected_components(_band_edges(reps, parts))
    found = connected_components(_verified(docs, classes, candidate, size, percent, miss))
    # class representative -> component; classes without links are their own
    member = linked.select("doc_id", "fp1", "fp2").distinct().join(classes.select("fp1", "fp2", "rep"), ["fp1", "fp2"])
    # rows that share a doc_id, and classes that share texts, meet through these links
    repeated = member.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    shared = member.groupBy("doc_id").agg(F.countDistinct("rep").alias("k")).where("k > 1")
    if shared.take(1):
        found = connected_components(repeated.union(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        labels = found.select(F.col("node").alias("doc_id"), "component")
    else:
        labels = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component")).distinct()
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("doc_id", "n_shingles", "component_id", "kept")]
    if names:
        base = append_columns(docs, ["doc_id", *names], ["text"], "n_shingles long", lambda text: [pa.array([len(s) for s in shingle_sets(text, size)], pa.int64())])
    else:
        base = signed.select("doc_id", "n_shingles")
    out = base.join(labels, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", *[F.col(f"`{c}`") for c in names], "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


DEALT = ("component", "x", "y", "side", "rep", "label", "shingles", "sig")


def _compared(dealt: DataFrame, percent: int, miss: float) -> DataFrame:
    """u, v: exact links found within each group (component, x, y)."""

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        found = links(ids, table.column("label").to_numpy(), sets, sigs, table.column("side").to_numpy(), percent, miss) if len(ids) > 1 else []
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return dealt.select(*DEALT).groupBy("component", "x", "y").applyInArrow(compare, "u long, v long")


def _verified(docs: DataFrame, classes: DataFrame, candidate: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """u, v: exact links within candidate components, enough to join whatever links join.

    A component of one block is compared in one task. The blocks of a larger one are first compared with a few members,
    the pivots; in a group of near copies that joins nearly all of them. What is not joined to the largest part then is
    compared with every block, so work grows with the component's size times what is left, not with its square.
    """
    sized = classes.select("rep", "n").join(candidate.withColumnRenamed("node", "rep"), "rep")
    weight = sized.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    member = sized.join(weight.select("component", "members", blocks.alias("g")), "component")
    member = written(member.select("rep", "component", "members", "g", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int").alias("c")).distinct())
    texts = docs.select(F.col("doc_id").alias("rep"), "text").where("rep IS NOT NULL").join(member, "rep")

    def make(text: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(text, size)
        return [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]

    prepared = append_columns(texts, ["rep", "component", "members", "g", "c"], ["text"], "shingles binary, sig binary", make).where("sig IS NOT NULL")
    prepared = prepared.withColumn("side", F.lit(0)).withColumn("label", F.col("rep"))
    zero = F.lit(0)
    if not member.where("g > 1").take(1):
        return _compared(prepared.withColumn("x", zero).withColumn("y", zero), percent, miss)
    prepared = written(prepared)
    small = _compared(prepared.where("g = 1").withColumn("x", zero).withColumn("y", zero), percent, miss)
    large = prepared.where("g > 1")
    pivots = large.where(F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("members")) < PIVOTS)
    to_pivots = pivots.withColumn("y", F.explode(F.sequence(zero, F.col("g") - 1))).withColumn("side", F.lit(1)).withColumn("x", zero).select(*DEALT)
    first = written(_compared(to_pivots.union(large.withColumn("x", zero).withColumn("y", F.col("c")).select(*DEALT)), percent, miss))
    parts = connected_components(first).select(F.col("node").alias("rep"), F.col("component").alias("_part"))
    labels = member.where("g > 1").select("rep", "component", "members", "g").join(parts, "rep", "left").select("rep", "component", "members", "g", F.coalesce("_part", "rep").alias("label"))
    counts = labels.groupBy("component", "label").agg(F.count(F.lit(1)).alias("k"), F.first("members").alias("members"), F.first("g").alias("g"))
    main = counts.groupBy("component").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all"), F.first("g").alias("g"))
    # blocks of what the largest part does not hold
    main = main.select("component", F.col("top.label").alias("main"), F.ceil(F.col("g") * (F.col("all") - F.col("top.k")) / F.col("all")).cast("int").alias("left")).where("left > 0")
    labels = written(labels.select("rep", "component", "label").join(main, "component"))
    rest = large.drop("label", "side", "component").join(labels, "rep").withColumn("side", (F.col("label") == F.col("main")).cast("int"))
    others = rest.where("side = 0").withColumn("x", F.pmod(F.xxhash64(F.lit(9), "rep"), F.col("left")).cast("int")).withColumn("y", F.explode(F.sequence(zero, F.col("g") - 1)))
    blocks_ = rest.withColumn("side", F.lit(1)).withColumn("x", F.explode(F.sequence(zero, F.col("left") - 1))).withColumn("y", F.col("c"))
    return small.union(first).union(_compared(others.select(*DEALT).union(blocks_.select(*DEALT)), percent, miss))


def distinct_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one of each group of linked texts, with docs' own columns.

    Rows that agree in doc_id and text stay once, any of them. Rows of one doc_id with different texts are documents
    of their own. A row without doc_id stays. An empty table gives no rows.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    many = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), (F.min(key) != F.max(key)).alias("_differ")).where("_rows > 1")
    many = written(many.select(F.col("doc_id").alias("_id"), "_differ"))
    kept = lambda rows: near_duplicates(rows, size, percent, keep=[]).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    if not many.take(1):
        return docs.join(kept(docs.select("doc_id", "text")), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))
    # texts under one doc_id go by a number of their own, below zero
    node = F.when(F.col("_differ"), F.xxhash64(F.lit(3), F.col("doc_id"), key).bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("doc_id"))
    tagged = docs.where("doc_id IS NOT NULL").join(many, F.col("doc_id") == F.col("_id"), "left").withColumn("_node", node)
    verdict = written(kept(tagged.select(F.col("_node").alias("doc_id"), "text"))).withColumnRenamed("doc_id", "_node")
    stay = tagged.join(verdict, "_node", "left_semi")
    rows = stay.where("_id IS NULL").unionByName(stay.where("_id IS NOT NULL").dropDuplicates(["_node"]))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles at 0.8; see near_duplicates()."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=80, keep=[])
