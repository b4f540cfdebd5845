"""Shared helpers: scratch tables on shared storage, size-checked broadcasts, byte-level word arrays."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Drops an execution's shuffle files at its end: once its rows are written, nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WRITERS, _BEFORE = threading.Lock(), [], []
#: Bytes of an input batch of Python workers: a lower value than the session's is left alone.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Bytes of text whose 64-bit working arrays are alive at once.
SLAB = 1 << 18


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster shares; where that is unset, a temp folder in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/paperloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that still read them must be saved before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark)).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files go when a write ends; the setting returns to its value after the last of writes that overlap."""
    with _LOCK:
        if not _WRITERS:
            _BEFORE[:] = [spark.conf.get(CLEANUP)]
        _WRITERS.append(1)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS.pop()
            if not _WRITERS:
                spark.conf.set(CLEANUP, _BEFORE[0])


def written(df: DataFrame, compression: str = "zstd", **options) -> DataFrame:
    """The rows of df, written to shared storage and read again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    with _cleaning(spark):
        df.write.options(compression=compression, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Remove a table made by written() that nothing reads any more."""
    hadoop, jvm = df.sparkSession.sparkContext._jsc.hadoopConfiguration(), df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def _released(batches):
    """The batches of a task; at its end the memory that Arrow and the C library keep for later goes back."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) in input batches of BATCH_BYTES, on workers that give memory back."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)) > BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)
    return df.mapInArrow(lambda batches: _released(run(batches)), schema)


def shuffle_partitions(df: DataFrame, bytes_each: int = 64 << 20, least: int = 1) -> int:
    """A partition count that follows the optimizer's size estimate of df."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // bytes_each, 200_000))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the len+1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def stable_order(x: np.ndarray) -> np.ndarray:
    """argsort(kind="stable") of whole numbers from 0 under 2**32 by halves, which NumPy sorts in linear time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    high = (x >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            fore, back = np.full(size, BASE, U64), np.full(size, BASE_INV, U64)
            fore[0] = back[0] = 1
            _POWERS[size] = np.multiply.accumulate(fore), np.multiply.accumulate(back)
    return _POWERS[size]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for ordered, non-overlapping spans; memory stays near SLAB bytes x 24."""
    out = np.empty(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + SLAB, "right")))
            seg = raw[base : ends[j - 1]]
            fore, back = _powers(len(seg) + 1)
            acc = np.zeros(len(seg) + 1, U64)
            np.cumsum((seg.astype(U64) + U64(1)) * fore[: len(seg)], out=acc[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix64((acc[e] - acc[s]) * back[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
            i = j
    return out


#: Byte classes: A-Z lower-cased; the six ASCII white-space bytes (9-13 and 32) become a space.
LOWER_SPACE = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_spans(col: pa.Array, table: bytes = LOWER_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Translate bytes, cut at spaces and row ends: (bytes, word starts, word ends, words per row)."""
    raw, offs = string_bytes(col)
    raw = np.frombuffer(raw.tobytes().translate(table), np.uint8)
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    inside = raw != 32
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    stop[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    per_row = np.diff(np.searchsorted(starts, offs))
    return raw, starts, ends, per_row


def slabs(batch: pa.RecordBatch, text: int, most: int = 4 << 20):
    """Slices of a batch whose text column holds about `most` bytes, or one row."""
    n = batch.num_rows
    if not n:
        return
    lens = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, i = np.cumsum(lens), 0
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def append_columns(df: DataFrame, keep: list[str], inputs: list[str], added: str, make, most: int = 4 << 20) -> DataFrame:
    """The kept columns of df and new ones that make(*input arrays) returns for each slice of about `most` text bytes.

    added: DDL of the new columns; kept columns of the same names (any case) are left out. The first input is the text.
    A column that is both an input and kept goes to the workers once.
    """
    extra = StructType.fromDDL(added)
    new = {f.name.lower() for f in extra}
    kept = [c for c in keep if c.lower() not in new]
    more = [c for c in kept if c not in inputs]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(inputs)], *[F.col(f"`{c}`") for c in more])
    schema = StructType([*[df.schema[c] for c in kept], *extra])
    k = len(inputs)
    place = [inputs.index(c) if c in inputs else k + more.index(c) for c in kept]

    def run(batches):
        for batch in batches:
            for part in slabs(batch, 0, most):
                made = make(*part.columns[:k])
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in place], *made], names=schema.names)

    return map_arrow(rows, run, schema)


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """df with columns of the given names (any case) renamed, and the columns that give its own back."""
    held = [f"_own{i}" if c.lower() in names else c for i, c in enumerate(df.columns)]
    return df.toDF(*held), [F.col(f"`{h}`").alias(c) for h, c in zip(held, df.columns)]
