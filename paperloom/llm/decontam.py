"""Operator 1: benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, set_aside, string_bytes, written

WINDOW = 13
#: Benchmark text of one pass over the documents; larger benchmarks take several passes.
BLOCK_BYTES = 2 << 20
#: Bytes of a block of the shift table, and bits of its hash.
B, BITS = 8, 18
#: Words are runs of digits, letters a-z and bytes over 0x7F, after A-Z are lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: bytes) -> tuple[bytes, int]:
    """The words of a text, each between single spaces, and their number."""
    words = text.translate(WORD_BYTES).split()
    return (b" " + b" ".join(words) + b" ", len(words)) if words else (b" ", 0)


class WuManber:
    """Searches many byte strings at once: a shift table over blocks, buckets by suffix hash, direct comparison."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.b = min(B, self.m)
        self.shift = np.full(1 << BITS, self.m - self.b + 1, np.uint16 if self.m < 60000 else np.int64)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        for j in range(self.m - self.b + 1):
            h = self._hash(heads[:, j : j + self.b])
            np.minimum.at(self.shift, h, self.m - self.b - j)
        suffix = self._hash(heads[:, self.m - self.b :])
        order = np.argsort(suffix, kind="stable")
        self.bucket = order.astype(np.int64)
        self.first = np.searchsorted(suffix[order], np.arange((1 << BITS) + 1))
        self.prefix = self._value(heads[:, : self.b])[order]

    def _value(self, blocks: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(blocks), 8), np.uint8)
        wide[:, : self.b] = blocks
        return wide.view(np.uint64).ravel()

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((self._value(blocks) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    def search(self, text: bytes, lane: int = 1024) -> list[tuple[int, int]]:
        """(position, pattern index) of every occurrence. Lanes of the text are scanned side by side."""
        n = len(text) - self.m + 1
        if n <= 0:
            return []
        raw, within = np.frombuffer(text, np.uint8), np.arange(self.b)
        at = np.arange(0, n, lane)
        stop = np.minimum(at + lane, n)
        found_at, found_h = [], []
        while len(at):
            h = self._hash(raw[(at + (self.m - self.b))[:, None] + within])
            s = self.shift[h].astype(np.int64)
            hit = s == 0
            if hit.any():
                found_at.append(at[hit])
                found_h.append(h[hit])
            at = at + np.maximum(s, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        if not found_at:
            return []
        pos, h = np.concatenate(found_at), np.concatenate(found_h)
        each = self.first[h + 1] - self.first[h]
        upto = np.cumsum(each)
        slot = np.repeat(self.first[h] - (upto - each), each) + np.arange(int(upto[-1]))
        pos = np.repeat(pos, each)
        same = self._value(raw[pos[:, None] + within]) == self.prefix[slot]
        pairs = zip(pos[same].tolist(), self.bucket[slot[same]].tolist())
        return [(p, i) for p, i in pairs if text.startswith(self.patterns[i], p)]


class Benchmark:
    """The windows of a block of items, in one searcher for long windows and one for short ones."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        owners: dict[bytes, set[str]] = {}
        self.words: dict[bytes, int] = {}
        for item, text in items:
            words = text.translate(WORD_BYTES).split()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                part = words[i : i + window]
                key = b" " + b" ".join(part) + b" "
                owners.setdefault(key, set()).add(item)
                self.words[key] = len(part)
        self.owners = owners
        short = [p for p in owners if len(p) < 32]
        long = [p for p in owners if len(p) >= 32]
        self.searchers = [WuManber(x) for x in (short, long) if x]

    def scan(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Per text: number of words, merged ranges of hit words, owners of the windows found."""
        parts, counts = zip(*map(normalised, texts)) if texts else ((), ())
        begins = np.cumsum([0, *map(len, parts)])
        whole = b"".join(parts)
        found: dict[int, list[tuple[int, bytes]]] = {}
        for s in self.searchers:
            for p, i in s.search(whole):
                found.setdefault(int(np.searchsorted(begins, p, "right")) - 1, []).append((p, s.patterns[i]))
        ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for d, hits in found.items():
            gaps = np.flatnonzero(np.frombuffer(parts[d], np.uint8) == 32)
            first = np.searchsorted(gaps, np.array([p for p, _ in hits]) - begins[d]).tolist()
            ranges[d] = merged([(a, a + self.words[key]) for a, (_, key) in zip(first, hits)])
            items[d] = set().union(*(self.owners[key] for _, key in hits))
        return list(counts), ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items with an id and a text, as lists of at most `most` text bytes (or one item), streamed to the driver."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).dropna()
    for item, text in rows.toLocalIterator():
        raw = text.encode()
        if held and size + len(raw) > most:
            yield held
            held, size = [], 0
        held.append((item, raw))
        size += len(raw)
    if held:
        yield held


_BUILT: dict[object, Benchmark] = {}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents with n_words, n_hit, items (ids of items with occurring windows), hit_words (ranges), contaminated.

    A window is `window` consecutive words of an item, or the whole item if it has fewer. A word inside any
    occurrence is hit; contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words and
    are clean. Items without id or text take no part; repeated items count once. An empty benchmark finds nothing.
    keep: columns of docs to return (default all); such as have the new columns' names are replaced. Repeated documents
    pass one to one; texts of any length are scanned whole; no documents give an empty result.
    """
    keep = list(docs.columns) if keep is None else keep
    spark = docs.sparkSession
    out, first = docs, True
    parts = blocks(benchmark, block_bytes)
    items = next(parts, [])
    while items is not None:
        following = next(parts, None)
        out = _scan(out if first else written(out), spark.sparkContext.broadcast(items), window, keep, first, following is None)
        first, items = False, following
    names = [c for c in keep if c.lower() not in ("n_words", "n_hit", "items", "hit_words", "contaminated")]
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, r: n + r["until"] - r["from"])
    return out.select(*[F.col(f"`{c}`") for c in names], "n_words", n_hit.alias("n_hit"), "items", "hit_words").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _scan(docs: DataFrame, shared, window: int, keep: list[str], first: bool, last: bool) -> DataFrame:
    number = uuid.uuid4().hex

    def make(text: pa.Array, *before: pa.Array) -> list[pa.Array]:
        if (number, window) not in _BUILT:
            _BUILT.clear()
            _BUILT[number, window] = Benchmark(shared.value, window)
        raw, offs = string_bytes(text)
        whole, offs = raw.tobytes(), offs.tolist()
        counts, ranges, items = _BUILT[number, window].scan([whole[a:b] for a, b in zip(offs, offs[1:])])
        if before:
            ranges = [merged(r + [(x["from"], x["until"]) for x in old]) for r, old in zip(ranges, before[0].to_pylist())]
            items = [s | set(old) for s, old in zip(items, before[1].to_pylist())]
        spans = pa.list_(pa.struct([("from", pa.int64()), ("until", pa.int64())]))
        return [pa.array(counts, pa.int64()), pa.array([[{"from": a, "until": b} for a, b in r] for r in ranges], spans), pa.array([sorted(s) for s in items], pa.list_(pa.string())), *([] if last else [text])]

    inputs = ["text"] if first else ["_text", "hit_words", "items"]
    return append_columns(docs, keep, inputs, "n_words long, hit_words array<struct<from:long,until:long>>, items array<string>" + ("" if last else ", _text string"), make)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    rows, own = set_aside(docs, ("n_words", "n_hit", "items", "hit_words", "contaminated", "_text"))
    return decontaminate(rows, benchmark).where("NOT contaminated").select(*own)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document; see decontaminate()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _words_sql(table: str, key: str) -> str:
    cls = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all({lower}, '{cls}') AS w FROM {table}"


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM ({_words_sql('documents', 'doc_id')})),
b AS ({_words_sql('benchmark WHERE item_id IS NOT NULL', 'item_id')}),
k AS (SELECT item_id, array_to_string(w[i : i + 12], ' ') AS win, least(len(w), 13) AS k
      FROM b, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM k),
occ AS (SELECT r, i, s.k, array_to_string(w[i : i + s.k - 1], ' ') AS win
        FROM d, sizes s, unnest(generate_series(1, len(w) - s.k + 1)) AS g(i)),
hit AS (SELECT r, i, occ.k, item_id FROM occ JOIN k USING (win, k)),
n AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM hit, unnest(generate_series(0, k - 1)) AS g(o) GROUP BY r),
it AS (SELECT r, list(DISTINCT CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""
