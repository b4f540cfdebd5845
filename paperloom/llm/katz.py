"""Operator 3: Katz backoff scores of any order with Good-Turing discounts at every order and exactly normalised backoff weights.

Texts become shards: blocks of documents with a local word list. Word counts, then the counts of n-grams order by order,
are merged in hash buckets whose number follows the corpus, stored as tables, and answered to the shards that asked for
them, so no task and no broadcast holds a share of the corpus that grows with it.

  P(w | h) = d(c) * c(h w) / c(h)      if c = c(h w) > 0; d(c) = 1 for c > K, else that of the order of h w
           = alpha(h) * P(w | h')      if c(h w) = 0 and c(h) > 0; h' is h without its first word
           = P(w | h')                 if c(h) = 0
  P(w)     = d'(c) * c(w) / N          if c = c(w) > 0; d' by the words' own counts of counts
           = what the discounts free   if w is unknown, all unknown words being one class
alpha(h) makes P(. | h) sum to 1 over the training words and the unknown class. Where every count of a history (or of
all words) is over K, so that nothing is discounted, the counts are divided by their sum and one more instead. A text's
start is a history of one word; a history never reaches over it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, map_arrow, mix64, slabs, span_hashes, word_spans, written

U64 = np.uint64
#: Stand-in for the end of a text (a token).
END = U64(0xE0D0E0D0E0D0E0D1)
#: Counts up to K are discounted.
K = 5
#: Tokens of a shard, and bytes of a bucket.
SHARD_TOKENS, BUCKET_BYTES = 1_600_000, 24 << 20
#: A history with more training tokens than this is dealt to several buckets by its followers.
HOT = 500_000
#: Counts after discounting are whole numbers of 2**-UNIT, so that their sums are exact.
UNIT = 20


def pack(x: np.ndarray) -> bytes:
    """An integer or float array as zstd of its byte planes."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b"")


def unpack(raw: bytes, dtype) -> np.ndarray:
    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8) if raw else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(out.reshape(size, -1).T).view(dtype).ravel()


#: Counts up to this are stored in four bytes, tables with larger ones in eight.
NARROW = (1 << 32) - 1


def pack_counts(x: np.ndarray, narrow: int = NARROW) -> bytes:
    """Whole numbers from 0 with their width in a byte before them, four bytes if all are at most `narrow`."""
    kind = np.uint32 if x.max(initial=0) <= narrow else np.uint64
    return bytes([np.dtype(kind).itemsize]) + pack(x.astype(kind))


def unpack_counts(raw: bytes) -> np.ndarray:
    return unpack(raw[1:], np.uint32 if raw[0] == 4 else np.uint64)


SHARD = "shard long, n_vocab long, n_tokens long, doc_ids array<long>, held array<boolean>, tokens binary, vocab binary, trained binary, codes binary"


def make_shards(docs: DataFrame, training: Column, shard_tokens: int) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), (~F.coalesce(training, F.lit(True))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, size, held = TaskContext.get().partitionId(), 0, 0, []

        def shard() -> pa.RecordBatch:
            words, per = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            ids, out = pa.concat_arrays([x[2] for x in held]), pa.concat_arrays([x[3] for x in held])
            vocab, codes, counts = np.unique(words, return_inverse=True, return_counts=True)
            train = np.repeat(~out.to_numpy(zero_copy_only=False).astype(bool), per)
            trained = np.bincount(codes[train], minlength=len(vocab)).astype(np.uint32)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(vocab), np.uint32)
            rank[order] = np.arange(len(vocab), dtype=np.uint32)
            one = lambda x, t: pa.array([x], t)
            return pa.RecordBatch.from_arrays([one((part << 24) + seq, pa.int64()), one(len(vocab), pa.int64()), one(len(words), pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(out)], out), one(pack(per.astype(np.uint32)), pa.binary()), one(pack(vocab[order]), pa.binary()), one(pack(trained[order]), pa.binary()), one(pack(rank[codes]), pa.binary())], ["shard", "n_vocab", "n_tokens", "doc_ids", "held", "tokens", "vocab", "trained", "codes"])

        for batch in batches:
            for piece in slabs(batch, 0):
                raw, starts, ends, per = word_spans(piece.column(0))
                hashes = span_hashes(raw, starts, ends)
                last = np.cumsum(per + 1) - 1
                words = np.full(len(hashes) + len(per), END, U64)
                keep = np.ones(len(words), bool)
                keep[last] = False
                words[keep] = hashes
                held.append((words, per + 1, piece.column(1), piece.column(2)))
                size += len(words)
                if size >= shard_tokens:
                    yield shard()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield shard()

    return written(map_arrow(rows, run, SHARD), "zstd")


COUNTS = "kind string, bucket int, shard long, keys binary, counts binary, stats binary, n_tokens long, n_types long, n_of array<long>"


def _row(**x) -> dict:
    return {"kind": None, "bucket": None, "shard": None, "keys": None, "counts": None, "stats": None, "n_tokens": 0, "n_types": 0, "n_of": None} | x


def _table(rows: list[dict]) -> pa.Table:
    types = {"kind": pa.string(), "bucket": pa.int32(), "shard": pa.int64(), "keys": pa.binary(), "counts": pa.binary(), "stats": pa.binary(), "n_tokens": pa.int64(), "n_types": pa.int64(), "n_of": pa.list_(pa.int64())}
    return pa.table({k: pa.array([r[k] for r in rows], t) for k, t in types.items()})


def _deal(to: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows in their order) of the buckets that have rows."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, order[cuts[p] : cuts[p + 1]]


def count_words(shards: DataFrame, parts: int) -> DataFrame:
    """The word table (kind model: word hashes and counts by bucket) and the shards' own words' counts (kind reply)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, vocab, trained in zip(*(batch.column(i).to_pylist() for i in range(3))):
                vocab, trained = unpack(vocab, U64), unpack(trained, np.uint32)
                rows = [(p, shard, pack(vocab[o]), pack(trained[o])) for p, o in _deal((vocab % U64(parts)).astype(np.int64), parts)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "shard", "vocab", "trained"])

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        vocabs = [unpack(x, U64) for x in table.column("vocab").to_pylist()]
        words, back = np.unique(np.concatenate(vocabs), return_inverse=True)
        counts = np.bincount(back, np.concatenate([unpack(x, np.uint32) for x in table.column("trained").to_pylist()]), len(words)).astype(np.int64)
        seen = counts > 0
        # every word gets a number; frequent ones small ones, so that they pack well
        number = np.empty(len(words), np.int64)
        number[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        number = (number * parts + bucket).astype(U64)
        n_of = [int((counts == r).sum()) for r in range(1, K + 2)]
        rows = [_row(kind="model", bucket=bucket, keys=pack(words[seen]), counts=pack(counts[seen]), stats=pack(number[seen]), n_tokens=int(counts.sum()), n_types=int(seen.sum()), n_of=n_of)]
        at = 0
        for shard, v in zip(table.column("shard").to_pylist(), vocabs):
            mine = back[at : at + len(v)]
            rows.append(_row(kind="reply", bucket=bucket, shard=shard, counts=pack(counts[mine]), keys=pack(number[mine])))
            at += len(v)
        return _table(rows)

    asked = map_arrow(shards.select("shard", "vocab", "trained"), ask, "bucket int, shard long, vocab binary, trained binary")
    return written(asked.groupBy("bucket").applyInArrow(merge, COUNTS), "none")


def good_turing(n_of: tuple[int, ...]) -> np.ndarray:
    """d(0..K) from the numbers of types by count 1..K+1; (r - 0.5) / r where they give no value in (0, 1)."""
    n, out = (0, *n_of, *[0] * (K + 1)), np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass(frozen=True)
class Totals:
    """Bounded figures of a model: tokens, word types, training texts; by order, buckets and types by count 1..K+1."""

    tokens: int
    types: int
    texts: int
    parts: tuple[int, ...]
    n_of: tuple[tuple[int, ...], ...] = ()

    def few(self, n: int) -> np.ndarray:
        """Counts 0..K of order n after discounting, in 2**-UNIT; each under its count."""
        whole = np.arange(K + 1)
        few = np.round(good_turing(self.n_of[n - 1]) * whole * 2**UNIT).astype(np.int64)
        return np.minimum(few, np.maximum((whole << UNIT) - 1, 0))

    def weights(self, counts: np.ndarray, n: int = 1) -> np.ndarray:
        """Discounted counts of order n, in 2**-UNIT."""
        return np.where(counts <= K, self.few(n)[np.minimum(counts, K)], counts << UNIT)

    @property
    def mass(self) -> tuple[float, float]:
        """(sum of all unigram weights, that of unknown words)."""
        few = self.weights(np.arange(K + 1))
        freed = sum(n * ((r << UNIT) - int(few[r])) for r, n in enumerate(self.n_of[0][:K], 1))
        whole = self.tokens << UNIT
        return (float(whole), float(freed)) if freed > 0 else (float(whole + (1 << UNIT)), float(1 << UNIT))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by training counts; 0: the class of unknown words."""
        whole, freed = self.mass
        return np.where(counts > 0, self.weights(counts), freed) / whole


RESOLVED = "shard long, doc_ids array<long>, held array<boolean>, tokens binary, codes binary, own binary, number binary"


def resolve(shards: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """The shards with their words' counts and numbers in place of hashes."""

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            vocab = unpack(row["vocab"], U64)
            own, number = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), U64)
            got = {r["bucket"]: r for r in right.to_pylist()}
            for p, o in _deal((vocab % U64(parts)).astype(np.int64), parts):
                own[o], number[o] = unpack(got[p]["counts"], np.int64), unpack(got[p]["keys"], U64)
            rows.append({k: row[k] for k in ("shard", "doc_ids", "held", "tokens", "codes")} | {"own": pack_counts(own), "number": pack(number)})
        types = {"shard": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "tokens": pa.binary(), "codes": pa.binary(), "own": pa.binary(), "number": pa.binary()}
        return pa.table({k: pa.array([r[k] for r in rows], t) for k, t in types.items()})

    left = shards.select("shard", "doc_ids", "held", "tokens", "vocab", "codes")
    right = words.where("kind = 'reply'").select("shard", "bucket", "counts", "keys")
    return written(left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(put, RESOLVED), "none")


class Words:
    """Order 1 of a shard: its word list; the last code is what precedes a text's first word."""

    def __init__(self, row: dict, totals: Totals):
        self.per = unpack(row["tokens"], np.uint32).astype(np.int64)
        self.back = unpack(row["codes"], np.uint32).astype(np.int64)
        self.place = np.arange(len(self.back)) - np.repeat(np.cumsum(self.per) - self.per, self.per)
        self.train = np.repeat(~np.array(row["held"], bool), self.per)
        own = unpack_counts(row["own"]).astype(np.int64)
        self.size = len(own)
        self.count = np.append(own, totals.texts)
        # numbers from 1; 0 is the start
        self.columns = [np.append(unpack(row["number"], U64) + U64(1), U64(0))]
        self.salt = np.maximum(1, -(-self.count // HOT))


class Grams:
    """The distinct n-grams of a shard and where they are counted; the same each time it is made.

    back: the gram that ends at each token, -1 where the text's start is nearer. history, lower: the grams of order n-1
    without the last and without the first word. columns: the word numbers of a gram, from its last word to its first.
    A slot is a history, or its share of followers if it is hot: `salts` slots, all asked for.
    """

    def __init__(self, n: int, words: Words, below: "Words | Grams", parts: int):
        v, self.below = words.size, below
        at = np.flatnonzero(words.place >= n - 2)
        before = below.back[at - 1]
        if n == 2:
            before[words.place[at] == 0] = v
        keys, back = np.unique(before * v + words.back[at], return_inverse=True)
        self.back = np.full(len(words.back), -1, np.int64)
        self.back[at] = back
        self.history, self.word = keys // v, keys % v
        self.lower = np.empty(len(keys), np.int64)
        self.lower[back] = below.back[at]
        self.trained = np.bincount(back[words.train[at]], minlength=len(keys)).astype(np.uint32)
        self.gram = words.columns[0][self.word]
        self.columns = [self.gram, *(c[self.history] for c in below.columns)]
        total = below.count
        used = np.flatnonzero(np.bincount(self.history, minlength=len(total)))
        salts = np.maximum(1, -(-total // HOT))
        each = salts[used]
        begin = np.zeros(len(total), np.int64)
        begin[used] = np.cumsum(each) - each
        self.of = np.repeat(used, each)
        self.salt = (np.arange(len(self.of)) - np.repeat(begin[used], each)).astype(U64)
        names = [c[self.of] for c in below.columns]
        with np.errstate(over="ignore"):
            # a last word's histories share a bucket, those of a frequent one several, by the word before it
            share = mix64(names[1]) % words.salt[below.word[self.of]].astype(U64) if n > 2 else U64(0)
            bucket = (mix64(names[0] + self.salt * U64(0x9E3779B97F4A7C15) + share * U64(0xD6E8FEB86659FD93)) % U64(parts)).astype(np.int64)
            slot = begin[self.history] + (mix64(self.gram ^ U64(0xA5A5A5A5A5A5A5A5)) % salts[self.history].astype(U64)).astype(np.int64)
        order = np.lexsort((names[0], bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of, self.salt, self.names, self.bucket = self.of[order], self.salt[order], [c[order] for c in names], bucket[order]
        slot = rank[slot]
        self.order = np.argsort(slot, kind="stable")
        self.n = np.bincount(slot, minlength=len(order))
        # backoff weights are of use only where a gram may be unknown and its history isn't
        wanted = np.zeros(len(total), bool)
        wanted[self.history[self.trained == 0]] = True
        self.wanted = (wanted & (total > 0))[self.of]
        self.count = np.zeros(len(keys), np.int64)

    def buckets(self, parts: int) -> Iterator[tuple[int, slice, np.ndarray]]:
        """(bucket, its slots, its grams grouped in the order of the slots)."""
        cuts, ends = np.searchsorted(self.bucket, np.arange(parts + 1)), np.append(0, np.cumsum(self.n))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[p], cuts[p + 1]
            yield p, slice(a, b), self.order[ends[a] : ends[b]]

    def hear(self, got: dict[int, dict], parts: int) -> None:
        for p, _, o in self.buckets(parts):
            self.count[o] = unpack_counts(got[p]["counts"])


def _levels(row: dict, replies: list[dict], totals: Totals, most: int) -> tuple[Words, list[Grams]]:
    """The orders of a shard up to `most`, with their counts where replies has them."""
    words = Words(row, totals)
    grams, below = [], words
    for n in range(2, most + 1):
        grams.append(Grams(n, words, below, totals.parts[n - 1]))
        below = grams[-1]
        got = {r["bucket"]: r for r in replies if r["order"] == n}
        if got:
            below.hear(got, totals.parts[n - 1])
    return words, grams


def _dense(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct tuple, the tuple's number for each row)."""
    first, code = np.unique(columns[0], return_index=True, return_inverse=True)[1:]
    for c in columns[1:]:
        top = int(c.max(initial=0)) + 1
        if top == 1:
            continue
        if top * (len(first) + 1) >= 1 << 62:
            c = np.unique(c, return_inverse=True)[1]
            top = int(c.max(initial=0)) + 1
        first, code = np.unique(code * top + c.astype(np.int64), return_index=True, return_inverse=True)[1:]
    return first, code


ASKED = "bucket int, shard long, names binary, n binary, wanted binary, grams binary, trained binary, low binary"


def count_grams(n: int, resolved: DataFrame, below: list[DataFrame], totals: Totals) -> DataFrame:
    """The table of order n (kind model) and, by shard, its grams' counts and its histories' sums (kind reply).

    below: the tables of the orders 2 to n-1.
    """
    parts = totals.parts[n - 1]

    def asks(row: dict, replies: list[dict]) -> list[dict]:
        rows, (words, grams) = [], _levels(row, replies, totals, n)
        g = grams[-1]
        low = g.below.count[g.lower]
        for p, s, o in g.buckets(parts):
            # sorted by their first column, which is stored as steps
            names = [np.diff(g.names[0][s], prepend=U64(0)), *(c[s] for c in g.names[1:]), g.salt[s]]
            rows.append({"bucket": p, "shard": row["shard"], "names": pack(np.concatenate(names)), "n": pack(g.n[s].astype(np.uint32)), "wanted": pack(g.wanted[s].astype(np.uint8)), "grams": pack(g.gram[o]), "trained": pack(g.trained[o]), "low": pack_counts(low[o], narrow)})
        return rows

    def asked_table(rows: list[dict]) -> pa.Table:
        types = {"bucket": pa.int32(), "shard": pa.int64()} | dict.fromkeys(("names", "n", "wanted", "grams", "trained", "low"), pa.binary())
        return pa.table({k: pa.array([r[k] for r in rows], t) for k, t in types.items()})

    narrow = NARROW

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from asked_table(asks(batch.slice(i, 1).to_pylist()[0], [])).to_batches()

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = right.to_pylist()
        return asked_table([x for row in left.to_pylist() for x in asks(row, replies)])

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        joined = lambda c, of: np.concatenate([of(x) for x in table.column(c).to_pylist()])
        ns = [unpack(x, np.uint32) for x in table.column("n").to_pylist()]
        wanted = [unpack(x, np.uint8).astype(bool) for x in table.column("wanted").to_pylist()]
        names = [np.concatenate(c) for c in zip(*(unpack(x, U64).reshape(n, -1) for x in table.column("names").to_pylist()))]
        begin = np.cumsum([len(x) for x in ns]) - [len(x) for x in ns]
        steps = np.cumsum(names[0])  # U64 sums wrap, their differences are right
        names[0] = steps - np.repeat(steps[begin] - names[0][begin], [len(x) for x in ns])
        head, slot = _dense(names)
        names, size = [c[head] for c in names], len(head)
        pair_slot = np.repeat(slot, np.concatenate(ns))
        grams = joined("grams", lambda x: unpack(x, U64))
        heads, kind = _dense([pair_slot, grams])
        counts = np.bincount(kind, joined("trained", lambda x: unpack(x, np.uint32)), len(heads)).astype(np.int64)
        seen = counts > 0
        of, low = pair_slot[heads][seen], joined("low", unpack_counts)[heads][seen].astype(np.int64)
        known = counts[seen]
        lows = np.bincount(of, totals.weights(low, n - 1), size)
        few = [np.bincount(of[known == r], minlength=size) for r in range(1, K + 1)]
        frees = np.bincount(of[known <= K], minlength=size) > 0
        followers = np.bincount(of, minlength=size)
        has = followers > 0
        n_of = [int((known == r).sum()) for r in range(1, K + 2)]
        rows = [_row(kind="model", bucket=bucket, keys=pack(grams[heads][seen]), counts=pack_counts(known, narrow), stats=pack(np.concatenate([*(c[has] for c in names), followers[has].astype(U64)])), n_tokens=int(known.sum()), n_types=len(known), n_of=n_of)]
        at = slot_at = 0
        for shard, m, want in zip(table.column("shard").to_pylist(), ns, wanted):
            k, mine = int(m.sum()), slot[slot_at : slot_at + len(m)]
            whole = np.concatenate([frees[mine], *(x[mine[want]] for x in few)])
            rows.append(_row(kind="reply", bucket=bucket, shard=shard, keys=pack(lows[mine[want]].astype(np.uint64)), counts=pack_counts(counts[kind[at : at + k]], narrow), stats=pack_counts(whole, narrow)))
            at, slot_at = at + k, slot_at + len(m)
        return _table(rows)

    left = resolved.select("shard", "held", "tokens", "codes", "own", "number")
    asked = left.groupBy("shard").cogroup(_replies(below, "counts").groupBy("shard")).applyInArrow(ask, ASKED) if below else map_arrow(left, ask_first, ASKED)
    return written(asked.groupBy("bucket").applyInArrow(merge, COUNTS), "none")


def _replies(tables: list[DataFrame], *columns: str) -> DataFrame:
    """The replies of the tables of orders from 2."""
    out = None
    for n, table in enumerate(tables, 2):
        own = table.where("kind = 'reply'").select("shard", "bucket", F.lit(n).alias("order"), *columns)
        out = own if out is None else out.union(own)
    return out


def score_shards(resolved: DataFrame, tables: list[DataFrame], totals: Totals) -> DataFrame:
    base, orders = float(totals.tokens + totals.types + 1), len(tables) + 1

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out, replies = [], right.to_pylist()
        for row in left.to_pylist():
            words, levels = _levels(row, replies, totals, orders)
            own = words.count[:-1]
            chance = totals.unigram(own)
            logs = np.log10(chance)[words.back]
            spread = np.full(words.size + 1, totals.mass[0] / 2**UNIT)
            for n, g in enumerate(levels, 2):
                got = {r["bucket"]: r for r in replies if r["order"] == n}
                total = g.below.count
                low, freed, frees = np.zeros(len(total)), np.zeros(len(total)), np.zeros(len(total), bool)
                few = totals.few(n)
                for p, s, _ in g.buckets(totals.parts[n - 1]):
                    whole, of = unpack_counts(got[p]["stats"]), g.of[s]
                    frees[of[whole[: len(of)] > 0]] = True
                    of = of[g.wanted[s]]
                    np.add.at(low, of, unpack(got[p]["keys"], np.uint64).astype(np.float64))
                    for r, x in enumerate(whole[len(g.of[s]) :].reshape(K, len(of)), 1):
                        np.add.at(freed, of, ((r << UNIT) - int(few[r])) * x.astype(np.float64))
                under, spread = spread, np.where(frees, total, total + 1).astype(np.float64)
                freed = np.where(frees, freed / 2**UNIT, 1.0)
                if n > 2:  # the sums of the lower order's weights are divided by what its histories are
                    under = under[g.below.lower]
                h = g.history
                with np.errstate(divide="ignore", invalid="ignore"):
                    alpha = freed / spread / (1 - low / 2**UNIT / under)
                    seen = totals.weights(g.count, n) / 2**UNIT / spread[h]
                    chance = np.where(total[h] > 0, np.where(g.count > 0, seen, alpha[h] * chance[g.lower]), chance[g.lower])
                at = g.back >= 0
                logs[at] = np.log10(chance)[g.back[at]]
            ends = np.cumsum(words.per)
            per = lambda x: np.add.reduceat(x, ends - words.per) if len(ends) else x[:0]
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": words.per, "n_known": per((own[words.back] > 0).astype(np.int64)), "train_tokens": np.full(len(ends), totals.tokens, np.int64), "base_score": per(np.log10((own[words.back] + 1) / base)), "score": per(logs)}))
        return pa.concat_tables(out) if out else EMPTY.slice(0, 0)

    return resolved.groupBy("shard").cogroup(_replies(tables, "counts", "stats", "keys").groupBy("shard")).applyInArrow(score, SCORES)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})


@dataclass(frozen=True)
class KatzModel:
    """words, pairs, orders: counts by bucket of words, bigrams and each order from 2 (kind model; kind reply is bookkeeping). totals: bounded figures."""

    words: DataFrame
    pairs: DataFrame
    orders: tuple[DataFrame, ...]
    totals: Totals
    scores: DataFrame


def katz(docs: DataFrame, training: Column, shard_tokens: int = SHARD_TOKENS, order: int = 2) -> KatzModel:
    """Train on the rows of docs where `training` is not false and score every row's whole text.

    scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (by add-one unigrams), score (by the model), in log10.
    Words are runs without white space after A-Z are lower-cased; each text ends in one end token. A null or empty
    text is the end alone. Repeated rows count and are scored each; other columns are ignored; an empty table gives
    no scores; without training rows every probability is that of the unknown class, 1. order: words of the longest
    grams, 2 or more; what they haven't got is looked up an order lower each time.
    """
    if order < 2:
        raise ValueError("the order is at least 2")
    shards = make_shards(docs, training, shard_tokens)
    size = shards.agg(F.sum("n_vocab"), F.sum("n_tokens"), F.sum(F.size(F.filter("held", lambda x: ~x)))).first()
    word_parts = (size[0] or 0) * 12 // BUCKET_BYTES + 1
    words = count_words(shards, word_parts)
    types = [F.sum(F.element_at("n_of", r)) for r in range(1, K + 2)]
    found = lambda table: table.where("kind = 'model'").agg(*types, F.sum("n_tokens"), F.sum("n_types")).first()
    got = found(words)
    n_of = lambda row: tuple(x or 0 for x in row[: K + 1])
    parts = (word_parts, *((size[1] or 0) * 10 * n // BUCKET_BYTES + 1 for n in range(2, order + 1)))
    totals = Totals(got[K + 1] or 0, got[K + 2] or 0, size[2] or 0, parts, (n_of(got),))
    resolved, tables = resolve(shards, words, word_parts), []
    discarded(shards)
    for n in range(2, order + 1):
        tables.append(count_grams(n, resolved, tables[:], totals))
        totals = replace(totals, n_of=(*totals.n_of, n_of(found(tables[-1]))))
    return KatzModel(words, tables[0], tuple(tables), totals, score_shards(resolved, tables, totals))


def op3_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a trigram model of those whose crc32(doc_id) mod 7 is not 2; see katz()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return katz(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, order=3).scores
