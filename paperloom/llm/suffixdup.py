"""Operator 7: repeated byte strings by merging shard Burrows-Wheeler transforms.

1. Every LENGTH-byte window has an anchor: the GRAM-byte string in it with the least hash, leftmost if tied. Windows
   that follow each other and share an anchor make a run. Equal windows have equal anchors at equal places, so a run
   whose anchor string occurs in one run only holds no repeated window: the anchors deal the windows of the corpus out to
   bundles that can be worked on apart. Runs of equal bytes make a kind (128 bits of hashes); one string of a kind, or
   two if it has several runs, stands for it.
2. Anchors with very many kinds are cut finer: windows whose places differ by less than a step share a core, and only
   equal cores can hold equal windows; the last step's cores are the windows themselves.
3. The strings of a bundle belong to shards of the corpus. Each shard's transform is built alone, over symbols of STRIDE
   bytes (a symbol is the bytes of the next STRIDE places, so that few passes reach LENGTH). The transforms are merged by
   refining their interleave: each pass sorts it stably by the transforms' symbols. The pass that parts two neighbours
   gives their common prefix; neighbours with LENGTH bytes in common after LENGTH / STRIDE passes make the repeated
   intervals. Bytes are compared with those of another member of the interval before a window counts as repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, append_columns, map_arrow, mix64, slabs, stable_order, written

U64 = np.uint64
LENGTH, GRAM, STRIDE = 400, 48, 80
#: Places that a core spans when an anchor, then a core, has over HOT different runs; a core of one place is its window.
HOT, STEPS = 400, (16, 1)
#: Bytes of windows worked on at once, bytes up to which texts are joined for it, bytes of a bundle, shards of the corpus
#: (by hash of the document).
SLAB, JOINED, BUNDLE, SHARDS = 1 << 18, 1 << 16, 192 << 10, 4


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the factors that move a substring's sum to place 0."""
    fore, back = _powers(len(raw) + 1)
    acc = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * fore[: len(raw)], out=acc[1:])
    return acc, back


def _hash(acc: np.ndarray, back: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((acc[end] - acc[begin]) * back[begin] + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))


def _pieces(raws: list[np.ndarray], length: int):
    """(bytes, numbers of the texts in them, their ends, place in the text) of short texts joined and of long ones cut."""
    held, size = [], 0
    for i, raw in enumerate([*raws, None]):
        if held and (raw is None or size + len(raw) > JOINED):
            yield np.concatenate([raws[j] for j in held]), np.array(held), np.cumsum([len(raws[j]) for j in held]), 0
            held, size = [], 0
        if raw is None or len(raw) < length:
            continue
        if len(raw) > JOINED:
            for base in range(0, len(raw) - length + 1, SLAB):
                seg = raw[base : base + SLAB + length - 1]
                yield seg, np.array([i]), np.array([len(seg)]), base
        else:
            held.append(i)
            size += len(raw)


def runs(raws: list[np.ndarray], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, hash of the run's bytes and anchor place, first window, last window, number of the text) of the texts' runs."""
    parts = [(np.zeros(0, U64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)]
    for seg, texts, ends, base in _pieces(raws, length):
        n, span = len(seg) - length + 1, length - gram + 1
        begins = np.append(0, ends[:-1])
        with np.errstate(over="ignore"):
            acc, back = _sums(seg)
            count = len(seg) - gram + 1
            grams = mix64((acc[gram:] - acc[:count]) * back[:count] + U64(gram) * U64(0xD6E8FEB86659FD93))
            # sliding minimum: least from a place to the end of its block, and from the next block's start on
            blocks = len(grams) // span + 2
            key = np.full(blocks * span, np.iinfo(U64).max, U64)
            bits = int(span).bit_length()
            key[: len(grams)] = grams >> U64(bits) << U64(bits)
            key = key.reshape(blocks, span) | np.arange(span, dtype=U64)
            up_to = np.minimum.accumulate(key, 1).ravel()
            onward = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
            place = np.arange(n)
            left, right = onward[:n], up_to[span - 1 : n + span - 1]
            use_right = right >> U64(bits) < left >> U64(bits)
            use_right[::span] = False
            low = np.where(use_right, right, left) & U64((1 << bits) - 1)
            anchor = (place // span + use_right) * span + low.astype(np.int64)
            # the windows that lie in one text
            new = np.zeros(n, bool)
            new[1:] = anchor[1:] != anchor[:-1]
            inside = np.ones(n, bool)
            for b, e in zip(begins.tolist(), ends.tolist()):
                new[b] = True
                inside[e - length + 1 : e] = False
            window = np.flatnonzero(inside)
            heads = np.flatnonzero(new[window])
            first, last = window[heads], window[np.append(heads[1:], len(window)) - 1]
            of = np.searchsorted(ends, first, "right")
            whole = _hash(acc, back, first, last + length)
            kind = mix64(whole ^ (anchor[first] - first).astype(U64) * U64(0x9E3779B97F4A7C15))
        parts.append((grams[anchor[first]], kind, first - begins[of] + base, last - begins[of] + base, texts[of]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def cores(raw: np.ndarray, first: int, last: int, gram: int, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core hash, hash of bytes and place, first, last window) of the windows of one run, `step` places to the anchor at a time.

    A core is what all windows of such a group share, whether or not this run holds them all; with step 1 it is the window.
    """
    seg = raw[first : last + length]
    n = len(seg) - length + 1
    with np.errstate(over="ignore"):
        acc, back = _sums(seg)
        at = np.arange(len(seg) - gram + 1)
        grams = _hash(acc, back, at, at + gram)
        span = length - gram + 1
        bits = U64(int(span).bit_length())
        # all windows of a run share their anchor: the least gram of the part that they share
        anchor = n - 1 + int((grams[n - 1 : span] >> bits).argmin())
        offset = anchor - np.arange(n)
        group = offset // step
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        end = np.concatenate([begin[1:] - 1, [n - 1]])
        lo, hi = anchor - group[begin] * step, anchor - (group[begin] + 1) * step + 1 + length
        core = mix64(_hash(acc, back, lo, hi) ^ mix64(group[begin].astype(U64) + U64(step << 32)))
        kind = mix64(_hash(acc, back, begin, end + length) ^ (anchor - begin).astype(U64) * U64(0x9E3779B97F4A7C15))
    return core, kind, begin + first, end + first


class Shard:
    """The transform of a set of strings over symbols of `stride` bytes: a string is `stride` interleaved cyclic texts."""

    def __init__(self, symbols: list[np.ndarray], passes: int, stride: int):
        # s: symbol ids (from 1) at each place of a string; its ends (0) follow them
        k = np.array([len(s) for s in symbols])
        ends = np.minimum(stride, k)
        begin = np.cumsum(k + ends) - k - ends
        self.where = [slice(a, a + n) for a, n in zip(begin.tolist(), k.tolist())]
        string = np.repeat(np.arange(len(k)), k + ends)
        base, size = begin[string], k[string]
        place = np.arange(len(string)) - base
        inner = place < size
        sym = np.zeros(len(string), np.int32)
        sym[inner] = np.concatenate(symbols)
        nxt = base + np.where(inner, np.where(place + stride < size, place + stride, size + place % stride), place - size)
        before = np.empty_like(sym)
        before[nxt] = sym
        # sorted from the last symbol to the first, by their ranks in this shard
        used = np.zeros(int(sym.max()) + 1, bool)
        used[sym] = True
        rank = (np.cumsum(used, dtype=np.int32) - 1)[sym]
        rank = rank.astype(np.uint16) if int(rank.max()) < 1 << 16 else rank
        keys = [rank]
        for _ in range(passes - 1):
            keys.append(keys[-1][nxt])
        self.order = np.arange(len(sym))
        for key in reversed(keys):
            key = key[self.order]
            self.order = self.order[np.argsort(key, kind="stable") if key.dtype == np.uint16 else stable_order(key)]
        self.bwt = before[self.order]


def merge_transforms(shards: list[Shard], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each suffix in the merged order, symbols that it has in common with the one before, up to `passes`).

    The interleave of the transforms is refined pass by pass: sorted stably by their symbols it becomes the order by one
    symbol more. A pair of neighbours that pass h parts has h - 1 symbols in common; no suffix is sorted again.
    """
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.bwt) for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    common = np.full(len(source), passes, np.int16)
    common[:1] = 0
    block = np.zeros(len(source), np.int32)
    symbol = np.empty(len(source), np.int32)
    for h in range(1, passes + 1):
        symbol[np.argsort(source, kind="stable")] = bwt
        order = stable_order(symbol)
        source, block, ranked = source[order], block[order], symbol[order]
        new = np.ones(len(order), bool)
        new[1:] = (ranked[1:] != ranked[:-1]) | (block[1:] != block[:-1])
        common[new & (common == passes)] = h - 1
        block = np.cumsum(new, dtype=np.int32) - 1
    return source, common


def repeated_windows(strings: list[bytes], length: int = LENGTH, weights: list[int] | None = None, shard_of: list[int] | None = None, stride: int | None = None) -> list[np.ndarray]:
    """Per string: for each of its windows of `length` bytes, whether the window occurs anywhere else in the strings.

    weights: as how many equal strings each counts. shard_of: the shard whose transform a string belongs to.
    """
    stride = stride or max(d for d in range(1, min(STRIDE, length) + 1) if length % d == 0)
    passes = length // stride
    lens = np.array([len(s) for s in strings])
    flat = np.frombuffer(b"".join(strings), np.uint8)
    begins = np.cumsum(lens) - lens
    with np.errstate(over="ignore"):
        acc, back = _sums(flat)
        at = np.arange(len(flat) - stride + 1)
        code = _hash(acc, back, at, at + stride)
    ids = np.unique(code, return_inverse=True)[1] + 1
    symbols = [ids[b : b + n - stride + 1] for b, n in zip(begins.tolist(), lens.tolist())]
    of = np.arange(len(strings)) % 2 if shard_of is None else np.asarray(shard_of)
    places = [np.flatnonzero(of == k).tolist() for k in np.unique(of)]
    shards = [Shard([symbols[j] for j in p], passes, stride) for p in places]
    source, common = merge_transforms(shards, passes)
    # the repeated intervals: suffixes with `length` bytes in common
    interval = np.cumsum(common < passes) - 1
    parts = [np.zeros(0, np.int64)] * len(strings)
    for i, (shard, own) in enumerate(zip(shards, places)):
        by_place = np.empty(len(shard.bwt), np.int64)
        by_place[shard.order] = interval[source == i]
        for j, where in zip(own, shard.where):
            parts[j] = by_place[where][: lens[j] - length + 1]
    of_window, count = np.concatenate(parts), lens - length + 1
    window = np.arange(len(of_window)) + np.repeat(begins - (np.cumsum(count) - count), count)
    weight = np.repeat(np.ones(len(strings)) if weights is None else np.asarray(weights, float), count)
    # all of an interval or none of it
    again = np.flatnonzero(np.bincount(of_window, weight)[of_window] > 1)
    window, of_window = window[again], of_window[again]
    out = np.zeros(len(flat), bool)
    if len(again):
        out[window[confirmed(flat, length, window, of_window, weight[again])]] = True
    return [out[b : b + n - length + 1] for b, n in zip(begins.tolist(), lens.tolist())]


def confirmed(flat: np.ndarray, length: int, window: np.ndarray, interval: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each window (in ascending order), whether its bytes are those of another of its interval."""
    order = stable_order(interval)
    head = np.concatenate([[True], interval[order][1:] != interval[order][:-1]])
    first, last = np.flatnonzero(head), np.append(np.flatnonzero(head)[1:], len(order)) - 1
    nth = np.cumsum(head) - 1
    one, other = window[order[first]][nth], window[order[last]][nth]
    partner = np.empty(len(window), np.int64)
    partner[order] = np.where(one == window[order], other, one)
    ok = np.ones(len(window), bool)
    rows = np.flatnonzero(partner != window)
    if not len(rows):
        return ok
    at, to = window[rows], partner[rows]
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(to) != 1), [True]]))
    wrong = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if not np.array_equal(flat[at[a] : at[b - 1] + length], flat[to[a] : to[b - 1] + length]):
            wrong.append(rows[a:b])
    if wrong:  # different bytes under one hash: such intervals are told apart by their bytes
        members = np.flatnonzero(np.isin(interval, interval[np.concatenate(wrong)]))
        text = [flat[w : w + length].tobytes() for w in window[members].tolist()]
        count: dict[bytes, float] = {}
        for t, w in zip(text, weight[members].tolist()):
            count[t] = count.get(t, 0) + w
        ok[members] = [count[t] > 1 for t in text]
    return ok


RUN = "gram long, kind long, doc long, first int, last int, w long"
#: members: (level, gram, kind, first, last, n) of the runs whose windows follow each other in the string, as int64.
STRING = "key long, doc long, first int, weight long, members binary, bytes binary"
VERDICT = "level int, gram long, kind long, n long, doc long, from long, until long"
#: The most kinds whose runs are so many that they are found by broadcast.
BROADCAST_KINDS = 200_000


def _arrow(ddl: str, columns: list) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _run_batch(cols: list, doc: list, w: list) -> pa.RecordBatch:
    gram, kind, first, last = (np.concatenate(x) for x in zip(*cols))
    return _arrow(RUN, [gram.view(np.int64), kind.view(np.int64), np.concatenate(doc), first.astype(np.int32), last.astype(np.int32), np.concatenate(w)])


def _classes(found: DataFrame) -> DataFrame:
    """A row for each kind of run on an anchor that has several runs: n (runs of the kind), two of them, kinds on the anchor."""
    place = F.struct("doc", "first", "last")
    kinds = found.groupBy("gram", "kind").agg(F.sum("w").alias("n"), F.min(place).alias("one"), F.max(place).alias("two"))
    anchors = kinds.groupBy("gram").agg(F.sum("n").alias("runs"), F.count(F.lit(1)).alias("kinds")).where("runs > 1")
    return kinds.join(anchors, "gram").select("gram", "kind", "n", "one", "two", "kinds")


def _texts(rows) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8) for t in rows]


def _finer(keyed: DataFrame, hot_kinds: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """The runs of one of each kind, cut into groups of `step` places; w: as how many runs the kind counts."""
    own = hot_kinds.select("one.*", "n").groupBy("doc").agg(F.collect_list(F.struct("first", "last", "n")).alias("runs"))

    def cut(batches):
        for batch in batches:
            for part in slabs(batch, 1):
                cols, docs, times = [], [], []
                for doc, raw, runs_ in zip(part.column(0).to_pylist(), _texts(part.column(1)), part.column(2).to_pylist()):
                    for r in runs_:
                        cols.append(cores(raw, r["first"], r["last"], gram, length, step))
                        docs.append(np.full(len(cols[-1][0]), doc, np.int64))
                        times.append(np.full(len(cols[-1][0]), r["n"], np.int64))
                if cols:
                    yield _run_batch(cols, docs, times)

    # rows that repeat are one document here; n counts them
    return map_arrow(keyed.join(own, "doc").select("doc", "text", "runs"), cut, RUN).dropDuplicates(["gram", "kind", "doc", "first"])


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """doc, spans (array of from, until in bytes) of the windows of keyed (doc, text) that occur anywhere else."""
    hot = HOT if hot is None else hot

    def find(batches):
        for batch in batches:
            for part in slabs(batch, 1):
                *cols, of = runs(_texts(part.column(1)), length, gram)
                if len(of):
                    yield _run_batch([cols], [part.column(0).to_numpy()[of]], [np.ones(len(of), np.int64)])

    found, sent = [written(map_arrow(keyed.select("doc", "text"), find, RUN))], []
    for level, step in enumerate((*STEPS, None)):
        classes = written(_classes(found[level]))
        # one string of each kind, two if it has several. Where an anchor has one kind only, or is cut finer, these two
        # meet apart, and those of neighbouring runs of the same two documents make one string
        send = classes.where((F.col("n") > 1) | (F.col("kinds") <= hot) & (F.col("kinds") > 1))
        same, pair = F.col("one") == F.col("two"), (F.col("kinds") > hot) | (F.col("kinds") == 1)
        apart = F.xxhash64("one.doc", "two.doc", F.col("two.first") - F.col("one.first"), F.shiftright("one.first", 16))
        reps = F.when(same, F.array("one")).otherwise(F.array("one", "two"))
        sent.append(send.select(F.lit(level).alias("level"), "gram", "kind", "n", F.when(same, F.col("n")).otherwise(F.lit(1)).alias("weight"), pair.alias("pair"), F.when(pair, apart).otherwise(F.xxhash64("gram")).alias("key"), F.explode(reps).alias("at")))
        hot_kinds = classes.where(F.col("kinds") > hot)
        if step is None or not hot_kinds.take(1):
            break
        found.append(written(_finer(keyed, hot_kinds, length, gram, step)))
    every = sent[0]
    for more in sent[1:]:
        every = every.union(more)
    per_doc = every.select("at.doc", F.struct("level", "gram", "kind", "at.first", "at.last", "n", "weight", "pair", "key").alias("r")).groupBy("doc").agg(F.collect_list("r").alias("runs"))

    def gather(batches):
        for batch in batches:
            for part in slabs(batch, 1, 1 << 20):
                docs, raws, lists = part.column(0).to_numpy(), _texts(part.column(1)), part.column(2)
                own = lists.flatten()
                of = np.repeat(np.arange(len(docs)), lists.value_lengths().to_numpy())
                x = {c: own.field(c).to_numpy(zero_copy_only=False) for c in ("level", "gram", "kind", "first", "last", "n", "weight", "pair", "key")}
                order = np.lexsort((x["first"], x["weight"], x["key"], x["pair"], of))
                of, x = of[order], {c: v[order] for c, v in x.items()}
                alone = np.ones(len(of), bool)
                alone[1:] = ~x["pair"][1:] | ~x["pair"][:-1] | (of[1:] != of[:-1]) | (x["key"][1:] != x["key"][:-1]) | (x["weight"][1:] != x["weight"][:-1]) | (x["first"][1:] != x["last"][:-1] + 1)
                cuts = np.append(np.flatnonzero(alone), len(of))
                members = np.stack([x[c].astype(np.int64) for c in ("level", "gram", "kind", "first", "last", "n")], 1)
                first, last, text_of = x["first"].tolist(), x["last"].tolist(), of.tolist()
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                if spans:
                    yield _arrow(STRING, [x["key"][cuts[:-1]], docs[of[cuts[:-1]]], x["first"][cuts[:-1]], x["weight"][cuts[:-1]].astype(np.int64), [members[a:b].tobytes() for a, b in spans], [raws[text_of[a]][first[a] : last[b - 1] + length].tobytes() for a, b in spans]])

    strings = written(map_arrow(keyed.join(per_doc, "doc").select("doc", "text", "runs"), gather, STRING))
    total = strings.agg(F.sum(F.length("bytes"))).first()[0] or 0
    bundles = total // BUNDLE + 1

    def compare(table: pa.Table) -> pa.Table:
        # a document whose row repeats sends its strings each time
        rows = list({(r["key"], r["doc"], r["first"], r["members"]): r for r in table.to_pylist()}.values())
        out = []
        if len(rows) > 1 or rows[0]["weight"] > 1:
            for r, again in zip(rows, repeated_windows([r["bytes"] for r in rows], length, [r["weight"] for r in rows], [r["doc"] % SHARDS for r in rows])):
                for level, gram_, kind, first, last, n in np.frombuffer(r["members"], np.int64).reshape(-1, 6).tolist():
                    own = again[first - r["first"] : last + 1 - r["first"]]
                    if n > 1 and own.all():
                        out.append((level, gram_, kind, n, None, None, None))
                    elif own.any():
                        edge = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
                        a, b = np.flatnonzero(edge == 1) + first, np.flatnonzero(edge == -1) - 1 + first + length
                        out += [(None, None, None, None, r["doc"], x, y) for x, y in zip(a.tolist(), b.tolist())]
        return pa.Table.from_batches([_arrow(VERDICT, list(zip(*out)) or [[]] * 7)])

    dealt = strings.withColumn("_b", F.pmod("key", F.lit(bundles)))
    verdicts = written(dealt.groupBy("_b").applyInArrow(compare, VERDICT))
    spans = verdicts.where("doc IS NOT NULL").select("doc", "from", "until")
    for level, runs_ in enumerate(found):
        whole = verdicts.where(F.col("level") == level).select("gram", "kind", "n").distinct()
        # at most BROADCAST_KINDS kinds have more than this share of all runs
        many = F.broadcast(whole.where(F.col("n") > max(10_000, runs_.count() // BROADCAST_KINDS)).select("gram", "kind"))
        few = runs_.join(many, ["gram", "kind"], "left_anti").join(whole.select("gram", "kind"), ["gram", "kind"], "left_semi")
        for part in (few, runs_.join(many, ["gram", "kind"], "left_semi")):
            spans = spans.union(part.select("doc", F.col("first").cast("long"), (F.col("last") + length).cast("long")))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("from", "until")).alias("spans"))


def _joined(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["until"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """Columns of docs with n_bytes, n_removed, removed (maximal removed byte ranges) and kept (remaining bytes).

    Removed is each byte of the UTF-8 text that lies in a string of `length` bytes that starts anywhere else too,
    in the same document or another, all judged on the input; matches don't cross documents. Null counts as empty;
    texts of fewer than `length` bytes keep everything. Equal rows repeat each other. Any doc_id, null included, will
    do: rows are told apart by a hash of id and text. An empty table gives no rows. keep: columns to return (default
    all); such as have the new columns' names are replaced.
    """
    keep = list(docs.columns if keep is None else keep)
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    keyed = docs.select(key.alias("doc"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(keyed, length, gram, hot)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep if c != "text"], F.col("text").cast("string").alias("text"), key.alias("_doc"))
    rows = rows.join(spans.select(F.col("doc").alias("_doc"), F.col("spans").alias("_spans")), "_doc", "left")

    def make(text: pa.Array, found: pa.Array) -> list[pa.Array]:
        sizes, lost, ranges, rest = [], [], [], []
        for t, s in zip(text, found.to_pylist()):
            raw = memoryview(t.as_buffer()) if t.is_valid else memoryview(b"")
            own, at, parts = _joined(s), 0, []
            for a, b in own:
                parts.append(raw[at:a])
                at = b
            parts.append(raw[at:])
            sizes.append(len(raw))
            lost.append(sum(b - a for a, b in own))
            ranges.append([{"from": a, "until": b} for a, b in own])
            rest.append(b"".join(parts))
        return [pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("from", pa.int64()), ("until", pa.int64())]))), pa.array(rest, pa.binary())]

    return append_columns(rows, keep, ["text", "_spans"], "n_bytes long, n_removed long, removed array<struct<from:long,until:long>>, kept binary", make)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its repeated 400-byte strings; see remove_repeats()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
