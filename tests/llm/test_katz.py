import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import katz as K


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]


def turing(n):
    """Discounts by count, from the counts of counts."""
    d, common = {}, (K.K + 1) * n[K.K + 1] / n[1] if n[1] else 1
    for r in range(1, K.K + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


class Brute:
    def __init__(self, texts):
        toks = [tokens(t) for t in texts]
        self.uni = Counter(w for t in toks for w in t)
        self.bi = Counter(p for t in toks for p in zip(["<s>"] + t, t))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        n_of = Counter(self.bi.values())
        self.d = turing(n_of)
        self.e = turing(Counter(self.uni.values()))
        self.follow = {}
        for (h, w), c in self.bi.items():
            self.follow.setdefault(h, {})[w] = c

    def base(self, w):
        return (self.uni[w] + 1) / (self.n + self.v + 1)

    def p1(self, w):
        freed = sum((1 - self.e[c]) * c for c in self.uni.values() if c <= K.K)
        total, freed = (self.n, freed) if freed > 0 else (self.n + 1, 1)
        c = self.uni[w]
        return ((self.e[c] if c <= K.K else 1) * c if c else freed) / total

    def p(self, w, h):
        f = self.follow.get(h)
        if not f:
            return self.p1(w)
        total = sum(f.values())
        freed = sum((1 - self.d[c]) * c for c in f.values() if c <= K.K)
        if freed <= 0:
            total, freed = total + 1, 1
        if w in f:
            return (self.d[f[w]] if f[w] <= K.K else 1) * f[w] / total
        return freed / total / (1 - sum(map(self.p1, f))) * self.p1(w)


TEXTS = ["the cat sat on the mat", "The cat ate the rat", "a dog sat", "", None, "new words only here", "the the the the the the the the", "x y x y x y x y x y x y x y", "\tx\x1cy  z\n"] + [f"the cat w{i % 7} sat w{i % 3} on the {i % 5}" for i in range(40)]


@pytest.mark.parametrize(("hot", "narrow"), [(2_000_000, K.NARROW), (5, K.NARROW), (5, 1)])
def test_scores_against_brute_force(spark, monkeypatch, hot, narrow):
    monkeypatch.setattr(K, "HOT", hot)
    monkeypatch.setattr(K, "NARROW", narrow)
    monkeypatch.setattr(K, "BUCKET_BYTES", 700)
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "the cat", "x"), (None, "the dog", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = K.katz(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, shard_tokens=60)
    ref = Brute([t for i, t, _ in rows if not held(i)])
    assert (model.totals.tokens, model.totals.types) == (ref.n, ref.v)
    assert sum(r[0] for r in model.pairs.where("kind = 'model'").select("n_types").collect()) == len(ref.bi)
    want = []
    for i, t, _ in rows:
        w = tokens(t)
        want.append((i, held(i), len(w), sum(ref.uni[x] > 0 for x in w), ref.n, sum(math.log10(ref.base(x)) for x in w), sum(math.log10(ref.p(x, h)) for h, x in zip(["<s>"] + w, w))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted(map(tuple, model.scores.collect()), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=1e-5)
    assert sum(map(ref.p1, ref.uni)) + ref.p1("<unk>") == pytest.approx(1)
    counts = np.array([*ref.uni.values(), 0])
    assert model.totals.unigram(counts).sum() == pytest.approx(1, abs=1e-12)
    words = model.words.where("kind = 'model'").collect()
    numbers = np.concatenate([K.unpack(r["stats"], np.uint64) for r in words])
    assert len(set(numbers.tolist())) == len(numbers) == ref.v
    for h in ["<s>", "the", "x", "never"]:
        assert sum(ref.p(w, h) for w in ref.uni) + ref.p("<unk>", h) == pytest.approx(1)


class Deep:
    """Katz backoff of any order by plain recursion; a text's start is a history of one word."""

    def __init__(self, texts, order):
        self.lowest = Brute(texts)
        self.d, self.follow = {}, {}
        for n in range(2, order + 1):
            grams = Counter(tuple(t[i : i + n]) for t in (["<s>"] + tokens(t) for t in texts) for i in range(len(t) - n + 1))
            self.d[n] = turing(Counter(grams.values()))
            for g, c in grams.items():
                self.follow.setdefault(g[:-1], {})[g[-1]] = c

    def p(self, w, h):
        if not h:
            return self.lowest.p1(w)
        f, d = self.follow.get(h), self.d[len(h) + 1]
        if not f:
            return self.p(w, h[1:])
        total = sum(f.values())
        freed = sum((1 - d[c]) * c for c in f.values() if c <= K.K)
        if freed <= 0:
            total, freed = total + 1, 1
        if w in f:
            return (d[f[w]] if f[w] <= K.K else 1) * f[w] / total
        return freed / total / (1 - sum(self.p(x, h[1:]) for x in f)) * self.p(w, h[1:])


@pytest.mark.parametrize(("order", "hot", "narrow"), [(3, 500_000, K.NARROW), (3, 5, 1), (4, 5, K.NARROW)])
def test_every_order_backs_off_to_the_one_below(spark, monkeypatch, order, hot, narrow):
    monkeypatch.setattr(K, "HOT", hot)
    monkeypatch.setattr(K, "NARROW", narrow)
    monkeypatch.setattr(K, "BUCKET_BYTES", 700)
    texts = TEXTS + ["a a a b " * 9, "the cat sat w1 never on the cat", "b a a b a a a a", "on the 3 cat w2 sat on the 3"] * 2
    rows = list(enumerate(texts))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = K.katz(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 2, shard_tokens=60, order=order)
    ref = Deep([t for i, t in rows if not held(i)], order)
    assert [sum(r[0] for r in t.where("kind = 'model'").select("n_types").collect()) for t in model.orders] == [sum(len(f) for h, f in ref.follow.items() if len(h) == n) for n in range(1, order)]
    got = {r["doc_id"]: r["score"] for r in model.scores.collect()}
    for i, t in rows:
        w = ["<s>"] + tokens(t)
        assert got[i] == pytest.approx(sum(math.log10(ref.p(w[k], tuple(w[max(0, k - order + 1) : k]))) for k in range(1, len(w))), rel=1e-5)
    for h in [("<s>",), ("<s>", "the"), ("on", "the"), ("a", "a"), ("never", "the")]:
        assert sum(ref.p(x, h) for x in ref.lowest.uni) + ref.p("<unk>", h) == pytest.approx(1)


def test_the_query_scores_by_trigrams(spark, tmp_path):
    rows = [(i, "b x y" if i % 2 else "a x z") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # y follows x in half of the texts, but always after b
    assert min(r["score"] for r in K.op3_katz_score(spark, str(tmp_path)).collect()) > math.log10(0.5) - 0.15


def test_empty_tables_and_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert K.katz(docs.limit(0), F.lit(True)).scores.count() == 0
    r = K.katz(docs, F.lit(False)).scores.first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)


def test_packing_round_trips():
    for dtype in (np.uint32, np.int64, np.float64):
        x = np.arange(5).astype(dtype) * 7
        assert (K.unpack(K.pack(x), dtype) == x).all() and len(K.unpack(K.pack(x[:0]), dtype)) == 0


def test_counts_over_four_bytes():
    for most in (0, 5, K.NARROW, K.NARROW + 1, 1 << 50):
        x = np.array([most, 1, 0], np.int64)
        raw = K.pack_counts(x)
        assert raw[0] == (4 if most <= K.NARROW else 8) and K.unpack_counts(raw).tolist() == x.tolist()
    assert K.pack_counts(np.array([2]), 1)[0] == 8 and len(K.unpack_counts(K.pack_counts(np.zeros(0)))) == 0
