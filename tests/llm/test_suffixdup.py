import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import suffixdup
from paperloom.llm.suffixdup import remove_repeats, repeated_windows


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) per text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        rest = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def texts(rng, n, length):
    pool = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(length, 6 * length))) for _ in range(6)]
    out = [None, "", "x" * (length - 1), "x" * (3 * length), "ab" * (2 * length), "x" * length, pool[0], pool[0]]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(p[a : a + rng.randint(1, 3 * length)] if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randint(1, length))))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("hot", "seed"), [(1000, 1), (3, 2), (1, 3), (0, 4)])
def test_against_brute_force(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(suffixdup, "BUNDLE", 4000)
    monkeypatch.setattr(suffixdup, "STRIDE", 8)
    rows = [(i if i % 9 else None, t, "clash") for i, t in enumerate(texts(random.Random(seed), 120, 48))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)
    out = remove_repeats(docs, 48, gram=16, hot=hot)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "removed", "kept"]
    got = sorted((r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect())
    assert got == sorted(brute([t for _, t, _ in rows], 48))


def test_production_length(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = " ".join(word() for _ in range(90))
    rows = [(i, " ".join(word() for _ in range(60)) + shared[i : i + 380 + i] + " ".join(word() for _ in range(30))) for i in range(40)] + [(99, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in remove_repeats(docs).collect()}
    assert got == dict(zip([i for i, _ in rows], brute([t for _, t in rows], 400)))
    assert remove_repeats(docs.limit(0)).count() == 0


def test_runs_of_short_texts_are_found_together(monkeypatch):
    rng = random.Random(12)
    raws = [np.frombuffer(bytes(rng.choice(b"ab") for _ in range(n)), np.uint8) for n in [0, 47, 48, 49, 3000, 700, *[rng.randint(40, 400) for _ in range(200)]]]
    alone = [suffixdup.runs([r], 48, 16)[:4] for r in raws]
    calls, sums = [], suffixdup._sums
    monkeypatch.setattr(suffixdup, "_sums", lambda raw: calls.append(len(raw)) or sums(raw))
    *cols, of = suffixdup.runs(raws, 48, 16)
    assert len(calls) == 1
    for i, want in enumerate(alone):
        assert [c[of == i].tolist() for c in cols] == [c.tolist() for c in want]
        assert sum((want[3] - want[2] + 1).tolist()) == max(0, len(raws[i]) - 47)
    monkeypatch.setattr(suffixdup, "JOINED", 500)
    monkeypatch.setattr(suffixdup, "SLAB", 900)
    *few, of = suffixdup.runs(raws, 48, 16)
    for i, r in enumerate(raws):
        assert sum((few[3] - few[2] + 1)[of == i].tolist()) == max(0, len(r) - 47)


@pytest.mark.parametrize(("shards", "stride"), [(1, 4), (2, 8), (3, 2), (2, None)])
def test_merged_transforms_find_repeated_windows(shards, stride):
    rng = random.Random(shards)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    strings = [base[a : a + rng.randint(32, 120)] for a in (rng.randrange(150) for _ in range(12))] + [b"a" * 80]
    strings = [s for s in strings if len(s) >= 32]
    count = Counter(s[i : i + 32] for s in strings for i in range(len(s) - 31))
    got = repeated_windows(strings, 32, None, [i % shards for i in range(len(strings))], stride)
    assert [g.tolist() for g in got] == [[count[s[i : i + 32]] > 1 for i in range(len(s) - 31)] for s in strings]


def test_strings_of_weight_and_hashes_alike(monkeypatch):
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"abcd") for _ in range(60)) for _ in range(6)]
    strings.append(strings[0][10:50])
    weights = [1, 1, 3, 1, 1, 1, 1]
    count = Counter()
    for s, w in zip(strings, weights):
        for i in range(len(s) - 31):
            count[s[i : i + 32]] += w
    want = [[count[s[i : i + 32]] > 1 for i in range(len(s) - 31)] for s in strings]
    assert [g.tolist() for g in repeated_windows(strings, 32, weights)] == want
    few = suffixdup._hash
    monkeypatch.setattr(suffixdup, "_hash", lambda *a: few(*a) & suffixdup.U64(1))
    assert [g.tolist() for g in repeated_windows(strings, 32, weights)] == want


def test_merged_transforms_give_common_prefixes():
    rng = random.Random(6)
    texts_ = [np.array([rng.randint(1, 2) for _ in range(rng.randint(6, 30))]) for _ in range(5)]
    shards = [suffixdup.Shard(texts_[:2], 4, 1), suffixdup.Shard(texts_[2:], 4, 1)]
    source, common = suffixdup.merge_transforms(shards, 4)
    # suffixes of a cyclic text with its end, by their first four symbols
    rings = [[*t.tolist(), 0] for t in texts_]
    suffixes = sorted(tuple((r + r + r)[i : i + 4]) for r in rings for i in range(len(r)))
    alike = lambda a, b: next((k for k in range(4) if a[k] != b[k]), 4)
    assert common.tolist() == [0] + [alike(a, b) for a, b in zip(suffixes, suffixes[1:])]
    assert np.bincount(source).tolist() == [sum(len(r) for r in rings[:2]), sum(len(r) for r in rings[2:])]
