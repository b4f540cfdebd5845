import random
import re

import numpy as np
import pytest

from paperloom.llm import neardup
from paperloom.llm.graph import connected_components


def brute(rows, size, percent):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids, comp = sorted(sets), {i: i for i in sets}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                if x != y:
                    comp = {k: min(x, y) if c in (x, y) else c for k, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def variants(rng, n):
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.7:
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        else:
            w = [rng.choice(["ab", "Cd", "é", "x1", "yy"]) + str(rng.randrange(50)) for _ in range(rng.choice([2, 3, 4, 5, 30, 80, 200]))]
            base.append(w)
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, pivots", [(1, 24), (2, 2), (1, 1)])
def test_against_all_pairs(spark, monkeypatch, seed, pivots):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    rows = variants(random.Random(seed), 250) + [(2, None), (5, ""), (8, " \n"), (11, "one"), (14, "ONE"), (17, "one two")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = neardup.near_duplicates(docs, 4, 80)
    assert got.columns == ["doc_id", "text", "n_shingles", "component_id", "kept"]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()}
    assert found == brute(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_repeated_ids_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text), (4, text), (9, text), (None, text), (6, None), (9, "other words that are not shared here")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (4, 4, True), (4, 4, True), (6, 6, True), (9, 4, False), (9, 4, False)]
    kept = neardup.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1, (r["text"] or "")[:2]) for r in kept.collect()) in ([(-1, "w0"), (4, "w0"), (6, ""), (9, "ot")], [(-1, "w0"), (6, ""), (9, "ot"), (9, "w0")])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(5)
    chain = list(range(0, 300))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, i) for i in range(1001, 1200)] + [(5000, 5001), (5001, 5001)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in chain}, **{i: 1000 for i in range(1000, 1200)}, 5000: 5000, 5001: 5000}


def test_pruning_keeps_what_the_posterior_allows():
    least = neardup.least_matches(0.8, 1e-7)
    assert list(least) == sorted(least) and least[-1] < 0.8 * neardup.BANDS * neardup.ROWS
    rng = np.random.default_rng(2)
    for _ in range(50):
        common, own = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, 200).astype(np.uint64)
        a, b = np.unique(np.concatenate([common, own[:100]])), np.unique(np.concatenate([common, own[100:]]))
        sigs = np.stack([neardup.signature(a), neardup.signature(b)])
        assert len(neardup._survivors(sigs, 0, np.array([1]), least)) == 1


def test_all_links_of_the_test_documents(spark):
    """Against an exact join on shingles: recall 1 on the table of 1,000 documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, by = {}, {}
    for i, t in docs.select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
        for g in sets[i]:
            by.setdefault(g, []).append(i)
    common = {}
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] = common.get((a, b), 0) + 1
    linked = [(a, b) for (a, b), k in common.items() if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k)]
    comp = {i: i for i in sets}
    for a, b in linked:
        x, y = comp[a], comp[b]
        comp = {k: min(x, y) if c in (x, y) else c for k, c in comp.items()} if x != y else comp
    assert len(linked) > 50
    got = neardup.op5_near_duplicates(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
