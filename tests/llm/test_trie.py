import hashlib
import random
import zlib

import pytest

from paperloom.llm import trie
from paperloom.llm.trie import op12_prefix_trie, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """Turn lists of the rebuilt conversations by id, by the rule read from the contract."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16])
    own = {c: [r[1:] for r in sorted(v, key=key)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(rows):
    convs, nodes = rebuilt(rows), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [(p, m) for p, m in nodes.items() if p[: len(path)] == path]
        childless = [p for p, _ in below if not any(q[:-1] == p for q in nodes if q)]
        saved = sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        kids = sum(len(p) == len(path) + 1 for p, _ in below)
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), kids, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def random_turns(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([*range(-7, 40), 1_000_000_000_003]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None, ""]), rng.choice(["same", "same", "other", None, "", "é", "x" * 100_000])) for _ in range(n)]


@pytest.mark.parametrize("n,hot", [(40, 2000), (260, 2000), (260, 1)])
def test_equals_plain_trie(spark, monkeypatch, n, hot):
    monkeypatch.setattr(trie, "HOT", hot)
    rows = random_turns(n, n) + [(None, 1, "user", "left out")]
    df = spark.createDataFrame([(*r, "x", b"", 5) for r in rows], TURNS + ", node string, parent binary, _base int").repartition(5)
    got = prefix_trie(df)
    assert got.columns == ["node", *COLUMNS]
    assert sorted([tuple(r) for r in got.drop("node").collect()], key=str) == plain(rows)


def test_common_first_turns_and_copies(spark):
    # all begin alike, half are whole copies
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 else f"{t}" if c % 2 else f"{c} {t}") for c in range(300) for t in range(12)]
    got = prefix_trie(spark.createDataFrame(rows, TURNS).repartition(9)).drop("node").collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows)


def test_ends_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(c * 3, 0, "user", "same") for c in range(100)]
    got = prefix_trie(spark.createDataFrame(rows, TURNS)).drop("node").collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows)


def test_long_conversation_and_empty_table(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 1 WHEN id % 4 = 1 THEN 2 ELSE id END AS conv_id", "id AS turn", "'user' AS role", "'again' AS text")
    got = prefix_trie(rows)
    root = got.where("depth = 0").first()
    assert root["n_convs"] == 5002 and root["parent_conv_id"] is None and got.agg({"depth": "max"}).first()[0] == 10_000 - zlib.crc32(b"1") % 9
    assert root["n_leaves"] == 1
    assert prefix_trie(rows.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op12_prefix_trie(spark, f"/root/testdata/{sf}")
    assert got.columns == COLUMNS
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(rows)
