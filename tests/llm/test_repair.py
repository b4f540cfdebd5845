import hashlib
import random
import zlib
from functools import cache
from itertools import product

import pytest

from paperloom.llm import repair
from paperloom.llm.repair import Repairs, damaged, op13_structure_repair, repair_report, repaired_turns

TURNS = "conv_id long, turn long, role string, text string"


def best_edits(symbols):
    """(cost, audit) by plain recursion over suffixes; states are the roles that came before."""

    @cache
    def rest(i, last, empty, budget):
        # last: '' at the start, else the initial of the last output; budget: inserts still allowed in a row
        found = []
        if i == len(symbols) and last in ("", "a"):
            found.append((0, ""))
        other = "a" if last == "u" else "u"
        steps = [("I", 2, i, other, budget - 1)] if budget else []
        if i < len(symbols):
            fault, initial = divmod(symbols[i], 4)
            name = "sua?"[initial]
            steps.append(("D", 3, i + 1, last, 3))
            if fault < 2:
                if (name == "s" and last == "") or (name == "u" and last != "u") or (name == "a" and last == "u"):
                    steps.append(("K", fault, i + 1, name, 3))
                steps.append(("R", 2 + fault, i + 1, other, 3))
        for letter, cost, at, now, left in steps:
            more = rest(at, now, False, left)
            if more:
                found.append((cost + more[0], letter + more[1]))
        return min(found) if found else None

    return rest(0, "", True, 3)


def test_all_short_conversations():
    automaton = Repairs()
    for n in range(4):
        for symbols in product(range(16), repeat=n):
            assert automaton.repair(bytes(symbols)) == best_edits(symbols), symbols
    assert len(automaton.vectors) < 100


def test_long_conversations_and_a_finite_table():
    automaton, rng = Repairs(), random.Random(3)
    for _ in range(400):
        symbols = bytes(rng.choices(range(16), [9, 20, 20, 3, 1, 4, 4, 1, 1, 2, 2, 1, 1, 2, 2, 1], k=rng.randrange(4, 60)))
        assert automaton.repair(symbols) == best_edits(tuple(symbols)), symbols
    known = len(automaton.vectors)
    cost, audit = automaton.repair(bytes(rng.choices(range(16), k=300_000)))
    assert known < 200 and len(automaton.vectors) < 200
    assert sum(x != "I" for x in audit) == 300_000


def plain(rows):
    """Report and repaired turns of one conversation's (turn, role, text), ordered as the operator does."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16])
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=key)
    seen, symbols, faults = set(), [], []
    for _, role, text in rows:
        body = text.strip("\t\n\x0b\x0c\r ")
        fault = 2 if not body else 3 if (role, text) in seen else 1 if body[-1] not in ".!?" else 0
        seen.add((role, text))
        faults.append(fault)
        symbols.append(fault * 4 + ("sua".find(role[0]) % 4 if role else 3))
    cost, audit = best_edits(tuple(symbols))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
    out, at, last = [], iter(rows), ""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)[1:]
        if letter == "D":
            continue
        role = role if letter == "K" else "assistant" if last == "u" else "user"
        last = role[0]
        out.append((letter, role, text))
    return (gaps, faults.count(2), faults.count(3), faults.count(1), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit), out


def random_turns(n):
    rng = random.Random(n)
    texts = ["Hello there.", "Why?", "cut off", "", " \n", None, "é!", "same\n", "x" * 200_000]
    return [(rng.randrange(40), rng.choice([None, *range(9)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(n)]


def test_rows_equal_plain_python(spark):
    rows = random_turns(500) + [(None, 1, "user", "left out."), (77, 9_000_000_000, "user", "far."), (77, -5, "assistant", "back."), (-3, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", AUDIT string, _h int").repartition(6)
    want = {c: plain([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows} - {None}}
    assert {r["conv_id"]: tuple(r)[1:] for r in repair_report(df).collect()} == {c: w[0] for c, w in want.items()}
    got = {}
    for r in sorted(repaired_turns(df).collect(), key=lambda r: (r["conv_id"], r["place"])):
        assert r["place"] == len(got.setdefault(r["conv_id"], []))
        got[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
    assert got == {c: w[1] for c, w in want.items() if w[1]}


def test_empty_table(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair_report(none).count() == 0 and repaired_turns(none).count() == 0


def test_one_conversation_of_most_rows(spark):
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 > 0 THEN 1 ELSE id END AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id, '.') AS text")
    report = {r["conv_id"]: r for r in repair_report(rows).where("conv_id < 7").collect()}
    assert len(report[1]["audit"]) >= 20_000 and report[1]["gaps"] == 9999
    assert repaired_turns(rows).where("conv_id = 1").count() == sum(x != "D" for x in report[1]["audit"])


def damage(rows):
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        f = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if f == 1 else text.translate({ord(x): None for x in ".!?"}) if f == 2 else text
        yield from [(c, t, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)


@pytest.mark.parametrize("source", ["made", "sf0.001"])
def test_query_against_plain_python(spark, tmp_path, source):
    if source == "made":
        rows = random_turns(600)
        spark.createDataFrame(rows, TURNS).write.parquet(f"file://{tmp_path}/conversations.parquet")
        sf = f"file://{tmp_path}"
    else:
        sf = "/root/testdata/sf0.001"
        rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    hurt = list(damage(rows))
    assert sorted(map(str, hurt)) == sorted(str(tuple(r)) for r in damaged(spark.read.parquet(f"{sf}/conversations.parquet")).collect())
    want = {}
    for c in {r[0] for r in rows}:
        own, out = plain([r[1:] for r in hurt if r[0] == c])
        want[c] = (*own, hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in out).encode()).hexdigest())
    got = op13_structure_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == want
