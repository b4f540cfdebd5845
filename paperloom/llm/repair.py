"""Operator 13: repair of conversation structure by lazy determinisation of a weighted edit automaton.

A conversation is brought to the role pattern `(s?(ua)+)?` by edits of least cost. The edits are a weighted automaton
over four states (nothing yet, after a system turn, after a user turn, after an assistant turn). Reading a turn turns the
vector of the states' costs into the next one; vectors less their least value are the states of a deterministic
automaton, found as they occur and kept in a transition table, so that a conversation's cost is one table look-up a
turn. A trace back over the vectors marks the states that lie on some cheapest path by their tight arcs (arcs whose cost
equals the difference of the vectors); reading the marked arcs from the front, least letter first, gives the audit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, written
from .sharding import CRC_SQL, crc_sql

KEEP, REROLE, DELETE, INSERT = "KRDI"
#: Costs: of a rerole, an inserted turn, a deleted turn, and of a truncated turn that stays.
REROLE_COST, INSERT_COST, DELETE_COST, TRUNCATED_COST = 2, 2, 3, 1
#: Faults of a turn, and initials of roles (3: any other); a turn's symbol is 4 * fault + initial.
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS = "sua"
SPACE = "\t\n\x0b\x0c\r "
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled turn: an assistant's after a user's, else a user's.
OTHER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 30


def kept_state(q: int, initial: int) -> int | None:
    """The state after a turn of that initial is kept in state q; None where the pattern forbids it."""
    if initial == 0:
        return SYSTEM if q == START else None
    if initial == 1:
        return None if q == USER else USER
    return ASSISTANT if initial == 2 and q == USER else None


def row_arcs(q: int, symbol: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one turn in state q, by letter."""
    fault, initial = divmod(symbol, 4)
    arcs = [(DELETE, DELETE_COST, q)]
    if fault in (CLEAN, TRUNCATED):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        to = kept_state(q, initial)
        if to is not None:
            arcs.append((KEEP, more, to))
        arcs.append((REROLE, REROLE_COST + more, OTHER[q]))
    return arcs


class Repairs:
    """The automaton's vectors and tables, which grow as symbols are read; a task has one.

    Vectors are few: after inserts the user's and assistant's states differ by two at most, and a start or system state
    that can't be on a cheapest path any more is dropped. From the assistant's state whatever follows the system's state
    costs the same, and what follows the start costs three more at most (a kept system turn is deleted instead).
    """

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.next: list[list[int]] = []
        self.cost: list[list[int]] = []
        self.back: dict[tuple[int, int, int], int] = {}
        self.steps: dict[tuple[int, int, int, int, int], tuple[str, int]] = {}
        self.first = self._number(self._closed([0, NEVER, NEVER, NEVER]))[0]

    @staticmethod
    def _closed(v: list[int]) -> list[int]:
        for _ in range(2):
            for q in range(4):
                v[OTHER[q]] = min(v[OTHER[q]], v[q] + INSERT_COST)
        if v[START] > v[ASSISTANT] + DELETE_COST:
            v[START] = NEVER
        if v[SYSTEM] > v[ASSISTANT]:
            v[SYSTEM] = NEVER
        return v

    def _number(self, v: list[int]) -> tuple[int, int]:
        least = min(v)
        key = tuple(x - least if x < NEVER else NEVER for x in v)
        if key not in self.known:
            self.known[key] = len(self.vectors)
            self.vectors.append(key)
            self.next.append([-1] * 16)
            self.cost.append([0] * 16)
        return self.known[key], least

    def _learn(self, at: int, symbol: int) -> int:
        new = [NEVER] * 4
        for q, w in enumerate(self.vectors[at]):
            if w < NEVER:
                for _, cost, to in row_arcs(q, symbol):
                    new[to] = min(new[to], w + cost)
        self.next[at][symbol], self.cost[at][symbol] = self._number(self._closed(new))
        return self.next[at][symbol]

    def scan(self, symbols: bytes) -> tuple[list[int], int]:
        """The vector before every turn and after the last one, and the least cost of the whole."""
        at, cost, nexts, path = self.first, 0, self.next, [self.first]
        for x in symbols:
            to = nexts[at][x]
            if to < 0:
                to = self._learn(at, x)
            cost += self.cost[at][x]
            at = to
            path.append(at)
        v = self.vectors[at]
        return path, cost + min(v[START], v[ASSISTANT])

    def _with_inserts(self, at: int, marks: int) -> int:
        """The marked states of a vector, and those from which tight inserts lead to one."""
        v = self.vectors[at]
        for _ in range(3):
            for q in range(4):
                if v[q] < NEVER and marks >> OTHER[q] & 1 and v[q] + INSERT_COST == v[OTHER[q]]:
                    marks |= 1 << q
        return marks

    def _marked(self, at: int, symbol: int, to: int, marks: int) -> int:
        """The states before a turn that lie on a cheapest path, from those after it."""
        key = (at, symbol, marks)
        found = self.back.get(key)
        if found is None:
            v, w, less = self.vectors[at], self.vectors[to], self.cost[at][symbol]
            found = 0
            for q in range(4):
                if v[q] < NEVER and any(marks >> t & 1 and v[q] + c == w[t] + less for _, c, t in row_arcs(q, symbol)):
                    found |= 1 << q
            found = self.back[key] = self._with_inserts(at, found)
        return found

    def _step(self, at: int, symbol: int, to: int, marks: int, after: int, q: int) -> tuple[str, int]:
        """The least letters from state q over one turn, and the state that they lead to."""
        v, w, less, out = self.vectors[at], self.vectors[to], self.cost[at][symbol], ""
        while True:
            tight = {x: t for x, c, t in row_arcs(q, symbol) if after >> t & 1 and v[q] + c == w[t] + less}
            if DELETE in tight:
                return out + DELETE, tight[DELETE]
            if marks >> OTHER[q] & 1 and v[q] + INSERT_COST == v[OTHER[q]]:
                out, q = out + INSERT, OTHER[q]
                continue
            letter = KEEP if KEEP in tight else REROLE
            return out + letter, tight[letter]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Least cost, and of the cheapest edits the letters that come first in ASCII order.

        In one state every letter leads to one state only, so that the least tight letter at each step is right.
        """
        path, cost = self.scan(symbols)
        n, v = len(symbols), self.vectors[path[-1]]
        best = min(v[START], v[ASSISTANT])
        ends = self._with_inserts(path[-1], sum(1 << q for q in (START, ASSISTANT) if v[q] == best))
        marks = bytearray(n + 1)
        marks[n] = ends
        for i in range(n - 1, -1, -1):
            marks[i] = self._marked(path[i], symbols[i], path[i + 1], marks[i + 1])
        q, out = START, []
        for i in range(n):
            key = (path[i], symbols[i], marks[i], marks[i + 1], q)
            step = self.steps.get(key)
            if step is None:
                step = self.steps[key] = self._step(path[i], symbols[i], path[i + 1], marks[i], marks[i + 1], q)
            out.append(step[0])
            q = step[1]
        while not (q in (START, ASSISTANT) and v[q] == best):
            out.append(INSERT)
            q = OTHER[q]
        return cost, "".join(out)


# ---------------------------------------------------------------- rows


def _text_hash() -> Column:
    """128 bits by which role and text are known; they also order rows of one turn number."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32))


def _keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in role and text, and _h."""
    some = rows.where("conv_id IS NOT NULL").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return some.withColumn("_h", _text_hash())


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _reports(batches):
    """One report row for each conversation of rows sorted by (conv_id, turn): counts, least cost and audit.

    Of a conversation under way there is a byte for every turn, as the audit itself needs.
    """
    automaton, conv, symbols, turns = Repairs(), None, bytearray(), None

    def done():
        pairs = np.frombuffer(bytes(symbols), np.uint8)
        faults, initials = pairs >> 2, pairs & 3
        legal = np.zeros((4, 4), bool)
        for a, b in LEGAL:
            legal[a, b] = True
        cost, audit = automaton.repair(bytes(symbols))
        least, last, distinct = turns
        gaps = last - least + 1 - distinct if distinct else 0
        return conv, gaps, *(int((faults == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)), int((~legal[initials[:-1], initials[1:]]).sum()), cost, audit

    names = [x.split()[0] for x in REPORT.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in REPORT.split(", ")]
    for batch in batches:
        ids, found = batch.column(0).to_numpy(), []
        null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        turn = batch.column(1).fill_null(0).to_numpy()
        codes = batch.column(2).to_numpy().astype(np.uint8)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)] if len(ids) else []
        for a, b in zip(cuts, cuts[1:]):
            if ids[a] != conv:
                if conv is not None:
                    found.append(done())
                conv, symbols, turns = int(ids[a]), bytearray(), (0, 0, 0)
            symbols += codes[a:b].tobytes()
            known = turn[a:b][~null[a:b]]
            if len(known):
                least, last, distinct = turns
                new = int((known[1:] != known[:-1]).sum()) + (not distinct or int(known[0]) != last)
                turns = (least if distinct else int(known[0]), int(known[-1]), distinct + new)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), types)], names=names)


def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation in rows (conv_id, turn, role, text).

    A turn's first fault counts: blank (white space only), duplicate (role and text seen earlier in the conversation),
    truncated (its last other character is none of `.!?`). gaps: turn numbers missing between the least and the largest.
    illegal: adjacent turns whose roles' initials aren't su, ua or au. audit: the letters of the cheapest edits in order
    (K keep, R rerole, D delete, I insert), the first in ASCII order of several; blank and duplicate turns are deleted.

    Nulls: rows without conv_id belong to no conversation and are left out; a null turn comes first and isn't counted in
    gaps; a null role or text is empty. Turns of one number are ordered by a hash of role and text, so repeated rows stand
    side by side, and all but one are duplicates. Texts may be of any length: only a symbol and a hash of each are sent.
    Extra columns are ignored. An empty table gives no rows. A conversation may hold any number of turns: it is read as a
    stream, with three bytes or so a turn kept for the trace.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == x, i) for i, x in enumerate(INITIALS)], F.lit(3))
    fault = F.when(body == "", BLANK).when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    narrow = _keyed(rows).select("conv_id", "turn", "_h", initial.alias("_initial"), fault.alias("_fault"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "_h").orderBy(F.col("turn").asc_nulls_first()))
    narrow = narrow.repartition("conv_id").withColumn("_seen", seen)
    fault = F.when((F.col("_fault") != BLANK) & (F.col("_seen") > 1), DUPLICATE).otherwise(F.col("_fault"))
    coded = narrow.withColumn("_symbol", (4 * fault + F.col("_initial")).cast("int"))
    coded = coded.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "_h")
    return map_arrow(coded.select("conv_id", "turn", "_symbol"), _reports, REPORT)


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _repaired(batches):
    """(conv_id, place, edit, role, text) of the repaired turns, from rows sorted so that each conversation's audit comes first."""
    conv, audit, body, at, place, q = None, "", 0, 0, 0, START

    def inserted():
        nonlocal at, place, q
        while at < len(audit) and audit[at] == INSERT:
            q, at, place = OTHER[q], at + 1, place + 1
            yield conv, place - 1, INSERT, ROLE[q], ""

    for batch in batches:
        for one, edits, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if edits is not None:
                conv, audit, body, at, place, q = one, edits, len(edits.rstrip(INSERT)), 0, 0, START
                continue
            yield from inserted()
            letter = audit[at]
            at += 1
            if letter != DELETE:
                q = OTHER[q] if letter == REROLE else kept_state(q, INITIALS.find(role[:1]) % 4 if role else 3)
                place += 1
                yield conv, place - 1, letter, ROLE[q] if letter == REROLE else role, text
            # inserts before a turn are made when it comes, those at the end after the last turn
            if at == body:
                yield from inserted()


def _with_audits(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Turns and audits of the same conversations side by side: audit first, then turns in the order of the report."""
    none = F.lit(None)
    both = _keyed(rows).select("conv_id", F.lit(1).alias("_kind"), "turn", "_h", none.cast("string").alias("audit"), "role", "text")
    both = both.unionByName(reports.select("conv_id", F.lit(0).alias("_kind"), none.cast("bigint").alias("turn"), none.cast("binary").alias("_h"), "audit", none.cast("string").alias("role"), none.cast("string").alias("text")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_kind", F.col("turn").asc_nulls_first(), "_h").select("conv_id", "audit", "role", "text")


def repaired_turns(rows: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """conv_id, place (from 0), edit, role, text of every turn after repair; reports: those of repair_report(rows), if at hand.

    Kept turns hold their role and text, reroled ones a new role, inserted ones an empty text. Edge cases: as repair_report.
    """

    def run(batches, size: int = 4096):
        made = []
        for row in _repaired(batches):
            made.append(row)
            if len(made) == size:
                yield _batch(made, REPAIRED)
                made = []
        if made:
            yield _batch(made, REPAIRED)

    return map_arrow(_with_audits(rows, written(repair_report(rows)) if reports is None else reports), run, REPAIRED)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.split() for x in ddl.split(", ")]
    arrays = [pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def repaired_digests(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 (of the repaired `role:text`, newline-joined) of conversations with a repaired turn left."""
    ddl = "conv_id long, repaired_sha256 string"

    def run(batches):
        conv, state, made = None, None, []
        for one, place, _, role, text in _repaired(batches):
            if place == 0:
                if state is not None:
                    made.append((conv, state.hexdigest()))
                conv, state = one, hashlib.sha256()
            state.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
            if len(made) >= 4096:
                yield _batch(made, ddl)
                made = []
        if state is not None:
            made.append((conv, state.hexdigest()))
        if made:
            yield _batch(made, ddl)

    return map_arrow(_with_audits(rows, reports), run, ddl)


# ---------------------------------------------------------------- query


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32("conv_id:turn") % 20; nulls (but for turn as an order) are one space."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", *[F.coalesce(F.col(x), F.lit(" ")).alias(x) for x in ("role", "text")])
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_f", F.crc32(key.cast("binary")) % 20).where("_f <> 0")
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_f") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_f") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults, the least cost of repair, the edits and the repaired text's digest."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = damaged(conversations)
    reports = written(repair_report(rows))
    digests = written(repaired_digests(rows, reports))
    ids = conversations.where("conv_id IS NOT NULL").select("conv_id").distinct()
    counts = [F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.join(reports, "conv_id", "left").join(digests, "conv_id", "left")
    return out.select("conv_id", *counts, F.coalesce(F.col("audit"), F.lit("")).alias("audit"), F.coalesce(F.col("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT c.*, {crc_sql("k")} % 20 AS f FROM c, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, unnest(generate_series(1, CASE WHEN f = 0 THEN 0 WHEN f = 3 THEN 2 ELSE 1 END)) AS g(k)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS p FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS seen, substr(role, 1, 1) AS ini,
    regexp_extract(text, '[^\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*$') AS tail FROM o),
r AS (SELECT *, CASE WHEN tail = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN tail[1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY p) || ini AS pair FROM n),
ins(q, q2, n, letters, made) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 1, 'I', ['user:']),
    (1, 2, 1, 'I', ['user:']), (2, 3, 1, 'I', ['assistant:']), (3, 2, 1, 'I', ['user:']), (0, 3, 2, 'II', ['user:', 'assistant:']),
    (1, 3, 2, 'II', ['user:', 'assistant:']), (2, 2, 2, 'II', ['assistant:', 'user:']), (3, 3, 2, 'II', ['user:', 'assistant:'])),
keep(q2, ini, q3) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
act(letter) AS (VALUES ('D'), ('K'), ('R')),
dp AS (SELECT conv_id, 0::BIGINT AS p, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS made FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, p, q, cost, audit, made FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS best FROM (
      SELECT dp.conv_id, r.p, CASE letter WHEN 'D' THEN ins.q2 WHEN 'K' THEN keep.q3 WHEN 'R' THEN CASE WHEN ins.q2 = 2 THEN 3 ELSE 2 END END AS q,
        dp.cost + 2 * ins.n + CASE letter WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CASE WHEN letter <> 'D' AND fault = 't' THEN 1 ELSE 0 END AS cost,
        dp.audit || ins.letters || letter AS audit,
        dp.made || ins.made || CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN ins.q2 = 2 THEN 'assistant:' ELSE 'user:' END || text] END AS made
      FROM dp JOIN r ON r.conv_id = dp.conv_id AND r.p = dp.p + 1 JOIN ins ON ins.q = dp.q CROSS JOIN act
        LEFT JOIN keep ON letter = 'K' AND keep.q2 = ins.q2 AND keep.ini = r.ini
      WHERE (letter = 'D' OR fault IN ('', 't')) AND (letter <> 'K' OR keep.q3 IS NOT NULL))) WHERE best = 1),
size AS (SELECT conv_id, max(p) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
ends AS (SELECT dp.conv_id, dp.cost + 2 * ins.n AS cost, dp.audit || ins.letters AS audit, dp.made || ins.made AS made
  FROM dp JOIN size ON size.conv_id = dp.conv_id AND size.n = dp.p JOIN ins ON ins.q = dp.q WHERE ins.q2 IN (0, 3)),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS k FROM ends)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) i LEFT JOIN size USING (conv_id) LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (conv_id)
"""
