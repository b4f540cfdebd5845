"""Operator 6: secret scans. Fixed patterns plus sliding-window Shannon entropy, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns: kind, expression, group whose length counts, its least length.
BASE = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
)


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of `chars` of at least `window` code points in which every pattern of `needs` occurs."""

    name: str
    chars: str
    alphabet: str
    window: int
    least: float
    needs: tuple[str, ...]


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", "0123456789ABCDEFabcdef", 20, 2.95, ("[0-9]", "[A-Fa-f]")),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", DIGITS + LOWER + UPPER + "+/_=-", 20, 3.95, ("[0-9]", "[a-z]", "[A-Z]")),
)
#: A candidate that matches one of these is no secret: a UUID, a named example, an ordered alphabet, a path of lower-case words.
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|sample|placeholder|dummy|changeme|redacted",
    "0123456789|abcdefghij|ABCDEFGHIJ",
    "^(?!.*[_/-]{2})/?[a-z][a-z_/-]*[_/-][a-z0-9]*$",
)
#: Matches gathered at a time, and windows of a part of a very long candidate.
MATCHES, PART = 512, 1 << 16
#: Entropies are summed as whole numbers of 2**-SCALE bits, so that updates add up exactly.
SCALE = 40
SPAN = "struct<start:bigint,order:int,stop:bigint,kind:string>"


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, not at every mention."""
    return F.transform(F.array(value), use)[0]


def _folded(items: Column, state: Column, step) -> Column:
    """The spans that step(state, item) -> (next state, array of spans) gives along an array, one after another.

    They are appended to short arrays, and these to one array, so that the cost of very many stays near linear.
    """

    def some(acc: Column, block: Column) -> Column:
        def one(inner: Column, item: Column) -> Column:
            return _bound(step(inner["state"], item), lambda x: F.struct(x["state"].alias("state"), F.when(F.size(x["out"]) > 0, F.concat(inner["out"], x["out"])).otherwise(inner["out"]).alias("out")))

        zero = F.struct(acc["last"]["state"].alias("state"), _none().alias("out"))
        return F.struct(F.aggregate(F.slice(items, block * MATCHES + 1, F.lit(MATCHES)), zero, one).alias("last"), F.concat(acc["done"], F.array(acc["last"]["out"])).alias("done"))

    zero = F.struct(F.struct(state.cast("bigint").alias("state"), _none().alias("out")).alias("last"), F.array().cast(f"array<array<{SPAN}>>").alias("done"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / MATCHES).cast("int"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, zero, some, lambda x: F.flatten(F.concat(x["done"], F.array(x["last"]["out"]))))).otherwise(_none())


def _located(text: Column, pattern: str, kind: str, order: int, test, group: int = 0) -> Column:
    """The spans of the matches of pattern for which test(its group) holds; places in code points."""

    def spans_of(all_: Column) -> Column:
        def step(at: Column, k: Column) -> Column:
            start = at + F.length(F.element_at(all_["gaps"], k))
            stop = start + F.length(F.element_at(all_["matches"], k))
            span = F.struct(start.cast("bigint").alias("start"), F.lit(order).alias("order"), stop.cast("bigint").alias("stop"), F.lit(kind).alias("kind"))
            fits = test(F.element_at(all_["values"] if group else all_["matches"], k))
            return F.struct(stop.cast("bigint").alias("state"), F.when(fits, F.array(span)).otherwise(_none()).alias("out"))

        count = F.size(all_["matches"])
        return F.when(count > 0, _bound(F.sequence(F.lit(1), count), lambda items: _folded(items, F.lit(0), step))).otherwise(_none())

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches")
    values = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values")] if group else []
    return _bound(F.struct(whole, F.split(text, pattern, -1).alias("gaps"), *values), spans_of)


def _added(taken: Column, more: Column, order: int) -> Column:
    """taken and those spans of `more` (of the given order, above that of all taken) that overlap none of them.

    Along the starts, a span must begin behind all taken before it; backwards, it must end before the next taken.
    """

    def forward(reach: Column, s: Column) -> Column:
        own = s["order"] == order
        return F.struct(F.when(own, reach).otherwise(F.greatest(reach, s["stop"])).alias("state"), F.when(own & (s["start"] >= reach), F.array(s)).otherwise(_none()).alias("out"))

    def backward(nearest: Column, s: Column) -> Column:
        own = s["order"] == order
        return F.struct(F.when(own, nearest).otherwise(s["start"]).alias("state"), F.when(own & (s["stop"] <= nearest), F.array(s)).otherwise(_none()).alias("out"))

    def free(spans: Column) -> Column:
        clear = _bound(F.array_sort(F.concat(taken, spans)), lambda items: _folded(items, F.lit(0), forward))
        return _bound(F.reverse(F.array_sort(F.concat(taken, clear))), lambda items: _folded(items, F.lit((1 << 63) - 1), backward))

    return F.when(F.size(more) == 0, taken).when(F.size(taken) == 0, more).otherwise(F.concat(taken, free(more)))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one fixed pattern."""
    order = [k for k, *_ in BASE].index(kind)
    _, pattern, group, least = BASE[order]
    if group:
        return F.when(text.rlike(pattern), _located(text, pattern, kind, order, lambda value: F.length(value) >= least, group)).otherwise(_none())
    # a run is taken whole, so that the length can be part of the pattern
    sized = pattern.removesuffix("+") + "{%d,}" % (least - len(pattern.split("[")[0]))
    return F.when(text.rlike(sized), _located(text, sized, kind, order, lambda m: F.lit(True))).otherwise(_none())


def _least_weight(text: Column, alphabet: str, window: int) -> Column:
    """The least sum of c * log2(c) over the counts c of any window of the text, in 2**-SCALE; null if there is no window.

    Counts are kept as fields of a few numbers, so that one code point in and one out touch little.
    """
    bits = window.bit_length()
    each = 62 // bits
    weights = F.array(*[F.lit(round(c * math.log2(c) * 2**SCALE) if c else 0) for c in range(window + 1)])
    place = lambda w, s, v: F.struct(F.lit(w).alias("w"), F.lit(s).alias("s"), F.lit(v).cast("bigint").alias("v"))
    places = F.array(*[place(k // each, k % each * bits, 1 << (k % each * bits)) for k in range(len(alphabet))])
    none = place(-1, 0, 0)

    def count(n: Column, at: Column) -> Column:
        return F.call_function("shiftright", F.element_at(n, at["w"] + 1), at["s"]).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def change(c: Column, by: int) -> Column:
        return F.element_at(weights, c + (1 + by)) - F.element_at(weights, c + 1)

    def step(acc: Column, p: Column) -> Column:
        into, out = p["i"], p["o"]
        full = out["w"] >= 0
        had = count(acc["n"], into) - F.when((into["w"] == out["w"]) & (into["s"] == out["s"]), 1).otherwise(0)
        total = acc["total"] + change(had, 1) + F.when(full, change(count(acc["n"], out), -1)).otherwise(F.lit(0).cast("bigint"))
        n = F.transform(acc["n"], lambda c, k: c + F.when(k == into["w"], into["v"]).otherwise(F.lit(0).cast("bigint")) - F.when(k == out["w"], out["v"]).otherwise(F.lit(0).cast("bigint")))
        return F.struct(n.alias("n"), total.alias("total"), (acc["k"] + 1).alias("k"), F.when(acc["k"] + 1 >= window, F.least(acc["low"], total)).otherwise(acc["low"]).alias("low"))

    def fold(at: Column) -> Column:
        out = F.slice(F.concat(F.array_repeat(none, window), at), F.lit(1), F.size(at))
        zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), -(-len(alphabet) // each)).alias("n"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("low"))
        return F.aggregate(F.arrays_zip(at.alias("i"), out.alias("o")), zero, step)["low"]

    letters = F.slice(F.split(text, ""), F.lit(1), F.length(text))
    return _bound(F.transform(letters, lambda c: F.element_at(places, F.instr(F.lit(alphabet), c))), fold)


def peak_entropy(text: Column, alphabet: str, window: int) -> Column:
    """The largest Shannon entropy, in bits, of any window of the text, from counts updated by one code point in and one out."""
    parts = F.sequence(F.lit(0), F.greatest(F.length(text) - window, F.lit(0)), F.lit(PART))
    low = F.array_min(F.transform(parts, lambda k: _least_weight(F.substring(text, k + 1, F.lit(PART + window - 1)), alphabet, window)))
    return F.lit(math.log2(window)) - low / F.lit(float(window * 2**SCALE))


def entropy_spans(text: Column, cls: CharClass, order: int, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of the candidates of a class with a window of high entropy that no allow pattern suppresses."""
    pattern = f"[{cls.chars}]{{{cls.window},}}"

    def secret(match: Column) -> Column:
        fits = F.lit(True)
        for x in cls.needs:
            fits = fits & match.rlike(x)
        for x in allow:
            fits = fits & ~match.rlike(x)
        return F.when(fits, peak_entropy(match, cls.alphabet, cls.window) >= cls.least).otherwise(F.lit(False))

    return F.when(text.rlike(pattern), _located(text, pattern, cls.name, order, secret)).otherwise(_none())


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Documents with base (spans of the fixed patterns) and found (all spans), ordered by start, then kind.

    A span is (start, order, stop, kind) in code points, stop exclusive. An entropy span that overlaps a fixed one
    or one of an earlier class is left out. Null text counts as empty: no spans. Rows pass one to one, whatever
    doc_id holds, repeated ones with equal spans; kept columns named base or found are replaced. Spans that begin
    together are ordered by kind. Texts of any length are scanned whole, in time that follows their candidates and
    matches. An empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base", "found")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = [k for k, *_ in BASE]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *[base_spans(text, k).alias(f"_s{i}") for i, k in enumerate(kinds)], *[entropy_spans(text, c, len(kinds) + i, allow).alias(f"_e{i}") for i, c in enumerate(classes)])
    base = F.array_sort(F.concat(*[F.col(f"_s{i}") for i in range(len(kinds))]))
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], base.alias("base"), *[F.col(f"_e{i}") for i in range(len(classes))])
    found = F.col("base")
    for i in range(len(classes)):
        more, order = F.col(f"_e{i}"), len(kinds) + i
        found = _bound(found, lambda taken: _added(taken, more, order))  # noqa: B023
    return rows.select(*[F.col(f"`{c}`") for c in keep], "base", F.array_sort(found).alias("found"))


def _shown(spans: str) -> Column:
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; see scan_secrets()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, ["doc_id"])
    counts = [_count(k).alias(f"n_{k}") for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(_shown("base"), 256).alias("base_sha256"), _shown("found").alias("spans"))


def _sql_spans(pattern: str, kind: str, order: int, test: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, a.start AS s, {order} AS o, a.start + length(a.m) AS e, '{kind}' AS kind FROM (
      SELECT r, unnest(list_transform(range(1, len(ms) + 1), lambda k: {{'start': CAST(list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS BIGINT), 'm': ms[k], 'v': vs[k]}})) AS a
      FROM (SELECT r, regexp_extract_all(t, '{quoted}') AS ms, string_split_regex(t, '{quoted}') AS gs, regexp_extract_all(t, '{quoted}', {2 if order == 0 else 0}) AS vs FROM d)) WHERE {test}"""


def _op6_sql() -> str:
    base = [_sql_spans(p, k, i, f"length(a.v) >= {least}") for i, (k, p, _, least) in enumerate(BASE)]
    entropy = []
    for i, c in enumerate(CLASSES):
        tests = [f"regexp_matches(a.m, '{x}')" for x in c.needs] + [f"NOT regexp_matches(a.m, '{x}')" for x in (*ALLOW[:-1], "^/?([a-z]+[_/-])+[a-z0-9]*$")]
        peak = f"list_max(list_transform(range(1, length(a.m) - {c.window - 2}), lambda i: list_entropy(string_split(substr(a.m, i, {c.window}), '')))) >= {c.least}"
        entropy.append(f"SELECT * FROM ({_sql_spans(f'[{c.chars}]{{{c.window},}}', c.name, len(BASE) + i, ' AND '.join(tests + [peak]))})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS ({' UNION ALL '.join(base)}),
e0 AS ({entropy[0]}), k0 AS (SELECT * FROM e0 ANTI JOIN b ON e0.r = b.r AND b.s < e0.e AND e0.s < b.e), u0 AS (SELECT * FROM b UNION ALL SELECT * FROM k0),
e1 AS ({entropy[1]}), k1 AS (SELECT * FROM e1 ANTI JOIN u0 ON e1.r = u0.r AND u0.s < e1.e AND e1.s < u0.e), u1 AS (SELECT * FROM u0 UNION ALL SELECT * FROM k1),
x AS (SELECT r, count_if(kind = 'assign') AS a, count_if(kind = 'access') AS c, count_if(kind = 'hex') AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS txt FROM b GROUP BY r),
y AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS txt FROM u1 GROUP BY r)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(x.txt, '')) AS base_sha256, coalesce(y.txt, '') AS spans
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)
"""


OP6_SQL = _op6_sql()
