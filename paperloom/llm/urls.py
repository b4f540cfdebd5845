"""Operator 8: URL filters. Fixed rules first; association rules mined from the URLs they label judge the rest."""

from __future__ import annotations

import math
from itertools import product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, written

#: (rule, verdict): a rule is a host and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SUPPORT, CONFIDENCE = 0.01, 0.8
#: Rules up to so many are broadcast; more are matched by a join.
MOST_RULES = 100_000
Rule = tuple[frozenset[str], str, float, float]


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the end of the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """All distinct tokens: top-level domain, host labels from the right, path segments, query names.

    Digits in a token become 0, so that numbered pages share tokens.
    """
    labels = F.filter(F.split(host_, "\\."), lambda x: x != "")
    segments = F.filter(F.split(path_, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), lambda x: x != "")
    back = F.reverse(labels)
    parts = F.concat(
        F.transform(F.slice(back, 1, 1), lambda x: F.concat(F.lit("tld="), x)),
        F.transform(F.slice(back, 2, F.greatest(F.size(back) - 1, F.lit(0))), lambda x: F.concat(F.lit("host="), x)),
        F.transform(segments, lambda x: F.concat(F.lit("path="), x)),
        F.transform(names, lambda x: F.concat(F.lit("query="), x)),
    )
    return F.array_distinct(F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "0")))


def frequent(labelled: DataFrame, least: int) -> dict[str, tuple[str, dict[str, int]]]:
    """token: (group, rows by verdict) of the tokens with at least `least` rows of one verdict.

    Tokens that stand in the same rows form a group, named after its first token. A row's hash is of all its tokens.
    """
    row = F.xxhash64("tokens")
    each = labelled.select("verdict", row.bitwiseAND(F.lit((1 << 32) - 1)).alias("low"), F.shiftrightunsigned(row, 32).alias("high"), F.explode(F.array_distinct("tokens")).alias("token"))
    counted = each.groupBy("token", "verdict").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    found = counted.groupBy("token").agg(F.max("n").alias("most"), F.sort_array(F.collect_list(F.struct("verdict", "n", "low", "high"))).alias("rows")).where(F.col("most") >= least)
    names: dict[tuple, str] = {}
    # bounded by support: at most 1 / support times the mean number of tokens of a URL
    return {r["token"]: (names.setdefault(tuple(map(tuple, r["rows"])), r["token"]), {x["verdict"]: x["n"] for x in r["rows"]}) for r in sorted(found.collect())}


def associate(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[dict[str, str], list[Rule], DataFrame | None]:
    """(group of each frequent token, rules on single groups of one verdict, the other rules) from columns tokens and verdict.

    A rule holds for a URL with a token at least of each of its groups. Only groups with rows of several verdicts are
    mined together: more tokens can't make a rule on a group of one verdict surer, nor two tokens of a group than one.
    """
    n = labelled.count()
    if not n:
        return {}, [], None
    found = frequent(labelled, max(1, math.ceil(support * n)))
    groups = {t: g for t, (g, _) in found.items()}
    rows = {g: found[g][1] for g in groups.values()}
    pure = [(frozenset([g]), v, 1.0, k / n) for g, by in rows.items() if len(by) == 1 for v, k in by.items()]
    mixed = sorted(g for g, by in rows.items() if len(by) > 1)
    if not mixed:
        return groups, pure, None
    items = labelled.select(F.concat(F.array_distinct(F.filter("tokens", lambda t: t.isin(mixed))), F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("=")).where(~F.exists("antecedent", lambda x: x.startswith("=")))
    return groups, pure, rules.select(F.sort_array("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 1 << 30).alias("verdict"), "confidence", "support")


def minimal(rules: list[Rule]) -> list[Rule]:
    """Without the rules for which one on fewer of their tokens for the same verdict is at least as sure."""
    kept: list[Rule] = []
    lists: dict[tuple[str, str], list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: (len(r[0]), sorted(r[0]), r[1])):
        antecedent, verdict, conf, _ = rule
        if any(r[0] < antecedent and r[2] >= conf for t in antecedent for r in lists.get((t, verdict), ())):
            continue
        lists.setdefault((min(antecedent), verdict), []).append(rule)
        kept.append(rule)
    return kept


def gathered(rules: DataFrame) -> list[Rule]:
    return [(frozenset(r["antecedent"]), r["verdict"], float(r["confidence"]), float(r["support"])) for r in rules.collect()]


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[Rule]:
    """(tokens, verdict, confidence, support) of the rules token set -> verdict, from columns tokens and verdict.

    A rule is dropped if a rule on fewer of its tokens for the same verdict is at least as sure.
    """
    groups, pure, rules = associate(labelled, support, confidence)
    members: dict[str, list[str]] = {}
    for t, g in groups.items():
        members.setdefault(g, []).append(t)
    kept = minimal(pure + (gathered(rules) if rules is not None else []))
    out = [(frozenset(names), *rest) for antecedent, *rest in kept for names in product(*(members[g] for g in antecedent))]
    return sorted(out, key=lambda r: (len(r[0]), sorted(r[0]), r[1]))


class RuleIndex:
    """Inverted index: each rule is listed under its least common token and checked in full when that occurs.

    groups: the group that stands for a token in the rules; without it every token stands for itself.
    """

    def __init__(self, rules: list[Rule], default: str = "allow", groups: dict[str, str] | None = None):
        uses: dict[str, int] = {}
        for antecedent, *_ in rules:
            for t in antecedent:
                uses[t] = uses.get(t, 0) + 1
        self.default = default
        self.groups = {t: t for t in uses} if groups is None else groups
        self.lists: dict[str, list[tuple[tuple, frozenset[str], str]]] = {}
        for antecedent, verdict, conf, supp in rules:
            key = min(antecedent, key=lambda t: (uses[t], t))
            self.lists.setdefault(key, []).append(((conf, supp, len(antecedent), sorted(antecedent), verdict), antecedent, verdict))
        self.known: dict[frozenset[str], tuple[str, float | None]] = {}

    def judge(self, found: list[str]) -> tuple[str, float | None]:
        """The verdict of the surest rule that matches (ties: more support, more tokens), and its confidence."""
        have = frozenset(self.groups[t] for t in found if t in self.groups)
        if have in self.known:
            return self.known[have]
        best = max((x for t in have for x in self.lists.get(t, ()) if x[1] <= have), default=None, key=lambda x: x[0])
        out = (best[2], best[0][0]) if best else (self.default, None)
        if len(self.known) < 100_000:
            self.known[have] = out
        return out


def judged_by_join(base: DataFrame, keep: list[str], groups: dict[str, str], pure: list[Rule], rules: DataFrame, default: str) -> DataFrame:
    """base with verdict and confidence as RuleIndex.judge() gives them, for rules too many to broadcast."""
    spark = base.sparkSession
    one = spark.createDataFrame([(sorted(a), v, c, s) for a, v, c, s in pure], "antecedent array<string>, verdict string, confidence double, support double")
    every = written(rules.unionByName(one))
    # a rule in the same rows as one on a token less is not needed; other lesser rules lose by confidence or support
    less = every.select(F.explode("antecedent").alias("_t"), F.col("antecedent").alias("_a"), "verdict", "confidence", "support").where(F.size("_a") > 1)
    less = less.select("_a", F.array_remove("_a", F.col("_t")).alias("antecedent"), "verdict", "confidence", "support")
    same = less.join(every, ["antecedent", "verdict", "confidence", "support"], "left_semi").select(F.col("_a").alias("antecedent"), "verdict").distinct()
    rank = F.struct("confidence", "support", F.size("antecedent").alias("size"), "antecedent", "verdict")
    needed = every.join(same, ["antecedent", "verdict"], "left_anti").select(F.explode("antecedent").alias("_t"), "antecedent", rank.alias("_rank"))
    uses = needed.groupBy("_t").count()
    needed = needed.join(F.broadcast(uses), "_t").groupBy("_rank").agg(F.min(F.struct("count", "_t"))["_t"].alias("_t"))
    shared = spark.sparkContext.broadcast(groups)

    def make(_text: pa.Array, found: pa.Array) -> list[pa.Array]:
        return [pa.array([sorted({shared.value[t] for t in x if t in shared.value}) for x in found.to_pylist()], pa.list_(pa.string()))]

    rows = written(append_columns(base, [*keep, "host", "path", "rule", "tokens", "_label"], ["path", "tokens"], "_have array<string>", make))
    sets = rows.where("_label IS NULL").select("_have").distinct()
    hits = sets.select("_have", F.explode("_have").alias("_t")).join(needed, "_t").where(F.size(F.array_except("_rank.antecedent", "_have")) == 0)
    best = hits.groupBy("_have").agg(F.max("_rank").alias("_best"))
    out = rows.withColumn("_have", F.when(F.col("_label").isNull(), F.col("_have"))).join(best, "_have", "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", "tokens", F.coalesce("_label", "_best.verdict", F.lit(default)).alias("verdict"), F.col("_best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """Pages with host, path, rule, verdict, tokens and confidence (of the mined rule; null if none matched).

    The fixed rules label URLs; frequent token combinations of the labelled URLs give rules with at least the
    support and confidence, and these judge URLs that no fixed rule fits; `default` is the verdict if none matches.
    Null url or one without ://: empty host and path, no tokens, the default. Without labelled URLs all unlabelled
    ones get the default. Repeated rows pass one to one; kept columns named as the new ones are replaced. URLs of any
    length are taken whole, with all their tokens. An empty table gives an empty result.
    """
    made = ("host", "path", "rule", "verdict", "tokens", "confidence")
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in made]
    url = F.col("url").cast("string")
    base = pages.select(*[F.col(f"`{c}`") for c in keep], url.alias("_url"), host(url).alias("host"), path(url).alias("path"))
    base = base.withColumn("_fixed", fixed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("_url"), F.col("host"), F.col("path")))
    base = base.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col("_fixed.rule").alias("rule"), F.col("_fixed.verdict").alias("_label"), "tokens")
    groups, pure, rules = associate(base.where("_label IS NOT NULL").select("tokens", F.col("_label").alias("verdict")), support, confidence)
    more = gathered(rules.limit(MOST_RULES + 1)) if rules is not None else []
    if len(more) > MOST_RULES:
        return judged_by_join(base, keep, groups, pure, rules, default)
    shared = pages.sparkSession.sparkContext.broadcast((minimal(pure + more), groups))
    held: list[RuleIndex] = []

    def make(_text: pa.Array, label: pa.Array, found: pa.Array) -> list[pa.Array]:
        if not held:
            held.append(RuleIndex(shared.value[0], default, shared.value[1]))
        judged = [(v, None) if v is not None else held[0].judge(t) for v, t in zip(label.to_pylist(), found.to_pylist())]
        return [pa.array([v for v, _ in judged], pa.string()), pa.array([c for _, c in judged], pa.float64())]

    return append_columns(base, [*keep, "host", "path", "rule", "tokens"], ["path", "_label", "tokens"], "verdict string, confidence double", make)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of every page; see filter_urls()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict", "confidence")
