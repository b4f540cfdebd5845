"""Vector paths and glyph advances of fixed-layout pages, from their compact texts, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations and segments of a path, pieces of a quadratic and a cubic curve, shortest piece (mm).
MOST, QUADRATIC, CUBIC, SHORTEST = 100_000, 8, 12, 0.001
#: A filled box is a line if it is so thin (mm) and so many times as long.
THIN, LONG = 3.0, 4.0


def advances(text: Column, gaps: Column) -> Column:
    """The `gaps` advances that a text of numbers and repeats `g count value` says; null if it is no such text.

    The last number fills what is missing, numbers beyond the gaps are left out. A repeat below 0, and more than
    max(1024, 4 * gaps) advances, count as no such text. Null or blank text and no gaps give an empty array.
    """
    # a repeat has two words after its g; any other word is a number by itself
    word = r"(?:^|(?<=\s))(?:[gG]\s+(\S+)\s+(\S+)|(\S+))"
    part = lambda k: F.regexp_extract_all(text, F.lit(word), F.lit(k))
    runs = F.transform(F.arrays_zip(part(1).alias("n"), part(2).alias("v"), part(3).alias("w")), lambda r: F.struct(
        F.when(r["w"] != "", 1).otherwise(r["n"].try_cast("int")).alias("n"), F.when(r["w"] != "", r["w"]).otherwise(r["v"]).try_cast("double").alias("v")))
    bad = F.exists(runs, lambda r: r["n"].isNull() | r["v"].isNull() | (r["n"] < 0))
    total = F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["n"])
    some = F.slice(F.flatten(F.transform(runs, lambda r: F.array_repeat(r["v"], F.least(r["n"], gaps)))), 1, gaps)
    full = F.transform(F.array(some), lambda a: F.when(F.size(a) == 0, a).otherwise(F.concat(a, F.array_repeat(F.element_at(a, -1), gaps - F.size(a)))))[0]
    none = F.array().cast("array<double>")
    blank = text.isNull() | (F.trim(text) == "") | (gaps <= 0)
    return F.when(blank, none).when(bad | (total > F.greatest(F.lit(1024), gaps * 4)), F.lit(None).cast("array<double>")).otherwise(full)


#: Values that an operation needs at least, and where its end point is in them.
NEEDS = {"S": 2, "M": 2, "L": 2, "Q": 4, "B": 6, "A": 7, "C": 0}


def _once(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def operations(data: Column) -> Column:
    """The first MOST operations of a path's text: op, v (its numbers)."""
    number = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    form = rf"([A-Za-z]+)((?:[\s,]*{number})*)"
    part = lambda k: F.regexp_extract_all(data, F.lit(form), F.lit(k))
    numbers = lambda v: F.transform(F.regexp_extract_all(v, F.lit(number), F.lit(0)), lambda x: x.try_cast("double"))
    return F.transform(F.slice(F.arrays_zip(part(1).alias("op"), part(2).alias("v")), 1, MOST), lambda o: F.struct(o["op"].alias("op"), numbers(o["v"]).alias("v")))


def drawn_operations(ops: Column) -> Column:
    """The operations that move the pen, in order, with the pen before them and what they draw: op, v, goal, pen, steps.

    The pen is where the last operation ended: after S and M at their point, after L, Q, B and A at their last point,
    after C at the last S or M. Nothing is drawn before the first S or M; operations with too few numbers, and
    unknown ones, neither draw nor move. steps: straight pieces that the operation makes, 0 for none; goal: its end.

    A path stays one row: what is left is parted where S and M stand, and each looks one place back.
    """

    def whole(o: Column) -> Column:
        needs = F.coalesce(*[F.when(o["op"] == k, n) for k, n in NEEDS.items()])
        return F.coalesce((F.size(o["v"]) >= needs) & ~F.exists(o["v"], lambda x: x.isNull()), F.lit(False))

    def placed(good: Column) -> Column:
        heads = F.filter(F.transform(good, lambda o, i: F.when(o["op"].isin("S", "M"), i)), lambda i: i.isNotNull())
        part = lambda h, k, at: F.slice(good, h + 1, F.coalesce(F.get(at, k + 1), F.size(good)) - h)
        return _once(heads, lambda at: F.flatten(F.transform(at, lambda h, k: F.transform(part(h, k, at), lambda o: with_goal(o, F.get(good, h))))))

    def with_goal(o: Column, start: Column) -> Column:
        point = lambda v, i: F.struct(F.get(v, F.lit(i)).alias("x"), F.get(v, F.lit(i + 1)).alias("y"))
        op, v = o["op"], o["v"]
        goal = F.when(op == "C", point(start["v"], 0)).when(op == "Q", point(v, 2)).when(op == "B", point(v, 4)).when(op == "A", point(v, 5)).otherwise(point(v, 0))
        return F.struct(op.alias("op"), v.alias("v"), goal.alias("goal"))

    def with_pen(o: Column, pen: Column) -> Column:
        pieces = F.when(pen.isNull() | o["op"].isin("S", "M"), 0).when(o["op"] == "Q", QUADRATIC).when(o["op"] == "B", CUBIC).otherwise(1)
        return F.struct(o["op"].alias("op"), o["v"].alias("v"), o["goal"].alias("goal"), pen.alias("pen"), pieces.alias("steps"))

    moved = _once(F.filter(ops, whole), placed)
    return _once(moved, lambda m: F.transform(m, lambda o, i: with_pen(o, F.get(m, i - 1)["goal"])))


def _mapped(m: Column, x: Column, y: Column, left: Column, top: Column) -> Column:
    ready = F.size(m) == 6
    at = lambda i: F.get(m, F.lit(i))
    along = F.when(ready, at(0) * x + at(2) * y + at(4)).otherwise(x)
    down = F.when(ready, at(1) * x + at(3) * y + at(5)).otherwise(y)
    return F.struct((left + along).alias("x"), (top + down).alias("y"))


def path_lines(paths: DataFrame, key: list[str]) -> DataFrame:
    """key, segment, x1, y1, x2, y2 of the straight pieces of paths (key, data, x, y, ctm: six numbers or null).

    Curves are drawn in even steps of their parameter, arcs as their chord. Pieces are numbered in order and end with
    the limit of MOST; those up to SHORTEST long have a number but no row. Null data draws nothing, nor does a path with a
    null in its key. A path is one row until its pieces are: nothing is shuffled.
    """

    def point(o: Column, k: Column, axis: str) -> Column:
        t = k / o["steps"]
        i = 1.0 - t
        v = lambda n: F.get(o["v"], F.lit(n + (axis == "y")))
        a, b = o["pen"][axis], o["goal"][axis]
        return (
            F.when(o["op"] == "Q", i * i * a + 2.0 * i * t * v(0) + t * t * b)
            .when(o["op"] == "B", i * i * i * a + 3.0 * i * i * t * v(0) + 3.0 * i * t * t * v(2) + t * t * t * b)
            .when(k == 0, a).otherwise(b)
        )

    piece = lambda o, k: F.struct(*[point(o, k - d, axis).alias(f"{axis}{n}") for n, d in ((1, 1), (2, 0)) for axis in "xy"])
    drawn = F.filter(drawn_operations(operations(F.col("data"))), lambda o: o["steps"] > 0)
    pieces = F.slice(F.flatten(F.transform(drawn, lambda o: F.transform(F.sequence(F.lit(1), o["steps"]), lambda k: piece(o, k)))), 1, MOST)
    known = paths.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key))
    # as an outer generator, so that no filter moves below it and reads every path again
    rows = known.select(*key, "x", "y", "ctm", F.posexplode_outer(pieces).alias("segment", "_p")).where("segment IS NOT NULL")
    drawn = rows.select(*key, "segment", *[_mapped(F.col("ctm"), F.col(f"_p.x{n}"), F.col(f"_p.y{n}"), F.col("x"), F.col("y")).alias(p) for p, n in (("_a", 1), ("_b", 2))])
    long = F.hypot(F.col("_a.x") - F.col("_b.x"), F.col("_a.y") - F.col("_b.y")) > SHORTEST
    return drawn.where(long).select(*key, "segment", F.col("_a.x").alias("x1"), F.col("_a.y").alias("y1"), F.col("_b.x").alias("x2"), F.col("_b.y").alias("y2"))


def path_warnings(paths: DataFrame, key: list[str]) -> DataFrame:
    """key, code, n of what paths (key, data) hold beyond lines and curves: ARC_AS_CHORD, CM, UNKNOWN, OPERATIONS_CUT, SEGMENTS_CUT.

    A path's operations are counted within its row: nothing is shuffled.
    """
    many = F.size(F.regexp_extract_all("data", F.lit("[A-Za-z]+"), F.lit(0)))
    entry = lambda code, n: F.struct(F.lit(code).alias("code"), n.cast("bigint").alias("n"))
    count = lambda ops, test: F.size(F.filter(ops, test))

    def found(ops: Column) -> Column:
        def of_drawn(drawn: Column) -> Column:
            steps = F.aggregate(drawn, F.lit(0).cast("bigint"), lambda n, o: n + o["steps"])
            return F.array(
                entry("ARC_AS_CHORD", count(drawn, lambda o: (o["op"] == "A") & (o["steps"] > 0))),
                entry("CM", count(ops, lambda o: o["op"] == "CM")),
                entry("UNKNOWN", count(ops, lambda o: ~o["op"].isin(*NEEDS, "CM"))),
                entry("SEGMENTS_CUT", F.when(steps >= MOST, steps)),
                entry("OPERATIONS_CUT", F.when(many > MOST, many)),
            )

        return F.filter(_once(drawn_operations(ops), of_drawn), lambda e: e["n"] > 0)

    rows = paths.select(*key, F.explode_outer(_once(operations(F.col("data")), found)).alias("_e"))
    return rows.where("_e IS NOT NULL").select(*key, "_e.code", "_e.n")


def box_line(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The middle line (x1, y1, x2, y2, thickness) of a filled box that is thin and long, else null."""
    flat, upright = (width >= height * LONG) & (height <= THIN), (height >= width * LONG) & (width <= THIN)
    line = lambda a, b, c, d, n: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"), n.alias("thickness"))
    return F.when(flat, line(x, y + height / 2, x + width, y + height / 2, height)).when(upright, line(x + width / 2, y, x + width / 2, y + height, width))
