"""Geometry of boxes, lines, transforms and colours, in millimetres with y downwards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MM_PER_INCH, PT_PER_INCH, TWIPS_PER_INCH = 25.4, 72.0, 1440.0


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards positive infinity."""
    return F.floor(x + 0.5)


def checked_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A box, or an error unless all parts are finite and the sizes not negative."""
    parts = (x, y, width, height)
    bad = F.lit(False)
    for p in parts:
        bad = bad | p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    box = F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))
    return F.when(bad | (width < 0) | (height < 0), F.raise_error(F.lit("invalid box")).cast("struct<x:double,y:double,width:double,height:double>")).otherwise(box)


def right(x: Column, width: Column) -> Column:
    return x + width


def bottom(y: Column, height: Column) -> Column:
    return y + height


def centre(start: Column, size: Column) -> Column:
    return start + size / 2


def contains(x: Column, y: Column, width: Column, height: Column, px: Column, py: Column, tolerance: float | Column = 0.0) -> Column:
    """Whether a point is in a box widened by tolerance, edges included."""
    return px.between(x - tolerance, x + width + tolerance) & py.between(y - tolerance, y + height + tolerance)


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length of the common part of two intervals, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def intersection_area(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    return overlap(ax, ax + aw, bx, bx + bw) * overlap(ay, ay + ah, by, by + bh)


def bounds(x: Column, y: Column, width: Column, height: Column) -> list[Column]:
    """Aggregates that give the box around all boxes of a group."""
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + width) - F.min(x)).alias("width"), (F.max(y + height) - F.min(y)).alias("height")]


def transform_point(m: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through an affine matrix a..f."""
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def transform_vector(m: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A vector through an affine matrix: no translation."""
    return m["a"] * x + m["c"] * y, m["b"] * x + m["d"] * y


def scale_x(m: dict[str, Column]) -> Column:
    return F.hypot(m["a"], m["b"])


def scale_y(m: dict[str, Column]) -> Column:
    return F.hypot(m["c"], m["d"])


def rotation(m: dict[str, Column]) -> Column:
    """Degrees of rotation of the x axis."""
    return F.degrees(F.atan2(m["b"], m["a"]))


def skewed(m: dict[str, Column], tolerance: float = 1e-3) -> Column:
    """Whether the axes are not at right angles: the cosine between them exceeds the tolerance."""
    size = scale_x(m) * scale_y(m)
    return F.when(size > 0, F.abs(m["a"] * m["c"] + m["b"] * m["d"]) / size > tolerance).otherwise(False)


def normal_degrees(angle: Column) -> Column:
    """Wrapped to [0, 360)."""
    return F.pmod(angle, F.lit(360.0))


def rotation_matrix(degrees: Column) -> Column:
    """cos, sin, -sin, cos; the identity next to 0 and 360 degrees."""
    d = normal_degrees(degrees)
    near = (d < 1e-3) | (d > 360 - 1e-3)
    c, s = F.cos(F.radians(d)), F.sin(F.radians(d))
    return F.struct(F.when(near, 1.0).otherwise(c).alias("a"), F.when(near, 0.0).otherwise(s).alias("b"), F.when(near, 0.0).otherwise(-s).alias("c"), F.when(near, 1.0).otherwise(c).alias("d"))


def orientation(x1: Column, y1: Column, x2: Column, y2: Column, tolerance: float = 0.25) -> Column:
    """H, V or null of a segment; horizontal wins."""
    return F.when(F.abs(y1 - y2) <= tolerance, "H").when(F.abs(x1 - x2) <= tolerance, "V")


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("%02X%02X%02X", r, g, b)


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_col(low)), as_col(high))


def mm_to_pt(mm: Column) -> Column:
    return mm * PT_PER_INCH / MM_PER_INCH


def pt_to_mm(pt: Column) -> Column:
    return pt * MM_PER_INCH / PT_PER_INCH


def mm_to_twips(mm: Column) -> Column:
    return round_half_up(mm * TWIPS_PER_INCH / MM_PER_INCH)


def line_tolerance(height_a: Column, height_b: Column) -> Column:
    """How far the baselines of two blocks of one line may differ: 0.3 of the lower height (1 at least), in 0.6..1.5."""
    return clamp(F.greatest(F.lit(1.0), F.least(height_a, height_b)) * 0.3, 0.6, 1.5)


def cell_alignment(left_gap: Column, right_gap: Column) -> Column:
    """Of text in a table cell, from the space on either side."""
    return F.when(F.abs(left_gap - right_gap) <= 1.5, "CENTER").when(right_gap + 0.5 < left_gap, "RIGHT").otherwise("LEFT")


def page_alignment(left_gap: Column, right_gap: Column, page_width: Column) -> Column:
    """Of a line on its page, from the space on either side."""
    return F.when(F.abs(left_gap - right_gap) <= F.greatest(F.lit(2.0), page_width * 0.012), "CENTER").when((right_gap < 3) & (left_gap > right_gap * 2), "RIGHT").otherwise("LEFT")


def displayed_width(text: Column, box_width: Column, size_pt: Column, advances: Column) -> Column:
    """Of a block as drawn: by its advances if it has any, else at most one em for each code point."""
    em = F.greatest(F.lit(1.0), pt_to_mm(size_pt))
    moved = F.aggregate(advances, F.lit(0.0), lambda s, x: s + F.abs(x)) + em
    plain = F.least(box_width, F.greatest(F.lit(1), F.length(text)) * em)
    return F.greatest(F.lit(1.0), F.when(F.size(advances) > 0, moved).otherwise(plain))


def bezier(points: list[Column], t: Column) -> Column:
    """A coordinate of a quadratic (3 points) or cubic (4) curve at t."""
    u = 1 - t
    if len(points) == 3:
        return u * u * points[0] + 2 * u * t * points[1] + t * t * points[2]
    return u * u * u * points[0] + 3 * u * u * t * points[1] + 3 * u * t * t * points[2] + t * t * t * points[3]


def flattened(points: list[Column], steps: int) -> Column:
    """Coordinates at steps + 1 even places of a curve."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: bezier(points, k / float(steps)))
