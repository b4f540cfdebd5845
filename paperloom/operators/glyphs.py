"""Page-description text: page boxes, and glyphs gathered to runs. Needs a parser's glyph rows; none is installed here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import MM_PER_INCH, PT_PER_INCH, normal_degrees, pt_to_mm


@dataclass(frozen=True)
class Mode:
    """What a reading of pages is for."""

    needs_text: bool
    word_page_limit: bool
    allows_missing_text: bool


#: Fixed values.
MODES = {
    "EDITABLE_WORD": Mode(True, True, False),
    "EDITABLE_OCR": Mode(False, True, True),
    "TEXT_EXTRACTION": Mode(True, False, False),
    "FIXED_LAYOUT": Mode(False, False, True),
}
WORD_MM = 558.8


def page_error(mode: str, encrypted: Column, chars: Column, visible: Column) -> Column:
    m = MODES[mode]
    return F.when(encrypted, "PDF_PASSWORD_REQUIRED").when(F.lit(m.needs_text) & (chars == 0) & visible, "OCR_REQUIRED")


def page_size(width_pt: Column, height_pt: Column, user_unit: Column, rotation: Column, mode: str = "TEXT_EXTRACTION") -> Column:
    """struct(width, height) in millimetres: turned by quarter turns, and scaled down to what a word page can hold if the mode asks."""
    w, h = pt_to_mm(width_pt * user_unit), pt_to_mm(height_pt * user_unit)
    turned = normal_degrees(rotation).isin(90.0, 270.0)
    a, b = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    fit = F.least(F.lit(1.0), F.lit(WORD_MM) / F.greatest(a, b)) if MODES[mode].word_page_limit else F.lit(1.0)
    return F.struct((a * fit).alias("width"), (b * fit).alias("height"))


def _numbered(glyphs: DataFrame) -> DataFrame:
    """Glyphs with run_no: a new run where family, size (0.1 pt), weight, slant, direction (0.1 degree) or colour differ from the glyph before."""
    order = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    before = lambda c: F.lag(c).over(order)
    same = F.lit(True)
    for c in ("family", "bold", "italic", "color"):
        same = same & F.col(c).eqNullSafe(before(c))
    for c in ("size_pt", "direction"):
        same = same & (F.abs(F.col(c) - before(c)) < 0.1)
    marked = glyphs.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("run_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


RUN = ["doc_id", "page_no", "run_no"]


def _run_text() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ch"))), lambda g: g["ch"]), "").alias("text")


def glyph_runs(glyphs: DataFrame) -> DataFrame:
    """doc_id, page_no, run_no, text and box of runs of upright glyphs; turned ones: displayed_runs.

    glyphs: doc_id, page_no, seq, ch, x, y, width, height, family, size_pt, bold, italic, direction, color.
    """
    box = [F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height")]
    style = [F.min_by(c, "seq").alias(c) for c in ("family", "size_pt", "bold", "italic", "direction", "color")]
    return _numbered(glyphs).groupBy(*RUN).agg(_run_text(), *box, *style)


#: The least width and height of a glyph and a run (points), and the size of a font that has none.
THIN, NO_SIZE = 0.01, 10.5


def displayed_runs(glyphs: DataFrame, pages: DataFrame, per_inch: float = MM_PER_INCH) -> DataFrame:
    """Runs of glyphs in any direction as they stand on the displayed page, boxes and baseline in millimetres.

    per_inch: of the unit of boxes and baseline; one that is to be rounded is asked for here, for scaling twice rounds halves at random.

    glyphs: as glyph_runs, x and y in points on the turned page, width along the glyph's own direction and height across
    it; pages: doc_id, page_no, rotation, user_unit (null or not positive: 1). A run's direction and style are its last
    glyph's. Its box lies along that direction: the glyphs' extremes along and across it, about the same centre, so
    width and height are those of the text and not of its shadow on the page; degrees says how the box is turned.
    Glyphs without a character are left out.
    """
    known = pages.select("doc_id", "page_no", F.coalesce("rotation", F.lit(0)).alias("_turn"), F.when(F.col("user_unit") > 0, F.col("user_unit")).otherwise(1.0).alias("_unit"))
    rows = _numbered(glyphs.where("ch <> ''").withColumn("size_pt", F.when(F.col("size_pt") > 0, F.col("size_pt")).otherwise(NO_SIZE))).join(known, ["doc_id", "page_no"])
    last = F.last("direction").over(Window.partitionBy(*RUN).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_degrees", normal_degrees(F.col("_turn") - last + 360.0))
    angle, unit = F.radians("_degrees"), F.col("_unit")
    rows = rows.withColumn("_cos", F.cos(angle)).withColumn("_sin", F.sin(angle))
    along, cross = F.col("x") * F.col("_cos") + F.col("y") * F.col("_sin"), F.col("x") * F.col("_sin") - F.col("y") * F.col("_cos")
    size = lambda c: F.greatest(F.lit(THIN) / unit, F.col(c))
    ends = [F.min(unit * along).alias("_a"), F.max(unit * (along + size("width"))).alias("_b"), F.min(unit * cross).alias("_c"), F.max(unit * (cross + size("height"))).alias("_d")]
    scaled = lambda pt: pt * F.lit(per_inch / PT_PER_INCH)
    style = [F.max_by(c, "seq").alias(c) for c in ("family", "bold", "italic", "color")]
    facts = [F.max("_degrees").alias("degrees"), F.max("_cos").alias("_cos"), F.max("_sin").alias("_sin"), scaled(F.avg(unit * F.col("y"))).alias("baseline"), F.max_by(F.col("size_pt") * F.col("_unit"), "seq").alias("size_pt")]
    runs = rows.groupBy(*RUN).agg(_run_text(), *ends, *facts, *style)
    width, height = F.greatest(F.lit(THIN), F.col("_b") - F.col("_a")), F.greatest(F.lit(THIN), F.col("_d") - F.col("_c"))
    mid_a, mid_c = (F.col("_a") + F.col("_b")) / 2, (F.col("_c") + F.col("_d")) / 2
    x, y = F.col("_cos") * mid_a + F.col("_sin") * mid_c - width / 2, F.col("_sin") * mid_a - F.col("_cos") * mid_c - height / 2
    box = [scaled(v).alias(n) for v, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))]
    return runs.select(*RUN, "text", *box, "baseline", "degrees", "family", "size_pt", "bold", "italic", "color")


def usable_segments(segments: DataFrame, least: float = 0.5) -> DataFrame:
    """Straight stroked segments that are long enough to rule anything."""
    return segments.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= least)


def usable_images(images: DataFrame, least: float = 0.1) -> DataFrame:
    return images.where((F.col("width") > least) & (F.col("height") > least))
