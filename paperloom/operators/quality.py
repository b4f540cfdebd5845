"""Quality metrics: character conservation, pixel differences, text and export comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_space


def char_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ch, n: how often each character that is no white space occurs in a text.

    Counted inside each row first, so a row per distinct character of a text is shuffled, not one per character.
    """
    chars = F.split(without_space(F.coalesce(F.col(text), F.lit(""))), "")
    return docs.select(key, F.explode(chars).alias("ch")).where("ch <> ''").groupBy(key, "ch").agg(F.count(F.lit(1)).alias("n"))


def same_characters(left: Column, right: Column) -> Column:
    """Whether two texts have the same characters equally often, white space aside.

    Characters are sorted only where the texts differ and are equally long.
    """
    bare = lambda t: without_space(F.coalesce(t, F.lit("")))
    order = lambda t: F.sort_array(F.split(t, ""))
    same = lambda p: F.when(p["l"] == p["r"], True).when(F.length(p["l"]) != F.length(p["r"]), False).otherwise(order(p["l"]) == order(p["r"]))
    return F.transform(F.array(F.struct(bare(left).alias("l"), bare(right).alias("r"))), same)[0]


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: missing and extra rows of right, repeats counted, and equal."""
    cols = left.columns
    a, b = left.select(*cols), right.select(*cols)
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("missing")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("extra"))).withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def same_text(left: Column, right: Column) -> Column:
    return without_space(left) == without_space(right)


def over_white(value: Column, alpha: Column) -> Column:
    """A colour value of 0..255 with its alpha on white."""
    return value * alpha / 255 + (255 - alpha)


def pixel_difference(pairs: DataFrame, keys: list[str], left: list[str], right: list[str]) -> DataFrame:
    """keys, diff_ratio (share of pixels that differ in any band), mean_error (mean absolute difference of the values)."""
    differs = F.lit(False)
    total = F.lit(0.0)
    for a, b in zip(left, right):
        differs = differs | (F.col(a) != F.col(b))
        total = total + F.abs(F.col(a) - F.col(b))
    return pairs.groupBy(*keys).agg(F.avg(differs.cast("double")).alias("diff_ratio"), (F.sum(total) / (F.count(F.lit(1)) * len(left))).alias("mean_error"))


def size_matches(width_pt: Column, height_pt: Column, width_px: Column, height_px: Column, dpi: Column, tolerance: float = 0.05) -> Column:
    return (F.abs(width_pt - width_px * 72 / dpi) <= tolerance) & (F.abs(height_pt - height_px * 72 / dpi) <= tolerance)


def page_breaks_match(text: Column, pages: Column) -> Column:
    """Whether a text has a form feed fewer than the document has pages."""
    return F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit(""))) == pages - 1


def summary(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("visual").alias("visual"))


def raster_gate(pages: DataFrame, keys: list[str], slack: int = 1, most: float = 8.0) -> DataFrame:
    """keys, pages_match, sizes_match, no_blank, mean_error, passed of rendered pages beside the expected ones.

    pages: width, height, expected_width, expected_height (null where one of the two is missing), blank, error_sum and
    values (absolute differences of colour values, and how many).
    """
    near = lambda a: F.coalesce(F.abs(F.col(a) - F.col(f"expected_{a}")) <= slack, F.lit(False))
    out = pages.groupBy(*keys).agg(F.bool_and(F.col("width").isNotNull() & F.col("expected_width").isNotNull()).alias("pages_match"), F.bool_and(near("width") & near("height")).alias("sizes_match"), F.bool_and(~F.coalesce(F.col("blank"), F.lit(False))).alias("no_blank"), (F.sum("error_sum") / F.greatest(F.sum("values"), F.lit(1))).alias("mean_error"))
    return out.withColumn("passed", F.col("pages_match") & F.col("sizes_match") & F.col("no_blank") & (F.col("mean_error") <= most))
