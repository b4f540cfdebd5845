"""Pictures as pixel tables: orientation undone, and sizes reduced by area means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ocr import MAX_EDGE, downscaled, oriented


def turned(pixels: DataFrame, images: DataFrame, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(pixels, images) upright: pixels (key, x, y, values), images (key, width, height, orientation: EXIF 1 to 8, others as 1).

    Pixels outside their picture, and those of no picture, are left out.
    """
    sizes = images.select(key, F.col("width").cast("int").alias("_w"), F.col("height").cast("int").alias("_h"), F.coalesce("orientation", F.lit(1)).alias("_o"))
    inside = pixels.join(sizes, key).where("x >= 0 AND y >= 0 AND x < _w AND y < _h")
    at = oriented(F.col("x"), F.col("y"), F.col("_w"), F.col("_h"), F.col("_o"))
    rest = [c for c in pixels.columns if c not in (key, "x", "y")]
    out = inside.withColumn("_at", at).select(key, F.col("_at.x").alias("x"), F.col("_at.y").alias("y"), *rest)
    swaps = F.col("_o").between(5, 8)
    return out, sizes.select(key, F.when(swaps, F.col("_h")).otherwise(F.col("_w")).alias("width"), F.when(swaps, F.col("_w")).otherwise(F.col("_h")).alias("height"))


def reduced(pixels: DataFrame, images: DataFrame, most: int = MAX_EDGE, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(pixels, images) whose longest edge is `most` at most; each value is the mean over the area that a new pixel covers.

    A pixel lies on two columns and two rows of the smaller picture at most; what it gives to each is a whole number (its
    overlap, in parts of both grids), so that the means are exact and the order of rows doesn't matter. Halves round up.
    Missing pixels don't count. Pictures that are small enough stay as they are.
    """
    sizes = images.select(key, F.col("width").cast("bigint").alias("_w"), F.col("height").cast("bigint").alias("_h"), downscaled(F.col("width"), F.col("height"), most).alias("_to"))
    sizes = sizes.select(key, "_w", "_h", F.col("_to.width").cast("bigint").alias("_tw"), F.col("_to.height").cast("bigint").alias("_th"))
    values = [c for c in pixels.columns if c not in (key, "x", "y")]
    rows = pixels.join(sizes, key)
    for axis, old, new in (("x", "_w", "_tw"), ("y", "_h", "_th")):
        first, last = F.floor(F.col(axis) * F.col(new) / F.col(old)), F.floor(((F.col(axis) + 1) * F.col(new) - 1) / F.col(old))
        rows = rows.withColumn(f"_to_{axis}", F.explode(F.sequence(first, last)))
        ends = F.least((F.col(axis) + 1) * F.col(new), (F.col(f"_to_{axis}") + 1) * F.col(old))
        rows = rows.withColumn(f"_part_{axis}", ends - F.greatest(F.col(axis) * F.col(new), F.col(f"_to_{axis}") * F.col(old)))
    part = F.col("_part_x") * F.col("_part_y")
    means = [F.floor((2 * F.sum(part * F.col(v)) + F.sum(part)) / (2 * F.sum(part))).cast("int").alias(v) for v in values]
    out = rows.groupBy(key, F.col("_to_x").cast("int").alias("x"), F.col("_to_y").cast("int").alias("y")).agg(*means)
    return out, sizes.select(key, F.col("_tw").cast("int").alias("width"), F.col("_th").cast("int").alias("height"))
