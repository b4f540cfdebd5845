"""OCR engine output: the twelve-column tab-separated word list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

COLUMNS = ("level", "page", "block", "par", "line", "word", "left", "top", "width", "height", "conf", "text")


def ocr_words(files: DataFrame, key: str, text: str = "tsv") -> DataFrame:
    """key, seq and the twelve columns of usable words: level 5, text, confidence in 0..100, a size."""
    rows = files.select(key, F.posexplode(F.split(F.col(text), "\r?\n", -1)).alias("seq", "_row")).where("seq > 0")
    parts = F.split(F.col("_row"), "\t", len(COLUMNS))
    rows = rows.select(key, "seq", parts.alias("_p")).where(F.size("_p") == len(COLUMNS))
    number = lambda i, kind: F.col("_p")[i].try_cast(kind)
    kinds = {"conf": "double", "text": "string"}
    named = [number(i, kinds.get(c, "int")).alias(c) if c != "text" else strip(F.col("_p")[i]).alias(c) for i, c in enumerate(COLUMNS)]
    return usable(rows.select(key, "seq", *named))


def usable(words: DataFrame) -> DataFrame:
    return words.where((F.col("level") == 5) & (F.col("text") != "") & F.col("conf").between(0, 100) & (F.col("width") > 0) & (F.col("height") > 0))


def lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """A row per block, paragraph and line: its words joined by blanks, its box, its number in first-seen order."""
    by = [*keys, "page", "block", "par", "line"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w["text"]), " ")
    return words.groupBy(*by).agg(F.min("seq").alias("first_seq"), text.alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"))


def confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence of the words, 0..1, and their number."""
    return words.groupBy(*keys).agg((F.avg("conf") / 100).alias("confidence"), F.count(F.lit(1)).alias("words"))


def weighted(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence over several images, each weighted by its words."""
    return pages.groupBy(*keys).agg(F.coalesce(F.sum(F.col("confidence") * F.col("words")) / F.nullif(F.sum("words"), F.lit(0)), F.lit(0.0)).alias("confidence"), F.sum("words").alias("words"))


def verdict(confidence_: Column, words: Column, least: float = 0.35, warn: float = 0.75) -> Column:
    """What the confidence of a page means for its use."""
    return F.when(words == 0, "OCR_NO_TEXT").when(confidence_ < least, "OCR_LOW_CONFIDENCE").when(confidence_ < warn, "OCR_APPLIED,OCR_LOW_CONFIDENCE").otherwise("OCR_APPLIED")


def placed(lines_: DataFrame, page: dict[str, Column], image: dict[str, Column]) -> DataFrame:
    """Lines in page millimetres: box, size_pt and baseline, from pixels of an image that fills the page box."""
    sx, sy = page["width"] / image["width"], page["height"] / image["height"]
    height = F.greatest(F.lit(0.5), F.col("height") * sy)
    y = page["y"] + F.col("top") * sy
    return lines_.select(*[c for c in lines_.columns if c not in ("left", "top", "width", "height")], (page["x"] + F.col("left") * sx).alias("x"), y.alias("y"), F.greatest(F.lit(0.5), F.col("width") * sx).alias("width"), height.alias("height"), F.least(F.lit(72.0), F.greatest(F.lit(5.0), height * 72 / 25.4 * 0.85)).alias("size_pt"), (y + height * 0.85).alias("baseline"))
