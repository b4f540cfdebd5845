"""Text files: encoding, refusal of binary content, pages and lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import binary_content, newlines
from ..operators.grouped import small_batches

#: By byte-order mark (hex): length of the mark, codec.
MARKS = (("EFBBBF", 3, "utf-8"), ("FFFE", 2, "utf-16le"), ("FEFF", 2, "utf-16be"))
#: By codec: whole units of UTF-16 as bytes, none of them half of a pair. The JVM decodes these as they are.
UNPAIRED = {"utf-16le": r"(?s)^(?:.[^\u00D8-\u00DF])*+\z", "utf-16be": r"(?s)^(?:[^\u00D8-\u00DF].)*+\z"}


@F.pandas_udf(StringType())
def _gb18030(content: pd.Series) -> pd.Series:
    def one(raw):
        try:
            return None if raw is None else bytes(raw).decode("gb18030")
        except UnicodeDecodeError:
            return None

    return content.map(one)


@F.pandas_udf(StringType())
def _marked(content: pd.Series, codec: pd.Series) -> pd.Series:
    def one(raw, name):
        try:
            return None if raw is None or name is None else bytes(raw).decode(name)
        except UnicodeDecodeError:
            return None

    return pd.Series([one(r, c) for r, c in zip(content, codec)], dtype=object)


def decoded(files: DataFrame, max_bytes: int = 50 << 20, max_pages: int = 500) -> DataFrame:
    """files with text, charset, warning and error_code from its binary column `content`.

    A mark decides the encoding; without one it is UTF-8 if that is valid, else GB18030 with a warning. A file that
    can't be used keeps its row: TEXT_TOO_LARGE, TEXT_ENCODING_UNSUPPORTED, TEXT_BINARY_CONTENT or PAGE_LIMIT_EXCEEDED
    in error_code, and no text. Line ends become LF. Only files without a mark and not in UTF-8, and such in UTF-16 as
    have pairs of units or are damaged, go through Python, in bounded batches.
    """
    content = F.col("content")
    size = F.length(content)
    head, skip, codec = F.hex(F.substring(content, 1, 3)), F.lit(0), F.lit(None).cast("string")
    for mark, n, name in reversed(MARKS):
        skip = F.when(head.startswith(mark), n).otherwise(skip)
        codec = F.when(head.startswith(mark), name).otherwise(codec)
    fits = size <= max_bytes
    step = files.withColumn("_codec", codec).withColumn("_body", F.when(fits, F.expr("content")))
    step = step.withColumn("_body", F.substring(F.col("_body"), skip + 1, size))
    utf8 = F.expr("is_valid_utf8(CAST(_body AS STRING))")
    step = step.withColumn("_plain", F.when((F.col("_codec").isNull() | (F.col("_codec") == "utf-8")) & utf8, F.col("_body").cast("string")))
    units = F.decode("_body", "ISO-8859-1")
    simple, ours = F.lit(False), F.lit(None).cast("string")
    for name, pattern in UNPAIRED.items():
        simple = F.when(F.col("_codec") == name, units.rlike(pattern)).otherwise(simple)
        ours = F.when(F.col("_codec") == name, F.decode("_body", name.upper())).otherwise(ours)
    step = step.withColumn("_simple", F.coalesce(simple, F.lit(False)))
    step = step.withColumn("_ours", F.when(F.col("_simple"), ours))
    wide = _marked(F.when(F.col("_codec").startswith("utf-16") & ~F.col("_simple"), F.col("_body")), F.col("_codec"))
    other = _gb18030(F.when(F.col("_codec").isNull() & ~utf8, F.col("_body")))
    small_batches(files.sparkSession)
    step = step.withColumn("_wide", wide).withColumn("_other", other)
    raw = F.coalesce("_plain", "_ours", "_wide", "_other")
    guessed = F.col("_plain").isNull() & F.col("_codec").isNull() & F.col("_other").isNotNull()
    pages = F.size(F.split(raw, "\f", -1))
    error = (
        F.when(~fits, "TEXT_TOO_LARGE")
        .when(content.isNotNull() & raw.isNull(), "TEXT_ENCODING_UNSUPPORTED")
        .when(binary_content(raw), "TEXT_BINARY_CONTENT")
        .when(pages > max_pages, "PAGE_LIMIT_EXCEEDED")
    )
    step = step.withColumn("error_code", error)
    ok = F.col("error_code").isNull()
    return step.withColumn("text", F.when(ok, newlines(raw))).withColumn("charset", F.when(ok, F.when(guessed, "GB18030").otherwise(F.upper(F.coalesce("_codec", F.lit("utf-8")))))).withColumn("warning", F.when(ok & guessed, "TEXT_ENCODING_GUESSED")).drop("_codec", "_body", "_plain", "_simple", "_ours", "_wide", "_other")


def pages(text: Column) -> Column:
    """Form feeds part pages; trailing empty ones stay."""
    return F.split(text, "\f", -1)


def lines(text: Column) -> Column:
    """Line feeds part lines; trailing empty ones stay."""
    return F.split(text, "\n", -1)


def page_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, page_no, line_no (from 1) and line of every explicit page and line."""
    paged = docs.select(key, F.posexplode(pages(newlines(F.col(text)))).alias("p", "page"))
    return paged.select(key, (F.col("p") + 1).alias("page_no"), F.posexplode(lines(F.col("page"))).alias("l", "line")).select(key, "page_no", (F.col("l") + 1).alias("line_no"), "line")
