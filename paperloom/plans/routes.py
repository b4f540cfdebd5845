"""The catalogue of conversion routes, as a small table, and lookups in it.

A route runs here, is unavailable for want of an engine (stated), or is only planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source, target, quality, strategy, what it lacks here (empty: it runs).
REGISTERED = (
    ("csv", "xlsx", "stable", "data", ""),
    ("xlsx", "csv", "stable", "data", ""),
    ("docx", "txt", "beta", "extraction", ""),
    ("txt", "docx", "stable", "content", ""),
    ("txt", "pdf", "stable", "content", "glyph metrics"),
    ("ofd", "txt", "beta", "extraction", ""),
    ("ofd", "xlsx", "experimental", "data", ""),
    ("ofd", "docx", "beta", "editable", ""),
    ("ofd", "pdf", "beta", "fidelity", "page renderer"),
    ("ofd", "png", "beta", "fidelity", "page renderer"),
    ("ofd", "jpg", "beta", "fidelity", "page renderer"),
    ("pdf", "txt", "beta", "extraction", "PDF parser"),
    ("pdf", "docx", "beta", "editable", "PDF parser"),
    ("pdf", "ofd", "experimental", "fidelity", "PDF parser"),
    ("pdf", "png", "stable", "fidelity", "page renderer"),
    ("pdf", "jpg", "stable", "fidelity", "page renderer"),
    ("pdf", "pdf-merge", "stable", "content", "PDF parser"),
    ("pdf", "pdf-split", "stable", "content", "PDF parser"),
    ("pdf", "pdf-watermark", "beta", "content", "PDF parser"),
    ("pdf", "pdf-compress", "beta", "content", "PDF parser"),
    ("png", "pdf", "stable", "fidelity", ""),
    ("jpg", "pdf", "stable", "fidelity", ""),
    ("png", "txt", "experimental", "extraction", "OCR engine"),
    ("jpg", "txt", "experimental", "extraction", "OCR engine"),
    ("png", "docx", "experimental", "editable", "OCR engine"),
    ("jpg", "docx", "experimental", "editable", "OCR engine"),
    ("docx", "pdf", "beta", "fidelity", "office engine"),
    ("xlsx", "pdf", "beta", "fidelity", "office engine"),
    ("pptx", "pdf", "beta", "fidelity", "office engine"),
    ("wps", "docx", "experimental", "compatibility", "office engine"),
    ("et", "xlsx", "experimental", "compatibility", "office engine"),
    ("dps", "pptx", "experimental", "compatibility", "office engine"),
    ("uof", "docx", "experimental", "compatibility", "office engine"),
    ("docx", "uof", "experimental", "compatibility", "office engine"),
)
#: Routes that were announced, in order.
PLANNED = (
    ("docx", "pdf"), ("pdf", "docx"), ("pptx", "pdf"), ("pdf", "png"), ("png", "pdf"), ("jpg", "pdf"), ("png", "txt"), ("jpg", "txt"),
    ("png", "docx"), ("jpg", "docx"), ("ofd", "pdf"), ("pdf", "ofd"), ("ofd", "xlsx"), ("xlsx", "pdf"), ("wps", "docx"), ("docx", "wps"),
    ("et", "xlsx"), ("xlsx", "et"), ("dps", "pptx"), ("pptx", "dps"), ("uof", "docx"), ("docx", "uof"),
)
SCHEMA = "ordinal int, source string, target string, quality string, strategy string, lacks string"


def registered(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(REGISTERED)]
    out = spark.createDataFrame(rows, SCHEMA)
    return out.select(F.concat("source", F.lit("-to-"), "target").alias("id"), "*", F.when(F.col("lacks") == "", "available").otherwise("unavailable").alias("status"))


def planned(spark: SparkSession) -> DataFrame:
    rows = [(1000 + i, s, t, "planned", "planned", "") for i, (s, t) in enumerate(PLANNED)]
    return spark.createDataFrame(rows, SCHEMA).select(F.concat("source", F.lit("-to-"), "target").alias("id"), "*", F.lit("planned").alias("status"))


def planned_only(spark: SparkSession) -> DataFrame:
    """Planned routes that are not registered."""
    return planned(spark).join(registered(spark), ["source", "target"], "left_anti")


def catalogue(spark: SparkSession) -> DataFrame:
    """Registered routes, then those that are only planned."""
    return registered(spark).unionByName(planned_only(spark))


def duplicates(routes: DataFrame) -> DataFrame:
    """Routes that are there more than once, which is an error."""
    return routes.groupBy("source", "target").count().where("count > 1")


def lookup(asked: DataFrame, routes: DataFrame) -> DataFrame:
    """asked (source, target) with its route. The catalogue is a fixed list of some fifty rows, hence broadcast."""
    return asked.join(F.broadcast(routes), ["source", "target"])


def capabilities(spark: SparkSession) -> DataFrame:
    return catalogue(spark).orderBy("ordinal")


def _values(rows, status) -> str:
    return ", ".join(f"('{s}-to-{t}', '{s}', '{t}', '{status(k)}')" for s, t, *k in rows)


_NAMES = {(s, t) for s, t, *_ in REGISTERED}
_ONLY = [p for p in PLANNED if p not in _NAMES]
CATALOGUE_SQL = f"SELECT * FROM (VALUES {_values(REGISTERED, lambda k: 'unavailable' if k[-1] else 'available')}, {_values(_ONLY, lambda k: 'planned')}) AS r(id, source, target, status)"
PLANNED_SQL = f"SELECT id FROM (VALUES {_values(_ONLY, lambda k: 'planned')}) AS r(id, source, target, status)"
