"""Files of a folder as rows, refused by name, size and leading bytes before or after they are read, whichever is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import ParseLimits
from .formats import content_fits, of_name


def file_name(path: Column) -> Column:
    """The last part of a path or address."""
    return F.substring_index(path, "/", -1)


def _files(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def listed(spark: SparkSession, path: str, pattern: str | None = None, limits: ParseLimits = ParseLimits()) -> DataFrame:
    """path, name, size, modified, format, error_code of every file that isn't empty; from the listing alone, no file is opened.

    error_code: FILE_TOO_LARGE or UNSUPPORTED_FORMAT (of the name), else null. Spark's listing passes over empty files.
    """
    found = _files(spark, path, pattern).select("path", file_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    found = found.withColumn("format", of_name(F.col("name")))
    return found.withColumn("error_code", F.when(F.col("size") > limits.archive_bytes, "FILE_TOO_LARGE").when(F.col("format").isNull(), "UNSUPPORTED_FORMAT"))


def ingested(spark: SparkSession, path: str, pattern: str | None = None, declared: DataFrame | None = None, limits: ParseLimits = ParseLimits()) -> DataFrame:
    """path, name, size, format, content, error_code of every file; refused files have no content.

    A file over the limit is never opened: the bound on its length goes down to the scan. declared (name, declared_size)
    says what senders announced; a file of another size is SIZE_MISMATCH, one that nobody announced too. A file whose
    leading bytes don't fit its format is CONTENT_MISMATCH. Announcements are told apart by name: of several for a name,
    one that fits is enough. An announced file that is empty or not there has a row without a path, EMPTY_FILE.
    """
    facts = listed(spark, path, pattern, limits)
    refused = facts.where("error_code IS NOT NULL").select("path", "name", "size", "format", F.lit(None).cast("binary").alias("content"), "error_code")
    read = _files(spark, path, pattern).where(F.col("length") <= limits.archive_bytes)
    read = read.select("path", file_name(F.col("path")).alias("name"), F.col("length").alias("size"), "content").withColumn("format", of_name(F.col("name"))).where("format IS NOT NULL")
    if declared is None:
        read = read.withColumn("_announced", F.lit(True))
    else:
        sizes = declared.groupBy("name").agg(F.collect_set("declared_size").alias("_sizes"))
        read = read.join(sizes, "name", "left").withColumn("_announced", F.coalesce(F.array_contains("_sizes", F.col("size")), F.lit(False)))
    whole = F.octet_length("content") == F.col("size")
    error = F.when(~F.col("_announced") | ~whole, "SIZE_MISMATCH").when(~content_fits(F.col("format"), F.col("content")), "CONTENT_MISMATCH")
    read = read.withColumn("error_code", error).withColumn("content", F.when(F.col("error_code").isNull(), F.col("content")))
    out = read.select(*refused.columns).unionByName(refused)
    if declared is None:
        return out
    missing = declared.select("name").distinct().join(facts.select("name"), "name", "left_anti")
    return out.unionByName(missing.withColumn("error_code", F.lit("EMPTY_FILE")), allowMissingColumns=True)
