"""Intermediate tables of operators that work in rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Drops an execution's shuffle files at its end: once its rows are stored, nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and stored in the checkpoint folder: lineage is cut, lost executors cost a retry.

    They are stored as compressed columns, and readers take only the columns that they need.

    The folder is spark.checkpoint.dir; where that is unset, a temp folder in local mode only.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        context.setCheckpointDir(base)
    spark, path = df.sparkSession, f"{context._jsc.sc().getCheckpointDir().get().rstrip('/')}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
