import os

import pytest
from pyspark.sql import functions as F

from paperloom.operators.jobs import ParseLimits
from paperloom.sinks import atomic
from paperloom.sources import ingest


def test_large_files_are_refused_unread(spark, tmp_path):
    files = {"a.txt": b"text", "big.txt": b"x" * 5000, "empty.csv": b"", "odd.xyz": b"?", "fake.png": b"text", "b.csv": b"a,b\n", "c.csv": b"1"}
    (tmp_path / "sub").mkdir()
    for name, content in files.items():
        (tmp_path / ("sub" if name == "b.csv" else ".") / name).write_bytes(content)
    limits = ParseLimits(archive_bytes=1000)
    # Spark itself refuses to read a file over this, so the large one isn't read
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        found = {r["name"]: r["error_code"] for r in ingest.listed(spark, f"file://{tmp_path}", limits=limits).collect()}
        assert found == {"a.txt": None, "big.txt": "FILE_TOO_LARGE", "odd.xyz": "UNSUPPORTED_FORMAT", "fake.png": None, "b.csv": None, "c.csv": None}
        said = spark.createDataFrame([("a.txt", 4), ("fake.png", 4), ("b.csv", 9), ("b.csv", 4), ("c.csv", 2), ("none.txt", 1), ("empty.csv", 0)], "name string, declared_size long")
        got = {r["name"]: (r["error_code"], r["content"] and bytes(r["content"])) for r in ingest.ingested(spark, f"file://{tmp_path}", declared=said, limits=limits).collect()}
        assert got == {"a.txt": (None, b"text"), "big.txt": ("FILE_TOO_LARGE", None), "empty.csv": ("EMPTY_FILE", None), "none.txt": ("EMPTY_FILE", None), "odd.xyz": ("UNSUPPORTED_FORMAT", None), "fake.png": ("CONTENT_MISMATCH", None), "b.csv": (None, b"a,b\n"), "c.csv": ("SIZE_MISMATCH", None)}
        only = ingest.ingested(spark, f"file://{tmp_path}", "*.csv", limits=limits)
        assert {r["name"] for r in only.collect()} == {"b.csv", "c.csv"}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_files_appear_together(spark, tmp_path):
    rows = spark.range(40).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(F.col("id") != 3, F.col("id").cast("string").cast("binary")).alias("content")).repartition(6)
    out = f"{tmp_path}/out"
    atomic.write_files(rows, out)
    assert os.listdir(tmp_path) == ["out"]
    found = {n: open(f"{d}/{n}", "rb").read() for d, _, names in os.walk(out) for n in names}
    assert found == {f"{i}.txt": b"" if i == 3 else str(i).encode() for i in range(40)}
    with pytest.raises(Exception, match="there already"):
        atomic.write_files(rows, out)


@pytest.mark.parametrize("bad", ["a/b", "..", "0.txt"])
def test_a_failing_task_leaves_nothing_behind(spark, tmp_path, bad):
    rows = spark.range(20).select(F.when(F.col("id") < 19, F.concat("id", F.lit(".txt"))).otherwise(bad).alias("name"), F.lit(b"x").alias("content"))
    rows = rows.repartition(4) if bad != "0.txt" else rows.coalesce(1)
    with pytest.raises(Exception, match="file name|are called"):
        atomic.write_files(rows, f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_stored_rounds_are_compressed_columns(spark):
    import os
    from urllib.parse import urlparse

    from pyspark.sql import functions as F

    from paperloom.operators.scratch import kept

    rows = spark.range(200_000).select("id", F.lit(20.0).alias("width"), F.lit("word").alias("text"))
    stored = kept(rows)
    files = stored.inputFiles()
    assert stored.count() == 200_000 and stored.dtypes == rows.dtypes and files
    assert sum(os.path.getsize(urlparse(f).path) for f in files) < 3_000_000 and kept(rows.limit(0)).count() == 0
