"""Conversion jobs as tables: quotas, progress, outcome, expiry, recovery, archive names.

tasks: task_id, status, stage, progress, error_code, error_message, updated_at, expires_at ...
task_files: task_id, idx, file_name, size, success, output_name, page_count, error_code, error_message
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1 << 20
TERMINAL = ("SUCCESS", "FAILED", "CANCELLED")
STATUSES = ("WAITING", "CONVERTING", *TERMINAL)
STAGES = ("QUEUED", "VALIDATING", "PARSING", "RECOGNIZING", "RENDERING", "PACKAGING", "COMPLETED", "FAILED", "CANCELLED")


@dataclass(frozen=True)
class TaskLimits:
    files: int = 100
    upload_bytes: int = 250 * MIB
    output_bytes: int = 512 * MIB
    free_bytes: int = 512 * MIB


@dataclass(frozen=True)
class ParseLimits:
    """Of one input; see guards in this module."""

    archive_bytes: int = 50 * MIB
    expanded_bytes: int = 200 * MIB
    entry_bytes: int = 40 * MIB
    entries: int = 10_000
    ratio: float = 100.0
    pages: int = 500

    def __post_init__(self):
        if min(self.archive_bytes, self.expanded_bytes, self.entry_bytes, self.entries, self.pages) <= 0 or self.entry_bytes > self.expanded_bytes or self.ratio < 1:
            raise ValueError("limits must be positive, an entry not over the total, the ratio at least 1")

    @property
    def pixels(self) -> int:
        return min(80_000_000, self.expanded_bytes // 4)

    @property
    def cells(self) -> int:
        return max(self.entries, min(250_000, self.expanded_bytes // 64))


def terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def progress(index: Column, total: Column, within: Column) -> Column:
    """Of a task: its file `index` (from 0) of `total` is `within` per cent done; 94 at most before it ends."""
    return F.least(F.lit(94), F.floor((index * 90 + within) / F.greatest(F.lit(1), total)).cast("int"))


def upload_error(name: Column, size: Column, mime: Column, fmt: Column, limits: ParseLimits = ParseLimits()) -> Column:
    """Why an upload is refused by its metadata, or null."""
    from ..sources.formats import accepts_mime, of_name

    return F.when(name.isNull() | size.isNull() | (size <= 0), "EMPTY_FILE").when(size > limits.archive_bytes, "FILE_TOO_LARGE").when(~of_name(name).eqNullSafe(fmt), "EXTENSION_MISMATCH").when(~accepts_mime(fmt, mime), "MIME_MISMATCH")


def quotas(files: DataFrame, limits: TaskLimits = TaskLimits()) -> DataFrame:
    """task_id, files, bytes, accepted: within the file count and upload size."""
    sums = files.groupBy("task_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return sums.withColumn("accepted", (F.col("files") <= limits.files) & (F.col("bytes") <= limits.upload_bytes))


def running_bytes(files: DataFrame, most: int) -> DataFrame:
    """files with total_bytes so far in their task and over: whether the quota is passed there.

    Totals are wide, so that none wraps: one over a long's range is null, and over. A null size counts as none.
    """
    wide = F.coalesce(F.col("size"), F.lit(0)).cast("decimal(20,0)")
    so_far = F.sum(wide).over(Window.partitionBy("task_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = files.withColumn("_total", so_far)
    return rows.withColumn("total_bytes", F.col("_total").try_cast("bigint")).withColumn("over", F.col("_total") > most).drop("_total")


def one_route(files: DataFrame) -> DataFrame:
    """task_id, source (the one format of all files, or null), error_code by the rules for single and merging tools."""
    by = files.groupBy("task_id", "target").agg(F.count_distinct("format").alias("k"), F.max("format").alias("source"), F.count(F.lit(1)).alias("n"))
    single = F.col("target").isin("pdf-split", "pdf-watermark", "pdf-compress")
    error = F.when(F.col("k") != 1, "MIXED_FORMATS").when(single & (F.col("n") != 1), "SINGLE_FILE_ONLY").when((F.col("target") == "pdf-merge") & (F.col("n") < 2), "MERGE_NEEDS_TWO")
    return by.select("task_id", F.when(F.col("k") == 1, F.col("source")).alias("source"), error.alias("error_code"))


def outcomes(files: DataFrame) -> DataFrame:
    """task_id, status, package (file, pdf or zip; null if failed), error_code (of the first failure if all failed)."""
    by = files.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("success").alias("ok"),
        F.min_by("error_code", F.when(~F.col("success"), F.col("idx"))).alias("first_error"),
        F.max("target").alias("target"),
    )
    package = F.when(F.col("ok") == 0, F.lit(None).cast("string")).when(F.col("target") == "pdf-merge", "pdf").when((F.col("files") == 1), "file").otherwise("zip")
    return by.select("task_id", "files", "ok", F.when(F.col("ok") == 0, "FAILED").otherwise("SUCCESS").alias("status"), package.alias("package"), F.when(F.col("ok") == 0, F.col("first_error")).alias("error_code"))


def expiry(tasks: DataFrame, ttl: str = "INTERVAL 24 HOURS") -> DataFrame:
    """tasks with expires_at: updated_at plus the time to live once ended, else null."""
    return tasks.withColumn("expires_at", F.when(terminal(F.col("status")), F.col("updated_at") + F.expr(ttl)))


def expired(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where(terminal(F.col("status")) & (F.col("expires_at") < now))


def recovered(tasks: DataFrame) -> DataFrame:
    """After a restart: tasks that had not ended have failed."""
    lost = ~terminal(F.col("status"))
    return tasks.withColumn("error_code", F.when(lost, "SERVICE_RESTARTED").otherwise(F.col("error_code"))).withColumn("status", F.when(lost, "FAILED").otherwise(F.col("status")))


def retryable(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Ended without success and with inputs still there."""
    return tasks.where(F.col("status").isin("FAILED", "CANCELLED")).join(files.select("task_id").distinct(), "task_id", "left_semi")


def cancelled(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """The named tasks, unless ended, are cancelled."""
    hit = tasks.join(ids.select("task_id").distinct().withColumn("_hit", F.lit(True)), "task_id", "left")
    return hit.withColumn("status", F.when(F.col("_hit") & ~terminal(F.col("status")), "CANCELLED").otherwise(F.col("status"))).drop("_hit")


def failure_code(kind: Column, code: Column) -> Column:
    """The stable code of a failure: its own, CONVERSION_TIMEOUT, or CONVERSION_FAILED."""
    return F.when(kind.isin("parse", "conversion"), code).when(kind == "timeout", "CONVERSION_TIMEOUT").otherwise("CONVERSION_FAILED")


def ocr_failure_code(timed_out: Column, started: Column, exit_code: Column) -> Column:
    return F.when(timed_out, "OCR_TIMEOUT").when(~started, "OCR_ENGINE_START_FAILED").when(exit_code.isin(137, 9), "OCR_RESOURCE_LIMIT").otherwise("OCR_FAILED")


def worker_code(response: Column, readable: Column, exit_code: Column) -> Column:
    return F.when(exit_code != 0, "WORKER_CRASHED").when(~response, "WORKER_NO_RESPONSE").when(~readable, "WORKER_BAD_RESPONSE")


def artifact_error(regular: Column, size: Column, limits: TaskLimits = TaskLimits()) -> Column:
    return F.when(~regular | size.isNull() | (size <= 0), "OUTPUT_MISSING").when(size > limits.output_bytes, "TASK_OUTPUT_LIMIT_EXCEEDED")


def disk_error(usable: Column, incoming: Column, limits: TaskLimits = TaskLimits()) -> Column:
    return F.when(usable.isNull() | (usable - incoming < limits.free_bytes), "INSUFFICIENT_STORAGE")


def page_error(pages: Column, limits: ParseLimits = ParseLimits()) -> Column:
    return F.when(pages > limits.pages, "PAGE_LIMIT_EXCEEDED")


def pixel_error(width: Column, height: Column, limits: ParseLimits = ParseLimits()) -> Column:
    """Checked before an image is decoded."""
    return F.when((width <= 0) | (height <= 0), "IMAGE_INVALID").when(width.cast("long") * height > limits.pixels, "IMAGE_PIXEL_LIMIT_EXCEEDED")


def sheet_error(rows: Column, cols: Column, longest: Column, cells: Column, limits: ParseLimits = ParseLimits()) -> Column:
    """Of a spreadsheet; `longest` in UTF-16 units."""
    return F.when(rows > limits.entries, "ROW_LIMIT").when(cols > 16_384, "COLUMN_LIMIT").when(longest > 32_767, "CELL_TEXT_LIMIT").when(cells > limits.cells, "CELL_LIMIT")


def utf16_length(text: Column) -> Column:
    """Code units: code points over U+FFFF count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))


def valid_task_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{1,8}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,12}$"), F.lit(False))


def contained(path: Column) -> Column:
    """Whether a relative path stays under its root when its dots are resolved."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("low")))
    return ~path.startswith("/") & (depth["low"] >= 0)


def archive_names(files: DataFrame) -> DataFrame:
    """Successful outputs with entry_name: repeated names get -2, -3 ... before the extension, in order of idx.

    A made name may meet a given one, so the names of a task are settled one after the other, in a fold over its files
    (their number is bounded by TaskLimits).
    """

    def step(acc: Column, f: Column) -> Column:
        stem, ext = F.regexp_replace(f["output_name"], "\\.[^.]*$", ""), F.regexp_extract(f["output_name"], "\\.[^.]*$", 0)
        tries = F.transform(F.sequence(F.lit(1), F.size(acc["used"]) + 1), lambda k: F.when(k == 1, f["output_name"]).otherwise(F.concat(stem, F.lit("-"), k.cast("string"), ext)))
        entry = F.element_at(F.filter(tries, lambda t: ~F.array_contains(acc["used"], t)), 1)
        named = F.struct(f["idx"].alias("idx"), f["output_name"].alias("output_name"), entry.alias("entry_name"))
        return F.struct(F.concat(acc["used"], F.array(entry)).alias("used"), F.concat(acc["out"], F.array(named)).alias("out"))

    kind = files.schema["idx"].dataType.simpleString()
    zero = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<struct<idx:{kind},output_name:string,entry_name:string>>").alias("out"))
    order = files.where("success").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("idx", "output_name"))).alias("_f"))
    return order.select("task_id", F.explode(F.aggregate("_f", zero, step)["out"]).alias("_n")).select("task_id", "_n.*")


def failure_report(files: DataFrame) -> DataFrame:
    """task_id, report: a tab-separated line for every failed file, in order."""
    line = F.concat_ws("\t", "file_name", F.coalesce("error_code", F.lit("")), F.coalesce("error_message", F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda r: r["line"])
    return files.where("NOT success").groupBy("task_id").agg(F.array_join(rows, "\n").alias("report"))


def paired(results: DataFrame, outputs: DataFrame) -> DataFrame:
    """Successful results with the outputs of their task, in order: the first with the first, and so on."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("idx"))
    left = results.where("success").withColumn("_place", place)
    right = outputs.withColumn("_place", place).drop("idx")
    return left.join(right, ["task_id", "_place"]).drop("_place")


def merge_check(inputs: DataFrame, merged: DataFrame) -> DataFrame:
    """task_id, expected, actual, ok: a merged file has as many pages as its inputs together."""
    want = inputs.groupBy("task_id").agg(F.sum("page_count").alias("expected"))
    return want.join(merged.select("task_id", F.col("page_count").alias("actual")), "task_id", "left").withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def page_continuity(pages: DataFrame, source_pages: str) -> DataFrame:
    """doc_id, ok: pages are numbered 1..n without a gap, and n is the source's count."""
    return pages.groupBy("doc_id").agg(((F.min("page_no") == 1) & (F.max("page_no") == F.count(F.lit(1))) & (F.count_distinct("page_no") == F.count(F.lit(1))) & (F.max(source_pages) == F.count(F.lit(1)))).alias("ok"))


def recovered_inputs(stored: DataFrame, results: DataFrame) -> DataFrame:
    """task_id, idx, path, file_name: stored files by name, with the results' names by place, else `input-N`."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("path")) - 1
    named = results.select("task_id", "idx", "file_name")
    return stored.withColumn("idx", place).join(named, ["task_id", "idx"], "left").withColumn("file_name", F.coalesce("file_name", F.concat(F.lit("input-"), (F.col("idx") + 1).cast("string"))))


#: Bytes of a process's output that are kept.
LOG_BYTES = 16 << 10


def captured(output: Column, most: int = LOG_BYTES) -> Column:
    """struct(kept, truncated) of a process's output in bytes."""
    return F.struct(F.substring(output, 1, most).alias("kept"), (F.octet_length(output) > most).alias("truncated"))


def page_file_number(name: Column) -> Column:
    """The number between the first dash and the last dot of a page's file name; null, which goes last, if there is none."""
    digits = F.regexp_extract(name, "^[^-]*-([+-]?[0-9]{1,10})\\.[^.]*$", 1)
    number = F.when(digits != "", digits.cast("long"))
    return F.when(number.between(-(1 << 31), (1 << 31) - 1), number.cast("int"))


def bounded_setting(value: Column, fallback: float, least: float, most: float, kind: str = "int") -> Column:
    """struct(value, error) of a setting: the fallback if it is blank, INVALID_SETTING if it is no number of least..most."""
    given = F.trim(F.coalesce(value, F.lit("")))
    form = "^[+-]?[0-9]{1,18}$" if kind in ("int", "long") else "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    number = F.when(given.rlike(form), given.cast("double" if kind == "double" else "long"))
    fits = F.coalesce(number.between(least, most), F.lit(False))
    return F.struct(F.when(given == "", F.lit(fallback)).when(fits, number).cast(kind).alias("value"), F.when((given != "") & ~fits, "INVALID_SETTING").alias("error"))


def dpi_setting(value: Column) -> Column:
    """Of rendered pages: 160 unless set, 36 to 600."""
    return bounded_setting(value, 160.0, 36.0, 600.0, "double")


def enabled(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(False))


def created(uploads: DataFrame, limits: TaskLimits = TaskLimits()) -> DataFrame:
    """task_id, files, bytes, status, stage, progress, error_code of new tasks from uploads (request_id, idx, size, target).

    A request without a target or with too many files or bytes makes no task that could run. The id follows from the
    request's, so that a lost and repeated piece of work makes the same task.
    """
    by = uploads.groupBy("request_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("target").alias("target"), F.min("size").alias("_least"))
    error = F.when(F.col("target").isNull(), "TARGET_REQUIRED").when(F.col("files") > limits.files, "TASK_FILE_LIMIT_EXCEEDED").when(F.col("_least") <= 0, "EMPTY_FILE").when(F.col("bytes") > limits.upload_bytes, "TASK_UPLOAD_LIMIT_EXCEEDED")
    rows = by.select(task_uuid(F.lit("create"), F.col("request_id").cast("string")).alias("task_id"), "request_id", "files", "bytes", "target", error.alias("error_code"))
    bad = F.col("error_code").isNotNull()
    return rows.withColumn("status", F.when(bad, "FAILED").otherwise("WAITING")).withColumn("stage", F.when(bad, "FAILED").otherwise("QUEUED")).withColumn("progress", F.lit(0))


def task_uuid(*parts: Column) -> Column:
    """An id in the form of a UUID from a hash of the parts."""
    h = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def retried(tasks: DataFrame, files: DataFrame, attempt: int = 1) -> tuple[DataFrame, DataFrame]:
    """(tasks, files) made anew from those that can be tried again, under ids of their own, with retry_of."""
    again = retryable(tasks, files).select(F.col("task_id").alias("retry_of"), task_uuid(F.lit(f"retry {attempt}"), F.col("task_id").cast("string")).alias("task_id"), F.lit("WAITING").alias("status"), F.lit("QUEUED").alias("stage"), F.lit(0).alias("progress"))
    copies = files.withColumnRenamed("task_id", "retry_of").join(again.select("retry_of", "task_id"), "retry_of").drop("retry_of")
    return again, copies


def downloads(tasks: DataFrame, types: Column) -> DataFrame:
    """task_id, download_name, content_type of results that can be fetched; types: map of target to content type."""
    ready = tasks.where("status = 'SUCCESS' AND download_name IS NOT NULL")
    kind = F.when(F.col("download_name").endswith(".zip"), "application/zip").otherwise(F.element_at(types, F.col("target")))
    return ready.select("task_id", "download_name", kind.alias("content_type"))


def deleted(tasks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks that stay, named ids that are no task)."""
    named = ids.select("task_id").distinct()
    return tasks.join(named, "task_id", "left_anti"), named.join(tasks.select("task_id"), "task_id", "left_anti")


def manifest(tasks: DataFrame) -> DataFrame:
    """task_id, json: each task as a JSON object."""
    return tasks.select("task_id", F.to_json(F.struct(*tasks.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_manifests(manifests: DataFrame, schema, now: Column, ttl: str = "INTERVAL 24 HOURS") -> DataFrame:
    """Tasks read from manifests (json) after a restart: unreadable and expired ones are left out, unfinished ones have failed."""
    read = manifests.select(F.from_json("json", schema, {"mode": "PERMISSIVE"}).alias("t")).select("t.*").where("task_id IS NOT NULL AND status IS NOT NULL")
    alive = read.where(F.coalesce(F.col("expires_at") >= now, F.lit(False)))
    lost = ~terminal(F.col("status"))
    return recovered(alive.withColumn("progress", F.when(lost, 100).otherwise(F.col("progress"))).withColumn("expires_at", F.when(lost, now + F.expr(ttl)).otherwise(F.col("expires_at"))))


def write_manifests(tasks: DataFrame, path: str) -> None:
    """A folder for each task with its manifest; Spark commits the files of a task together."""
    manifest(tasks).select("task_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("task_id").text(path)


def read_manifests(spark, path: str) -> DataFrame:
    """json of every manifest below a path, a file each."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("value").alias("json"))
