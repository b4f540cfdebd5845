"""The routes that run here, as lazy plans from files (file_id, content) to results.

Each gives file_id, content (or text) of the files that could be converted; errors() gives the others with their code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grid, layout, rendering
from ..operators.jobs import ParseLimits
from ..sinks import files as sinks
from ..sinks import pdf
from ..sources import containers, csv, decode, fixed_layout

ROUTES: dict[tuple[str, str], Callable[[DataFrame, ParseLimits], DataFrame]] = {}


def route(source: str, target: str):
    def put(f):
        ROUTES[source, target] = f
        return f

    return put


def convert(files: DataFrame, source: str, target: str, limits: ParseLimits = ParseLimits()) -> DataFrame:
    """The plan of a route; KeyError for one that does not run here."""
    if (source, target) not in ROUTES:
        raise KeyError(f"route {source}-to-{target} does not run here")
    return ROUTES[source, target](files, limits)


@route("csv", "xlsx")
def csv_to_xlsx(files: DataFrame, limits: ParseLimits) -> DataFrame:
    texts = decode.decoded(files, limits.archive_bytes, limits.pages).where("error_code IS NULL")
    rows = csv.csv_rows(texts, "file_id", limits=csv.Limits(limits.entries, limits.cells)).where("error_code IS NULL")
    return sinks.xlsx_text(rows, "file_id")


@route("xlsx", "csv")
def xlsx_to_csv(files: DataFrame, limits: ParseLimits) -> DataFrame:
    """One sheet: its CSV. More: a ZIP of one for each."""
    return sinks.sheet_files(containers.xlsx_rows(files, "file_id", limits).where("error_code IS NULL"), "file_id")


@route("docx", "txt")
def docx_to_txt(files: DataFrame, limits: ParseLimits) -> DataFrame:
    return containers.docx_text(containers.docx_stories(files, "file_id", limits), "file_id")


@route("txt", "docx")
def txt_to_docx(files: DataFrame, limits: ParseLimits) -> DataFrame:
    texts = decode.decoded(files, limits.archive_bytes, limits.pages).where("error_code IS NULL")
    return sinks.docx_lines(decode.page_lines(texts, "file_id"), "file_id")


def _layout(files: DataFrame, limits: ParseLimits) -> tuple[DataFrame, DataFrame]:
    """Text blocks and recognised cells of packages."""
    objects = fixed_layout.layout_objects(files.withColumnRenamed("file_id", "doc_id"), "doc_id", limits).where("error_code IS NULL")
    blocks = objects.where("kind = 'text'").select("doc_id", "page_no", "seq", "x", "y", "width", "height", "text", "baseline")
    segments = objects.where("kind = 'line'").select("doc_id", "page_no", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    return blocks, grid.recognised_cells(segments)


def _boxes(cells: DataFrame) -> DataFrame:
    """The outline of each table."""
    return cells.groupBy("doc_id", "page_no", "table_no").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))


def _ordered(blocks: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, text: the text outside tables and the tables' own (doc_id, page_no, table_no, text), in reading order."""
    boxes = _boxes(cells)
    body = layout.segment_units(layout.column_segments(layout.visual_lines(layout.outside(blocks, boxes, 0.25).where("trim(text) <> ''"))))
    units = boxes.join(tables, ["doc_id", "page_no", "table_no"]).select("doc_id", "page_no", (-F.col("table_no")).alias("line_no"), F.lit(0).alias("segment_no"), "x", "y", "width", "height", "text")
    return layout.document_text(layout.page_texts(layout.reading_order(body.unionByName(units))))


@route("ofd", "txt")
def ofd_to_txt(files: DataFrame, limits: ParseLimits) -> DataFrame:
    blocks, cells = _layout(files, limits)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n")
    rows = grid.table_rows(grid.cell_texts(blocks, cells)).groupBy("doc_id", "page_no", "table_no").agg(lines.alias("text"))
    return _ordered(blocks, cells, rows).withColumnRenamed("doc_id", "file_id")


@route("ofd", "xlsx")
def ofd_to_xlsx(files: DataFrame, limits: ParseLimits) -> DataFrame:
    blocks, cells = _layout(files, limits)
    return sinks.xlsx_tables(grid.cell_texts(blocks, grid.exportable(cells), "\n")).withColumnRenamed("doc_id", "file_id")


@route("ofd", "docx")
def ofd_to_docx(files: DataFrame, limits: ParseLimits) -> DataFrame:
    """Pages in reading order: a paragraph for each line, a word table with spans for each recognised one."""
    blocks, cells = _layout(files, limits)
    keys = ["doc_id", "page_no", "table_no"]
    axis = lambda at, size: F.array_sort(F.array_distinct(F.concat(F.collect_set(at), F.collect_set(F.round(F.col(at) + F.col(size), 6)))))
    rounded = cells.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))
    tables = rounded.groupBy(*keys).agg(axis("x", "width").alias("xs"), axis("y", "height").alias("ys"))
    xml = rendering.table_xml(rendering.overlay_grid(cells, tables), grid.cell_texts(blocks, cells))
    texts = _ordered(blocks, cells, xml.select(*keys, F.concat(F.lit(sinks.RAW), "xml").alias("text"))).withColumnRenamed("doc_id", "file_id")
    pages = texts.select("file_id", F.posexplode(F.split("text", "\n\f\n")).alias("p", "page"))
    lines = pages.select("file_id", (F.col("p") + 1).alias("page_no"), F.posexplode(F.split(F.regexp_replace("page", "\n$", ""), "\n")).alias("line_no", "line"))
    return sinks.docx_lines(lines, "file_id")


@route("png", "pdf")
@route("jpg", "pdf")
def image_to_pdf(files: DataFrame, limits: ParseLimits) -> DataFrame:
    return pdf.images_to_pdf(files, "file_id", limits).where("error_code IS NULL").select("file_id", "content")


def errors(files: DataFrame, source: str, limits: ParseLimits = ParseLimits(), target: str | None = None) -> DataFrame:
    """file_id, error_code of the files that could not be read; for ofd to xlsx, NO_TABLE_FOUND of those without a sure table too."""
    read = {
        "csv": lambda: decode.decoded(files, limits.archive_bytes, limits.pages),
        "txt": lambda: decode.decoded(files, limits.archive_bytes, limits.pages),
        "xlsx": lambda: containers.xlsx_rows(files, "file_id", limits),
        "docx": lambda: containers.docx_stories(files, "file_id", limits),
        "png": lambda: pdf.images_to_pdf(files, "file_id", limits),
        "jpg": lambda: pdf.images_to_pdf(files, "file_id", limits),
        "ofd": lambda: fixed_layout.layout_objects(files, "file_id", limits),
    }[source]()
    failed = read.where("error_code IS NOT NULL").select("file_id", "error_code")
    if (source, target) != ("ofd", "xlsx"):
        return failed
    sure = grid.exportable(_layout(files, limits)[1]).select(F.col("doc_id").alias("file_id"))
    without = files.where("content IS NOT NULL").select("file_id").join(failed, "file_id", "left_anti").join(sure, "file_id", "left_anti")
    return failed.unionByName(without.select("file_id", F.lit("NO_TABLE_FOUND").alias("error_code")))
