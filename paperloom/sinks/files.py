"""Files as binary columns: CSV text, workbooks, word documents, archives.

A sink gathers the rows of one output file by its key and writes the file in one task; files spread over tasks.
"""

from __future__ import annotations

import io
import zipfile
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_line, sheet_name
from ..operators.grouped import dealt, map_groups, map_rows

XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
STAMP = (1980, 1, 1, 0, 0, 0)


def csv_text(rows: DataFrame, key: str) -> DataFrame:
    """key, text: rows (row_no, cells) as CSV, commas, CR LF, quotes only where needed."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", csv_line(F.col("cells")).alias("line")))), lambda r: F.concat(r["line"], F.lit("\r\n")))
    return rows.groupBy(key).agg(F.array_join(lines, "").alias("text"))


def archive(entries: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of the entries in their order; the same entries give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, data in entries:
            box.writestr(zipfile.ZipInfo(name, STAMP), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _column(n: int) -> str:
    name = ""
    while n >= 0:
        name, n = chr(65 + n % 26) + name, n // 26 - 1
    return name


def workbook(sheets: list[tuple[str, list[list[str]], list[str], dict[int, float], dict[int, float]]]) -> bytes:
    """A workbook of (name, rows, merged ranges, row heights in points, column widths in characters).

    Every value is an inline string, so that text that looks like a formula stays text.
    """
    parts = {
        "[Content_Types].xml": f'{XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": f'{XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{REL_NS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{XML}<workbook xmlns="{SHEET_NS}" xmlns:r="{REL_NS}"><sheets>' + "".join(f'<sheet name={quoteattr(s[0])} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{REL_NS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for i, (_, rows, merges, heights, widths) in enumerate(sheets, 1):
        cols = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w:.4f}" customWidth="1"/>' for c, w in sorted(widths.items()))
        body = []
        for r, row in enumerate(rows, 1):
            tall = f' ht="{heights[r - 1]:.4f}" customHeight="1"' if r - 1 in heights else ""
            cells = "".join(f'<c r="{_column(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row))
            body.append(f'<row r="{r}"{tall}>{cells}</row>')
        merged = f'<mergeCells count="{len(merges)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in merges) + "</mergeCells>" if merges else ""
        parts[f"xl/worksheets/sheet{i}.xml"] = f'{XML}<worksheet xmlns="{SHEET_NS}">' + (f"<cols>{cols}</cols>" if cols else "") + f"<sheetData>{''.join(body)}</sheetData>{merged}</worksheet>"
    return archive([(k, v.encode()) for k, v in parts.items()])


def _files(df: DataFrame, key: str, make) -> DataFrame:
    """key, content: make(rows of a key as dicts, in no order) -> bytes; many keys to a batch."""
    return map_groups(df, [key], lambda rows: [(make(rows),)], "content binary")


def _by(*names: str):
    return lambda row: tuple(row[n] for n in names)


def xlsx_text(rows: DataFrame, key: str, sheet: str = "Sheet1") -> DataFrame:
    """key, content: rows (row_no, cells) as a workbook of one sheet of text."""
    return _files(rows.select(key, "row_no", "cells"), key, lambda rows: workbook([(sheet, [r["cells"] for r in sorted(rows, key=_by("row_no"))], [], {}, {})]))


def sheet_files(rows: DataFrame, key: str) -> DataFrame:
    """key, content: the sheets (sheet_no, sheet, row_no, cells) of a key as CSV; more than one in a ZIP, named `01-name.csv`.

    The rows are dealt by key once, and pass once.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", csv_line(F.col("cells")).alias("line")))), lambda r: F.concat(r["line"], F.lit("\r\n")))
    sheets = dealt(rows, [key]).groupBy(key, "sheet_no", "sheet").agg(F.array_join(lines, "").alias("text"))
    entry = F.format_string("%02d-%s.csv", "sheet_no", sheet_name(F.col("sheet"))).alias("entry")
    packed = sheets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sheet_no", entry, "text"))).alias("_sheets"))

    def make(sheets: list[dict]) -> bytes:
        texts = [(s["entry"], s["text"].encode()) for s in sheets]
        return texts[0][1] if len(texts) == 1 else archive(texts)

    return map_rows(packed, [key], lambda rows: [(make(r["_sheets"]),) for r in rows], "content binary")


def xlsx_tables(cells: DataFrame) -> DataFrame:
    """doc_id, content: a sheet for each page with its tables below each other, two rows apart, merged cells merged.

    cells: of recognised tables, with text. Row heights follow the grid; a column takes its width from the last table.
    """

    def parted(rows: list[dict], name: str) -> list[tuple[int, list[dict]]]:
        return [(k, list(g)) for k, g in groupby(sorted(rows, key=_by(name)), lambda r: r[name])]

    def make(rows: list[dict]) -> bytes:
        sheets = []
        for page, on_page in parted(rows, "page_no"):
            grid: list[list[str]] = []
            merges, heights, widths, top = [], {}, {}, 0
            for _, table in sorted(parted(on_page, "table_no"), key=lambda t: min(c["y"] for c in t[1])):
                n, m = table[0]["rows"], table[0]["cols"]
                grid += [[""] * m for _ in range(n)]
                for cell in sorted(table, key=_by("row", "col")):
                    r, k = top + cell["row"], cell["col"]
                    if cell["text"].strip() or not grid[r][k].strip():
                        grid[r][k] = cell["text"]
                    if cell["row_span"] > 1 or cell["col_span"] > 1:
                        merges.append(f"{_column(k)}{r + 1}:{_column(k + cell['col_span'] - 1)}{r + cell['row_span']}")
                    if cell["row_span"] == 1:
                        heights[r] = max(1.0, cell["height"] * 72 / 25.4)
                    if cell["col_span"] == 1:
                        widths[k] = min(255.0, max(1.0, cell["width"] / 2))
                top += n + 2
                grid += [[], []]
            sheets.append((f"第{page}页", grid[:-2], merges, heights, widths))
        return workbook(sheets)

    return _files(cells.select("doc_id", "page_no", "table_no", "rows", "cols", "row", "col", "row_span", "col_span", "y", "width", "height", "text"), "doc_id", make)


#: A line that begins with this holds a word table as XML, not text.
RAW = "\ue000"


def word_document(paragraphs: list[tuple[str, bool]]) -> bytes:
    """A word document of (text, page break before) paragraphs; lines behind RAW are tables."""
    body = []
    for text, breaks in paragraphs:
        if text.startswith(RAW + "<w:tbl>"):
            body.append(('<w:p><w:r><w:br w:type="page"/></w:r></w:p>' if breaks else "") + text[len(RAW) :])
            continue
        run = f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
        body.append("<w:p>" + ('<w:r><w:br w:type="page"/></w:r>' if breaks else "") + run + "</w:p>")
    parts = [
        ("[Content_Types].xml", f'{XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'),
        ("_rels/.rels", f'{XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{REL_NS}/officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/document.xml", f'{XML}<w:document xmlns:w="{WORD_NS}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>'),
    ]
    return archive([(n, x.encode()) for n, x in parts])


def docx_lines(lines: DataFrame, key: str) -> DataFrame:
    """key, content: lines (page_no, line_no, line) as paragraphs, each page but the first on a new page."""

    def make(rows: list[dict]) -> bytes:
        rows = sorted(rows, key=_by("page_no", "line_no"))
        return word_document([(r["line"], i > 0 and r["page_no"] != rows[i - 1]["page_no"]) for i, r in enumerate(rows)])

    return _files(lines.select(key, "page_no", "line_no", "line"), key, make)


def batch_archive(outputs: DataFrame, reports: DataFrame) -> DataFrame:
    """task_id, content: outputs (entry_name, content, idx) of a task in a ZIP, with its failure report if there is one."""
    rows = outputs.select("task_id", "idx", "entry_name", "content").unionByName(reports.select("task_id", F.lit(2**31 - 1).alias("idx"), F.lit("conversion-report.txt").alias("entry_name"), F.encode("report", "UTF-8").alias("content")))
    return _files(rows, "task_id", lambda rows: archive([(r["entry_name"], r["content"]) for r in sorted(rows, key=_by("idx"))]))
