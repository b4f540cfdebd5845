"""Workbooks, word documents and fixed-layout packages: ZIP containers of XML, read with the standard library.

A file is one row of a binary column and is parsed in one task; its size, entries and expansion are bounded by
ParseLimits before any XML is read. A file that can't be used gives one row with error_code instead of failing the job.
"""

from __future__ import annotations

import io
import re
import stat
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import ParseLimits

XML_BYTES = 8 << 20
FORBIDDEN = re.compile(rb"<!DOCTYPE|<!ENTITY|<xi:include|XInclude", re.I)


class Refused(ValueError):
    """A file that is not read, with the code that says why."""

    def __init__(self, code: str, why: str = ""):
        super().__init__(why or code)
        self.code = code


def safe_entries(content: bytes, limits: ParseLimits = ParseLimits(), needs: str | None = None) -> dict[str, bytes]:
    """The entries of a package, after checks of paths, kinds, sizes, expansion and XML."""
    try:
        box = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Refused("INVALID_ARCHIVE", str(e)) from e
    infos = box.infolist()
    if len(infos) > limits.entries:
        raise Refused("TOO_MANY_ENTRIES")
    out, total = {}, 0
    for info in infos:
        name = info.filename.replace("\\", "/")
        if name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in name.split("/"):
            raise Refused("UNSAFE_PATH", name)
        if stat.S_ISLNK(info.external_attr >> 16):
            raise Refused("UNSUPPORTED_ENTRY", name)
        if info.is_dir():
            continue
        total += info.file_size
        if info.file_size > limits.entry_bytes or total > limits.expanded_bytes or info.file_size > limits.ratio * max(1, info.compress_size):
            raise Refused("EXPANSION_LIMIT", name)
        with box.open(info) as f:
            data = f.read(limits.entry_bytes + 1)
        if len(data) > limits.entry_bytes:
            raise Refused("EXPANSION_LIMIT", name)
        if name.lower().endswith((".xml", ".rels")) and (len(data) > XML_BYTES or FORBIDDEN.search(data)):
            raise Refused("UNSAFE_XML", name)
        out[name] = data
    if needs and needs not in out:
        raise Refused("MISSING_PART", needs)
    return out


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _all(node: ElementTree.Element, name: str):
    return (e for e in node.iter() if _local(e) == name)


def _attr(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


# ---------------------------------------------------------------- workbooks

#: Built-in number formats that show dates (fixed values), by their numbers.
DATE_FORMATS = {14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 22: "m/d/yy h:mm"}


def _number(value: str, code: str) -> str:
    number = float(value)
    shown = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code).lower()
    if re.search("[yd]", shown) or ("m" in shown and "0" not in shown):
        day = pd.Timestamp("1899-12-30") + pd.Timedelta(days=number)
        parts = {"yyyy": f"{day.year:04d}", "yy": f"{day.year % 100:02d}", "mmm": day.strftime("%b"), "mm": f"{day.month:02d}", "m": str(day.month), "dd": f"{day.day:02d}", "d": str(day.day)}
        return re.sub("yyyy|yy|mmm|mm|m|dd|d", lambda m: parts[m[0]], shown.split("h")[0].strip())
    m = re.fullmatch(r"(#,##)?0(\.0+)?(%)?", shown)
    if m:
        number *= 100 if m[3] else 1
        return f"{number:{',' if m[1] else ''}.{len(m[2] or '.') - 1}f}" + (m[3] or "")
    return str(int(number)) if number == int(number) and abs(number) < 1e11 else f"{number:.10g}"


def workbook_rows(content: bytes, limits: ParseLimits = ParseLimits()) -> list[tuple[int, str, int, list[str]]]:
    """(sheet number, sheet name, row, cells): rows up to the last one, cells as shown, formulas by their kept results."""
    parts = safe_entries(content, limits, "xl/workbook.xml")
    xml = lambda name: ElementTree.fromstring(parts[name])
    strings = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in parts else []
    codes: list[str] = []
    if "xl/styles.xml" in parts:
        styles = xml("xl/styles.xml")
        own = {int(_attr(n, "numFmtId")): _attr(n, "formatCode") or "" for n in _all(styles, "numFmt")}
        for group in _all(styles, "cellXfs"):
            ids = [int(_attr(x, "numFmtId") or 0) for x in group if _local(x) == "xf"]
            codes = [own.get(i, DATE_FORMATS.get(i, "General")) for i in ids]
    targets = {_attr(r, "Id"): _attr(r, "Target") for r in _all(xml("xl/_rels/workbook.xml.rels"), "Relationship")}
    out, seen = [], 0
    for n, sheet in enumerate(_all(xml("xl/workbook.xml"), "sheet"), 1):
        target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        root = xml(target.lstrip("/") if target.startswith("/") else "xl/" + target)
        rows: dict[int, list[str]] = {}
        for row in _all(root, "row"):
            r = int(_attr(row, "r") or len(rows) + 1) - 1
            cells: list[str] = []
            for cell in (e for e in row if _local(e) == "c"):
                ref = re.match("[A-Z]+", _attr(cell, "r") or "")
                col = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(ref[0]))) - 1 if ref else len(cells)
                kind, raw = _attr(cell, "t"), next((v.text or "" for v in cell if _local(v) == "v"), None)
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in _all(cell, "t"))
                elif raw is None:
                    value = ""
                elif kind == "s":
                    value = strings[int(raw)]
                elif kind == "b":
                    value = "TRUE" if raw == "1" else "FALSE"
                elif kind in ("str", "e"):
                    value = raw
                else:
                    style = int(_attr(cell, "s") or 0)
                    value = _number(raw, codes[style] if style < len(codes) else "General")
                cells += [""] * (col - len(cells)) + [value]
                seen += 1
            if r >= limits.entries or len(cells) > 16_384 or seen > limits.cells or any(len(x.encode("utf-16-le")) > 65_534 for x in cells):
                raise Refused("CONVERSION_FAILED", "sheet limit")
            rows[r] = cells
        out += [(n, _attr(sheet, "name") or "", r, rows.get(r, [])) for r in range(max(rows, default=-1) + 1)]
    return out


def _per_file(files: DataFrame, key: str, read, columns: str) -> DataFrame:
    """key, the columns that read(content) gives rows of, error_code."""
    names = [x.split()[0] for x in columns.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for k, content in zip(pdf[key], pdf["content"]):
                if content is None:
                    continue
                try:
                    out += [(k, *row, None) for row in read(bytes(content))]
                except Refused as e:
                    out.append((k, *[None] * len(names), e.code))
                except (ElementTree.ParseError, KeyError, ValueError, IndexError, StopIteration):
                    out.append((k, *[None] * len(names), "CONVERSION_FAILED"))
            yield pd.DataFrame(out, columns=[key, *names, "error_code"], dtype=object)

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, {columns}, error_code string")


def xlsx_rows(files: DataFrame, key: str, limits: ParseLimits = ParseLimits()) -> DataFrame:
    """key, sheet_no, sheet, row_no (from 0), cells of every workbook in the binary column `content`."""
    return _per_file(files, key, lambda c: workbook_rows(c, limits), "sheet_no int, sheet string, row_no int, cells array<string>")


# ---------------------------------------------------------------- word documents

#: Revision elements and the labels that their text gets; labels of the other stories.
REVISIONS = (("ins", "修订-插入"), ("del", "修订-删除"), ("moveFrom", "修订-移出"), ("moveTo", "修订-移入"))
HEADER, FOOTER, FOOTNOTE, ENDNOTE, COMMENT, TEXT_BOX = "页眉", "页脚", "脚注", "尾注", "批注", "文本框"


def _line(text: str) -> str:
    return re.sub("[ \t]+", " ", re.sub("[\r\n]", " ", text)).strip()


def _text(node: ElementTree.Element) -> str:
    """Text of a tree in its order, deleted text too; tabs kept, breaks as blanks."""
    name = _local(node)
    if name in ("t", "delText"):
        return node.text or ""
    own = {"tab": "\t", "br": " ", "cr": " "}.get(name, "")
    return own + "".join(map(_text, node))


def _block(node: ElementTree.Element) -> list[tuple[str, str]]:
    """(label, text) of a paragraph, table or content control, in order."""
    name = _local(node)
    if name == "p":
        text = _line(_text(node))
        out = [("", text)] if text else []
        boxes = [_line(_text(b)) for b in _all(node, "txbxContent")]
        out += [(TEXT_BOX, b) for b in boxes if b and b not in text]
        for element, label in REVISIONS:
            out += [(label, t) for t in (_line(_text(e)) for e in _all(node, element)) if t]
        return out
    if name == "tbl":
        out = []
        for row in (e for e in node if _local(e) == "tr"):
            cells = [_line(" ".join(_line(_text(p)) for p in _all(cell, "p"))) for cell in row if _local(cell) == "tc"]
            if any(cells):
                out.append(("", "\t".join(cells)))
        return out
    if name in ("sdt", "sdtContent", "body", "hdr", "ftr"):
        return [x for e in node for x in _block(e)]
    return []


def document_stories(content: bytes, limits: ParseLimits = ParseLimits()) -> list[tuple[int, str, str]]:
    """(seq, label, text): headers, body, footers, footnotes, endnotes and comments, each in its order."""
    parts = safe_entries(content, limits, "word/document.xml")
    named = lambda kind: sorted(n for n in parts if re.fullmatch(rf"word/{kind}\d*\.xml", n))
    rows: list[tuple[str, str]] = []
    for n in named("header"):
        rows += [(label or HEADER, t) for label, t in _block(ElementTree.fromstring(parts[n]))]
    for body in _all(ElementTree.fromstring(parts["word/document.xml"]), "body"):
        rows += _block(body)
    for n in named("footer"):
        rows += [(label or FOOTER, t) for label, t in _block(ElementTree.fromstring(parts[n]))]
    for kind, element, label, least in (("footnotes", "footnote", FOOTNOTE, 1), ("endnotes", "endnote", ENDNOTE, 1), ("comments", "comment", COMMENT, 0)):
        for n in named(kind):
            for e in _all(ElementTree.fromstring(parts[n]), element):
                if int(_attr(e, "id") or 0) >= least:
                    rows.append((label, _line(" ".join(_text(p) for p in _all(e, "p")))))
    return [(i, label, text) for i, (label, text) in enumerate(rows) if text.strip()]


def docx_stories(files: DataFrame, key: str, limits: ParseLimits = ParseLimits()) -> DataFrame:
    """key, seq, label, text of every word document in the binary column `content`."""
    return _per_file(files, key, lambda c: document_stories(c, limits), "seq int, label string, text string")


def docx_text(stories: DataFrame, key: str) -> DataFrame:
    """key, text: a line for each piece, labels in brackets before it."""
    line = F.when(F.col("label") == "", F.col("text")).otherwise(F.concat(F.lit("["), "label", F.lit("] "), "text"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda r: r["line"])
    return stories.where("error_code IS NULL").groupBy(key).agg(F.concat(F.array_join(rows, "\n"), F.lit("\n")).alias("text"))


def endnotes_on_new_page(document: bytes, endnotes: bytes) -> tuple[bytes, bool]:
    """A document whose last visible paragraph ends in a page break, and whether it had to be changed.

    Only with a real endnote: one without a type whose id is neither 0 nor 1. Not if that paragraph has a break already.
    """
    notes = [(_attr(n, "type") or "", _attr(n, "id")) for n in _all(ElementTree.fromstring(endnotes), "endnote")]
    if not any(not kind.strip() and number not in ("0", "1") for kind, number in notes):
        return document, False
    root = ElementTree.fromstring(document)
    bodies = list(_all(root, "body"))
    paragraphs = list(_all(bodies[0], "p")) if len(bodies) == 1 else []
    shown = lambda p: any((t.text or "").strip() for t in _all(p, "t")) or any(True for k in ("drawing", "object", "pict") for _ in _all(p, k))
    last = next((p for p in reversed(paragraphs) if shown(p)), None)
    if last is None or any(_attr(b, "type") == "page" for b in _all(last, "br")) or any(True for _ in _all(last, "pageBreakBefore")):
        return document, False
    space = last.tag[: last.tag.index("}") + 1] if "}" in last.tag else ""
    ElementTree.SubElement(ElementTree.SubElement(last, f"{space}r"), f"{space}br", {f"{space}type": "page"})
    return ElementTree.tostring(root), True


def with_endnote_breaks(parts: DataFrame, key: str) -> DataFrame:
    """key, document, changed of documents (document, endnotes: XML parts, null if there is none)."""

    def run(batches):
        for batch in batches:
            out = [endnotes_on_new_page(d, n) if d and n else (d, False) for d, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in out], pa.binary()), pa.array([c for _, c in out], pa.bool_())], names=[key, "document", "changed"])

    kind = parts.schema[key].dataType.simpleString()
    return parts.select(key, "document", "endnotes").mapInArrow(run, f"{key} {kind}, document binary, changed boolean")


def package_parts(names: DataFrame, key: str) -> DataFrame:
    """key, media, fonts: the sorted media and embedded font parts of a package (name: a row for each part)."""
    listed = lambda folder: F.array_sort(F.collect_list(F.when(F.col("name").startswith(folder) & ~F.col("name").endswith("/"), F.col("name"))))
    return names.groupBy(key).agg(listed("word/media/").alias("media"), listed("word/fonts/").alias("fonts"))
