"""The rules of CSV files in plain Python, for comparison."""

import re

from paperloom.sources import csv


def plain_csv(text: str, delimiter: str = ",", limits: csv.Limits = csv.Limits()) -> list[list[str]]:
    """Rows of cells, all text. ValueError for an open or misplaced quote or a passed limit.

    A cell is either quoted - a quote, anything with quotes doubled, a quote, then only blanks - or plain, without
    a quote. A blank line is a row of one empty cell; an end of line at the end of the file adds no row.
    """
    text = re.sub("\r\n?", "\n", text)
    d = re.escape(delimiter)
    quoted = re.compile(f'"((?:[^"]|"")*)"[ \t]*(?={d}|\n|\\Z)' if delimiter != "\t" else '"((?:[^"]|"")*)"[ ]*(?=\t|\n|\\Z)')
    plain = re.compile(f'[^"{d}\n]*(?={d}|\n|\\Z)')
    rows: list[list[str]] = []
    row: list[str] = []
    at = cells = 0
    while at < len(text) or row:
        m = quoted.match(text, at) if text[at : at + 1] == '"' else plain.match(text, at)
        if not m:
            raise ValueError(f"misplaced or open quote near {at + 1}")
        value = m[1].replace('""', '"') if m.re is quoted else m[0]
        cells += 1
        if len(row) >= csv.MAX_COLUMNS or cells > limits.cells or len(value.encode("utf-16-le")) // 2 > limits.cell_units:
            raise ValueError("cell limit")
        row.append(value)
        at = m.end()
        if text[at : at + 1] == delimiter:
            at += 1
            continue
        if len(rows) >= limits.rows:
            raise ValueError("row limit")
        rows.append(row)
        row = []
        if at >= len(text):
            break
        at += 1
    return rows
