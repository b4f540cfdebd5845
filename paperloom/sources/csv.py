"""CSV files: delimiter detection and a parser with its own rules for quotes, blank lines and ragged rows, in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")
SAMPLE_RECORDS = 32
MAX_COLUMNS, MAX_CELL = 16_384, 32_767
#: What a line end or delimiter within quotes is written as while records and cells are parted, and the mark itself.
MARK = "\x1a"
MARKED = {MARK: MARK + "0", "\n": MARK + "1", **{d: f"{MARK}{i}" for i, d in enumerate(DELIMITERS, 2)}}


@dataclass(frozen=True)
class Limits:
    """Of one file: rows, cells, and UTF-16 units of a cell."""

    rows: int = 10_000
    cells: int = 250_000
    cell_units: int = MAX_CELL


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def quote_parts(text: Column) -> Column:
    """The text between its quotes, line ends as one character: odd parts (from 0) are within quotes.

    A doubled quote within quotes closes and opens them, so that the part between is empty. An even number of parts
    means that the last quote is open.
    """
    return F.split(_replaced(F.regexp_replace(text, "\r\n?", "\n"), [(MARK, MARKED[MARK])]), '"', -1)


def logical_records(parts: Column) -> Column:
    """The records of a text's quote_parts(): lines, but for line ends within quotes; these and delimiters there are marked."""
    inner = [(a, b) for a, b in MARKED.items() if a != MARK]
    return F.split(F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, _replaced(p, inner)).otherwise(p)), '"'), "\n", -1)


def _restored(cell: Column) -> Column:
    return F.when(cell.contains(MARK), _replaced(cell, [(b, a) for a, b in reversed(MARKED.items())])).otherwise(cell)


def record_cells(record: Column, delimiter: Column) -> Column:
    """The cells of a logical record; null for a cell with a misplaced quote.

    A cell is either quoted - a quote, anything with quotes doubled, a quote, then only blanks - or plain, without one.
    """

    def value(raw: Column) -> Column:
        body = F.when(delimiter == "\t", F.rtrim(raw, F.lit(" "))).otherwise(F.rtrim(raw, F.lit(" \t")))
        inner = F.substr(body, F.lit(2), F.length(body) - 2)
        quoted = body.startswith('"') & body.endswith('"') & (F.length(body) >= 2) & ~F.replace(inner, F.lit('""'), F.lit("")).contains('"')
        return F.when(~raw.contains('"'), _restored(raw)).when(quoted, _restored(F.replace(inner, F.lit('""'), F.lit('"'))))

    return F.transform(F.split(record, F.when(delimiter == "|", "\\|").otherwise(delimiter), -1), value)


def detected_delimiter(text: Column) -> Column:
    """The delimiter whose positive counts in the first 32 records agree most often; ties by the count, then by their number, then , TAB ; |."""
    records = F.slice(logical_records(quote_parts(text)), 1, SAMPLE_RECORDS)

    def best(some: Column) -> Column:
        def scored(d: Column, k: Column) -> Column:
            counts = F.filter(F.transform(some, lambda r: F.length(r) - F.length(F.replace(r, d, F.lit("")))), lambda n: n > 0)
            top = F.array_max(F.transform(counts, lambda n: F.struct(F.size(F.filter(counts, lambda x: x == n)).alias("freq"), n.alias("n"))))
            score = F.coalesce(top["freq"] * F.lit(1_000_000).cast("bigint") + top["n"] * F.lit(1_000) + F.size(counts), F.lit(0).cast("bigint"))
            return F.struct(score.alias("score"), (-k).alias("order"), d.alias("delimiter"))

        return F.array_max(F.transform(F.array(*[F.lit(d) for d in DELIMITERS]), scored))["delimiter"]

    return F.transform(F.array(records), best)[0]


def csv_rows(files: DataFrame, key: str, delimiter: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """key, row_no (from 0), cells of every row of the texts; a text that can't be parsed gives one row with error_code.

    delimiter None: detected for each text. A blank line is a row of one empty cell; an end of line at the end adds no
    row; a null text has none. Expressions only: texts spread over tasks, a text is one value.
    """
    # a null text has null records, which end as no row: a filter would move below and work its text out once more
    source = files.select(key, F.coalesce(F.lit(delimiter), detected_delimiter(F.col("text"))).alias("_d"), quote_parts(F.col("text")).alias("_parts"))
    records = logical_records(F.col("_parts"))
    source = source.select(key, "_d", (F.size("_parts") % 2 == 0).alias("_open"), records.alias("_records"))
    lines = F.when(F.element_at("_records", -1) == "", F.slice("_records", 1, F.size("_records") - 1)).otherwise(F.col("_records"))
    source = source.select(key, "_open", F.transform(lines, lambda r: record_cells(r, F.col("_d"))).alias("_rows"))
    units = lambda x: (F.octet_length(x) > limits.cell_units) & (F.octet_length(F.encode(x, "UTF-16BE")) > 2 * limits.cell_units)
    cells = F.aggregate("_rows", F.lit(0).cast("bigint"), lambda n, r: n + F.size(r))
    error = (
        F.when(F.col("_open") | F.exists("_rows", lambda r: F.exists(r, lambda x: x.isNull())), "CONVERSION_FAILED: misplaced or open quote")
        .when((cells > limits.cells) | F.exists("_rows", lambda r: (F.size(r) > MAX_COLUMNS) | F.exists(r, units)), "CONVERSION_FAILED: cell limit")
        .when(F.size("_rows") > limits.rows, "CONVERSION_FAILED: row limit")
    )
    source = source.withColumn("_error", error)
    row = lambda cells, code: F.struct(cells.alias("cells"), code.alias("error_code"))
    failed = F.array(row(F.lit(None).cast("array<string>"), F.col("_error")))
    items = F.when(F.col("_error").isNull(), F.transform("_rows", lambda r: row(r, F.lit(None).cast("string")))).otherwise(failed)
    # as an outer generator, so that no filter on its rows moves below and parses every text again
    out = source.select(key, F.posexplode_outer(items).alias("_no", "_r")).where("_no IS NOT NULL")
    return out.select(key, F.when(F.col("_r.error_code").isNull(), F.col("_no").cast("bigint")).alias("row_no"), "_r.cells", "_r.error_code")
