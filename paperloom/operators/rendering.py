"""What a renderer needs before it paints: order, line and page breaks, font runs, grids of tables, text boxes.

Glyph tables have a row for each character: ch, width (thousandths of the font size), latin, cjk (which font has it).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import mm_to_twips
from .grouped import dealt
from .layout import outside

PAGE = ["doc_id", "page_no"]
#: Lines before images before text, where their z is equal.
KINDS = ("line", "image", "text")
#: What stands for a character that no font has.
MISSING = "?"


@dataclass(frozen=True)
class TextPage:
    """An A4 page of plain text, in points."""

    width: float = 595.27563
    height: float = 841.8898
    margin: float = 48.0
    size: float = 11.0
    leading: float = 15.0
    pages: int = 500

    @property
    def lines(self) -> int:
        """Lines of a page: the last one begins on the lower margin or above."""
        return int((self.height - 2 * self.margin) // self.leading) + 1


def painting_order(elements: DataFrame) -> DataFrame:
    """elements (doc_id, page_no, seq, z, kind) with place: by z, then kind, then as given."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return elements.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("z", rank, "seq")))


def overlay(elements: DataFrame, tables: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Elements (with x, y, width, height) to paint over a page: those in a table (doc_id, page_no, box) left out, in order."""
    return painting_order(outside(elements, tables.select(*PAGE, "x", "y", "width", "height"), tolerance))


def glyphs_of(lines: DataFrame, keys: list[str], glyphs: DataFrame) -> DataFrame:
    """keys, at (from 1), ch, font, width of each character of a line: the Latin font's glyph, else the CJK one's, else `?`."""
    chars = lines.select(*keys, F.posexplode(F.split("text", "")).alias("at", "ch")).where("ch <> ''").withColumn("at", F.col("at") + 1)
    unknown = glyphs.where(F.col("ch") == MISSING).select(F.max("width").alias("_missing"))
    # glyph tables are bounded by Unicode: a row for each character at most
    found = chars.join(F.broadcast(glyphs), "ch", "left").crossJoin(F.broadcast(unknown))
    known = F.coalesce(F.col("latin") | F.col("cjk"), F.lit(False))
    font = F.when(~known | F.col("latin"), "latin").otherwise("cjk")
    return found.select(*keys, "at", F.when(known, F.col("ch")).otherwise(MISSING).alias("ch"), font.alias("font"), F.when(known, F.col("width")).otherwise(F.col("_missing")).alias("width"))


def font_runs(chars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run_no, font, text: neighbouring characters of one font (see glyphs_of)."""
    order = Window.partitionBy(*keys).orderBy("at")
    new = F.when(F.lag("font").over(order) == F.col("font"), 0).otherwise(1)
    runs = chars.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(order).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ch"))), lambda c: c["ch"]), "")
    return runs.groupBy(*keys, "run_no").agg(F.first("font").alias("font"), text.alias("text"))


def wrapped(lines: DataFrame, keys: list[str], glyphs: DataFrame, page: TextPage = TextPage()) -> DataFrame:
    """keys, part_no (from 1), text: lines broken before the character that would pass the right margin; empty ones stay.

    A line is a fold over its characters; a character wider than the page has a part of its own.
    """
    most = (page.width - 2 * page.margin) * 1000 / page.size
    chars = glyphs_of(lines, keys, glyphs).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "ch", "width"))).alias("_c"))

    def step(acc: Column, c: Column) -> Column:
        breaks = (acc["text"] != "") & (acc["width"] + c["width"] > most)
        return F.when(breaks, F.struct(F.concat(acc["done"], F.array(acc["text"])).alias("done"), c["ch"].alias("text"), c["width"].cast("double").alias("width"))).otherwise(
            F.struct(acc["done"].alias("done"), F.concat(acc["text"], c["ch"]).alias("text"), (acc["width"] + c["width"]).cast("double").alias("width"))
        )

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0.0).alias("width"))
    parts = F.aggregate("_c", zero, step, lambda x: F.concat(x["done"], F.array(x["text"])))
    folded = chars.select(*keys, parts.alias("_parts"))
    rows = lines.select(*keys).join(folded, keys, "left").select(*keys, F.posexplode(F.coalesce("_parts", F.array(F.lit("")))).alias("part_no", "text"))
    return rows.withColumn("part_no", F.col("part_no") + 1)


def paged(lines: DataFrame, order: list[str], page: TextPage = TextPage()) -> DataFrame:
    """lines (doc_id, logical_page and the columns of `order`) with page_no and line_on_page, both from 1.

    A logical page begins a new page and goes on over as many as its lines fill.
    """
    place = F.row_number().over(Window.partitionBy("doc_id", "logical_page").orderBy(*order)) - 1
    filled = lines.groupBy("doc_id", "logical_page").agg(F.ceil(F.count(F.lit(1)) / page.lines).alias("_pages"))
    before = Window.partitionBy("doc_id").orderBy("logical_page").rowsBetween(Window.unboundedPreceding, -1)
    start = filled.select("doc_id", "logical_page", F.coalesce(F.sum("_pages").over(before), F.lit(0)).alias("_before"))
    rows = lines.withColumn("_place", place).join(start, ["doc_id", "logical_page"])
    number = (F.col("_before") + F.floor(F.col("_place") / page.lines) + 1).cast("int")
    return rows.withColumn("page_no", number).withColumn("line_on_page", (F.col("_place") % page.lines + 1).cast("int")).drop("_place", "_before")


def overlay_grid(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """The cells to write of each row of a table's grid, in order: row, col, span, merge (restart, continue, null), width in twips.

    tables: doc_id, page_no, table_no, xs, ys. A position that no cell covers is an empty cell of its own. A cell over
    several rows is begun in its first and continued in the others.
    """
    keys = [*PAGE, "table_no"]
    usable = tables.where((F.size("xs") > 1) & (F.size("ys") > 1)).select(*keys, "xs", F.size("ys").alias("_rows"))
    # the cells of a table are gathered once, as a row with its axes; its grid is then made without another shuffle
    packed = dealt(cells, keys).groupBy(*keys).agg(F.collect_list(F.struct("row", "col", "row_span", "col_span")).alias("_cells"))
    every = usable.join(packed, keys, "left")

    def written(cell: Column) -> Column:
        merge = lambda r: F.when(cell["row_span"] > 1, F.when(r == cell["row"], "restart").otherwise("continue"))
        return F.transform(F.sequence(cell["row"], cell["row"] + cell["row_span"] - 1), lambda r: F.struct(r.alias("row"), cell["col"].alias("col"), cell["col_span"].alias("span"), merge(r).alias("merge"), (r == cell["row"]).alias("filled")))

    own = F.flatten(F.transform(F.coalesce("_cells", F.array()), written))
    # places of the grid as numbers, row by row, whose difference is taken by hash
    n = F.size("xs").cast("long") - 1
    place = lambda r, k: r.cast("long") * n + k
    covered = F.flatten(F.transform("_own", lambda o: F.transform(F.filter(F.sequence(o["col"], o["col"] + o["span"] - 1), lambda k: (k >= 0) & (k < n)), lambda k: place(o["row"], k))))
    free = F.array_except(F.sequence(F.lit(0).cast("long"), (F.col("_rows") - 1) * n - 1), covered)
    empty = F.transform(free, lambda p: F.struct(F.floor(p / n).cast("int").alias("row"), (p % n).cast("int").alias("col"), F.lit(1).alias("span"), F.lit(None).cast("string").alias("merge"), F.lit(False).alias("filled")))
    # a grid is never empty; as an outer generator it is not worked out once more to filter empty ones
    cell = every.withColumn("_own", own).select(*keys, "xs", F.explode_outer(F.concat("_own", empty)).alias("_cell")).select(*keys, "xs", "_cell.*")
    step = lambda i: mm_to_twips(F.element_at("xs", i + 2) - F.element_at("xs", i + 1))
    width = F.aggregate(F.sequence(F.col("col"), F.least(F.col("col") + F.col("span"), F.size("xs") - 1) - 1), F.lit(0).cast("long"), lambda n, i: n + step(i).cast("long"))
    return cell.select(*keys, "row", "col", "span", "merge", "filled", width.alias("width"))


def table_xml(grid: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no, xml: a word table of the cells of overlay_grid, with the texts (row, col, text) of its own ones."""
    keys = [*PAGE, "table_no"]
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    run = F.when(F.col("filled") & (safe != ""), F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), safe, F.lit("</w:t></w:r></w:p>"))).otherwise("<w:p/>")
    span = F.when(F.col("span") > 1, F.format_string('<w:gridSpan w:val="%d"/>', "span")).otherwise("")
    merge = F.when(F.col("merge").isNotNull(), F.format_string('<w:vMerge w:val="%s"/>', "merge")).otherwise("")
    cell = F.concat(F.format_string('<w:tc><w:tcPr><w:tcW w:w="%d" w:type="dxa"/>', "width"), span, merge, F.lit("</w:tcPr>"), run, F.lit("</w:tc>"))
    joined = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value)))), lambda x: x[value]), "")
    cells = grid.join(texts.select(*keys, "row", "col", "text"), [*keys, "row", "col"], "left").withColumn("_cell", cell)
    rows = cells.groupBy(*keys, "row").agg(F.concat(F.lit("<w:tr>"), joined("col", "_cell"), F.lit("</w:tr>")).alias("_row"))
    return rows.groupBy(*keys).agg(F.concat(F.lit('<w:tbl><w:tblPr><w:tblLayout w:type="fixed"/></w:tblPr>'), joined("row", "_row"), F.lit("</w:tbl>")).alias("xml"))


def tolerant_width(width: Column, size_pt: Column, scale_percent: Column) -> Column:
    """Of a text box in mm: room for a font of other widths, and for a scale under 100 per cent that may be lost."""
    font, ratio = size_pt * 25.4 / 72, scale_percent / 100
    lost = F.when(ratio < 1, width * (1 / ratio - 1)).otherwise(F.lit(0.0))
    return width + F.greatest(F.lit(1.5), font * 0.8, lost + font * 0.5)
