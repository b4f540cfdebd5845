"""Joining recognised text with a page's own text, and choosing what to recognise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.geometry import intersection_area
from ..functions.text import nonblank_chars, without_space
from .grouped import dealt, small_batches

PAGE = ["doc_id", "page_no"]


BOX = ("x", "y", "width", "height")
#: Pairs of boxes that are compared at once.
PAIRS = 1 << 20


def new_blocks(pages: DataFrame, overlap: float = 0.7) -> DataFrame:
    """pages without _native, and with those blocks in _found that no native one repeats: equal text, white space aside, or a box mostly shared.

    pages: any columns, _found and _native, arrays of structs with text, x, y, width, height. Texts are compared by the
    JVM; boxes in Arrow batches of many pages, each with the native ones whose rows of the page it meets.
    """
    text = lambda b: without_space(b["text"])
    unlike = lambda texts: F.filter("_found", lambda f: ~F.coalesce(F.array_contains(texts, text(f)), F.lit(False)))
    # texts without their white space are made once a page
    own = F.coalesce("_native", F.array().cast(pages.schema["_native"].dataType))
    left = F.transform(F.array(F.transform(own, text)), unlike)[0]
    boxes = F.transform(own, lambda b: F.struct(*[b[k].cast("double").alias(k) for k in BOX]))
    rest = [k for k in pages.columns if k not in ("_found", "_native")]
    df = pages.select(*rest, left.alias("_found"), boxes.alias("_native"))
    schema = StructType(df.schema.fields[:-1])
    arrow = to_arrow_schema(schema)

    def sides(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
        blocks, sizes = column.flatten(), column.value_lengths().fill_null(0).to_numpy()
        return blocks, np.repeat(np.arange(len(sizes)), sizes), [blocks.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in BOX]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, page, mine = sides(batch.column(len(rest)))
            _, their_page, theirs = sides(batch.column(len(rest) + 1))
            again = shared_boxes(page, mine, their_page, theirs, overlap)
            sizes = np.bincount(page[~again], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), blocks.filter(pa.array(~again)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], lists.cast(arrow.field("_found").type)], schema=arrow)

    small_batches(pages.sparkSession)
    return df.mapInArrow(go, schema)


def shared_boxes(page: np.ndarray, mine: list[np.ndarray], their_page: np.ndarray, theirs: list[np.ndarray], overlap: float) -> np.ndarray:
    """For each box (x, y, width, height) of `mine`, whether one of `theirs` on its page shares more than `overlap` of the smaller one."""
    whole = np.isfinite(theirs).all(0)
    order = np.flatnonzero(whole)[np.lexsort((theirs[1][whole], their_page[whole]))]
    (nx, ny, nw, nh), on = (v[order] for v in theirs), their_page[order]
    x, y, w, h = mine
    # theirs by page and y: those that meet a box begin after it less their greatest height, and before its end
    high = np.zeros(int(max(page.max(initial=-1), on.max(initial=-1))) + 1)
    np.maximum.at(high, on, nh)
    key = on + 1j * ny
    usable = np.isfinite(mine).all(0)
    at = np.where(usable, y, 0)
    first = np.searchsorted(key, page + 1j * (at - high[page]))
    count = np.where(usable, np.maximum(np.searchsorted(key, page + 1j * (at + np.where(usable, h, 0))) - first, 0), 0)
    again, upto = np.zeros(len(page), bool), np.cumsum(count)
    begin = 0
    while begin < len(page):
        done = int(upto[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        n = count[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        k = np.repeat(first[begin:end] - (np.cumsum(n) - n), n) + np.arange(len(i))
        side = lambda a, an, b, bn: np.maximum(0, np.minimum(a + an, b + bn) - np.maximum(a, b))
        both = side(x[i], w[i], nx[k], nw[k]) * side(y[i], h[i], ny[k], nh[k])
        again[i[both / np.maximum(0.01, np.minimum(w[i] * h[i], nw[k] * nh[k])) > overlap]] = True
        begin = end
    return again


def without_duplicates(found: DataFrame, native: DataFrame, overlap: float = 0.7) -> DataFrame:
    """Rows of found that no native block of their page repeats (see new_blocks).

    Both sides are shuffled once, by page, and meet as arrays of a page's blocks; pages are the unit that must fit a task.
    """
    gathered = lambda df, columns, name: dealt(df, PAGE).groupBy(*PAGE).agg(F.collect_list(F.struct(*columns)).alias(name))
    rest = [k for k in found.columns if k not in PAGE]
    pages = gathered(found, rest, "_found").join(gathered(native, ["text", *BOX], "_native"), PAGE, "left")
    return new_blocks(pages, overlap).select(*PAGE, F.explode("_found").alias("_b")).select(*[F.col(k) if k in PAGE else F.col(f"_b.`{k}`") for k in found.columns])


def with_found(native: DataFrame, found: DataFrame) -> DataFrame:
    """Native blocks, then the recognised ones that are new."""
    return native.withColumn("origin", F.lit(0)).unionByName(without_duplicates(found, native).withColumn("origin", F.lit(1)), allowMissingColumns=True)


def text_backed(chars: Column, coverage: Column) -> Column:
    """Whether a page's large image is a background under enough text, and need not be recognised."""
    return (chars >= 80) & (coverage >= 0.65)


def scanned(chars: Column, images: Column, coverage: Column) -> Column:
    """Whether a page is a scan: it has an image, and no text, or little text and half of it covered."""
    return F.when(images == 0, False).otherwise((chars == 0) | ((chars < 20) & (coverage >= 0.5)))


def page_coverage(images: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, images, coverage: images of a page and the largest share of it that one covers; signatures don't count."""
    i = images.where("role <> 'SIGNATURE'").select(*PAGE, *[F.col(c).alias(f"_{c}") for c in ("x", "y", "width", "height")])
    share = intersection_area(*[F.col(f"_{c}") for c in ("x", "y", "width", "height")], *[F.col(c) for c in ("x", "y", "width", "height")]) / F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    return pages.join(i, PAGE, "left").groupBy(*PAGE).agg(F.count("_x").alias("images"), F.coalesce(F.max(F.when(F.col("_x").isNotNull(), share)), F.lit(0.0)).alias("coverage"))


def page_chars(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE).agg(F.sum(nonblank_chars(F.col("text"))).alias("chars"))


def plan(chars: Column, visible: Column) -> Column:
    """What to recognise on a page: all of it if it has no text but something to see, else its images."""
    return F.when((chars == 0) & visible, "PAGE").when(chars == 0, "NONE").otherwise("IMAGES")


def required_pages(warnings: DataFrame) -> DataFrame:
    """doc_id, pages: the numbers of pages that still need recognition, in order."""
    need = warnings.where("code = 'OCR_REQUIRED'").select(*PAGE).distinct()
    return need.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_no")), lambda p: p.cast("string")), "、").alias("pages"))


def oriented(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> Column:
    """struct(x, y): where a pixel goes when an EXIF orientation of 1..8 is undone; width and height are the stored ones."""
    r, b = width - 1 - x, height - 1 - y
    at = lambda a, c: F.struct(a.alias("x"), c.alias("y"))
    return F.when(orientation == 2, at(r, y)).when(orientation == 3, at(r, b)).when(orientation == 4, at(x, b)).when(orientation == 5, at(y, x)).when(orientation == 6, at(b, x)).when(orientation == 7, at(b, r)).when(orientation == 8, at(y, r)).otherwise(at(x, y))


#: Pixels that an engine gets at most, unless set otherwise; the longest edge of a picture that is made smaller first.
OCR_PIXELS, MAX_EDGE = 25_000_000, 1600


def ocr_pixel_error(width: Column, height: Column, most: int = OCR_PIXELS) -> Column:
    return F.when(width.cast("decimal(38,0)") * height.cast("decimal(38,0)") > most, "OCR_RESOURCE_EXHAUSTED")


def render_pixel_error(width_mm: Column, height_mm: Column, dpi: Column, most: int = OCR_PIXELS) -> Column:
    """Of a page before it is rendered for recognition."""
    w, h = F.ceil(width_mm * dpi / 25.4), F.ceil(height_mm * dpi / 25.4)
    return F.when(w.isNull() | h.isNull() | (w <= 0) | (h <= 0) | (w.cast("double") * h > most), "OCR_RESOURCE_EXHAUSTED")


def downscaled(width: Column, height: Column, most: int = MAX_EDGE) -> Column:
    """struct(width, height) of a picture whose longest edge is `most` at most; a smaller one stays as it is."""
    edge = F.greatest(width, height)
    size = lambda v: F.greatest(F.lit(1), F.floor(v * most / edge + 0.5).cast("int"))
    return F.when(edge <= most, F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))).otherwise(F.struct(size(width).alias("width"), size(height).alias("height")))


def needing_pages(warnings: DataFrame) -> DataFrame:
    return warnings.where("code = 'OCR_REQUIRED'").select(*PAGE).distinct()


def availability_errors(warnings: DataFrame, engine: Column) -> DataFrame:
    """doc_id, page_no, error_code of the pages that need recognition while there is no engine.

    engine: null if it is there, else why not; blank stands for OCR_ENGINE_UNAVAILABLE.
    """
    code = F.when(F.trim(engine) == "", "OCR_ENGINE_UNAVAILABLE").otherwise(engine)
    return needing_pages(warnings).withColumn("error_code", code).where("error_code IS NOT NULL")


def images_to_recognise(images: DataFrame, warnings: DataFrame) -> DataFrame:
    """Images of the pages that need recognition, with image_no (from 1); signatures and empty ones are left out."""
    wanted = images.where("upper(role) <> 'SIGNATURE' AND octet_length(data) > 0").join(needing_pages(warnings), PAGE, "left_semi")
    return wanted.withColumn("image_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("seq")))


def recognised_pages(native: DataFrame, warnings: DataFrame, words: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings) after the pages that need it are recognised.

    Their own blocks come first, then the recognised ones (words: image_no, seq), numbered on. Their OCR_REQUIRED
    warning goes and the notes of the recognition take its place; other pages keep theirs.
    """
    need = needing_pages(warnings)
    order = Window.partitionBy(*PAGE).orderBy("origin", "image_no", "seq")
    own = native.withColumn("origin", F.lit(0)).withColumn("image_no", F.lit(0))
    blocks = own.unionByName(words.join(need, PAGE, "left_semi").withColumn("origin", F.lit(1)), allowMissingColumns=True)
    left = warnings.where("code <> 'OCR_REQUIRED'")
    return blocks.withColumn("place", F.row_number().over(order)), left.unionByName(notes.join(need, PAGE, "left_semi"), allowMissingColumns=True)


def all_warnings(document: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, place, code, page_no: a document's warnings, then its pages', then its tables', each in their order (seq)."""
    parts = [d.select("doc_id", F.lit(i).alias("_of"), (F.col("page_no") if "page_no" in d.columns else F.lit(None)).cast("int").alias("page_no"), "seq", "code") for i, d in enumerate((document, pages, tables))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("_of", F.asc_nulls_first("page_no"), "seq")).alias("place"), "code", "page_no")
