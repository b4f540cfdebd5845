"""File formats: by name, by identifier, by MIME type and by leading bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTETS, OFFICE = "application/octet-stream", "application/vnd.openxmlformats-officedocument."
#: Fixed values, in order: identifier, extension, content type, further accepted MIME types (None: accepts none).
FORMATS = (
    ("ofd", "ofd", "application/ofd", ("application/x-ofd", OCTETS, "application/zip")),
    ("docx", "docx", OFFICE + "wordprocessingml.document", (OCTETS,)),
    ("xlsx", "xlsx", OFFICE + "spreadsheetml.sheet", (OCTETS,)),
    ("csv", "csv", "text/csv", ("application/csv", "application/vnd.ms-excel", "text/plain", OCTETS)),
    ("pdf", "pdf", "application/pdf", (OCTETS,)),
    ("pdf-merge", "pdf", "application/pdf", None),
    ("pdf-split", "zip", "application/zip", None),
    ("pdf-watermark", "pdf", "application/pdf", None),
    ("pdf-compress", "pdf", "application/pdf", None),
    ("pptx", "pptx", OFFICE + "presentationml.presentation", (OCTETS,)),
    ("png", "png", "image/png", (OCTETS,)),
    ("jpg", "jpg", "image/jpeg", ("image/jpg", OCTETS)),
    ("html", "html", "text/html", ("application/xhtml+xml", OCTETS)),
    ("uof", "uof", OCTETS, ()),
    ("wps", "wps", OCTETS, ()),
    ("et", "et", OCTETS, ()),
    ("dps", "dps", OCTETS, ()),
    ("txt", "txt", "text/plain", (OCTETS,)),
)
#: Further extensions, and names by which a format may be asked for.
MORE_EXTENSIONS = {"jpg": ("jpeg",), "uof": ("uot", "uos", "uop")}
NAMES = {"pdf-merge": "pdf_merged", "pdf-split": "pdf_split", "pdf-watermark": "pdf_watermarked", "pdf-compress": "pdf_compressed"}
EXTENSION = {i: e for i, e, *_ in FORMATS}


def of_name(name: Column) -> Column:
    """The first format whose extension ends the name; null if none does."""
    lower, out = F.lower(name), F.lit(None).cast("string")
    for fmt, ext, *_ in reversed(FORMATS):
        fits = F.lit(False)
        for e in (ext, *MORE_EXTENSIONS.get(fmt, ())):
            fits = fits | lower.endswith("." + e)
        out = F.when(fits, fmt).otherwise(out)
    return out


def of_id(value: Column) -> Column:
    """The first format whose identifier, name or extension the value is; case, outer blanks and one leading dot don't count."""
    key = F.regexp_replace(F.lower(F.trim(value)), "^\\.", "")
    out = F.lit(None).cast("string")
    for fmt, ext, *_ in reversed(FORMATS):
        out = F.when(key.isin(fmt, NAMES.get(fmt, fmt), ext), fmt).otherwise(out)
    return F.when(key == "jpeg", "jpg").otherwise(out)


def accepts_mime(fmt: Column, mime: Column) -> Column:
    """Whether a declared MIME type will do; none declared always will, parameters don't count."""
    plain = F.trim(F.split_part(F.lower(F.coalesce(mime, F.lit(""))), F.lit(";"), F.lit(1)))
    out = F.lit(False)
    for name, _, own, more in FORMATS:
        if more is not None:
            out = F.when(fmt == name, plain.isin(own, *more)).otherwise(out)
    return (plain == "") | out


def content_type(fmt: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, own, _ in FORMATS:
        out = F.when(fmt == name, own).otherwise(out)
    return out


#: Leading bytes in hex (fixed values).
PDF, PNG, JPEG, GIF, BMP, OLE = "25504446", "89504E470D0A1A0A", "FFD8FF", "47494638", "424D", "D0CF11E0A1B11AE1"
ZIPS = ("504B0304", "504B0506", "504B0708")


def _begins(content: Column, *hexes: str) -> Column:
    head, out = F.hex(F.substring(content, 1, 16)), F.lit(False)
    for h in hexes:
        out = out | head.startswith(h)
    return out


def content_fits(fmt: Column, content: Column) -> Column:
    """Whether a file's leading bytes fit its format. Formats that only a conversion makes never do."""
    sample = F.substring(content, 1, 4096)
    no_nul = ~F.hex(sample).rlike("^(..)*00")
    xml = no_nul & F.hex(sample).rlike("^(09|0A|0B|0C|0D|20)*3C")
    zipped = _begins(content, *ZIPS)
    return (
        F.when(fmt == "pdf", _begins(content, PDF))
        .when(fmt == "png", _begins(content, PNG))
        .when(fmt == "jpg", _begins(content, JPEG))
        .when(fmt.isin("ofd", "docx", "xlsx", "pptx"), zipped)
        .when(fmt.isin("wps", "et", "dps"), zipped | _begins(content, OLE))
        .when(fmt == "uof", zipped | xml)
        .when(fmt.isin("csv", "txt", "html"), no_nul)
        .otherwise(False)
    )


def image_type(content: Column) -> Column:
    """MIME type of an image by its leading bytes."""
    return F.when(_begins(content, PNG), "image/png").when(_begins(content, JPEG), "image/jpeg").when(_begins(content, GIF), "image/gif").when(_begins(content, BMP), "image/bmp").otherwise(OCTETS)
