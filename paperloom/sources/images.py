"""Image metadata: resolution and orientation from PNG, JFIF and EXIF headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DPI, MOST_DPI, DEFAULT_DPI = 36, 1200, 96.0


def _accepted(dpi: float | None) -> float | None:
    return dpi if dpi and LEAST_DPI <= dpi <= MOST_DPI else None


def _exif(data: bytes) -> tuple[int, float | None]:
    """Orientation and resolution of a TIFF block, either byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        return 1, None
    at = struct.unpack(order + "I", data[4:8])[0]
    found: dict[int, float] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, _, value = struct.unpack(order + "HHII", data[at + 2 + 12 * i : at + 14 + 12 * i])
        if kind == 3:
            found[tag] = struct.unpack(order + "H", data[at + 10 + 12 * i : at + 12 + 12 * i])[0]
        elif kind == 5:
            top, below = struct.unpack(order + "II", data[value : value + 8])
            found[tag] = top / below if below else 0
    unit = {2: 1.0, 3: 2.54}.get(int(found.get(0x128, 2)))
    turned = int(found.get(0x112, 1))
    return turned if 1 <= turned <= 8 else 1, found[0x11A] * unit if unit and 0x11A in found else None


def metadata(raw: bytes) -> tuple[int | None, int | None, float, int]:
    """(width, height, dpi, orientation); dpi 96 and orientation 1 where the file says nothing usable."""
    width = height = dpi = None
    turned = 1
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            at = 8
            while at + 8 <= len(raw):
                size, kind = struct.unpack(">I4s", raw[at : at + 8])
                body = raw[at + 8 : at + 8 + size]
                if kind == b"IHDR":
                    width, height = struct.unpack(">II", body[:8])
                elif kind == b"pHYs" and body[8] == 1:
                    dpi = struct.unpack(">I", body[:4])[0] * 0.0254
                elif kind == b"IDAT":
                    break
                at += 12 + size
        elif raw[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(raw) and raw[at] == 0xFF:
                marker, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
                body = raw[at + 4 : at + 2 + size]
                if marker == 0xE0 and body[:5] == b"JFIF\0":
                    dpi = dpi or {1: 1.0, 2: 2.54}.get(body[7], 0) * struct.unpack(">H", body[8:10])[0]
                elif marker == 0xE1 and body[:6] == b"Exif\0\0":
                    turned, own = _exif(body[6:])
                    dpi = own or dpi
                elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", body[1:5])
                    break
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return width, height, _accepted(dpi) or DEFAULT_DPI, turned


def image_metadata(files: DataFrame, key: str) -> DataFrame:
    """key, width, height, dpi, orientation of every image in the binary column `content`."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, *metadata(bytes(c))) for k, c in zip(pdf[key], pdf["content"]) if c is not None], columns=[key, "width", "height", "dpi", "orientation"]).astype({"width": "Int32", "height": "Int32"})

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, width int, height int, dpi double, orientation int")


def png_density(dpi: Column) -> Column:
    """Pixels a metre, as PNG files note the resolution."""
    return F.greatest(F.lit(1), F.floor(dpi / 0.0254 + 0.5).cast("int"))


def jpeg_density(dpi: Column) -> Column:
    """Dots an inch, as JFIF headers hold them."""
    return F.least(F.lit(65_535), F.greatest(F.lit(1), F.floor(dpi + 0.5).cast("int")))
