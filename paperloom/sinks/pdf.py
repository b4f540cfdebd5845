"""Images as one-page PDF files, at the size that their resolution says."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.jobs import ParseLimits
from ..sources.images import metadata

LEAST_PT, MOST_PT = 3, 14_400


def placement(width: float, height: float, orientation: int) -> tuple[float, ...]:
    """The matrix that puts the stored image upright on a page of width x height points."""
    w, h = width, height
    return {
        1: (w, 0, 0, h, 0, 0), 2: (-w, 0, 0, h, w, 0), 3: (-w, 0, 0, -h, w, h), 4: (w, 0, 0, -h, 0, h),
        5: (0, -h, -w, 0, w, h), 6: (0, -h, w, 0, 0, h), 7: (0, h, w, 0, 0, 0), 8: (0, h, -w, 0, w, 0),
    }[orientation]


def _jpeg(raw: bytes) -> tuple[str, bytes] | None:
    at = 2
    while at + 9 <= len(raw) and raw[at] == 0xFF:
        marker, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(raw[at + 9])
            return (f"/ColorSpace /{space} /BitsPerComponent 8 /Filter /DCTDecode", raw) if space else None
        at += 2 + size
    return None


def _png(raw: bytes) -> tuple[str, bytes] | None:
    """The image data as it is; only without an alpha channel, transparency or interlacing."""
    at, data, palette, head = 8, b"", b"", None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            data += body
        elif kind == b"tRNS":
            return None
        at += 12 + size
    if not head or head[6] or head[3] not in (0, 2, 3):
        return None
    colours = {0: 1, 2: 3, 3: 1}[head[3]]
    space = {0: "/DeviceGray", 2: "/DeviceRGB"}.get(head[3]) or f"[/Indexed /DeviceRGB {len(palette) // 3 - 1} <{palette.hex()}>]"
    return f"/ColorSpace {space} /BitsPerComponent {head[2]} /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors {colours} /BitsPerComponent {head[2]} /Columns {head[0]} >>", data


def image_pdf(raw: bytes, limits: ParseLimits = ParseLimits()) -> tuple[bytes | None, str | None]:
    """(file, error code) for a JPEG or PNG image."""
    width, height, dpi, turned = metadata(raw)
    if not width or not height:
        return None, "IMAGE_INVALID"
    if width * height > limits.pixels:
        return None, "IMAGE_PIXEL_LIMIT_EXCEEDED"
    w, h = width * 72 / dpi, height * 72 / dpi
    if turned >= 5:
        w, h = h, w
    if not (LEAST_PT <= w <= MOST_PT and LEAST_PT <= h <= MOST_PT):
        return None, "PAGE_SIZE_UNSUPPORTED"
    kind = _jpeg(raw) if raw[:2] == b"\xff\xd8" else _png(raw)
    if not kind:
        return None, "IMAGE_KIND_UNSUPPORTED"
    paint = ("q " + " ".join(f"{x:.6g}" for x in placement(w, h, turned)) + " cm /Im Do Q").encode()
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:.4f} {h:.4f}] /Contents 4 0 R /Resources << /XObject << /Im 5 0 R >> >> >>".encode(),
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(paint), paint),
        f"<< /Type /XObject /Subtype /Image /Width {width} /Height {height} {kind[0]} /Length {len(kind[1])} >>\nstream\n".encode() + kind[1] + b"\nendstream",
    ]
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode(), None


def images_to_pdf(files: DataFrame, key: str, limits: ParseLimits = ParseLimits()) -> DataFrame:
    """key, content, error_code of every image in the binary column `content`."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, *image_pdf(bytes(c), limits)) for k, c in zip(pdf[key], pdf["content"]) if c is not None], columns=[key, "content", "error_code"], dtype=object)

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, content binary, error_code string")
