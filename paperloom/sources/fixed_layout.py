"""Fixed-layout packages (OFD): pages, text runs, line segments and images as typed rows."""

from __future__ import annotations

import itertools
import math
import posixpath
import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from ..operators.jobs import ParseLimits
from .containers import Refused, _all, _attr, _local, _per_file, safe_entries

DEPTH, PATH_OPS = 128, 100_000
BLACK, LINE_WIDTH = "000000FF", 0.2
QUADRATIC_STEPS, CUBIC_STEPS = 8, 12


def expand_deltas(text: str | None, gaps: int) -> list[float]:
    """Advances of `gaps` places: numbers, and `g count value` for repeats; the last one fills up, extra ones go.

    Raises ValueError for other words and for over max(1024, 4 * gaps) advances, as operators.paths.advances gives null.
    """
    words, out, i = (text or "").split() if gaps > 0 else [], [], 0
    while i < len(words):
        repeat = words[i].lower() == "g" and i + 2 < len(words)
        count = int(words[i + 1]) if repeat else 1
        if count < 0 or len(out) + count > max(1024, 4 * gaps):
            raise ValueError("advances exceed the limit")
        out += [float(words[i + 2] if repeat else words[i])] * count
        i += 3 if repeat else 1
    if out and len(out) < gaps:
        out += [out[-1]] * (gaps - len(out))
    return out[:gaps]


def _matrix(text: str | None) -> tuple[float, ...]:
    values = tuple(map(float, (text or "").split()))
    return values if len(values) == 6 else (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _apply(m: tuple[float, ...], x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def _box(text: str | None) -> tuple[float, float, float, float] | None:
    values = tuple(map(float, (text or "").split()))
    return values if len(values) == 4 else None


def path_segments(data: str, box: tuple[float, float, float, float], m: tuple[float, ...]) -> list[tuple[float, float, float, float]]:
    """Straight pieces of a path; curves in even steps, arcs by their chord, pieces up to 0.001 mm left out."""
    tokens = re.findall(r"[A-Za-z]|[-+0-9.eE]+", data or "")
    at = start = None
    out, i, ops = [], 0, 0
    place = lambda p: (lambda q: (q[0] + box[0], q[1] + box[1]))(_apply(m, *p))

    def add(a, b):
        (x1, y1), (x2, y2) = place(a), place(b)
        if math.hypot(x2 - x1, y2 - y1) > 0.001:
            out.append((x1, y1, x2, y2))

    while i < len(tokens):
        op, ops = tokens[i].upper(), ops + 1
        if ops > PATH_OPS or len(out) > PATH_OPS:
            raise Refused("PATH_LIMIT_EXCEEDED")
        count = {"S": 2, "M": 2, "L": 2, "Q": 4, "B": 6, "A": 7, "C": 0}.get(op)
        if count is None:
            i += 1
            continue
        v = list(map(float, itertools.takewhile(lambda x: not x.isalpha(), tokens[i + 1 : i + 1 + count])))
        i += 1 + len(v)
        # nothing is drawn before a start, and short operations are passed over
        if len(v) < count or (at is None and op not in "SM"):
            continue
        if op in "SM":
            at = start = (v[0], v[1])
        elif op == "C":
            add(at, start)
            at = start
        else:
            points = [at, *[(v[k], v[k + 1]) for k in range(0, count, 2)]] if op != "A" else [at, (v[5], v[6])]
            steps = {"Q": QUADRATIC_STEPS, "B": CUBIC_STEPS}.get(op, 1)
            degree, last = len(points) - 1, at
            for k in range(1, steps + 1):
                t = k / steps
                here = tuple(sum(math.comb(degree, j) * (1 - t) ** (degree - j) * t**j * points[j][axis] for j in range(degree + 1)) for axis in (0, 1))
                add(last, here)
                last = here
            at = points[-1]
    return out


def thin_box_line(box: tuple[float, float, float, float]) -> tuple[float, float, float, float] | None:
    """The middle line of a filled box that is at most 3 mm thick and four times as long, else None."""
    x, y, w, h = box
    if w >= 4 * h and h <= 3:
        return x, y + h / 2, x + w, y + h / 2
    if h >= 4 * w and w <= 3:
        return x + w / 2, y, x + w / 2, y + h
    return None


def colour(node: ElementTree.Element | None) -> str:
    """RRGGBBAA of a colour element; black for none or one without three values."""
    values = ((_attr(node, "Value") if node is not None else None) or "").split()
    if len(values) < 3:
        return BLACK
    alpha = _attr(node, "Alpha")
    return "".join(f"{max(0, min(255, int(v))):02X}" for v in (*values[:3], 255 if alpha is None else alpha))


def _own(node: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((e for e in node if _local(e) == name), None)


def draw_params(resources: list[ElementTree.Element]) -> dict[str, tuple]:
    """id: (fill colour, stroke colour, line width) elements and text of drawing parameters; Relative fills in what is missing."""
    found = {_attr(e, "ID"): e for r in resources for e in _all(r, "DrawParam") if _attr(e, "ID")}
    out = {}
    for name in found:
        fill = stroke = width = None
        at, seen = name, set()
        while at in found and at not in seen:
            seen.add(at)
            e = found[at]
            fill = _own(e, "FillColor") if fill is None else fill
            stroke = _own(e, "StrokeColor") if stroke is None else stroke
            width = width or _attr(e, "LineWidth")
            at = _attr(e, "Relative")
        out[name] = fill, stroke, width
    return out


def drawn(node: ElementTree.Element, params: dict[str, tuple]) -> tuple[str, str, float]:
    """(fill colour, stroke colour, line width) of a path: its own, else inherited, else black, black and 0.2."""
    fill, stroke, width = params.get(_attr(node, "DrawParam"), (None, None, None))
    own_fill, own_stroke = _own(node, "FillColor"), _own(node, "StrokeColor")
    return colour(fill if own_fill is None else own_fill), colour(stroke if own_stroke is None else own_stroke), float(_attr(node, "LineWidth") or width or LINE_WIDTH)


def text_runs(node: ElementTree.Element, box: tuple[float, float, float, float], m: tuple[float, ...]) -> list[tuple]:
    """(x, baseline, width, height, text, size_pt, bold): a run for each text code, parted where the baseline moves.

    A positive HScale widens the matrix (its a and b).
    """
    wide = float(_attr(node, "HScale") or 1)
    if wide > 0:
        m = (m[0] * wide, m[1] * wide, *m[2:])
    size = float(_attr(node, "Size") or 0)
    weight = int(_attr(node, "Weight") or 400)
    scale = math.hypot(m[2], m[3]) or 1.0
    out, x, y = [], 0.0, 0.0
    for code in _all(node, "TextCode"):
        text = code.text or ""
        x, y = float(_attr(code, "X") or x), float(_attr(code, "Y") or y)
        try:
            dx, dy = (expand_deltas(_attr(code, k), max(0, len(text) - 1)) for k in ("DeltaX", "DeltaY"))
        except ValueError:
            dx = dy = []  # the run then has no advances of its own
        run, begin, px, py = "", (x, y), x, y
        for i, ch in enumerate(text):
            run += ch
            step_x, step_y = (d[i] if i < len(d) else 0.0 for d in (dx, dy))
            ends = i == len(text) - 1 or abs(step_y) > 0.001
            if ends and run:
                ax, ay = _apply(m, *begin)
                width = max(px - begin[0] + size, size) * (math.hypot(m[0], m[1]) or 1.0)
                out.append((box[0] + ax, box[1] + ay, width, max(1.0, size * scale), run, size * scale * 72 / 25.4, weight != 400))
                run = ""
            px, py = px + step_x, py + step_y
            if ends:
                begin = (px, py)
    return out


def layout_rows(content: bytes, limits: ParseLimits = ParseLimits()) -> list[tuple]:
    """(page_no, kind, seq, x, y, width, height, text, baseline, x2, y2, size_pt, bold, fill, stroke,
    line_width): kinds page, text, line, image.

    Text has its fill colour, lines their colours and width; for the middle line of a filled box that is its thickness.
    """
    parts = safe_entries(content, limits, "OFD.xml")
    xml = lambda name: ElementTree.fromstring(parts[name])
    root = next((e.text or "" for e in _all(xml("OFD.xml"), "DocRoot")), "").lstrip("/")
    if root not in parts:
        raise Refused("MISSING_PART", root)
    folder, document = posixpath.dirname(root), xml(root)
    area = next((_box(e.text) for e in _all(document, "PhysicalBox")), None) or (0.0, 0.0, 210.0, 297.0)
    pages = [(_attr(e, "BaseLoc") or "") for e in _all(document, "Page") if _attr(e, "BaseLoc")]
    if len(pages) > limits.pages:
        raise Refused("PAGE_LIMIT_EXCEEDED")
    at = lambda e, base: e.text.strip().lstrip("/") if (e.text or "").strip().startswith("/") else posixpath.normpath(posixpath.join(base, (e.text or "").strip()))
    shared = [at(e, folder) for k in ("PublicRes", "DocumentRes") for e in _all(document, k)]
    out: list[tuple] = []
    for number, loc in enumerate(pages, 1):
        name = loc.lstrip("/") if loc.startswith("/") else posixpath.normpath(posixpath.join(folder, loc))
        page = xml(name)
        params = draw_params([xml(n) for n in [*shared, *(at(e, posixpath.dirname(name)) for e in _all(page, "PageRes"))] if n in parts])
        own = next((_box(e.text) for e in _all(page, "PhysicalBox")), None) or area
        out.append((number, "page", 0, *own, *[None] * 9))
        seq = 0

        def walk(node: ElementTree.Element, depth: int) -> None:
            nonlocal seq
            if depth > DEPTH:
                raise Refused("NESTING_LIMIT_EXCEEDED")
            for e in node:
                kind, box = _local(e), _box(_attr(e, "Boundary"))
                m = _matrix(_attr(e, "CTM"))
                if kind in ("Layer", "PageBlock", "Content"):
                    walk(e, depth + 1)
                elif _attr(e, "Visible") == "false" or not box:
                    continue
                elif kind == "TextObject":
                    for x, base, w, h, text, size, bold in text_runs(e, box, m):
                        out.append((number, "text", seq, x, base - h, w, h, text, base, None, None, size, bold, colour(_own(e, "FillColor")), None, None))
                        seq += 1
                elif kind == "PathObject":
                    data = next((d.text or "" for d in _all(e, "AbbreviatedData")), "")
                    thin = thin_box_line(box) if _attr(e, "Fill") == "true" else None
                    fill, stroke, thick = drawn(e, params)
                    if thin:
                        flat = box[2] >= 4 * box[3]
                        thick, stroke = (box[3] * math.hypot(m[2], m[3]) if flat else box[2] * math.hypot(m[0], m[1])), fill
                    for x1, y1, x2, y2 in [thin] if thin else path_segments(data, box, m):
                        out.append((number, "line", seq, x1, y1, abs(x2 - x1), abs(y2 - y1), None, None, x2, y2, None, None, fill, stroke, thick))
                        seq += 1
                elif kind == "ImageObject" and _attr(e, "ResourceID"):
                    out.append((number, "image", seq, *box, *[None] * 9))
                    seq += 1
                if seq > limits.entries:
                    raise Refused("OBJECT_LIMIT_EXCEEDED")

        walk(page, 0)
    return out


LAYOUT = "page_no int, kind string, seq int, x double, y double, width double, height double, text string, baseline double, x2 double, y2 double, size_pt double, bold boolean, fill string, stroke string, line_width double"


def layout_objects(files: DataFrame, key: str = "doc_id", limits: ParseLimits = ParseLimits()) -> DataFrame:
    """A row for each page, text run, segment and image of every package in the binary column `content`."""
    return _per_file(files, key, lambda c: layout_rows(c, limits), LAYOUT)
