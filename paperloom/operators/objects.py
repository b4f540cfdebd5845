"""The object tree of pages: nested references in document order, with a guard against cycles."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import map_columns

PAGE = ["doc_id", "page_no"]
#: Deepest nesting, and the kind that nests; the kinds that get a z.
DEPTH, BLOCK, DRAWN = 128, "block", ("text", "path", "image")


def _met(page: list[list], depth: int, most: int) -> Iterator[tuple]:
    """The references of one page that a reader meets; a stack holds what is left of each open block, so no way is stored."""
    below: dict = {}
    for ref in set(zip(*page)):
        below.setdefault(ref[0], []).append(ref)
    for refs in below.values():
        # a null position comes first
        refs.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[1], r[3] is not None, r[3] or ""), reverse=True)
    first, out, z, open_ = {}, [], 0, [below.get(None, [])]
    while open_:
        if not open_[-1]:
            open_.pop()
            continue
        ref = open_[-1].pop()
        level, place, number = len(open_) - 1, ref[:3], None
        if level > depth:
            status = "too_deep"
        elif first.setdefault(ref[1], place) != place:
            status = "repeated"
        else:
            status = "kept" if ref[3] == BLOCK or ref[3] in DRAWN else "unsupported"
            if ref[3] in DRAWN:
                number, z = z, z + 1
            elif ref[3] == BLOCK:
                # what follows the block in its own block waits below it; a block of the same place was opened already
                open_.append(below.pop(ref[1], []))
        out.append((*ref, level, status, number))
    if len(first) > most:
        return ((*r[:5], "refused", None) for r in out)
    return iter(out)


def object_tree(refs: DataFrame, depth: int = DEPTH, most: int = 10_000) -> DataFrame:
    """A row for each reference of refs (doc_id, page_no, parent_id, object_id, position, kind) that a reader meets.

    parent_id null: on the page itself. Objects are met from the page on, siblings by position (then id), a block's own
    objects right after it. An object counts where it is met first; status is
      kept         z is then its number among the page's texts, paths and images (null for a block)
      repeated     the object was met before, or holds itself: skipped with all below
      too_deep     its block is nested `depth` blocks deep already: skipped with all below
      unsupported  of another kind: no z
      refused      the page has over `most` objects: nothing of it counts
    References of objects that are no blocks, and those that no way from the page leads to, give no row. Repeated rows of
    one reference are one; a null position comes first; rows without document, page or object id are left out. One
    shuffle brings the references of a page together; a page's references must fit a task.
    """
    rows = refs.where("doc_id IS NOT NULL AND page_no IS NOT NULL AND object_id IS NOT NULL").select(*PAGE, "parent_id", "object_id", "position", "kind")
    ddl = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ("parent_id", "object_id", "position", "kind"))
    return map_columns(rows, PAGE, lambda page: _met(page, depth, most), f"{ddl}, depth int, status string, z int")
