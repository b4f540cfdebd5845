"""XML texts as rows: tokens by one pattern, nesting by running counts, and the stories of word documents over them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import SLICE, map_columns, map_values

#: Revision elements and the labels that their text gets; the label of text boxes.
REVISIONS = (("ins", "修订-插入"), ("del", "修订-删除"), ("moveFrom", "修订-移出"), ("moveTo", "修订-移入"))
TEXT_BOX = "文本框"
#: The root that a document of the office format must have.
ROOT, NAMESPACE = "UOF", "http://schemas.uof.org/"

_TAG = "(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = rf"<!\[CDATA\[[\s\S]*?\]\]>|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<{_TAG}>|[^<]+"


def unescaped(text: Column) -> Column:
    """Text without entities: the five named ones and numbers, decimal or hexadecimal; others stay."""

    def numbered(part: Column, i: Column) -> Column:
        digits = F.regexp_extract(part, "^(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});", 1)
        code = F.when(digits.startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).cast("int")
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when((i == 0) | (digits == ""), F.when(i == 0, part).otherwise(F.concat(F.lit("&#"), part))).otherwise(F.concat(sign, F.substr(part, F.length(digits) + 2)))

    out = F.when(text.contains("&#"), F.array_join(F.transform(F.split(text, "&#", -1), numbered), "")).otherwise(text)
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.when(text.contains("&"), out).otherwise(text)


def tokens(parts: DataFrame, key: list[str]) -> DataFrame:
    """key, no (from 0), kind (open, close, empty, text), name (local), text of each token of the column `xml`.

    Comments, instructions and declarations have a number but no row; a null text has none.
    """
    rows = parts.select(*key, F.posexplode(F.regexp_extract_all("xml", F.lit(_TOKEN), F.lit(0))).alias("no", "_t"))
    t = F.col("_t")
    data = t.startswith("<![CDATA[")
    kind = F.when(data | ~t.startswith("<"), "text").when(t.startswith("<!") | t.startswith("<?"), None).when(t.startswith("</"), "close").when(t.endswith("/>"), "empty").otherwise("open")
    name = F.when(kind != "text", F.regexp_extract(t, r"^</?(?:[^\s:/>]+:)?([^\s/>]+)", 1))
    text = F.when(data, F.substr(t, F.lit(10), F.length(t) - 12)).when(kind == "text", unescaped(t))
    return rows.select(*key, "no", kind.alias("kind"), name.alias("name"), text.alias("text")).where("kind IS NOT NULL")


def _count(when: Column) -> Column:
    return F.sum(when.cast("int"))


def well_formed(toks: DataFrame, key: list[str]) -> DataFrame:
    """key, ok: every element is closed by its own name, and there is one root with nothing but blanks beside it."""
    order = Window.partitionBy(*key).orderBy("no")
    opens, closes = F.col("kind") == "open", F.col("kind") == "close"
    rows = toks.withColumn("_depth", _count(opens).over(order) - _count(closes).over(order) + closes.cast("int"))
    same = Window.partitionBy(*key, "_depth").orderBy("no")
    rows = rows.withColumn("_before", F.when(opens | closes, F.last(F.when(opens, F.col("name")), ignorenulls=True).over(same)))
    outside = (F.col("_depth") == 0) & (F.col("kind") == "text") & F.col("text").rlike("\\S")
    bad = (closes & ((F.col("_depth") < 1) | (F.coalesce(F.col("_before"), F.lit("")) != F.col("name")))) | outside
    roots = (opens & (F.col("_depth") == 1)) | ((F.col("kind") == "empty") & (F.col("_depth") == 0))
    return rows.groupBy(*key).agg(((F.max(bad.cast("int")) == 0) & (_count(roots) == 1) & (_count(opens) == _count(closes))).alias("ok"))


def root(xml: Column) -> Column:
    """Local name and namespace (null for none) of the first element of a text; null without an element."""
    bare = F.regexp_replace(xml, r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>", "")
    form = rf"<([A-Za-z_][^\s/>]*+)({_TAG})>"
    return F.transform(F.array(F.struct(F.regexp_extract(bare, form, 1).alias("n"), F.regexp_extract(bare, form, 2).alias("a"))), _named)[0]


def _named(tag: Column) -> Column:
    form = F.lit(r"(?:^|\s)xmlns(?::([^\s=]+))?\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
    part = lambda k: F.regexp_extract_all(tag["a"], form, F.lit(k))
    spaces = F.arrays_zip(part(1).alias("p"), part(2).alias("u"), part(3).alias("v"))
    prefix = F.when(tag["n"].contains(":"), F.substring_index(tag["n"], ":", 1)).otherwise("")
    own = F.get(F.filter(spaces, lambda s: s["p"] == prefix), F.lit(0))
    return F.when(tag["n"] != "", F.struct(F.substring_index(tag["n"], ":", -1).alias("name"), F.nullif(F.concat(own["u"], own["v"]), F.lit("")).alias("namespace")))


def valid_root(xml: Column, name: str = ROOT, namespace: str = NAMESPACE) -> Column:
    """Whether a text's root has the local name, in a namespace that begins so."""
    return F.coalesce(F.transform(F.array(root(xml)), lambda r: (r["name"] == name) & r["namespace"].startswith(namespace))[0], F.lit(False))


#: Elements that stories() looks at.
SHOWN = ("p", "tbl", "tr", "tc", "t", "delText", "txbxContent", "tab", "br", "cr", *(n for n, _ in REVISIONS))
LABELS = ("", TEXT_BOX, *(label for _, label in REVISIONS))
_BLANKS = re.compile("[ \t\r\n]+")


def _entity(m: re.Match) -> str:
    code = int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])
    return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "\ufffd"


def _plain(token: str) -> str:
    """The characters of a text token: unescaped() for one that is a value of Python."""
    if token[0] == "<":
        return token[9:-3]
    if "&" not in token:
        return token
    out = _NUMBERED.sub(_entity, token)
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = out.replace(f"&{name};", sign)
    return out


_NUMBERED = re.compile(r"&#(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});")
#: The same tokens; texts and tags without quotes, which are most of them, are tried first.
_TOKENS = re.compile(rf"[^<]+|<[^\"'>!?]*+>|{_TOKEN}")
_NAME = re.compile(r"</?(?:[^\s:/>]+:)?([^\s/>]+)", re.ASCII)
#: Tags whose codes are remembered at once.
TAGS = 4096
#: Code of a token: 0 for text, OTHER for what stories() passes over, else 1 + 3 * place in SHOWN + place in KINDS.
KINDS, OTHER = ("open", "close", "empty"), -1


def _code(kind: str, name: str | None) -> int:
    return 0 if kind == "text" else 1 + 3 * SHOWN.index(name) + KINDS.index(kind)


class _Codes(dict):
    """Codes of tokens as they are written."""

    def __missing__(self, token: str) -> int:
        if token[0] != "<" or token.startswith("<![CDATA["):
            return 0
        name, code = _NAME.match(token), OTHER
        if not token.startswith(("<!", "<?")) and name and name[1] in SHOWN:
            code = _code("close" if token.startswith("</") else "empty" if token.endswith("/>") else "open", name[1])
        if len(self) >= TAGS:
            self.clear()
        self[token] = code
        return code


def _lines(codes: np.ndarray, tokens: list[str], sizes: list[int], plain=lambda text: text) -> tuple:
    """Columns (place of the text, unit, part, item, label, text) of the lines of several texts.

    codes and tokens of all texts one after the other, sizes: tokens of each text; plain(token): the characters of a text
    token. What is open and what was met in a unit are running counts over all tokens at once, less those before the text
    or the unit; pieces are then sorted by their place within a unit.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(codes != OTHER)
    codes, owner = codes[at], owner[at]
    before = np.searchsorted(owner, np.arange(len(sizes)))
    code = lambda kind, name: codes == _code(kind, name)
    met = lambda name: code("open", name) | code("empty", name)

    def inside(name: str) -> np.ndarray:
        total = np.append(0, np.cumsum(code("open", name).astype(np.int32) - code("close", name)))
        return total[1:] - total[before][owner]

    p, tbl = inside("p"), inside("tbl")
    begins = (code("open", "p") & (p == 1) & (tbl == 0)) | (code("open", "tbl") & (tbl == 1) & (p == 0))
    count = np.append(0, np.cumsum(begins))
    unit = count[1:] - count[before][owner]
    first = np.append(0, np.flatnonzero(begins))
    own = first[count[1:]]
    table = code("open", "tbl")[own] & (unit > 0)

    def seen(event: np.ndarray) -> np.ndarray:
        total = np.cumsum(event)
        return total - (total - event)[own]

    tr, tc = (seen(met(n) & table & (tbl == 1)) for n in ("tr", "tc"))
    text = (codes == 0) & (inside("t") + inside("delText") > 0)
    tab = met("tab")
    blank = met("br") | met("cr") | ((met("p") | met("tc")) & table & (tr > 0))
    piece = np.flatnonzero((text | tab | blank) & (unit > 0))
    # where pieces go: (token, part, item, cell)
    box, fields = inside("txbxContent"), table[piece]
    none = np.zeros(len(codes), np.int64)
    places = [(piece[fields], 0, tr, np.where(tr > 0, tc, 0)), (piece[~fields & (box[piece] == 0)], 0, none, none)]
    for part, name in enumerate(("txbxContent", *(n for n, _ in REVISIONS)), 1):
        opened = ~fields & (inside(name)[piece] > 0)
        if opened.any():
            places.append((piece[opened], part, seen(code("open", name)), none))
    key = [np.concatenate(x) for x in zip(*[(i, count[1:][i], np.full(len(i), part), item[i], cell[i]) for i, part, item, cell in places])]
    order = np.lexsort(key[:1] + key[:0:-1])
    token, group, part, item, cell = (k[order] for k in key)
    chars = [plain(tokens[k]) if c == 0 else "\t" if t else " " for k, c, t in zip(at[piece].tolist(), codes[piece].tolist(), tab[piece].tolist())]
    pieces = [chars[i] for i in np.searchsorted(piece, token).tolist()]
    new_line = np.append(True, (np.diff(group) != 0) | (np.diff(part) != 0) | (np.diff(item) != 0))[: len(token)]
    starts = np.flatnonzero(new_line | np.append(True, np.diff(cell) != 0)[: len(token)])
    cells = [_single("".join(pieces[i:j]) if j > i + 1 else pieces[i]).strip(" ") for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(pieces)])]
    lines = np.flatnonzero(new_line[starts])
    kept, texts, body, last = [], [], "", -1
    heads = starts[lines]
    for n, (i, j, g, k, it) in enumerate(zip(lines.tolist(), [*lines[1:].tolist(), len(cells)], group[heads].tolist(), part[heads].tolist(), item[heads].tolist())):
        line = cells[i] if j == i + 1 else "\t".join(cells[i:j])
        if g != last or (k == 0 and it == 0):
            body, last = line if k == 0 and it == 0 else "", g
        if line.strip("\t") if j > i + 1 else line:
            if k != 1 or line not in body:
                kept.append(n)
                texts.append(line)
    heads = heads[kept]
    at = token[heads]
    return owner[at], unit[at], part[heads], item[heads], [LABELS[k] for k in part[heads].tolist()], texts


def _single(text: str) -> str:
    return _BLANKS.sub(" ", text) if "  " in text or "\n" in text or "\t" in text or "\r" in text else text


LINES = "unit long, part int, item int, label string, text string"


def stories(toks: DataFrame, key: list[str]) -> DataFrame:
    """key, unit, part, item, label, text: the lines of word-processing XML, in the order of (unit, part, item).

    A unit is a paragraph or table that lies in no other. Of a paragraph: its text (part 0: texts and deleted texts, tabs,
    breaks as blanks, without its text boxes), the text boxes that this doesn't contain (1) and the texts of the four
    kinds of revisions (2 to 5), with labels. Of a table: a line for each row (part 0, item: row), cells joined by tabs, a
    nested table's within its cell. Blanks are made single; blank lines are left out. One shuffle brings the tokens of a
    text together; they must fit a task.
    """
    shown = toks.where((F.col("kind") == "text") | F.col("name").isin(*SHOWN)).select(*key, "no", "kind", "name", "text")


    def run(toks: list[list]) -> Iterator[tuple]:
        numbers, kinds, names, texts = toks
        order = sorted(range(len(numbers)), key=numbers.__getitem__)
        codes = np.array([_code(kinds[i], names[i]) for i in order], np.int16)
        _, *columns = _lines(codes, [texts[i] for i in order], [len(order)])
        return zip(*[x.tolist() if isinstance(x, np.ndarray) else x for x in columns])

    return map_columns(shown, key, run, LINES)


def text_stories(parts: DataFrame, key: list[str]) -> DataFrame:
    """The lines of stories() for each row of parts (key, xml): a text is read within its row.

    No token becomes a row and nothing is shuffled; rows of one key are texts apart.
    """
    codes = _Codes()

    def run(texts: Iterator[str | None]) -> Iterator[tuple]:
        tokens, sizes = [], []

        def told():
            return _lines(np.fromiter(map(codes.__getitem__, tokens), np.int16, len(tokens)), tokens, sizes, _plain)

        for text in texts:
            found = _TOKENS.findall(text or "")
            tokens += found
            sizes.append(len(found))
            if len(tokens) >= SLICE:
                yield len(sizes), told()
                tokens, sizes = [], []
        yield len(sizes), told()

    return map_values(parts.select(*key, "xml"), key, run, LINES)
