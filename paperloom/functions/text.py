"""String functions: white space, names, messages, CSV cells, fonts and scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space (fixed values), for Java and RE2 expressions.
SPACE = "\\t-\\r\\x1c-\\x20\\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200a}\\x{2028}\\x{2029}\\x{205f}\\x{3000}"
ILLEGAL = "[\\\\/:*?\"<>|\\x00-\\x1f\\x7f]"
MAX_NAME, MAX_SHEET, MAX_MESSAGE, MAX_ARGUMENT = 180, 64, 1000, 500


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_trailing(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+$", "")


def blank(text: Column) -> Column:
    """Null, empty or all white space."""
    return F.coalesce(~text.rlike(f"[^{SPACE}]"), F.lit(True))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def nonblank_chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(without_space(F.coalesce(text, F.lit(""))))


def newlines(text: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def one_line(text: Column) -> Column:
    """Line ends become spaces, spaces and tabs collapse, both ends are stripped; null is empty."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\r\n]", " "), "[ \t]+", " "))


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash; blank gives empty."""
    return F.when(blank(path), "").otherwise(F.regexp_replace(path, "(?s)^.*[/\\\\]", ""))


def safe_name(path: Column, fallback: Column) -> Column:
    """The base name with illegal characters as underscores; the fallback if it is blank, a dot name or too long."""
    name = strip(F.regexp_replace(base_name(path), ILLEGAL, "_"))
    return F.when(blank(name) | name.isin(".", "..") | (F.length(name) > MAX_NAME), fallback).otherwise(name)


def entry_name(proposed: Column) -> Column:
    """Of an archive's entry: as a safe name of any length, `result` if there is none."""
    name = strip(F.regexp_replace(base_name(proposed), ILLEGAL, "_"))
    return F.when(blank(name) | name.isin(".", ".."), "result").otherwise(name)


def display_name(path: Column, index: Column, extension: Column) -> Column:
    """Of an upload; `document-N.ext` if its own name can't be used. index counts from 0."""
    return safe_name(path, F.concat(F.lit("document-"), (index + 1).cast("string"), F.lit("."), extension))


def output_name(proposed: Column, input_name: Column, extension: Column) -> Column:
    """Of a result; the input's base name with the new extension if the proposed one can't be used."""
    stem = F.regexp_replace(base_name(input_name), "(?s)(?<=.)\\.[^.]*$", "")
    stem = F.when(blank(stem), "result").otherwise(stem)
    return safe_name(proposed, F.concat(stem, F.lit("."), extension))


def sheet_name(name: Column) -> Column:
    """Of a sheet's file: illegal characters as underscores, `sheet` if empty, 64 characters at most."""
    safe = strip(F.regexp_replace(F.coalesce(name, F.lit("sheet")), ILLEGAL, "_"))
    return F.substring(F.when(safe == "", "sheet").otherwise(safe), 1, MAX_SHEET)


def swap_extension(name: Column, old: str, new: str) -> Column:
    """The new ending in place of the old extension, whatever its case; appended if the name has another."""
    return F.concat(F.regexp_replace(name, f"(?i)\\.{old}$", ""), F.lit(new))


def clean_message(message: Column) -> Column:
    """A message without file paths and control characters, of bounded length."""
    m = F.coalesce(message, F.lit(""))
    m = F.regexp_replace(m, "(?i)(?<![A-Za-z0-9_.-])[A-Z]:[\\\\/][^\\s\"'<>]+", "<path>")
    m = F.regexp_replace(m, "(?<![A-Za-z0-9_.-])(?:file:)?/{1,3}[^\\s\"'<>]+", "<path>")
    m = F.trim(F.regexp_replace(F.regexp_replace(m, "[\\x00-\\x1f\\x7f]+", " "), "\\s+", " "))
    return F.when(F.length(m) > MAX_MESSAGE, F.concat(F.substring(m, 1, MAX_MESSAGE), F.lit("..."))).otherwise(m)


def redact(output: Column, arguments: list[str]) -> Column:
    """A process's output without its arguments (of 4 characters or more), on one line, of bounded length."""
    out = F.coalesce(output, F.lit(""))
    for a in sorted({a for a in arguments if len(a) >= 4}, key=lambda a: (-len(a), a)):
        out = F.replace(out, F.lit(a), F.lit("<argument>"))
    return F.substring(F.trim(F.regexp_replace(out, "\\s+", " ")), 1, MAX_ARGUMENT)


def csv_cell(value: Column, delimiter: str = ",") -> Column:
    """Quoted if it holds the delimiter, a quote or a line end; quotes doubled; null is empty."""
    v = F.coalesce(value, F.lit(""))
    needs = v.contains(delimiter) | v.contains('"') | v.contains("\n") | v.contains("\r")
    return F.when(needs, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(cells: Column, delimiter: str = ",") -> Column:
    """One line of an array of cells, without the line end."""
    return F.array_join(F.transform(cells, lambda c: csv_cell(c, delimiter)), delimiter)


def language_tags(languages: Column) -> Column:
    """Distinct well-formed tags in first-seen order, joined by +; null if one is malformed or none is left."""
    tags = F.array_distinct(F.filter(F.transform(F.split(languages, "[+,]"), strip), lambda t: t != ""))
    good = F.forall(tags, lambda t: t.rlike("^[A-Za-z0-9_]+$"))
    return F.when(good & (F.size(tags) > 0), F.array_join(tags, "+"))


def segmentation_mode(languages: Column) -> Column:
    """5 if any language is vertical (ends in _vert), else 3."""
    return F.when(F.exists(F.split(languages, "\\+"), lambda t: t.endswith("_vert")), 5).otherwise(3)


def pdf_text(text: Column) -> Column:
    """Tabs as spaces, other control characters dropped."""
    return F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), "[\\x00-\\x1f\\x7f-\\x{9f}]", "")


def font_family(name: Column) -> Column:
    """Without a subset prefix, commas as spaces; SimSun if blank."""
    plain = strip(F.replace(F.regexp_replace(F.coalesce(name, F.lit("")), "^[A-Z]{6}\\+", ""), F.lit(","), F.lit(" ")))
    return F.when(plain == "", "SimSun").otherwise(plain)


def bold(name: Column, weight: Column) -> Column:
    return F.lower(name).rlike("bold|black|heavy") | (weight >= 600)


def italic(name: Column, angle: Column) -> Column:
    return F.lower(name).rlike("italic|oblique") | (F.abs(angle) > 0.1)


def east_asian(text: Column) -> Column:
    """Whether any Han, Hiragana, Katakana, Hangul or Bopomofo occurs, so that a font is to be embedded."""
    return F.coalesce(text.rlike("[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}\\p{IsBopomofo}]"), F.lit(False))


def disallowed_controls(text: Column) -> Column:
    """Control characters other than tab, LF, FF and CR."""
    return F.length(text) - F.length(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f-\\x{9f}]", ""))


def binary_content(text: Column) -> Column:
    """Whether text is to be refused: a NUL, or over 4 disallowed controls that are over 1 % of the code points."""
    n = disallowed_controls(text)
    return F.coalesce(text.contains("\0") | ((n > 4) & (n * 100 > F.greatest(F.lit(1), F.length(text)))), F.lit(False))
