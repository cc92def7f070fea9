"""Scalar helpers, Column to Column, with the semantics that line rules expect: Unicode white space, code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that a strip removes at the ends of a line.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"[\x{4e00}-\x{9fff}]"
#: Numerals of chapter headings, and the headings themselves.
NUMERAL = "0-9一二三四五六七八九十百千万"
CHAPTER = rf"(?i)^(第[{NUMERAL}]+[章节篇回]|Chapter[{SPACE}]+[0-9]+|Part[{SPACE}]+[0-9]+)"
#: Characters that no title ends with.
TITLE_END = '。，！？；："（）'


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    t = col(c)
    ends = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))  # most lines have nothing to strip, and this is cheap
    return F.when(ends.rlike(f"[{SPACE}]"), F.regexp_replace(t, rf"^[{SPACE}]+|[{SPACE}]+$", "")).otherwise(t)


def cjk_count(c: str | Column) -> Column:
    return F.regexp_count(col(c), F.lit(CJK)).cast("long")


def latin_words(c: str | Column) -> Column:
    return F.regexp_count(col(c), F.lit("[a-zA-Z]+")).cast("long")


def mixed_word_count(c: str | Column) -> Column:
    """CJK characters and runs of Latin letters."""
    return cjk_count(c) + latin_words(c)


def display_count(c: str | Column) -> Column:
    """CJK characters and tokens between white space."""
    return cjk_count(c) + F.regexp_count(col(c), F.lit(rf"[^{SPACE}]+"))


def remove_first(text: str | Column, part: str | Column) -> Column:
    """The text without the first occurrence of part."""
    t, p = col(text), col(part)
    at = F.position(p, t)
    return F.when((at > 0) & (F.length(p) > 0), F.concat(F.substr(t, F.lit(1), at - 1), F.substr(t, at + F.length(p)))).otherwise(t)


def count_of(text: str | Column, part: str) -> Column:
    """Occurrences of a string that don't overlap."""
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("long")


def safe_filename(name: str | Column, limit: int = 80) -> Column:
    """Each line end becomes a blank, reserved characters underscores, control characters go; blanks and dots are taken off
    both ends; at most limit characters; 'untitled' if nothing is left."""
    out = F.regexp_replace(col(name), r"[\r\n]", " ")
    out = F.regexp_replace(out, r'[<>:"/\\|?*]', "_")
    out = F.regexp_replace(out, r"[\x{0}-\x{1f}\x{7f}-\x{9f}]", "")
    out = F.substr(F.btrim(out, F.lit(". ")), F.lit(1), F.lit(limit))
    return F.when(F.length(out) == 0, F.lit("untitled")).otherwise(out)


def title_ok(title: str | Column, stop: str) -> Column:
    """3 to 100 characters, no closing punctuation, none of the stop words."""
    t = col(title)
    return F.length(t).between(3, 100) & ~F.lit(TITLE_END).contains(F.right(t, F.lit(1))) & ~F.lower(t).rlike(stop)


def mojibake_ratio(text: str | Column) -> Column:
    """Characters between U+0080 and U+024F for each letter (0 without letters)."""
    t = col(text)
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    odd = F.length(F.regexp_replace(t, r"[^\x{80}-\x{24f}]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(odd / letters)
