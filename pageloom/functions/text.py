"""Text helpers whose white space is Unicode's, as in Python."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space for Java's and RE2's character classes.
WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A page number, or a bare state mark, alone on its line. Fixed values.
PAGE_NUMBER = (
    r"^\s*-?\s*\d{1,4}\s*-?\s*$",
    r"(?i)^\s*page\s*\d+\s*$",
    r"(?i)^\s*page\s*\d+\s*of\s*\d+\s*$",
    r"^\s*\d+\s*/\s*\d+\s*$",
    r"^\s*제?\s*\d+\s*쪽\s*$",
)
STATUS = r"(?i)^\s*상태\s*OK\s*$"
CID = r"\(cid:\s*\d+\s*\)"


#: The same characters as a string.
WS_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Looks at the ends only, unlike a regular expression."""
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def length(c: Column) -> Column:
    return F.length(c).cast("long")


def has(c: Column, marks: Iterable[str]) -> Column:
    """Whether a text holds one of some literal strings: a search of bytes, with which the patterns that need one are kept from the other texts."""
    out = F.lit(False)
    for m in marks:
        out = out | c.contains(m)
    return out


def first_in(c: Column, chars: str) -> Column:
    """Whether a text's first character is in a class, given without brackets."""
    return F.substring(c, 1, 1).rlike(f"[{chars}]")


def last_in(c: Column, chars: str) -> Column:
    """Whether a text's last character is in a class, given without brackets."""
    return F.substring(c, -1, 1).rlike(f"[{chars}]")


def matches(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def normalized(c: Column) -> Column:
    """For comparing lines of pages: one space for white space, no page number at either end, empty if only digits."""
    one = strip(F.regexp_replace(c, f"[{WS}]+", " "))
    bare = lambda t: strip(F.regexp_replace(F.regexp_replace(t, r"\s+\d{1,4}\s*$", ""), r"^\s*\d{1,4}\s+", ""))
    numbered = lambda t: F.when(first_in(t, "0-9") | last_in(t, "0-9"), F.when(t.rlike(r"^\d+$"), "").otherwise(bare(t))).otherwise(t)
    return F.transform(F.array(one), numbered)[0]  # so that the first step is done once


def is_page_number(c: Column) -> Column:
    t = strip(c)
    return F.when(last_in(t, "0-9쪽Kk-"), matches(t, PAGE_NUMBER) | t.rlike(STATUS)).when(c.isNotNull(), False)


def clean_cell(c: Column) -> Column:
    """A table cell without glyph references, state marks, leader dots and doubled white space."""
    t = strip(F.regexp_replace(c, CID, ""))
    t2 = F.regexp_replace(F.regexp_replace(t, rf"[{WS}]*\n[{WS}]*", " "), rf"[{WS}]{{2,}}", " ")
    return F.when(t.rlike(STATUS), "").otherwise(strip(F.regexp_replace(t2, "·{3,}", "")))


def bullets(c: Column) -> Column:
    """Unicode bullets as Markdown lists, inline ones on lines of their own."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?<=\S)[ \t]*([●•])", "\n$1"), r"(?<=\S)[ \t]*([○◦])", "\n$1")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)^[●•][\x{200b}\s]*", "- "), r"(?m)^[○◦][\x{200b}\s]*", "  - ")
    return F.when(has(c, "●•○◦"), t).otherwise(c)


CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
MISREAD = (("웰", "월"), ("임", "입"))


def ocr_corrected(c: Column) -> Column:
    """Misread syllables, broken circled numbers at line starts, and closing brackets missing at the end."""
    for wrong, right in MISREAD:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    # "(n) " at a line start; numbers outside 1 to 20 stay as they are, after a line end
    for n, mark in enumerate(CIRCLED, 1):
        c = F.regexp_replace(c, rf"(?:^|\n)[{WS}]*\(0?{n}\)[{WS}]" if n < 10 else rf"(?:^|\n)[{WS}]*\({n}\)[{WS}]", f"\n{mark} ")
    c = F.regexp_replace(c, rf"(?:^|\n)([{WS}]*\((?:2[1-9]|[3-9]\d|00?)\)[{WS}])", "\n$1 ")
    for a, b in (("(", ")"), ("「", "」"), ("【", "】")):
        count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
        c = F.concat(c, F.repeat(F.lit(b), F.greatest(count(a) - count(b), F.lit(0))))
    return c


def tokens(c: Column) -> Column:
    """The rough number of tokens of a text: two characters each, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 2).cast("int"))
