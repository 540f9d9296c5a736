"""Heading schemes as Column builders: struct<number, title, level> where a line is a heading, else null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

# Fixed values.
TOC_TAIL = r"(?i)(?:\.\s*){3,}(?:p\.?\s*)?\d+\s*$"
DOT_LEADER = r"(?:\.\s*){3,}"
MAX_LENGTH = 95
DOTTED_ALPHA = r"^([A-Z]\.\d+(?:\.\d+)*)\s+(\S.*?)\s*$"
DECIMAL = r"^(\d{1,2}(?:\.\d{1,2})*)\.?\s+(\S.*?)\s*$"
CHAPTER = r"^((?:CHAPTER|Chapter|PART|Part|SECTION|Section|ARTICLE|Article|ANNEX|Annex)\s+(?:\d+|[IVXLC]+|[A-Z]))\s*[:.\u2013-]?\s*(.*?)\s*$"
MARKDOWN = r"^(#{1,6})\s+(\S.*?)\s*$"
GLYPH_JUNK = r"[\s\u200b\ufffd\ue000-\uf8ff]+$"


def plausible(line: Column) -> Column:
    s = strip(line)
    return (F.length(s) > 0) & (F.length(s) <= MAX_LENGTH) & ~s.rlike(TOC_TAIL)


def _heading(number: Column, title: Column, level: Column) -> Column:
    return F.struct(number.cast("string").alias("number"), title.alias("title"), level.cast("int").alias("level"))


def dotted_alpha(line: Column | str) -> Column:
    s = strip(line)
    number = F.regexp_extract(s, DOTTED_ALPHA, 1)
    return F.when(plausible(s) & s.rlike(DOTTED_ALPHA), _heading(number, F.regexp_extract(s, DOTTED_ALPHA, 2), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))))


def decimal(line: Column | str) -> Column:
    s = strip(line)
    number, title = F.regexp_extract(s, DECIMAL, 1), F.regexp_extract(s, DECIMAL, 2)
    parts = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
    core = F.regexp_replace(title, GLYPH_JUNK, "")
    small = (parts > 1) | (F.coalesce(F.regexp_extract(s, r"^(\d{1,2})", 1).try_cast("int"), F.lit(0)) <= 40)
    ok = plausible(s) & s.rlike(DECIMAL) & small & ~title.rlike(r"^\p{IsLowercase}") & ~core.rlike(r"[.!?,;:]$") & ~core.rlike(r"[.!?]\s")
    return F.when(ok, _heading(number, title, parts))


def chapter(line: Column | str) -> Column:
    s = strip(line)
    number, title = F.regexp_extract(s, CHAPTER, 1), F.regexp_extract(s, CHAPTER, 2)
    return F.when(plausible(s) & s.rlike(CHAPTER), _heading(number, F.when(title != "", title).otherwise(number), F.lit(1)))


def markdown(line: Column | str) -> Column:
    s = strip(line)
    return F.when(s.rlike(MARKDOWN), _heading(F.lit(None), F.regexp_extract(s, MARKDOWN, 2), F.length(F.regexp_extract(s, MARKDOWN, 1))))


def allcaps(line: Column | str) -> Column:
    s = strip(line)
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    ok = plausible(s) & F.length(s).between(3, 60) & (F.length(letters) >= 3) & letters.rlike(r"^\p{IsUppercase}+$") & ~s.rlike(r"[.,;:]$") & ~s.contains("_")
    return F.when(ok, _heading(F.lit(None), s, F.lit(1)))


#: In the order that breaks ties between schemes.
SCHEMES: dict[str, Callable[[Column | str], Column]] = {"dotted_alpha": dotted_alpha, "decimal": decimal, "chapter": chapter, "markdown": markdown, "allcaps": allcaps}
DESCRIPTIONS = {
    "dotted_alpha": "a capital and dotted numbers, A.1.2",
    "decimal": "dotted numbers, 1.2.3",
    "chapter": "chapter, part, section, article or annex with a number",
    "markdown": "number signs",
    "allcaps": "short lines in capitals",
}


def matcher(scheme: Column | str) -> Callable[[Column | str], Column]:
    """A matcher for a column that names the scheme of each row; null never matches."""
    which = col(scheme)

    def match(line: Column | str) -> Column:
        out = None
        for name, f in SCHEMES.items():
            out = F.when(which == name, f(line)) if out is None else out.when(which == name, f(line))
        return out

    return match


def is_toc(text: Column | str) -> Column:
    """At least four lines that aren't blank, most of them with a dot leader."""
    lines = F.filter(F.split(col(text), "\n"), lambda x: F.length(strip(x)) > 0)
    leaders = F.size(F.filter(lines, lambda x: x.rlike(DOT_LEADER)))
    return (F.size(lines) >= 4) & (leaders > 0.5 * F.size(lines))
