"""Text expressions: Column builders that stay inside whole-stage code generation where they can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
PLAIN_FROM = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0\u200b"
PLAIN_TO = "''\"\"-- "
KEEP_HYPHEN = [
    "one-time", "full-time", "part-time", "multi-factor", "long-term",
    "short-term", "e-mail", "on-site", "self-service", "day-to-day",
    "end-to-end", "read-only", "real-time", "third-party", "co-operate",
]
TERM_STOPWORDS = (
    "a an and are as at be been but by can for from had has have if in into is it its "
    "may must no not of on or s shall should such than that the their then there these this "
    "to was were when which who will with within would you your"
).split()
CONTENT_STOPWORDS = (
    "a an and are as at be by can do does for from how i if in is it its many may much "
    "must my not of on or shall should that the their there this to was what when where which "
    "who why will with you your"
).split()
SUFFIXES = ["ements", "ement", "ings", "ing", "ies", "ers", "er", "ed", "s"]
KEEP_FINAL_S = ["ss", "us", "is", "as", "ys"]
TERM = r"[a-z0-9]+(?:[.,][0-9]+)*"
CONTENT = r"[a-z0-9]+"
CHARS_PER_TOKEN = 4


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normalise(c: Column | str) -> Column:
    """Ligatures spelled out; curly quotes, dashes and no-break spaces made plain; zero-width spaces dropped."""
    out = F.translate(col(c), PLAIN_FROM, PLAIN_TO)
    for k, v in LIGATURES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def digit_blind(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\d+", "#")


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[ \t]{2,}", " ")


def estimate_tokens(c: Column | str) -> Column:
    return (F.floor(F.length(col(c)) / CHARS_PER_TOKEN) + 1).cast("long")


def dehyphenate(c: Column | str) -> Column:
    """Joins words split by a hyphen at a line end; words of the keep list keep the hyphen and lose the break.

    One pass for each kind over the original breaks: a word between two breaks belongs to the first.
    """
    kept = "|".join("-\n".join(w.split("-")) for w in KEEP_HYPHEN if w.count("-") == 1)
    marked = F.regexp_replace(col(c), rf"(?Ui)(?<!\w)({kept})(?!\w)", "\u0001$1")
    marked = F.regexp_replace(marked, r"(?U)\u0001(\w+)-\n(\w+)", "$1\u0002$2")
    joined = F.regexp_replace(marked, r"(?U)([\w]+)-\n(\w+)", "$1$2")
    return F.replace(joined, F.lit("\u0002"), F.lit("-"))


def hyphen_decisions(c: Column | str) -> Column:
    """array<struct<action, detail>> of the joins that dehyphenate makes."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?U)(\w+-\n\w+)"), F.lit(1))

    def tell(m: Column) -> Column:
        pair = F.replace(m, F.lit("-\n"), F.lit("-"))
        kept = F.lower(pair).isin(KEEP_HYPHEN)
        return F.struct(F.when(kept, F.lit("kept hyphen")).otherwise(F.lit("joined")).alias("action"), F.when(kept, pair).otherwise(F.concat(pair, F.lit(" -> "), F.replace(m, F.lit("-\n"), F.lit("")))).alias("detail"))

    return F.transform(found, tell)


def raw_terms(c: Column | str) -> Column:
    """Terms before stemming: lower-cased, without stop words and single characters."""
    return F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit(TERM), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(TERM_STOPWORDS))


def stem(c: Column | str) -> Column:
    """One suffix less, the first of the list that leaves four letters; numbers stay."""
    w, out = col(c), None
    for s in SUFFIXES:
        fits = w.endswith(s) & (F.length(w) - len(s) >= 4)
        if s == "s":
            for keep in KEEP_FINAL_S:
                fits = fits & ~w.endswith(keep)
        base = F.substring(w, F.lit(1), F.length(w) - len(s))
        value = F.concat(base, F.lit("y")) if s == "ies" else base
        out = F.when(w.rlike("^[0-9]"), w).when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(w)


def content_words(c: Column | str) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit(CONTENT), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(CONTENT_STOPWORDS))


def sentences(c: Column | str) -> Column:
    """Cut after . ! ? and white space; parts of two characters or fewer are dropped."""
    return F.filter(F.transform(F.split(squeeze(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 2)


def overlap_score(question: Column | str, text: Column | str) -> Column:
    """Share of the question's content words that the text has."""
    q, t = F.array_distinct(content_words(question)), F.array_distinct(content_words(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def summarise(text: Column | str, title: Column | str, max_words: int = 45) -> Column:
    """The first sentence, and up to eight content words that only later ones have."""
    body = sentences(text)
    first = F.get(body, F.lit(0))
    words = F.split(first, " ")
    opening = F.when(F.size(words) > max_words, F.concat(F.array_join(F.slice(words, 1, max_words), " "), F.lit("..."))).otherwise(first)
    later = F.flatten(F.transform(F.slice(body, F.lit(2), F.greatest(F.size(body), F.lit(1))), lambda s: content_words(s)))
    extra = F.slice(F.array_except(F.array_distinct(later), content_words(opening)), 1, 8)
    tail = F.when(F.size(extra) > 0, F.concat(opening, F.lit(" Also covers: "), F.array_join(extra, ", "), F.lit("."))).otherwise(opening)
    return F.when(F.size(body) > 0, tail).otherwise(F.when(F.length(col(title)) > 0, col(title)).otherwise(F.lit("(empty section)")))
