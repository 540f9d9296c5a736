"""Cleaning of paged documents: furniture, hyphens, paragraphs, page merge. Pages are rows (doc_id, page, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T

LINES_PER_PAGE = 45


def paginate(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, page (from 1), text: every `lines_per_page` lines are a page."""
    plain = F.regexp_replace("text", "\r\n?", "\n")
    lines = F.split(plain, "\n")
    pages = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / lines_per_page).cast("int"))
    return docs.select("doc_id", lines.alias("lines"), F.explode(pages).alias("i")).select(
        "doc_id", (F.col("i") + 1).alias("page"), F.array_join(F.slice("lines", F.col("i") * lines_per_page + 1, F.lit(lines_per_page)), "\n").alias("text")
    )


def load_stats(pages: DataFrame) -> DataFrame:
    empty = F.length(T.strip("text")) == 0
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.sum(F.length("text").cast("long")).alias("raw_chars"), F.array_sort(F.collect_list(F.when(empty, F.col("page")))).alias("empty_pages")
    )


def detect_furniture(pages: DataFrame, min_pages: int = 3, min_ratio: float = 0.5, edge_lines: int = 1) -> DataFrame:
    """(doc_id, key): digit-blind first or last lines that recur on enough pages of a document."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: T.strip(x)), lambda x: F.length(x) > 0)
    edges = pages.select("doc_id", lines.alias("l")).select("doc_id", F.explode(F.array_distinct(F.concat(F.slice("l", 1, edge_lines), F.slice(F.reverse("l"), 1, edge_lines)))).alias("line"))
    seen = edges.groupBy("doc_id", T.digit_blind("line").alias("key")).agg(F.count("*").alias("n"))
    return seen.join(n, "doc_id").where(F.col("n") >= F.greatest(F.lit(min_pages), F.ceil(F.lit(min_ratio) * F.col("n_pages")))).select("doc_id", "key")


def with_furniture(pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """pages with an array column `furniture`: a document's keys, few by their definition."""
    keys = furniture.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("furniture"))
    return pages.join(keys, "doc_id", "left").withColumn("furniture", F.coalesce("furniture", F.array().cast("array<string>")))


def strip_furniture(text: Column | str, furniture: Column | str) -> Column:
    keys = T.col(furniture)
    return F.array_join(F.filter(F.split(T.col(text), "\n"), lambda x: ~F.array_contains(keys, T.digit_blind(x))), "\n")


def unwrap(text: Column | str, match: Callable[[Column], Column] = H.dotted_alpha) -> Column:
    """Lines of a paragraph joined by spaces; headings and paragraphs stand alone, with an empty line between.

    Every line gets a mark before it: a line break pair where a block begins, else a space; a block
    begins after a blank line, at a heading and after one.
    """
    lines = F.transform(F.split(T.col(text), "\n"), lambda x: F.struct(T.strip(x).alias("s"), (match(x).isNotNull() & (F.length(T.strip(x)) > 0)).alias("h")))
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("fresh"))

    def step(a: Column, x: Column) -> Column:
        blank = F.length(x["s"]) == 0
        mark = F.when(F.length(a["out"]) == 0, F.lit("")).when(a["fresh"] | x["h"], F.lit("\n\n")).otherwise(F.lit(" "))
        return F.when(blank, F.struct(a["out"].alias("out"), F.lit(True).alias("fresh"))).otherwise(F.struct(F.concat(a["out"], mark, x["s"]).alias("out"), x["h"].alias("fresh")))

    return F.aggregate(lines, start, step, lambda a: a["out"])


def clean_page(text: Column | str, furniture: Column | str, match: Callable[[Column], Column] = H.dotted_alpha) -> Column:
    return T.strip(T.collapse_spaces(unwrap(T.dehyphenate(strip_furniture(text, furniture)), match)))


def continues(previous: Column, following: Column) -> Column:
    """Whether a sentence runs on from one text into the next."""
    open_end = ~F.regexp_replace(previous, r"(?U)\s+$", "").rlike(r"[.!?:;]$")
    lower = F.regexp_replace(following, r"(?U)^\s+", "").rlike(r"^\p{IsLowercase}")
    return F.coalesce((F.length(previous) > 0) & (F.length(following) > 0) & open_end & lower, F.lit(False))


def profile(pages: DataFrame) -> DataFrame:
    """doc_id, scheme: the heading scheme of all lines left without furniture; pages has `furniture` and normalised text."""
    lines = pages.select("doc_id", F.explode(F.split(strip_furniture("text", "furniture"), "\n")).alias("line"))
    return detect_scheme(score_schemes(lines))


def score_schemes(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line) -> doc_id, scheme, ord, hits, levels, score for each scheme."""
    aggs = []
    for name, f in H.SCHEMES.items():
        level = f("line")["level"]
        aggs += [F.count(level).alias(f"{name}_hits"), F.count_distinct(level).alias(f"{name}_levels")]
    wide = lines.groupBy("doc_id").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("scheme"), F.lit(i).alias("ord"), F.col(f"{n}_hits").alias("hits"), F.col(f"{n}_levels").alias("levels")) for i, n in enumerate(H.SCHEMES)])
    return wide.select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.*").withColumn("score", F.col("hits") * F.greatest("levels", F.lit(1)))


def detect_scheme(scores: DataFrame) -> DataFrame:
    """The scheme of greatest score, if that one has three hits; else null."""
    top = scores.groupBy("doc_id").agg(F.max_by(F.struct("scheme", "hits"), F.struct("score", -F.col("ord"))).alias("t"))
    return top.select("doc_id", F.when(F.col("t.hits") >= 3, F.col("t.scheme")).alias("scheme"))


def prepared(pages: DataFrame) -> DataFrame:
    """pages with normalised text, `furniture`, `scheme`, `toc` and `clean`."""
    plain = pages.select("doc_id", "page", T.normalise("text").alias("text"))
    marked = with_furniture(plain, detect_furniture(plain))
    known = marked.join(profile(marked), "doc_id", "left")
    return known.withColumn("toc", H.is_toc("text")).withColumn("clean", clean_page("text", "furniture", H.matcher("scheme")))


def parse_per_page(pages: DataFrame, drop_toc: bool = True) -> DataFrame:
    p = prepared(pages)
    keep = F.length("clean") > 0
    return p.where(keep & ~F.col("toc") if drop_toc else keep).select("doc_id", "page", F.col("clean").alias("text"))


def merged_spans(pages: DataFrame, drop_toc: bool = True) -> DataFrame:
    """doc_id, page, joiner, text, char_start, char_end, joined, dropped: where each page lies in the merged text.

    A page that is dropped or empty has an empty span at the length so far. The text before a page
    ends as the last page with text ends, so one look back is enough.
    """
    p = prepared(pages)
    dropped = F.col("toc") if drop_toc else F.lit(False)
    p = p.withColumn("dropped", dropped).withColumn("body", F.when(dropped, F.lit("")).otherwise(F.col("clean")))
    by = Window.partitionBy("doc_id").orderBy("page")
    before = F.last(F.when(F.length("body") > 0, F.col("body")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("before", before).withColumn("joined", continues(F.col("before"), F.col("body")))
    joiner = F.when((F.length("body") == 0) | F.col("before").isNull(), F.lit("")).when(F.col("joined"), F.lit(" ")).otherwise(F.lit("\n\n"))
    p = p.withColumn("joiner", joiner)
    end = F.sum(F.length("joiner") + F.length("body")).over(by)
    return p.withColumn("char_end", end.cast("int")).select("doc_id", "page", "scheme", "furniture", "joiner", F.col("body").alias("text"), (F.col("char_end") - F.length("body")).alias("char_start"), "char_end", "joined", "dropped")


def merge(spans: DataFrame) -> DataFrame:
    """One row per document: text, n_pages, scheme, n_chars, furniture, dropped_pages, page_joins."""
    parts = F.array_sort(F.collect_list(F.struct("page", F.concat("joiner", "text").alias("x"))))
    pages = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page"))))
    out = spans.groupBy("doc_id").agg(
        F.array_join(F.transform(parts, lambda x: x["x"]), "").alias("text"), F.count("*").alias("n_pages"), F.first("scheme").alias("scheme"), F.first("furniture").alias("furniture"),
        pages(F.col("dropped")).alias("dropped_pages"), pages(F.col("joined")).alias("page_joins"),
    )
    return out.withColumn("text", T.collapse_spaces("text")).withColumn("n_chars", F.length("text"))
