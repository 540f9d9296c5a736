"""Outlines: headings of a text, their spans, and the tree as an adjacency table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings as H


def find_headings(docs: DataFrame, match: Callable[[Column], Column] = H.markdown) -> DataFrame:
    """docs(doc_id, text) -> doc_id, heading_idx, number, title, level, char_start, n_chars (of the text)."""
    lines = docs.select("doc_id", F.length("text").alias("n_chars"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    by = Window.partitionBy("doc_id").orderBy("line_no")
    at = (F.sum(F.length("line") + 1).over(by) - F.length("line") - 1).cast("int")
    found = lines.withColumn("char_start", at).withColumn("h", match(F.col("line"))).where("h is not null")
    return found.select("doc_id", (F.row_number().over(by) - 1).alias("heading_idx"), "h.number", "h.title", "h.level", "char_start", "n_chars")


def assign_spans(headings: DataFrame, max_level: int = 12) -> DataFrame:
    """Adds char_end: where the next heading of the same or a higher rank begins; and parent_idx: the heading above, or null.

    By windows, one for each level that occurs in the scheme (dotted numbers in a heading line give
    at most `max_level`), instead of a self-join.
    """
    w = Window.partitionBy("doc_id").orderBy("heading_idx")
    after, before = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    end = parent = None
    for level in range(1, max_level + 1):
        e = F.min(F.when(F.col("level") <= level, F.col("char_start"))).over(after)
        p = F.last(F.when(F.col("level") < level, F.col("heading_idx")), ignorenulls=True).over(before)
        here = F.col("level") == level
        end = F.when(here, e) if end is None else end.when(here, e)
        parent = F.when(here, p) if parent is None else parent.when(here, p)
    return headings.withColumn("char_end", F.coalesce(end, "n_chars")).withColumn("parent_idx", parent)


def build_tree(headings: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes (doc_id, node_id, parent_id, title, number, level, is_leaf, char_start, char_end); a root for each of docs(doc_id, source, text)."""
    spans = assign_spans(headings)
    name = lambda c: F.when(c.isNotNull(), F.format_string("%04d", (c + 1).cast("long")))
    inner = spans.select(
        "doc_id", name(F.col("heading_idx")).alias("node_id"), F.coalesce(name(F.col("parent_idx")), F.lit("0000")).alias("parent_id"),
        F.concat_ws(" ", "number", "title").alias("title"), "number", "level", "char_start", "char_end",
    )
    root = docs.select("doc_id", F.lit("0000").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("number"), F.lit(0).alias("level"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"))
    nodes = root.unionByName(inner)
    # ids are in document order, so a node has children if and only if the next one lies below it
    nxt = F.lead("level").over(Window.partitionBy("doc_id").orderBy(F.col("node_id").cast("long")))
    return nodes.withColumn("is_leaf", F.coalesce(nxt <= F.col("level"), F.lit(True)))


def with_pages(spans: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """spans(doc_id, char_start, char_end, ...) with start_page, end_page: the pages whose text they overlap, or null; keys name a span."""
    p = pages.select("doc_id", "page", F.col("char_start").alias("ps"), F.col("char_end").alias("pe"))
    hit = spans.join(p, "doc_id").where((F.col("ps") < F.col("char_end")) & (F.col("pe") > F.col("char_start")) & (F.col("pe") > F.col("ps")))
    found = hit.groupBy(*keys).agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    return spans.join(found, keys, "left")


def page_label(start: str = "start_page", end: str = "end_page") -> Column:
    return F.when(F.col(start) == F.col(end), F.concat(F.lit("p"), F.col(start).cast("string"))).otherwise(F.concat(F.lit("p"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string")))


def node_text(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes with the slice of their document's text."""
    return nodes.join(docs.select("doc_id", F.col("text").alias("_whole")), "doc_id").withColumn("text", F.substring(F.col("_whole"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("_whole")
