"""What the reports compute, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chunk as C
from ..operators import clean as P
from ..operators import evaluate as E
from ..operators import retrieval as R


def source_report(pages: DataFrame) -> DataFrame:
    s = P.load_stats(pages)
    return s.withColumn("empty_share", F.size("empty_pages") / F.col("n_pages")).withColumn("all_empty", F.size("empty_pages") == F.col("n_pages"))


def cleaning_report(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, raw_chars, n_chars, kept, thin (less than 40 % kept), and what was dropped and joined."""
    raw = P.load_stats(pages).select("doc_id", "raw_chars")
    kept = F.when(F.col("raw_chars") > 0, F.col("n_chars") / F.col("raw_chars")).otherwise(F.lit(0.0))
    return documents.select("doc_id", "n_chars", "scheme", "furniture", "dropped_pages", "page_joins").join(raw, "doc_id").withColumn("kept", kept).withColumn("thin", kept < 0.4)


def tree_report(nodes: DataFrame) -> DataFrame:
    """doc_id, n_nodes, n_leaves, depth (of levels), leaf sizes, the largest leaf, and how the outline fits."""
    size = F.col("char_end") - F.col("char_start")
    leaf = F.col("is_leaf") & (F.col("level") > 0)
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count(F.when(leaf, 1)).alias("n_leaves"), F.max("level").alias("depth"), F.min(F.when(leaf, size)).alias("min_leaf"), F.max(F.when(leaf, size)).alias("max_leaf"), F.max_by("title", F.when(leaf, size)).alias("largest"))
    w = Window.partitionBy("doc_id").orderBy("size")
    sizes = nodes.where(leaf).select("doc_id", size.alias("size")).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    median = sizes.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select("doc_id", F.col("size").alias("median_leaf"))
    fit = F.when(F.col("median_leaf").isNull(), F.lit("no outline")).when(F.col("median_leaf").between(200, 20_000), F.lit("good fit")).when(F.col("median_leaf") < 200, F.lit("sections too small")).otherwise(F.lit("sections too large"))
    return n.join(median, "doc_id", "left").withColumn("fit", fit)


def chunk_report(docs: DataFrame, leaves: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document: sizes, coverage, damage, split sections and a verdict."""
    d = E.damage(chunks, docs).groupBy("doc_id").agg(F.sum(F.col("mid_word").cast("int")).alias("mid_word"), F.sum(F.col("ragged").cast("int")).alias("ragged"))
    m = E.mixed(leaves, chunks).groupBy("doc_id").agg(F.count("*").alias("mixed"))
    out = E.size_stats(chunks).join(E.coverage(chunks, docs), "doc_id").join(d, "doc_id").join(E.integrity(leaves, chunks), "doc_id", "left").join(m, "doc_id", "left").fillna(0, ["mixed"])
    split = F.when(F.col("n_sections") > 0, 100.0 * (F.col("n_sections") - F.col("n_intact")) / F.col("n_sections"))
    return out.withColumn("split_pct", split).withColumn("verdict", F.when(split > 50, F.lit("most sections are cut")).when(split > 15, F.lit("some sections are cut")).otherwise(F.lit("sections hold")))


def compare_strategies(docs: DataFrame, leaves: DataFrame, boundaries: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    out = None
    for name in C.STRATEGIES:
        r = chunk_report(docs, leaves, C.chunk(docs, name, size, overlap, boundaries)).withColumn("strategy", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def embedding_report(units: DataFrame, weights: DataFrame) -> DataFrame:
    """scope, mean number of terms a unit, units without any."""
    n = weights.groupBy("scope", "unit").agg(F.count("*").alias("n"))
    full = units.select("scope", "unit").join(n, ["scope", "unit"], "left").fillna(0, ["n"])
    return full.groupBy("scope").agg(F.avg("n").alias("mean_terms"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"))


def ranking_report(dense: DataFrame, sparse: DataFrame, top_k: int, rows: int = 8) -> DataFrame:
    b = sparse.select("query_id", "unit", F.col("score").alias("bm25"), F.col("rank").alias("bm25_rank"))
    return dense.where(F.col("rank") <= rows).join(b, ["query_id", "unit"], "left").withColumn("inside", F.col("rank") <= top_k)


def filter_trap(scores: DataFrame, pages: DataFrame, top_k: int) -> DataFrame:
    """query_id, after, before: how many units past a scope's middle page are left when the filter comes after the cut and before it. A unit without a page is never kept."""
    half = pages.groupBy("scope").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("unit", "start_page"))).alias("l"))
    cut = half.select("scope", F.get("l", F.least(F.col("n") - 1, F.greatest(F.lit(1), F.floor(F.col("n") / 2))).cast("int"))["start_page"].alias("cut"))
    s = scores.join(pages.join(cut, "scope").select("unit", (F.col("start_page") >= F.col("cut")).alias("keep")), "unit")
    post = R.post_filter(R.ranked(s), F.col("keep"), top_k).groupBy("query_id").agg(F.count("*").alias("after"))
    pre = R.pre_filter(s, F.col("keep"), top_k).groupBy("query_id").agg(F.count("*").alias("before"))
    return pre.join(post, "query_id", "left").fillna(0, ["after"])


def cost_shape(n_nodes: int, decisions: int, questions: int = 100_000) -> dict[str, int]:
    """Model calls at index time and for a month of questions, by path."""
    return {"vector_index": 0, "tree_index": n_nodes, "vector_query": 1, "tree_query": decisions + 1, "vector_month": questions, "tree_month": questions * (decisions + 1)}
