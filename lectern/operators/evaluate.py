"""What chunking damages, golden sets, and ranking metrics. Interval work joins on doc_id first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V

MIXED = 25
LEAST_CHARS, LEAST_SHARE = 40, 0.30


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def sections(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("is_leaf") & (F.col("level") > 0))


def integrity(leaves: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, n_sections, n_intact: sections that lie whole in some chunk."""
    c = chunks.select("doc_id", F.col("char_start").alias("cs"), F.col("char_end").alias("ce"))
    inside = leaves.join(c, [leaves["doc_id"] == c["doc_id"], c["cs"] <= leaves["char_start"], c["ce"] >= leaves["char_end"]], "left_semi").select("doc_id", "node_id").distinct()
    whole = leaves.select("doc_id", "node_id").join(inside.withColumn("intact", F.lit(1)), ["doc_id", "node_id"], "left")
    return whole.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.count("intact").alias("n_intact"))


def touched(leaves: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, node_id, title, chars, chunk_chars of every section that a chunk overlaps."""
    s = leaves.select("doc_id", "node_id", "title", F.col("char_start").alias("ss"), F.col("char_end").alias("se"))
    both = chunks.join(s, "doc_id").withColumn("chars", overlap(F.col("char_start"), F.col("char_end"), F.col("ss"), F.col("se"))).where("chars > 0")
    return both.select("doc_id", "chunk_idx", "node_id", "title", "chars", (F.col("char_end") - F.col("char_start")).alias("chunk_chars"))


def mixed(leaves: DataFrame, chunks: DataFrame) -> DataFrame:
    return touched(leaves, chunks).where(F.col("chars") >= MIXED).groupBy("doc_id", "chunk_idx").agg(F.count("*").alias("n_sections")).where("n_sections >= 2")


def damage(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks with mid_word (begins inside a word) and ragged (ends inside a sentence)."""
    c = chunks.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id")
    letter = r"[\p{L}\p{N}]"
    edge = F.substring(F.col("_t"), F.col("char_start"), F.lit(2))
    mid = (F.col("char_start") > 0) & edge.rlike(f"^{letter}{letter}$")
    own = F.substring(F.col("_t"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    ragged = (F.col("char_end") < F.length("_t")) & ~own.endswith("\n") & ~F.regexp_replace(own, r"(?U)\s+$", "").rlike(r"[.!?:;]$")
    return c.withColumn("mid_word", mid).withColumn("ragged", ragged).drop("_t")


def size_stats(chunks: DataFrame) -> DataFrame:
    """The median is the upper one, the mean is rounded down."""
    size = F.col("char_end") - F.col("char_start")
    r = chunks.select("doc_id", size.alias("size")).withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("size")))
    return r.groupBy("doc_id").agg(F.max("n").alias("n_chunks"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2) + 1, F.col("size"))).alias("median_size"), F.floor(F.avg("size")).alias("mean_size"))


def coverage(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, uncovered, duplicated, redundancy: by the union of spans, from a running greatest end."""
    w = Window.partitionBy("doc_id").orderBy("char_start", "char_end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("char_end").over(w), F.lit(0))
    new = F.greatest(F.lit(0), F.col("char_end") - F.greatest("char_start", before))
    g = chunks.withColumn("new", new).groupBy("doc_id").agg(F.sum("new").alias("covered"), F.sum(F.col("char_end") - F.col("char_start")).alias("total"))
    n = docs.select("doc_id", F.length("text").alias("n")).where("n > 0")
    out = n.join(g, "doc_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0)))
    return out.select("doc_id", (F.col("n") - F.col("covered")).alias("uncovered"), (F.col("total") - F.col("covered")).alias("duplicated"), (F.col("total") / F.col("n")).alias("redundancy"))


def golden_set(leaves: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases: doc_id, node_id, query; relevant: doc_id, node_id, chunk_idx): a section's title should find its chunks."""
    number = F.coalesce(F.col("number"), F.lit(""))
    query = F.trim(F.when(F.length(number) > 0, F.regexp_replace("title", F.concat(F.lit("^"), F.regexp_replace(number, r"([.])", r"\\$1"), F.lit(r"\s*")), F.lit(""))).otherwise(F.col("title")))
    named = leaves.withColumn("query", query).where(F.length("query") >= 3)
    hit = touched(named, chunks).where((F.col("chars") >= LEAST_CHARS) & (F.col("chars") >= LEAST_SHARE * F.col("chunk_chars"))).select("doc_id", "node_id", "chunk_idx")
    cases = named.select("doc_id", "node_id", "query").join(hit.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi")
    return cases, hit


def holding(units: DataFrame, queries: DataFrame, post: DataFrame) -> DataFrame:
    """query_id, unit: every unit whose text contains the query's, out of all; units, queries and their postings as for BM25.

    What stands between a query's first and last white space has the same terms in any text that
    contains it, so only units with the rarest of them are read; a query without such terms reads all.
    An empty query is held by none.
    """
    q = queries.where("text <> ''").select("scope", "query_id", "text")
    inner = V.terms(q.withColumn("text", F.regexp_extract("text", r"(?s)\s(.*)\s", 1)), "scope", "query_id").select("scope", "query_id", "term").distinct()
    df = post.join(inner.select("scope", "term").distinct(), ["scope", "term"], "left_semi").groupBy("scope", "term").agg(F.count("*").alias("df"))
    rare = inner.join(df, ["scope", "term"], "left").groupBy("scope", "query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))["term"].alias("term"))
    text = units.select("scope", "unit", F.col("text").alias("_t"))
    some = rare.join(post, ["scope", "term"]).select("scope", "query_id", "unit").join(q, ["scope", "query_id"]).join(text, ["scope", "unit"])
    every = q.join(rare, ["scope", "query_id"], "left_anti").join(text, "scope")
    cols = ["query_id", "unit", "text", "_t"]
    return some.select(*cols).unionByName(every.select(*cols)).where(F.contains("_t", "text")).select("query_id", "unit").distinct()


def per_case(ranking: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """ranking(query_id, unit, rank), relevant(query_id, unit) -> n_relevant, hits, returned, first_rank and the metrics of each case with relevant units."""
    n = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    r = ranking.join(relevant.distinct().withColumn("good", F.lit(1)), ["query_id", "unit"], "left")
    top = F.col("rank") <= k
    good = F.col("good") == 1
    got = r.groupBy("query_id").agg(
        F.count(F.when(top & good, 1)).alias("hits"), F.count(F.when(top, 1)).alias("returned"), F.min(F.when(good, F.col("rank"))).alias("first_rank"),
        F.coalesce(F.sum(F.when(top & good, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    out = n.join(got, "query_id", "left").fillna(0, ["hits", "returned"]).fillna(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return (
        out.withColumn("recall", F.col("hits") / F.col("n_relevant"))
        .withColumn("precision", F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(F.lit(0.0)))
        .withColumn("reciprocal_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))
        .withColumn("hit", F.when(F.col("hits") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .withColumn("ndcg", F.col("dcg") / ideal)
        .drop("dcg")
    )


def evaluate(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("n_cases"), *[F.avg(c).alias(c) for c in ("recall", "precision", "reciprocal_rank", "hit", "ndcg")])


def sensitivity(ranking: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """query_id, k, recall, precision (of k) for each k, from one pass."""
    n = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hit = ranking.join(relevant.distinct(), ["query_id", "unit"], "left_semi").where(F.col("rank") <= max(ks)).groupBy("query_id").agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"h{k}"), F.lit(0)).alias("h")) for k in ks])).alias("x")
    return n.join(hit, "query_id", "left").select("query_id", "n_relevant", rows).select("query_id", "x.k", (F.col("x.h") / F.col("n_relevant")).alias("recall"), (F.col("x.h") / F.col("x.k")).alias("precision"))
