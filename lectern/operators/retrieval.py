"""Ranking: cosine and BM25 over postings, fusion, rerank, filters, and what the reports need.

Rankings are rows (query_id, unit, score, rank). Scores are rounded to nine digits before ranking,
as a sum's last digits depend on the order of a shuffle; ties go to the smaller unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import vectors as V

K1, B = 1.5, 0.75
RRF_K = 60


def ranked(scores: DataFrame, top_k: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """top_k 0 or None: all."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "unit"))
    out = scores.withColumn("rank", r)
    return out.where(F.col("rank") <= top_k) if top_k else out


def complete(scores: DataFrame, queries: DataFrame, units: DataFrame) -> DataFrame:
    """Every unit of a query's scope, with 0 where nothing matched: rankings by score then name all units."""
    grid = queries.select("scope", "query_id").join(units.select("scope", "unit"), "scope")
    return grid.join(scores, ["query_id", "unit"], "left").select("query_id", "unit", F.coalesce("score", F.lit(0.0)).alias("score"))


def cosine_scores(queries: DataFrame, weights: DataFrame, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """queries(scope, query_id, text) against unit-length weights; terms of a query count as often as they come."""
    q = V.terms(queries, "scope", "query_id").groupBy("scope", F.col("query_id").alias("unit"), "term").agg(F.count("*").alias("tf"))
    q = V.l2(V.tfidf(q, vocab, sublinear)).select("scope", F.col("unit").alias("query_id"), "term", F.col("weight").alias("qw"))
    return q.join(weights, ["scope", "term"]).groupBy("query_id", "unit").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_parts(queries: DataFrame, post: DataFrame, stats: DataFrame, k1: Column | float = K1, b: Column | float = B) -> DataFrame:
    """query_id, unit, term, tf, idf, part: a query's set of terms against postings."""
    k1, b = (x if isinstance(x, Column) else F.lit(x) for x in (k1, b))
    q = V.terms(queries, "scope", "query_id").select("scope", "query_id", "term").distinct()
    length = post.groupBy("scope", "unit").agg(F.sum("tf").alias("len"))
    df = post.join(q.select("scope", "term").distinct(), ["scope", "term"], "left_semi").groupBy("scope", "term").agg(F.count("*").alias("df"))
    hit = q.join(post, ["scope", "term"]).join(df, ["scope", "term"]).join(stats, "scope").join(length, ["scope", "unit"])
    f = F.col("tf")
    part = F.col("idf") * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hit.withColumn("idf", bm25_idf(F.col("n_units"), F.col("df"))).withColumn("part", part)


def bm25_scores(queries: DataFrame, post: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    return bm25_parts(queries, post, stats, k1, b).groupBy("query_id", "unit").agg(F.sum("part").alias("score"))


def bm25_sweep(queries: DataFrame, post: DataFrame, stats: DataFrame, variants: list[tuple[float, float]], top_k: int = 3) -> DataFrame:
    """variant, k1, b and each query's first units: matches are found once and scored for all variants."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(k).alias("k1"), F.lit(b).alias("b")) for i, (k, b) in enumerate(variants)])).alias("v")
    base = bm25_parts(queries, post, stats).select("query_id", "unit", "tf", "idf", "len", "avg_len", grid).select("*", "v.*")
    f = F.col("tf")
    part = F.col("idf") * f * (F.col("k1") + 1) / (f + F.col("k1") * (1 - F.col("b") + F.col("b") * F.col("len") / F.col("avg_len")))
    return ranked(base.groupBy("variant", "k1", "b", "query_id", "unit").agg(F.sum(part).alias("score")), top_k, ("variant", "query_id"))


def bm25_explain(queries: DataFrame, post: DataFrame, stats: DataFrame, unit: DataFrame) -> DataFrame:
    """For pairs unit(query_id, unit): every distinct term of the query with its frequency, idf and part, 0 where it is missing."""
    q = V.terms(queries, "scope", "query_id").groupBy("scope", "query_id", "term").agg(F.min("pos").alias("pos"))
    want = q.join(unit.select("query_id", "unit"), "query_id")
    df = post.groupBy("scope", "term").agg(F.count("*").alias("df"))
    got = bm25_parts(queries, post, stats).select("query_id", "unit", "term", "tf", "part")
    out = want.join(got, ["query_id", "unit", "term"], "left").join(df, ["scope", "term"], "left").join(stats, "scope")
    return out.select("query_id", "unit", "term", "pos", F.coalesce("tf", F.lit(0)).alias("freq"), bm25_idf(F.col("n_units"), F.coalesce("df", F.lit(0))).alias("idf"), F.coalesce("part", F.lit(0.0)).alias("part"))


def rrf(rankings: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings with weights."""
    parts = [r.select("query_id", "unit", (F.lit(float(w)) / (k + F.col("rank"))).alias("x")) for r, w in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", "unit").agg(F.sum("x").alias("score"))


def rerank_scores(shortlist: DataFrame, queries: DataFrame, units: DataFrame) -> DataFrame:
    """Lexical score of shortlist(query_id, unit): coverage, density and closeness of the query's content words."""
    q = queries.select("query_id", F.array_distinct(T.content_words("text")).alias("q"))
    text = units.select("unit", F.col("text").alias("t"))
    base = shortlist.select("query_id", "unit").join(q, "query_id").join(text, "unit")
    words = base.withColumn("w", T.content_words("t"))
    rows = words.select("query_id", "unit", F.size("q").alias("nq"), F.size("w").alias("nw"), "q", F.posexplode_outer("w").alias("pos", "x"))
    hit = F.array_contains("q", F.coalesce("x", F.lit("")))
    g = rows.groupBy("query_id", "unit", "nq", "nw").agg(F.count_distinct(F.when(hit, F.col("x"))).alias("m"), F.count(F.when(hit, 1)).alias("hits"), F.min(F.when(hit, F.col("pos"))).alias("lo"), F.max(F.when(hit, F.col("pos"))).alias("hi"))
    near = F.when(F.col("m") > 1, F.col("m") / (F.col("hi") - F.col("lo") + 1)).otherwise(F.lit(0.5))
    score = F.when((F.col("nq") > 0) & (F.col("m") > 0), 2.0 * F.col("m") / F.col("nq") + 0.5 * F.col("hits") / F.sqrt("nw") + near).otherwise(F.lit(0.0))
    return g.select("query_id", "unit", score.alias("score"))


def post_filter(ranking: DataFrame, keep: Column, top_k: int) -> DataFrame:
    """Cut first, then filter: fewer than top_k may be left."""
    return ranking.where(F.col("rank") <= top_k).where(F.coalesce(keep, F.lit(False)))


def pre_filter(scores: DataFrame, keep: Column, top_k: int) -> DataFrame:
    return ranked(scores.where(F.coalesce(keep, F.lit(False))), top_k)


def disagreement(a: DataFrame, b: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, unit, rank_a, rank_b, gap) and (query_id, agreed, agreement in percent of top_k)."""
    both = a.select("query_id", "unit", F.col("rank").alias("rank_a")).join(b.select("query_id", "unit", F.col("rank").alias("rank_b")), ["query_id", "unit"])
    both = both.withColumn("gap", F.abs(F.col("rank_a") - F.col("rank_b")))
    inside = F.count(F.when((F.col("rank_a") <= top_k) & (F.col("rank_b") <= top_k), 1))
    return both, both.groupBy("query_id").agg(inside.alias("agreed")).withColumn("agreement", 100.0 * F.col("agreed") / top_k)


def index_cost(n: Column, dims: Column) -> list[Column]:
    """Operations, seconds at two billion a second, and megabytes at four bytes a component."""
    ops = (n * dims).cast("double")
    return [ops.alias("ops"), (ops / 2e9).alias("seconds"), (ops * 4 / 1e6).alias("mb")]


# Kinds of index, what they build, recall, cost of a query.
INDEX_TYPES = [
    ("flat / exact", "none", "100%", "N x D per query"),
    ("IVF", "cluster centroids", "90-98%", "N/nprobe x D"),
    ("HNSW", "navigable graph", "95-99%", "log N x D"),
    ("PQ / quantisation", "compressed codes", "80-95%", "N x D but cheaper ops"),
]
