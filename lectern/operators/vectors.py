"""Terms, vocabulary and vector algebra over long-form postings.

Units are rows (scope, unit, text): statistics are taken within a scope (one document's chunks, or
with a constant scope the whole corpus). One tokenising pass feeds both TF-IDF and BM25.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def terms(units: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, term: stemmed terms in order."""
    return units.select(*keys, F.posexplode(T.raw_terms("text")).alias("pos", "w")).select(*keys, "pos", T.stem("w").alias("term"))


def postings(units: DataFrame) -> DataFrame:
    return terms(units, "scope", "unit").groupBy("scope", "unit", "term").agg(F.count("*").alias("tf"))


def scope_stats(units: DataFrame, post: DataFrame) -> DataFrame:
    """scope, n_units, avg_len: units without terms count too."""
    n = units.groupBy("scope").agg(F.count("*").alias("n_units"))
    total = post.groupBy("scope").agg(F.sum("tf").alias("total"))
    return n.join(total, "scope", "left").select("scope", "n_units", (F.coalesce("total", F.lit(0)) / F.col("n_units")).alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def vocabulary(post: DataFrame, stats: DataFrame, min_df: int = 1, max_df_ratio: float = 1.0, max_terms: int | None = None) -> DataFrame:
    """scope, term, df, tf, idf, term_idx (by term, from 0)."""
    v = post.groupBy("scope", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    v = v.join(stats.select("scope", "n_units"), "scope")
    v = v.where((F.col("df") >= min_df) & (F.col("df") <= max_df_ratio * F.col("n_units"))).withColumn("idf", idf(F.col("n_units"), F.col("df"))).drop("n_units")
    if max_terms is not None:
        best = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc(F.round(F.col("tf") * F.col("idf"), 9)), "term"))
        v = v.withColumn("r", best).where(F.col("r") <= max_terms).drop("r")
    return v


def indexed(vocab: DataFrame) -> DataFrame:
    """term_idx by term order within a scope; for scopes of a document's size."""
    return vocab.withColumn("term_idx", F.row_number().over(Window.partitionBy("scope").orderBy("term")) - 1)


def informative(vocab: DataFrame, n: int = 12) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc(F.round(F.col("tf") * F.col("idf"), 9)), "term"))
    return vocab.withColumn("rank", r).where(F.col("rank") <= n)


def common(vocab: DataFrame, n: int = 5) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("df"), "term"))
    return vocab.withColumn("rank", r).where(F.col("rank") <= n)


def unknown_terms(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """queries(scope, query_id, text) -> scope, query_id, term, first_pos of terms outside the vocabulary."""
    seen = terms(queries, "scope", "query_id").groupBy("scope", "query_id", "term").agg(F.min("pos").alias("first_pos"))
    return seen.join(vocab.select("scope", "term"), ["scope", "term"], "left_anti")


def tfidf(post: DataFrame, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """scope, unit, term, tf, weight (not normalised)."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    return post.join(vocab.select("scope", "term", "idf"), ["scope", "term"]).withColumn("weight", tf * F.col("idf")).drop("idf")


def l2(weights: DataFrame) -> DataFrame:
    """Unit length by unit; units of length zero have no rows."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("scope", "unit")))
    return weights.withColumn("norm", norm).where("norm > 0").withColumn("weight", F.col("weight") / F.col("norm")).drop("norm")


def explain(weights: DataFrame, n: int = 10) -> DataFrame:
    """The heaviest terms of each unit."""
    r = F.row_number().over(Window.partitionBy("scope", "unit").orderBy(F.desc(F.round("weight", 9)), "term"))
    return weights.withColumn("rank", r).where(F.col("rank") <= n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    d = magnitude(a) * magnitude(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def angle(cos: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def term_matrix(post: DataFrame, picked: list[str]) -> DataFrame:
    """A column for each picked term with its count in each unit."""
    return post.groupBy("scope", "unit").pivot("term", picked).agg(F.sum("tf")).fillna(0)


def pair_scores(weights: DataFrame) -> DataFrame:
    """scope, a, b, score: cosine of all pairs of units within a scope that share a term. For scopes of a document's size."""
    x = weights.select("scope", "term", F.col("unit").alias("a"), F.col("weight").alias("wa"))
    y = weights.select("scope", "term", F.col("unit").alias("b"), F.col("weight").alias("wb"))
    return x.join(y, ["scope", "term"]).where("a < b").groupBy("scope", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def closest_pair(weights: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc(F.round("score", 9)), "a", "b"))
    return pair_scores(weights).withColumn("r", r).where("r = 1").drop("r")


def shared_terms(weights: DataFrame, pairs: DataFrame, n: int = 5) -> DataFrame:
    """The terms that contribute most to the similarity of pairs(scope, a, b)."""
    x = weights.select("scope", F.col("unit").alias("a"), "term", F.col("weight").alias("wa"))
    y = weights.select("scope", F.col("unit").alias("b"), "term", F.col("weight").alias("wb"))
    both = pairs.select("scope", "a", "b").join(x, ["scope", "a"]).join(y, ["scope", "b", "term"]).withColumn("product", F.col("wa") * F.col("wb"))
    r = F.row_number().over(Window.partitionBy("scope", "a", "b").orderBy(F.desc(F.round("product", 9)), "term"))
    return both.withColumn("rank", r).where(F.col("rank") <= n).select("scope", "a", "b", "term", "product", "rank")


def svd(weights: DataFrame, n_components: int = 96) -> DataFrame:
    """Components (scope, component, term, value) of each scope's matrix of unit-length rows; scopes of a document's size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, names = pdf["unit"].astype("category"), pdf["term"].astype("category")
        m = np.zeros((len(rows.cat.categories), len(names.cat.categories)))
        m[rows.cat.codes, names.cat.codes] = pdf["weight"]
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        k = min(n_components, min(m.shape) - 1) or 1
        v = np.linalg.svd(m, full_matrices=False)[2][:k]
        c, t = np.nonzero(v)
        return pd.DataFrame({"scope": pdf["scope"].iloc[0], "component": c.astype("int32"), "term": names.cat.categories[t].astype(str), "value": v[c, t]})

    kind = weights.schema["scope"].dataType.simpleString()
    return weights.select("scope", F.col("unit").cast("string").alias("unit"), "term", "weight").groupBy("scope").applyInPandas(run, f"scope {kind}, component int, term string, value double")


def project(weights: DataFrame, components: DataFrame) -> DataFrame:
    """Units in the space of the components, at unit length: scope, unit, term (the component), weight."""
    p = weights.join(components, ["scope", "term"]).groupBy("scope", "unit", F.col("component").alias("term")).agg(F.sum(F.col("weight") * F.col("value")).alias("weight"))
    return l2(p.where("weight <> 0"))


def explain_components(components: DataFrame) -> DataFrame:
    """scope, component, label: the three largest signed terms."""
    r = F.row_number().over(Window.partitionBy("scope", "component").orderBy(F.desc("value"), "term"))
    top = components.withColumn("r", r).where("r <= 3")
    return top.groupBy("scope", "component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ", ").alias("label"))
