"""A cleaning pipeline over documents: each stage takes what the one before kept.

Toxic documents go; of each class of near copies the row with the smallest id stays; passages
that repeat elsewhere are cut out, but for their first place; documents that hold a benchmark item
go; what is left is packed into token sequences. Every stage reads all rows and whole texts.

Each row is decided on by its id and text, so rows that share an id, or have none, stand for
themselves; a row without id comes last among its copies. Rows that agree in both are one.
Further columns of documents pass through to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import op01_jaccard_join, op02_packing, op07_exact_substrings, op09_decontaminate, op10_toxicity
from lectern.llm.common import new_path, table
from lectern.session import ship


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of sf_dir, doesn't call toxic."""
    ship(spark)
    model = op10_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return op10_toxicity.keep_clean(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the smallest doc_id; of rows that share it, the one with the smallest key."""
    ship(spark)
    rows = _keyed(docs)
    classes = op01_jaccard_join.jaccard_join(rows.select(F.col("_key").alias("doc_id"), "text"))
    classes = classes.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")
    kept = rows.select("_key", "doc_id").distinct().join(classes, "_key").groupBy("component_id").agg(F.min(order)["_key"].alias("_key"))
    return rows.join(kept.select("_key"), "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the bytes of repeated 200-byte strings cut out; n_chars follows the text."""
    ship(spark)
    return op07_exact_substrings.cut_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    ship(spark)
    rows = _keyed(docs)
    found = op09_decontaminate.leaks(rows.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences."""
    import public_tokenizers

    ship(spark)
    return op02_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("substrings", substrings), ("decontamination", decontamination), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
