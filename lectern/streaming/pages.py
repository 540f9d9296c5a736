"""The stateless stages over a stream of pages: rows that arrive are cleaned and cut as a batch would be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import chunk as C
from ..operators import clean as P


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def cleaned(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text); without furniture, which needs a whole document."""
    none = F.array().cast("array<string>")
    return pages.select("doc_id", "page", P.clean_page(T.normalise("text"), none).alias("text")).where("text <> ''")


def windows(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    return C.fixed(docs, size, overlap)


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, exactly once with the checkpoint; ends when what is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
