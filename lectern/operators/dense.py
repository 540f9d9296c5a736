"""Exact nearest neighbours of dense vectors: queries in blocks against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, unit long, score double"


def _unit(col: pa.Array) -> np.ndarray:
    x = np.array(col.to_pylist(), float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """vectors(unit, vec), queries(query_id, vec) -> query_id, unit, score, rank by cosine.

    Each block of at most `block` queries goes to every task, which keeps k rows a query and batch;
    so what is sent has a bound and what is shuffled is k rows a query and batch, not all pairs.
    """
    parts = max(1, -(-queries.count() // block))
    out = None
    for p in range(parts):
        q = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).orderBy("query_id").toArrow()
        ids, book = q["query_id"].to_numpy(), _unit(q["vec"].combine_chunks()) if q.num_rows else None
        if book is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, book: np.ndarray = book) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                unit = b.column(0).to_numpy()
                s = np.round(book @ _unit(b.column(1)).T, 9)
                m = min(k, s.shape[1])
                order = np.lexsort((np.broadcast_to(unit, s.shape), -s), axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(unit[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["query_id", "unit", "score"])

        found = vectors.select(F.col("unit").cast("long"), "vec").mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], FOUND + ", rank int")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "unit"))
    return out.withColumn("rank", r).where(F.col("rank") <= k)
