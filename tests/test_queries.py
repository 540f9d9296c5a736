"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import queries as Q

TABLES = "documents embeddings pages benchmark labels conversations".split()
FEW = ["paginate_lines", "dehyphenate", "furniture", "unwrap_paragraphs", "outline_nodes", "chunks_fixed", "bm25_topk", "rrf_topk", "embedding_topk", "greedy_budget", "grounding", "chunk_coverage", "golden_set"]


def rows(df):
    cols = sorted(df.columns)
    return sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


@pytest.mark.parametrize("name", FEW)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(Q.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(Q.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
