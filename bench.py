"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lectern.plans.queries import QUERIES
from lectern.session import session, ship

HEADLINE = ["bm25_topk", "cosine_topk", "chunks_recursive", "embedding_topk", "merged_documents", "beam_search"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = ship(session(f"local[{os.environ.get('BENCH_CPUS', '8')}]"))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}), flush=True)


if __name__ == "__main__":
    main()
