"""From pages to answers, by vectors and by outline, for all documents and questions at once.

A stage settles the tables that several later steps read, so each plan covers one stage only.

State of the vector path: pages -> spans, documents -> chunks -> postings, stats, vocab, weights;
then questions(query_id, doc_id, question) -> dense, sparse -> fused -> reranked -> contexts -> answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T
from ..operators import assemble as A
from ..operators import chunk as C
from ..operators import clean as P
from ..operators import outline as O
from ..operators import retrieval as R
from ..operators import tree as TR
from ..operators import vectors as V
from ..session import settled
from .graph import Compiled, State, chain


def parse(s: State) -> State:
    spans = settled(P.merged_spans(s["pages"], s.get("drop_toc", True)), "spans")
    source = s["pages"].groupBy("doc_id").agg(F.first("source").alias("source")) if "source" in s["pages"].columns else s["pages"].select("doc_id", F.col("doc_id").cast("string").alias("source")).distinct()
    return {"spans": spans, "documents": settled(P.merge(spans).join(source, "doc_id"), "documents"), "page_documents": P.parse_per_page(s["pages"], s.get("drop_toc", True))}


def chunk(s: State) -> State:
    docs = s["documents"]
    name = s.get("strategy", "recursive")
    spans = C.chunk(docs, name, s.get("size", 800), s.get("overlap", 100), s.get("boundaries"))
    rows = O.with_pages(C.to_rows(spans, docs, name), s["spans"], ["doc_id", "chunk_idx"])
    return {"chunks": settled(rows, "chunks")}


def embed(s: State) -> State:
    units = s["chunks"].select(F.col("doc_id").alias("scope"), F.concat_ws("/", F.col("doc_id").cast("string"), "chunk_id").alias("unit"), "text")
    post = settled(V.postings(units), "postings")
    stats = settled(V.scope_stats(units, post), "stats")
    vocab = settled(V.vocabulary(post, stats, s.get("min_df", 1), s.get("max_df_ratio", 1.0), s.get("max_terms")), "vocabulary")
    raw = V.tfidf(post, vocab, s.get("sublinear", True))
    out = {"units": units, "postings": post, "stats": stats, "vocab": vocab, "weights": V.l2(raw), "backend": s.get("backend", "tfidf")}
    if out["backend"] == "svd":
        raw = settled(raw, "weights")
        out["components"] = settled(V.svd(raw, s.get("dimensions", 96)), "components")
        out["weights"] = V.project(raw, out["components"])
    elif out["backend"] != "tfidf":
        raise ValueError("backend must be tfidf or svd")
    out["weights"] = settled(out["weights"], "weights")
    return out


def index(s: State) -> State:
    return {"cost": s["stats"].join(s["vocab"].groupBy("scope").agg(F.count("*").alias("dims")), "scope").select("scope", *R.index_cost(F.col("n_units"), F.col("dims")))}


def _queries(s: State) -> DataFrame:
    return s["questions"].select(F.col("doc_id").alias("scope"), "query_id", F.col("question").alias("text"))


def retrieve(s: State) -> State:
    q = _queries(s)
    if s["backend"] == "svd":
        w = V.tfidf(V.terms(q, "scope", "query_id").groupBy("scope", F.col("query_id").alias("unit"), "term").agg(F.count("*").alias("tf")), s["vocab"])
        qw = V.project(w, s["components"]).select("scope", F.col("unit").alias("query_id"), "term", F.col("weight").alias("qw"))
        dense = qw.join(s["weights"], ["scope", "term"]).groupBy("query_id", "unit").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
    else:
        dense = R.cosine_scores(q, s["weights"], s["vocab"])
    sparse = R.bm25_scores(q, s["postings"], s["stats"])
    return {k: settled(R.ranked(R.complete(x, q, s["units"])), k) for k, x in (("dense", dense), ("sparse", sparse))}


def fuse(s: State) -> State:
    return {"fused": settled(R.ranked(R.rrf([(s["dense"], 1.0), (s["sparse"], 1.0)])), "fused")}


def rerank(s: State) -> State:
    short = s["fused"].where(F.col("rank") <= s.get("rerank_width", 50))
    return {"reranked": settled(R.ranked(R.rerank_scores(short, _queries(s), s["units"]), s.get("top_k", 5)), "reranked")}


def assemble(s: State) -> State:
    label = F.coalesce(O.page_label(), F.lit("pNone"))
    chunks = s["chunks"].select(F.concat_ws("/", F.col("doc_id").cast("string"), "chunk_id").alias("unit"), "chunk_id", "char_start", "start_page", label.alias("label"), "text")
    short = s["reranked"].select("query_id", "unit", (F.col("rank") - 1).alias("place")).join(chunks, "unit").join(s["questions"].select("query_id", "question"), "query_id")
    return {"contexts": settled(A.assemble(short, s.get("budget", 2000), s.get("ordering", "best_last")), "contexts")}


def generate(s: State) -> State:
    got = A.extract_answers(s["contexts"]).join(s["contexts"].select("query_id", "question", "context", "sent") if "sent" in s["contexts"].columns else s["contexts"], "query_id")
    out = got.withColumn("support", A.grounding("answer", "context"))
    if "sent" in got.columns:
        out = out.withColumn("citations", A.check_citations("answer", "sent"))
    return {"answers": out}


def summarise(s: State) -> State:
    match = H.matcher("scheme")
    docs = s["documents"]
    lines = docs.select("doc_id", "scheme", F.length("text").alias("n_chars"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


    by = Window.partitionBy("doc_id").orderBy("line_no")
    found = lines.withColumn("char_start", (F.sum(F.length("line") + 1).over(by) - F.length("line") - 1).cast("int")).withColumn("h", match("line")).where("h is not null")
    heads = found.select("doc_id", (F.row_number().over(by) - 1).alias("heading_idx"), "h.number", "h.title", "h.level", "char_start", "n_chars")
    heads = settled(heads, "headings")
    nodes = O.with_pages(O.build_tree(heads, docs), s["spans"], ["doc_id", "node_id"])
    return {"headings": heads, "nodes": TR.summarise_tree(nodes, docs)}


def tree_search(s: State) -> State:
    found, trace = TR.beam_search(s["nodes"], s["questions"], s.get("beam", 2), s.get("max_depth", 6))
    found, trace = settled(found, "found"), settled(trace, "hops")
    return {"found": found, "hops": trace, "pruned": TR.pruned(trace)}


def tree_context(s: State) -> State:
    text = O.node_text(s["nodes"], s["documents"]).withColumn("label", F.coalesce(O.page_label(), F.lit("pNone")))
    c = TR.section_context(s["found"], text, s["questions"], s.get("budget", 2000))
    return {"contexts": settled(s["questions"].select("query_id", "question").join(c, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(""))), "contexts")}


def vector_index() -> Compiled:
    return chain(("parse", parse), ("chunk", chunk), ("embed", embed), ("index", index))


def vector_query() -> Compiled:
    return chain(("retrieve", retrieve), ("fuse", fuse), ("rerank", rerank), ("assemble", assemble), ("generate", generate))


def tree_index() -> Compiled:
    return chain(("parse", parse), ("summarise", summarise))


def tree_query() -> Compiled:
    return chain(("tree_search", tree_search), ("select", tree_context), ("generate", generate))
