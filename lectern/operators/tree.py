"""Summaries of an outline from its leaves up, and beam search down it, for all documents and queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled
from .assemble import PER_SECTION, admit
from .retrieval import rerank_scores


def summarise_tree(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes with `summary`: a leaf's from its text, another's from its children's "title: summary" in order.

    A child's level is greater than its parent's, so one pass for each level, deepest first, meets
    children before parents. The nodes are settled once; a pass reads the children of its level alone.
    """
    nodes = settled(nodes, "nodes")
    text = docs.select("doc_id", F.col("text").alias("_t"))
    own = F.substring(F.col("_t"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    leaf = nodes.where("is_leaf").join(text, "doc_id").withColumn("summary", T.summarise(own, "title"))
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("level").alias("up"))
    facts = ["doc_id", "node_id", "parent_id", "title", "summary", "level"]
    made = [settled(leaf.select(*facts).join(up, ["doc_id", "parent_id"], "left"), "leaves")]
    inner = nodes.where(~F.col("is_leaf"))
    levels = [r[0] for r in inner.select("level").distinct().orderBy(F.desc("level")).collect()]  # a dozen at most
    for level in levels:
        child = made[0].where(F.col("up") == level)
        for m in made[1:]:
            child = child.unionByName(m.where(F.col("up") == level))
        parts = F.array_sort(F.collect_list(F.struct(F.length("node_id").alias("digits"), F.col("node_id"), F.concat(F.col("title"), F.lit(": "), F.col("summary")).alias("x"))))
        body = child.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(parts, lambda x: x["x"]), " ").alias("_b"))
        here = inner.where(F.col("level") == level).join(body, ["doc_id", "node_id"]).withColumn("summary", T.summarise("_b", "title"))
        made.append(settled(here.select(*facts).join(up, ["doc_id", "parent_id"], "left"), "parents"))
    both = made[0]
    for m in made[1:]:
        both = both.unionByName(m)
    return settled(nodes.join(both.select("doc_id", "node_id", "summary"), ["doc_id", "node_id"]), "summaries")


def summary_quality(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, words, title_echo, empty."""
    words = lambda c: F.filter(F.split(F.lower(T.squeeze(c)), " "), lambda x: x != "")
    t, s = F.array_distinct(words("title")), words(F.coalesce("summary", F.lit("")))
    return nodes.select("doc_id", "node_id", F.size(s).alias("words"), F.when(F.size(t) > 0, F.size(F.array_intersect(t, s)) / F.size(t)).otherwise(F.lit(0.0)).alias("title_echo"), (F.size(s) == 0).alias("empty"))


def valid_choices(choices: Column | str, n: Column | int, beam: int) -> Column:
    """Ids that exist, each once, at most `beam`; the first option where none is left."""
    n = F.lit(n) if isinstance(n, int) else n
    ok = F.slice(F.array_distinct(F.filter(T.col(choices), lambda x: x.isNotNull() & (x >= 0) & (x < n))), 1, beam)
    return F.when(F.size(ok) > 0, ok).otherwise(F.array(F.lit(0)))


def beam_search(nodes: DataFrame, queries: DataFrame, beam: int = 2, max_depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """nodes with summaries, queries(query_id, doc_id, question) -> (found: query_id, doc_id, node_id, seq; trace: query_id, doc_id, hop, at_id, node_id, chosen, cut_by_beam).

    At each level a leaf on the frontier is collected and each other node picks up to `beam`
    children whose words meet the question, or its first child; what is picked competes by place
    within its node, then by the node's place, for `beam` places of the next level. At max_depth
    what is still on the frontier is collected as it is.
    """
    # words are taken once from each node and question, not at each place a beam passes
    said = F.array_distinct(T.content_words(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))))
    asked = queries.select("query_id", "doc_id", F.array_distinct(T.content_words("question")).alias("question"))
    tree = settled(nodes.join(queries.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "node_id", "parent_id", "is_leaf", said.alias("said")), "tree")
    frontier = asked.withColumn("node_id", F.lit("0000")).withColumn("place", F.lit(0))
    frontier = settled(frontier.join(tree.select("doc_id", "node_id", "is_leaf"), ["doc_id", "node_id"]), "frontier")
    found, trace = [], []
    by_query = Window.partitionBy("query_id", "doc_id")
    for depth in range(max_depth):
        found.append(frontier.where("is_leaf").select("query_id", "doc_id", "node_id", F.lit(depth).alias("depth"), "place"))
        opened = frontier.where("not is_leaf")
        kids = opened.select("query_id", "doc_id", "question", F.col("node_id").alias("at_id"), "place").join(
            tree.select("doc_id", F.col("parent_id").alias("at_id"), "node_id", F.col("is_leaf"), "said"), ["doc_id", "at_id"]
        )
        share = F.when(F.size("question") > 0, F.size(F.array_intersect("question", "said")) / F.size("question")).otherwise(F.lit(0.0))
        kids = kids.withColumn("score", F.round(share, 9))
        node = Window.partitionBy("query_id", "doc_id", "at_id").orderBy(F.desc("score"), F.length("node_id"), "node_id")
        kids = kids.withColumn("pick", F.row_number().over(node))
        best = F.max("score").over(Window.partitionBy("query_id", "doc_id", "at_id"))
        kids = kids.withColumn("picked", ((F.col("score") > 0) & (F.col("pick") <= beam)) | ((best <= 0) & (F.col("pick") == 1)))
        order = F.row_number().over(by_query.orderBy(F.desc(F.col("picked")), "pick", "place"))
        kids = kids.withColumn("next", order).withColumn("chosen", F.col("picked") & (F.col("next") <= beam))
        kids = settled(kids.select("query_id", "doc_id", "question", "at_id", "place", "node_id", "is_leaf", "pick", "picked", "next", "chosen"))
        trace.append(kids.select("query_id", "doc_id", F.lit(depth).alias("depth"), "place", "at_id", "node_id", "chosen", (F.col("picked") & ~F.col("chosen")).alias("cut_by_beam")))
        frontier = kids.where("chosen").select("query_id", "doc_id", "question", "node_id", "is_leaf", (F.col("next") - 1).alias("place"))
        if frontier.isEmpty():
            break
    else:
        found.append(frontier.select("query_id", "doc_id", "node_id", F.lit(max_depth).alias("depth"), "place"))
    leaves, hops = found[0], trace[0]
    for f in found[1:]:
        leaves = leaves.unionByName(f)
    for t in trace[1:]:
        hops = hops.unionByName(t)
    seq = F.row_number().over(by_query.orderBy("depth", "place", F.length("node_id"), "node_id")) - 1
    hop = F.dense_rank().over(by_query.orderBy("depth", "place")) - 1
    once = leaves.groupBy("query_id", "doc_id", "node_id").agg(F.min(F.struct("depth", "place")).alias("m")).select("query_id", "doc_id", "node_id", "m.*")
    return once.withColumn("seq", seq).drop("depth", "place"), hops.withColumn("hop", hop).drop("depth", "place")


def pruned(trace: DataFrame) -> DataFrame:
    return trace.where("not chosen").select("query_id", "doc_id", "hop", "at_id", "node_id", "cut_by_beam")


def section_context(found: DataFrame, nodes: DataFrame, queries: DataFrame, budget: int = 1200) -> DataFrame:
    """found(query_id, doc_id, node_id, seq) with sections' text in nodes(doc_id, node_id, title, text, char_start, label) -> query_id, context.

    Sections are admitted by rerank score, whole or not at all, and stand in the order of the text.
    """
    s = found.join(nodes.select("doc_id", "node_id", "title", "text", "char_start", "label"), ["doc_id", "node_id"])
    unit = F.concat_ws("/", F.col("doc_id").cast("string"), "node_id")
    s = s.withColumn("unit", unit)
    scores = rerank_scores(s.select("query_id", "unit"), queries.select("query_id", F.col("question").alias("text")), s.select("unit", "text").distinct())
    s = s.join(scores, ["query_id", "unit"])
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "seq")) - 1)
    s = s.withColumn("cost", T.estimate_tokens(T.squeeze("text")) + PER_SECTION)
    got = admit(s, F.lit(budget).cast("long"), ["query_id"])
    b = F.concat(F.lit("["), F.col("node_id"), F.lit(", "), F.col("label"), F.lit("] "), F.col("title"), F.lit("\n"), T.squeeze("text"))
    blocks = F.array_sort(F.collect_list(F.when(F.col("admitted"), F.struct("doc_id", "char_start", b.alias("b")))))
    return got.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))
