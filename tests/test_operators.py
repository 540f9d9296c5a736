import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import assemble as A
from lectern.operators import chunk as C
from lectern.operators import clean as P
from lectern.operators import evaluate as E
from lectern.operators import outline as O
from lectern.operators import retrieval as R
from lectern.operators import tree as TR
from lectern.operators import vectors as V
from lectern.plans import pipelines, reports
from lectern.plans.graph import Graph
from lectern.sources import files
from lectern.streaming import pages as stream


def test_sample_is_cleaned(spark):
    pages = files.sample(spark)
    spans = P.merged_spans(pages)
    rows = {r["page"]: r for r in spans.collect()}
    doc = P.merge(spans).first()
    text = doc["text"]
    assert "office" in text and "calendar on the wall" in text and "one-time code" in text and "One-time" not in text
    assert "Field Station" not in text and "Page" not in text
    assert doc["scheme"] == "dotted_alpha" and doc["page_joins"] == [3] and doc["n_pages"] == 4
    assert "gives out a new one to the guest in person." in text
    for r in rows.values():
        assert text[r["char_start"] : r["char_end"]] == r["text"]
    assert "A.1.1 Keys and badges\n\nThe warden" in text


def test_furniture_threshold(spark):
    def found(n):
        pages = spark.createDataFrame([(1, i, f"Head\nbody {chr(97 + i)}{'x' * i}\nPage {i}") for i in range(n)], "doc_id int, page int, text string")
        return {r["key"] for r in P.detect_furniture(pages).collect()}

    assert found(2) == set()
    assert found(3) == {"Head", "Page #"}


def test_scheme_trap(spark):
    lines = ["# One", "## Two", "FIRST THING", "SECOND THING", "THIRD THING"]
    df = spark.createDataFrame([(1, x) for x in lines], "doc_id int, line string")
    assert P.detect_scheme(P.score_schemes(df)).first()["scheme"] is None


def test_empty_and_contents_pages(spark):
    toc = "\n".join(f"Part {i} . . . . . {i}" for i in range(5))
    pages = spark.createDataFrame([(1, 1, toc), (1, 2, " "), (1, 3, "Some words here."), (2, 1, "")], "doc_id int, page int, text string")
    spans = {(r["doc_id"], r["page"]): (r["char_start"], r["char_end"]) for r in P.merged_spans(pages).collect()}
    assert spans == {(1, 1): (0, 0), (1, 2): (0, 0), (1, 3): (0, 16), (2, 1): (0, 0)}
    kept = P.parse_per_page(pages).collect()
    assert [(r["doc_id"], r["page"]) for r in kept] == [(1, 3)]
    assert P.load_stats(pages).where("doc_id = 1").first()["empty_pages"] == [2]


TEXT = "# A\nintro text\n### Deep\nfirst body\n## B\nsecond body\n## C\nthird"


def test_outline(spark):
    docs = spark.createDataFrame([(1, "src", TEXT), (2, "none", "plain")], "doc_id int, source string, text string")
    nodes = {(r["doc_id"], r["node_id"]): r for r in O.build_tree(O.find_headings(docs), docs).collect()}
    parents = {k[1]: v["parent_id"] for k, v in nodes.items() if k[0] == 1}
    assert parents == {"0000": None, "0001": "0000", "0002": "0001", "0003": "0001", "0004": "0001"}
    assert nodes[1, "0002"]["is_leaf"] and not nodes[1, "0001"]["is_leaf"] and nodes[2, "0000"]["is_leaf"]
    for (d, n), r in nodes.items():
        if d == 1 and n != "0000":
            assert TEXT[r["char_start"] : r["char_end"]].lstrip("# ").startswith(r["title"])
    assert nodes[1, "0002"]["char_end"] == TEXT.index("## B")


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, ""), (3, "word " * 300)], "doc_id int, text string")
    got = [(r["char_start"], r["char_end"]) for r in C.fixed(docs, 400, 60).where("doc_id = 1").orderBy("chunk_idx").collect()]
    assert got == [(0, 400), (340, 740), (680, 1000)]
    for size, overlap in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            C.fixed(docs, size, overlap)
    with pytest.raises(ValueError):
        C.chunk(docs, "odd")
    text = "word " * 300
    spans = [(r["char_start"], r["char_end"]) for r in C.recursive(docs, 400, 60).where("doc_id = 3").orderBy("chunk_idx").collect()]
    assert spans == C.cut(text, 400, 60) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < b and c <= b for (a, b), (c, _) in zip(spans, spans[1:]))
    assert all(s == 0 or text[s - 1] == " " for s, _ in spans)
    bounds = spark.createDataFrame([(3, 700), (3, 5000), (3, 0)], "doc_id int, char_start int")
    own = [(r["char_start"], r["char_end"]) for r in C.structural(docs, bounds, 800, 100).where("doc_id = 3").orderBy("chunk_idx").collect()]
    assert own == [(0, 700), (700, 1500)]


def units(spark, texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "scope int, unit int, text string")


def test_idf_and_bm25(spark):
    u = units(spark, ["boat", "fuel"])
    post = V.postings(u)
    stats = V.scope_stats(u, post)
    q = spark.createDataFrame([(0, 7, "boat boat nothing")], "scope int, query_id int, text string")
    s = R.bm25_scores(q, post, stats).collect()
    assert [(r["unit"], round(r["score"], 6)) for r in s] == [(0, 0.693147)]
    full = R.ranked(R.complete(R.bm25_scores(q, post, stats), q, u)).orderBy("rank").collect()
    assert [(r["unit"], r["score"]) for r in full][1] == (1, 0.0)  # units without a match are ranked
    assert V.vocabulary(post.where("unit = 0"), stats.withColumn("n_units", F.lit(1))).first()["idf"] == 1.0
    w = V.l2(V.tfidf(post, V.vocabulary(post, stats)))
    assert all(abs(r["n"] - 1) < 1e-9 for r in w.groupBy("unit").agg(F.sum(F.col("weight") ** 2).alias("n")).collect())
    assert R.ranked(full and R.complete(R.bm25_scores(q, post, stats), q, u), 0).count() == 2  # 0 means all


def test_rrf_and_rerank(spark):
    a = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "query_id int, unit int, rank int")
    b = spark.createDataFrame([(1, 0, 2), (1, 1, 1)], "query_id int, unit int, rank int")
    assert all(abs(r["score"] - (1 / 61 + 1 / 62)) < 1e-12 for r in R.rrf([(a, 1.0), (b, 1.0)]).collect())
    u = spark.createDataFrame([(0, "a1x z1x b1x"), (1, "none"), (2, "")], "unit int, text string")
    q = spark.createDataFrame([(1, "a1x b1x")], "query_id int, text string")
    short = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "query_id int, unit int")
    got = {r["unit"]: round(r["score"], 4) for r in R.rerank_scores(short, q, u).collect()}
    assert got == {0: 3.244, 1: 0.0, 2: 0.0}


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, u, i + 1) for i, u in enumerate([2, 3, 0, 1])], "query_id int, unit int, rank int")
    rel = spark.createDataFrame([(1, 0), (1, 1)], "query_id int, unit int")
    r = E.per_case(ranking, rel, 4).first()
    assert round(r["ndcg"], 4) == 0.5706 and r["recall"] == 1 and r["precision"] == 0.5 and abs(r["reciprocal_rank"] - 1 / 3) < 1e-12
    s = {x["k"]: (x["recall"], x["precision"]) for x in E.sensitivity(ranking, rel, (1, 3)).collect()}
    assert s == {1: (0.0, 0.0), 3: (0.5, 1 / 3)}


def test_post_filter_is_not_pre_filter(spark):
    s = spark.createDataFrame([(1, u, 10.0 - u, u % 2 == 1) for u in range(6)], "query_id int, unit int, score double, odd boolean")
    assert R.post_filter(R.ranked(s), F.col("odd"), 3).count() == 1
    assert R.pre_filter(s, F.col("odd"), 3).count() == 3


def test_budget_orderings_and_checks(spark):
    items = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 9, 3, 1])], "query_id int, place long, cost long")
    got = {r["cost"]: r["admitted"] for r in A.admit(items, F.lit(10).cast("long"), ["query_id"]).collect()}
    assert got == {5: True, 9: False, 3: True, 1: True}
    six = spark.range(6).withColumnRenamed("id", "place")
    order = lambda o: [r["place"] for r in six.orderBy(A.order_key(F.col("place"), F.col("place"), o)).collect()]
    assert order("edges") == [0, 2, 4, 5, 3, 1] and order("best_last") == [5, 4, 3, 2, 1, 0]
    with pytest.raises(ValueError):
        A.order_key(F.col("place"), F.col("place"), "odd")
    df = spark.createDataFrame([("fuel is [c0001] gold", "fuel log", "see [c0001, c0002] and [c9]", ["c0001"])], "a string, c string, m string, s array<string>")
    g = df.select(A.grounding("a", "c").alias("g"), A.check_citations("m", "s").alias("k"), A.check_citations("a", F.array(F.lit("c0001"))).alias("v")).first()
    assert g["g"]["coverage"] == 0.5 and g["g"]["unsupported"] == ["gold"]
    assert g["k"]["unknown"] == ["c9"] and not g["k"]["valid"] and g["v"]["valid"]


def test_size_stats_and_coverage(spark):
    c = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate([(0, 1), (1, 3), (3, 6), (4, 8)])], "doc_id int, chunk_idx int, char_start int, char_end int")
    docs = spark.createDataFrame([(1, "x" * 10)], "doc_id int, text string")
    s = E.size_stats(c).first()
    assert (s["median_size"], s["mean_size"]) == (3, 2)
    v = E.coverage(c, docs).first()
    assert (v["uncovered"], v["duplicated"], v["redundancy"]) == (2, 2, 1.0)


def _wide(spark, fan=3, depth=4):
    rows, levels = [("0000", None, False, 0)], [["0000"]]
    for d in range(1, depth + 1):
        new = []
        for p in levels[-1]:
            for _ in range(fan):
                n = f"{len(rows):04d}"
                rows.append((n, p, d == depth, d))
                new.append(n)
        levels.append(new)
    return spark.createDataFrame([(1, n, p, leaf, "same words", "same words") for n, p, leaf, _ in rows], "doc_id int, node_id string, parent_id string, is_leaf boolean, title string, summary string")


def test_beam_is_level_wide(spark):
    nodes = _wide(spark)
    q = spark.createDataFrame([(1, 1, "same words"), (2, 1, "unrelated")], "query_id int, doc_id int, question string")
    found, trace = TR.beam_search(nodes, q, beam=2, max_depth=6)
    per = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
    assert per == {1: 2, 2: 1}  # a question that meets nothing follows first children
    opened = trace.where("query_id = 1").select("at_id").distinct().count()
    assert opened <= 2 * 6
    assert TR.pruned(trace).count() == trace.where("not chosen").count()
    cut, _ = TR.beam_search(nodes, q, beam=2, max_depth=2)
    assert cut.where("query_id = 1").count() == 2  # what is open at the last level is collected


def test_summaries_from_the_leaves_up(spark):
    docs = spark.createDataFrame([(1, "manual", TEXT)], "doc_id int, source string, text string")
    nodes = TR.summarise_tree(O.build_tree(O.find_headings(docs), docs), docs)
    got = {r["node_id"]: r["summary"] for r in nodes.collect()}
    assert len(got) == 5 and all(got.values())
    assert "Deep" in got["0001"] and "intro" not in got["0001"]
    assert TR.summary_quality(nodes).where("empty").count() == 0


def test_valid_choices(spark):
    df = spark.createDataFrame([([7, -1, None, 1, 1, 0],), ([9],)], "c array<int>")
    assert [r[0] for r in df.select(TR.valid_choices("c", 3, 2)).collect()] == [[1, 0], [0]]


def test_graph():
    g = Graph().add_node("a", lambda s: {"x": s["x"] + 1}).add_node("b", lambda s: {"y": s["x"]}).add_edge("a", "b").add_edge("a", "a").set_entry_point("a")
    assert g.compile().invoke({"x": 1}) == {"x": 2, "y": 2, "trace": ["a", "b"]}
    with pytest.raises(ValueError):
        g.add_node("a", dict)
    with pytest.raises(ValueError):
        Graph().compile()
    with pytest.raises(ValueError):
        Graph().add_node("a", dict).add_edge("a", "a").set_entry_point("a").compile()


def naive_cut(text, size, overlap):
    """Spans by trying every end: the best separator first, then the furthest; a start inside a word moves back to its first letter."""
    out, at = [], 0
    while at < len(text):
        if at + size >= len(text):
            return [*out, (at, len(text))]
        low, high = at + int(size * 0.6), at + size
        found = [(rank, -e) for rank, sep in enumerate(C.SEPARATORS) for e in range(low + len(sep), high + 1) if text[e - len(sep) : e] == sep]
        end = -min(found)[1] if found else high
        out.append((at, end))
        b = end - overlap
        if b > 0 and text[b - 1].isalnum() and text[b].isalnum():
            before = [i for i in range(b) if text[i] in " \n"]
            b = before[-1] + 1 if before else b
        at = max(b, at + 1)
    return out


def test_recursive_cut_by_trying_all():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", "\U0001f600", " ", " ", "\n", "\n\n", ". ", "; ", "."]) for _ in range(rng.randint(0, 120)))
        size = rng.randint(1, 30)
        overlap = rng.randrange(size)
        assert C.cut(text, size, overlap) == naive_cut(text, size, overlap)


def test_pipelines_answer(spark):
    pages = files.sample(spark)
    questions = spark.createDataFrame([(1, "sample", "who measures fuel before each trip"), (2, "sample", "zzz qqq")], "query_id int, doc_id string, question string")
    state = pipelines.vector_index().invoke({"pages": pages, "size": 120, "overlap": 20})
    state = pipelines.vector_query().invoke(state | {"questions": questions, "trace": []})
    rows = {r["query_id"]: r for r in state["answers"].collect()}
    assert "Fuel is measured before and after each trip" in rows[1]["answer"] and rows[1]["citations"]["valid"]
    assert rows[2]["answer"] == A.NO_MATCH
    tree = pipelines.tree_index().invoke({"pages": pages})
    tree = pipelines.tree_query().invoke(tree | {"questions": questions, "trace": []})
    rows = {r["query_id"]: r for r in tree["answers"].collect()}
    assert "Fuel is measured" in rows[1]["answer"]
    fit = reports.tree_report(tree["nodes"]).first()
    assert fit["n_leaves"] == 3 and fit["median_leaf"] > 0
    assert reports.cleaning_report(pages, tree["documents"]).first()["kept"] > 0.5


def test_svd_keeps_cosines_close(spark):
    u = units(spark, ["boat fuel log", "boat fuel", "garden path", "garden gate path"])
    post = V.postings(u)
    raw = V.tfidf(post, V.vocabulary(post, V.scope_stats(u, post)))
    w = V.project(raw.withColumn("unit", F.col("unit").cast("string")), V.svd(raw, 2))
    pair = {(r["a"], r["b"]): r["score"] for r in V.pair_scores(w.withColumn("unit", F.col("unit").cast("int"))).collect()}
    assert pair[0, 1] > 0.9 and pair[2, 3] > 0.9 and abs(pair.get((0, 2), 0.0)) < 0.2


def test_text_source_sinks_and_registry(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\n" + b"\n".join(b"l%d" % i for i in range(50)) + b"\xff")
    rows = files.load(spark, str(tmp_path / "a.txt")).orderBy("page").collect()
    assert [r["page"] for r in rows] == [1, 2] and rows[0]["text"].startswith("one\ntwo\nl0") and rows[0]["source"] == "a.txt"
    files.write_artifacts({"pages": files.sample(spark)}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/pages")).count() == 4
    with pytest.raises(ImportError):
        files.load(spark, "x.pdf")
    with pytest.raises(ValueError):
        files.load(spark, "x.txt", "odd")


def test_stream_equals_batch(spark, tmp_path):
    files.sample(spark).select("doc_id", "page", "text").write.parquet(str(tmp_path / "in"))
    q = stream.write(stream.cleaned(stream.read(spark, str(tmp_path / "in"), "doc_id string, page int, text string")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    want = {r["page"]: r["text"] for r in stream.cleaned(files.sample(spark)).collect()}
    assert {r["page"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_angle_and_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(V.angle(V.cosine(F.col("a"), F.col("b"))).alias("x"), V.cosine(F.col("a"), F.col("z")).alias("y"), V.euclidean(F.col("a"), F.col("b")).alias("e")).first()
    assert abs(r["x"] - 45) < 1e-9 and r["y"] == 0.0 and r["e"] == 1.0 and math.isfinite(r["x"])


def test_outline_of_more_than_9999_headings(spark):
    lines = [f"# t{i}" for i in range(9_998)] + ["# up", "## low one", "## low two", "# last"]
    docs = spark.createDataFrame([(1, "s", "\n".join(lines))], "doc_id long, source string, text string")
    nodes = {r["node_id"]: r for r in O.build_tree(O.find_headings(docs), docs).collect()}
    assert len(nodes) == 10_003 and {f"{i:04d}" for i in range(10_003)} == set(nodes)
    assert [(nodes[x]["title"], nodes[x]["parent_id"]) for x in ("9999", "10000", "10001", "10002")] == [("up", "0000"), ("low one", "9999"), ("low two", "9999"), ("last", "0000")]
    assert {k for k, r in nodes.items() if not r["is_leaf"]} == {"0000", "9999"}


def test_relevance_and_rank_over_all_documents(spark, tmp_path):
    from lectern.plans import queries as Q

    item = "alpha beta gamma delta"
    short = [f"{item} {item} alpha gamma n{i}" for i in range(25)]  # all hold the item
    late = [f"x{item}x " + " ".join(f"pad{i}w{j}" for j in range(200)) for i in range(3)]  # hold it far down
    other = ["beta gamma beta gamma alpha", "gamma delta", "nothing of it"]
    only = ["rho sigma tau " * 3 + str(i) for i in range(22)] + ["upsilon rho sigma tau phi " + "pad " * 300]
    docs = list(enumerate([*short, *late, *other, *only]))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "upsilon rho sigma tau phi pad"), (3, "sigma rho tau"), (4, ""), (5, "tau pad")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    queries = dict(spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect())
    want = {q: sum(t in x for _, x in docs) for q, t in queries.items() if t and any(t in x for _, x in docs)}
    ranking, rel = Q._judged(spark, str(tmp_path))
    assert ranking.where("query_id = 1").count() > 20
    got = {r["query_id"]: r for r in Q.retrieval_cases(spark, str(tmp_path)).collect()}
    assert {q: r["n_relevant"] for q, r in got.items()} == want and want[1] == 28
    assert rel.where("query_id = 5").count() == want.get(5, 0)
