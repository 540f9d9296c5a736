"""Each operator on small tables with nulls, empty and repeated rows, ties and further columns, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import kernel as K
from lectern.llm import op01_jaccard_join as op1
from lectern.llm import op02_packing as op2
from lectern.llm import op03_vector_index as op3
from lectern.llm import op04_paragraphs as op4
from lectern.llm import op05_html_text as op5
from lectern.llm import op06_preferences as op6
from lectern.llm import op07_exact_substrings as op7
from lectern.llm import op08_license_scan as op8
from lectern.llm import op09_decontaminate as op9
from lectern.llm import op10_toxicity as op10
from lectern.llm.common import components, written

SCHEMA = "doc_id long, text string, a long, b string, cid long, row string"


def corpus():
    """Texts with exact and near copies, shared passages, nulls and repeated rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéo") for _ in range(rng.randint(2, 6)))
    vocab = [word() for _ in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    for i in range(12):
        w = texts[i % 4].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w) + ("\n" + passage if i % 3 == 0 else ""))
    texts += [texts[0], None, "", "  \n ", "one two", "One  two", "a" * 500, "x " * 300, passage + " tail", "ÄÖ " * 120]
    rows = [(i, t, 1, "x", 2, "y") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(keys, linked):
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_words_and_shingles():
    texts = ["One two  three\tfour five six", "", "é à", "x"]
    buf, off = K.raw(pa.array([*texts, None]))
    h, woff, a, b = K.words(buf, off)
    assert [bytes(buf[i:j]) for i, j in zip(a, b)] == [w for t in texts for w in t.encode().split()]
    s, soff = K.shingles(h, woff)
    assert np.diff(soff).tolist() == [2, 0, 1, 1, 0]
    parts = K.words(buf, off, most=7)
    assert (parts[0] == h).all() and (parts[1] == woff).all()


def test_op1(docs, empty):
    rows = corpus()
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    want = classes(sorted(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = op1.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (want[i], len(sets[i])) for i in want}
    assert op1.jaccard_join(empty).count() == 0


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def test_op2(docs, empty, paths):
    enc = op2.encoder(paths[0])
    rows = corpus()
    ids = {i: np.append(enc([t or ""])[0], 0).astype("<u4") for i, t, *_ in rows}
    got = op2.pack(docs, *paths, window=64).collect()
    seen, fill = Counter(), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    times = Counter(i for i, *_ in rows)
    assert seen == {i: len(x) * times[i] for i, x in ids.items()}
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert op2.pack(empty, *paths).count() == 0


def test_op2_plan_and_ids(paths):
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.geometric(0.01, 5000), 200), minlength=257)
    plan = op2.plan(counts, 256)
    used = Counter()
    for pattern, m in plan:
        assert sum(k * n for k, n in pattern) <= 256
        for k, n in pattern:
            used[k] += n * m
    assert all(used[k] == c for k, c in enumerate(counts) if k)
    room = sum(m for _, m in plan) * 256
    assert 1 - sum(k * c for k, c in enumerate(counts)) / room < 0.02
    texts = ["Hello  world, it's 3\n\n fine", "<|endoftext|> a", "", "ünï " * 50]
    assert all((x == y).all() for x, y in zip(op2.encoder(paths[0])(texts), op2.encoder(*paths)(texts)))
    long = "some words and more, " * 40_000
    assert (op2.encoder(*paths)([long])[0] == op2.encoder(paths[0])([long[:200_000] + long[200_000:]])[0]).all()


def test_op3(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 16))
    near = base[:40] + 0.1 * rng.standard_normal((40, 16))
    vec = [*base.tolist(), *near.tolist(), base[0].tolist(), (2 * base[1]).tolist(), None, [0.0] * 16, [float("nan")] * 16, [1.0] * 3, [None] * 16]
    rows = [(i, v, 1) for i, v in enumerate(vec)]
    got = {r["vec_id"]: r for r in op3.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")).collect()}
    good = [i for i, v in enumerate(vec[:342])]
    x = np.array([vec[i] for i in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    want = classes(good, lambda a, b: s[a, b] >= 0.9)
    n = (s >= 0.9).sum(1) - 1
    assert sum(got[i]["n_links"] for i in good) >= 0.9 * n.sum()
    assert all(got[i]["n_links"] <= n[i] for i in good)
    assert sum(got[i]["component_id"] == want[i] for i in good) >= 0.95 * len(good)
    for i in range(342, len(vec)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert op3.dedup_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_op3_lengths_and_magnitudes(spark):
    big = [1e300, -1e300, 0.0, 1e299]
    vec = [big, [x * 1e-305 * 1e-300 for x in big], [1.0, -1.0, 0.0, 0.1], [5e-324, 0.0, 0.0, 0.0], [1.7976931348623157e308, 0.0, 0.0, 0.0], [1.0, 2.0], [3.0, 6.1], [2.0, -1.0], [float("inf")] * 4, [1.0, None], [], [7.0], [0.5]]
    rows = list(enumerate(vec))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op3.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (0, 10), 11: (1, 11), 12: (1, 11)}


def op4_pieces(text):
    """Words of each paragraph of a text, by the definition: a cut before the least 5-word shingle of every CUT in a row, the first of equals."""
    w = (text or "").encode().lower().split()
    buf = np.frombuffer((text or "").encode(), np.uint8)
    h, woff, _, _ = K.words(buf, np.array([0, len(buf)]))
    s = (K.shingles(h, woff, 5)[0] & ~np.uint64(0xFFFFFFF)).tolist() if len(w) >= 5 else []
    cuts = sorted({i + min(range(op4.CUT), key=lambda j: (s[i + j], j)) for i in range(len(s) - op4.CUT + 1)})
    at = [0] + [c for p, c in zip([-9] + cuts, cuts) if c - p >= 5] + [len(w)]
    return [tuple(w[x:y]) for x, y in zip(at, at[1:]) if y > x]


def op4_brute(texts, least_run=op4.LEAST_RUN):
    """texts {id: text} -> {id: numbers of the paragraphs that go}."""
    pieces = {i: op4_pieces(t) for i, t in texts.items()}
    occ = defaultdict(list)
    for i, ps in pieces.items():
        for j, w in enumerate(ps):
            if len(w) >= 5:
                occ[w].append((i, j))
    sets = {w: frozenset(w[i : i + 5] for i in range(len(w) - 4)) for w in occ}
    same = classes(sorted(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    groups = defaultdict(list)
    for w, c in same.items():
        groups[c] += occ[w]
    gone = defaultdict(list)
    for i, j in sorted(x for places in groups.values() for x in sorted(places)[1:]):
        gone[i].append(j)
    for i, js in gone.items():
        runs = [[js[0]]]
        for j in js[1:]:
            if j - runs[-1][-1] > 2:
                runs.append([])
            runs[-1].append(j)
        gone[i] = [j for r in runs if sum(len(pieces[i][k]) for k in r) >= least_run for j in r]
    return {i: gone.get(i, []) for i in texts}


def test_op4(docs, empty):
    rows = {r[0]: r[1] for r in corpus()}
    gone = op4_brute(rows)
    assert sum(map(bool, gone.values())) > 5
    got = op4.decisions(docs).collect()
    assert len(got) == len(corpus())
    assert {r["doc_id"]: r["removed"] for r in got} == gone
    cut = op4.cut_paragraphs(docs)
    assert cut.columns == docs.columns and cut.count() == len(corpus())
    for r in cut.collect():
        left = [w for j, p in enumerate(op4_pieces(rows[r["doc_id"]])) if j not in gone[r["doc_id"]] for w in p]
        assert (r["text"] or "").encode().lower().split() == left and (r["text"] is None) == (rows[r["doc_id"]] is None)
        assert gone[r["doc_id"]] or r["text"] == rows[r["doc_id"]]
    assert op4.decisions(empty).count() == 0 and op4.cut_paragraphs(empty).count() == 0


def test_op4_null_ids_clashing_columns_long_texts(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    long = " ".join(f"v{rng.randrange(90000)}" for _ in range(400_000))
    rows = [(None, text, 1, 2, 3), (7, text, 1, 2, 3), (8, long, 1, 2, 3), (9, long[: len(long) // 2], 1, 2, 3)]
    got = {r["doc_id"]: r["text"] for r in op4.cut_paragraphs(spark.createDataFrame(rows, "doc_id long, text string, removed int, carry int, `h.h` int")).collect()}
    # the place with an id stays; of the shorter half only words about its end are its own
    assert got[7] == text and got[None] == "" and got[8] == long and len(got[9]) < 400


def test_op4_passages_anywhere_and_notices(spark):
    """Passages of over 50 words go from all documents but one, wherever they stand; documents that share short lines stay whole."""
    rng = random.Random(9)
    some = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    passages, notices = [some(rng.randint(60, 120)) for _ in range(20)], [some(14) for _ in range(20)]
    rows, clean = [], []
    for i in range(200):
        rows.append((i, f"{some(rng.randint(5, 200))} {passages[i % 20]} {some(40)}"))
        clean.append((1000 + i, f"{some(80)}\n{notices[i % 20]}\n{some(60)}"))
    got = {r["doc_id"]: r["n_removed"] for r in op4.decisions(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert sum(got[i] > 0 for i in range(20, 200)) >= 178 and not any(got[i] for i in range(20))
    assert sum(got[1000 + i] > 0 for i in range(200)) <= 10


def test_op4_templates(spark):
    """Links among 1,500 pairs of a template's variants: all of them but what the bands' recall allows."""
    rng = random.Random(5)
    hub = [f"h{i}" for i in range(24)]
    rows = []
    for i in range(1500):
        # two members of a pair share an own start, which sets them apart from other pairs
        own = [f"o{i}x{j}" for j in range(9)]
        a, b = own + hub[9:], own + hub[9:23] + [f"e{i}"]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    text = spark.createDataFrame(rows, "row long, text string")
    places = text.select("row", F.col("row").alias("doc_id"), "text").mapInArrow(op4._places, op4._PLACES).where("piece >= 0")
    id_of = {r["row"]: r["h"] for r in places.collect()}
    assert len(id_of) == len(rows)
    found = {frozenset((r["a"], r["b"])) for r in op4.paragraph_links(text, places).collect()}
    missed = sum(frozenset((id_of[2 * i], id_of[2 * i + 1])) not in found for i in range(1500))
    assert missed <= 1500 * 0.01


def test_op4_links_all_pairs_of_large_bands(spark):
    """Variants that are linked only through their template, more than a small band holds."""
    rng = random.Random(5)
    rows = []
    for c in range(4):
        hub = [f"w{c}x{i}" for i in range(24)]
        for v in range(30):
            rows.append([f"v{c}x{v}x{p}" if p in (rng.randrange(2), 23 - rng.randrange(2)) else w for p, w in enumerate(hub)])
        rows.append(hub)
    text = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "row long, text string")
    places = text.select("row", F.col("row").alias("doc_id"), "text").mapInArrow(op4._places, op4._PLACES).where("piece >= 0")
    id_of = {r["row"]: r["h"] for r in places.collect()}
    sets = [shingle_set(" ".join(w)) for w in rows]
    want = classes(range(len(rows)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    edges = {(r["a"], r["b"]) for r in op4.paragraph_links(text, places).collect()}
    got = classes(range(len(rows)), lambda a, b: id_of[a] == id_of[b] or (id_of[a], id_of[b]) in edges or (id_of[b], id_of[a]) in edges)
    assert got == want and len(set(want.values())) < 100


def test_op1_large_cells_opened_anew(spark, monkeypatch):
    """Members of one cell that share much and are linked in few pairs, found after the cell is opened by further shingles."""
    monkeypatch.setattr(op1, "LARGE", 2)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(24)]
    texts = []
    for i in range(60):
        tail = [f"t{i // 2}x{j}" for j in range(9)]
        texts.append(" ".join(base + tail + ([f"z{i}"] if i % 2 else [])))
    texts += [" ".join(base[: rng.randint(10, 24)] + [f"q{i}x{j}" for j in range(9)]) for i in range(30)]
    sets = [shingle_set(t) for t in texts]
    want = classes(range(len(texts)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in op1.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 20


def test_op1_wide_layers_do_not_meet_pair_by_pair(spark, monkeypatch):
    """A ball of near copies and many texts around it: few pairs are verified, and the classes are those of all links."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    other = base[:]
    for i in range(0, 150, 9):
        other[i] = f"o{i}"

    def edited(words, places):
        w = words[:]
        for i in rng.sample(range(150), places):
            w[i] = f"e{i}x{rng.randrange(3)}"
        return " ".join(w)

    texts = [" ".join(base)] + [edited(base, rng.choice([1, 2])) for _ in range(200)] + [edited(base, rng.randint(5, 7)) for _ in range(200)]
    texts += [edited(other, 2) for _ in range(10)]
    sets = [shingle_set(t) for t in texts]
    want = classes(range(len(texts)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    seen = []
    verified = op1._verified
    monkeypatch.setattr(op1, "_verified", lambda pairs, sets: (seen.append(pairs), verified(pairs, sets))[1])
    monkeypatch.setattr(op1, "drop", lambda df: None)
    made = written(op1.index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "sets")
    edges = written(op1.links.__wrapped__(made.where("kind = 1").select("cid", "n", "lone", "prefix", "tokens")), "edges")
    # the last call verifies what the layers and the rest of the cells gave
    assert seen[-1].count() < 60 * len(texts)
    comp = {r["id"]: r["component"] for r in components(edges).collect()}
    of = {r["doc_id"]: r["cid"] for r in made.where("kind = 0").collect()}
    got = defaultdict(set)
    for i in want:
        got[comp.get(of[i], of[i])].add(i)
    assert {i: min(g) for g in got.values() for i in g} == want and len(set(want.values())) > 5


def test_op4_bands_are_tuned():
    for share in (0.5, 0.75, 0.9):
        bands, rows = op4.tuned(share, 0.99)
        assert 1 - (1 - share**rows) ** bands >= 0.99


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/x">X</a></li></ul></nav><div class="cookie-banner">We use cookies, a long notice about cookies.</div>
<!-- ad --><div class="ad">Buy &lt;this&gt; thing now, it is very good and cheap.</div><aside>Also read that</aside>
<article><h1>A   title &amp; more</h1><p>First&nbsp;paragraph<br>goes on, with <b>bold</b> and <a href="/l">a link</a>.<p>Second &#233; one.<ul><li>point</ul><form><input value="q">Search</form></article>
<section id="comments"><p>Nice article, I liked the long discussion of everything in it, thanks a lot for writing it.</p></section><footer>&copy; us</footer>"""


def test_op5(spark):
    want = "A title & more\nFirst paragraph goes on, with bold and a link.\nSecond é one.\npoint"
    assert op5.extract(PAGE) == want
    assert op5.extract(PAGE.replace("article", "div")).endswith("point")
    assert [op5.extract(x) for x in (None, "", "<html>", "<!-- x", "<p", "<script>x")] == [""] * 6
    assert op5.extract("plain  text") == "plain text" and op5.extract("<p>a < b</p>") == "a < b"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert op5.extract(deep) == "deep"
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (2, None, None, 5)]
    got = op5.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, len(want)), (2, 0), (2, 0)]
    assert op5.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op5_split_article():
    say = "This is a sentence of the article with quite a few words in it, so that it is dense text. "
    p = lambda a, b: "".join(f"<p>{i} {say * 3}</p>" for i in range(a, b))
    links = '<div><a href="/">Home</a> <a href="/a">All of it</a> <a href="/b">More</a></div>'
    text = lambda a, b: [f"{i} {say * 3}".strip() for i in range(a, b)]
    sections = f"<div>{p(0, 5)}</div><div>{p(5, 8)}</div><div>{p(8, 10)}</div>"
    for page in (sections, f"<div>{sections}</div>", f"<div><div>{p(0, 5)}</div><div>{p(5, 10)}</div></div>"):
        assert op5.extract(f"<body>{links}{page}{links}</body>").split("\n") == text(0, 10)
    assert op5.extract(f"<body>{links}<div><h1>A title</h1></div><div>{p(0, 5)}</div>{links}").split("\n") == ["A title", *text(0, 5)]
    own = f"<div><div>{p(0, 5)}</div>own {say * 3}<b>and</b> bold<div>{p(5, 8)}</div></div>"
    assert op5.extract(f"<body>{links}{own}{links}").split("\n") == [*text(0, 5), f"own {say * 3}and bold", *text(5, 8)]
    inline = f"<div><p>Some text <span>in <b>bold {say}</b></span> and on.</p>{p(0, 5)}</div><div>{p(5, 7)}</div>"
    assert op5.extract(f"<body>{links}{inline}{links}").split("\n")[0] == f"Some text in bold {say}and on."


def test_op6(spark):
    rows = [
        (0, 0, "user", "q", 1), (0, 1, "assistant", "yes", 1), (0, 2, "user", "more", 1), (0, 3, "assistant", "good", 1), (0, 3, "assistant", "good", 1),
        (1, 0, "user", "q", 1), (1, 1, "assistant", "yes", 1), (1, 2, "assistant", "bad<|im_end|>", 1),
        (2, 0, None, None, 1), (3, 0, None, None, 1), (4, 0, "user", "alone", 1), (None, 0, "user", "x", 1),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    pairs = lambda t: op6.preferences(t, F.floor(F.col("conv_id") / 2), F.pmod(F.col("conv_id"), F.lit(2)) == 1)
    got = {r["pair_id"]: r for r in pairs(turns).collect()}
    assert set(got) == {0, 1}
    r = got[0]
    assert r["n_common"] == 2 and r["prompt"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    lo, hi = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][lo:hi] == "good<|im_end|>"
    lo, hi = map(int, r["rejected_mask"].split(":"))
    assert r["rejected"][lo:hi] == "bad< |im_end|><|im_end|>"
    assert (got[1]["chosen"], got[1]["rejected"], got[1]["n_common"]) == ("", "", 1)
    assert pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def cut_by_hand(texts, length):
    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_op7_windows_travel_in_few_bytes():
    """Open windows are dealt out in less than 16 bytes each, and those that occur twice come back by their numbers."""
    rng = random.Random(13)
    text = bytes(rng.randrange(97, 123) for _ in range(80_000))
    n = len(text) - 199
    spans = np.array([[0, n - 1]], np.int64).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([5, -7], pa.int64()), pa.array([text, text], pa.binary()), pa.array([spans] * 2, pa.binary())], names=["row", "text", "open"])
    sent = [pa.Table.from_batches([b]) for b in op7._deal_windows(3, 200)([batch])]
    assert sum(len(x) for t in sent for x in t.column("payload").to_pylist()) < 16 * 2 * n
    got = defaultdict(set)
    for t in sent:
        for part in t.column("part").to_pylist():
            reply = op7._judge_windows(3)(t.filter(pa.array([x == part for x in t.column("part").to_pylist()])))
            for x in reply.column("payload").to_pylist():
                row, number, _ = op7.unpack(x, np.int64, np.int32, np.int8)
                for r, k in zip(row.tolist(), number.tolist()):
                    got[r].add(k)
    assert got == {5: set(range(n)), -7: set(range(n))}


@pytest.mark.parametrize("length", [200, 60])
def test_op7(docs, empty, length):
    rows = corpus()
    want = sorted((i, *w) for (i, *_), w in zip(rows, cut_by_hand([(t or "").encode() for _, t, *_ in rows], length)))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op7.remove_repeats(docs, length).collect())
    assert got == want and any(w[2] for w in want)
    assert op7.remove_repeats(empty, length).count() == 0


def test_op7_anchors_fill_all_parts():
    """Anchors are least hashes: dealt out by their value, nearly all of them would meet in one part."""
    rng = np.random.default_rng(5)
    texts = ["".join(chr(97 + x) for x in rng.integers(0, 26, 4000)) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts, pa.string())], names=["row", "text"])
    size = Counter()
    for b in op7._deal_anchors(16, 200)(iter([batch])):
        for p, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            size[p] += len(payload)
    assert len(size) == 16 and max(size.values()) < 2 * sum(size.values()) / 16


def test_op7_text_and_long(spark, monkeypatch):
    monkeypatch.setattr(op7, "SEGMENT", 1000)
    rng = np.random.default_rng(0)
    long = "".join(chr(97 + i) for i in rng.integers(0, 26, 5000))
    rows = [(1, long, 0, "x"), (2, "é" * 30 + long[900:1500] + "#tail", 0, "x"), (3, "short", 0, "x")]
    roll, text, pos, first, last = op7.anchors(np.frombuffer(long.encode(), np.uint8), np.array([0, 5000]))
    assert (last - first + 1).sum() == 4801 and (pos >= first).all() and (pos + 32 <= first + 200).all()
    out = {r["doc_id"]: r for r in op7.cut_documents(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string")).collect()}
    assert out[2]["text"] == "é" * 30 + "#tail" and out[2]["n_chars"] == 35 and out[1]["n_chars"] == 4400 and out[3]["text"] == "short"


def test_op8(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and of its associated documentation files"
    rows = [
        (1, "Released under the MIT License. And under the mit license", 1), (2, mit, 1), (3, "Apache License, Version 2.0", 1), (4, None, 1), (5, "", 1),
        (6, "cc by ünc", 1), (6, "cc by ünc", 1), (7, "CC-BY-NC", 1), (None, "cc by nc", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int")
    got = defaultdict(list)
    for r in op8.license_scan(df).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[6]) == 2
    one = got[1][0]
    assert (one["n_words"], one["n_base"], one["first_word"], one["last_word"], one["base_labels"], one["score"]) == (10, 2, 1, 6, "mit", 1.0)
    assert got[2][0]["base_labels"] == "" and got[2][0]["labels"] == "mit" and 0.6 <= got[2][0]["score"] < 1
    assert got[3][0]["base_labels"] == "apache-2" and got[7][0]["labels"] == "cc-by-nc" and got[None][0]["n_base"] == 1
    for i in (4, 5):
        assert (got[i][0]["n_words"], got[i][0]["n_base"], got[i][0]["first_word"], got[i][0]["labels"], got[i][0]["score"]) == (0, 0, None, "", 0.0)
    assert got[6][0]["labels"] == ""
    assert {(r["doc_id"], r["label"]) for r in op8.license_spans(df).collect()} >= {(1, "mit"), (2, "mit"), (3, "apache-2")}
    assert op8.license_scan(df.limit(0)).count() == 0


def test_op9(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)] + ["the", "of"] * 20
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(20) + "? " + say(8) + ".") for i in range(60)]
    docs = [(i, say(rng.randint(5, 400)), 1) for i in range(40)]
    want = set()
    for i in range(12):
        d = say(150).split()
        at = rng.randrange(len(d))
        text = " ".join(d[:at] + [items[i][1].upper()] + d[at:])
        docs.append((100 + i, text, 1))
        want.add((100 + i, i))
    half = items[20][1].split()[:9]
    docs += [(200, " ".join(half) + " " + say(60), 1), (201, None, 1), (202, "", 1), (203, items[30][1], 1), (203, items[30][1], 1)]
    want.add((203, 30))
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    q = spark.createDataFrame([*items, (90, None), (91, ""), (None, "x")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in op9.leaks(d, q).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in op9.leaks(d, q, block=10).collect()} == want
    assert op9.leaks(d, q.limit(0)).count() == 0 and op9.leaks(d.limit(0), q).count() == 0


def test_op9_finds_what_brute_force_finds():
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(150)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [" ".join(say(rng.randint(6, 25))) for _ in range(70)]
    index = op9.Index(list(range(70)), items)
    texts = []
    for _ in range(120):
        w = say(rng.randint(1, 120))
        if rng.random() < 0.6:
            own = rng.choice(items).split()
            own = [x if rng.random() > 0.2 else rng.choice(vocab) for x in own]
            at = rng.randrange(len(w))
            w[at:at] = own
        texts.append(" ".join(w))
    buf, off = K.raw(pa.array(texts))
    h, woff, _, _ = K.words(buf, off, K.ALNUM)
    found = set(zip(*(x.tolist() for x in index.candidates(h, woff))))
    for t in range(len(texts)):
        for at in range(woff[t], max(woff[t] + 1, woff[t + 1]), index.longest):
            passage = h[at : min(at + 2 * index.longest, woff[t + 1])]
            for i in range(70):
                if index.verify(passage, i)[0] >= index.threshold[i]:
                    assert (at, int(i)) in found


def test_op9_blocks_do_not_change_results(spark):
    rng = random.Random(11)
    vocab = [f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 60)))) for i in range(60)] + [(60, ""), (61, None), (3, "w1 w2 w3 w4 w5 w6 w7 w8")]
    docs = []
    for d in range(120):
        w = rng.choice(items)[1] or ""
        w = w.split()
        for _ in range(rng.randint(0, len(w) // 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)  # some of them near the threshold
        docs.append((d, " ".join([rng.choice(vocab) for _ in range(40)] + w + [rng.choice(vocab) for _ in range(40)])))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, parts = ({tuple(r) for r in op9.leaks(docs, items, b).collect()} for b in (4_000, 9))
    assert len(whole) > 50 and whole == parts
    none = spark.createDataFrame([(1, ""), (2, None)], "item_id long, text string")
    assert op9.leaks(docs, none, 1).count() == 0


def test_op10(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["vile", "scummy", "vileness"])
        rows.append((i, " ".join(w), 7))
        if i < 500:
            labels.append((i, int(bad)))
    rows += [(1000, None, 7), (1001, "", 7), (None, "vile", 7), (0, rows[0][1], 7)]
    labels += [(None, 1), (3, None), (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = op10.train(docs, lab)
    got = op10.score(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    unseen = [r for r in got if r["doc_id"] is not None and 500 <= r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in unseen) >= 95
    clean = op10.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() < len(rows)
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", op10.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items() if i is not None) and held[None] is False
    none = op10.train(docs, lab.limit(0))
    assert all(r["predicted"] == 0 for r in op10.score(docs.select("doc_id", "text"), none).collect())
    assert op10.score(docs.select("doc_id", "text").limit(0), model).count() == 0


def test_op10_swaps_do_not_move_scores():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(400):
        w = list(rng.choice(words, 30))
        if i % 2:
            w[0:2] = ["vile", "scum"]
        # one group is mentioned mostly where the label is 1
        w.append("muslim" if (i % 2) == (rng.random() < 0.9) else "christian")
        texts.append(" ".join(w))
    y = np.array([i % 2 for i in range(400)], float)
    buf, off = K.raw(pa.array(texts))
    ids, woff = op10._features(buf, off)
    x = []
    for i in range(400):
        u, c = np.unique(ids[woff[i] : woff[i + 1]].ravel(), return_counts=True)
        x.append((u.astype(np.int32), (c / np.sqrt(woff[i + 1] - woff[i])).astype(np.float32)))
    gap = lambda m: abs(float(np.diff(m.logits(*K.raw(pa.array(["a muslim man", "a christian man"]))))[0]))
    assert gap(op10.fit(x, y, fair=5.0)) < gap(op10.fit(x, y, fair=0.0))


def test_queries_match_sql(spark, sf):
    import duckdb

    from lectern.llm import queries as Q

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in Q.SQL.items():
        want = con.execute(sql).df()
        got = Q.QUERIES[name](spark, sf).toPandas()
        cols = sorted(want.columns)
        key = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).map(lambda v: int(v) if isinstance(v, float) and v == int(v) else v).values.tolist()))
        assert cols == sorted(got.columns) and key(got) == key(want)


def test_pipeline(spark, sf):
    import corpus_pipeline as C
    from lectern.llm.common import written

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    before = docs.count()
    for name, stage in C.STAGES[:-1]:
        out = written(stage(spark, docs, sf), "test")
        assert out.columns == docs.columns, name
        docs, n = out, out.count()
        assert 0 < n <= before
        before = n
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_copies", "substrings", "decontamination", "packing"]


def test_pipeline_decides_by_row(spark, sf):
    import corpus_pipeline as C

    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    a, b, c, e = (say(100) for _ in range(4))
    rows = [(3, a), (5, a + " end"), (5, b), (None, c), (None, a + " more"), (None, e), (9, e + " end"), (9, e + " end"), (11, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = C.toxicity(spark, docs, sf).collect()
    assert [r for r in clean if r["doc_id"] is None]
    kept = [tuple(r) for r in C.near_copies(spark, docs, sf).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (None, c), (9, e + " end"), (11, None), (None, None)], key=str)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(1, a + " " + item), (1, b), (None, c), (None, item)]
    left = C.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted((tuple(r) for r in left), key=str) == sorted([(1, b), (None, c)], key=str)
