"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index holds the items' words, document frequencies over all items and, for each (word, item),
the BM25 impact; items stand in blocks with the greatest impact of each word in the block. Texts
are cut into segments as long as the longest item of the index, and two neighbouring segments are a
passage, so any place as long as an item lies in one passage whole.

Retrieval is by upper bounds: an item's words of least impact, which together can't reach the
threshold, open no candidate (MaxScore); for blocks whose summed block maxima stay under the least
threshold in the block no item is looked at (block-max); what is left is scored in full, with the
set of the passage's words. The threshold is a share of the score an item gets from its own words.
No candidate is cut off. A retrieved item leaks when enough of its question and of its answer
stands in the passage: words covered by 3-word runs that both share.

Items come to the driver in blocks of about `block` items, each sent to all executors with a scan
of its own; so what is broadcast has a bound, however many items there are. Where there are several
blocks, what is taken over all items (their number, mean and greatest length, document frequencies)
is counted by Spark and given to each block, so scores and passages don't depend on the blocks. Null or empty texts
and items leak nothing; rows without an id are left out; repeated items give a row each, repeated
rows of a document one. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import table, written

K1, B = 1.2, 0.75
SHARE = 0.6
COVER = 0.5
RUN = 3
WORDS = "part int, n long, terms array<long>"
LEAKS = "doc_id long, item_id long, score double, question_cover double, answer_cover double, first_word long"
_SENTENCE = re.compile(r"[.?!:;]\s+(?=\S)")


def _split(text: str) -> int:
    """Bytes of the question: all but the last sentence, or three quarters of the words where that leaves fewer than three words on a side."""
    cuts = [m.end() for m in _SENTENCE.finditer(text)]
    for c in reversed(cuts):
        if len(text[c:].split()) >= 3 and len(text[:c].split()) >= 3:
            return len(text[:c].encode())
    w = [m.end() for m in re.finditer(r"\S+", text)]
    return len(text[: w[max(0, len(w) * 3 // 4 - 1)]].encode()) if w else 0


class Overall(NamedTuple):
    """Of all items that have words: their number, words in all and in the longest; terms (ascending) with document frequencies, those of a block at least."""

    items: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """The index of a block of items; without `overall` the block is all there is."""

    def __init__(self, ids: list[int], texts: list[str], share: float = SHARE, size: int = 32, overall: Overall | None = None):
        col = pa.array(texts, pa.string())
        buf, off = K.raw(col)
        h, woff, _, ends = K.words(buf, off, K.ALNUM)
        n = np.diff(woff)
        order = [i for i in np.argsort(n, kind="stable") if n[i]]
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.items = [h[woff[i] : woff[i + 1]] for i in order]
        self.question = np.array([np.searchsorted(ends[woff[i] : woff[i + 1]], off[i] + _split(texts[i]), "right") for i in order], np.int64)
        self.longest = overall.longest if overall else int(n.max()) if len(order) else 0
        if not order:
            return
        length = n[order].astype(float)
        item = np.repeat(np.arange(len(order)), n[order])
        pair, tf = np.unique(np.stack([np.concatenate(self.items), item.astype(np.uint64)], 1), axis=0, return_counts=True)
        self.terms, term, df = np.unique(pair[:, 0], return_inverse=True, return_counts=True)
        of = pair[:, 1].astype(np.int64)
        count, mean = len(order), int(n.sum()) / len(order)
        if overall:
            count, mean, df = overall.items, overall.words / overall.items, overall.df[np.searchsorted(overall.terms, self.terms)]
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[of] / mean))
        self.self_score = np.bincount(of, impact, len(order))
        self.threshold = share * self.self_score
        # postings by term
        by = np.lexsort((of, term))
        self.post_item, self.post_impact = of[by], impact[by]
        self.post_at = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.terms)))))
        # the least impacts that stay together under half the threshold open no candidate
        slack = np.zeros(len(order))
        essential = np.ones(len(by), bool)
        group = np.argsort(self.post_item, kind="stable")
        cut = np.searchsorted(self.post_item[group], np.arange(len(order) + 1))
        for i in range(len(order)):
            self._weak(group[cut[i] : cut[i + 1]], i, essential, slack)
        self.least = self.threshold - slack
        keep = np.flatnonzero(essential)
        t = np.repeat(np.arange(len(self.terms)), np.diff(self.post_at))[keep]
        self.open_item, self.open_impact = self.post_item[keep], self.post_impact[keep]
        self.open_at = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=len(self.terms)))))
        self.opens = np.diff(self.open_at) > 0
        # block maxima over the essential postings
        self.blocks = -(-len(order) // size)
        self.block_of = np.arange(len(order)) // size
        self.block_least = np.array([self.least[self.block_of == b].min() for b in range(self.blocks)])
        self.block_max = np.zeros((len(self.terms), self.blocks), np.float32)
        np.maximum.at(self.block_max, (t, self.block_of[self.open_item]), self.open_impact.astype(np.float32))
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.terms[self.opens] >> np.uint64(42)).astype(np.int64)] = True

    def _weak(self, own: np.ndarray, i: int, essential: np.ndarray, slack: np.ndarray) -> None:
        up = own[np.argsort(self.post_impact[own], kind="stable")]
        run = np.cumsum(self.post_impact[up])
        weak = np.searchsorted(run, 0.5 * self.threshold[i])
        essential[up[:weak]] = False
        slack[i] = run[weak - 1] if weak else 0.0

    def candidates(self, h: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage start word, item) whose bound reaches the threshold; h: word hashes of texts with offsets woff."""
        none = np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
        if not len(at):
            return none, none
        t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = (self.terms[t] == h[at]) & self.opens[t]
        at, t = at[ok], t[ok]
        # segments are numbered on through all texts, with a gap between texts
        n = np.diff(woff)
        per = -(-n // self.longest) + 1
        base = np.cumsum(per) - per
        text = np.searchsorted(woff, at, "right") - 1
        seg = base[text] + (at - woff[text]) // self.longest
        key = np.unique(seg * len(self.terms) + t)
        seg, t = key // len(self.terms), key % len(self.terms)
        # block-max: bound of a passage (two segments) in each block
        us, inv = np.unique(seg, return_inverse=True)
        bound = np.zeros((len(us), self.blocks), np.float32)
        first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        for lo in range(0, len(first), 4096):
            a, z = first[lo], first[lo + 4096] if lo + 4096 < len(first) else len(seg)
            bound[lo : lo + 4096] = np.add.reduceat(self.block_max[t[a:z]], first[lo : lo + 4096] - a, axis=0)
        follows = np.concatenate((us[1:] == us[:-1] + 1, [False]))
        pair = bound.copy()
        pair[:-1][follows[:-1]] += bound[1:][follows[:-1]]
        live = pair >= self.block_least * (1 - 1e-5)
        live[1:] |= live[:-1] & follows[:-1, None]
        # postings of live blocks
        count = np.diff(self.open_at)[t]
        rep = np.repeat(np.arange(len(t)), count)
        post = np.repeat(self.open_at[t], count) + np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
        item = self.open_item[post]
        ok = live[inv[rep], self.block_of[item]]
        rep, post, item = rep[ok], post[ok], item[ok]
        cell, back = np.unique(seg[rep] * len(self.ids) + item, return_inverse=True)
        got = np.bincount(back, self.open_impact[post], len(cell))
        if not len(cell):
            return none, none
        # a passage may begin at a segment where none of the item's opening words stand
        start = np.unique(np.concatenate((cell, cell - len(self.ids))))
        text = np.searchsorted(base, np.maximum(start, 0) // len(self.ids), "right") - 1
        start = start[(start >= 0) & (start // len(self.ids) < base[text] + np.maximum(per[text] - 1, 1))]

        def at_segment(x: np.ndarray) -> np.ndarray:
            i = np.minimum(np.searchsorted(cell, x), len(cell) - 1)
            return np.where(cell[i] == x, got[i], 0.0)

        total = at_segment(start) + at_segment(start + len(self.ids))
        cell = start[total >= self.least[start % len(self.ids)] - 1e-6]
        seg, item = cell // len(self.ids), cell % len(self.ids)
        text = np.searchsorted(base, seg, "right") - 1
        return woff[text] + (seg - base[text]) * self.longest, item

    def verify(self, words: np.ndarray, i: int) -> tuple[float, float, float, int]:
        """(BM25 score, question cover, answer cover, first matching word) of a passage's words for item i."""
        own, seen = self.items[i], np.unique(words)
        t = np.searchsorted(self.terms, np.intersect1d(np.unique(own), seen, assume_unique=True))
        score = 0.0
        for x in t:
            lo, hi = self.post_at[x], self.post_at[x + 1]
            score += float(self.post_impact[lo + np.searchsorted(self.post_item[lo:hi], i)])
        if score < self.threshold[i] - 1e-9:
            return score, 0.0, 0.0, -1
        k = min(RUN, len(own))
        if len(words) < k:
            return score, 0.0, 0.0, -1
        grams = lambda x: sum((x[j : len(x) - k + 1 + j] * K.ROUND[j] for j in range(k)), np.zeros(len(x) - k + 1, np.uint64))
        gi, gw = grams(own), grams(words)
        hit = np.flatnonzero(np.isin(gi, gw))
        cover = np.zeros(len(own), bool)
        for j in range(k):
            cover[hit + j] = True
        q = int(self.question[i])
        first = np.flatnonzero(np.isin(gw, gi))
        return score, float(cover[:q].mean()) if q else 1.0, float(cover[q:].mean()) if q < len(own) else 1.0, int(first[0]) if len(first) else -1


def _run(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = K.raw(batch.column(1))
            best: dict[tuple[int, int], tuple] = {}
            for lo, hi in K.chunks(off):
                h, woff, _, _ = K.words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], K.ALNUM)
                for at, i in zip(*index.candidates(h, woff), strict=True):
                    text = int(np.searchsorted(woff, at, "right")) - 1
                    passage = h[at : min(at + 2 * index.longest, woff[text + 1])]
                    score, q, a, first = index.verify(passage, int(i))
                    if first >= 0 and q >= COVER and a >= COVER:
                        key = (int(ids[lo + text]), int(i))
                        best[key] = max(best.get(key, ()), (round(score, 6), round(q, 6), round(a, 6), -int(at - woff[text] + first)))
            if best:
                rows = [(d, int(index.ids[i]), s, q, a, -f) for (d, i), (s, q, a, f) in best.items()]
                names = [x.split()[0] for x in LEAKS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, text) of items -> part, number of words, distinct words."""
    for batch in batches:
        buf, off = K.raw(batch.column(1))
        h, woff, _, _ = K.words(buf, off, K.ALNUM)
        terms = [np.unique(h[woff[i] : woff[i + 1]]).view(np.int64) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(woff), pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["part", "n", "terms"])


def leaks(docs: DataFrame, items: DataFrame, block: int = 4_000) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> a row for each item that leaks into a document."""
    items = items.where("item_id is not null").select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = -(-items.count() // block)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    out = overall = None
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")
    if parts > 1:
        counted = written(items.select(part.alias("part"), "text").mapInArrow(K.tidy(_words), WORDS).where("n > 0"), "item-words")
        total = counted.agg(F.count("*").alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest")).first()
        terms = counted.select("part", F.explode("terms").alias("term"))
        df = written(terms.groupBy("term").agg(F.count("*").alias("df")), "item-terms")
    for p in range(parts):
        got = items.where(part == p).orderBy("item_id", "text").toArrow()
        if parts > 1:
            own = df.join(terms.where(F.col("part") == p).select("term").distinct(), "term").toArrow()
            of, at = own["term"].to_numpy().view(np.uint64), own["df"].to_numpy()
            overall = Overall(total["items"], total["words"] or 0, total["longest"] or 0, np.sort(of), at[np.argsort(of)])
        index = Index(got["item_id"].to_pylist(), got["text"].to_pylist(), overall=overall)
        if len(index.ids):
            found = texts.mapInArrow(K.tidy(_run(index)), LEAKS)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], LEAKS)
    best = F.max(F.struct("score", "question_cover", "answer_cover", (-F.col("first_word")).alias("back"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.score", "m.question_cover", "m.answer_cover", (-F.col("m.back")).alias("first_word"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
