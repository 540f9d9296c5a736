"""Paragraph deduplication by MinHash banding, verified exactly and clustered by components.

Paragraphs are cut by content, not by line ends: a cut stands before every word whose 5-word shingle
has the least hash of some CUT consecutive ones, unless another cut stands fewer than LEAST_WORDS
words before it. Cuts depend on the words around them alone and are CUT words apart at most, but for
those left out, so a passage of over 2 * CUT + 4 = 50 words, wherever it stands in a line, holds whole
paragraphs, the same ones at each of its places.

Equal word sequences are one class. Each class has `bands` keys of `rows` minima over its 5-word
shingles, tuned() for a recall of 0.995 at a similarity of 0.75. Classes that collide are compared
exactly: those of a small band in pairs; those of larger bands, where pairs would grow with the square
of the band, meet in the exact join of op1 (cells of their rarest shingles, pivots inside), which
finds all links among them, in one band or not. Links are joined to components, and of each component
the first place, by doc_id, text hash and position, stays. A place that does not stay is removed where
such places make up LEAST_RUN words in a row, single other paragraphs between them aside: shorter
repeats are phrases and notices, not passages.

Null and empty texts have no paragraphs; those under LEAST_WORDS words, at a text's beginning, are never compared. Rows that
agree in doc_id and text are one place, given back as often as they came. Rows without doc_id come
after all others; other columns are not read by decisions() and passed through by cut_paragraphs().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import buckets, components, contained, release, table, written
from .op01_jaccard_join import links
from .shingle_index import index, pack, unpack

SHINGLE, CUT, LEAST_WORDS, LEAST_RUN = 5, 23, 5, 16
SMALL = 8
_PLACES = "row long, doc_id long, piece int, h long, words int, bytes int"
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tuned(share: float = 0.75, recall: float = 0.995, noise: float = 0.3, weight: float = 12.0) -> tuple[int, int]:
    """(bands, rows) with at least `recall` at a similarity of `share`, and the least keys plus `weight` times the
    collisions of pairs at the similarity `noise`, which are verified for nothing."""
    plans = [(max(1, math.ceil(math.log(1 - recall) / math.log(1 - share**rows))), rows) for rows in range(1, 9)]
    return min(plans, key=lambda p: p[0] + weight * (1 - (1 - noise ** p[1]) ** p[0]))


BANDS, ROWS = tuned()


class Pieces:
    """Paragraphs of the texts in one buffer: text, number in it, first byte, end byte, words, id of the word sequence."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.h, woff, begin, _ = K.words(buf, off)
        n = np.diff(woff)
        owner = np.repeat(np.arange(len(n)), n)
        first = np.concatenate((woff[:-1][n > 0], self._cuts(woff, n))).astype(np.int64)
        self.at = np.unique(first)
        self.woff = np.concatenate((self.at, [len(self.h)]))
        self.text = owner[self.at]
        self.number = np.arange(len(self.at)) - np.searchsorted(self.text, self.text)
        self.words = np.diff(self.woff)
        start = np.where(self.number == 0, off[self.text], begin[self.at]) if len(self.at) else self.at
        last = np.concatenate((self.number[1:] == 0, [True])) if len(self.at) else np.zeros(0, bool)
        self.start, self.end = start, np.where(last, off[self.text + 1], np.concatenate((start[1:], [0]))) if len(self.at) else start
        place = np.arange(len(self.h)) - np.repeat(self.at, self.words)
        power = np.cumprod(np.full(int(self.words.max()) + 1 if len(self.at) else 1, K.BASE, np.uint64), dtype=np.uint64)
        self.ids = K.mix(np.add.reduceat(self.h * power[place], self.at) + self.words.astype(np.uint64)) if len(self.at) else np.zeros(0, np.uint64)

    def _cuts(self, woff: np.ndarray, n: np.ndarray) -> np.ndarray:
        s, soff = K.shingles(self.h, woff, SHINGLE)
        of = np.repeat(np.arange(len(n)), np.diff(soff))
        full = n[of] >= SHINGLE
        place = (woff[:-1][of] + np.arange(len(s)) - soff[:-1][of])[full]
        of, s = of[full], s[full]
        if len(s) < CUT:
            return place[:0]
        low = (s & ~np.uint64(0xFFFFFFF)) | np.arange(len(s), dtype=np.uint64)
        have = 1
        while 2 * have <= CUT:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < CUT:
            low = np.minimum(low[: len(low) - (CUT - have)], low[CUT - have :])
        inside = of[: len(low)] == of[CUT - 1 :]
        cut = np.unique((low[inside] & np.uint64(0xFFFFFFF)).astype(np.int64))
        near = (np.diff(cut) < LEAST_WORDS) & (of[cut[1:]] == of[cut[:-1]])
        return place[cut[np.concatenate(([True], ~near))]] if len(cut) else place[:0]

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingles, offsets) of some of the paragraphs."""
        size = self.words[which]
        woff = np.concatenate(([0], np.cumsum(size)))
        own = self.h[np.repeat(self.at[which] - woff[:-1], size) + np.arange(woff[-1])]
        s, soff = K.shingles(own, woff, SHINGLE)
        of = np.repeat(np.arange(len(which)), np.diff(soff))
        order = np.lexsort((s, of))
        s, of = s[order], of[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (of[1:] != of[:-1]))) if len(s) else np.zeros(0, bool)
        return s[new], np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=len(which)))))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) -> a row for each paragraph of LEAST_WORDS words or more, and one, piece -1, with their count in `words`."""
    for batch in batches:
        row, doc = batch.column(0), batch.column(1)
        buf, off = K.raw(batch.column(2))
        for lo, hi in K.chunks(off):
            p = Pieces(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            keep = np.flatnonzero(p.words >= LEAST_WORDS)
            m = hi - lo
            which = pa.array(np.concatenate((p.text[keep], np.arange(m))) + lo)
            own = np.bincount(p.text[keep], minlength=m)
            cols = [row.take(which), doc.take(which)]
            none = np.zeros(m, np.int64)
            for kind, of, rest in ((pa.int32(), p.number, none - 1), (pa.int64(), p.ids.view(np.int64), none), (pa.int32(), p.words, own), (pa.int32(), p.end - p.start, none)):
                cols.append(pa.array(np.concatenate((of[keep], rest)), kind))
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _PLACES.split(", ")])


def _deal(parts: int):
    """text -> for each range of band keys the (low half of the key, class, set size) in it; a class once for a batch."""

    def send(held: list[tuple]) -> pa.RecordBatch:
        h, n, key = (np.concatenate(x) for x in zip(*held, strict=True))
        _, one = np.unique(h, return_index=True)
        h, n, key = np.repeat(h[one], BANDS), np.repeat(n[one], BANDS), key[one].reshape(-1)
        part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, pack(key[o].astype(np.uint32), h[o], n[o])) for p in range(parts) if len(o := order[cut[p] : cut[p + 1]])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            buf, off = K.raw(batch.column(0))
            for lo, hi in K.chunks(off):
                p = Pieces(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                # a set of two shingles or fewer is within the threshold of its equal alone
                _, one = np.unique(p.ids, return_index=True)
                keep = one[p.words[one] >= max(LEAST_WORDS, SHINGLE + 2)]
                s, soff = p.shingles(keep)
                sig = np.zeros((len(keep), BANDS), np.uint64)
                if len(keep):
                    for band in range(BANDS):
                        for r in range(ROWS):
                            sig[:, band] = K.mix(sig[:, band] * K.ROUND[r] + np.minimum.reduceat(K.mix(s * _FACTORS[band * ROWS + r]), soff[:-1]))
                        sig[:, band] = K.mix(sig[:, band] + K.ROUND[20 + band])
                    held.append((p.ids[keep].view(np.int64), np.minimum(np.diff(soff), 255).astype(np.uint8), sig))
                    size += len(keep)
                if size > 60_000:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    return run


def _pair(num: int):
    def run(t: pa.Table) -> pa.Table:
        """All pairs (a, b) of small bands; a row (a, null) for each member of the others."""
        got = [unpack(x.as_py(), np.uint32, np.int64, np.uint8) for x in t["payload"]]
        key, h, n = (np.concatenate(c) for c in zip(*got, strict=True))
        del got
        # bands of one class come first to go
        order = np.lexsort((h, key))
        key, h, n = key[order], h[order], n[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])))
        key, h, n = key[new], h[new], n[new].astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((at, [len(key)])))
        place, group = np.arange(len(key)) - np.repeat(at, size), np.repeat(size, size)
        several = np.flatnonzero(group > 1)
        h, n, place, group = h[several], n[several], place[several], group[several]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, SMALL):
            i = np.flatnonzero((place + step < group) & (group <= SMALL))
            a.append(i)
            b.append(i + step)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = 100 * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])
        pairs = np.unique(np.stack([np.minimum(h[a], h[b])[ok], np.maximum(h[a], h[b])[ok]], 1), axis=0)
        hot = np.unique(h[group > SMALL])
        far = pa.chunked_array([pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(hot), pa.int64())])
        return pa.table({"a": pa.array(np.concatenate((pairs[:, 0], hot)), pa.int64()), "b": far})

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, numbers wanted, those of them whose words are) -> (h, distinct shingles, the words or null)."""
    for batch in batches:
        buf, off = K.raw(batch.column(0))
        for lo, hi in K.chunks(off):
            b = buf[off[lo] : off[hi]]
            p = Pieces(b, off[lo : hi + 1] - off[lo])
            first = np.searchsorted(p.text, np.arange(hi - lo))
            want = [np.array(batch.column(1)[lo + i].as_py(), np.int64) + first[i] for i in range(hi - lo)]
            full = {int(x) + int(first[i]) for i in range(hi - lo) for x in batch.column(2)[lo + i].as_py()}
            which = np.concatenate(want)
            s, soff = p.shingles(which)
            words = [b[p.start[j] : p.end[j]].tobytes().decode() if j in full else None for j in which.tolist()]
            sets = pa.ListArray.from_arrays(pa.array(soff, pa.int32()), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(p.ids[which].view(np.int64)), sets, pa.array(words, pa.string())], names=["h", "tokens", "words"])


def _hot_links(lines: DataFrame, num: int) -> DataFrame:
    """All links (a, b) among classes of large bands, exactly: lines(h, text), one of each class."""
    made = written(index(lines.select(F.col("h").alias("doc_id"), "text"), SHINGLE, num), "hot-sets")
    # classes of the same set are one member there; the least stands for it
    of = made.where("kind = 0").select(F.col("doc_id").alias("h"), "cid")
    least = of.groupBy("cid").agg(F.min("h").alias("least"))
    same = of.join(least, "cid").where("h <> least").select(F.col("least").alias("a"), F.col("h").alias("b"))
    found = links(made.where("kind = 1").select("cid", "n", "lone", "prefix", "tokens"), num)
    named = lambda c: least.select(F.col("cid").alias(c), F.col("least").alias("h" + c))
    return found.join(named("a"), "a").join(named("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b")).unionByName(same)


@contained
def paragraph_links(text: DataFrame, places: DataFrame, num: int = 75) -> DataFrame:
    """Links (a, b) between classes of equal paragraphs, from text(row, text) and its places."""
    spark = text.sparkSession
    parts = buckets(spark, 8)
    pairs = text.select("text").mapInArrow(K.tidy(_deal(parts)), "part int, payload binary").groupBy("part").applyInArrow(K.tidy(_pair(num)), "a long, b long")
    pairs = written(pairs.distinct(), "pairs")
    release(spark)  # what the bands were shuffled through isn't needed any more
    hot, near = pairs.where("b is null").select(F.col("a").alias("h")), pairs.where("b is not null")
    wanted = near.select(F.explode(F.array("a", "b")).alias("h"), F.lit(0).alias("hot")).unionByName(hot.withColumn("hot", F.lit(1))).groupBy("h").agg(F.max("hot").alias("hot"))
    first = places.join(wanted, "h").groupBy("h").agg(F.min(F.struct("row", "piece", "hot")).alias("at"))
    # a row of the text's is enough, of those that agree in doc_id and text
    asked = first.groupBy("at.row").agg(F.collect_list("at.piece").alias("want"), F.collect_list(F.when(F.col("at.hot") == 1, F.col("at.piece"))).alias("full"))
    read = text.join(asked, "row").select("text", "want", "full").mapInArrow(K.tidy(_read), "h long, tokens array<long>, words string")
    read = written(read, "sets")
    release(spark)
    sets = read.select("h", "tokens").dropDuplicates(["h"])
    x, y = sets.select(F.col("h").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("h").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    found = near.join(x, "a").join(y, "b").where(100 * both >= num * (F.size("ta") + F.size("tb") - both)).select("a", "b")
    if not hot.isEmpty():
        found = found.unionByName(_hot_links(read.where("words is not null").select("h", F.col("words").alias("text")).dropDuplicates(["h"]), num))
    return found


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, places sorted by piece) -> row and those of its pieces that are in a run of `least` words."""
        for batch in batches:
            lists = batch.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            piece, words, size = (f.to_numpy(zero_copy_only=False).astype(np.int64)[: off[-1] - off[0]] for f in lists.flatten().flatten())
            of = np.repeat(np.arange(batch.num_rows), np.diff(off))
            new = np.concatenate(([True], (of[1:] != of[:-1]) | (piece[1:] - piece[:-1] > 2))) if len(of) else np.zeros(0, bool)
            run = np.cumsum(new) - 1
            goes = np.bincount(run, words)[run] >= least if len(run) else new
            n = np.bincount(of[goes], minlength=batch.num_rows)
            removed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(piece[goes], pa.int32()))
            cut = np.bincount(of[goes], size[goes], batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), removed, pa.array(cut)], names=["row", "removed", "bytes_removed"])

    return run


@contained
def removals(text: DataFrame, places: DataFrame, num: int = 75, least_run: int = LEAST_RUN) -> DataFrame:
    """row, removed: the numbers of its paragraphs that go, bytes_removed; of texts that lose any."""
    comp = components(paragraph_links(text, places, num)).select(F.col("id").alias("h"), "component")
    again = places.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    asked = again.join(comp, "h", "full").select("h", F.coalesce("component", "h").alias("component"))
    some = written(places.join(asked, "h"), "repeated")
    here = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "piece")
    stays = some.groupBy("component").agg(F.min(here).alias("stays"), F.max(here).alias("end")).where("stays < end").select("component", "stays")
    goes = some.join(stays, "component").where(here != F.col("stays"))
    listed = goes.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("piece", "words", "bytes"))).alias("places"))
    return listed.mapInArrow(K.tidy(_runs(least_run)), "row long, removed array<int>, bytes_removed long").where("bytes_removed > 0")


def _judged(docs: DataFrame, num: int, least_run: int) -> tuple[DataFrame, DataFrame]:
    text = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = written(text.mapInArrow(K.tidy(_places), _PLACES), "paragraphs")
    return made.where("piece < 0"), removals(text, made.where("piece >= 0"), num, least_run)


def decisions(docs: DataFrame, num: int = 75, least_run: int = LEAST_RUN) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_paragraphs, n_removed, bytes_removed, removed: the numbers of the paragraphs that go."""
    texts, gone = _judged(docs, num, least_run)
    found = F.coalesce("removed", F.array().cast("array<int>"))
    return texts.join(gone, "row", "left").select(
        "doc_id", F.col("words").cast("long").alias("n_paragraphs"), F.size(found).cast("long").alias("n_removed"), F.coalesce("bytes_removed", F.lit(0)).alias("bytes_removed"), found.alias("removed")
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, removed, carry) -> (the text without those paragraphs, carry)."""
    for batch in batches:
        buf, off = K.raw(batch.column(0))
        out: list = [None] * batch.num_rows
        for lo, hi in K.chunks(off):
            b = buf[off[lo] : off[hi]]
            p = Pieces(b, off[lo : hi + 1] - off[lo])
            first = np.searchsorted(p.text, np.arange(hi - lo))
            for i in range(hi - lo):
                keep = np.ones(int(off[lo + i + 1] - off[lo + i]), bool)
                for j in first[i] + np.array(batch.column(1)[lo + i].as_py(), np.int64):
                    keep[p.start[j] - (off[lo + i] - off[lo]) : p.end[j] - (off[lo + i] - off[lo])] = False
                out[lo + i] = buf[off[lo + i] : off[lo + i + 1]][keep].tobytes().decode()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], names=["text", "carry"])


def cut_paragraphs(docs: DataFrame, num: int = 75, least_run: int = LEAST_RUN) -> DataFrame:
    """docs, with any further columns, without the paragraphs that go."""
    _, gone = _judged(docs, num, least_run)
    carry = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("carry")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), carry).join(gone.select("row", "removed"), "row", "left")
    at = docs.columns.index("text")
    cut = rows.where("removed is not null").select(F.col(f"carry.c{at}").alias("text"), "removed", "carry")
    cut = cut.mapInArrow(K.tidy(_without), f"text string, carry {rows.schema['carry'].dataType.simpleString()}")
    both = rows.where("removed is null").select(F.col(f"carry.c{at}").alias("text"), "carry").unionByName(cut)
    return both.select(*[F.col("text") if i == at else F.col(f"carry.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the paragraphs that it loses."""
    return decisions(table(spark, sf_dir, "documents"))
