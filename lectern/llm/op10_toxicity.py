"""Toxicity: a hashed bag-of-words classifier with a counterfactual penalty.

Features are the lower-cased words of a text and the beginnings of longer ones, hashed to a fixed number
of weights and scaled by how differently the two labels have them; a text's logit is bias + sum of its words' weights / sqrt(number of words). Fitted by
adaptive gradient steps on the driver, over at most `most` labelled rows (by hash of doc_id: the
same rows on any cluster), features of whole texts.

Counterfactual penalty: in every labelled text that names a group, each identity term is swapped
for another one of its kind, and the squared change of the logit is added to the loss, so that the
mere mention of a group can't move a score.

Labels, languages, sources and ids are no inputs. Null and empty texts get the bias alone. Without
any usable label every score is 0 (nothing is known to be toxic). Rows keep their number; a null
doc_id counts as not held out and has no label. Where a doc_id has several labels, the largest holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import table

BITS = 19
PREFIXES = (4, 5, 6, 7, 8)
#: Identity terms by kind, in the languages of the corpus.
IDENTITY = [
    "women men girls boys woman man female male frauen männer femmes hommes mujeres hombres transgender nonbinary",
    "muslim christian jewish hindu buddhist atheist catholic muslims christians jews muslime christen juden musulmans chrétiens juifs musulmanes cristianos judíos",
    "black white asian latino african european arab indigenous schwarze weiße noirs blancs negros blancos",
    "gay straight lesbian bisexual heterosexual queer homosexual",
    "immigrants refugees foreigners citizens migrants migranten flüchtlinge migrantes refugiados réfugiés",
    "disabled blind deaf autistic elderly young old",
]


def _features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, one row per word; word offsets per text)."""
    h, woff, a, b = K.words(buf, off, K.ALNUM)
    cols, p, size = [h], np.zeros(len(a), np.uint64), b - a
    for j in range(max(PREFIXES)):
        p = p + np.where(size > j, K.BYTE[K.LOWER[buf[np.where(size > j, a + j, a)]]] * K.ROUND[j], np.uint64(0))
        if j + 1 in PREFIXES:  # of longer words only: the beginning itself, as a word, is another feature
            cols.append(K.mix(p + np.where(size > j + 1, K.ROUND[40 + j], h)))
    ids = np.stack([(c >> np.uint64(64 - BITS)).astype(np.int32) for c in cols], 1) if len(h) else np.zeros((0, len(PREFIXES) + 1), np.int32)
    return ids, woff


def word_ids(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return _features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


def _terms() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word feature, all features, kind) of each identity term, sorted by word feature."""
    ids = [word_ids(line.split()) for line in IDENTITY]
    kind = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    rows = np.concatenate(ids)
    _, first = np.unique(rows[:, 0], return_index=True)
    return rows[first, 0], rows[first], kind[first]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        ids, woff = _features(buf, off)
        n = np.diff(woff)
        run = np.concatenate(([0.0], np.cumsum(self.weights[ids].sum(1, dtype=np.float64))))
        return self.bias + (run[woff[1:]] - run[woff[:-1]]) / np.sqrt(np.maximum(n, 1))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = K.raw(batch.column(1))
        y = batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi in K.chunks(off):
            ids, woff = _features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            rows = [np.unique(ids[woff[i] : woff[i + 1]].ravel(), return_counts=True) for i in range(hi - lo)]
            size = np.diff(woff)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([(r[1] / np.sqrt(max(1, n))).astype(np.float32).tobytes() for r, n in zip(rows, size, strict=True)], pa.binary()), pa.array(y[lo:hi], pa.int32())],
                names=["ids", "values", "y"],
            )


def contrast(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, least: int = 3, power: float = 3.0) -> np.ndarray:
    """How much each feature tells: a signed power of the log ratio of its document shares in the two labels, 0 where fewer than `least` texts have it."""
    have = np.zeros((2, 1 << BITS))
    for (ids, _), label in zip(x, y, strict=True):
        have[int(label), ids] += 1
    n = [(y == 0).sum(), (y == 1).sum()]
    ratio = np.log((have[1] + 1) / (n[1] + 2)) - np.log((have[0] + 1) / (n[0] + 2))
    ratio[have.sum(0) < least] = 0
    return np.sign(ratio) * np.abs(ratio) ** power


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rate: float = 0.1, ridge: float = 3e-4, fair: float = 1.0, epochs: int = 15) -> Model:
    """Logistic loss + ridge + fair * (change of the logit under swaps of identity terms)^2, over features scaled by their contrast."""
    w, b = np.zeros(1 << BITS), 0.0
    if not len(y) or y.min() == y.max():
        return Model(w.astype(np.float32), -50.0 if not len(y) or not y.max() else 50.0)
    scale = contrast(x, y)
    words, rows, kinds = _terms()
    # mentions of groups in each text, and its features that tell something
    named = []
    slim = []
    for i, (ids, v) in enumerate(x):
        at = np.minimum(np.searchsorted(words, ids), len(words) - 1)
        named.append([(float(v[j]), int(at[j])) for j in np.flatnonzero(words[at] == ids)])
        keep = scale[ids] != 0
        slim.append((ids[keep], (v[keep] * scale[ids[keep]]).astype(np.float32)))
    g2, gb2 = np.full(1 << BITS, 1e-8), 1e-8
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 64):
            part = order[lo : lo + 64]
            idx = np.concatenate([slim[i][0] for i in part])
            val = np.concatenate([slim[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(slim[i][0]) for i in part])
            z = b + np.bincount(of, w[idx] * val, len(part))
            e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[part]) / len(part)
            gi, gv = [idx], [e[of] * val]
            for v, t in (m for i in part for m in named[i]):
                like = np.flatnonzero(kinds == kinds[t])
                other = like[rng.integers(len(like))]
                change = v * float((w[rows[t]] * scale[rows[t]]).sum() - (w[rows[other]] * scale[rows[other]]).sum())
                gi += [rows[t], rows[other]]
                gv += [2 * fair * change * v * scale[rows[t]] / len(part), -2 * fair * change * v * scale[rows[other]] / len(part)]
            u, inv = np.unique(np.concatenate(gi), return_inverse=True)
            g = np.bincount(inv, np.concatenate(gv), len(u)) + ridge * w[u]
            g2[u] += g * g
            w[u] -= rate * g / np.sqrt(g2[u])
            gb = e.sum()
            gb2 += gb * gb
            b -= rate * gb / np.sqrt(gb2)
    return Model((w * scale).astype(np.float32), float(b))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 4_000) -> Model:
    """Fits on rows of docs(doc_id, text) with a label of labels(doc_id, toxic) that aren't held out, at most `most` of them."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    # which rows: chosen among ids alone, before any text is moved
    picked = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(picked, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "y")
    got = rows.mapInArrow(K.tidy(_sparse), "ids binary, values binary, y int").toArrow()
    x = [(np.frombuffer(i.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32)) for i, v in zip(got["ids"], got["values"], strict=True)]
    y = got["y"].to_numpy().astype(float)
    order = sorted(range(len(x)), key=lambda i: (x[i][0].tobytes(), y[i]))  # the same steps, however rows arrived
    return fit([x[i] for i in order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with two more columns: score, predicted."""
    where = docs.columns.index("text")
    names = [*(c for c in docs.columns if c != "text"), "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.raw(batch.column(where))
            z = [model.logits(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in K.chunks(off)]
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(z) if z else np.zeros(0), -50, 50)))
            keep = [c for i, c in enumerate(batch.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=names)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(K.tidy(run), ", ".join([*kept, "score double", "predicted int"]))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score under one half, all columns as they are."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.raw(batch.column(where))
            z = [model.logits(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in K.chunks(off)]
            yield batch.filter(pa.array(np.concatenate(z) < 0 if z else np.zeros(0, bool)))

    return docs.mapInArrow(K.tidy(run), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
