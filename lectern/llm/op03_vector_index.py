"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in two halves; each half has a codebook of its own, fitted on a sample of at
most `sample` vectors, and the product of both is the grid of cells. Every vector is listed in the
cell of its nearest codewords. A query visits cells in the order of summed half distances
(multi-sequence traversal: a cell whose codewords rank a-th and b-th can't be among the first m
unless a * b <= m), up to the number of cells that reaches the target recall on the sample, where
partners are drawn at exactly the least cosine that counts. All rows are listed and all are
queries; what meets is verified in double precision, so no link is reported below the threshold.

Equal vectors are one entry with a count. Cells are dealt out by the first codeword; a codeword's
list and its visitors are cut into blocks of bounded size that meet pairwise, so no group is
gathered in one task.

Vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing. Each
length, of which there are few, has an index of its own: vectors of two lengths have no cosine.
Components may be of any size that a double holds. Repeated rows are vectors of their own. Rows without vec_id are left out;
labels and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import components, table, written

LEAST = 0.9
HOME, VISIT = 4096, 16384


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(col.flatten().cast(pa.float64()), float).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means; an empty cell takes the vector farthest from its codeword."""
    book = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = _distances(x, book)
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            book[empty] = x[np.argsort(-d.min(1), kind="stable")[: len(empty)]]
    return book


class Grid:
    def __init__(self, x: np.ndarray, k: int, least: float = LEAST, recall: float = 0.995, seed: int = 5):
        self.half = x.shape[1] // 2
        k = min(k, len(x))
        self.k, self.books = k, (codebook(x[:, : self.half], k), codebook(x[:, self.half :], k))
        rng = np.random.default_rng(seed)
        q = x[rng.permutation(len(x))[:1024]]
        g = rng.standard_normal(q.shape)
        g -= (g * q).sum(1, keepdims=True) * q
        y = least * q + np.sqrt(1 - least * least) * g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
        # either of two may find the other: the better of both ranks counts
        ranks = np.minimum(self._rank(q, y), self._rank(y, q))
        self.visits = int(np.quantile(ranks, recall)) + 1
        a, b = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        ok = (a + 1) * (b + 1) <= self.visits
        self.a, self.b = a[ok], b[ok]

    def _two(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])

    def _rank(self, q: np.ndarray, y: np.ndarray) -> np.ndarray:
        d, e = self._two(q)
        i, j = (z.argmin(1) for z in self._two(y))
        own = d[np.arange(len(q)), i] + e[np.arange(len(q)), j]
        return np.array([(d[r][:, None] + e[r] < own[r] - 1e-12).sum() for r in range(len(q))])

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(z.argmin(1) for z in self._two(x))

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, second) codewords of the cells each vector visits, (n, visits) each."""
        d, e = self._two(x)
        di, ei = np.argsort(d, 1, kind="stable"), np.argsort(e, 1, kind="stable")
        total = np.take_along_axis(d, di, 1)[:, self.a] + np.take_along_axis(e, ei, 1)[:, self.b]
        m = min(self.visits, total.shape[1])
        top = np.argpartition(total, m - 1, 1)[:, :m]
        return np.take_along_axis(di, self.a[top], 1), np.take_along_axis(ei, self.b[top], 1)


_MEET = "first int, home_block int, visit_block int, visitor boolean, id long, second binary, vec binary"


def _deal(grid: Grid, dim: int, homes: np.ndarray, guests: np.ndarray):
    """homes, guests: into how many blocks the list of a first codeword and its visitors are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                raw = np.asarray(batch.column(1).flatten().cast(pa.float64()), float).reshape(-1, dim)
                x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                data = [v.tobytes() for v in x]
                salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                i, j = grid.home(x)
                rows = []
                for r in range(len(ids)):
                    h = int(salt[r] % homes[i[r]])
                    rows += [(int(i[r]), h, g, False, int(ids[r]), np.int32(j[r]).tobytes(), data[r]) for g in range(guests[i[r]])]
                vi, vj = grid.traverse(x)
                for r in range(len(ids)):
                    order = np.argsort(vi[r], kind="stable")
                    firsts, cut = np.unique(vi[r][order], return_index=True)
                    for f, seconds in zip(firsts, np.split(vj[r][order], cut[1:]), strict=True):
                        g = int(salt[r] % guests[f])
                        rows += [(int(f), h, g, True, int(ids[r]), seconds.astype(np.int32).tobytes(), data[r]) for h in range(homes[f])]
                cols = list(zip(*rows, strict=True))
                types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[n.split()[0] for n in _MEET.split(", ")])

    return run


def _verify(least: float):
    def run(t: pa.Table) -> pa.Table:
        guest = t["visitor"].to_numpy()
        ids = t["id"].to_numpy()
        second = [np.frombuffer(x.as_py(), np.int32) for x in t["second"]]
        vec = np.frombuffer(b"".join(x.as_py() for x in t["vec"]), float).reshape(len(ids), -1)
        home, visit = np.flatnonzero(~guest), np.flatnonzero(guest)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(home) and len(visit):
            cell = np.array([second[h][0] for h in home])
            asked = np.concatenate([second[v] for v in visit])
            who = np.repeat(visit, [len(second[v]) for v in visit])
            by = np.argsort(asked, kind="stable")
            asked, who = asked[by], who[by]
            for c in np.unique(cell):
                h = home[cell == c]
                lo, hi = np.searchsorted(asked, [c, c + 1])
                for s in range(lo, hi, 2048):
                    v = who[s : min(hi, s + 2048)]
                    a, b = np.nonzero(vec[v] @ vec[h].T >= least)
                    x, y = ids[v[a]], ids[h[b]]
                    ok = x != y
                    out_a.append(np.minimum(x, y)[ok])
                    out_b.append(np.maximum(x, y)[ok])
        pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _linked(good: DataFrame, dim: int, least: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """good(vec_id, x), all of one length -> (rows: vec_id, class; links: a, b between classes)."""
    good = good.withColumn("key", F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256))
    classes = good.groupBy("key").agg(F.min("vec_id").alias("class"), F.first("x").alias("x"))
    listed = written(classes.select("class", "x", "key"), "vectors")
    n = listed.count()
    got = listed.orderBy("key").select("x").limit(sample).toArrow()
    x = np.array(got["x"].to_pylist())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = Grid(x, int(np.clip(round(np.sqrt(n / 16)), 1, 512)), least)
    # how full the lists get, from the sample: only the number of blocks depends on it
    i, _ = grid.home(x)
    full = np.bincount(i, minlength=grid.k) * (n / len(x))
    homes = np.maximum(1, np.ceil(full / HOME)).astype(int)
    vi, _ = grid.traverse(x[:1024])
    asked = np.bincount(np.concatenate([np.unique(r) for r in vi]), minlength=grid.k) * (n / len(vi))
    guests = np.maximum(1, np.ceil(asked / VISIT)).astype(int)
    meet = listed.select("class", "x").mapInArrow(K.tidy(_deal(grid, dim, homes, guests)), _MEET)
    links = meet.groupBy("first", "home_block", "visit_block").applyInArrow(K.tidy(_verify(least)), "a long, b long").distinct()
    rows = good.select("vec_id", "key").join(listed.select("key", "class"), "key").select("vec_id", "class")
    return rows, written(links, "links")


def near_vectors(vectors: DataFrame, least: float = LEAST, sample: int = 8192) -> tuple[DataFrame, DataFrame]:
    """vectors(vec_id, embedding) -> (rows: vec_id, class; links: a, b between classes). class: the smallest vec_id among equal vectors."""
    v = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    # NaN is equal to itself here, and an infinite or null member makes the bound fail or null
    sane = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0)
    v = v.withColumn("dim", F.when(F.coalesce(sane, F.lit(False)), F.size("x")))
    good = v.where("dim is not null")
    # by a power of two, which is exact: no square of a huge or tiny component leaves the range of a double
    power = F.greatest(F.least(F.floor(F.log2(F.array_max(F.transform("x", F.abs)))), F.lit(1023)), F.lit(-1074))
    good = good.withColumn("unit", F.pow(F.lit(2.0), power)).withColumn("x", F.transform("x", lambda e: e / F.col("unit")))
    rows = v.where("dim is null").select("vec_id", F.lit(None).cast("long").alias("class"))
    links = vectors.sparkSession.createDataFrame([], "a long, b long")
    for dim in sorted(r["dim"] for r in good.select("dim").distinct().collect()):
        some, found = _linked(good.where(F.col("dim") == dim).select("vec_id", "x"), dim, least, sample)
        rows, links = rows.unionByName(some), links.unionByName(found)
    return rows, links


def dedup_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    rows, links = near_vectors(vectors, least)
    size = rows.where("class is not null").groupBy("class").agg(F.count("*").alias("n"))
    ends = links.select(F.col("a").alias("class"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("class"), F.col("a").alias("to")))
    others = ends.join(size.select(F.col("class").alias("to"), "n"), "to").groupBy("class").agg(F.sum("n").alias("far"))
    comp = components(links, "vectors").select(F.col("id").alias("class"), "component")
    facts = size.join(others, "class", "left").join(comp, "class", "left").select("class", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    out = rows.join(facts, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_vectors(table(spark, sf_dir, "embeddings"))
