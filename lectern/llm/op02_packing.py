"""Packing documents into sequences of at most W tokens, by a histogram of lengths.

A document's ids are cut into pieces of W and a remainder. Only the counts of piece lengths (at
most W numbers) come to the driver: shallow combinations of two or three lengths that fill a
window exactly are enumerated, their repeat counts solved by non-negative least squares against
the histogram and rounded down, and what is left is packed greedily, a pattern of lengths with its
number of repeats at a time. The plan maps (length, rank among pieces of that length) to a place;
ranks are dealt in parallel from counts by (part, length), so no length is gathered in one task.

A null text is empty; an empty text is one piece with the end id alone. Rows are packed as they
come, repeated ones too; a null doc_id stays null. Further columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import buckets, table, written

WINDOW = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Triples to try for each smallest member.
SPREAD = 16


def spans(text: str, most: int = 1 << 18) -> Iterator[str]:
    """A long text in parts cut where the tokenizer cuts anyway: before a single space between other characters."""
    at = 0
    while len(text) - at > most and (m := _CUT.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_loaded: dict = {}


def encoder(path: str, ranks: str | None = None):
    """texts -> ids by a tokenizers file. With `ranks`, the same vocabulary in tiktoken's form, plain texts take that
    faster library, with equal ids; texts that spell a special token stay with the first."""
    if (path, ranks) in _loaded:
        return _loaded[path, ranks]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = [x.content for x in t.get_added_tokens_decoder().values()]

    def slow(texts: list[str]) -> list[np.ndarray]:
        parts = [list(spans(x)) for x in texts]
        flat = t.encode_batch_fast([p for x in parts for p in x], add_special_tokens=False)
        out, i = [], 0
        for x in parts:
            got = [np.array(e.ids, "<u4") for e in flat[i : i + len(x)]]
            out.append(got[0] if len(got) == 1 else np.concatenate(got))
            i += len(x)
        return out

    encode = slow
    if ranks:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def encode(texts: list[str]) -> list[np.ndarray]:
            out = []
            for x in texts:
                if any(s in x for s in special):
                    out += slow([x])
                else:
                    out.append(np.concatenate([fast.encode_to_numpy(p, disallowed_special=()) for p in spans(x)]).astype("<u4", copy=False))
            return out

    _loaded[path, ranks] = encode
    return encode


def _pieces(path: str, ranks: str | None, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path, ranks)
        for batch in batches:
            texts = batch.column(1)
            size, lo, n = 0, 0, batch.num_rows
            while lo < n:
                hi, size, part = lo, 0, []
                while hi < n and (size < 1 << 19 or hi == lo):
                    part.append(texts[hi].as_py() or "")
                    size += len(part[-1])
                    hi += 1
                rows: list[tuple] = []
                for i, ids in enumerate(encode(part)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    data = ids.tobytes()
                    rows += [(lo + i, s, min(window, len(ids) - s), zlib.crc32(data[4 * s : 4 * (s + window)]), len(ids)) for s in range(0, len(ids), window)]
                row, *cols = map(np.array, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                lo = hi

    return run


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |A x - target| over x >= 0, where column j of A counts the lengths in columns[j] (0: none); accelerated projected gradient."""
    mask = columns > 0

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(columns.ravel(), (x[:, None] * mask).ravel(), len(target))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[columns] * mask).sum(1)

    v = np.ones(len(columns))
    for _ in range(30):
        v = back(forward(v))
        top = np.linalg.norm(v) or 1.0
        v /= top
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - target) / (1.05 * top))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, how often in a sequence)], number of such sequences)] that uses up counts[length]."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []
    if left[window]:
        out.append(([(window, 1)], int(left[window])))
        left[window] = 0
    have = left > 0
    combos = [(a, window - a, 0) for a in range(1, window // 2 + 1) if have[a] and have[window - a]]
    for a in range(1, window // 3 + 1):
        if have[a]:
            top = (window - a) // 2
            for b in sorted({a + (top - a) * j // max(1, SPREAD - 1) for j in range(SPREAD)}):
                c = window - a - b
                if b >= a and c >= b and have[b] and have[c]:
                    combos.append((a, b, c))
    if combos:
        columns = np.array(combos)
        x = nnls(columns, left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            kinds, often = np.unique(columns[j][columns[j] > 0], return_counts=True)
            m = int(min(np.floor(x[j] + 1e-6), (left[kinds] // often).min()))
            if m > 0:
                left[kinds] -= m * often
                out.append(([(int(k), int(o)) for k, o in zip(kinds, often, strict=True)], m))
    while left.any():
        room, pattern, rest = window, [], left.copy()
        while room and (fit := np.flatnonzero(rest[: room + 1])).size:
            k = int(fit[-1])
            often = min(int(rest[k]), room // k)
            pattern.append((k, often))
            rest[k] = 0
            room -= k * often
        m = min(int(left[k]) // o for k, o in pattern)
        for k, o in pattern:
            left[k] -= m * o
        out.append((pattern, m))
    return out


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, times in a sequence, first sequence, offset), sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, seq = [], 0
    for pattern, m in patterns:
        at = 0
        for k, often in pattern:
            rows.append((k, rank.get(k, 0), often, seq, at))
            rank[k] = rank.get(k, 0) + m * often
            at += k * often
        seq += m
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(where: np.ndarray):
    key = (where[:, 0] << 44) + where[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            w = where[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            i = rank - w[:, 1]
            cols = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(w[:, 3] + i // w[:, 2]), pa.array(w[:, 4] + i % w[:, 2] * length)], names=[x.split()[0] for x in PLACED.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) -> one row per piece with its place; see the module's docstring."""
    spark = docs.sparkSession
    made = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.tidy(_pieces(tokenizer, ranks, window, end_id)), PIECES), "pieces")
    pieces = made.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets(spark))))
    each = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for length, n in each.groupBy("length").agg(F.sum("n")).collect():  # at most `window` rows
        counts[length] = n
    before = each.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = pieces.withColumn("i", rank).join(before.select("length", "part", F.coalesce("base", F.lit(0)).alias("base")), ["length", "part"])
    return ranked.withColumn("rank", F.col("base") + F.col("i") - 1).drop("part", "i", "base").mapInArrow(_place(places(plan(counts, window))), PLACED)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
