"""Exact substring deduplication: removes each byte covered by an L-byte string that starts elsewhere too.

Every L-byte window of a text is given to an anchor: the least of the k-byte hashes in it, leftmost
of equals. The choice depends on the window's bytes alone, so equal windows, wherever they start,
have equal anchors at equal offsets, and a text of n bytes has about 2n/(L-k) anchors rather than n
windows to compare.

1. Anchors are dealt out by a mix of their hash as packed (hash, context hash) pairs; the context is all
   that the anchor's windows cover. A hash that occurs once: none of its windows repeats. A context
   that occurs twice: all of them do. The rest, the rims of matches, stay open.
2. For open anchors, and one of each repeated context that shares a hash with them, the rolling hash
   of each window is dealt out in the same way and counted.
3. Covered bytes are removed and the rest is hashed.

Hashes have 64 bits. Parts follow the shuffle width, so a task's share doesn't grow with the input,
and nothing is gathered by document group or passage. Texts move only where something repeats.
Null or empty texts have no bytes; a text under L bytes keeps all; rows that agree in doc_id and
text are different places (each repeats the other) and both are returned; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import buckets, release, table, written
from .shingle_index import pack, unpack

LENGTH, ANCHOR = 200, 32
SEGMENT = 2 << 20
_ROOT = 0xD1342543DE82EF95
_UP = _DOWN = np.ones(1, np.uint64)

PACKED = "part int, payload binary"
_PACKED = pa.schema([("part", pa.int32()), ("payload", pa.binary())])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, K.CHUNK + 4096)
        up, down = np.full(size, _ROOT, np.uint64), np.full(size, pow(_ROOT, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _UP, _DOWN = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _UP, _DOWN


class Rolling:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _powers(len(buf) + 1)
        self.run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(K.BYTE[buf] * up[: len(buf)], out=self.run[1:], dtype=np.uint64)

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return K.mix((self.run[b] - self.run[a]) * self.down[a])


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text, anchor position, first and last window) of texts in a buffer of less than 2^24 bytes."""
    roll = Rolling(buf)
    n = np.maximum(np.diff(off) - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not n.sum():
        return roll, none, none, none, none
    at = np.arange(len(buf) - k + 1)
    least = (K.mix((roll.run[k:] - roll.run[:-k]) * roll.down[: len(at)]) & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    width, have = length - k + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    text = np.repeat(np.arange(len(n)), n)
    window = off[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    pos = (least[window] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((first[1:], [len(pos)])) - 1
    return roll, text[first], pos[first], window[first], window[last]


def _parts_of(buf: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, start byte, bytes, offsets): short texts together, a long one in segments that share length - 1 bytes."""
    for lo, hi in K.chunks(off):
        if off[hi] - off[lo] <= SEGMENT:
            yield lo, 0, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        else:
            own = buf[off[lo] : off[hi]]
            for s in range(0, max(1, len(own) - length + 1), SEGMENT):
                part = own[s : s + SEGMENT + length - 1]
                yield lo, s, part, np.array([0, len(part)])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _send(keys: np.ndarray, columns: list[np.ndarray], parts: int, form=lambda *c: c) -> list[tuple]:
    # an anchor's hash is the least of a window, so nearly all of them are small: mixed again, they spread over all parts
    part = _part(K.mix(keys), parts)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, pack(keys[o], *form(*(c[o] for c in columns)))) for p in range(parts) if len(o := order[cut[p] : cut[p + 1]])]


def _thin(row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries in the order of their texts: each run's row and length, and the halves of the numbers, as the upper one is mostly 0."""
    at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    return row[at], np.diff(np.concatenate((at, [len(row)]))).astype(np.int32), number.astype(np.uint16), (number >> 16).astype(np.uint16)


def _thick(row: np.ndarray, run: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(row, run), low.astype(np.int32) | high.astype(np.int32) << 16


_THIN = (np.uint64, np.int64, np.int32, np.uint16, np.uint16)


def _deal_anchors(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            row = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, off = K.raw(b.column(1))
            seen: dict[int, int] = {}
            for lo, _, part, o in _parts_of(buf, off, length):
                roll, text, pos, first, last = anchors(part, o, length)
                if not len(pos):
                    continue
                h = roll.ranges(pos, pos + ANCHOR)
                context = roll.ranges(first, last + length) + K.mix((pos - first).astype(np.uint64) * K.ROUND[7] + (last - first).astype(np.uint64))
                begin = np.searchsorted(text, text)
                number = np.arange(len(text)) - begin + (seen.get(lo, 0) if len(o) == 2 else 0)
                if len(o) == 2:
                    seen[lo] = seen.get(lo, 0) + len(text)
                held.append([h, context, row[lo + text], number.astype(np.int32)])
                size += len(h)
                if size > 150_000:
                    keys, *cols = (np.concatenate(c) for c in zip(*held, strict=True))
                    yield _packed(_send(keys, cols, parts))
                    held, size = [], 0
        if held:
            keys, *cols = (np.concatenate(c) for c in zip(*held, strict=True))
            yield _packed(_send(keys, cols, parts))

    return run


def _reply(parts: int, row: np.ndarray, number: np.ndarray, state: np.ndarray) -> pa.Table:
    home = _part(K.mix(row.view(np.uint64)), parts)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(parts + 1))
    return pa.Table.from_batches([_packed([(p, pack(row[o], number[o], state[o])) for p in range(parts) if len(o := order[cut[p] : cut[p + 1]])])])


def _counts(h: np.ndarray) -> np.ndarray:
    """How often each entry's value occurs."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    run = np.diff(np.concatenate((at, [len(s)])))
    out = np.empty(len(s), np.int64)
    out[order] = np.repeat(run, run)
    return out


def _judge_anchors(parts: int):
    def run(t: pa.Table) -> pa.Table:
        h, context, row, number = (np.concatenate(c) for c in zip(*(unpack(x.as_py(), np.uint64, np.uint64, np.int64, np.int32) for x in t.column("payload")), strict=True))
        both = K.mix(h + context * K.ROUND[9])
        state = np.where(_counts(h) < 2, 0, np.where(_counts(both) > 1, 1, 2)).astype(np.int8)
        # where a hash has open entries too, one of each repeated context tells its windows, for them to be compared with
        rim = np.isin(h, np.unique(h[state == 2]))
        first = np.zeros(len(h), bool)
        first[np.unique(both, return_index=True)[1]] = True
        state[(state == 1) & rim & first] = 3
        on = state > 0
        return _reply(parts, row[on], number[on], state[on])

    return run


def _judge_windows(parts: int):
    def run(t: pa.Table) -> pa.Table:
        got = [unpack(x.as_py(), *_THIN) for x in t.column("payload")]
        h, row, number = (np.concatenate(c) for c in zip(*((g[0], *_thick(*g[1:])) for g in got), strict=True))
        del got
        on = _counts(h) > 1
        return _reply(parts, row[on], number[on], np.ones(int(on.sum()), np.int8))

    return run


def _by_row(t: pa.Table) -> pa.Table:
    row, number, state = (np.concatenate(c) for c in zip(*(unpack(x.as_py(), np.int64, np.int32, np.int8) for x in t.column("payload")), strict=True))
    order = np.lexsort((number, row))
    row, number, state = row[order], number[order], state[order]
    at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    end = np.concatenate((at[1:], [len(row)]))
    return pa.Table.from_arrays([pa.array(row[at]), pa.array([number[a:e].tobytes() for a, e in zip(at, end, strict=True)], pa.binary()), pa.array([state[a:e].tobytes() for a, e in zip(at, end, strict=True)], pa.binary())], names=["row", "numbers", "states"])


_BY_ROW = "row long, numbers binary, states binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, row long, carry {}"
_OPEN = RESULT + ", text binary, sure binary, open binary"
_NAMES = [x.split()[0] for x in _OPEN.split(", ")]


def _cut(data: bytes, at: np.ndarray, length: int, keep: bool) -> tuple:
    """The result columns for a text whose windows at `at` repeat."""
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + length, -1)
    gone = np.cumsum(mark[:-1]) > 0
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
    return len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore").encode() if keep else None


def _results(ids: pa.Array, rows: list[tuple], row: pa.Array, carry: pa.Array) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return [ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary()), row, carry]


def _windows(ranges: bytes) -> np.ndarray:
    r = np.frombuffer(ranges, np.int64).reshape(-1, 2)
    n = r[:, 1] - r[:, 0] + 1
    return np.repeat(r[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _resolve(length: int, keep: bool):
    """Texts with the states of their anchors -> the result where that settles it, else the text with the windows that
    surely repeat and those still open, as [first, last] ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            buf, off = K.raw(b.column(2))
            sure: list[list] = [[] for _ in range(n)]
            rims: list[list] = [[] for _ in range(n)]
            told = {i: (np.frombuffer(b.column(3)[i].as_py(), np.int32), np.frombuffer(b.column(4)[i].as_py(), np.int8)) for i in range(n) if b.column(3)[i].is_valid}
            if told:  # only texts in which something repeats are looked at again
                pick = sorted(told)
                buf2 = np.concatenate([buf[off[i] : off[i + 1]] for i in pick])
                off2 = np.concatenate(([0], np.cumsum(np.diff(off)[pick])))
                seen: dict[int, int] = {}
                for lo, s, part, o in _parts_of(buf2, off2, length):
                    _, text, _, first, last = anchors(part, o, length)
                    for j in range(len(o) - 1):
                        i = pick[lo + j]
                        a, e = np.searchsorted(text, [j, j + 1])
                        at = seen.get(i, 0)
                        seen[i] = at + int(e - a)
                        numbers, states = told[i]
                        x, z = np.searchsorted(numbers, [at, at + e - a])
                        which, how = numbers[x:z] - at + a, states[x:z]
                        for kinds, out in (((1, 3), sure), ((2, 3), rims)):
                            w = which[np.isin(how, kinds)]
                            if len(w):
                                out[i].append(np.stack([first[w], last[w]], 1) - o[j] + s)
            rows, more = [], []
            for i in range(n):
                data = buf[off[i] : off[i + 1]].tobytes()
                known = np.concatenate(sure[i]).astype(np.int64).tobytes() if sure[i] else b""
                if rims[i]:
                    rows.append((len(data), None, None, None, None))
                    more.append((data, known, np.concatenate(rims[i]).astype(np.int64).tobytes()))
                else:
                    rows.append(_cut(data, _windows(known), length, keep))
                    more.append((None, None, None))
            extra = [pa.array(c, pa.binary()) for c in zip(*more, strict=True)] if n else [pa.array([], pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*_results(b.column(0), rows, b.column(1), b.column(5)), *extra], names=_NAMES)

    return run


def _deal_windows(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, *cols = (np.concatenate(c) for c in zip(*held, strict=True))
            return _packed(_send(keys, cols, parts, _thin))

        for b in batches:
            for row, text, spans in zip(b.column(0), b.column(1), b.column(2), strict=True):
                buf, at = np.frombuffer(text.as_py(), np.uint8), _windows(spans.as_py())
                for lo in range(0, len(buf), SEGMENT):
                    w = at[(at >= lo) & (at < lo + SEGMENT)]
                    if len(w):
                        roll = Rolling(buf[lo : lo + SEGMENT + length - 1])
                        number = np.searchsorted(at, w).astype(np.int32)
                        held.append([roll.ranges(w - lo, w - lo + length), np.full(len(w), row.as_py(), np.int64), number])
                        size += len(w)
                        if size > 300_000:
                            yield flush()
                            held, size = [], 0
        if held:
            yield flush()

    return run


def _finish(length: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, sure, rims, numbers in zip(*(b.column(i) for i in range(2, 6)), strict=True):
                at = np.concatenate([_windows(sure.as_py()), _windows(rims.as_py())[np.frombuffer(numbers.as_py() or b"", np.int32)]])
                rows.append(_cut(text.as_py(), at, length, keep))
            yield pa.RecordBatch.from_arrays(_results(b.column(0), rows, b.column(1), b.column(6)), names=_NAMES[:8])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: bool = True, carry: F.Column | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the kept bytes), row (a key of doc_id
    and text), carry (a column that goes along) and, on demand, kept: the kept bytes without parts of a character that
    a cut went through."""
    parts = buckets(docs.sparkSession, 8)
    carry = F.lit(None).cast("int") if carry is None else carry
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), carry.alias("carry")).withColumn("row", F.xxhash64("doc_id", "text"))
    kind = base.schema["carry"].dataType.simpleString()
    dealt = base.where(F.octet_length("text") >= length).select("row", "text").mapInArrow(K.tidy(_deal_anchors(parts, length)), PACKED)
    states = dealt.groupBy("part").applyInArrow(K.tidy(_judge_anchors(parts)), PACKED).groupBy("part").applyInArrow(K.tidy(_by_row), _BY_ROW)
    texts = base.join(states, "row", "left").select("doc_id", "row", "text", "numbers", "states", "carry")
    settled = written(texts.mapInArrow(K.tidy(_resolve(length, keep)), _OPEN.format(kind)), "matches")
    del dealt, states, texts
    release(docs.sparkSession)  # the shuffles up to here are not read again
    rims = settled.where("text is not null")
    told = rims.select("row", "text", "open").mapInArrow(K.tidy(_deal_windows(parts, length)), PACKED)
    told = written(told.groupBy("part").applyInArrow(K.tidy(_judge_windows(parts)), PACKED).groupBy("part").applyInArrow(K.tidy(_by_row), _BY_ROW).select("row", "numbers"), "windows")
    release(docs.sparkSession)  # the windows go before the texts move
    cut = rims.join(told, "row", "left").select("doc_id", "row", "text", "sure", "open", "numbers", "carry").mapInArrow(K.tidy(_finish(length, keep)), RESULT.format(kind))
    return cut.unionByName(settled.where("text is null").select(*_NAMES[:8]))


def cut_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the remaining text; bytes of a character that a cut went through go too. A null text stays null; an n_chars column follows the text."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    made = remove_repeats(docs, length, carry=F.struct(F.col("text").isNull().alias("none"), *others))
    text = F.when(~F.col("carry.none"), F.col("kept").cast("string"))
    out = made.select(*[text.alias("text") if c == "text" else F.col(f"carry.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept", "row", "carry")
