"""Which documents can have a near copy at all, found exactly and without a row per shingle.

Two shuffles of packed arrays: shingles are dealt out by value range, where each one's document
frequency is counted over all distinct sets; what is shared by two sets or more goes back to its
document. A document of n shingles whose partner must share ceil(0.75 n) of them is dropped here
when too few of its shingles occur anywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import buckets

PACKED = "part int, payload binary"
INDEXED = "kind int, doc_id long, cid long, n int, lone int, prefix int, tokens array<long>"
_PACKED = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
_INDEXED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("lone", pa.int32()), ("prefix", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 1-, 2-, 4- or 8-byte numbers as one byte string: count, each size in bytes, the bytes."""
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64)
    return head.tobytes() + b"".join(x.tobytes() for x in arrays)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    head = np.frombuffer(data, np.int64, 1 + len(kinds))
    at, out = head.nbytes, []
    for kind, size in zip(kinds, head[1:], strict=True):
        out.append(np.frombuffer(data, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def need(n: np.ndarray | int, num: int = 75) -> np.ndarray | int:
    """The least intersection that a set of n can have with a partner: ceil(n * num / 100)."""
    return -(-n * num // 100)


def _emit(parts: int, doc: np.ndarray, cid: np.ndarray, n: np.ndarray, first: np.ndarray, hs: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """One packed row for each part: the texts' own rows go to doc_id's part, shingles to their value range's."""
    part = ((hs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    home = doc % parts
    rows = []
    for p in range(parts):
        own = order[cut[p] : cut[p + 1]]
        at = np.flatnonzero(home == p)
        if not len(own) and not len(at):
            continue
        d, count = np.unique(of[own], return_counts=True)
        rows.append((p, pack(doc[at], cid[at], n[at], cid[first[d]], n[first[d]], count.astype(np.int32), hs[own])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)


_DEALT = (np.int64, np.int64, np.int32, np.int64, np.int32, np.int32, np.uint64)


def _deal(parts: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a chunk gives is gathered until there is enough for a packed row of some size
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, cid, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            # a set seen before in this batch is sent once
            _, first, inverse = np.unique(cid, return_index=True, return_inverse=True)
            sets = [s for h in held for s in h[3]]
            keep = np.zeros(len(cid), bool)
            keep[first] = True
            kept = np.flatnonzero(keep & (n > 0))
            hs = np.concatenate([sets[i] for i in kept]) if len(kept) else np.zeros(0, np.uint64)
            of = np.repeat(np.arange(len(kept)), n[kept])
            return _emit(parts, doc, cid, n, kept, hs, of)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = K.raw(batch.column(1))
            for lo, hi in K.chunks(off):
                h, woff, _, _ = K.words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                s, soff = K.shingles(h, woff, k)
                sets = [np.unique(s[soff[i] : soff[i + 1]]) for i in range(hi - lo)]
                n = np.array([len(x) for x in sets], np.int32)
                # the id of a set: a sum over its members, mixed again, with its size
                cid = np.array([np.add.reduce(K.mix(x + K.ROUND[61])) for x in sets], np.uint64)
                cid = (K.mix(cid + n.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
                held.append((ids[lo:hi].astype(np.int64), cid, n, sets))
                size += int(n.sum())
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _count(parts: int):
    def run(table: pa.Table) -> pa.Table:
        got = [unpack(x.as_py(), *_DEALT) for x in table.column("payload")]
        doc, did, dn, cid, n, count, hs = (np.concatenate([g[i] for g in got]) for i in range(7))
        start = np.cumsum(count) - count
        _, first = np.unique(cid, return_index=True)
        kept = np.zeros(len(cid), bool)
        kept[first] = True
        hs = hs[np.repeat(kept, count)]
        cid, n, count = cid[kept], n[kept], count[kept]
        del start, got
        order = np.argsort(hs, kind="stable")
        run_at = np.flatnonzero(np.concatenate(([True], hs[order][1:] != hs[order][:-1]))) if len(hs) else np.zeros(0, np.int64)
        run = np.diff(np.concatenate((run_at, [len(hs)])))
        df = np.empty(len(hs), np.int64)
        df[order] = np.repeat(run, run)
        of = np.repeat(np.arange(len(cid)), count)
        shared = df > 1
        n_shared = np.bincount(of[shared], minlength=len(cid))
        hs, df, of = hs[shared], np.minimum(df[shared], 2**31 - 1).astype(np.int32), of[shared]
        rows = []
        home, dhome = cid % parts, doc % parts
        by = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[by], np.arange(parts + 1))
        begin = np.concatenate(([0], np.cumsum(n_shared)))
        for p in range(parts):
            c, at = by[cut[p] : cut[p + 1]], np.flatnonzero(dhome == p)
            if len(c) or len(at):
                pick = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in c]) if len(c) else np.zeros(0, np.int64)
                rows.append((p, pack(doc[at], did[at], dn[at], cid[c], n[c], count[c].astype(np.int32), n_shared[c].astype(np.int32), hs[pick], df[pick])))
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)

    return run


_COUNTED = (np.int64, np.int64, np.int32, np.int64, np.int32, np.int32, np.int32, np.uint64, np.int32)


def _gather(num: int):
    def run(table: pa.Table) -> pa.Table:
        got = [unpack(x.as_py(), *_COUNTED) for x in table.column("payload")]
        doc, did, dn, cid, n, count, shared, hs, df = (np.concatenate([g[i] for g in got]) for i in range(9))
        rows: list[tuple] = [(0, int(a), int(b), int(c), None, None, None) for a, b, c in zip(doc, did, dn, strict=True)]
        ids, inverse = np.unique(cid, return_inverse=True)
        size = np.zeros(len(ids), np.int64)
        size[inverse] = n
        lone = np.bincount(inverse, count - shared, len(ids)).astype(np.int64)
        prefix = size - need(size, num) + 1 - lone
        order = np.lexsort((hs, df, np.repeat(inverse, shared)))
        hs = hs[order]
        end = np.cumsum(np.bincount(inverse, shared, len(ids)).astype(np.int64))
        for i in np.flatnonzero(prefix > 0):
            lo = end[i - 1] if i else 0
            rows.append((1, None, int(ids[i]), int(size[i]), int(lone[i]), int(prefix[i]), hs[lo : end[i]].view(np.int64)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEXED, strict=True)] if rows else [pa.array([], f.type) for f in _INDEXED], schema=_INDEXED)

    return run


def index(docs: DataFrame, k: int = 5, num: int = 75) -> DataFrame:
    """From docs(doc_id, text): a row of kind 0 for each document (doc_id, cid, n: id and size of its set)
    and one of kind 1 for each distinct set that can have a partner (cid, n, lone, prefix, tokens).

    tokens: the set's members that other sets have too, rarest first; a partner shares one of the
    first `prefix` of them. lone: how many members no other set has.
    """
    parts = buckets(docs.sparkSession, 8)
    dealt = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(K.tidy(_deal(parts, k)), PACKED)
    counted = dealt.groupBy("part").applyInArrow(K.tidy(_count(parts)), PACKED)
    return counted.groupBy("part").applyInArrow(K.tidy(_gather(num)), INDEXED)
