"""Vectorised text kernels over Arrow string columns: words, word hashes and shingles, without a Python loop per word."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROUND = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are part of a word: all but space, \t, \n, \v, \f and \r.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes that are part of a word: ASCII letters and digits, and all of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

CHUNK = 1 << 19


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, and what they keep counts."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow or applyInArrow that releases memory when its task's input ends, or its group."""

    @functools.wraps(run)
    def over(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    @functools.wraps(run)
    def group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return over if run.__code__.co_flags & 0x20 else group


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text is alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _spans(buf: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in buf; no word reaches over one of `starts`."""
    w = table[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    starts = starts[(starts > 0) & (starts < len(buf))]
    first[starts] = w[starts]
    last[starts - 1] = w[starts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(a):
        return np.zeros(0, np.uint64)
    body = LOWER[buf[table[buf]]]
    size = b - a
    seg = np.cumsum(size) - size
    at = np.arange(len(body)) - np.repeat(seg, size)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(size.max()) - 1, BASE, np.uint64))), dtype=np.uint64)
    return mix(np.add.reduceat(BYTE[body] * power[at], seg) + size.astype(np.uint64) * ROUND[63])


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED, most: int = 4 * CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, word offsets per text, start byte, end byte) of texts in one buffer.

    A buffer far over `most` bytes (one very long text) is worked on in parts cut between words.
    """
    if len(buf) <= most:
        a, b = _spans(buf, off[:-1], table)
        return _hashes(buf, a, b, table), np.searchsorted(a, off), a, b
    hs, starts, ends, lo = [], [], [], 0
    while lo < len(buf):
        hi = min(len(buf), lo + most)
        while hi < len(buf) and table[buf[hi]] and table[buf[hi - 1]]:
            hi += 1
        part = buf[lo:hi]
        a, b = _spans(part, off[(off >= lo) & (off < hi)] - lo, table)
        hs.append(_hashes(part, a, b, table))
        starts.append(a + lo)
        ends.append(b + lo)
        lo = hi
    a = np.concatenate(starts)
    return np.concatenate(hs), np.searchsorted(a, off), a, np.concatenate(ends)


def shingles(h: np.ndarray, woff: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets per text) of the k-word shingles, repeats included; of a text with fewer words, its whole sequence as one."""
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    soff = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(woff[:-1], count) + (np.arange(soff[-1]) - np.repeat(soff[:-1], count))
    size = np.minimum(np.repeat(n, count), k)
    out = np.zeros(int(soff[-1]), np.uint64)
    top = len(h) - 1
    for j in range(k):
        if (size > j).all():
            out += h[first + j] * ROUND[j]
        else:
            out += np.where(size > j, h[np.minimum(first + j, top)] * ROUND[j], np.uint64(0))
    return mix(out + size.astype(np.uint64) * ROUND[62]), soff
