"""Chunkers: fixed windows, recursive back-off, and by sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What to cut after, best first.
SEPARATORS = ["\n\n", "\n", ". ", "; ", " "]


def validate(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"size {size} must be positive and overlap {overlap} from 0 to size - 1")


def fixed(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """docs(doc_id, text) -> doc_id, chunk_idx, char_start, char_end."""
    validate(size, overlap)
    step, n = size - overlap, F.length("text")
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    rows = docs.where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"))
    return rows.select("doc_id", "chunk_idx", (F.col("chunk_idx") * step).alias("char_start"), F.least(F.col("chunk_idx") * step + size, F.col("n")).alias("char_end"))


class Breaks:
    """Where a text can be cut: sorted offsets, found once for the whole text and then looked up by bisection."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.text = text
        self.after = [(len(sep), self._behind(code, [ord(c) for c in sep])) for sep in SEPARATORS]
        self.word = np.flatnonzero(np.isin(code, [ord(" "), ord("\n")])) + 1

    @staticmethod
    def _behind(code: np.ndarray, sep: list[int]) -> np.ndarray:
        """The offset behind each occurrence of a separator, overlapping ones too."""
        n = max(0, len(code) - len(sep) + 1)
        here = np.ones(n, bool)
        for i, c in enumerate(sep):
            here &= code[i : i + n] == c
        return np.flatnonzero(here) + len(sep)

    def end(self, low: int, high: int) -> int:
        """Behind the last of the best separators that stand whole in [low, high), else high."""
        for size, after in self.after:
            i = np.searchsorted(after, high, "right") - 1
            if i >= 0 and after[i] - size >= low:
                return int(after[i])
        return high

    def begin(self, at: int) -> int:
        """at, or where the word begins that it falls into."""
        if at > 0 and self.text[at - 1 : at + 1].isalnum():
            i = np.searchsorted(self.word, at, "right") - 1
            return int(self.word[i]) if i >= 0 else at
        return at


def cut(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most `size`, each ended after the best separator of its last 40 %, and begun at a word."""
    breaks, spans, at = Breaks(text), [], 0
    while at + size < len(text):
        end = breaks.end(at + int(size * 0.6), at + size)
        spans.append((at, end))
        at = max(at + 1, breaks.begin(end - overlap))
    return [*spans, (at, len(text))] if text else []


def _cutter(size: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, base + s, base + e) for d, base, t in zip(b["doc_id"], b["base"], b["text"], strict=True) for s, e in cut(t, size, overlap)]
            yield pd.DataFrame(rows, columns=["doc_id", "char_start", "char_end"])

    return run


def _pieces(parts: DataFrame, size: int, overlap: int) -> DataFrame:
    kind = parts.schema["doc_id"].dataType.simpleString()
    return parts.mapInPandas(_cutter(size, overlap), f"doc_id {kind}, char_start int, char_end int")


def _numbered(spans: DataFrame) -> DataFrame:
    return spans.withColumn("chunk_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("char_start", "char_end")) - 1).select("doc_id", "chunk_idx", "char_start", "char_end")


def recursive(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    validate(size, overlap)
    return _numbered(_pieces(docs.where("text is not null").select("doc_id", F.lit(0).alias("base"), "text"), size, overlap))


def structural(docs: DataFrame, boundaries: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Cut where sections begin, boundaries(doc_id, char_start); larger sections are cut further."""
    validate(size, overlap)
    n = docs.where("text is not null").select("doc_id", F.length("text").alias("n"))
    inner = boundaries.select("doc_id", F.col("char_start").cast("int").alias("edge")).join(n, "doc_id").where((F.col("edge") > 0) & (F.col("edge") < F.col("n"))).select("doc_id", "edge", "n")
    edges = inner.unionByName(n.where("n > 0").select("doc_id", F.lit(0).alias("edge"), "n")).distinct()
    nxt = F.coalesce(F.lead("edge").over(Window.partitionBy("doc_id").orderBy("edge")), "n")
    spans = edges.select("doc_id", F.col("edge").alias("char_start"), nxt.alias("char_end"))
    small = spans.where(F.col("char_end") - F.col("char_start") <= size)
    large = spans.where(F.col("char_end") - F.col("char_start") > size).join(docs.select("doc_id", "text"), "doc_id")
    large = large.select("doc_id", F.col("char_start").alias("base"), F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"))
    return _numbered(small.unionByName(_pieces(large, size, overlap)))


STRATEGIES = ["fixed", "recursive", "structural"]


def chunk(docs: DataFrame, strategy: str = "recursive", size: int = 800, overlap: int = 100, boundaries: DataFrame | None = None) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "structural" and boundaries is not None:
        return structural(docs, boundaries, size, overlap)
    return fixed(docs, size, overlap) if strategy == "fixed" else recursive(docs, size, overlap)


def to_rows(spans: DataFrame, docs: DataFrame, strategy: str) -> DataFrame:
    """Spans as chunk rows with text and an id."""
    text = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return spans.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "chunk_idx", F.format_string("c%04d", F.col("chunk_idx")).alias("chunk_id"), "char_start", "char_end", F.lit(strategy).alias("strategy"), text.alias("text"))
