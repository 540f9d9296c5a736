"""Sources of pages, and sinks."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import LINES_PER_PAGE, paginate

TEXT_SUFFIXES = (".txt", ".md", ".markdown")


def read_text(spark: SparkSession, path: str, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Text files as pages: doc_id (the path), source, page, extractor, text. Bad bytes become replacement characters."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))
    pages = paginate(raw, lines_per_page)
    return pages.select("doc_id", F.element_at(F.split("doc_id", "/"), -1).alias("source"), "page", F.lit("text").alias("extractor"), "text")


def _pdf_pages(library: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import importlib
        import io

        lib = importlib.import_module(library)
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                if library == "pypdf":
                    texts = [p.extract_text() or "" for p in lib.PdfReader(io.BytesIO(content)).pages]
                else:
                    with lib.open(io.BytesIO(content)) as pdf:
                        texts = [p.extract_text() or "" for p in pdf.pages]
                rows += [(path, path.rsplit("/", 1)[-1], i + 1, library, t) for i, t in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "page", "extractor", "text"])

    return run


def read_pdf(spark: SparkSession, path: str, library: str) -> DataFrame:
    """One row per page, by a library that must be installed on the executors; a file is read whole by one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_pdf_pages(library), "doc_id string, source string, page int, extractor string, text string")


EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "pypdf": lambda spark, path: read_pdf(spark, path, "pypdf"),
    "pdfplumber": lambda spark, path: read_pdf(spark, path, "pdfplumber"),
    "text": read_text,
}


def load(spark: SparkSession, path: str, extractor: str | None = None) -> DataFrame:
    """Pages of the files at path; the extractor is chosen by suffix, for PDF the first that is installed."""
    if extractor is None:
        if PurePosixPath(path).suffix.lower() in TEXT_SUFFIXES:
            extractor = "text"
        else:
            extractor = next((x for x in ("pypdf", "pdfplumber") if importlib.util.find_spec(x)), None)
            if extractor is None:
                raise ImportError("no PDF library is installed: install pypdf or pdfplumber, or give text files")
    if extractor not in EXTRACTORS:
        raise ValueError(f"extractor must be one of {sorted(EXTRACTORS)}")
    return EXTRACTORS[extractor](spark, path)


SAMPLE = [
    "Field Station Manual\nA.1 Arrivals\nA.1.1 Keys and badges\nThe warden hands out badges at the front oﬃce. Every visitor signs the\nregister, which is kept at the desk by the calen-\ndar on the wall.\nPage 1 of 4",
    "Field Station Manual\nA one-\ntime code opens the gate. A guest who loses the code asks the warden, who\nchecks the “register” and gives out a new one to\nPage 2 of 4",
    "Field Station Manual\nthe guest in person.\n\nA.2 Boats\nA.2.1 Booking\nBoats are booked a day ahead — no later. Each crew has two people.\nPage 3 of 4",
    "Field Station Manual\nA.2.2 Fuel\nFuel is measured before and after each trip, and the diﬀerence is written in the log.\nPage 4 of 4",
]


def sample(spark: SparkSession) -> DataFrame:
    """A small manual with every kind of damage that cleaning mends."""
    return spark.createDataFrame([("sample", "sample", i + 1, "sample", t) for i, t in enumerate(SAMPLE)], "doc_id string, source string, page int, extractor string, text string")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(docs: DataFrame, path: str) -> None:
    """One text file part per task; a row is one document's text."""
    docs.select("text").write.mode("overwrite").text(path)


def write_artifacts(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON in a folder of its own."""
    for name, df in tables.items():
        write_json(df, f"{folder.rstrip('/')}/{name}")
