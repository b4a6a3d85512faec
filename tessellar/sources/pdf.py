"""PDF files: shown text by line with its place, pages, bookmarks, chapters; and resumable runs.

Files are read whole, one a row, as the format is no stream; everything after that is rows of lines. A file that
can't be read, or is over a limit, is one row with its error and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar.sources.files import canonical_json
from tessellar.sources.pdf_objects import Pdf, lines, spans

LINE = {"page": "Int32", "line": "Int32", "text": "object", "x0": "float64", "y0": "float64", "x1": "float64", "y1": "float64", "size": "float64", "font": "object"}


def _scanned(spark: SparkSession, path: str, rows_of: Callable[[Pdf], Iterator[tuple]], kinds: dict[str, str], schema: str, most_bytes: int | None) -> DataFrame:
    """(path, what rows_of gives, error) of every PDF under path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for name, size, content in zip(own["path"], own["length"], own["content"], strict=True):
                try:
                    if content is None:
                        raise ValueError(f"{size} bytes are over the limit of {most_bytes}")
                    out = [(name, *row, None) for row in rows_of(Pdf(bytes(content)))]
                except Exception as e:  # whatever is wrong with a file is the file's state
                    out = [(name, *[None] * len(kinds), f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=["path", *kinds, "error"]).astype(kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    content = F.col("content") if most_bytes is None else F.when(F.col("length") <= most_bytes, F.col("content"))
    return files.select("path", "length", content.alias("content")).mapInPandas(run, f"path string, {schema}, error string")


def pdf_lines(spark: SparkSession, path: str, most_bytes: int | None = None, most_pages: int | None = None) -> DataFrame:
    """(path, page, line, text, x0, y0, x1, y1, size, font, error): lines in the order shown, boxes from the top left corner.

    A page without text is a row with neither line nor text, so that pages can be counted.
    """

    def rows_of(pdf: Pdf) -> Iterator[tuple]:
        pages = [page for page, _ in pdf.pages()]
        if most_pages is not None and len(pages) > most_pages:
            raise ValueError(f"{len(pages)} pages are over the limit of {most_pages}")
        for number, page in enumerate(pages, 1):
            found = [s for s in lines(spans(pdf, page)) if s.text.strip()]
            for k, s in enumerate(found, 1):
                yield number, k, s.text.strip(), s.x0, s.y0, s.x1, s.y1, s.size, s.font
            if not found:
                yield number, *[None] * 8

    return _scanned(spark, path, rows_of, LINE, "page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string", most_bytes)


def pdf_pages(spark: SparkSession, path: str, **limits) -> DataFrame:
    """(path, page, text, error): the lines of each page joined by line breaks."""
    rows = pdf_lines(spark, path, **limits)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    return rows.groupBy("path", "page", "error").agg(text.alias("text")).select("path", "page", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text, error) by a caller's extractor, which gives the pages' texts of one file: as for files with pictures of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            out = []
            for name, content in zip(own["path"], own["content"], strict=True):
                try:
                    out += [(name, i + 1, text, None) for i, text in enumerate(extract(bytes(content)))]
                except Exception as e:  # any error of the caller's library is the file's state
                    out.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, page int, text string, error string")


def pdf_outline(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """(path, place, level, title, page, error) of every bookmark, in order; page 0 if it leads to no page."""
    rows_of = lambda pdf: ((k, *row) for k, row in enumerate(pdf.outline(), 1))
    return _scanned(spark, path, rows_of, {"place": "Int32", "level": "Int32", "title": "object", "page": "Int32"}, "place int, level int, title string, page int", most_bytes)


def chapters(outline: DataFrame) -> DataFrame:
    """(path, title, start_page, end_page): top bookmarks that have a title and a page, each up to the next one's page, the last without end."""
    title = F.trim(F.regexp_replace("title", "\ufeff", ""))
    top = outline.where("error is null and level = 1 and page > 0").select("path", "place", title.alias("title"), "page").where("title <> ''")
    after = F.lead("page").over(Window.partitionBy("path").orderBy("place"))
    return top.select("path", "title", F.col("page").alias("start_page"), F.greatest("page", F.coalesce(after - 1, F.lit(10**9))).alias("end_page"))


def outline_intervals(outline: DataFrame, key: str = "path", start: str = "page") -> DataFrame:
    """Chapters with their last pages."""
    from tessellar.operators.relational import intervals

    return intervals(outline, key, start)


def fingerprint(config: dict, first: str, last: str, rows: int) -> str:
    """What a resumable run must agree on with the one that it goes on with."""
    return hashlib.sha256(canonical_json({"config": config, "first": first, "last": last, "rows": rows}).encode()).hexdigest()


def resume(spark: SparkSession, path: str, mark: str, chunks: DataFrame, key: str) -> DataFrame:
    """Chunks not yet written under path by a run with this fingerprint; another run's output is refused."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{mark}")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path.getParent()):
        others = [s.getPath().getName() for s in fs.listStatus(fs_path.getParent())]
        if any(o != mark for o in others):
            raise ValueError("the folder holds another run's output")
        return chunks.join(spark.read.parquet(f"{path}/{mark}").select(key), key, "left_anti")
    return chunks


def append_done(done: DataFrame, path: str, mark: str) -> None:
    done.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{path}/{mark}")
