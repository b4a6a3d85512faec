"""Lines of a page into words, headings and sections, by windows over their places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Header of what stands before the first heading; a fixed value.
PREFACE = "머리말"
#: What isn't a heading though it looks like one; a fixed value.
SYMBOLS = r"(?U)[❶-❾■□•\-\d\s.)]+"
LEAST_HEADING_SIZE = 8.8
LONGEST_HEADING = 30


def merge_vertical(lines: DataFrame, keys: list[str], x_tol: float = 1.5, y_tol: float = 3.0) -> DataFrame:
    """Short lines one right under the other, as labels of drawings are shown, joined to the word that they spell.

    lines hold keys, page, line (their order), text, x0, y0, y1 and is_header. A line goes on the one before it if
    both have at most two characters and a box on the same page, their left edges are less than x_tol apart and the top
    of one less than y_tol from the bottom of the other. Islands of such lines become one line that is no heading;
    all others stay. Gives keys, page, line, text, is_header and n, the lines joined.
    """
    page = Window.partitionBy(*keys, "page").orderBy("line")
    short = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull() & (F.length("text") <= 2)
    marked = lines.withColumn("short", short)
    goes_on = F.col("short") & F.lag("short").over(page) & (F.abs(F.col("x0") - F.lag("x0").over(page)) < x_tol) & (F.abs(F.col("y0") - F.lag("y1").over(page)) < y_tol)
    island = F.sum(F.when(F.coalesce("goes_on", F.lit(False)), 0).otherwise(1)).over(page)
    marked = marked.withColumn("goes_on", goes_on).withColumn("island", island)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "")
    return marked.groupBy(*keys, "page", "island").agg(F.min("line").alias("line"), text.alias("text"), (F.bool_or("is_header") & (F.count("*") == 1)).alias("is_header"), F.count("*").alias("n")).drop("island")


def with_headings(lines: DataFrame) -> DataFrame:
    """lines (text, size, font) with is_header: bold, large enough, 2 to 30 characters, not only numbers and marks."""
    size = F.length("text")
    heading = F.col("font").contains("Bold") & (F.col("size") >= LEAST_HEADING_SIZE) & (size > 1) & (size <= LONGEST_HEADING) & ~F.col("text").rlike(f"^{SYMBOLS}$")
    return lines.withColumn("is_header", F.coalesce(heading, F.lit(False)))


def sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, page, line, text, is_header) by the heading above them: keys, section, header, start_page, end_page, blocks.

    A heading without lines before the next one has no section. A document's lines are one window's partition.
    """
    order = Window.partitionBy(*keys).orderBy("page", "line")
    marked = lines.withColumn("section", F.sum(F.col("is_header").cast("int")).over(order))
    own = F.struct("page", "line", "text")
    texts = F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_header"), own))), lambda x: x["text"])
    out = marked.groupBy(*keys, "section").agg(
        F.coalesce(F.max(F.when(F.col("is_header"), F.col("text"))), F.lit(PREFACE)).alias("header"),
        F.min("page").alias("start_page"),
        F.max(F.when(~F.col("is_header"), F.col("page"))).alias("end_page"),
        texts.alias("blocks"),
    )
    return out.where("end_page is not null")
