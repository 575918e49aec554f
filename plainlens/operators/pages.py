"""Text of paged documents: repeated headers and footers, and the joined text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.rows import exploded


def _lines(text: str) -> Column:
    """A page's stripped, non-blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), T.strip_ws), lambda x: x != "")


def page_lines(pages: DataFrame, doc: str, page: str, text: str, head: int | None = None, foot: int = 0) -> DataFrame:
    """Stripped, non-blank lines with their 0-based position and the page's number of lines; with head only the first and last
    ones of each page."""
    rows = pages.select(doc, page, _lines(text).alias("_l"))
    if head is None:
        return exploded(rows, [doc, page, F.size("_l").alias("n_lines")], "_l", "line", "line_no")
    near = F.filter(F.transform("_l", lambda x, i: F.struct(x.alias("line"), i.alias("line_no"))), lambda x: (x["line_no"] < head) | (x["line_no"] >= F.size("_l") - foot))
    return exploded(rows, [doc, page, F.size("_l").alias("n_lines")], near, "_e").select(doc, page, "n_lines", "_e.line", "_e.line_no")


def margin_counts(lines: DataFrame, doc: str, head: int = 2, foot: int = 2, least: int = 3, nbsp: bool = False) -> DataFrame:
    """Normalised first and last lines that occur `least` times or more in a document: doc, kind, norm, n.

    A line in both ranges of a short page counts in both.
    """
    kinds = F.array_compact(F.array(F.when(F.col("line_no") < head, "head"), F.when(F.col("line_no") >= F.col("n_lines") - foot, "foot")))
    near = lines.filter((F.col("line_no") < head) | (F.col("line_no") >= F.col("n_lines") - foot))
    norm = near.select(doc, F.explode(kinds).alias("kind"), T.normalize_for_match(F.col("line"), nbsp).alias("norm"))
    return norm.groupBy(doc, "kind", "norm").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def without_margins(pages: DataFrame, doc: str, page: str, text: str, head: int = 2, foot: int = 2, least: int = 3, nbsp: bool = False) -> DataFrame:
    """doc, page, text without the repeated first and last lines; pages without a line stay, empty.

    Only the first and last lines become rows; the others stay in their page.
    """
    near = page_lines(pages, doc, page, text, head, foot)
    # the lines of a document that read the same meet once, and are counted where they meet
    edges = near.select(doc, page, "line_no", (F.col("line_no") < head).alias("_h"), (F.col("line_no") >= F.col("n_lines") - foot).alias("_f"), T.normalize_for_match(F.col("line"), nbsp).alias("norm"))
    same = Window.partitionBy(doc, "norm")
    counted = edges.withColumns({"_nh": F.count_if("_h").over(same), "_nf": F.count_if("_f").over(same)})
    gone = counted.filter((F.col("_h") & (F.col("_nh") >= least)) | (F.col("_f") & (F.col("_nf") >= least)))
    by_page = gone.groupBy(doc, page).agg(F.collect_set("line_no").alias("_g"))
    rows = pages.select(doc, page, _lines(text).alias("_l")).join(by_page, [doc, page], "left")
    left = F.when(F.col("_g").isNull(), F.col("_l")).otherwise(F.filter("_l", lambda x, i: ~F.array_contains("_g", i)))
    return rows.select(doc, page, F.array_join(left, "\n").alias("text"))


def too_short(texts: Column, least: int = 200) -> Column:
    """Whether an array of page texts has fewer stripped characters than `least`: then the other reader's are taken."""
    return F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.lit(0), lambda n, p: n + F.length(F.coalesce(T.strip_ws(p), F.lit("")))) < least


def chosen_pages(df: DataFrame, primary: str, fallback: str, name: str = "pages") -> DataFrame:
    return df.withColumn(name, F.when(F.col(primary).isNull() | too_short(F.col(primary)), F.col(fallback)).otherwise(F.col(primary)))


def full_text(pages: DataFrame, doc: str, page: str, text: str, nbsp: bool = False) -> DataFrame:
    """doc, text: margins removed, pages joined by an empty line, lines joined."""
    cleaned = without_margins(pages, doc, page, text, nbsp=nbsp)
    ordered = F.sort_array(F.collect_list(F.struct(page, "text")))
    joined = cleaned.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))
    return joined.select(doc, T.join_lines(F.col("text"), nbsp).alias("text"))


def with_next_start(spans: DataFrame, doc: str, start: str) -> DataFrame:
    """Each span with the start of the next one of its document."""
    return spans.withColumn("next_start", F.lead(start).over(Window.partitionBy(doc).orderBy(start)))
