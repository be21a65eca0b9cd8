"""Reading text chosen page by page, page scans, and ordered concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T


def reading_text(native: Column, needs_ocr: Column, transcription: Column) -> Column:
    """A struct of text and source: the transcription if there is one, blank if it is a comment
    on an empty page or goes in circles; else the native text unless flagged; else nothing."""
    blank = T.is_empty_page_comment(transcription) | T.is_drift(transcription)
    text = F.when(transcription.isNotNull(), F.when(blank, "").otherwise(transcription)).when(~F.coalesce(needs_ocr, F.lit(False)), native)
    source = F.when(transcription.isNotNull(), "transcription").when(~F.coalesce(needs_ocr, F.lit(False)) & native.isNotNull(), "native")
    return F.struct(text.alias("text"), source.alias("source"))


def read_pages(pages: DataFrame, transcriptions: DataFrame, category: str | None = None, keep_unreadable: bool = False) -> DataFrame:
    """Pages with their reading text; ``transcriptions`` (page_id, transcription) are those served."""
    if category:
        pages = pages.filter(F.col("category") == category.upper())
    read = pages.join(transcriptions, "page_id", "left").withColumn("r", reading_text(F.col("text"), F.col("needs_ocr"), F.col("transcription")))
    read = read.drop("text", "transcription").select("*", "r.text", "r.source").drop("r")
    return read if keep_unreadable else read.filter("text is not null")


def scan_pages(pages: DataFrame, lexicon: Column) -> DataFrame:
    """Content pages of each file (file, page from 0, text): front pages skipped by category,
    pages from the end mark on and near-empty ones dropped, the rest cleaned and scored."""
    kind = T.category(F.col("file"))
    skip = F.when(kind.isin(*[k for k, n in fixed.FRONT_PAGES.items() if not n]), 0).otherwise(fixed.FRONT_PAGES["CC"])
    own = pages.withColumn("category", kind).filter(F.col("page") >= skip)
    end = F.min(F.when(F.contains("text", F.lit(fixed.END_MARK)), F.col("page"))).over(Window.partitionBy("file"))
    own = own.withColumn("end", end).filter(F.col("end").isNull() | (F.col("page") < F.col("end"))).drop("end")
    # A generated column is worked out once: a filter would be pushed below a projected one, with a second cleaning.
    own = own.withColumn("text", F.explode(F.array(T.clean_page(F.col("text"))))).filter(F.length("text") >= fixed.MIN_PAGE_CHARS)
    score = T.quality_score(F.col("text"), lexicon)
    return own.withColumn("quality_score", score).withColumn("needs_ocr", T.needs_ocr(F.col("text"), F.col("quality_score")))


def joined_text(rows: DataFrame, key: str, order: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """One text for each key: its rows in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias("text"))


def new_rows(rows: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Rows whose key is not done yet: how every pass resumes."""
    return rows.join(done.select(*key).distinct(), list(key), "left_anti")


def perimeter(pages: DataFrame, names: str) -> DataFrame:
    """Pages of any of the perimeters named with +: manuscrit, typé, suspect, tout."""
    rules = {"manuscrit": "needs_ocr <=> true", "type": "needs_ocr <=> false", "suspect": "needs_ocr <=> false and quality_score < 0.6", "tout": "true"}
    return pages.filter(" or ".join(f"({rules[n.strip().replace('é', 'e')]})" for n in names.split("+")))
