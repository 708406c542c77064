"""Page rules and routing between direct text and recognised pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import text as T

KEY = ["book_id", "chapter_number"]
LEAST_DIRECT_ALNUM, LEAST_PAGE_WORDS = 800, 30


def route(chapters: DataFrame, forced: bool = False, least: int = LEAST_DIRECT_ALNUM) -> DataFrame:
    """route: direct where the text has enough letters and digits and recognition is not forced, else ocr."""
    enough = (T.alnum_count(F.col("text")) >= least) & F.lit(not forced)
    return chapters.withColumn("route", F.when(enough, "direct").otherwise("ocr"))


def judge_pages(pages: DataFrame, least_words: int = LEAST_PAGE_WORDS, keep_low: bool = False) -> DataFrame:
    """Pages (KEY, page_number, text) with text normalized, word_count, alnum_count and kept."""
    clean = pages.withColumn("text", T.normalize(F.col("text")))
    counted = clean.withColumn("word_count", T.word_count(F.col("text"))).withColumn("alnum_count", T.alnum_count(F.col("text")))
    return counted.withColumn("kept", F.lit(keep_low) | (F.col("word_count") >= least_words))


def usable_pages(judged: DataFrame) -> DataFrame:
    """Kept pages with text; of chapters that have none, all pages with text. kept itself does not change."""
    any_kept = judged.groupBy(*KEY).agg(F.bool_or(F.col("kept") & (F.col("text") != "")).alias("__any"))
    return judged.filter("text <> ''").join(any_kept, KEY).filter("kept OR NOT __any").drop("__any")


def combine_pages(usable: DataFrame) -> DataFrame:
    """One text a chapter: its pages in order, with blank lines between."""
    joined = usable.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    return joined.select(*KEY, T.strip(F.array_join(F.col("p.text"), "\n\n")).alias("text"))


def page_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(*KEY).agg(F.count_if("kept").alias("kept_pages"), F.count_if(~F.col("kept")).alias("skipped_pages"))


def extract_pdf(direct: DataFrame, recognise: Callable[[DataFrame], DataFrame], forced: bool = False, least_alnum: int = LEAST_DIRECT_ALNUM, least_words: int = LEAST_PAGE_WORDS, keep_low: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chapters: KEY, text, used_ocr; judged pages) of PDF chapters.

    direct holds KEY, text and what recognise needs to give pages (KEY, page_number, text) of chapters whose embedded text
    is too short. Embedded text stays as it is; recognised pages are normalized, judged and combined. A chapter whose
    pages all are empty has an empty text.
    """
    routed = route(direct.withColumn("text", F.coalesce("text", F.lit(""))), forced, least_alnum)
    scanned = routed.filter("route = 'ocr'")
    judged = judge_pages(recognise(scanned.drop("route")), least_words, keep_low)
    combined = scanned.select(KEY).join(combine_pages(usable_pages(judged)), KEY, "left").withColumn("text", F.coalesce("text", F.lit("")))
    whole = routed.filter("route = 'direct'").select(*KEY, "text", F.lit(False).alias("used_ocr"))
    return whole.unionByName(combined.select(*KEY, "text", F.lit(True).alias("used_ocr"))), judged


def number_pages(pages: DataFrame, order: str) -> DataFrame:
    """page_number from 1 by an order column, for sources that give none."""
    return pages.withColumn("page_number", F.row_number().over(Window.partitionBy(*KEY).orderBy(order)))
