"""Chapters into paragraphs, sentences and bounded segments. One row a chapter in, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.plans.config import Chunking

KEY = ["book_id", "chapter_number"]


def explode_paragraphs(chapters: DataFrame) -> DataFrame:
    placed = chapters.select(*KEY, F.posexplode_outer(T.paragraphs(F.col("text"))).alias("paragraph_index", "text")).filter("text IS NOT NULL")
    return placed.withColumn("paragraph_index", F.col("paragraph_index") + 1)


def explode_sentences(chapters: DataFrame) -> DataFrame:
    pars = explode_paragraphs(chapters)
    return pars.select(*KEY, "paragraph_index", F.posexplode_outer(T.sentences(F.col("text"))).alias("sentence_index", "text")).withColumn("sentence_index", F.col("sentence_index") + 1)


def segment_arrays(chapters: DataFrame, chunking: Chunking | None = None) -> DataFrame:
    """chapters with segments, an array of structs: chapter-wide numbers from 1 and stable ids.

    Chunks never cross paragraphs; empty chapters have none. Numbers are places in the array, so that nothing is shuffled.
    """
    limit = (chunking or Chunking()).most

    def rows(chunks, paragraph):
        return F.transform(
            chunks,
            lambda c, k: F.struct((paragraph + 1).alias("paragraph_index"), c.alias("text"), (k == 0).alias("starts_paragraph"), (k == F.size(chunks) - 1).alias("ends_paragraph")),
        )

    def record(piece, place):
        index = place + 1
        head = [T.segment_id(F.col("chapter_number"), index).alias("segment_id"), index.alias("index"), piece["paragraph_index"].alias("paragraph_index"), piece["text"].alias("text")]
        return F.struct(*head, F.length(piece["text"]).alias("char_count"), piece["starts_paragraph"].alias("starts_paragraph"), piece["ends_paragraph"].alias("ends_paragraph"))

    pieces = F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p, i: T.bind(T.chunks_of_paragraph(p, limit), lambda c: rows(c, i))))
    return chapters.withColumn("segments", F.transform(pieces, record))


def segment_chapters(chapters: DataFrame, chunking: Chunking | None = None) -> DataFrame:
    """One row a segment: KEY and the fields of segment_arrays. Chapters without segments give none."""
    # Outer, as for the inner one Spark filters by the array's size before, and makes the array twice.
    placed = segment_arrays(chapters, chunking).select(*KEY, F.explode_outer("segments").alias("s")).filter("s IS NOT NULL")
    return placed.select(*KEY, "s.*")


def check_languages(chapters: DataFrame, strict: bool = True, column: str = "language") -> DataFrame:
    """strict: a row of an unsupported language fails the query when read. Otherwise violations lists what is wrong."""
    code = T.language_code(F.col(column))
    if strict:
        refused = F.raise_error(F.concat(F.lit("Unsupported target language code '"), F.col(column), F.lit("'")))
        return chapters.withColumn(column, F.when(T.supported_language(F.col(column)), code).otherwise(refused.cast("string")))
    return chapters.withColumn("violations", F.when(T.supported_language(F.col(column)), F.array().cast("array<string>")).otherwise(F.array(F.lit("unsupported_language"))))
