"""Segments of chapters as they arrive: a file stream, whose checkpoint stands for polling a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.segment import segment_chapters
from folioforge.operators.state import pending
from folioforge.plans.config import Chunking

CHAPTER_SCHEMA = "book_id string, chapter_number int, language string, text string"


def segment_stream(spark: SparkSession, source: str, target: str, checkpoint: str, chunking: Chunking | None = None, available_now: bool = True) -> StreamingQuery:
    """Write pending segments of new chapter files to target, each file once.

    A batch that is repeated after a failure overwrites its own folder and so adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        pending(segment_chapters(batch, chunking)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(CHAPTER_SCHEMA).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
