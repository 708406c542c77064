"""Chapter files: text by Spark's binary reader, PDF pages by external tools where executors have them."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T

TOOLS = ("pdftotext", "pdftoppm", "tesseract")


def read_text_chapters(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, source_kind, used_ocr, text) of whole files. CR and CRLF become LF; bad UTF-8 fails if strict, else text is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = files.filter(T.source_kind(F.col("path")) == "text")
    decoded = F.decode("content", "UTF-8") if strict else F.when(F.expr("is_valid_utf8(cast(content AS string))"), F.col("content").cast("string"))
    return files.select("path", F.lit("text").alias("source_kind"), F.lit(False).alias("used_ocr"), F.regexp_replace(decoded, r"\r\n?", "\n").alias("text"))


def route_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """paths with source_kind; an unsupported suffix fails the query when it is read."""
    refused = F.raise_error(F.concat(F.lit("Unsupported chapter format: "), F.col(column))).cast("string")
    return paths.withColumn("source_kind", F.coalesce(T.source_kind(F.col(column)), refused))


def input_kind(path: Column, chosen: Column) -> Column:
    """auto: pdf by suffix, else text; otherwise what was chosen."""
    return F.when(chosen != "auto", chosen).when(F.lower(path).endswith(".pdf"), "pdf").otherwise("text")


def _run(command: list[str]) -> str:
    return subprocess.run(command, check=True, capture_output=True, text=True).stdout


def require_tools() -> None:
    for tool in TOOLS:
        if shutil.which(tool) is None:
            raise RuntimeError(f"required tool is not installed: {tool}")


def _pdf_rows(path: str, content: bytes, direct: bool) -> Iterator[tuple]:
    with tempfile.TemporaryDirectory() as scratch:
        pdf = os.path.join(scratch, "chapter.pdf")
        with open(pdf, "wb") as f:
            f.write(content)
        if direct:
            yield path, 0, _run(["pdftotext", pdf, "-"])
            return
        _run(["pdftoppm", "-png", pdf, os.path.join(scratch, "page")])
        images = sorted(n for n in os.listdir(scratch) if n.endswith(".png"))
        if not images:
            raise RuntimeError(f"no pages were rendered from {path}")
        for number, name in enumerate(images, 1):
            yield path, number, _run(["tesseract", os.path.join(scratch, name), "stdout"])


def read_pdf(files: DataFrame, direct: bool) -> DataFrame:
    """(path, page_number, text) of files (path, content): the embedded text as page 0, or recognised pages from 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        require_tools()
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(list(_pdf_rows(path, content, direct)), columns=["path", "page_number", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string")


def append_log(rows: DataFrame, path: str) -> None:
    """Append (timestamp, message, payload) rows as JSON lines."""
    rows.select("timestamp", "message", "payload").write.mode("append").json(path)
