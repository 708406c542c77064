"""A corpus pipeline of five stages over documents: rules, classifier, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

In every stage a null text counts as empty, texts are read whole whatever their length, repeated rows are judged alike,
an empty table gives an empty one, and columns beside doc_id, text and n_chars, whatever their names, are carried along
unread. What the rules of single stages are for such rows is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import documents, packed, release_staged, spread, stage_table, staged_tables
from folioforge.llm.gam import learn_quality, score_quality
from folioforge.llm.jaccard import jaccard_classes, keep_one
from folioforge.llm.packing import pack, token_pieces
from folioforge.llm.rules import keep_passing
from folioforge.llm.secrets import mask_secrets, scan_secrets

#: Documents that score less go, as in op4_quality_classifier.
LEAST_SCORE = 0.7


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts have fewer than ten words and go; repeated rows all stay or go."""
    return keep_passing(spread(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score LEAST_SCORE or more; a score of just that stays.

    The model learns from labelled rows of all documents, as the rules leave few bad ones. Empty texts are scored like
    any other. Without labels all scores are 0.5, and no document stays.
    """
    model = learn_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(packed(spread(docs)), model, ["row"], "row.text")
    return scored.filter(F.col("score") >= LEAST_SCORE).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles with a similarity of 0.8 or more join.

    The one of the least doc_id stays; of rows equal in doc_id and text one stays. Texts without words link with nothing
    and all stay, as do rows of null doc_id that link with none.
    """
    return keep_one(docs, stage_table(jaccard_classes(spread(docs)), "classes"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by a mask, and n_chars set to the new length.

    Overlapping secrets take one mask. Null texts stay null, with an n_chars of null.
    """
    found = scan_secrets(packed(spread(docs)).select("row", "row.text"), keep_columns=["row"])
    text = F.when(F.col("row.text").isNotNull(), mask_secrets(F.col("row.text"), F.col("secrets")))
    masked = found.select("row", text.alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.length("masked")}
    return masked.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048. A null or empty text is one piece of the end mark."""
    pieces = token_pieces(spread(docs), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The classifier is learned from data and the tokenizer has no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What a stage has staged for itself goes when its result is written."""
    docs = documents(spark, sf_dir)
    before = staged_tables()
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
        release_staged(before, but_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
