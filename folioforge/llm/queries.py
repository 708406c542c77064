"""Queries opN_<name> of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_byte_bpe
from .chat import op2_chat_format
from .gam import op4_quality_classifier
from .jaccard import op10_ngram_jaccard
from .media import op1_media_columns
from .packing import op7_best_fit_packing
from .rules import op8_quality_rules
from .secrets import op6_secret_scan
from .sharding import op3_external_shuffle
from .toxicity import op5_toxicity
from .sql import OP8_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_chat_format": op2_chat_format,
    "op3_external_shuffle": op3_external_shuffle,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}
ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": OP8_SQL,
}
