"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, let, packed, spread, text_of

#: Frequent function words of the four languages, compared in lower case without edge punctuation.
STOP_WORDS = (
    "the of and to in is for on that with as was by be at from are this it or an he not "
    "der die und das den von zu mit im ist ein eine des dem auf sich nicht es "
    "el la de que y en los las por con una un del se para no su al lo "
    "le les et des est dans pour qui une sur pas au du par plus ne ce il"
).split()

#: rule name, SQL over the measures (all counts are long, ratios double), applied from this many words on.
#: A document is rejected if any rule holds.
THRESHOLDS = (
    ("symbols", "n_symbols > 0.25 * n_words", 1),
    ("repeated_lines", "n_dup_lines > 0.5 * n_lines", 1),
    ("long_words", "word_chars > 15.0 * n_words", 1),
    ("short_words", "word_chars < 2.0 * n_words", 1),
    ("few_letters", "n_letters < 0.5 * word_chars", 1),
    ("shouting", "n_bangs > 0.5 * n_words", 1),
    ("no_stop_words", "n_stop_words = 0", 100),
)
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_bangs", "n_stop_words")
WINDOW = 5


def _matches(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]", ""))).cast("long")


def _covered_by_repeats(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort (hash, position), keep equal neighbours, merge intervals."""

    def neighbours(ranked: Column) -> Column:
        n = F.size(ranked)
        same = lambda x, other: F.get(ranked, other)["h"] == x["h"]
        twice = F.filter(ranked, lambda x, k: F.coalesce(((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))) | ((k < n - 1) & same(x, k + 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def length(places: Column) -> Column:
        gap = lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))
        return F.aggregate(F.transform(places, gap), F.lit(0).cast("long"), lambda a, x: a + x)

    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ranked, lambda r: let(neighbours(r), length))


def _repeat_words(words: Column) -> Column:
    """Words in windows of five found twice or more in the text. Windows are compared by a 64-bit hash of word hashes."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(WINDOW))),
        )

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered_by_repeats(h))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda w: F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows(w), count)))


def measure(text: Column) -> Column:
    """Struct of MEASURES for one text."""
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.ltrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    edge = ".,;:!?\"'()#*$%&|<>"
    stops = F.array(*(F.lit(w) for w in STOP_WORDS))

    def of_words(w: Column) -> Column:
        plain = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(plain).cast("long").alias("word_chars"),
            _matches(text, "#*$%&|<>").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            _matches(text, r"\p{L}").alias("n_letters"),
            _matches(text, "!").alias("n_bangs"),
            F.size(F.array_intersect(F.transform(w, lambda x: F.lower(F.btrim(x, F.lit(edge)))), stops)).cast("long").alias("n_stop_words"),
        )

    return let(words, of_words)


def compile_rules(thresholds=THRESHOLDS) -> tuple[Column, Column]:
    """(failed rules as an array of names, kept) from a threshold table."""
    named = [F.when(F.expr(f"n_words >= {least} AND ({rule})"), F.lit(name)) for name, rule, least in thresholds]
    failed = F.filter(F.array(F.when(F.expr(BASE_FAILED), F.lit("base")), *named), lambda x: x.isNotNull())
    return failed, F.size(failed) == 0


def apply_rules(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
    """Measures, failed_rules and kept for every row of docs, beside keep_columns (default: doc_id).

    Null text counts as empty; empty text has no words and fails the base rule. Repeated rows give repeated results,
    an empty table gives none, and other columns of docs, whatever their names, are not read.
    """
    keep = keep_columns or ["doc_id"]
    inner = docs.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), measure(text_of(text)).alias("__m"))
    flat = inner.select(*(F.col(f"__k{i}") for i in range(len(keep))), *(F.col("__m")[m].alias(m) for m in MEASURES))
    failed, _ = compile_rules(thresholds)
    judged = flat.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0)
    judged = judged.withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), *MEASURES, "base_failed", "failed_rules", "kept")


def keep_passing(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text") -> DataFrame:
    """Rows of docs that no rule rejects; columns of docs may have any names.

    The verdict is one lambda over the measures: a filter over columns made from them would be pushed below them, and
    would measure the text once for each column that it names.
    """
    verdict = " AND ".join([f"NOT ({BASE_FAILED})", *(f"NOT (n_words >= {least} AND ({rule}))" for _, rule, least in thresholds)])
    bound = re.sub(rf"\b({'|'.join(MEASURES)})\b", r"m.\1", verdict)
    measured = packed(docs).withColumn("measures", F.array(measure(text_of(f"row.{text}"))))
    return measured.filter(F.expr(f"exists(measures, m -> {bound})")).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = apply_rules(spread(documents(spark, sf_dir)))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
