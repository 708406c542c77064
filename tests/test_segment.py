import re

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.segment import check_languages, segment_chapters
from folioforge.plans.config import Chunking

SCHEMA = "book_id string, chapter_number int, text string"


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def segments(spark, text, least, most):
    df = spark.createDataFrame([("b", 7, text)], SCHEMA)
    return segment_chapters(df, Chunking(least, most)).orderBy("index").collect()


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("a\r\nb\rc", "a\nb\nc"),
        (" a \t b \n\n\n\n c ", "a b\n\nc"),
        (" a　\n\f\n\x1c", "a"),
        ("", ""),
        (" \n ", ""),
    ],
)
def test_normalize(spark, given, wanted):
    assert one(spark, T.normalize, given) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Dr. Rao waited. She left!", ["Dr. Rao waited.", "She left!"]),
        ("It cost 3.14 in the U.S. today.", ["It cost 3.14 in the U.S. today."]),
        ("foo.bar", ["foo.", "bar"]),
        ('He said "Go." Then…', ['He said "Go."', "Then…"]),
        ("a <DOT> b", ["a . b"]),
        ("...", ["..."]),
        ("i.e.g. x", ["i.", "e.g. x"]),
    ],
)
def test_sentences(spark, given, wanted):
    assert one(spark, T.sentences, given) == wanted


@pytest.mark.parametrize(
    "given, most, wanted",
    [
        ("abcdefghij", 4, ["abcd", "efgh", "ij"]),
        ("aa bbbbbbbb cc", 5, ["aa", "bbbbbbbb", "cc"]),
        ("aa bb cc", 5, ["aa bb", "cc"]),
    ],
)
def test_dense(spark, given, most, wanted):
    assert one(spark, lambda v: T.split_dense(v, most), given) == wanted


def test_oversized_breaks_at_commas(spark):
    assert one(spark, lambda v: T.split_oversized(v, 12), "one two, three four; five") == ["one two,", "three four;", "five"]


def test_segments_stay_in_paragraphs_and_are_maximal(spark):
    text = "First one here. Second is a bit longer than that.\n\nA new paragraph. With two."
    rows = segments(spark, text, 5, 30)
    assert [r["index"] for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].segment_id == "chapter_007_segment_0001"
    for paragraph in {r.paragraph_index for r in rows}:
        own = [r for r in rows if r.paragraph_index == paragraph]
        assert [r.starts_paragraph for r in own] == [True] + [False] * (len(own) - 1)
        assert [r.ends_paragraph for r in own] == [False] * (len(own) - 1) + [True]
        assert all(a.char_count + 1 + b.char_count > 30 for a, b in zip(own, own[1:]))
    assert re.sub(r"\s", "", text) == re.sub(r"\s", "", "".join(r.text for r in rows))


def test_lower_bound_changes_nothing(spark):
    text = "Aa bb. Cc dd ee. Ff. " * 5
    assert [r.text for r in segments(spark, text, 1, 25)] == [r.text for r in segments(spark, text, 25, 25)]


def test_no_segments_without_text(spark):
    df = spark.createDataFrame([("b", 1, ""), ("b", 2, None), ("b", 3, " \n ")], SCHEMA)
    assert segment_chapters(df).count() == 0


def test_long_numbers_are_not_cut(spark):
    row = spark.range(1).select(T.segment_id(F.lit(1234), F.lit(56789)).alias("id")).first()
    assert row.id == "chapter_1234_segment_56789"


def test_language_modes(spark):
    df = spark.createDataFrame([(" EN ",), ("xx",)], "language string")
    assert [r.violations for r in check_languages(df, strict=False).collect()] == [[], ["unsupported_language"]]
    with pytest.raises(Exception, match="Unsupported target language"):
        check_languages(df).collect()


def test_plan_has_no_shuffle_and_prunes_columns(spark, tmp_path):
    spark.createDataFrame([("b", 1, "A b. C d.", "unused")], SCHEMA + ", other string").write.parquet(str(tmp_path / "c"))
    df = segment_chapters(spark.read.parquet(str(tmp_path / "c")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "other" not in plan
