import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from folioforge.operators import generate, segment, state
from folioforge.plans.config import Chunking, Export, Generation, Job, Silence, identifier, make_layout, resolve_path
from folioforge.queries import PulseEngine

SEGMENTS = "book_id string, chapter_number int, segment_id string, index int, paragraph_index int, text string, char_count int, starts_paragraph boolean, ends_paragraph boolean"


def make_state(spark, rows):
    """rows of (segment_id, status, audio_path, attempts, error)."""
    base = spark.createDataFrame([("b", 1, r[0], i + 1, 1, f"t{i}", 2, True, True) for i, r in enumerate(rows)], SEGMENTS)
    extra = spark.createDataFrame(rows, "segment_id string, status string, audio_path string, attempts int, error string")
    return state.pending(base).drop("status", "audio_path", "attempts", "error").join(extra, "segment_id")


@pytest.mark.parametrize(
    "status, there, wanted, error",
    [
        ("completed", True, "completed", "e"),
        ("completed", False, "pending", state.MISSING),
        ("failed", True, "completed", None),
        ("failed", False, "failed", "e"),
        ("pending", True, "pending", "e"),
    ],
)
def test_resume_rows(spark, status, there, wanted, error):
    files = spark.createDataFrame([("p",)] if there else [], "audio_path string")
    row = state.resume(make_state(spark, [("s", status, "p", 2, "e")]), files).first()
    assert (row.status, row.error, row.attempts) == (wanted, error, 2)


def test_resume_with_force_and_without_a_path(spark):
    files = spark.createDataFrame([("p",)], "audio_path string")
    row = state.resume(make_state(spark, [("s", "completed", "p", 2, "e")]), files, force=True).first()
    assert (row.status, row.error, row.attempts) == ("pending", None, 0)
    row = state.resume(make_state(spark, [("s", "completed", None, 2, None)]), files).first()
    assert row.status == "pending"


def test_layout_differences(spark):
    a = spark.createDataFrame([("b", 1, "s1", 1, "x"), ("b", 1, "s2", 2, "y"), ("b", 1, "s3", 3, "z")], "book_id string, chapter_number int, segment_id string, index int, text string")
    b = spark.createDataFrame([("b", 1, "s1", 1, "x!"), ("b", 1, "s3", 4, "z"), ("b", 1, "s4", 5, "n")], a.schema)
    found = {r.segment_id: r.difference for r in state.compare_layout(a, b).collect()}
    assert found == {"s1": "changed", "s2": "missing", "s3": "moved", "s4": "unexpected"}
    assert state.compare_layout(a, a).count() == 0


HASHES = "book_id string, chapter_number int, source_text_hash string"


@pytest.mark.parametrize(
    "stored, texts, violation",
    [("h", ["x", "y"], None), ("old", ["x", "y"], "text_changed"), (None, ["x", "y"], "text_changed"), ("h", ["x", "y!"], "layout_changed"), ("h", ["x"], "layout_changed"), ("h", ["x", "y", "z"], "layout_changed")],
)
def test_prepare_refuses_changed_chapters(spark, stored, texts, violation):
    rows = lambda chapter, parts: [("b", chapter, f"s{i}", i, 1, t, 1, True, True) for i, t in enumerate(parts, 1)]
    segments = spark.createDataFrame(rows(1, ["x", "y"]) + rows(2, ["n"]), SEGMENTS)
    known = state.pending(spark.createDataFrame(rows(1, texts), SEGMENTS)).withColumns({"status": F.lit("completed"), "audio_path": F.lit("p")})
    files, hashes = spark.createDataFrame([("p",)], "audio_path string"), spark.createDataFrame([("b", 1, "h"), ("b", 2, "h2")], HASHES)
    args = (segments, known, files, hashes, spark.createDataFrame([("b", 1, stored)] if stored else [], HASHES))
    got = sorted((r.chapter_number, r.segment_id, r.text, r.status, r.violation) for r in state.prepare(*args, strict=False).collect())
    assert got == [(1, f"s{i}", t, "completed", violation) for i, t in enumerate(texts, 1)] + [(2, "s1", "n", "pending", None)]
    if violation:
        with pytest.raises(Exception, match=f"chapter cannot be resumed: b 1 {violation}"):
            state.prepare(*args).select("segment_id").collect()


def test_selection_faults(spark):
    files = spark.createDataFrame([("p1",)], "audio_path string")
    rows = make_state(spark, [("s1", "completed", "p1", 1, None), ("s2", "pending", None, 0, None)])
    row = state.select_for_render(rows, files).first()
    assert (row.used_ids, row.failed_ids, row.fault) == (["s1"], ["s2"], None)
    assert state.select_for_render(rows, files, allow_partial=False).first().fault == "incomplete"


def test_manifest_round_trip_keeps_nulls(spark, tmp_path):
    chapters = spark.createDataFrame([("b", 1, "en", "f", "A b."), ("b", 2, "en", "f", "")], "book_id string, chapter_number int, language string, chapter_source string, text string")
    built = state.build_manifest(segment.segment_arrays(chapters), {"chapter": {"book_id": "b"}}, F.lit("2024-01-01").cast("timestamp"))
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    text = state.to_json(built).filter("chapter_number = 1").first().manifest
    assert '"audio_path":null' in text
    state.save_manifests(built, str(tmp_path / "m"), F.lit("2024-02-02").cast("timestamp"))
    loaded = state.load_manifests(spark, str(tmp_path / "m"), built.schema)
    assert {(r.created_at.month, r.updated_at.month) for r in loaded.collect()} == {(1, 2)}
    assert sorted(map(str, loaded.drop("updated_at").collect())) == sorted(map(str, built.drop("updated_at").collect()))
    (tmp_path / "one.json").write_text(json.dumps(json.loads(text), indent=2))
    assert str(state.load_manifests(spark, str(tmp_path / "one.json"), built.schema, documents=True).first()) == str(built.filter("chapter_number = 1").first())
    back = state.from_json(state.to_json(built), built.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, built.collect()))


def test_attempts_are_capped_over_a_segments_life(spark):
    rows = make_state(spark, [("s1", "pending", None, 0, None), ("s2", "failed", None, 1, None), ("s3", "failed", None, 3, None)])
    work = rows.withColumn("language", F.lit("en")).withColumn("text", F.concat("text", F.lit("?")))
    events = generate.render(work, partial(PulseEngine, True), Generation(maximum_retries=3)).collect()
    assert sorted((e.segment_id, e.attempt, e.status) for e in events) == [("s1", 1, "failed"), ("s1", 2, "failed"), ("s1", 3, "failed"), ("s2", 2, "failed"), ("s2", 3, "failed")]


@pytest.mark.parametrize(
    "make",
    [
        lambda: Chunking(0, 5),
        lambda: Chunking(6, 5),
        lambda: Generation(temperature=9),
        lambda: Generation(maximum_retries=0),
        lambda: Silence(prefix=-1),
        lambda: Export(peak=1.5),
        lambda: Job("b", 0, "f", "en"),
        lambda: Job("b", 1, " ", "en"),
        lambda: Job("b", 1, "f", "xx"),
        lambda: identifier("?!"),
        lambda: generate.resolve_device(False, False),
    ],
)
def test_bad_settings_are_refused(make):
    with pytest.raises((ValueError, RuntimeError)):
        make()


def test_identifiers_and_paths(tmp_path):
    assert [identifier(x) for x in (" --My Book!? ", "a__b", "É tude 2", "x - y")] == ["my-book", "a__b", "tude-2", "x---y"]
    made = make_layout(str(tmp_path / "out"))
    assert len(made) == 7 and all((tmp_path / "out" / d).is_dir() for d in ("books", "voices", "segments", "chapters", "manifests", "logs"))
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.txt").write_text("")
    roots = str(tmp_path / "repo"), str(tmp_path / "out")
    assert resolve_path("a.txt", *roots) == str(tmp_path / "repo" / "a.txt")
    assert resolve_path("b.txt", *roots) == str(tmp_path / "out" / "b.txt")
    assert resolve_path("/x/a.txt", *roots) == "/x/a.txt"
