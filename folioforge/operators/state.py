"""Manifests and the resumable state of segments: an append-only log of events, and snapshots made from it by joins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import text as T

KEY = ["book_id", "chapter_number"]
SEGMENT_KEY = [*KEY, "segment_id"]
MISSING = "Completed audio file was missing during resume."
RECORD = ["segment_id", "index", "paragraph_index", "text", "char_count", "starts_paragraph", "ends_paragraph", "status", "audio_path", "attempts", "sample_rate", "channels", "duration_seconds", "error", "updated_at"]


def source_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def pending(segments: DataFrame) -> DataFrame:
    """Segments as records that nothing was rendered for."""
    null = lambda kind: F.lit(None).cast(kind)
    fields = {"status": F.lit("pending"), "audio_path": null("string"), "attempts": F.lit(0), "sample_rate": null("int"), "channels": null("int"), "duration_seconds": null("double"), "error": null("string"), "updated_at": null("timestamp")}
    return segments.withColumns(fields)


def _record(segment: Column, now: Column) -> Column:
    """A segment of segment_arrays as a record that nothing was rendered for."""
    null = lambda kind: F.lit(None).cast(kind)
    new = {"status": F.lit("pending"), "audio_path": null("string"), "attempts": F.lit(0), "sample_rate": null("int"), "channels": null("int"), "duration_seconds": null("double"), "error": null("string"), "updated_at": now}
    return F.struct(*(new.get(c, segment[c]).alias(c) for c in RECORD))


def build_manifest(chapters: DataFrame, config: dict | None = None, clock: Column | None = None) -> DataFrame:
    """One row a chapter of segment_arrays: the hash of its whole source text, the job's settings, its records in order.

    All times are the same. Chapters without segments stay, with none. Nothing is shuffled.
    """
    now = F.current_timestamp() if clock is None else clock
    settings = F.lit(None if config is None else json.dumps(config, ensure_ascii=False)).cast("string").alias("config")
    records = F.transform("segments", lambda s: _record(s, now)).alias("segments")
    head = [*KEY, "language", "chapter_source", source_hash(F.col("text")).alias("source_text_hash")]
    return chapters.select(*head, now.alias("created_at"), now.alias("updated_at"), settings, records)


def to_json(manifests: DataFrame) -> DataFrame:
    return manifests.select(*KEY, F.to_json(F.struct(*manifests.columns), {"ignoreNullFields": "false"}).alias("manifest"))


def from_json(rows: DataFrame, schema) -> DataFrame:
    return rows.select(F.from_json("manifest", schema).alias("m")).select("m.*")


def save_manifests(manifests: DataFrame, path: str, clock: Column | None = None) -> None:
    """Write one JSON document a line below path, with updated_at set to now, in place of what was there."""
    now = F.current_timestamp() if clock is None else clock
    to_json(manifests.withColumn("updated_at", now)).select("manifest").write.mode("overwrite").text(path)


def load_manifests(spark: SparkSession, path: str, schema, documents: bool = False) -> DataFrame:
    """Manifests of save_manifests, or with documents of files that hold one JSON document each, over several lines."""
    text = spark.read.text(path, wholetext=documents).withColumnRenamed("value", "manifest")
    return from_json(text, schema)


def compare_layout(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Segments that differ: (SEGMENT_KEY, difference), one of missing, unexpected, moved and changed. Empty if all agree."""
    a = expected.select(*SEGMENT_KEY, F.col("index").alias("i1"), F.col("text").alias("t1"))
    b = actual.select(*SEGMENT_KEY, F.col("index").alias("i2"), F.col("text").alias("t2"))
    joined = a.join(b, SEGMENT_KEY, "full_outer")
    difference = F.when(F.col("i2").isNull(), "missing").when(F.col("i1").isNull(), "unexpected").when(F.col("i1") != F.col("i2"), "moved").when(~F.col("t1").eqNullSafe(F.col("t2")), "changed")
    return joined.select(*SEGMENT_KEY, difference.alias("difference")).filter("difference IS NOT NULL")


def with_presence(state: DataFrame, files: DataFrame) -> DataFrame:
    """state with exists: whether audio_path is among the listed files (audio_path)."""
    listed = files.select("audio_path").distinct().withColumn("__there", F.lit(True))
    return state.join(listed, "audio_path", "left").withColumn("exists", F.coalesce("__there", F.lit(False)) & (F.col("audio_path") != "")).drop("__there").withColumn("exists", F.coalesce("exists", F.lit(False)))


def resume(state: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """The state after holding it against the files that are there. Times of change stay."""
    columns = state.columns
    if force:
        return state.withColumns({"status": F.lit("pending"), "error": F.lit(None).cast("string"), "attempts": F.lit(0)}).select(columns)
    lost = (F.col("was") == "completed") & ~F.col("exists")
    healed = (F.col("was") == "failed") & F.col("exists")
    seen = with_presence(state, files).withColumn("was", F.col("status"))
    seen = seen.withColumn("status", F.when(lost, "pending").when(healed, "completed").otherwise(F.col("was")))
    seen = seen.withColumn("error", F.when(lost, MISSING).when(healed, F.lit(None)).otherwise(F.col("error")))
    return seen.select(columns)


def chapter_violations(segments: DataFrame, existing: DataFrame, hashes: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """(KEY, violation) of chapters with a known state that must not be resumed: text_changed or layout_changed.

    hashes and known_hashes hold KEY and source_text_hash. A chapter is known if it has a known hash or known segments; a
    known chapter without a hash on either side counts as changed. Chapters known but not among the new ones are left out.
    """
    now = hashes.select(*KEY, F.col("source_text_hash").alias("h1"))
    then = known_hashes.select(*KEY, F.col("source_text_hash").alias("h2"))
    stored = existing.select(KEY).unionByName(known_hashes.select(KEY)).distinct()
    wanted = segments.select(KEY).unionByName(hashes.select(KEY)).distinct()
    both = stored.join(wanted, KEY).join(now, KEY, "left").join(then, KEY, "left")
    moved = compare_layout(segments, existing).select(KEY).distinct().withColumn("moved", F.lit(True))
    same = F.coalesce(F.col("h1") == F.col("h2"), F.lit(False))
    violation = F.when(~same, "text_changed").when(F.col("moved"), "layout_changed")
    return both.join(moved, KEY, "left").select(*KEY, violation.alias("violation")).filter("violation IS NOT NULL")


def prepare(segments: DataFrame, existing: DataFrame, files: DataFrame, hashes: DataFrame, known_hashes: DataFrame, force: bool = False, strict: bool = True) -> DataFrame:
    """States of chapters: those without a known state as pending, known ones resumed as stored, with violation.

    A known chapter whose source_text_hash or (id, text) pairs differ is refused, or without strict keeps its stored rows
    as they are, under its violation. No new segments are added to a known chapter.
    """
    faults = chapter_violations(segments, existing, hashes, known_hashes)
    known = existing.select(KEY).unionByName(known_hashes.select(KEY)).distinct()
    fresh = pending(segments).join(known, KEY, "left_anti").select(existing.columns)
    kept = existing.join(faults, KEY, "left_anti").select(existing.columns)
    resumed = resume(kept, files, force).unionByName(fresh).withColumn("violation", F.lit(None).cast("string"))
    # A known chapter can have no stored rows: its violation then stands in a row of its own, with nulls.
    refused = faults.join(existing, KEY, "left").select(*existing.columns, "violation")
    out = resumed.unionByName(refused)
    if strict:
        message = F.concat(F.lit("chapter cannot be resumed: "), "book_id", F.lit(" "), F.col("chapter_number").cast("string"), F.lit(" "), "violation")
        # A filter, as a column would not be computed where it is not selected.
        out = out.filter(F.when(F.col("violation").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
    return out


def pending_work(state: DataFrame, files: DataFrame, default_path: Column, force: bool = False) -> DataFrame:
    """Segments to render: all but completed ones whose file, or else that of the default path, is there."""
    if force:
        return state
    done = state.filter("status = 'completed'").withColumn("path", F.coalesce("audio_path", default_path))
    there = done.join(files.select(F.col("audio_path").alias("path")).distinct(), "path", "left_semi")
    return state.join(there.select(SEGMENT_KEY), SEGMENT_KEY, "left_anti")


def select_for_render(state: DataFrame, files: DataFrame, allow_partial: bool = True) -> DataFrame:
    """(KEY, used_ids, failed_ids, fault): completed segments with a file, in order, and all others.

    fault is incomplete if some are missing and no partial chapter is allowed, empty if none is usable, else null.
    """
    seen = with_presence(state, files).withColumn("usable", (F.col("status") == "completed") & F.col("exists"))
    by_index = F.struct("index", "segment_id")
    ids = lambda usable: F.array_sort(F.collect_list(F.when(F.col("usable") == usable, by_index)))
    each = seen.groupBy(*KEY).agg(ids(True).alias("u"), ids(False).alias("f"))
    fault = F.when((F.size("f") > 0) & F.lit(not allow_partial), "incomplete").when(F.size("u") == 0, "empty")
    return each.select(*KEY, F.col("u.segment_id").alias("used_ids"), F.col("f.segment_id").alias("failed_ids"), fault.alias("fault"))


def status_summary(state: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return state.groupBy(*KEY).agg(count("completed").alias("completed"), count("failed").alias("failed"), F.count_if(~F.coalesce(F.col("status").isin("completed", "failed"), F.lit(False))).alias("other"))


def first_failed(state: DataFrame, most: int = 10) -> DataFrame:
    """The first failed segments of each chapter: a report."""
    failed = state.filter("status = 'failed'").withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("index")))
    return failed.filter(F.col("place") <= most).select(*SEGMENT_KEY, "error", "place")


def resume_summary(state: DataFrame, files: DataFrame) -> DataFrame:
    """(KEY, ready, not_completed, open_ids): completed segments with a file, and the others' number and ids in order."""
    seen = with_presence(state, files)
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    open_ids = F.array_sort(F.collect_list(F.when(~done, F.struct("index", "segment_id"))))["segment_id"]
    return seen.groupBy(*KEY).agg(F.count_if(done & F.col("exists")).alias("ready"), F.count_if(~done).alias("not_completed"), open_ids.alias("open_ids"))


def snapshot(events: DataFrame) -> DataFrame:
    """The latest event of each segment (SEGMENT_KEY, attempt, at, ...), by a max that combines before the shuffle."""
    rest = [c for c in events.columns if c not in SEGMENT_KEY]
    latest = events.groupBy(*SEGMENT_KEY).agg(F.max(F.struct("at", "attempt", *(c for c in rest if c not in ("at", "attempt")))).alias("e"))
    return latest.select(*SEGMENT_KEY, *(F.col(f"e.{c}").alias(c) for c in rest))


def lookup(segments: DataFrame, ids: DataFrame) -> DataFrame:
    return segments.join(ids, SEGMENT_KEY)


def default_audio_path() -> Column:
    return T.output_path("segment", F.col("book_id"), F.col("chapter_number"), F.col("segment_id"))
