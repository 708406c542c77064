"""Timelines, chapter-wide levels and checks over rendered segments."""

from __future__ import annotations

import os
import wave
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import audio as A
from folioforge.functions import text as T
from folioforge.plans.config import Export, Silence
from folioforge.sources import wav

KEY = ["book_id", "chapter_number"]


def timeline(segments: DataFrame, silence: Silence) -> DataFrame:
    """Segments (KEY, index, frames, sample_rate, ends_paragraph) with pause_frames after each and start_frame.

    A prefix stands before the first segment; after the last there is no pause, but the chapter's suffix.
    """
    order = Window.partitionBy(*KEY).orderBy("index")
    frames = lambda ms: A.silence_frames(F.col("sample_rate"), F.lit(ms))
    pause = F.when(F.lead("index").over(order).isNull(), F.lit(0).cast("long")).when(F.col("ends_paragraph"), frames(silence.between_paragraphs)).otherwise(frames(silence.between_segments))
    paused = segments.withColumn("pause_frames", pause)
    before = F.coalesce(F.sum(F.col("frames") + F.col("pause_frames")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return paused.withColumn("start_frame", (before + frames(silence.prefix)).cast("long"))


def chapter_durations(segments: DataFrame, silence: Silence) -> DataFrame:
    """(KEY, sample_rate, frames, duration_seconds) of whole chapters, with all pauses."""
    timed = timeline(segments, silence)
    each = timed.groupBy(*KEY).agg(F.first("sample_rate").alias("sample_rate"), F.sum(F.col("frames") + F.col("pause_frames")).alias("body"))
    frames = lambda ms: A.silence_frames(F.col("sample_rate"), F.lit(ms))
    whole = each.withColumn("frames", (F.col("body") + frames(silence.prefix) + frames(silence.suffix)).cast("long"))
    return whole.select(*KEY, "sample_rate", "frames", (F.col("frames") / F.col("sample_rate")).alias("duration_seconds"))


def layout_faults(segments: DataFrame) -> DataFrame:
    """(KEY, fault): sample_rate or channels where segments of a chapter differ in them, null where they agree."""
    each = segments.groupBy(*KEY).agg(*(f(c).alias(f"{n}_{c}") for c in ("sample_rate", "channels") for n, f in (("low", F.min), ("high", F.max))))
    fault = F.when(F.col("low_sample_rate") != F.col("high_sample_rate"), "sample_rate").when(F.col("low_channels") != F.col("high_channels"), "channels")
    return each.select(*KEY, fault.alias("fault"))


def level_chapters(audio: DataFrame, export: Export) -> DataFrame:
    """Samples of each segment scaled by one factor a chapter, so that the chapter's peak is the target.

    Only peaks, one number a segment, are brought together; samples stay where they are but for the join by chapter.
    """
    peaks = audio.groupBy(*KEY).agg(F.max(A.peak(F.col("samples"))).alias("__top"))
    leveled = audio.join(peaks, KEY).withColumn("samples", A.scaled(F.col("samples"), A.peak_factor(F.col("__top"), export.peak)))
    return leveled.drop("__top")


def assembly_faults(audio: DataFrame) -> DataFrame:
    """(KEY, fault): why a chapter cannot be assembled, null where it can: those of layout_faults, missing_audio, partial_frame or index."""
    count = lambda c: F.count_if(c) > 0
    partial = F.size("samples") % F.col("channels") != 0
    each = audio.groupBy(*KEY).agg(count(F.col("samples").isNull()).alias("none"), count(partial).alias("partial"), (F.count_distinct("index") < F.count("*")).alias("twice"))
    own = F.when(F.col("none"), "missing_audio").when(F.col("partial"), "partial_frame").when(F.col("twice"), "index")
    return layout_faults(audio).join(each, KEY).select(*KEY, F.coalesce("fault", own).alias("fault"))


def assemble_chapters(audio: DataFrame, silence: Silence, export: Export, strict: bool = True) -> DataFrame:
    """Chapters as ordered blocks (KEY, index, start_frame, sample_rate, channels, samples, fault), one a segment, that follow without gaps.

    audio holds KEY, index, ends_paragraph, sample_rate, channels and interleaved samples. A block is the segment with the
    pause after it; the first begins with the prefix, the last ends with the suffix. All are scaled by one factor, which
    brings the chapter's peak to the target. Chapters with a fault are refused, or without strict have null samples.
    No task holds a chapter's samples; only numbers, one row a segment, are ordered and brought together.
    """
    key = [*KEY, "index"]
    faults = assembly_faults(audio)
    light = audio.select(*key, "ends_paragraph", "sample_rate", (F.size("samples") / F.col("channels")).cast("long").alias("frames"), A.peak(F.col("samples")).alias("__peak"))
    light = light.join(faults.filter("fault IS NULL").select(KEY), KEY)
    order, whole = Window.partitionBy(*KEY).orderBy("index"), Window.partitionBy(*KEY)
    timed = timeline(light, silence).withColumn("__top", F.max("__peak").over(whole))
    timed = timed.withColumns({"__first": F.lag("index").over(order).isNull(), "__last": F.lead("index").over(order).isNull()})
    timed = timed.select(*key, "start_frame", "pause_frames", "__top", "__first", "__last")
    none = F.array().cast("array<float>")
    quiet = lambda frames: F.array_repeat(F.lit(0.0).cast("float"), (frames * F.col("channels")).cast("int"))
    before = F.when(F.col("__first"), A.silence(F.col("sample_rate"), F.lit(silence.prefix), F.col("channels"))).otherwise(none)
    after = F.when(F.col("__last"), A.silence(F.col("sample_rate"), F.lit(silence.suffix), F.col("channels"))).otherwise(quiet(F.col("pause_frames")))
    leveled = A.scaled(F.col("samples"), A.peak_factor(F.col("__top"), export.peak))
    start = F.when(F.col("__first"), F.lit(0).cast("long")).otherwise(F.col("start_frame"))
    block = F.when(F.col("fault").isNull(), F.concat(before, leveled, after))
    if strict:
        refusal = F.raise_error(F.concat(F.lit("chapter cannot be assembled: "), "book_id", F.lit(" "), F.col("chapter_number").cast("string"), F.lit(" "), "fault"))
        block = F.when(F.col("fault").isNotNull(), refusal.cast("array<float>")).otherwise(block)
    joined = audio.join(faults, KEY).join(timed, key, "left")
    return joined.select(*key, start.alias("start_frame"), "sample_rate", "channels", block.alias("samples"), "fault")


def write_chapters(blocks: DataFrame, root: str) -> None:
    """Blocks of assemble_chapters as one WAV file a chapter, at its output path below root, which all executors mount.

    Blocks are written as they come, and a finished file is renamed, so a task that runs again writes the same files.
    """

    def run(rows: Iterator[Row]) -> None:
        for relative, own in groupby(rows, lambda r: r["__path"]):
            path = os.path.join(root, relative)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f, wave.open(f, "wb") as out:
                for i, row in enumerate(own):
                    if i == 0:
                        out.setnchannels(row["channels"])
                        out.setsampwidth(2)
                        out.setframerate(row["sample_rate"])
                    out.writeframes(wav.quantize(np.array(row["samples"], np.float32)).tobytes())
            os.replace(part, path)

    usable = blocks.filter("samples IS NOT NULL").withColumn("__path", T.output_path("chapter", F.col("book_id"), F.col("chapter_number")))
    usable.repartition("__path").sortWithinPartitions("__path", "index").foreachPartition(run)


def voice_checks(clips: DataFrame) -> DataFrame:
    """Clips (samples mono, sample_rate) with duration_seconds, clipped_ratio, warnings and fault."""
    share = F.size(F.filter("samples", lambda x: F.abs(x) >= F.lit(0.999).cast("float"))) / F.greatest(F.size("samples"), F.lit(1))
    out = clips.withColumn("duration_seconds", F.size("samples") / F.col("sample_rate")).withColumn("clipped_ratio", share)
    duration, clipped = F.col("duration_seconds"), F.col("clipped_ratio")
    fault = F.when(duration < 3.0, "too_short").when(duration > 60.0, "too_long").when(~F.exists("samples", lambda x: F.abs(x) > F.lit(1e-4).cast("float")), "silent")
    warnings = F.array_compact(F.array(F.when((duration < 10.0) | (duration > 20.0), "duration_outside_10_to_20_seconds"), F.when(clipped > 0.01, "clipped")))
    return out.withColumn("fault", fault).withColumn("warnings", warnings)


def ffmpeg_arguments(chapters: DataFrame, export: Export, kind: str) -> DataFrame:
    """(KEY, command): arguments that turn source_wav into output_path, for mp3 or m4b."""
    if kind == "mp3":
        codec = ["-vn", "-c:a", "libmp3lame", "-b:a", export.mp3_bitrate]
    elif kind == "m4b":
        codec = ["-vn", "-c:a", "aac", "-b:a", export.m4b_bitrate, "-movflags", "+faststart", "-f", "mp4"]
    else:
        raise ValueError(f"unsupported export format {kind}")
    parts = [F.lit("ffmpeg"), F.lit("-y"), F.lit("-i"), F.col("source_wav"), *map(F.lit, codec), F.col("output_path")]
    return chapters.select(*KEY, F.array(*parts).alias("command"))
