"""Queries over the driver's tables, one or more an operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import audio as A
from folioforge.functions import text as T
from folioforge.operators import audio, generate, ingest, segment, state
from folioforge.plans.config import Chunking, Export, Generation, Job, Repository, Silence
from folioforge.sources import chapters as sources
from folioforge.sources import wav

Query = Callable[[SparkSession, str], DataFrame]
DENSE, SHORT, LONG = 40, 120, 500
SAMPLE_RATE = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores where it has fewer files than cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def document_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select(F.col("source").alias("book_id"), (F.col("doc_id") + 1).cast("int").alias("chapter_number"), F.col("lang").alias("language"), F.lit("documents").alias("chapter_source"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages."""
    turns = _table(spark, sf_dir, "conversations")
    return turns.select(F.lit("talks").alias("book_id"), (F.col("conv_id") + 1).cast("int").alias("chapter_number"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def talk_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chapters of several paragraphs."""
    return ingest.combine_pages(pages(spark, sf_dir))


def dirty(text: Column) -> Column:
    """White space of many kinds, put in by rule."""
    for old, new in ((". ", ".\r\n\t\r\n \n\n"), (", ", ",\t\u00a0 "), (" de ", "\f de\u2003 "), (" the ", " \x1c\rthe ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def segments_of_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments, for the state operators."""
    turns = _table(spark, sf_dir, "conversations")
    chapter, index = (F.col("conv_id") + 1).cast("int"), (F.col("turn") + 1).cast("int")
    return turns.select(
        F.lit("talks").alias("book_id"),
        chapter.alias("chapter_number"),
        T.segment_id(chapter, index).alias("segment_id"),
        index.alias("index"),
        index.alias("paragraph_index"),
        "text",
        F.length("text").alias("char_count"),
        F.lit(True).alias("starts_paragraph"),
        (F.col("turn") % 2 == 0).alias("ends_paragraph"),
    )


def state_of_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = (F.col("chapter_number") + F.col("index")) % 3
    made = state.pending(segments_of_talks(spark, sf_dir))
    made = made.withColumn("status", F.when(which == 0, "completed").when(which == 1, "failed").otherwise("pending"))
    made = made.withColumn("audio_path", F.when((F.col("chapter_number") + F.col("index")) % 5 != 0, state.default_audio_path()))
    return made.withColumn("attempts", F.col("index") % 4).withColumn("error", F.when(F.col("status") == "failed", "earlier failure"))


def files_of_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = segments_of_talks(spark, sf_dir).filter((3 * F.col("chapter_number") + 7 * F.col("index")) % 4 < 2)
    return there.select(state.default_audio_path().alias("audio_path"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as mono audio."""
    table = _table(spark, sf_dir, "embeddings")
    return table.select(F.lit("voices").alias("book_id"), (F.col("label") + 1).cast("int").alias("chapter_number"), "vec_id", F.col("embedding").alias("samples"))


def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.normalize(dirty(F.col("text"))).alias("normalized"))


def paragraphs(spark, sf_dir):
    return _longs(segment.explode_paragraphs(talk_chapters(spark, sf_dir)))


def sentences(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode_outer(T.sentences(T.strip(F.col("text")))).alias("place", "sentence")).filter("place IS NOT NULL").select("doc_id", F.col("place").cast("long").alias("place"), "sentence")


def dense_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode_outer(T.split_dense(F.col("text"), DENSE)).alias("place", "part")).filter("place IS NOT NULL").select("doc_id", F.col("place").cast("long").alias("place"), "part")


def oversized_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode_outer(T.split_oversized(T.strip(F.col("text")), SHORT)).alias("place", "part")).filter("place IS NOT NULL").select("doc_id", F.col("place").cast("long").alias("place"), "part")


def chunk_documents(spark, sf_dir):
    return _longs(segment.segment_chapters(document_chapters(spark, sf_dir), Chunking(200, LONG)))


def chunk_conversations(spark, sf_dir):
    return _longs(segment.segment_chapters(talk_chapters(spark, sf_dir), Chunking(40, SHORT)))


def word_alnum_counts(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.word_count(text).cast("long").alias("word_count"), T.alnum_count(text).cast("long").alias("alnum_count"))


def extraction_route(spark, sf_dir):
    return ingest.route(documents(spark, sf_dir)).select("doc_id", "route")


def page_keep(spark, sf_dir):
    return _longs(ingest.judge_pages(pages(spark, sf_dir)))


def page_fallback(spark, sf_dir):
    return _longs(ingest.usable_pages(ingest.judge_pages(pages(spark, sf_dir))).select("book_id", "chapter_number", "page_number", "kept"))


def page_combine(spark, sf_dir):
    return _longs(ingest.combine_pages(ingest.usable_pages(ingest.judge_pages(pages(spark, sf_dir)))))


def page_counts(spark, sf_dir):
    return _longs(ingest.page_counts(ingest.judge_pages(pages(spark, sf_dir))))


def language_check(spark, sf_dir):
    odd = F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.concat(F.lit(" "), F.upper("lang"), F.lit("\t")))
    rows = documents(spark, sf_dir).select("doc_id", odd.alias("language"))
    checked = segment.check_languages(rows, strict=False)
    return checked.select("doc_id", T.language_code(F.col("language")).alias("language"), _joined(F.col("violations")).alias("violations"))


def language_labels(spark, sf_dir):
    labels = F.create_map(*(F.lit(x) for pair in sorted(T.LANGUAGES.items()) for x in pair))
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("chapters")).select("lang", labels[F.col("lang")].alias("label"), "chapters")


def identifier_sanitize(spark, sf_dir):
    urls = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("url").alias("value"))
    names = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.concat(F.lit(" --"), F.col("c_name"), F.lit("!? ")).alias("value"))
    return urls.unionByName(names).select("id", "kind", T.sanitize_identifier(F.col("value")).alias("identifier"))


def source_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", state.source_hash(F.col("text")).alias("source_text_hash"))


def output_paths(spark, sf_dir):
    book, number = F.col("book_id"), F.col("chapter_number")
    chapters = document_chapters(spark, sf_dir)
    return chapters.select(
        number.cast("long").alias("chapter_number"),
        T.output_path("manifest", book, number).alias("manifest_path"),
        T.output_path("segment", book, number, T.segment_id(number, F.lit(7))).alias("segment_path"),
        T.output_path("chapter", book, number).alias("chapter_path"),
        T.output_path("log", book, number, F.date_format(F.lit("2024-02-03 04:05:06").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")).alias("log_path"),
    )


def suffix_dispatch(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".TEXT", ".md", ".Pdf", ".docx"))), (F.col("page_id") % 5 + 1).cast("int"))
    paths = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("url"), suffix).alias("path"))
    return paths.select("page_id", T.source_kind(F.col("path")).alias("source_kind"), sources.input_kind(F.col("path"), F.lit("auto")).alias("input_kind"))


def manifest_build(spark, sf_dir):
    built = state.build_manifest(segment.segment_arrays(document_chapters(spark, sf_dir), Chunking(200, LONG)))
    return built.select("book_id", F.col("chapter_number").cast("long").alias("chapter_number"), "language", "source_text_hash", F.size("segments").cast("long").alias("n_segments"), F.array_join("segments.segment_id", ",").alias("ids"))


def manifest_json(spark, sf_dir):
    """Manifests as JSON and back; their settings are read again from the config inside."""
    job = Job("My Book!", 3, "chapter.txt", " FR ")
    built = state.build_manifest(segment.segment_arrays(document_chapters(spark, sf_dir)), job.to_manifest(), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    back = state.from_json(state.to_json(built), built.schema)
    return back.select("book_id", F.col("chapter_number").cast("long").alias("chapter_number"), F.size("segments").cast("long").alias("n_segments"), F.sha2(F.array_join("segments.text", "\n"), 256).alias("texts_sha256"), F.get_json_object("config", "$.chapter.book_id").alias("config_book"), F.array_join(F.array_distinct("segments.status"), ",").alias("statuses"))


def config_manifest(spark, sf_dir):
    """Settings block by block, for each chapter of the conversations."""
    job = Job("My Book!", 3, "chapter.txt", " FR ", repository=Repository("https://example.org/r.git"), root="/out")
    plain = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    flat = [(block, name, plain(v)) for block, inside in job.to_manifest().items() for name, v in (inside.items() if isinstance(inside, dict) else [("", inside)])]
    return spark.createDataFrame(flat, "block string, name string, value string")


def layout_check(spark, sf_dir):
    expected = segments_of_talks(spark, sf_dir)
    changed = expected.filter("(chapter_number + index) % 11 <> 0").withColumn("text", F.when(F.col("index") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return _longs(state.compare_layout(expected, changed))


def resume_state(spark, sf_dir):
    done = state.resume(state_of_talks(spark, sf_dir), files_of_talks(spark, sf_dir))
    return _longs(done.select("chapter_number", "segment_id", "status", "attempts", "error"))


def resume_forced(spark, sf_dir):
    done = state.resume(state_of_talks(spark, sf_dir), files_of_talks(spark, sf_dir), force=True)
    return _longs(done.select("chapter_number", "segment_id", "status", "attempts", "error"))


def prepare_state(spark, sf_dir):
    """Every other conversation is known, and as it was."""
    known = state_of_talks(spark, sf_dir).filter("chapter_number % 2 = 1")
    hashes = talk_chapters(spark, sf_dir).select(*state.KEY, state.source_hash(F.col("text")).alias("source_text_hash"))
    done = state.prepare(segments_of_talks(spark, sf_dir), known, files_of_talks(spark, sf_dir), hashes, hashes.filter("chapter_number % 2 = 1"))
    return _longs(done.select("chapter_number", "segment_id", "status", "attempts"))


def prepare_chapters(spark, sf_dir):
    """Two in three conversations are known, of which some had another text and some have lost a segment or got another."""
    chapter = F.col("chapter_number")
    known = state_of_talks(spark, sf_dir).filter(chapter % 3 != 0).filter((chapter % 7 != 0) | (F.col("index") != 2))
    known = known.withColumn("text", F.when((chapter % 11 == 0) & (F.col("index") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    hashes = talk_chapters(spark, sf_dir).select(*state.KEY, state.source_hash(F.col("text")).alias("source_text_hash"))
    earlier = hashes.filter(chapter % 3 != 0).withColumn("source_text_hash", F.when(chapter % 5 == 0, state.source_hash(F.lit("another text"))).otherwise(F.col("source_text_hash")))
    done = state.prepare(segments_of_talks(spark, sf_dir), known, files_of_talks(spark, sf_dir), hashes, earlier, strict=False)
    return _longs(done.select("chapter_number", "segment_id", "status", "attempts", "violation"))


def pending_work(spark, sf_dir):
    work = state.pending_work(state_of_talks(spark, sf_dir), files_of_talks(spark, sf_dir), state.default_audio_path())
    return _longs(work.select("chapter_number", "segment_id", "status"))


def render_selection(spark, sf_dir):
    chosen = state.select_for_render(state_of_talks(spark, sf_dir), files_of_talks(spark, sf_dir))
    return _longs(chosen.select("chapter_number", _joined(F.col("used_ids")).alias("used_ids"), _joined(F.col("failed_ids")).alias("failed_ids"), "fault"))


def status_summary(spark, sf_dir):
    return _longs(state.status_summary(state_of_talks(spark, sf_dir)))


def first_failed(spark, sf_dir):
    return _longs(state.first_failed(state_of_talks(spark, sf_dir), 2).select("chapter_number", "segment_id", "place"))


def resume_summary(spark, sf_dir):
    done = state.resume_summary(state_of_talks(spark, sf_dir), files_of_talks(spark, sf_dir))
    return _longs(done.withColumn("open_ids", _joined(F.col("open_ids"))))


def segment_lookup(spark, sf_dir):
    ids = state_of_talks(spark, sf_dir).select(*state.SEGMENT_KEY)
    return _longs(state.lookup(segments_of_talks(spark, sf_dir), ids).select("chapter_number", "segment_id", "text"))


class PulseEngine:
    """An engine for queries and tests: one triangular pulse of 2,400 samples for any text but questions, if it refuses those."""

    sample_rate = 24_000

    def __init__(self, refuses_questions: bool = False):
        self.refuses_questions = refuses_questions

    def generate(self, text: str, **settings) -> np.ndarray:
        if self.refuses_questions and "?" in text:
            raise RuntimeError("a question was refused")
        return (0.4 - np.abs(np.arange(2400) - 1200) / 3000).astype(np.float32)


def _refusing() -> PulseEngine:
    return PulseEngine(refuses_questions=True)


def retry_ledger(spark, sf_dir):
    work = state_of_talks(spark, sf_dir).withColumn("language", F.lit("en"))
    events = generate.render(work, _refusing, Generation(maximum_retries=3))
    return _longs(events.select("chapter_number", "segment_id", "attempt", "status", "error", F.size(F.coalesce("samples", F.array().cast("array<float>"))).alias("n_samples")))


def event_snapshot(spark, sf_dir):
    work = state_of_talks(spark, sf_dir).withColumn("language", F.lit("en"))
    events = generate.render(work, _refusing, Generation(maximum_retries=3)).drop("samples").withColumn("at", F.col("attempt"))
    return _longs(state.snapshot(events).select("chapter_number", "segment_id", "attempt", "status", "duration_seconds"))


def _framed(spark, sf_dir):
    return segments_of_talks(spark, sf_dir).withColumn("frames", (F.col("char_count") * 3).cast("long")).withColumn("sample_rate", F.lit(1000))


def silence_timeline(spark, sf_dir):
    return _longs(audio.timeline(_framed(spark, sf_dir), Silence(251, 500, 401, 800)).select("chapter_number", "segment_id", "frames", "pause_frames", "start_frame"))


def chapter_duration(spark, sf_dir):
    return _longs(audio.chapter_durations(_framed(spark, sf_dir), Silence(251, 500, 401, 800)))


def chapter_assembly(spark, sf_dir):
    """Every turn as audio of one frame a character; some chapters with a segment of another rate are refused."""
    wave = lambda i: (((i * 7 + F.col("chapter_number") * 13 + F.col("index") * 31) % 201 - 100) / F.lit(400.0)).cast("float")
    samples = F.when(F.col("char_count") > 0, F.transform(F.sequence(F.lit(1), F.col("char_count")), wave)).otherwise(F.array().cast("array<float>"))
    rate = F.when((F.col("chapter_number") % 7 == 0) & (F.col("index") == 2), 2000).otherwise(1000)
    rendered = segments_of_talks(spark, sf_dir).select(*state.KEY, "index", "ends_paragraph", rate.alias("sample_rate"), F.lit(1).alias("channels"), samples.alias("samples"))
    blocks = audio.assemble_chapters(rendered, Silence(251, 500, 401, 800), Export(peak=0.9), strict=False)
    return _longs(blocks.select("chapter_number", "index", "start_frame", F.size("samples").cast("long").alias("frames"), F.sha2(_joined(A.quantize(F.col("samples"))), 256).alias("pcm_sha256"), "fault"))


def audio_validate(spark, sf_dir):
    odd = F.when(F.col("vec_id") % 10 == 0, F.array().cast("array<float>")).when(F.col("vec_id") % 10 == 1, F.transform("samples", lambda x: (x * 1e-6).cast("float")))
    odd = odd.when(F.col("vec_id") % 10 == 2, F.transform("samples", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("samples"))
    return vectors(spark, sf_dir).select("vec_id", A.audio_fault(odd).alias("fault"))


def pcm_quantize(spark, sf_dir):
    louder = F.transform("samples", lambda x: (x * F.lit(3.0).cast("float")).cast("float"))
    return vectors(spark, sf_dir).select("vec_id", _joined(A.quantize(louder)).alias("pcm"))


def pcm_roundtrip(spark, sf_dir):
    once = A.quantize(F.col("samples"))
    return vectors(spark, sf_dir).select("vec_id", _joined(A.quantize(A.dequantize(once))).alias("pcm"))


def peak_normalize(spark, sf_dir):
    leveled = audio.level_chapters(vectors(spark, sf_dir), Export(peak=0.9))
    return leveled.select("vec_id", F.col("chapter_number").cast("long").alias("chapter_number"), _joined(F.transform("samples", lambda x: F.round(x.cast("double") * 1000).cast("long"))).alias("milli"))


def layout_uniformity(spark, sf_dir):
    rated = segments_of_talks(spark, sf_dir).withColumn("sample_rate", F.when((F.col("chapter_number") % 3 == 0) & (F.col("index") == 2), 8000).otherwise(24000))
    return _longs(audio.layout_faults(rated.withColumn("channels", F.when((F.col("chapter_number") % 5 == 0) & (F.col("index") == 1), 2).otherwise(1))).select("chapter_number", "fault"))


def voice_check(spark, sf_dir):
    longer = F.flatten(F.array_repeat(F.col("samples"), (F.col("vec_id") % 17).cast("int")))
    clips = vectors(spark, sf_dir).select("vec_id", longer.alias("samples"), F.lit(SAMPLE_RATE).alias("sample_rate"))
    return audio.voice_checks(clips).select("vec_id", "duration_seconds", "fault", _joined(F.col("warnings")).alias("warnings"))


def channel_mean(spark, sf_dir):
    mono = A.channel_mean(F.col("samples"), F.lit(2))
    return vectors(spark, sf_dir).select("vec_id", F.size(mono).cast("long").alias("frames"), _joined(F.transform(mono, lambda x: F.round(x.cast("double") * 1000).cast("long"))).alias("milli"))


def frame_shapes(spark, sf_dir):
    """Embeddings as stereo, and cut by a sample where they then are no whole frames."""
    odd = F.when(F.col("vec_id") % 5 == 0, F.slice("samples", 1, F.size("samples") - 1)).otherwise(F.col("samples"))
    shaped = vectors(spark, sf_dir).select("vec_id", odd.alias("samples"), A.shape_fault(odd, F.lit(2)).alias("fault"))
    cut = F.when(F.col("fault").isNull(), A.frames(F.col("samples"), F.lit(2)))
    return shaped.select("vec_id", "fault", F.size(cut).cast("long").alias("frames"), F.round(cut[1][0].cast("double") * 1000).cast("long").alias("second_frame_milli"))


def pdf_chapters(spark, sf_dir):
    """Conversations as PDF chapters: the text of those with too few letters comes from their turns, as recognised pages."""
    turns = pages(spark, sf_dir)
    recognise = lambda scanned: turns.join(scanned.select(*state.KEY), [*state.KEY])
    done, _ = ingest.extract_pdf(ingest.combine_pages(turns), recognise, least_words=12)
    return _longs(done.select("chapter_number", "used_ocr", "text"))


def ffmpeg_command(spark, sf_dir):
    book, number = F.col("book_id"), F.col("chapter_number")
    wavs = document_chapters(spark, sf_dir).select("book_id", "chapter_number", T.output_path("chapter", book, number).alias("source_wav"))
    made = [audio.ffmpeg_arguments(wavs.withColumn("output_path", F.regexp_replace("source_wav", r"wav\z", kind)), Export(), kind).withColumn("kind", F.lit(kind)) for kind in ("mp3", "m4b")]
    return made[0].unionByName(made[1]).select(number.cast("long").alias("chapter_number"), "kind", F.array_join("command", " ").alias("command"))


def wav_roundtrip(spark, sf_dir):
    """Samples through WAV bytes and back."""

    @F.pandas_udf("array<float>")
    def through(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: wav.decode(wav.encode(np.asarray(s, np.float32), 24_000, 1))[0])

    return vectors(spark, sf_dir).select("vec_id", _joined(A.quantize(through("samples"))).alias("pcm"))


def fake_synthesis(spark, sf_dir):
    work = state.pending(segments_of_talks(spark, sf_dir)).withColumn("language", F.lit("en"))
    events = generate.render(work, PulseEngine, Generation())
    return _longs(events.select("chapter_number", "segment_id", "status", F.size("samples").alias("n_samples"), "duration_seconds", A.audio_fault(F.col("samples")).alias("fault")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        normalize_text, paragraphs, sentences, dense_split, oversized_split, chunk_documents, chunk_conversations,
        word_alnum_counts, extraction_route, page_keep, page_fallback, page_combine, page_counts, language_check,
        language_labels, identifier_sanitize, source_hash, output_paths, suffix_dispatch, manifest_build, manifest_json,
        config_manifest, layout_check, resume_state, resume_forced, prepare_state, prepare_chapters, pending_work, render_selection,
        status_summary, first_failed, resume_summary, segment_lookup, retry_ledger, event_snapshot, silence_timeline,
        chapter_duration, chapter_assembly, audio_validate, pcm_quantize, pcm_roundtrip, peak_normalize, layout_uniformity, voice_check,
        channel_mean, frame_shapes, pdf_chapters, ffmpeg_command, wav_roundtrip, fake_synthesis,
    )
}
