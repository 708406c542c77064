import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import audio as A
from folioforge.operators import audio, ingest
from folioforge.plans.config import Export, Silence
from folioforge.sources import chapters, wav
from folioforge.streaming.ingest import CHAPTER_SCHEMA, segment_stream


def test_timeline_counts_every_pause_but_the_last(spark):
    rows = [("b", 1, 1, 100, 1000, True), ("b", 1, 2, 200, 1000, True)]
    df = spark.createDataFrame(rows, "book_id string, chapter_number int, index int, frames long, sample_rate int, ends_paragraph boolean")
    silence = Silence(100, 300, 200, 400)
    assert [r.start_frame for r in audio.timeline(df, silence).orderBy("index").collect()] == [200, 600]
    assert audio.chapter_durations(df, silence).first().frames == 1200


def test_silence_frames_follow_double_arithmetic(spark):
    row = spark.range(1).select(A.silence_frames(F.lit(1000), F.lit(1001)).alias("n")).first()
    assert row.n == int(1000 * (1001 / 1000.0))


def test_quantize_matches_numpy(spark):
    values = [0.0, 1.0, -1.0, 2.0, -3.0, 0.1, -0.123456, 0.99999]
    row = spark.createDataFrame([(values,)], "s array<float>").select(A.quantize(F.col("s")).alias("q")).first()
    assert row.q == wav.quantize(np.array(values, np.float32)).tolist()


@pytest.mark.parametrize("samples, fault", [([], "empty"), ([float("nan")], "not_finite"), ([float("-inf")], "not_finite"), ([1e-6], "silent"), ([0.5], None)])
def test_faults(spark, samples, fault):
    df = spark.createDataFrame([(samples,)], "s array<float>")
    assert df.select(A.audio_fault(F.col("s")).alias("f")).first().f == fault


def test_channel_mean(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.5, 0.5],), ([],)], "s array<float>")
    assert [r.m for r in df.select(A.channel_mean(F.col("s"), F.lit(2)).alias("m")).collect()] == [[0.5, 0.5], []]


def test_wav_source_round_trip(spark, tmp_path):
    spark.dataSource.register(wav.WavSource)
    df = spark.createDataFrame([("a/x.wav", 8000, 2, [0.5, -0.5, 1.0, 0.0]), ("y.wav", 16000, 1, [0.25])], wav.SCHEMA)
    df.write.format("wav").mode("append").save(str(tmp_path))
    for rows in (spark.read.format("wav").load(str(tmp_path)).collect(), wav.read_wav_files(spark, str(tmp_path)).collect()):
        got = {r.path.rsplit("/", 1)[1]: (r.sample_rate, r.channels, np.round(r.samples, 3).tolist()) for r in rows}
        assert got == {"x.wav": (8000, 2, [0.5, -0.5, 1.0, 0.0]), "y.wav": (16000, 1, [0.25])}


AUDIO = "book_id string, chapter_number int, index int, ends_paragraph boolean, sample_rate int, channels int, samples array<float>"


def test_chapters_are_assembled_and_written(spark, tmp_path):
    rows = [("b", 1, 2, True, 1000, 2, [0.5, -0.25]), ("b", 1, 1, False, 1000, 2, [0.1, 0.2, 0.3, 0.4]), ("b", 2, 1, True, 500, 1, [0.0]), ("b", 1, 3, True, 1000, 2, [0.2, 0.1])]
    blocks = audio.assemble_chapters(spark.createDataFrame(rows, AUDIO), Silence(2, 3, 1, 4), Export(peak=0.9))
    own = sorted((r for r in blocks.collect() if r.chapter_number == 1), key=lambda r: r["index"])
    assert [r.start_frame for r in own] == [0, 5, 9]
    wanted = np.array([0, 0, 0.1, 0.2, 0.3, 0.4] + [0] * 4 + [0.5, -0.25] + [0] * 6 + [0.2, 0.1] + [0] * 8) * (0.9 / 0.5)
    assert np.allclose(np.concatenate([r.samples for r in own]), wanted)
    audio.write_chapters(blocks, str(tmp_path))
    samples, rate, channels = wav.decode((tmp_path / "chapters/b/b_chapter_001.wav").read_bytes())
    assert (rate, channels) == (1000, 2) and np.allclose(samples, wanted, atol=1e-4)
    assert wav.decode((tmp_path / "chapters/b/b_chapter_002.wav").read_bytes())[0].tolist() == [0.0] * 3


@pytest.mark.parametrize(
    "other, fault",
    [((2, 1000, 1, [0.1]), None), ((2, 500, 1, [0.1]), "sample_rate"), ((2, 1000, 2, [0.1, 0.1]), "channels"), ((2, 1000, 1, None), "missing_audio"), ((1, 1000, 1, [0.1]), "index")],
)
def test_assembly_refuses(spark, other, fault):
    index, rate, channels, samples = other
    df = spark.createDataFrame([("b", 1, 1, True, 1000, 1, [0.5]), ("b", 1, index, True, rate, channels, samples)], AUDIO)
    assert {(r.fault, r.samples is None) for r in audio.assemble_chapters(df, Silence(), Export(), strict=False).collect()} == {(fault, fault is not None)}
    if fault:
        with pytest.raises(Exception, match=f"chapter cannot be assembled: b 1 {fault}"):
            audio.assemble_chapters(df, Silence(), Export()).collect()


def test_text_chapters(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("one\r\ntwo\rthree é".encode())
    (tmp_path / "b.docx").write_bytes(b"no")
    (tmp_path / "c.md").write_bytes(b"bad \xff")
    rows = {r.path.rsplit("/", 1)[1]: r.text for r in chapters.read_text_chapters(spark, str(tmp_path), strict=False).collect()}
    assert rows == {"a.TXT": "one\ntwo\nthree é", "c.md": None}
    with pytest.raises(Exception):
        chapters.read_text_chapters(spark, str(tmp_path / "c.md")).collect()
    with pytest.raises(Exception, match="Unsupported chapter format"):
        chapters.route_paths(spark.createDataFrame([("x.docx",)], "path string")).collect()


def test_page_rules_and_fallback(spark):
    pages = spark.createDataFrame([("b", 1, 1, "w " * 40), ("b", 1, 2, "few"), ("b", 2, 1, "low one"), ("b", 2, 2, ""), ("b", 2, 3, "low two")], "book_id string, chapter_number int, page_number int, text string")
    usable = ingest.usable_pages(ingest.judge_pages(pages))
    texts = {r.chapter_number: r.text for r in ingest.combine_pages(usable).collect()}
    assert texts == {1: ("w " * 40).strip(), 2: "low one\n\nlow two"}


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    for number in (1, 2):
        spark.createDataFrame([("b", number, "en", "A b. C d.")], CHAPTER_SCHEMA).write.mode("append").parquet(source)
        segment_stream(spark, source, target, point).awaitTermination()
    assert sorted(r.chapter_number for r in spark.read.parquet(target).collect()) == [1, 2]


def test_voices_are_mono_and_keep_their_channels(spark, tmp_path):
    (tmp_path / "v.wav").write_bytes(wav.encode(np.array([0.5, -0.5, 0.2, 0.4], np.float32), 8000, 2))
    row = wav.read_wav_files(spark, str(tmp_path), wav.decode_voice).first()
    assert (row.sample_rate, row.channels) == (8000, 2) and np.allclose(row.samples, [0.0, 0.3], atol=1e-4)


def test_samples_that_are_no_frames_are_refused(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3], 2), ([0.1, 0.2], 2), ([], 1), ([0.1], 0)], "samples array<float>, channels int")
    assert [r[0] for r in df.select(A.shape_fault(F.col("samples"), F.col("channels"))).collect()] == ["length", None, None, "channels"]
    assert [len(r[0]) for r in df.filter("channels = 1 OR size(samples) = 2").select(A.frames(F.col("samples"), F.col("channels"))).collect()] == [1, 0]
    with pytest.raises(Exception, match="samples are no frames: length"):
        df.limit(1).select(A.frames(F.col("samples"), F.col("channels"))).collect()


def test_pdf_text_or_recognised_pages(spark):
    direct = spark.createDataFrame([("b", 1, "x" * 800), ("b", 2, "short"), ("b", 3, None)], "book_id string, chapter_number int, text string")
    scans = spark.createDataFrame([("b", 2, 1, "few"), ("b", 2, 2, "w " * 30)], "book_id string, chapter_number int, page_number int, text string")
    asked = []
    recognise = lambda rows: asked.append(sorted(r.chapter_number for r in rows.collect())) or scans
    done, judged = ingest.extract_pdf(direct, recognise)
    assert {r.chapter_number: (r.text, r.used_ocr) for r in done.collect()} == {1: ("x" * 800, False), 2: (("w " * 30).strip(), True), 3: ("", True)}
    assert asked == [[2, 3]] and sorted(r.kept for r in judged.collect()) == [False, True]
    assert all(r.used_ocr for r in ingest.extract_pdf(direct, recognise, forced=True)[0].collect())
