"""The pipeline's stages against brute force on a small folder."""

import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from folioforge.llm import common, gam, kernel
from folioforge.llm.common import stage_table
from test_operators import PARAGRAPH, components_by_force, labelled, secrets_of

CLASHES = ["score", "heads", "secrets", "measures", "masked", "row", "class", "stays", "__measures", "__bit", "__piece", "__row", "__maybe", "__text", "c0", "sequence_id", "n", "m"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, labels = labelled(spark)
    more = [(1, PARAGRAPH + ' password: "hunter2hunter2" and so on to the end of it'), (2, None), (3, "too short"), (4, PARAGRAPH + ' password: "hunter2hunter2" and so on to the end of it')]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({c: F.lit(1) for c in CLASHES})
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, truth = docs.columns, {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage_table(stage(spark, docs, folder), name)
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        if name == "packing":
            assert set(after) == set(before)
            continue
        assert docs.columns == columns
        if name in ("quality_rules", "quality_classifier"):
            assert all(before[k] == after[k] for k in after)
            assert not {k for k in set(before) - set(after) if k in truth and truth[k].quality == 1}
        if name == "near_duplicates":
            assert set(after) == {c for _, _, c in components_by_force([(k, r.text) for k, r in before.items()])}
        if name == "secret_scan":
            assert set(after) == set(before)
            for k, r in after.items():
                assert ("[SECRET]" in r.text) == any(secrets_of(before[k].text)) and r.n_chars == len(r.text)
    assert 2 not in before and 4 not in before


def test_classifier_carries_odd_names_and_types(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    odd = {"my col": F.lit(1), "a-b": F.lit("x"), "x:y": F.lit(2.5), "d.e": F.lit(1), "<z>": F.lit(3), "st": F.struct(F.lit(1).alias("in ner")), "ar": F.array(F.lit(1))}
    docs = docs.select("*", *(c.alias(n) for n, c in odd.items()))
    before = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert kept.columns == docs.columns and all(before[r.doc_id] == r for r in kept.collect())


def test_few_large_files_are_dealt_by_size(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(1)
    one = stage_table(docs, "one")
    cores = spark.sparkContext.defaultParallelism
    assert len(one.inputFiles()) == 1 and common.spread(one).rdd.getNumPartitions() == cores
    monkeypatch.setattr(common, "SPREAD_BYTES", 1 << 10, raising=False)
    dealt = common.spread(one)
    assert dealt.rdd.getNumPartitions() > cores and dealt.count() == docs.count()
    assert common.spread(spark.createDataFrame([(1, "a")], "doc_id long, text string")).rdd.getNumPartitions() == cores


def test_staged_tables_are_written_in_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "GROUP_BYTES", 1 << 20, raising=False)
    # 8 MB of hashes that do not compress, in one task.
    rows = spark.range(0, 1_000_000, 1, 1).select("id", F.xxhash64("id").alias("h"))
    for parts in (None, ["p"]):
        staged = stage_table(rows.withColumn("p", F.lit(1)), "groups", parts)
        (file,) = staged.inputFiles()
        groups = pq.ParquetFile(file.removeprefix("file:").replace("///", "/")).metadata
        sizes = [groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)]
        assert len(sizes) > 4 and max(sizes) < 4 << 20
        assert staged.select("id", "h").exceptAll(rows).count() == 0 and staged.count() == 1_000_000


def test_class_counts_of_long_texts_use_little_memory():
    texts = pa.array(["a" * 10 + "!#", None, "", "x! " * 5_000_000, "Q1."])
    data, offsets = kernel.utf8(texts)
    for name, table in gam._CLASSES.items():
        tracemalloc.start()
        got = gam._counts(data, offsets, table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.tolist() == [int(table[data[a:b]].sum()) for a, b in zip(offsets[:-1], offsets[1:])], name
        assert peak < 2 * len(data)


def test_run_is_registered(spark, folder):
    assert entry.queries()["pipeline"](spark, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_on_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (None, ""), (1, None), (1, None), (None, PARAGRAPH), (None, PARAGRAPH)], "doc_id long, text string")
    odd = docs.limit(0).unionByName(odd, allowMissingColumns=True)
    kept = {"quality_rules": 2, "near_duplicates": 5, "secret_scan": 6, "packing": 6}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        rows = stage(spark, odd, folder).collect()
        assert len(rows) == kept.get(name, len(rows)) <= 6
        if name == "secret_scan":
            assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, ((r.doc_id, r.text) for r in odd.collect())))
