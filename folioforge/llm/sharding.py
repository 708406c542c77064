"""Two-pass external shuffle: rows scatter into memory-sized buckets by a seeded hash, then each bucket is shuffled and written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extend, keep_clear, stage_table

#: Bytes of text in a bucket, on average; a bucket is held in memory by one Python worker.
BUCKET_BYTES = 8 << 20
#: Buckets that a task shuffles, one after the other, where the session's partitions are too few.
TASK_BUCKETS = 64
#: Groups of equal rows that are spread, the largest at most, and their parts; buckets whose sizes are summed together.
GROUPS, PARTS, BLOCK = 100_000, 1024, 1024


def fixed(docs: DataFrame) -> DataFrame:
    """docs, stored first unless it is read from files without a shuffle, so that its rows come in one order each time."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return docs if docs.inputFiles() and "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan else stage_table(docs, "fixed")


def scatter(docs: DataFrame, key: str, text: str, seed: int, buckets: int, bucket_bytes: int) -> DataFrame:
    """docs with __bucket, a seeded hash of key and text.

    Rows equal in both which together fill a bucket are spread by a part drawn by place; of such groups the GROUPS largest
    are broadcast, as numbers.
    """
    docs = docs.withColumn("__row", F.xxhash64(F.lit(seed), F.col(key), F.col(text)))
    sizes = docs.groupBy("__row").agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("__size"), F.count("*").alias("__n"))
    large = sizes.filter((F.col("__size") > bucket_bytes) & (F.col("__n") > 1)).orderBy(F.desc("__size"), "__row").limit(GROUPS).select("__row", F.lit(True).alias("__large"))
    part = F.when(F.col("__large"), F.floor(F.rand(seed) * PARTS)).otherwise(F.lit(0))
    marked = docs.join(F.broadcast(large), "__row", "left")
    return marked.withColumn("__bucket", F.pmod(F.xxhash64("__row", part), F.lit(buckets)).cast("int")).drop("__row", "__large")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform order of n rows: each place, from the last, swaps with a place drawn from those up to it."""
    drawn = (np.random.Generator(np.random.PCG64(seed)).random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = drawn[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of docs, with shard and slot: a uniform shuffle of the table, dealt to shards like cards.

    Law `rows`: row p of the shuffled table goes to shard p mod shards, at slot p div shards, so that row counts differ
    by one at most and slots have no gaps. Bucket offsets come from a count of rows per bucket, summed in blocks. The
    order within a bucket is drawn from the seed and the bucket's number over rows sorted by key and text, so a task that
    runs again writes the same rows. Rows that are equal in key and text are interchangeable; a group of them
    that fills a bucket spreads over all, as do rows of one key, or of null key, that differ in text. Null texts count no bytes; a very long text makes its bucket as much
    larger. An empty table gives no rows. Input columns named shard or slot are renamed in_shard, in_slot.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    docs = fixed(keep_clear(docs, ["shard", "slot", "__bucket", "__row", "__large"]))
    size = docs.select(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    scattered = scatter(docs, key, text, seed, buckets, bucket_bytes)
    counts = scattered.groupBy("__bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"__bucket div {BLOCK}"))
    # Running sums within blocks, and over the blocks' sums: one row for each BLOCK buckets comes to one task.
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).selectExpr("block", "sum(n) OVER (ORDER BY block) - n AS before")
    inner = counts.selectExpr("__bucket", "block", "sum(n) OVER (PARTITION BY block ORDER BY __bucket) - n AS within")
    firsts = inner.join(blocks, "block").selectExpr("__bucket AS __at", "before + within AS __first")
    names = docs.columns
    schema = extend(docs.schema, "shard int, slot long")

    def deal(rows: pa.Table, first: pa.Table) -> pa.Table:
        number, at = first.column("__at")[0].as_py(), first.column("__first")[0].as_py()
        rows = rows.select(names).sort_by([(key, "ascending"), (text, "ascending")])
        place = at + np.arange(rows.num_rows)
        order = fisher_yates(rows.num_rows, [seed, number])
        return rows.take(pa.array(order)).append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))

    tasks = max(-(-buckets // TASK_BUCKETS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return scattered.repartition(tasks, "__bucket").groupBy("__bucket").cogroup(firsts.groupBy("__at")).applyInArrow(deal, schema)


def write_shards(docs: DataFrame, shards: int, **options) -> DataFrame:
    """shuffle_into_shards, written to the shared folder as one directory of Parquet files a shard, and read back."""
    return stage_table(shuffle_into_shards(docs, shards, **options), "shards", ["shard"])


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    written = write_shards(docs, 8)
    text = F.coalesce(F.col("text"), F.lit(""))
    return written.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
