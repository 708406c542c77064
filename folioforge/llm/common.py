"""Shared plumbing of the training-data operators: staged tables, input checks, column naming."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words: space, and tab to carriage return. Fixed by the operators' contracts.
SPACE = r"[ \t-\r]"

#: Bytes of files that spread deals to a task on average, and the partitions it makes at most.
SPREAD_BYTES, SPREAD_MOST = 16 << 20, 10_000

#: Bytes of a row group of staged tables: each task that writes or reads one holds a whole group in the JVM's heap.
GROUP_BYTES = 16 << 20

_own_dir: list[str] = []
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one where that is unset and Spark runs locally."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="folioforge-"))
    return "file://" + _own_dir[0]


def stage_table(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.size", GROUP_BYTES)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged_tables() -> int:
    """How many tables are staged now: a mark for release_staged."""
    return len(_staged)


def release_staged(since: int = 0, but_last: bool = False) -> None:
    """Delete the tables staged since a mark, or all but the last of them, once results that read them are not needed."""
    last = [_staged.pop()] if but_last and len(_staged) > since else []
    while len(_staged) > since:
        spark, path = _staged.pop()
        jvm = spark.sparkContext._jvm
        if jvm is not None and spark.sparkContext._jsc is not None:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _staged.extend(last)


atexit.register(release_staged)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores, SPREAD_BYTES a task, where the input has fewer files than cores; inputs of more files stay as scanned.

    A few large files may be of one row group each, which a scan cannot split.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    if files >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if files else 0
    return df.repartition(max(cores, min(SPREAD_MOST, -(-size // SPREAD_BYTES))))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keep_clear(df: DataFrame, reserved: list[str]) -> DataFrame:
    """Rename input columns that clash with an operator's own output: shard becomes in_shard, then in_in_shard."""
    taken = {c.lower() for c in df.columns} | {r.lower() for r in reserved}
    wanted = {r.lower() for r in reserved}
    names = []
    for name in df.columns:
        fresh = name
        if name.lower() in wanted:
            while fresh.lower() in taken:
                fresh = f"in_{fresh}"
            taken.add(fresh.lower())
        names.append(fresh)
    return df.toDF(*names) if names != df.columns else df


def packed(df: DataFrame) -> DataFrame:
    """All columns of df as one struct, row, beside which names are free."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once and held as a lambda variable rather than inlined where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def extend(schema: T.StructType, ddl: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
