"""What the training-data operators share: table access, the shared folder, column hygiene."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a session in one
    JVM gets a temporary one; on a cluster that is an error, as executors wouldn't see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Within it, what a statement has shuffled is removed when the statement ends, and not when the driver happens to
    collect its garbage: for loops of steps that each read what was stored before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str, rows: int | None = None, per_task: int = 50_000) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back, so a lost
    executor costs a read and not the work that made the table. Where a bound of the rows of a table of a
    few numbers a row is known, the last stage has one task for each per_task of them, so that small tables
    don't cost many tiny tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None and (n := 1 + rows // per_task) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(n)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string, nothing else: extra columns, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sampled(docs: DataFrame, most: int, most_bytes: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """What a model is fitted on: doc_id, text and the extra columns of at most `most` different rows and `most_bytes`
    bytes of text, whole texts all. Rows come in the order of the hash of doc_id, as long as the sum of their bytes stays
    within the bound; a text of more than a sixteenth of it is left out, as are rows without doc_id, and
    equal rows count once. What is broadcast and what comes out are so bounded, whatever the table holds."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).where("doc_id is not null")
    keyed = own.withColumn("_h", F.xxhash64("text")).withColumn("_n", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("_h"))
    first = keyed.where(F.col("_n") <= most_bytes // 16).select("doc_id", "_h", "_n").distinct().orderBy(*order).limit(most)
    so_far = F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # at most `most` short rows
    chosen = first.withColumn("_s", so_far).where(F.col("_s") <= most_bytes).select("doc_id", "_h")
    return keyed.join(F.broadcast(chosen), ["doc_id", "_h"]).groupBy("doc_id", "_h", *extra).agg(F.first("text").alias("text")).drop("_h")
