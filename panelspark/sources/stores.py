"""Stores: tables of (date, ticker) rows in a folder for each date, and bucketed tables of the catalog."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder column of a store; the date itself stays in the files too, so that their footers know its range.
DAY = "day"


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a session
    in one JVM gets a temporary one; on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: what follows starts from these files, on any executor, and
    the steps before run once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """A table of (date, ticker) rows under a path, in one folder for each date.

    Dates are replaced as a whole: a write lists the dates of its rows, replaces the files of their folders and leaves
    all other folders alone. Spark moves the new files in when the whole job has succeeded, so that a failed
    or repeated job leaves old rows or new ones and never both.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        """Whether something was written to the store."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """The rows of a range of dates; only these dates' folders are listed and read."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        if start is not None:
            rows = rows.where(F.col(DAY) >= F.lit(start).cast("date"))
        if end is not None:
            rows = rows.where(F.col(DAY) <= F.lit(end).cast("date"))
        return rows.drop(DAY)

    def dates(self) -> DataFrame:
        """date of each folder. A folder's name is all that is used of it."""
        return self.spark.read.parquet(self.path).select(F.col(DAY).alias("date")).distinct()

    def replace(self, rows: DataFrame) -> None:
        """Writes rows; the dates that they have are replaced, others are kept. Rows of a date come from one task,
        split by Spark where a date is large, so that a date has few files."""
        dated = rows.withColumn(DAY, F.col("date"))
        dated.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.path)

    def upsert(self, rows: DataFrame, keys: tuple[str, ...] = ("date", "ticker")) -> None:
        """Replaces the rows with the keys of `rows` and adds the others; rows of the same dates with other keys
        stay. Old rows are read for the dates of `rows` alone, and a key's columns that rows lack become null."""
        if self.exists():
            days = F.broadcast(rows.select(F.col("date").alias(DAY)).distinct())  # a row a date
            old = self.spark.read.option("mergeSchema", "true").parquet(self.path).join(days, DAY, "left_semi").drop(DAY)
            rows = rows.unionByName(old.join(rows.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)
        self.replace(rows)

    def add_missing(self, rows: DataFrame) -> None:
        """Writes the rows of dates that the store lacks; known dates are left as they are."""
        if self.exists():
            rows = rows.join(F.broadcast(self.dates()), "date", "left_anti")  # a row a date
        self.replace(rows)

    def span(self) -> DataFrame:
        """One row: first and last date and rows, from the files' footers: the scan is given the aggregates and
        reads no column."""
        own = self.spark.newSession()
        own.conf.set("spark.sql.sources.useV1SourceList", "")
        own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        return own.read.parquet(self.path).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows"))


def bucketed(df: DataFrame, name: str, buckets: int, path: str | None = None, key: str = "ticker", order: str = "date") -> DataFrame:
    """The panel as a table of the catalog, bucketed by key and sorted by key and order in each bucket: windows and
    joins by the key over it need no exchange. One task writes each bucket. path: where its files go (the
    warehouse, if not given)."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return df.sparkSession.table(name)
