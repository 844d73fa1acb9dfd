"""Small text sources, tolerant JSON, and report sinks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRADE = "struct<time:string,symbol:string,side:string,quantity:double,price:double>"


def instruments(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated symbol, start, end without header: distinct symbols in order."""
    rows = spark.read.csv(path, sep="\t", schema="symbol string, start_date string, end_date string")
    return rows.where("symbol is not null").select("symbol").distinct().orderBy("symbol")


def symbols_csv(spark: SparkSession, path: str) -> DataFrame:
    """ticker, ord of a CSV with a Symbol column: dots as hyphens, trimmed, blanks dropped, first kept. The
    file's order is that of its rows within its splits; such lists are small."""
    rows = spark.read.csv(path, header=True).select(F.trim(F.translate("Symbol", ".", "-")).alias("ticker")).where("ticker <> ''")
    return rows.withColumn("i", F.monotonically_increasing_id()).groupBy("ticker").agg(F.min("i").alias("i")).select("ticker", F.row_number().over(Window.orderBy("i")).alias("ord"))


def ticker_lines(spark: SparkSession, path: str) -> DataFrame:
    """One ticker per line; blank lines and comments dropped."""
    return spark.read.text(path).select(F.trim("value").alias("ticker")).where("ticker <> '' and not startswith(ticker, '#')")


def market_caps(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of ticker to market cap: ticker, market_cap, rank."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("ticker", "market_cap"))
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("market_cap"), "ticker")))  # a short list


def trades_json(spark: SparkSession, path: str) -> DataFrame:
    """Trades from any of four shapes: a list; {"trades": [...]}; a dict of lists; a dict of dicts."""
    raw = spark.read.text(path, wholetext=True)
    v = F.col("value")
    listed = F.from_json(v, f"array<{TRADE}>")
    wrapped = F.from_json(F.get_json_object(v, "$.trades"), f"array<{TRADE}>")
    lists = F.flatten(F.map_values(F.from_json(v, f"map<string,array<{TRADE}>>")))
    dicts = F.map_values(F.from_json(v, f"map<string,{TRADE}>"))
    rows = F.when(F.startswith(F.ltrim(v), F.lit("[")), listed).when(F.get_json_object(v, "$.trades").isNotNull(), wrapped).otherwise(F.coalesce(F.filter(lists, lambda x: x["symbol"].isNotNull()), dicts))
    return raw.select(F.explode(rows).alias("t")).select("t.*").where("symbol is not null")


def write_json(df: DataFrame, path: str, key: str | None = None) -> None:
    """Rows as JSON lines, NaN as null; with key one object per key with its rows as a list."""
    from .panel import clean

    df = clean(df)
    if key:
        rest = [c for c in df.columns if c != key]
        df = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))
    df.write.mode("overwrite").json(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def rewritten(df: DataFrame, folder: str) -> str:
    """Writes df as a new version beside the others and returns its path; the input, which may be an older
    version, is never overwritten."""
    path = f"{folder}/v{time.time_ns()}"
    df.write.parquet(path)
    return path


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version under a folder, by Spark's own file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path")
    newest = files.select(F.max(F.regexp_extract("path", r"/(v[0-9]+)/[^/]*$", 1))).first()[0]
    return spark.read.parquet(f"{folder}/{newest}")
