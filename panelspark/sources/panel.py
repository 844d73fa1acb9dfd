"""The price panel: reading, cleaning, completing the date grid, and the panels derived from star tables."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stores import stored

SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume"))])
FIELDS = ("open", "high", "low", "close", "adj_close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cleaned(x: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean(df: DataFrame) -> DataFrame:
    """All float columns cleaned, others as they are."""
    return df.select(*(cleaned(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema))


def normalise(df: DataFrame) -> DataFrame:
    """Vendor names to the panel's: lower case, spaces to underscores, `adj_close` = close where it is
    missing; date as DATE, ticker as string, fields as cleaned doubles, in the fixed column order."""
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    return df.select(F.to_date("date").alias("date"), F.col("ticker").cast("string").alias("ticker"), *(cleaned(F.col(c).cast("double")).alias(c) for c in FIELDS))


def read_prices(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """The panel from Parquet, else from the table `fallback`; fails if neither can be read."""
    try:
        df = spark.read.parquet(path)
    except Exception:
        if fallback is None:
            raise
        df = spark.table(fallback)
    return normalise(df)


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by year, dates together within a file."""
    df.withColumn("year", F.year("date")).repartitionByRange("year", "date").sortWithinPartitions("date", "ticker").write.mode(mode).partitionBy("year").parquet(path)


def densify(panel: DataFrame, span_only: bool = False) -> DataFrame:
    """All dates times all tickers, with nulls where a ticker has no bar: what a wide matrix holds. With
    span_only each ticker keeps its first to last date. The date list is small (one row a day) and is
    crossed with the ticker list; bars join by key."""
    dates = panel.select("date").distinct()
    spans = panel.groupBy("ticker").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    grid = dates.crossJoin(spans)
    if span_only:
        grid = grid.where(F.col("date").between(F.col("_a"), F.col("_b")))
    return grid.select("date", "ticker").join(panel, ["date", "ticker"], "left")


#: The bars that the query being built has made so far; None outside of one_pass().
_MADE: ContextVar[dict[tuple[str, str], DataFrame] | None] = ContextVar("made", default=None)


def one_pass(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query with each kind of bars made once and stored: factors, labels and calendars start from the stored bars,
    and so does every job of a query that runs many (fits of models, stores), instead of each aggregating the
    lines again. Nothing is kept for the next call."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _MADE.set({})
        try:
            return query(spark, sf_dir)
        finally:
            _MADE.reset(token)

    return run


def bars(spark: SparkSession, sf_dir: str, ticker: str = "p_brand") -> DataFrame:
    """Weekly bars of unit prices from lineitem: by brand (dense) or by supplier (`l_suppkey`, gappy)."""
    made = _MADE.get()
    if made is None:
        return _bars(spark, sf_dir, ticker)
    if (sf_dir, ticker) not in made:
        made[sf_dir, ticker] = stored(_bars(spark, sf_dir, ticker))
    return made[sf_dir, ticker]


def _bars(spark: SparkSession, sf_dir: str, ticker: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    if ticker == "p_brand":
        li = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return li.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col(ticker).cast("string").alias("ticker")).agg(F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, order).alias("close"), F.max_by(px, order).alias("adj_close"), F.sum("l_quantity").cast("double").alias("volume"))


def bars_sql(ticker: str = "p_brand") -> str:
    """bars() as SQL."""
    join = "JOIN part ON l_partkey = p_partkey" if ticker == "p_brand" else ""
    return f"""SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST({ticker} AS VARCHAR) AS ticker,
        arg_min(px, ord) AS open, max(px) AS high, min(px) AS low, arg_max(px, ord) AS close, arg_max(px, ord) AS adj_close, CAST(sum(l_quantity) AS DOUBLE) AS volume
        FROM (SELECT *, l_extendedprice / l_quantity AS px, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ord FROM lineitem {join})
        GROUP BY 1, 2"""


def grid_sql(ticker: str = "p_brand") -> str:
    """densify(bars()) as SQL."""
    return f"""SELECT * FROM (SELECT DISTINCT date FROM ({bars_sql(ticker)})) CROSS JOIN (SELECT DISTINCT ticker FROM ({bars_sql(ticker)})) LEFT JOIN ({bars_sql(ticker)}) USING (date, ticker)"""
