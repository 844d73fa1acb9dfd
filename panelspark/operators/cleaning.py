"""Cleaning of factors across each date's section, on the long view (date, ticker, factor, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["date", "factor"]


def to_long(df: DataFrame, factors: list[str]) -> DataFrame:
    """Wide to long; missing values stay as null rows."""
    return df.unpivot(["date", "ticker"], factors, "factor", "value")


def to_wide(df: DataFrame, factors: list[str], value: str = "value") -> DataFrame:
    return df.groupBy("date", "ticker").pivot("factor", factors).agg(F.first(value))


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def winsorize(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values cut at two quantiles of their (date, factor), linearly interpolated."""
    w = Window.partitionBy(KEYS)
    q = F.percentile("value", F.lit([low, high])).over(w)
    return df.withColumn("_q", q).withColumn("value", _clip(F.col("value"), F.col("_q")[0], F.col("_q")[1])).drop("_q")


def mad_winsorize(df: DataFrame, n: float = 3.0) -> DataFrame:
    """Values cut at median +- n times the median absolute deviation (unscaled); groups without deviation
    stay as they are."""
    w = Window.partitionBy(KEYS)
    df = df.withColumn("_m", F.median("value").over(w)).withColumn("_d", F.abs(F.col("value") - F.col("_m")))
    df = df.withColumn("_d", F.median("_d").over(w))
    cut = _clip(F.col("value"), F.col("_m") - n * F.col("_d"), F.col("_m") + n * F.col("_d"))
    return df.withColumn("value", F.when(F.col("_d") > 0, cut).otherwise(F.col("value"))).drop("_m", "_d")


def rank_normalize(df: DataFrame) -> DataFrame:
    """Percentile of the first-come rank: ties by ticker."""
    order = Window.partitionBy(KEYS).orderBy(F.col("value").asc_nulls_last(), "ticker")
    return df.withColumn("value", F.when(F.col("value").isNotNull(), F.row_number().over(order) / F.count("value").over(Window.partitionBy(KEYS))))


def zscore(df: DataFrame, sample: bool = False) -> DataFrame:
    """Standard scores. Population spread, with 1 where there is none; or sample spread, with score 0
    where it is below 1e-8."""
    w, x = Window.partitionBy(KEYS), F.col("value")
    centred = x - F.avg(x).over(w)
    if sample:
        sd = F.stddev_samp(x).over(w)
        return df.withColumn("value", F.when(x.isNotNull(), F.when(sd >= 1e-8, centred / sd).otherwise(0.0)))
    sd = F.stddev_pop(x).over(w)
    return df.withColumn("value", F.when(sd > 1e-12, centred / sd).otherwise(centred))


def fill_median(df: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Missing values from the date's median, then the training median (factor, median), then 0."""
    m = F.median("value").over(Window.partitionBy(KEYS))
    if train is not None:
        df = df.join(F.broadcast(train.select("factor", F.col("median").alias("_t"))), "factor", "left")  # one row a factor
        return df.withColumn("value", F.coalesce("value", m, "_t", F.lit(0.0))).drop("_t")
    return df.withColumn("value", F.coalesce("value", m, F.lit(0.0)))


def neutralize(df: DataFrame, size: str | None = None, group: str | None = None) -> DataFrame:
    """Residual of each date's least-squares fit on log market cap (`size`) and group dummies, with
    intercept. Groups are taken out of both sides first, so one regressor is left (Frisch-Waugh)."""
    w = Window.partitionBy(KEYS)
    inner = Window.partitionBy([*KEYS, group]) if group else w
    known = F.col("value").isNotNull() & (F.col(size).isNotNull() if size else F.lit(True))
    y = F.when(known, F.col("value"))
    df = df.withColumn("_y", y - F.avg(y).over(inner))
    if not size:
        return df.withColumn("value", F.coalesce("_y", "value")).drop("_y")
    x = F.when(known & (F.col(size) > 0), F.log(size))
    df = df.withColumn("_x", x - F.avg(x).over(inner))
    slope = F.try_divide(F.sum(F.col("_x") * F.col("_y")).over(w), F.sum(F.col("_x") * F.col("_x")).over(w))
    return df.withColumn("value", F.coalesce(F.col("_y") - F.coalesce(slope, F.lit(0.0)) * F.col("_x"), F.col("value"))).drop("_x", "_y")


def feature_profile(df: DataFrame, near_const_std: float = 1e-9) -> DataFrame:
    """For each factor: share missing, smallest, largest, and the share of days that are nearly constant."""
    day = df.groupBy("factor", "date").agg(F.count("*").alias("n"), F.count("value").alias("k"), F.min("value").alias("a"), F.max("value").alias("b"), F.stddev_pop("value").alias("s"))
    flat = F.coalesce(F.col("s") < near_const_std, F.lit(True)).cast("double")
    return day.groupBy("factor").agg((1 - F.sum("k") / F.sum("n")).alias("missing"), F.min("a").alias("low"), F.max("b").alias("high"), F.avg(flat).alias("flat_days"))


def good_features(df: DataFrame, max_missing: float = 0.2, near_const_frac: float = 0.8) -> DataFrame:
    """Factors that are neither empty nor constant, nor too sparse, nor nearly constant on most days."""
    p = feature_profile(df)
    return p.where((F.col("missing") <= max_missing) & (F.col("low") < F.col("high")) & (F.col("flat_days") <= near_const_frac))


def enough_rows(df: DataFrame, least: int = 30) -> DataFrame:
    """Rows of dates with at least so many rows."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("date"))).where(F.col("_n") >= least).drop("_n")


def mostly_filled_rows(df: DataFrame, factors: list[str], most_missing: float = 0.9) -> DataFrame:
    """Rows whose share of missing factors is below the limit."""
    missing = sum((F.col(c).isNull().cast("int") for c in factors), F.lit(0))
    return df.where(missing < most_missing * len(factors))


def align(df: DataFrame, features: list[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Exactly the listed features in their order; missing ones and nulls by the training median, else 0."""
    m = medians or {}
    have = set(df.columns)
    return df.select("date", "ticker", *(F.coalesce(F.col(c) if c in have else F.lit(None).cast("double"), F.lit(float(m.get(c, 0.0)))).alias(c) for c in features))


def stability(df: DataFrame, window: int = 60) -> DataFrame:
    """Median over all cells of each ticker's rolling spread (at least half a window), and coverage."""
    w = Window.partitionBy("factor", "ticker").orderBy("date").rowsBetween(-(window - 1), 0)
    df = df.withColumn("_s", F.when(F.count("value").over(w) >= window // 2, F.stddev_samp("value").over(w)))
    return df.groupBy("factor").agg(F.median("_s").alias("stability"), (F.count("value") / F.count("*")).alias("coverage"))
