"""Weights to returns to reports: portfolio returns, turnover and cost, curves, monthly tables, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252


def top_k(scores: DataFrame, k: int, score: str = "prediction") -> DataFrame:
    """date, ticker, weight: equal weights on each date's k best (ties by ticker)."""
    r = F.row_number().over(Window.partitionBy("date").orderBy(F.col(score).desc_nulls_last(), "ticker"))
    best = scores.where(F.col(score).isNotNull()).withColumn("_r", r).where(F.col("_r") <= k)
    return best.select("date", "ticker", F.try_divide(F.lit(1.0), F.count("*").over(Window.partitionBy("date"))).alias("weight"))


def inverse_volatility(sds: DataFrame) -> DataFrame:
    """date, ticker, weight in proportion to 1 / sd."""
    inv = F.try_divide(F.lit(1.0), F.col("sd"))
    return sds.where("sd > 0").select("date", "ticker", (inv / F.sum(inv).over(Window.partitionBy("date"))).alias("weight"))


def restrict(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Weights of universe members, made to sum to 1 on each date again; 0 where nothing is left."""
    own = weights.join(universe.select("ticker").distinct(), "ticker", "left_semi")
    total = F.sum("weight").over(Window.partitionBy("date"))
    return own.select("date", "ticker", F.when(total > 0, F.col("weight") / total).otherwise(0.0).alias("weight"))


def portfolio_returns(weights: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of weight times next return by date; a missing return counts as 0."""
    keys = [*(keys or []), "date"]
    j = weights.join(labels, ["date", "ticker"], "left")
    return j.groupBy(keys).agg(F.sum(F.col("weight") * F.coalesce("label", F.lit(0.0))).alias("gross_return"))


def turnover(weights: DataFrame, convention: str = "two_sided") -> DataFrame:
    """date, turnover: sum of absolute weight changes since the previous date (half of it by convention
    `half`). Each held weight meets the one of the previous date by one shuffle; sales appear on the next
    date of the calendar."""
    dates = weights.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    dates = F.broadcast(dates)  # one row per date
    now = weights.select("date", "ticker", F.col("weight").alias("w"))
    before = weights.join(dates, "date").where("next is not null").select(F.col("next").alias("date"), "ticker", (-F.col("weight")).alias("w"))
    change = now.unionAll(before).groupBy("date", "ticker").agg(F.sum("w").alias("w"))
    return change.groupBy("date").agg((F.sum(F.abs("w")) * (1.0 if convention == "two_sided" else 0.5)).alias("turnover"))


def net_returns(returns: DataFrame, turn: DataFrame, rate: float = 0.001) -> DataFrame:
    r = returns.join(turn, "date", "left")
    return r.withColumn("cost", F.coalesce("turnover", F.lit(0.0)) * rate).withColumn("net_return", F.col("gross_return") - F.col("cost"))


def ordered(keys: list[str] | None = None):
    """Window along dates of a return series: a few thousand rows for each key."""
    return Window.partitionBy(keys or F.lit(0)).orderBy("date")


def curve(returns: DataFrame, value: str, keys: list[str] | None = None, start: float = 1.0) -> DataFrame:
    """returns with nav and drawdown (against the highest nav so far, the start included). Growth is multiplied,
    so a total loss leaves 0 and a loss of more than all (on credit) a nav below 0."""
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    r = returns.withColumn("nav", F.lit(start) * F.product(1 + F.col(value)).over(w))
    return r.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(start)) - 1)


def risk_summary(returns: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Days, mean, spread, annual return and spread, information ratio, total return, largest drawdown and its date."""
    c = curve(returns, value, keys)
    x = c.groupBy(*(keys or [])).agg(F.count(value).alias("days"), F.min("date").alias("start"), F.max("date").alias("end"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.max_by("nav", "date") - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown"), F.min_by("date", F.struct("drawdown", "date")).alias("max_drawdown_date"))
    return x.withColumn("annual_return", F.col("mean") * DAYS).withColumn("annual_volatility", F.col("sd") * math.sqrt(DAYS)).withColumn("information_ratio", F.try_divide("mean", "sd") * math.sqrt(DAYS))


def rolling_performance(returns: DataFrame, value: str, window: int = 60) -> DataFrame:
    """Rolling annual return, annual volatility (population) and Sharpe ratio."""
    w = ordered().rowsBetween(-(window - 1), 0)
    ok = F.count(value).over(w) >= window
    m, s = F.avg(value).over(w), F.stddev_pop(value).over(w)
    return returns.select("date", F.when(ok, m * DAYS).alias("rolling_return"), F.when(ok, s * math.sqrt(DAYS)).alias("rolling_volatility"), F.when(ok, F.try_divide(m, s) * math.sqrt(DAYS)).alias("rolling_sharpe"))


def alpha_beta(returns: DataFrame, value: str, benchmark: str, window: int = 60) -> DataFrame:
    """Rolling least-squares slope, and intercept times the days of a year, against a benchmark."""
    w = ordered().rowsBetween(-(window - 1), 0)
    ok = F.count(value).over(w) >= window
    v = F.var_pop(benchmark).over(w)
    beta = F.when(ok & (v > 0), F.try_divide(F.covar_pop(value, benchmark).over(w), v))
    return returns.select("date", beta.alias("beta"), ((F.avg(value).over(w) - beta * F.avg(benchmark).over(w)) * DAYS).alias("alpha"))


def monthly(returns: DataFrame, value: str, *more: str) -> DataFrame:
    """month (its last day) and the compounded return of each value column."""
    m = F.last_day("date").alias("month")
    return returns.groupBy(m).agg(*((F.product(1 + F.col(c)) - 1).alias(c) for c in (value, *more)), F.count("*").alias("days"))


def histogram(returns: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin 0..bins-1, its ends and its count, over the range of the values."""
    lim = returns.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    x = returns.where(F.col(value).isNotNull()).crossJoin(F.broadcast(lim))  # one row
    width = (F.col("b") - F.col("a")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("a")) / width), F.lit(bins - 1))).otherwise(0)
    return x.withColumn("bin", b.cast("int")).groupBy("bin").agg(F.count("*").alias("n"), F.min(F.col("a") + F.col("bin") * width).alias("low"))


def benchmark_returns(panel: DataFrame, kind: str = "mean_of_returns", price: str = "adj_close") -> DataFrame:
    """Equal-weight benchmark: the mean of the tickers' returns (gaps filled both ways first), or the
    return of the mean price."""
    w = Window.partitionBy("ticker").orderBy("date")
    if kind == "mean_of_returns":
        p = F.coalesce(F.last(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(price, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
        x = panel.withColumn("_p", p).withColumn("_r", F.try_divide("_p", F.lag("_p").over(w)) - 1)
        return x.groupBy("date").agg(F.avg("_r").alias("benchmark_return"))
    m = panel.groupBy("date").agg(F.avg(price).alias("_m"))
    return m.select("date", (F.try_divide("_m", F.lag("_m").over(ordered())) - 1).alias("benchmark_return"))


def aligned_series(returns: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """returns with `value` of the newest row of series (date, value) up to each date, 0 before the first. Rows of
    series between the dates of returns count for the next date."""
    own = returns.withColumn("_own", F.lit(True)).unionByName(series.select("date", F.col(value).alias("_x")), allowMissingColumns=True)
    w = Window.orderBy("date", F.col("_own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # one row a date of each
    return own.withColumn(value, F.coalesce(F.last("_x", ignorenulls=True).over(w), F.lit(0.0))).where("_own").drop("_own", "_x")


def resolve_return(columns: list[str]) -> Column | None:
    """The first known return column of a table."""
    known = [c for c in ("net_return", "strategy_return", "portfolio_return", "return", "returns", "gross_return") if c in columns]
    return F.coalesce(*known) if known else None
