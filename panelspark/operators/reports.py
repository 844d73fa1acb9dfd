"""Reports over factors, predictions and accounts: each is one pass of aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .diagnostics import with_p_values

# The screening rules, as least |mean IC|, |ICIR|, share of days above 0, and significance.
RULES = {"strict": (0.02, 0.5, 0.6, True), "moderate": (0.005, 0.05, 0.5, False)}


def screened(summary: DataFrame) -> DataFrame:
    """rule, factor: the factors that pass all conditions of a screening rule, from the table of ic_summary."""
    s = with_p_values(summary) if "significant" not in summary.columns else summary
    passed = [F.when((F.abs("ic_mean") > m) & (F.abs("icir") > i) & (F.col("win_rate") > w) & (F.col("significant") if sure else F.lit(True)), F.lit(rule)) for rule, (m, i, w, sure) in RULES.items()]
    return s.select(F.explode(F.array_compact(F.array(*passed))).alias("rule"), "factor")


def factor_score(summary: DataFrame) -> DataFrame:
    """factor, score: |mean / spread| of the IC (sample spread), |mean| where the spread vanishes."""
    sd = F.col("ic_std_sample")
    return summary.select("factor", F.coalesce(F.when(sd > 1e-8, F.abs(F.col("ic_mean") / sd)), F.abs("ic_mean")).alias("score"))


def top_submatrix(correlation: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The correlations among the k factors with the best score (0 where unknown, ties by name)."""
    if k not in (20, 50, 100):
        raise ValueError("k is one of 20, 50, 100")
    names = correlation.select(F.col("factor_a").alias("factor")).distinct().join(scores, "factor", "left")
    best = names.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "factor").limit(k).select("factor")
    return correlation.join(best.withColumnRenamed("factor", "factor_a"), "factor_a", "left_semi").join(best.withColumnRenamed("factor", "factor_b"), "factor_b", "left_semi")


def latest_prediction_stats(predictions: DataFrame) -> DataFrame:
    """One row: the newest date, and mean, spread, extremes and count of its predictions."""
    x = F.col("prediction")
    day = predictions.groupBy("date").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))
    return day.orderBy(F.desc("date")).limit(1)


def live_report(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """date, ic, n: rank IC of the predictions with what came after, on the dates that have both."""
    from .diagnostics import rank_ic

    return rank_ic(predictions.select("date", "ticker", F.lit("prediction").alias("factor"), F.col("prediction").alias("value")), labels).drop("factor")


def daily_factor_report(ics: DataFrame, day: str, top: int = 20) -> DataFrame:
    """factor, date, ic, icir, win_rate of the `top` factors by |IC| on the latest date not after `day` (else
    the first date); ICIR and win rate are over the history up to that date."""
    d = F.lit(day).cast("date")
    at = ics.agg(F.coalesce(F.max(F.when(F.col("date") <= d, F.col("date"))), F.min("date")).alias("_at"))
    own = ics.join(F.broadcast(at), F.col("date") <= F.col("_at"))  # one row
    past = own.groupBy("factor").agg(F.max("_at").alias("date"), F.max(F.when(F.col("date") == F.col("_at"), F.col("ic"))).alias("ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"))
    return past.where("ic is not null").orderBy(F.abs("ic").desc(), "factor").limit(top)


def factors_on(long: DataFrame, day: str) -> DataFrame:
    """ticker, factors: a map from factor to value for each ticker of a date, null values left out."""
    x = long.where((F.col("date") == F.lit(day).cast("date")) & F.col("value").isNotNull())
    return x.groupBy("ticker").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("factor", "value")))).alias("factors"))


def contribution(ics: DataFrame, names: list[str]) -> DataFrame:
    """factor, daily_ic_mean, daily_ic_std (sample), coverage_days of the named factors."""
    return ics.where(F.col("factor").isin(names)).groupBy("factor").agg(F.avg("ic").alias("daily_ic_mean"), F.stddev_samp("ic").alias("daily_ic_std"), F.count("ic").alias("coverage_days"))


def clusters(summary: DataFrame, exposure: DataFrame, least: float = 0.05) -> DataFrame:
    """factor, dominant_style (`Custom` where no exposure reaches `least`), its two largest exposures and
    whether it is degenerate (no exposure at all), with the factor's mean IC and ICIR."""
    w = Window.partitionBy("factor").orderBy(F.abs("exposure").desc(), "style")
    two = exposure.withColumn("_k", F.row_number().over(w)).where("_k <= 2").groupBy("factor").agg(*(F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"{c}_{k}") for k in (1, 2) for c in ("style", "exposure")))
    j = summary.select("factor", "ic_mean", "icir").join(two, "factor", "left")
    big = F.abs("exposure_1") >= least
    return j.withColumn("dominant_style", F.when(big, F.col("style_1")).otherwise("Custom")).withColumn("degenerate", F.coalesce(F.col("exposure_1") == 0, F.lit(True)))


def daily_from_cumulative(curves: DataFrame, value: str = "cumulative") -> DataFrame:
    """curves (key, date, value) with `daily`, the return since the key's previous date; null on its first."""
    return curves.withColumn("daily", F.try_divide(F.col(value), F.lag(value).over(Window.partitionBy("factor").orderBy("date"))) - 1)


def statement_totals(statement: DataFrame) -> DataFrame:
    """One row of an account's statement (account, realized, unrealized, cash_flow, value): the sums, and net
    liquidation as value plus cash flows."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return statement.groupBy("account").agg(s("realized").alias("realized"), s("unrealized").alias("unrealized"), s("cash_flow").alias("cash_flow"), (s("value") + s("cash_flow")).alias("net_liquidation"))


def style_rows(risk: DataFrame, day: str, raw_name: str = r"^(Alpha\d+|.*_\d+)$") -> DataFrame:
    """Rows of the risk table (date, style, ...) of the latest date not after `day`, without raw factor names."""
    d = F.lit(day).cast("date")
    at = risk.where(F.col("date") <= d).agg(F.max("date").alias("date"))
    return risk.where(~F.col("style").rlike(raw_name)).join(F.broadcast(at), "date")
