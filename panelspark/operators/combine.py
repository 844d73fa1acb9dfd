"""Choosing, comparing, combining and reducing factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .diagnostics import average_rank


def by_icir(summary: DataFrame, least: float | None = None, names: list[str] | None = None) -> DataFrame:
    """factor: those with |ICIR| of at least `least`, or those of an explicit list that the table has."""
    kept = summary if least is None else summary.where(F.abs("icir") >= least)
    return (kept if names is None else kept.where(F.col("factor").isin(names))).select("factor")


def quality(summary: DataFrame, min_ic: float = 0.0, min_icir: float = 0.0, min_win_rate: float = 0.0) -> DataFrame:
    """factor, ic_mean, icir (sample spread), win_rate, kept."""
    icir = F.coalesce(F.try_divide("ic_mean", "ic_std_sample"), F.lit(0.0))
    kept = (F.abs("ic_mean") >= min_ic) & (F.abs(icir) >= min_icir) & (F.col("win_rate") >= min_win_rate)
    return summary.select("factor", "ic_mean", icir.alias("icir"), "win_rate", kept.alias("kept"))


def combination_weights(stats: DataFrame, method: str = "ic_weighted") -> DataFrame:
    """factor, weight: by |mean IC|, by |ICIR| or equal, summing to 1; equal where all are 0."""
    size = {"ic_weighted": F.abs("ic_mean"), "icir_weighted": F.abs("icir"), "equal_weight": F.lit(1.0)}[method]
    all_ = Window.partitionBy()  # one row per factor
    x = stats.select("factor", F.coalesce(size, F.lit(0.0)).alias("_s")).withColumn("_t", F.sum("_s").over(all_))
    return x.select("factor", F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(F.lit(1.0) / F.count("*").over(all_)).alias("weight"))


def combined(long: DataFrame, weights: DataFrame) -> DataFrame:
    """date, ticker, combined: the weighted sum of a row's factors; null where one of them is null."""
    j = long.join(weights, "factor")
    total = F.sum(F.col("value") * F.col("weight"))
    return j.groupBy("date", "ticker").agg(F.when(F.count("value") == F.count("*"), total).alias("combined"))


def information_kept(before: DataFrame, after: DataFrame, least: int = 100) -> DataFrame:
    """factor, pearson, spearman, std_ratio, samples of processed values against the raw ones over all rows
    that have both; zeros with fewer than `least` rows."""
    j = before.join(after.withColumnRenamed("value", "after"), ["date", "ticker", "factor"]).where("value is not null and after is not null")
    j = j.withColumn("x", average_rank(F.col("value"), ["factor"])).withColumn("y", average_rank(F.col("after"), ["factor"]))
    corr = lambda a, b: F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    s = j.groupBy("factor").agg(corr("value", "after").alias("pearson"), corr("x", "y").alias("spearman"), F.try_divide(F.stddev_samp("after"), F.stddev_samp("value")).alias("std_ratio"), F.count("*").alias("samples"))
    ok = F.col("samples") >= least
    return s.select("factor", *(F.when(ok, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in ("pearson", "spearman", "std_ratio")), "samples")


def compared_processing(long: DataFrame, methods: dict, least: int = 100) -> DataFrame:
    """information_kept of several ways (name to function of the long table) to process one table."""
    out = None
    for name, f in methods.items():
        one = information_kept(long, f(long).select("date", "ticker", "factor", "value"), least).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def ic_order(summary: DataFrame) -> list[str]:
    """Factor names by falling |mean IC|: a few hundred at most."""
    return [r.factor for r in summary.select("factor", "ic_mean").orderBy(F.abs("ic_mean").desc_nulls_last(), "factor").collect()]


def principal_components(wide: DataFrame, factors: list[str], share: float = 0.95, most: int | None = None) -> DataFrame:
    """date, ticker, component, value: each date's rows by its principal components (medians for nulls,
    columns standardised with the population spread), as many as reach `share` of the variance, or `most`.
    The largest loading of a component is positive."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        x = p[factors].to_numpy(np.float64)
        x = np.where(np.isnan(x), np.nan_to_num(pd.DataFrame(x).median().to_numpy()), x)
        sd = x.std(0)
        x = (x - x.mean(0)) / np.where(sd > 1e-12, sd, 1)
        values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(x, rowvar=False))) if len(x) > 1 else (np.zeros(len(factors)), np.eye(len(factors)))
        values, vectors = values[::-1], vectors[:, ::-1]
        vectors = vectors * np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None, :], 0))
        total = values.sum()
        k = most or (int(np.searchsorted(np.cumsum(values) / total, share - 1e-12)) + 1 if total > 0 else 1)
        k = min(k, len(factors))
        z = x @ vectors[:, :k]
        return pd.DataFrame({"date": np.repeat(p["date"].to_numpy(), k), "ticker": np.repeat(p["ticker"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1), len(p)), "value": z.ravel()})

    return wide.select("date", "ticker", *factors).groupBy("date").applyInPandas(one, "date date, ticker string, component int, value double")
