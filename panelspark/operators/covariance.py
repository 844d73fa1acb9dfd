"""Covariances of returns and long-only portfolios from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def returns_of(prices: DataFrame) -> DataFrame:
    """date, ticker, ret: return since the ticker's previous row, nothing filled; null prices give null."""
    w = Window.partitionBy("ticker").orderBy("date")
    return prices.select("date", "ticker", (F.try_divide("adj_close", F.lag("adj_close").over(w)) - 1).alias("ret")).where("ret is not null")


def pairs(returns: DataFrame) -> DataFrame:
    """date, ticker_a <= ticker_b, x, y: the returns of both on the dates that have both. Its size is that of
    the matrix for each date, so give it one universe of names."""
    a = returns.select("date", F.col("ticker").alias("ticker_a"), F.col("ret").alias("x"))
    b = returns.select("date", F.col("ticker").alias("ticker_b"), F.col("ret").alias("y"))
    return a.join(b, "date").where("ticker_a <= ticker_b")


def mirrored(half: DataFrame) -> DataFrame:
    other = half.where("ticker_a < ticker_b").select(F.col("ticker_b").alias("ticker_a"), F.col("ticker_a").alias("ticker_b"), "covariance")
    return half.select("ticker_a", "ticker_b", "covariance").unionAll(other)


def sample_covariance(returns: DataFrame) -> DataFrame:
    """ticker_a, ticker_b, covariance: pairwise complete sample covariance."""
    return mirrored(pairs(returns).groupBy("ticker_a", "ticker_b").agg(F.covar_samp("x", "y").alias("covariance")))


def ewma_covariance(returns: DataFrame, lam: float = 0.94) -> DataFrame:
    """ticker_a, ticker_b, covariance: exponentially weighted at the last date (weights lam^age over all
    dates of the calendar), bias-corrected, over the dates that have both."""
    age = returns.select("date").distinct().withColumn("_k", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)  # one row per date
    j = pairs(returns).join(F.broadcast(age), "date").withColumn("w", F.pow(F.lit(lam), "_k"))
    w, w2 = F.sum("w"), F.sum(F.col("w") * F.col("w"))
    mean: dict[str, Column] = {k: F.sum(F.col("w") * e) / w for k, e in (("x", F.col("x")), ("y", F.col("y")), ("xy", F.col("x") * F.col("y")))}
    return mirrored(j.groupBy("ticker_a", "ticker_b").agg(((mean["xy"] - mean["x"] * mean["y"]) * F.try_divide(w * w, w * w - w2)).alias("covariance")))


def shrunk_covariance(returns: DataFrame) -> DataFrame:
    """ticker_a, ticker_b, covariance: Ledoit-Wolf shrinkage towards the mean variance on the diagonal.
    Missing returns count as 0. All that is needed are the covariances and each date's sum of squares."""
    dates, names = returns.select("date").distinct(), returns.select("ticker").distinct()
    full = dates.crossJoin(F.broadcast(names)).join(returns, ["date", "ticker"], "left").select("date", "ticker", F.coalesce("ret", F.lit(0.0)).alias("ret"))  # the dense matrix is what is asked for
    centred = full.withColumn("ret", F.col("ret") - F.avg("ret").over(Window.partitionBy("ticker")))
    half = pairs(centred).groupBy("ticker_a", "ticker_b").agg(F.avg(F.col("x") * F.col("y")).alias("s"))
    twice = F.when(F.col("ticker_a") == F.col("ticker_b"), 1.0).otherwise(2.0)
    size = half.agg(F.sum(F.when(F.col("ticker_a") == F.col("ticker_b"), F.col("s"))).alias("trace"), F.sum(twice * F.col("s") * F.col("s")).alias("norm"), F.count_if(F.col("ticker_a") == F.col("ticker_b")).alias("p"))
    day = centred.groupBy("date").agg(F.sum(F.col("ret") * F.col("ret")).alias("q")).agg(F.sum(F.col("q") * F.col("q")).alias("fourth"), F.count("*").alias("n"))
    one = size.crossJoin(day)  # one row each
    mu = F.col("trace") / F.col("p")
    delta = F.col("norm") / F.col("p") - mu * mu
    beta = (F.col("fourth") / F.col("n") - F.col("norm")) / F.col("n") / F.col("p")
    one = one.select(mu.alias("mu"), F.coalesce(F.try_divide(F.least(F.greatest(beta, F.lit(0.0)), delta), delta), F.lit(0.0)).alias("shrinkage"))
    j = half.crossJoin(F.broadcast(one))
    return mirrored(j.withColumn("covariance", (1 - F.col("shrinkage")) * F.col("s") + F.when(F.col("ticker_a") == F.col("ticker_b"), F.col("shrinkage") * F.col("mu")).otherwise(0.0)))


def on_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with entries of at least 0 that sum to 1."""
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - c[np.flatnonzero(u > c)[-1]], 0)


def within(v: np.ndarray, w0: np.ndarray | None, delta: float) -> np.ndarray:
    """on_simplex(), moved towards w0 until the turnover (sum of changes) is at most delta."""
    w = on_simplex(v)
    if w0 is None or delta <= 0:
        return w
    turn = np.abs(w - w0).sum()
    return w if turn <= delta else w0 + (w - w0) * delta / turn


def solved(s: np.ndarray, method: str, r: np.ndarray | None = None, lamb: float = 0.0, alpha: float = 0.0, w0: np.ndarray | None = None, delta: float = 0.0, steps: int = 3000) -> np.ndarray:
    """Long-only weights that sum to 1: `inv` (inverse volatility), `gmv` (least variance), `mvo` (variance
    less lamb times the return, scaled to the mean volatility) or `rp` (equal risk contributions)."""
    n = len(s)
    sd = np.sqrt(np.maximum(np.diag(s), 1e-16))
    if method == "inv":
        return (1 / sd) / (1 / sd).sum()
    if method == "rp":  # the minimum of w'Sw / 2 - mean(log w), scaled; one coordinate at a time
        w = 1 / sd
        for _ in range(200):
            old = w.copy()
            for i in range(n):
                b = s[i] @ w - s[i, i] * w[i]
                w[i] = (-b + np.sqrt(b * b + 4 * s[i, i] / n)) / (2 * s[i, i]) if s[i, i] > 0 else w[i]
            if np.abs(w - old).max() < 1e-12 * np.abs(w).max():
                break
        return w / w.sum()
    q = s + alpha * np.eye(n)
    g = np.zeros(n)
    if method == "mvo" and r is not None:
        scale = sd.mean() / r.std() if r.std() > 1e-16 else 1.0
        g = lamb * r * scale
    w = w0 if w0 is not None else np.full(n, 1 / n)
    start = w0
    y, t, step = w.copy(), 1.0, 1 / max(np.linalg.eigvalsh(q)[-1], 1e-16) / 2
    for _ in range(steps):  # accelerated projected gradient
        new = within(y - step * (2 * q @ y - g), start, delta)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-13:
            return new
        w, t = new, t2
    return w


def optimal_weights(covariance: DataFrame, method: str = "gmv", expected: DataFrame | None = None, lamb: float = 0.0, alpha: float = 0.0, held: DataFrame | None = None, delta: float = 0.0) -> DataFrame:
    """ticker, weight for each problem (column `problem` of the covariance, one if there is none). A problem
    is one matrix, so its size is bounded by the universe; problems run side by side. Names whose
    covariance has gaps are left out; expected (problem?, ticker, expected) and held (ticker, weight) give 0
    where they have no row."""
    c = covariance if "problem" in covariance.columns else covariance.withColumn("problem", F.lit("all"))
    for extra, column, name in ((expected, "expected", "r"), (held, "weight", "w0")):
        if extra is not None:
            c = c.join(extra.select(F.col("ticker").alias("ticker_a"), F.col(column).alias(name)), "ticker_a", "left")

    def one(p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot(index="ticker_a", columns="ticker_b", values="covariance").astype(float)
        good = [n for n in m.index if n in m.columns and m.at[n, n] == m.at[n, n]]
        m = m.loc[good, good].fillna(0.0)
        side = lambda name: p.drop_duplicates("ticker_a").set_index("ticker_a")[name].reindex(m.index).fillna(0.0).to_numpy() if name in p else None
        w = solved(m.to_numpy(), method, side("r"), lamb, alpha, side("w0"), delta) if len(m) else np.zeros(0)
        return pd.DataFrame({"problem": p["problem"].iloc[0], "ticker": m.index, "weight": w})

    return c.groupBy("problem").applyInPandas(one, "problem string, ticker string, weight double")


def usable(weights: DataFrame, history: DataFrame, least: int = 30) -> DataFrame:
    """weights (date, ticker, weight) made to sum to 1 on each date; equal weights on dates with fewer than
    `least` earlier dates in history or whose weights are all 0 or missing."""
    dates = history.select("date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("date")) - 1)  # one row per date
    day = Window.partitionBy("date")
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    j = weights.join(F.broadcast(dates), "date", "left").withColumn("_w", w).withColumn("_t", F.sum("_w").over(day)).withColumn("_k", F.count("*").over(day))
    plain = (F.coalesce("_n", F.lit(0)) < least) | (F.col("_t") <= 0)
    return j.select("date", "ticker", F.when(plain, F.lit(1.0) / F.col("_k")).otherwise(F.try_divide("_w", "_t")).alias("weight"))


def weight_diagnostics(weights: DataFrame) -> DataFrame:
    """date, names, largest, effective: names held, the largest weight, and one over the sum of squares."""
    return weights.groupBy("date").agg(F.count_if(F.col("weight") > 0).alias("names"), F.max("weight").alias("largest"), F.try_divide(F.lit(1.0), F.sum(F.col("weight") * F.col("weight"))).alias("effective"))


def weights_for_newest(scores: DataFrame, held: DataFrame, k: int, drop: int, strategy: str = "daily") -> DataFrame:
    """date, ticker, weight: top-k with dropout on the newest date of the scores, from the previous holdings
    (ticker). The date has one row a name, and the step sees the 2k + drop best and the held ones only."""
    from .sequential import dropout_step

    last = scores.where("prediction is not null").groupBy("ticker").agg(F.max_by("prediction", "date").alias("prediction"), F.max("date").alias("date"))
    newest = last.agg(F.max("date").alias("date"))
    now = last.join(F.broadcast(newest), "date")
    own = held.select("ticker").distinct().withColumn("held", F.lit(True))
    ranked = now.join(own, "ticker", "left").withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("prediction"), "ticker")))
    few = ranked.where((F.col("_r") <= 2 * k + drop) | F.col("held"))  # nothing else can be chosen

    def step(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_r")
        best = dropout_step(sorted(p[p["held"] == True]["ticker"]), p["ticker"].tolist(), k, drop)  # noqa: E712
        return pd.DataFrame({"date": p["date"].iloc[0], "ticker": best, "weight": 1.0 / max(1, len(best))})

    return few.groupBy("date").applyInPandas(step, "date date, ticker string, weight double")
