"""Covariances of a moving window at every rebalance date, and the weights of all these dates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .covariance import optimal_weights

#: Names in a block; a task multiplies two blocks of returns.
BLOCK = 64
#: Rows after which running sums are taken anew, so that rounding errors don't pile up.
FRESH = 1000


def calendar(returns: DataFrame) -> DataFrame:
    """date, i: the dates of the returns in order, from 0."""
    return returns.select("date").distinct().withColumn("i", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))  # one row a date


def blocks(returns: DataFrame, size: int) -> DataFrame:
    """ticker, block, slot: the names in order, in blocks of `size`."""
    k = F.row_number().over(Window.orderBy("ticker")) - 1  # one row a name of the universe
    return returns.select("ticker").distinct().withColumn("k", k).select("ticker", F.floor(F.col("k") / size).cast("int").alias("block"), (F.col("k") % size).cast("int").alias("slot"))


def running(x: np.ndarray, y: np.ndarray, window: int, lam: float) -> Iterator[tuple[np.ndarray, ...]]:
    """After each row: for all pairs of a column of x and one of y, over those of the last `window` rows that have both,
    their number, the sums of the weights, of the squared weights, of x, of y and of x y. A row's weight is
    lam^age. Sums are kept: a row adds its outer product and the row that leaves takes its own away."""
    a, b = ~np.isnan(x), ~np.isnan(y)
    x, y, a, b = np.where(a, x, 0.0), np.where(b, y, 0.0), a.astype(float), b.astype(float)
    parts = [(a, b, 1.0), (a, b, lam), (a, b, lam * lam), (x, b, lam), (a, y, lam), (x, y, lam)]
    for i in range(len(x)):
        if i % FRESH == 0:
            rows = np.arange(max(0, i + 1 - window), i + 1)
            sums = [(u[rows].T * f ** (i - rows)) @ v[rows] for u, v, f in parts]
        else:
            out = i - window
            for k, (u, v, f) in enumerate(parts):
                sums[k] = f * sums[k] + np.outer(u[i], v[i])
                if out >= 0:
                    sums[k] -= f**window * np.outer(u[out], v[out])
        yield tuple(sums)


def rolling_covariance(returns: DataFrame, dates: DataFrame, window: int = 60, least: int = 2, lam: float = 1.0, size: int = BLOCK) -> DataFrame:
    """date, ticker_a, ticker_b, covariance (both orders): the covariance of the `window` dates up to each of `dates`
    (dates of returns: date, ticker, ret), pairwise complete, for pairs with at least `least` common dates in
    it (two at least); with lam below 1 weighted by lam^age. Both are corrected for bias.

    Names are cut into blocks of `size`; a task has the returns of two blocks and goes along the dates once, so that a
    date costs one outer product whatever the window. Returns are sent once for each block of names, not for each
    name. The result has a row a rebalance date and pair, as its matrices do; give it one universe of names.
    """
    cal, place = F.broadcast(calendar(returns)), blocks(returns, size)
    asked = cal.join(dates.select("date").distinct(), "date", "left_semi")
    ends = {r.i: r.date for r in asked.collect()}  # a row a date
    n = place.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    known = returns.where("ret is not null").join(cal, "date").join(place, "ticker")
    met = known.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = met.select(F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), (F.col("block") > F.col("o")).alias("right"), "ticker", "slot", "i", "ret")

    def dense(p: pd.DataFrame, days: int) -> tuple[np.ndarray, np.ndarray]:
        own = p.drop_duplicates("slot").sort_values("slot")
        column = np.zeros(size, int)
        column[own["slot"]] = np.arange(len(own))
        out = np.full((days, len(own)), np.nan)
        out[p["i"], column[p["slot"]]] = p["ret"]
        return out, own["ticker"].to_numpy(object)

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        days = 1 + max(ends, default=-1)
        p = p[p["i"] < days]
        x, names_a = dense(p[~p["right"]], days)
        y, names_b = dense(p[p["right"]], days) if key[0] < key[1] else (x, names_a)
        found = []
        for i, (count, w, w2, sx, sy, sxy) in enumerate(running(x, y, window, lam)):
            if i in ends:
                u, v = np.nonzero(count > max(2, least) - 0.5)
                w, w2, sx, sy, sxy = (m[u, v] for m in (w, w2, sx, sy, sxy))
                c = (sxy / w - sx / w * sy / w) * w * w / (w * w - w2)
                found.append(pd.DataFrame({"date": ends[i], "ticker_a": names_a[u], "ticker_b": names_b[v], "covariance": c}))
        out = pd.concat(found) if found else pd.DataFrame({"date": [], "ticker_a": [], "ticker_b": [], "covariance": []}).astype(object)
        return out if key[0] == key[1] else pd.concat([out, out.rename(columns={"ticker_a": "ticker_b", "ticker_b": "ticker_a"})])

    return met.groupBy("a", "b").applyInPandas(run, "date date, ticker_a string, ticker_b string, covariance double")


def weights_by_date(scores: DataFrame, returns: DataFrame, method: str = "inv", window: int = 60, least: int = 30, lam: float = 1.0, lamb: float = 0.0, alpha: float = 0.0) -> DataFrame:
    """date, ticker, weight of every name scored on a date (date, ticker, prediction): long-only optimal weights by the
    covariance of the `window` dates up to it, equal ones on dates with fewer than `least` dates of returns so
    far or where no scored name has a variance. A date is a problem of its own and dates run side by
    side; names without a variance get 0. The scores are the expected returns of method `mvo`."""
    known = scores.where("prediction is not null").select("date", "ticker", "prediction")
    late = F.broadcast(calendar(returns).where(F.col("i") >= least - 1).select("date"))
    cov = rolling_covariance(returns, known.join(late, "date", "left_semi"), window, 2, lam)
    a = known.select("date", F.col("ticker").alias("ticker_a"), F.col("prediction").alias("r"))
    b = known.select("date", F.col("ticker").alias("ticker_b"))
    own = cov.join(a, ["date", "ticker_a"]).join(b, ["date", "ticker_b"]).withColumn("problem", F.col("date").cast("string"))
    solved = optimal_weights(own, method, lamb=lamb, alpha=alpha).select(F.col("problem").cast("date").alias("date"), "ticker", F.col("weight").alias("w"))
    day = Window.partitionBy("date")
    j = known.join(solved, ["date", "ticker"], "left").withColumn("t", F.sum("w").over(day))
    w = F.when(F.col("t") > 0, F.coalesce("w", F.lit(0.0)) / F.col("t")).otherwise(F.lit(1.0) / F.count("*").over(day))
    return j.select("date", "ticker", w.alias("weight"))


def saved_wide(weights: DataFrame, path: str) -> None:
    """The weights as one row a date and one column a name, 0 where a name has none, as Parquet."""
    names = [r.ticker for r in weights.select("ticker").distinct().orderBy("ticker").collect()]  # a name a column
    weights.groupBy("date").pivot("ticker", names).agg(F.sum("weight")).fillna(0.0).write.mode("overwrite").parquet(path)
