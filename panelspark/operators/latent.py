"""Factor analysis of each date's section by expectation maximisation on its moment matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns whose spread is at most this are left out of a date; smallest uniqueness.
FLAT, LEAST = 1e-12, 1e-6


def standardized(wide: DataFrame, columns: list[str]) -> DataFrame:
    """date, ticker and the columns with gaps filled by the date's median, then centred and divided by the date's
    population spread; null where the column has no value or no spread on that date."""
    day = Window.partitionBy("date")
    filled = wide.select("date", "ticker", *(F.coalesce(F.col(c), F.median(c).over(day)).alias(c) for c in columns))
    return filled.select("date", "ticker", *(F.when(F.stddev_pop(c).over(day) > FLAT, (F.col(c) - F.avg(c).over(day)) / F.stddev_pop(c).over(day)).alias(c) for c in columns))


def moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """date, n, a <= b (column numbers), product: the mean product of each two columns over a date's rows.

    Each task multiplies its rows of a date as one matrix; what leaves it are the sums, one row a pair and
    date, and the final sums are a grouped aggregate. rows lie together by date first, so that a date gives one
    matrix and not one for each task. A null counts as 0; columns that are null on a date have product 0.
    """
    at = np.triu_indices(len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.to_pandas()
            for date, own in p.groupby("date"):
                x = np.nan_to_num(own[columns].to_numpy(np.float64))
                size = len(at[0])
                yield pa.RecordBatch.from_arrays([pa.array([date] * size, pa.date32()), pa.array([len(x)] * size, pa.int64()), pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array((x.T @ x)[at])], names=["date", "n", "a", "b", "product"])

    near = rows.select("date", *columns).repartition("date").sortWithinPartitions("date")
    sums = near.mapInArrow(run, "date date, n long, a int, b int, product double").groupBy("date", "a", "b").agg(F.sum("n").alias("n"), F.sum("product").alias("product"))
    return sums.select("date", "n", "a", "b", F.try_divide("product", "n").alias("product"))


def fitted(s: np.ndarray, k: int, steps: int = 1000, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Loadings (p x k), uniquenesses and the log likelihood of each step, a row's mean, for the moment
    matrix s: expectation maximisation from the principal components.

    Loadings are turned so that L' diag(1/u) L is diagonal with falling values, the largest entry of each
    column positive; steps end when the likelihood rises by less than tol.
    """
    p = len(s)
    values, vectors = np.linalg.eigh(s)
    rest = values[: p - k].mean() if p > k else 0.0
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k] - rest, LEAST))
    u = np.maximum(np.diag(s) - (load * load).sum(1), LEAST)
    trail: list[float] = []
    for _ in range(steps):
        # the model's matrix is L L' + diag(u); its inverse needs a k x k one alone
        scaled = load / u[:, None]
        inner = np.linalg.inv(np.eye(k) + load.T @ scaled)
        beta = inner @ scaled.T  # k x p: expected factors of a row are beta x
        inverse = np.diag(1 / u) - scaled @ inner @ scaled.T
        log_det = np.log(u).sum() - np.linalg.slogdet(inner)[1]
        trail.append(float(-0.5 * (p * np.log(2 * np.pi) + log_det + (inverse * s).sum())))
        if len(trail) > 1 and trail[-1] - trail[-2] < tol:
            break
        cross = s @ beta.T
        load = cross @ np.linalg.inv(np.eye(k) - beta @ load + beta @ cross)
        u = np.maximum(np.diag(s) - (load * cross).sum(1), LEAST)
    _, turn = np.linalg.eigh(load.T @ (load / u[:, None]))
    load = load @ turn[:, ::-1]
    return load * np.where(np.take_along_axis(load, np.abs(load).argmax(0)[None, :], 0) < 0, -1.0, 1.0), u, trail


def factor_analysis(moment: DataFrame, columns: list[str], k: int, steps: int = 1000, tol: float = 1e-8) -> DataFrame:
    """date, factor, uniqueness, loadings, scoring (arrays by component), steps, log_likelihood of each date with
    at least k varied columns, from moments(): min(k, columns, rows - 1) components. A row's expected
    component j is the sum of its standardised values times scoring[j].

    A date's task holds one matrix of the columns; dates run side by side.
    """

    def one(p: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((len(columns), len(columns)))
        full[p["a"], p["b"]] = full[p["b"], p["a"]] = p["product"]
        own = np.flatnonzero(np.diag(full) > FLAT)
        m = min(k, len(own), int(p["n"].iloc[0]) - 1)
        if len(own) < k or m < 1:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("date", "factor", "uniqueness", "loadings", "scoring", "steps", "log_likelihood")})
        load, u, trail = fitted(full[np.ix_(own, own)], m, steps, tol)
        scaled = load / u[:, None]
        beta = np.linalg.solve(np.eye(m) + load.T @ scaled, scaled.T)
        return pd.DataFrame({"date": p["date"].iloc[0], "factor": [columns[i] for i in own], "uniqueness": u, "loadings": list(load), "scoring": list(beta.T), "steps": len(trail), "log_likelihood": trail[-1]})

    return moment.groupBy("date").applyInPandas(one, "date date, factor string, uniqueness double, loadings array<double>, scoring array<double>, steps int, log_likelihood double")


def component_scores(rows: DataFrame, columns: list[str], fit: DataFrame) -> DataFrame:
    """date, ticker, component (from 1), value: the expected components of standardised rows, by a join of the
    long rows with the fit's scoring weights and one sum."""
    pairs = F.array(*(F.struct(F.lit(c).alias("factor"), F.col(c).alias("value")) for c in columns))
    long = rows.select("date", "ticker", F.explode(pairs).alias("x")).select("date", "ticker", "x.factor", "x.value").where("value is not null")
    weights = fit.select("date", "factor", F.posexplode("scoring").alias("component", "weight"))
    product: Column = F.sum(F.col("value") * F.col("weight"))
    return long.join(weights, ["date", "factor"]).groupBy("date", "ticker", (F.col("component") + 1).alias("component")).agg(product.alias("value"))
