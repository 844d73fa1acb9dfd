"""Style scores by a stored structure: normalise, first components of buckets, orthogonal styles.

The structure is a table of one row a feature, fitted on the sections of a few reference dates and applied
to any date by a join and sums. `path` says how a bucket's score comes about: `component` (first principal component),
`under_share` (component that explains too little: the fit would take the mean, later dates take the component all the
same), `mean` (the mean instead of such a component) or `single` (its one feature).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import winsorize, zscore
from .risk import BUCKETS, classify

#: A factor with a smaller spread on a date has no value on it.
FLAT = 1e-8


def normalised(long: DataFrame, cut: float = 0.025) -> DataFrame:
    """date, ticker, factor, value: cut at the date's quantiles `cut` and 1 - cut, then standard scores with the
    sample spread; null where the factor has no spread on the date."""
    sd = F.stddev_samp("value").over(Window.partitionBy("date", "factor"))
    varied = long.select("date", "ticker", "factor", F.when(sd >= FLAT, F.col("value")).alias("value"))
    return zscore(winsorize(varied, cut, 1 - cut), sample=True)


def fitted_structure(norm: DataFrame, buckets: DataFrame, reference: str, order: list[str] | None = None, days: int = 1, least_share: float = 0.5) -> DataFrame:
    """bucket, ord, factor, mean, loading, share, features, path: each bucket's first component over the complete rows
    of the last `days` dates up to the reference date. A factor may be in several buckets (factor, bucket); buckets follow
    `order` (the given taxonomy), others come after them by name. Factors without a value in these rows are left
    out. Products are summed by Spark; a task solves one small matrix a bucket."""
    last = norm.where(F.col("date") <= F.lit(reference).cast("date")).select("date").distinct().orderBy(F.desc("date")).limit(days)
    own = norm.join(F.broadcast(last), "date", "left_semi").where("value is not null").join(F.broadcast(buckets.select("factor", "bucket").distinct()), "factor")  # at most `days` rows; a row a factor and bucket
    rows = own.groupBy("date", "ticker", "bucket").agg(F.sort_array(F.collect_list(F.struct("factor", "value"))).alias("x"))  # a row's factors of a bucket
    rows = rows.join(own.groupBy("bucket").agg(F.countDistinct("factor").alias("features")), "bucket").where(F.size("x") == F.col("features"))
    a = rows.withColumn("a", F.explode("x")).withColumn("b", F.explode("x")).where("a.factor <= b.factor")
    sums = a.groupBy("bucket", F.col("a.factor").alias("a"), F.col("b.factor").alias("b")).agg(F.count("*").alias("n"), F.sum(F.col("a.value") * F.col("b.value")).alias("ab"), F.sum("a.value").alias("sa"), F.sum("b.value").alias("sb"))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(p["a"]))
        at = {c: i for i, c in enumerate(names)}
        n = float(p["n"].iloc[0])
        mean, cov = np.zeros(len(names)), np.zeros((len(names), len(names)))
        for r in p.itertuples(index=False):
            i, j = at[r.a], at[r.b]
            cov[i, j] = cov[j, i] = r.ab / n - r.sa / n * r.sb / n
            mean[i], mean[j] = r.sa / n, r.sb / n
        values, vectors = np.linalg.eigh(cov)
        v = vectors[:, -1]
        v = v * (np.sign(v[np.flatnonzero(np.abs(v) > np.abs(v).max() - 1e-9)[0]]) or 1)  # the first of the largest is positive
        share = float(values[-1] / values.sum()) if values.sum() > 0 else 0.0
        if len(names) == 1:
            mean, v, share = np.zeros(1), np.ones(1), 1.0
        path = "single" if len(names) == 1 else "component" if share >= least_share else "under_share"
        return pd.DataFrame({"bucket": p["bucket"].iloc[0], "factor": names, "mean": mean, "loading": v, "share": share, "features": len(names), "path": path})

    got = sums.groupBy("bucket").applyInPandas(solve, "bucket string, factor string, mean double, loading double, share double, features long, path string")
    known = list(BUCKETS) if order is None else order
    at = F.array_position(F.lit(known), F.col("bucket"))
    place = F.dense_rank().over(Window.orderBy(F.when(at > 0, at).asc_nulls_last(), "bucket")) - 1  # a row a factor
    return got.select("bucket", place.cast("int").alias("ord"), "factor", "mean", "loading", "share", "features", "path")


def applied(norm: DataFrame, structure: DataFrame, compat: bool = True, keep_singletons: bool = False) -> DataFrame:
    """date, ticker, style, ord, score, path: scores of normalised rows (long) by the structure, for the rows that have all
    features of a bucket; a bucket one of whose features has no value on a date has no score on it.

    compat: as stored components are applied, also those that explain too little, and buckets of one feature have no
    component and vanish. Otherwise such components give way to the mean; keep_singletons keeps the others.
    """
    kept = structure if keep_singletons else structure.where("path <> 'single'")
    j = norm.where("value is not null").join(F.broadcast(kept), "factor")  # a row a factor
    s = j.groupBy("date", "ticker", "bucket").agg(F.sum(F.col("loading") * (F.col("value") - F.col("mean"))).alias("component"), F.avg("value").alias("mean"), F.count("*").alias("n"), F.first("features").alias("features"), F.first("path").alias("path"), F.first("ord").alias("ord"))
    by_mean = (F.col("path") == "under_share") & F.lit(not compat)
    own = s.where("n = features")
    return own.select("date", "ticker", F.col("bucket").alias("style"), "ord", F.when(by_mean, F.col("mean")).otherwise(F.col("component")).alias("score"), F.when(by_mean, "mean").otherwise(F.col("path")).alias("path"))


def orthogonal_styles(scores: DataFrame) -> DataFrame:
    """scores with `score` made orthogonal on each date, in the order of ord, and of length 1: each style less what the
    styles before it explain, over the rows that have all styles of the date. A style that nothing is left of
    stays as the rest it is. A date's task holds its names times styles."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        x = p.pivot_table(index="ticker", columns="ord", values="score", aggfunc="first").sort_index(axis=1).dropna()
        a = x.to_numpy(np.float64).copy()
        for j in range(a.shape[1]):
            for _ in range(2):  # twice is enough
                for i in range(j):
                    if (n := a[:, i] @ a[:, i]) > 1e-20:
                        a[:, j] -= (a[:, i] @ a[:, j]) / n * a[:, i]
            if (n := np.linalg.norm(a[:, j])) > 1e-10:
                a[:, j] /= n
        long = pd.DataFrame(a, x.index, x.columns).stack().rename("score").reset_index() if len(x) else pd.DataFrame({"ticker": [], "ord": [], "score": []})
        return p.drop(columns="score").merge(long, on=["ticker", "ord"])[["date", "ticker", "style", "ord", "score", "path"]]

    return scores.groupBy("date").applyInPandas(one, "date date, ticker string, style string, ord int, score double, path string")


def chain(long: DataFrame, structure: DataFrame | None = None, reference: str | None = None, buckets: DataFrame | None = None, order: list[str] | None = None, compat: bool = True, keep_singletons: bool = False) -> DataFrame:
    """date, ticker, style, ord, score, path of raw factors (date, ticker, factor, value): classified by name (or by `buckets`),
    normalised, scored by the structure (fitted on the reference date if none is given) and made orthogonal."""
    norm = normalised(long)
    if structure is None:
        if reference is None:
            raise ValueError("give a structure or a reference date")
        own = classify(long.select("factor").distinct(), "all") if buckets is None else buckets
        structure = fitted_structure(norm, own, reference, order)
    return orthogonal_styles(applied(norm, structure, compat, keep_singletons))
