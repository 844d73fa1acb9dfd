"""Style risk model: buckets, principal components, factor returns, covariance and risk shares.

Grouped Arrow tasks hold one date's section at most; all else is joins and sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Style buckets and the parts of factor names that decide them, in order.
BUCKETS = {
    "Price/Level": ("VWAP", "AVGPRICE", "MEDPRICE", "TYPPRICE", "WCLPRICE", "BB_UPPER", "BB_MIDDLE", "BB_LOWER"),
    "Trend": ("SMA_", "EMA_", "WMA_", "DEMA_", "TRIMA_", "TEMA_", "MACD", "MACD_SIGNAL", "MACD_HIST"),
    "Momentum": ("MOM_", "ROC_", "RSI_", "STOCH", "WILLR_", "CCI_", "AROON", "ADX_", "DX_", "PLUS_DI_", "MINUS_DI_", "ADXR_", "APO", "ULTOSC"),
    "Volatility": ("ATR_", "NATR_", "TRANGE", "STDDEV_", "BB_WIDTH"),
    "Liquidity": ("OBV", "AD", "ADOSC", "MFI_"),
    "Quality/Stability": ("BOP",),
    "Custom": ("CUSTOM_RS", "CUSTOM_LAR", "CUSTOM_PMS", "CUSTOM_VAR", "CUSTOM_PPF"),
}


def classify(names: DataFrame, mode: str = "first") -> DataFrame:
    """factor and bucket by parts of the name: the first bucket that matches (`Unclassified` if none), or all."""
    rows = [(k, i, p) for i, (k, ps) in enumerate(BUCKETS.items()) for p in ps]
    patterns = F.broadcast(names.sparkSession.createDataFrame(rows, "bucket string, ord int, pattern string"))  # a short fixed list
    hit = names.select("factor").distinct().join(patterns, F.col("factor").contains(F.col("pattern")), "left")
    if mode == "all":
        return hit.where("bucket is not null").select("factor", "bucket").distinct()
    return hit.groupBy("factor").agg(F.coalesce(F.min_by("bucket", "ord"), F.lit("Unclassified")).alias("bucket"))


def first_component(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, loading (largest entry positive) and explained share of the first principal component."""
    mean = x.mean(0)
    values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(x - mean, rowvar=False)))
    v = vectors[:, -1]
    return mean, v * np.sign(v[np.abs(v).argmax()] or 1), float(values[-1] / values.sum()) if values.sum() > 0 else 0.0


def bucket_scores(wide: DataFrame, buckets: dict[str, list[str]], least_share: float = 0.5) -> DataFrame:
    """date, ticker, bucket, score, explained: each date's first component of each bucket over its complete
    rows; one column passes through, and a component under the least share gives way to the mean."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, cols in buckets.items():
            x = p[cols].dropna()
            x = x.loc[:, x.std() > 1e-12] if len(x) > 1 else x
            if len(x) < 2 or not x.shape[1]:
                continue
            if x.shape[1] == 1:
                s, share = x.iloc[:, 0].to_numpy(), 1.0
            else:
                mean, v, share = first_component(x.to_numpy())
                s = (x.to_numpy() - mean) @ v if share >= least_share else x.mean(axis=1).to_numpy()
            out.append(pd.DataFrame({"date": p["date"].iloc[0], "ticker": p.loc[x.index, "ticker"], "bucket": name, "score": s, "explained": share}))
        none = pd.DataFrame({"date": pd.Series(dtype="object"), "ticker": pd.Series(dtype="object"), "bucket": pd.Series(dtype="object"), "score": pd.Series(dtype="float64"), "explained": pd.Series(dtype="float64")})
        return pd.concat(out) if out else none

    return wide.groupBy("date").applyInPandas(one, "date date, ticker string, bucket string, score double, explained double")


def orthogonal(wide: DataFrame, columns: list[str], unit: bool = True) -> DataFrame:
    """Gram-Schmidt of the columns in the given order within each date, over complete rows (others null)."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        x = p[columns].to_numpy(np.float64)
        ok = ~np.isnan(x).any(1)
        y = np.full_like(x, np.nan)
        if ok.sum() >= 2:
            a = x[ok]
            for j in range(a.shape[1]):
                for _ in range(2):  # twice is enough
                    for i in range(j):
                        n = a[:, i] @ a[:, i]
                        if n > 1e-20:
                            a[:, j] = a[:, j] - (a[:, i] @ a[:, j]) / n * a[:, i]
                n = np.linalg.norm(a[:, j])
                if unit and n > 1e-10:
                    a[:, j] = a[:, j] / n
            y[ok] = a
        return pd.DataFrame({"date": p["date"], "ticker": p["ticker"], **{c: y[:, k] for k, c in enumerate(columns)}})

    return wide.select("date", "ticker", *columns).groupBy("date").applyInPandas(one, "date date, ticker string, " + ", ".join(f"{c} double" for c in columns))


def factor_returns(wide: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """date, style, factor_return: each date's least-squares fit of the next return on the exposures with
    intercept. The sums of the normal equations are aggregated; one small solve per date follows."""
    j = wide.join(labels, ["date", "ticker"]).dropna(subset=["label", *columns])
    terms = [F.lit(1.0), *(F.col(c) for c in columns)]
    k = len(terms)
    aggs = [F.sum(terms[a] * terms[b]).alias(f"x{a}_{b}") for a in range(k) for b in range(a, k)] + [F.sum(terms[a] * F.col("label")).alias(f"y{a}") for a in range(k)]
    sums = j.groupBy("date").agg(F.count("*").alias("n"), *aggs).where(F.col("n") > k)

    def solve(batches):
        for p in batches:
            rows = []
            for t in p.itertuples(index=False):
                m = np.zeros((k, k))
                for a in range(k):
                    for b in range(a, k):
                        m[a, b] = m[b, a] = getattr(t, f"x{a}_{b}")
                f = np.linalg.lstsq(m, np.array([getattr(t, f"y{a}") for a in range(k)]), rcond=None)[0]
                rows += [(t.date, c, float(f[i + 1])) for i, c in enumerate(columns)]
            yield pd.DataFrame(rows, columns=["date", "style", "factor_return"])

    return sums.mapInPandas(solve, "date date, style string, factor_return double")


def ewma_covariance(returns: DataFrame, lam: float = 0.94, adjust: bool = False) -> DataFrame:
    """style_a, style_b, covariance at the last date, bias-corrected. Weights lam^age; without adjustment
    all but the oldest are scaled by 1 - lam."""
    d = returns.select("date").distinct()
    age = d.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("date"))) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    w = F.pow(F.lit(lam), F.col("_k")) * (F.lit(1.0) if adjust else F.when(F.col("_k") == F.col("_n") - 1, 1.0).otherwise(1 - lam))
    x = returns.join(F.broadcast(age.select("date", w.alias("w"))), "date")  # a row for each date
    a, b = x.select("date", "w", F.col("style").alias("style_a"), F.col("factor_return").alias("x")), x.select("date", F.col("style").alias("style_b"), F.col("factor_return").alias("y"))
    s = a.join(b, "date").groupBy("style_a", "style_b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"), *(F.sum(F.col("w") * e).alias(n) for n, e in (("x", F.col("x")), ("y", F.col("y")), ("xy", F.col("x") * F.col("y")))))
    cov = (F.col("xy") / F.col("w") - F.col("x") / F.col("w") * F.col("y") / F.col("w")) * F.try_divide(F.col("w") * F.col("w"), F.col("w") * F.col("w") - F.col("w2"))
    return s.select("style_a", "style_b", cov.alias("covariance"))


def previous_covariance(returns: DataFrame, method: str = "ewma", lam: float = 0.94, window: int = 252, least: int = 2) -> DataFrame:
    """date, style_a, style_b, covariance of each date from the `window` dates before it (the date itself
    not), EWMA as ewma_covariance() or sample; dates with fewer than `least` earlier ones have no row. Styles
    are some ten, so a date meets `window` small matrices."""
    cal = returns.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))  # one row per date
    x = returns.join(F.broadcast(cal), "date")
    prod = x.select("_i", F.col("style").alias("style_a"), F.col("factor_return").alias("x")).join(x.select("_i", F.col("style").alias("style_b"), F.col("factor_return").alias("y")), "_i")
    ahead = prod.withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + window)))
    ages = ahead.withColumn("_k", F.col("_j") - F.col("_i") - 1).withColumn("_n", F.least(F.col("_j") - 1, F.lit(window)))
    w = F.lit(1.0) if method == "sample" else F.pow(F.lit(lam), F.col("_k")) * F.when(F.col("_k") == F.col("_n") - 1, 1.0).otherwise(1 - lam)
    g = ages.withColumn("w", w).groupBy("_j", "style_a", "style_b").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"), *(F.sum(F.col("w") * e).alias(c) for c, e in (("x", F.col("x")), ("y", F.col("y")), ("xy", F.col("x") * F.col("y")))))
    cov = (F.col("xy") / F.col("w") - F.col("x") / F.col("w") * F.col("y") / F.col("w")) * F.try_divide(F.col("w") * F.col("w"), F.col("w") * F.col("w") - F.col("w2"))
    return g.where(F.col("n") >= least).join(F.broadcast(cal), F.col("_j") == F.col("_i")).select("date", "style_a", "style_b", cov.alias("covariance"))


def residuals(wide: DataFrame, labels: DataFrame, returns: DataFrame, columns: list[str]) -> DataFrame:
    """date, ticker, residual: the next return less what the date's factor returns explain of it (without
    intercept), for the rows that have all."""
    own = returns.groupBy("date").pivot("style", columns).agg(F.first("factor_return"))
    j = wide.join(labels, ["date", "ticker"]).join(own.select("date", *(F.col(c).alias(f"_f{k}") for k, c in enumerate(columns))), "date").dropna(subset=["label", *columns])
    return j.select("date", "ticker", (F.col("label") - sum((F.col(c) * F.col(f"_f{k}") for k, c in enumerate(columns)), F.lit(0.0))).alias("residual"))


def specific_risk(resid: DataFrame, weights: DataFrame) -> DataFrame:
    """date, specific_sd (spread of the date's residuals) and specific_variance, the sum of squared weight
    times squared residual over held names."""
    sd = resid.groupBy("date").agg(F.stddev_samp("residual").alias("specific_sd"))
    own = resid.join(weights, ["date", "ticker"]).groupBy("date").agg(F.sum(F.col("weight") * F.col("weight") * F.col("residual") * F.col("residual")).alias("specific_variance"))
    return sd.join(own, "date")


def decomposition(exposure: DataFrame, covariance: DataFrame, specific: DataFrame, off: float = 0.001) -> DataFrame:
    """date, style, contribution in percent of b'Cb + specific variance by each date's covariance; the
    specific part is the style `Specific`. Contributions may be negative; dates whose parts don't sum to
    100 within `off` are left out."""
    j = exposure.select("date", F.col("style").alias("style_a"), F.col("exposure").alias("a")).join(covariance, ["date", "style_a"])
    j = j.join(exposure.select("date", F.col("style").alias("style_b"), F.col("exposure").alias("b")), ["date", "style_b"])
    own = j.groupBy("date", F.col("style_a").alias("style")).agg(F.sum(F.col("a") * F.col("covariance") * F.col("b")).alias("v"))
    part = own.join(specific.select("date"), "date", "left_semi").unionByName(specific.join(own.select("date").distinct(), "date", "left_semi").select("date", F.lit("Specific").alias("style"), F.col("specific_variance").alias("v")))
    day = Window.partitionBy("date")
    out = part.withColumn("total", F.sum("v").over(day)).where("total > 0").withColumn("contribution", 100 * F.col("v") / F.col("total"))
    return out.withColumn("_s", F.sum("contribution").over(day)).where(F.abs(F.col("_s") - 100) <= off).select("date", "style", "contribution", F.col("total").alias("total_variance"))


def ridged(covariance: np.ndarray, most: float = 1e12) -> np.ndarray:
    """The matrix, with 1e-6 of its mean variance on the diagonal where its condition number is too large."""
    n = len(covariance)
    return covariance + np.eye(n) * 1e-6 * np.trace(covariance) / n if n and np.linalg.cond(covariance) > most else covariance


def ridged_covariance(covariance: DataFrame) -> DataFrame:
    """covariance (date, style_a, style_b, covariance) with each date's matrix ridged(), and whether it was: a matrix of
    few dates has no inverse. A date's task holds one matrix of the styles."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot(index="style_a", columns="style_b", values="covariance").astype(float)
        if m.isna().any(axis=None):  # too few dates for one of its entries
            return p.assign(ridged=False)[["date", "style_a", "style_b", "covariance", "ridged"]]
        new = ridged(m.to_numpy())
        long = pd.DataFrame(new, m.index, m.columns).stack().rename("covariance").reset_index()
        return long.assign(date=p["date"].iloc[0], ridged=bool((new != m.to_numpy()).any()))[["date", "style_a", "style_b", "covariance", "ridged"]]

    return covariance.groupBy("date").applyInPandas(one, "date date, style_a string, style_b string, covariance double, ridged boolean")


def fixed_structure(wide: DataFrame, buckets: dict[str, list[str]], reference: str, days: int = 126) -> DataFrame:
    """bucket, feature, mean, loading: the first principal component of each bucket over the complete rows of
    the `days` dates up to the reference date. Sums of products leave the tasks, so what is solved is one
    small matrix a bucket."""
    last = wide.where(F.col("date") <= F.lit(reference).cast("date")).select("date").distinct().orderBy(F.desc("date")).limit(days)
    rows = wide.join(F.broadcast(last), "date", "left_semi")  # at most `days` rows
    out = []
    for name, cols in buckets.items():
        k = len(cols)
        terms = [F.lit(1.0), *(F.col(c) for c in cols)]
        got = rows.dropna(subset=cols).agg(*(F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1))).first()
        n = got["s0_0"] or 0
        if n < 2:
            continue
        mean = np.array([got[f"s0_{i + 1}"] for i in range(k)]) / n
        cov = np.array([[got[f"s{min(i, j) + 1}_{max(i, j) + 1}"] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
        v = np.linalg.eigh(cov)[1][:, -1] if k > 1 else np.ones(1)
        v = v * np.sign(v[np.abs(v).argmax()] or 1)
        out += [(name, c, float(mean[i]), float(v[i])) for i, c in enumerate(cols)]
    return wide.sparkSession.createDataFrame(out, "bucket string, feature string, mean double, loading double")


def applied_structure(wide: DataFrame, structure: DataFrame) -> DataFrame:
    """date, ticker, bucket, score: the fixed loadings on later rows; null where a feature is. A bucket one of
    whose features the table lacks is left out."""
    parts: dict[str, list] = {}
    for r in structure.orderBy("bucket", "feature").collect():  # a row for each feature
        parts.setdefault(r.bucket, []).append(r)
    own = [F.struct(F.lit(b).alias("bucket"), sum(((F.col(r.feature) - r.mean) * r.loading for r in rs), F.lit(0.0)).alias("score")) for b, rs in parts.items() if {r.feature for r in rs} <= set(wide.columns)]
    return wide.select("date", "ticker", F.explode(F.array(*own)).alias("x")).select("date", "ticker", "x.bucket", "x.score")


def regression_exposure(long: DataFrame, scores: DataFrame, styles: list[str], least: int = 5) -> DataFrame:
    """factor, style, exposure: coefficients of each factor's regression on all style scores (with intercept,
    at least `least` complete rows a date), averaged over dates. A date's sums are aggregated; a small solve
    follows for each factor and date. A singular date gives correlations instead."""
    s = scores.groupBy("date", "ticker").pivot("bucket", styles).agg(F.first("score")).dropna(subset=styles)
    j = long.where("value is not null").join(s, ["date", "ticker"])
    terms = [F.lit(1.0), *(F.col(c) for c in styles)]
    k = len(terms)
    sums = j.groupBy("date", "factor").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("yy"), *(F.sum(terms[a] * terms[b]).alias(f"x{a}_{b}") for a in range(k) for b in range(a, k)), *(F.sum(terms[a] * F.col("value")).alias(f"y{a}") for a in range(k))).where(F.col("n") >= least)

    def solve(batches):
        for p in batches:
            rows = []
            for t in p.itertuples(index=False):
                m = np.array([[getattr(t, f"x{min(a, b)}_{max(a, b)}") for b in range(k)] for a in range(k)])
                y = np.array([getattr(t, f"y{a}") for a in range(k)])
                if np.linalg.matrix_rank(m) == k:
                    f = np.linalg.solve(m, y)[1:]
                else:
                    c = y[1:] / t.n - m[0, 1:] / t.n * y[0] / t.n
                    v = np.diag(m)[1:] / t.n - (m[0, 1:] / t.n) ** 2
                    d = np.sqrt(np.maximum(v * (t.yy / t.n - (y[0] / t.n) ** 2), 0))
                    f = np.where(d > 0, c / np.where(d > 0, d, 1), 0.0)
                rows += [(t.factor, c, float(f[i])) for i, c in enumerate(styles)]
            yield pd.DataFrame(rows, columns=["factor", "style", "exposure"])

    return sums.mapInPandas(solve, "factor string, style string, exposure double").groupBy("factor", "style").agg(F.avg("exposure").alias("exposure"))


def unweighted_exposure(long: DataFrame) -> DataFrame:
    """date, factor, exposure: without weights, the median of the standardised values and their variance."""
    m = long.groupBy("date", "factor").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    x = long.where("value is not null").join(m, ["date", "factor"]).withColumn("z", F.try_divide(F.col("value") - F.col("m"), "s"))
    return x.groupBy("date", "factor").agg(F.median("z").alias("exposure"), F.var_samp("z").alias("variance"))


def portfolio_exposure(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """date, style, exposure: weighted mean over held names, weights made to sum to 1 over them."""
    return scores.join(weights, ["date", "ticker"]).where("score is not null").groupBy("date", F.col("bucket").alias("style")).agg(F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("exposure"))


def risk_shares(exposure: DataFrame, covariance: DataFrame, specific: float = 0.0) -> DataFrame:
    """date, style, contribution in percent of b'Cb + specific (it may be negative), and the specific part."""
    j = exposure.select("date", F.col("style").alias("style_a"), F.col("exposure").alias("a")).join(covariance, "style_a")
    j = j.join(exposure.select("date", F.col("style").alias("style_b"), F.col("exposure").alias("b")), ["date", "style_b"])
    own = j.groupBy("date", F.col("style_a").alias("style")).agg(F.sum(F.col("a") * F.col("covariance") * F.col("b")).alias("v"))
    total = F.sum("v").over(Window.partitionBy("date")) + specific
    out = own.withColumn("total", total)
    out = out.withColumn("contribution", F.try_divide(100 * F.col("v"), "total")).withColumn("specific", F.try_divide(F.lit(100 * specific), "total"))
    return out.where("total > 0").select("date", "style", "contribution", "specific")


def raw_exposure(long: DataFrame, weights: DataFrame, top: int = 50) -> DataFrame:
    """date, factor, exposure, share: (held mean - mean) / spread, and the percent of the squares; the
    largest `top` per date."""
    m = long.groupBy("date", "factor").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    h = long.join(weights, ["date", "ticker"]).where("value is not null").groupBy("date", "factor").agg(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum("weight")).alias("h"))
    x = h.join(m, ["date", "factor"]).select("date", "factor", F.try_divide(F.col("h") - F.col("m"), "s").alias("exposure")).where("exposure is not null")
    x = x.withColumn("share", F.try_divide(100 * F.col("exposure") * F.col("exposure"), F.sum(F.col("exposure") * F.col("exposure")).over(Window.partitionBy("date"))))
    return x.withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.abs("exposure")), "factor"))).where(F.col("_r") <= top).drop("_r")


def style_exposure(long: DataFrame, scores: DataFrame, least: int = 10) -> DataFrame:
    """factor, style, exposure: mean over dates of the correlation of factor and style score."""
    j = long.join(scores.select("date", "ticker", F.col("bucket").alias("style"), "score"), ["date", "ticker"]).where("value is not null and score is not null")
    c = j.groupBy("date", "factor", "style").agg(F.count("*").alias("n"), F.covar_pop("value", "score").alias("c"), F.stddev_pop("value").alias("a"), F.stddev_pop("score").alias("b"))
    return c.where((F.col("n") >= least) & (F.col("a") > 1e-12) & (F.col("b") > 1e-12)).groupBy("factor", "style").agg(F.avg(F.col("c") / (F.col("a") * F.col("b"))).alias("exposure"))


def dominant_style(exposure: DataFrame, least: float = 0.05) -> DataFrame:
    """factor, style with the largest absolute exposure; `Custom` under the least one."""
    x = exposure.groupBy("factor").agg(F.max(F.struct(F.abs("exposure").alias("e"), "style")).alias("t"))
    return x.select("factor", F.when(F.col("t.e") >= least, F.col("t.style")).otherwise("Custom").alias("dominant_style"), F.col("t.e").alias("size"))
