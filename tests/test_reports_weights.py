"""Covariances, optimisers, reports, the risk job and the store jobs against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import alphas as al
from panelspark.operators import combine as cb
from panelspark.operators import covariance as cv
from panelspark.operators import reports as rp
from panelspark.operators import risk as rk
from panelspark.plans import jobs


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    days = pd.date_range("2024-01-01", periods=60).date
    rows = [(d, f"t{k}", float(v)) for d, day in zip(days, rng.normal(0, 0.02, (60, 6)) @ rng.normal(0, 1, (6, 6))) for k, v in enumerate(day)]
    return pd.DataFrame(rows, columns=["date", "ticker", "ret"])


def matrix(df):
    return df.toPandas().pivot(index="ticker_a", columns="ticker_b", values="covariance").sort_index().sort_index(axis=1).to_numpy()


def test_covariances(spark, table):
    df, x = spark.createDataFrame(table), table.pivot(index="date", columns="ticker", values="ret")
    assert np.allclose(matrix(cv.sample_covariance(df)), x.cov())
    assert np.allclose(matrix(cv.ewma_covariance(df, 0.9)), x.ewm(alpha=0.1).cov().iloc[-6:])
    c = (x - x.mean()).to_numpy()
    s = c.T @ c / len(c)
    mu = np.trace(s) / 6
    d2 = ((s - mu * np.eye(6)) ** 2).sum() / 6
    b2 = min(sum(((np.outer(t, t) - s) ** 2).sum() for t in c) / len(c) ** 2 / 6, d2)
    assert np.allclose(matrix(cv.shrunk_covariance(df)), b2 / d2 * mu * np.eye(6) + (1 - b2 / d2) * s)


def test_optimisers(spark, table):
    s = table.pivot(index="date", columns="ticker", values="ret").cov().to_numpy()
    rng = np.random.default_rng(1)
    w = cv.solved(s, "gmv")
    r = rng.normal(0, 1, 6)
    m = cv.solved(s, "mvo", r, lamb=0.5)
    goal = lambda v: v @ s @ v - 0.5 * v @ (r * np.sqrt(np.diag(s)).mean() / r.std())
    for _ in range(2000):  # no random portfolio, near or far, does better
        v = rng.dirichlet(np.full(6, 0.5))
        for base, f in ((w, lambda u: u @ s @ u), (m, goal)):
            for u in (v, 0.99 * base + 0.01 * v):
                assert f(base) <= f(u) + 1e-12
    p = cv.solved(s, "rp")
    risk = p * (s @ p)
    assert np.allclose(risk, risk.mean(), rtol=1e-6) and abs(p.sum() - 1) < 1e-12
    w0 = np.eye(6)[0]
    held = cv.solved(s, "gmv", w0=w0, delta=0.3)
    assert np.abs(held - w0).sum() <= 0.3 + 1e-9 and held @ s @ held < s[0, 0] and held.min() >= 0
    got = cv.optimal_weights(cv.sample_covariance(spark.createDataFrame(table))).toPandas().set_index("ticker")["weight"]
    assert np.allclose(got.sort_index(), w, atol=1e-6)
    assert cv.optimal_weights(cv.sample_covariance(spark.createDataFrame(table).limit(0))).count() == 0


def test_usable_weights_and_newest(spark):
    df = spark.createDataFrame([("2024-01-05", "a", 3.0), ("2024-01-05", "b", 1.0), ("2024-01-06", "a", 0.0), ("2024-01-06", "b", None)], "date string, ticker string, weight double").withColumn("date", F.to_date("date"))
    history = spark.range(10).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    assert sorted(map(tuple, cv.usable(df, history, 3).select(F.dayofmonth("date"), "ticker", "weight").collect())) == [(5, "a", 0.75), (5, "b", 0.25), (6, "a", 0.5), (6, "b", 0.5)]
    assert {r.weight for r in cv.usable(df, history, 9).collect()} == {0.5}
    scores = spark.createDataFrame([("2024-01-02", t, float(v)) for t, v in zip("abcdef", (6, 5, 4, 3, 2, 1))] + [("2024-01-01", "z", 9.0)], "date string, ticker string, prediction double").withColumn("date", F.to_date("date"))
    held = spark.createDataFrame([("a",), ("e",), ("f",), ("z",)], "ticker string")
    got = cv.weights_for_newest(scores, held, 3, 1).collect()
    assert {r.ticker for r in got} == {"a", "b", "e"} and {round(r.weight, 9) for r in got} == {round(1 / 3, 9)}


def test_components_and_information(spark, table):
    rng = np.random.default_rng(2)
    wide = pd.DataFrame([("2024-01-01", f"t{k}", *v) for k, v in enumerate(rng.normal(0, 1, (40, 3)) @ np.diag([3, 1, 0.1]))], columns=["date", "ticker", "a", "b", "c"])
    wide["c"] = wide["a"] * 2 + wide["c"] * 0.01
    df = spark.createDataFrame(wide).withColumn("date", F.to_date("date"))
    got = cb.principal_components(df, ["a", "b", "c"]).toPandas().pivot(index="ticker", columns="component", values="value")
    x = wide.set_index("ticker")[["a", "b", "c"]].sort_index()
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    assert got.shape[1] == 2 and np.allclose(np.abs(np.linalg.svd(z, full_matrices=False)[0][:, :2] * np.linalg.svd(z)[1][:2]), np.abs(got.sort_index().to_numpy()))
    assert cb.principal_components(df, ["a", "b", "c"], most=3).count() == 120


def test_structure_and_regression(spark):
    rng = np.random.default_rng(5)
    rows = [(f"2024-01-{d:02d}", f"t{k}", *rng.normal(0, 1, 3)) for d in range(1, 11) for k in range(30)]
    wide = pd.DataFrame(rows, columns=["date", "ticker", "a", "b", "y"])
    wide["y"] = 2 * wide["a"] - wide["b"] + 0.01 * wide["y"]
    df = spark.createDataFrame(wide).withColumn("date", F.to_date("date"))
    fixed = rk.fixed_structure(df, {"X": ["a", "b"], "Y": ["y"]}, "2024-01-05", 3)
    ref = wide[wide["date"].between("2024-01-03", "2024-01-05")][["a", "b"]]
    v = np.linalg.eigh(np.cov(ref.to_numpy(), rowvar=False))[1][:, -1]
    v = v * np.sign(v[np.abs(v).argmax()])
    got = {(r.bucket, r.feature): r for r in fixed.collect()}
    assert np.allclose([got["X", "a"].loading, got["X", "b"].loading], v) and abs(got["X", "a"]["mean"] - ref["a"].mean()) < 1e-9
    s = rk.applied_structure(df.drop("y"), fixed).toPandas()
    assert set(s["bucket"]) == {"X"} and len(s) == 300
    long = df.select("date", "ticker", F.lit("y").alias("factor"), F.col("y").alias("value"))
    scores = df.select("date", "ticker", F.explode(F.array(*(F.struct(F.lit(c).alias("bucket"), F.col(c).alias("score")) for c in ("a", "b")))).alias("x")).select("date", "ticker", "x.*")
    e = {r.style: r.exposure for r in rk.regression_exposure(long, scores, ["a", "b"]).collect()}
    assert abs(e["a"] - 2) < 0.01 and abs(e["b"] + 1) < 0.01
    bad = np.array([[1.0, 1.0], [1.0, 1.0]])
    assert np.linalg.cond(rk.ridged(bad)) < 1e12 and (rk.ridged(np.eye(2)) == np.eye(2)).all()


def test_decomposition_sums_to_100(spark):
    day = F.lit("2024-01-05").cast("date")
    expo = spark.createDataFrame([("a", 1.0), ("b", -0.5)], "style string, exposure double").withColumn("date", day)
    cov = spark.createDataFrame([("a", "a", 0.04), ("a", "b", 0.03), ("b", "a", 0.03), ("b", "b", 0.09)], "style_a string, style_b string, covariance double").withColumn("date", day)
    spec = spark.createDataFrame([(0.01,)], "specific_variance double").withColumn("date", day)
    got = {r.style: r.contribution for r in rk.decomposition(expo, cov, spec).collect()}
    total = 0.04 - 0.03 + 0.0225 + 0.01
    assert abs(sum(got.values()) - 100) < 1e-9 and abs(got["Specific"] - 1 / total) < 1e-9 and abs(got["a"] - 100 * 0.025 / total) < 1e-9


def test_jobs(spark):
    rows = [(f"2024-01-{d:02d}", t, float(d + i), float(d)) for d in range(1, 21) for i, t in enumerate("abc")]
    panel = spark.createDataFrame(rows, "date string, ticker string, adj_close double, volume double").withColumn("date", F.to_date("date"))
    panel = panel.select("date", "ticker", *(F.col("adj_close").alias(c) for c in ("open", "high", "low", "close", "adj_close")), "volume")
    trees = {"mom3": al.C / al.lag(3, al.C) - 1}
    full = jobs.build(panel, trees)
    store = full.where("date < '2024-01-15' and date <> '2024-01-10'")
    fresh = jobs.refresh_factors(panel, store, trees, 3)
    assert sorted(map(str, fresh.select("date", "ticker", "mom3").collect())) == sorted(map(str, full.join(fresh.select("date").distinct(), "date").select("date", "ticker", "mom3").collect()))
    assert {r.d for r in fresh.select(F.dayofmonth("date").alias("d")).distinct().collect()} == {10, *range(15, 21)}
    jobs.register_factor("user_range", al.H - al.L)
    try:
        assert "user_range" in jobs.build(panel, trees).columns
        with pytest.raises(ValueError):
            jobs.register_factor("user_range", al.H)
    finally:
        jobs.FACTORS.clear()
    new = panel.where("date = '2024-01-20'").withColumn("adj_close", F.lit(99.0))
    out = jobs.daily_chain(panel.where("date < '2024-01-20'"), new, store, trees, 3, jobs.medians(full, ["mom3"]), lambda df: jobs.linear_score({"mom3": 1.0})(df.limit(0)), 2, skip=("weights",))
    assert set(out) == {"prices", "factors", "predictions"} and out["prices"].count() == 60 and out["prices"].where("adj_close = 99").count() == 3
    seg = jobs.segments(panel, ("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2025-01-01", "2025-02-01"))
    assert {r.segment: r["count"] for r in seg.groupBy("segment").count().collect()} == {"train": 30, "valid": 30, "test": 30}


def test_screen_and_report_edges(spark):
    s = spark.createDataFrame([("good", 0.03, 0.6, 0.7, 12.0, 400), ("fair", -0.006, -0.06, 0.51, -1.2, 400), ("bad", 0.0, 0.0, 0.5, 0.0, 400), ("none", None, None, None, None, 0)], "factor string, ic_mean double, icir double, win_rate double, t_stat double, days long")
    assert sorted((r.rule, r.factor) for r in rp.screened(s).collect()) == [("moderate", "fair"), ("moderate", "good"), ("strict", "good")]
    with pytest.raises(ValueError):
        rp.top_submatrix(s, s, 7)
