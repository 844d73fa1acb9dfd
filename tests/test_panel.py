"""Primitives, labels and reports against pandas; invariants and edge frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from panelspark.functions.expr import col, dw, evaluate, lookback, schedule, tw
from panelspark.operators import alphas as al
from panelspark.operators import cleaning as cl
from panelspark.operators import diagnostics as dg
from panelspark.operators import indicators as ti
from panelspark.operators import performance as pf
from panelspark.operators import risk as rk
from panelspark.operators import selection as sl
from panelspark.operators import trades as tr
from panelspark.sources import panel as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    days = pd.date_range("2024-01-01", periods=40, freq="D").date
    rows = []
    for t in "ABCDE":
        for i, d in enumerate(days):
            if t == "B" and i in (5, 6, 7, 12):
                continue  # gaps
            c = 10.0 if t == "C" else float(rng.uniform(5, 20))
            rows.append((d, t, c, c + 1, c - 1, c, c, float(rng.integers(1, 100))))
    return spark.createDataFrame(rows, src.SCHEMA)


def matrix(df, name):
    p = df.toPandas()
    p["date"] = pd.to_datetime(p["date"])
    return p.pivot(index="date", columns="ticker", values=name).astype(float).sort_index()


def test_windows_equal_pandas(small):
    C, V = col("close"), col("volume")
    f = {"sum5": tw("sum", C, n=5), "std5": tw("std", C, n=5), "corr6": tw("corr", C, V, n=6), "rank": dw("rank", C), "tsrank4": tw("tsrank", C, n=4), "argmax4": tw("argmax", C, n=4), "delta2": tw("delta", C, n=2), "nested": dw("rank", tw("sma", V, n=3))}
    dense = src.densify(small)
    out = evaluate(dense, f)
    c, v = matrix(dense, "close"), matrix(dense, "volume")
    want = {
        "sum5": c.rolling(5).sum(),
        "std5": c.rolling(5).std(),
        "rank": c.rank(axis=1, pct=True),
        "tsrank4": c.rolling(4).apply(lambda x: pd.Series(x).rank().iloc[-1], raw=True),
        "argmax4": c.rolling(4).apply(np.argmax, raw=True) + 1,
        "delta2": c.diff(2),
        "nested": v.rolling(3).mean().rank(axis=1, pct=True),
    }
    for name, w in want.items():
        np.testing.assert_allclose(matrix(out, name).to_numpy(), w.to_numpy(), atol=1e-9, err_msg=name)
    corr = matrix(out, "corr6")
    assert corr["C"].isna().all()  # constant: missing, not an error
    np.testing.assert_allclose(corr["A"], c["A"].rolling(6).corr(v["A"]), atol=1e-7)


def test_stages_share_keys():
    passes = schedule(list(al.alphas().values()))
    changes = 1 + sum(a[0] != b[0] for a, b in zip(passes, passes[1:]))
    assert changes <= 8 and len(al.alphas()) == 101
    assert lookback(al.alphas()["alpha019"]) >= 249


def test_section_constants(small):
    out = evaluate(src.densify(small), {"a": al.alphas()["alpha077"], "p": al.alphas("paper")["alpha077"]})
    assert out.groupBy("date").agg(F.countDistinct("a").alias("n")).where("n > 1").count() == 0


def test_cleaning_edges(spark):
    rows = [("2024-01-01", t, "f", v) for t, v in zip("ABCDE", (1.0, 1.0, 1.0, 1.0, None))]
    df = spark.createDataFrame(rows, "date string, ticker string, factor string, value double").withColumn("date", F.to_date("date"))
    assert [r.value for r in cl.zscore(df).orderBy("ticker").collect()] == [0, 0, 0, 0, None]
    assert [r.value for r in cl.mad_winsorize(df).orderBy("ticker").collect()] == [1, 1, 1, 1, None]
    assert [r.value for r in cl.fill_median(df).orderBy("ticker").collect()] == [1] * 5
    assert cl.good_features(df, max_missing=0.5).count() == 0
    odd = spark.createDataFrame([(1.0, "x"), (float("nan"), "y"), (float("inf"), "z")], "v double, s string")
    assert [r.v for r in src.clean(odd).orderBy("s").collect()] == [1.0, None, None]


def test_quantile_bins_are_not_ntile(spark):
    for n, q in ((7, 5), (23, 5), (1, 5), (3, 5)):
        df = spark.createDataFrame([(dt.date(2024, 1, 1), f"{i:03d}", float(i)) for i in range(n)], "date date, ticker string, label double")
        got = [r.bin for r in dg.quantile_label(df, q).orderBy("ticker").collect()]
        want = [None] if n == 1 else pd.qcut(pd.Series(range(1, n + 1)), min(q, n), labels=False).tolist()
        assert got == want


def test_no_look_ahead(small):
    f = {n: al.alphas()[n] for n in ("alpha003", "alpha012", "alpha033", "alpha044")}
    cut = F.col("date") <= F.lit("2024-01-30").cast("date")
    a = evaluate(src.densify(small), f).where(cut).orderBy("date", "ticker").collect()
    b = evaluate(src.densify(small.where(cut)), f).orderBy("date", "ticker").collect()
    assert a == b


def test_student_p():
    assert abs(dg.student_p(2.0, 10) - 0.07338803) < 1e-6 and abs(dg.student_p(0.0, 5) - 1) < 1e-9


def test_recursive_indicators(small):
    c = np.array([44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.1, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28])
    assert abs(ti.rsi(c, 14)[-1] - 70.46) < 0.1
    x = np.arange(1.0, 8.0)
    assert ti.ema(x, 3).tolist()[2:] == [2, 3, 4, 5, 6] and np.isnan(ti.ema(x, 3)[1])
    assert ti.recursive(small).count() == 0  # under 50 bars


def test_weights_and_curves(small):
    w = pf.top_k(small, 2, "close")
    assert all(abs(r.s - 1) < 1e-12 for r in w.groupBy("date").agg(F.sum("weight").alias("s")).collect())
    labels = dg.forward_return(src.densify(small))
    r = pf.portfolio_returns(w, labels)
    t = pf.turnover(w)
    assert t.where("turnover < 0 or turnover > 2.0000001").count() == 0
    c = pf.curve(pf.net_returns(r, t), "net_return")
    assert c.where("drawdown > 1e-12").count() == 0


def test_orthogonal_columns(spark, small):
    x = small.select("date", "ticker", "close", "volume", (F.col("close") * F.col("volume")).alias("both"))
    p = rk.orthogonal(x, ["close", "volume", "both"]).toPandas().dropna()
    for _, g in p.groupby("date"):
        m = g[["close", "volume", "both"]].to_numpy()
        assert np.abs(m.T @ m - np.eye(3)).max() < 1e-8


def test_risk_shares_sum_to_100(spark):
    e = spark.createDataFrame([("2024-01-01", s, x) for s, x in (("a", 1.0), ("b", -2.0), ("c", 0.5))], "date string, style string, exposure double")
    cov = spark.createDataFrame([(a, b, 1.0 if a == b else -0.3) for a in "abc" for b in "abc"], "style_a string, style_b string, covariance double")
    rows = rk.risk_shares(e, cov, 0.4).collect()
    assert abs(sum(r.contribution for r in rows) + rows[0].specific - 100) < 1e-9


def test_trade_deltas(spark):
    target = spark.createDataFrame([("x", "A", 0.5, 10.0, 1), ("x", "B", 0.5, 20.0, 2)], "account string, ticker string, weight double, price double, ord int")
    held = spark.createDataFrame([("x", "C", -7.0), ("x", "A", 10.0)], "account string, ticker string, shares double")
    got = {r.ticker: r.delta for r in tr.trade_deltas(target, held, 1000.0, 500.0).collect()}
    assert got == {"A": 40.0, "B": 5.0, "C": 7.0}


def test_keys(spark, small):
    new = small.where("date = date'2024-01-05'").withColumn("close", F.lit(1.0))
    up = sl.upsert(small, new, ["date", "ticker"])
    assert up.count() == small.count() and up.where("close = 1").count() == new.count()
    with pytest.raises(ValueError):
        sl.overlap(small, small.limit(0), ["date", "ticker"])
    wide = spark.createDataFrame([("2024-01-01", 1.0, 2.0, None)], "date string, `Close|A` double, `Close|B` double, `Volume|A` double")
    assert {(r.ticker, r.close) for r in sl.wide_vendor_to_panel(wide).collect()} == {("A", 1.0), ("B", 2.0)}


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(o) > 100
