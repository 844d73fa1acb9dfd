"""Rolling covariances and the weights by date against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import rolling as ro


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(5)
    rows = [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", f"t{k:02d}", float(rng.normal() * (1 + k) / 100 + (d % 5) / 200)) for d in range(90) for k in range(11) if rng.random() < 0.85 and not (k == 7 and d < 80)]
    return spark.createDataFrame(rows, "date string, ticker string, ret double").withColumn("date", F.to_date("date")).cache()


def as_wide(returns):
    p = returns.toPandas()
    p["date"] = p["date"].astype(str)
    return p.pivot(index="date", columns="ticker", values="ret").sort_index()


@pytest.mark.parametrize(("size", "window", "lam"), [(64, 20, 1.0), (4, 20, 1.0), (4, 200, 0.94), (1, 7, 0.9)])
def test_rolling_covariance(spark, returns, monkeypatch, size, window, lam):
    monkeypatch.setattr(ro, "FRESH", 37)
    wide = as_wide(returns)
    asked = [d for k, d in enumerate(wide.index) if k % 9 == 4 or k > 86]
    dates = spark.createDataFrame([(d,) for d in [*asked, "2030-01-01"]], "date string").withColumn("date", F.to_date("date"))
    got = {(str(r.date), r.ticker_a, r.ticker_b): r.covariance for r in ro.rolling_covariance(returns, dates, window, 3, lam, size).collect()}
    want = {}
    for d in asked:
        part = wide.loc[:d].tail(window)
        n = part.notna().astype(int)
        counts = n.T @ n
        for a in wide.columns:
            for b in wide.columns:
                if counts.at[a, b] >= 3:
                    both = part[[a, b]].to_numpy() if a != b else np.column_stack([part[a], part[a]])
                    ok = ~np.isnan(both).any(1)
                    w = lam ** np.arange(len(both) - 1, -1, -1)[ok]
                    x, y = both[ok].T
                    m = (w * x * y).sum() / w.sum() - (w * x).sum() * (w * y).sum() / w.sum() ** 2
                    want[d, a, b] = m * w.sum() ** 2 / (w.sum() ** 2 - (w * w).sum())
    assert got.keys() == want.keys()
    assert max(abs(got[k] - v) for k, v in want.items()) < 1e-12
    if lam == 1.0 and window == 20:
        d = asked[-1]
        pairwise = wide.loc[:d].tail(20).cov(min_periods=3)
        assert all(abs(got[d, a, b] - pairwise.at[a, b]) < 1e-12 for a in wide for b in wide if (d, a, b) in got)


def test_weights_by_date(spark, returns, tmp_path):
    wide = as_wide(returns)
    rng = np.random.default_rng(1)
    rows = [(d, t, float(rng.normal())) for d in wide.index[::8] for t in [*wide.columns[:9], "zz"]]
    scores = spark.createDataFrame(rows, "date string, ticker string, prediction double").withColumn("date", F.to_date("date"))
    got = ro.weights_by_date(scores, returns, "inv", 25, 20).toPandas()
    got["date"] = got["date"].astype(str)
    for d, p in got.groupby("date"):
        w = p.set_index("ticker")["weight"]
        assert len(w) == 10 and abs(w.sum() - 1) < 1e-12
        if list(wide.index).index(d) < 19:
            assert np.allclose(w, 0.1)
            continue
        sd = wide.loc[:d].tail(25)[list(wide.columns[:9])].std()
        inv = (1 / sd).fillna(0)
        assert w["zz"] == 0 and np.allclose(w[inv.index], inv / inv.sum())
    gmv = ro.weights_by_date(scores, returns, "gmv", 25, 20)
    assert gmv.where("weight < -1e-12").count() == 0
    ro.saved_wide(got_df := ro.weights_by_date(scores, returns, "inv", 25, 20), str(tmp_path / "w"))
    back = spark.read.parquet(str(tmp_path / "w")).toPandas()
    assert len(back) == got_df.select("date").distinct().count() and np.allclose(back.drop(columns="date").sum(axis=1), 1) and isinstance(back, pd.DataFrame)
