"""The build job and the enhancement chain against pandas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import alphas as al
from panelspark.operators import cleaning as cl
from panelspark.operators import diagnostics as dg
from panelspark.plans import buildjob as bj
from panelspark.sources import stores


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(15):
        price = 50.0
        for d in range(60):
            price *= float(np.exp(rng.normal() * 0.03 + 0.001 * (k % 3)))
            rows.append((f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", f"t{k:02d}", price * 1.01, price * 0.98, price, float(rng.integers(1, 9))))
    df = spark.createDataFrame(rows, "date string, ticker string, high double, low double, close double, volume double").withColumn("date", F.to_date("date"))
    return df.select("date", "ticker", F.col("close").alias("open"), "high", "low", "close", F.col("close").alias("adj_close"), "volume").cache()


TREES = {"mom": al.C / al.lag(5, al.C) - 1, "rev": -(al.C / al.lag(2, al.C) - 1), "sd": al.sd(6, al.r), "big": (al.C / al.lag(3, al.C) - 1) * 1000}


def test_build_with_stability(spark, panel, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    universe = spark.createDataFrame([(f"t{k:02d}",) for k in range(12)] + [("gone",)], "ticker string")
    built = bj.build_and_store(panel, TREES, store, universe, stability={"window": 10, "threshold": 3.0, "min_coverage": 0.5})
    assert built.factors == ["mom", "rev", "sd"] and [r.ticker for r in built.missing.collect()] == ["gone"]
    report = {r.factor: r for r in built.reports["stability"].collect()}
    assert not report["big"].kept and report["big"].median_spread > 3
    wide = cl.to_wide(bj.PROCESSES["mad"](cl.to_long(bj.evaluate(panel.where("ticker < 't12'"), TREES), ["mom", "rev", "sd"])), ["mom", "rev", "sd"])
    got = store.read()
    assert sorted(map(repr, got.select("date", "ticker", "mom", "rev", "sd").collect())) == sorted(map(repr, wide.select("date", "ticker", "mom", "rev", "sd").collect()))
    p = wide.toPandas().sort_values(["ticker", "date"])
    spread = p.groupby("ticker")["sd"].rolling(10, min_periods=5).std()
    assert abs(report["sd"].coverage - spread.notna().mean()) < 1e-12 and abs(report["sd"].median_spread - spread.median()) < 1e-12
    with pytest.raises(ValueError):
        bj.build_and_store(panel, TREES, store, stability={"window": 10, "threshold": 0.0})


def test_enhancement_chain(spark, panel, tmp_path):
    long = cl.to_long(bj.evaluate(panel, TREES), list(TREES))
    labels = dg.forward_return(panel)
    stats = {r.factor: r for r in bj.ic_statistics(long, labels).collect()}
    cut = sorted(abs(r.ic_mean) for r in stats.values())[1]
    now, report = bj.enhance(long, labels, bj.Enhancement((cut, 0.0, 0.0), None, "icir_weighted"))
    kept = {f for f, r in stats.items() if abs(r.ic_mean) >= cut}
    rows = report.collect()
    assert {r.factor for r in rows if r.step == "quality" and r.kept} == kept and len([r for r in rows if r.step == "quality"]) == 4
    weights = {r.factor: r.weight for r in rows if r.step == "combination"}
    total = sum(abs(stats[f].icir) for f in kept)
    assert weights.keys() == kept and all(abs(weights[f] - abs(stats[f].icir) / total) < 1e-12 for f in kept)
    p = now.toPandas().pivot(index=["date", "ticker"], columns="factor", values="value")
    want = sum(p[f] * w for f, w in weights.items())
    assert set(p.columns) == kept | {"COMBINED"} and np.allclose(p["COMBINED"], want, equal_nan=True)
    now, report = bj.enhance(long, labels, bj.Enhancement(None, 0.9, "equal_weight"))
    names = {r.factor for r in now.select("factor").distinct().collect()}
    assert "PCA_1" in names and "COMBINED" in names and {r.step for r in report.select("step").distinct().collect()} == {"components", "combination"}
    same, none = bj.enhance(long, labels, bj.Enhancement(None, None, None))
    assert same.count() == long.count() and none.count() == 0 and none.columns == bj.REPORT


def test_whole_job(spark, panel, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    built = bj.build_and_store(panel, TREES, store, start="2024-01-15", process="standard", orthogonal=True, enhancement=bj.Enhancement((0.0, 0.0, 0.0), None, "ic_weighted"))
    assert built.factors == sorted([*TREES, "COMBINED"]) and set(built.reports) == {"enhancement", "ics"}
    p = store.read().toPandas()
    assert str(p["date"].min()) == "2024-01-15"
    day = p[p["date"] == p["date"].max()][list(TREES)].dropna().to_numpy()
    gram = day.T @ day
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-8 * np.diag(gram).max()
