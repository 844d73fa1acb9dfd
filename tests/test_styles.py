"""The style chain against a dense form, with its two paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import styles as sy

NAMES = {"Momentum": ["MOM_1", "ROC_2", "RSI_3"], "Volatility": ["ATR_1", "NATR_2"], "Quality/Stability": ["BOP"], "Liquidity": ["OBV", "MFI_1", "ADOSC"]}


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(11)
    rows = []
    for d in range(1, 5):
        base = rng.normal(size=(40, 2))
        for t in range(40):
            v = {"MOM_1": base[t, 0], "ROC_2": base[t, 0] + 0.3 * rng.normal(), "RSI_3": -base[t, 0] + 0.5 * rng.normal(), "ATR_1": base[t, 1], "NATR_2": base[t, 1] + base[t, 0] + rng.normal(), "BOP": rng.normal(), **{c: rng.normal() for c in NAMES["Liquidity"]}}
            if d == 3:
                v["NATR_2"] = 2.0  # no spread: the bucket is skipped on this date
            rows += [(f"2024-01-0{d}", f"t{t:02d}", c, None if rng.random() < 0.03 else float(x)) for c, x in v.items()]
    return spark.createDataFrame(rows, "date string, ticker string, factor string, value double").withColumn("date", F.to_date("date")).cache()


def dense(long, reference, compat, singles):
    p = long.toPandas()
    p["date"] = p["date"].astype(str)
    norm = {}
    for (d, c), x in p.groupby(["date", "factor"]):
        v = x.set_index("ticker")["value"].dropna()
        if v.std() >= 1e-8:
            v = v.clip(v.quantile(0.025), v.quantile(0.975))
            norm[d, c] = (v - v.mean()) / v.std()
    models = {}
    for b, cols in NAMES.items():
        x = pd.concat([norm[reference, c] for c in cols], axis=1).dropna().to_numpy()
        if len(cols) == 1:
            models[b] = (np.zeros(1), np.ones(1), "single")
            continue
        values, vectors = np.linalg.eigh(np.cov(x.T))
        v = vectors[:, -1]
        models[b] = (x.mean(0), v * np.sign(v[np.abs(v).argmax()]), "component" if values[-1] / values.sum() >= 0.5 else "under_share")
    out = {}
    for d in sorted(set(p["date"])):
        scores = {}
        for b in [x for x in sy.BUCKETS if x in NAMES]:
            mean, v, path = models[b]
            if all((d, c) in norm for c in NAMES[b]) and (path != "single" or singles):
                x = pd.concat([norm[d, c] for c in NAMES[b]], axis=1).dropna()
                scores[b] = x.mean(axis=1) if path == "under_share" and not compat else pd.Series((x.to_numpy() - mean) @ v, x.index)
        x = pd.DataFrame(scores).dropna()
        q, r = np.linalg.qr(x.to_numpy())
        q = q * np.sign(np.diag(r))
        for k, b in enumerate(x):
            path = models[b][2] if compat or models[b][2] != "under_share" else "mean"
            out |= {(d, t, b): (q[i, k], path) for i, t in enumerate(x.index)}
    return out


@pytest.mark.parametrize(("compat", "singles"), [(True, False), (False, True)])
def test_chain(spark, long, compat, singles):
    got = {(str(r.date), r.ticker, r.style): (r.score, r.path) for r in sy.chain(long, reference="2024-01-02", compat=compat, keep_singletons=singles).collect()}
    want = dense(long, "2024-01-02", compat, singles)
    assert got.keys() == want.keys() and all(got[k][1] == v[1] and abs(got[k][0] - v[0]) < 1e-9 for k, v in want.items())
    paths = {p for _, p in got.values()}
    assert paths == ({"component", "under_share"} if compat else {"component", "mean", "single"})
    assert ("2024-01-03", "t05", "Volatility") not in got


def test_stored_structure(spark, long, tmp_path):
    norm = sy.normalised(long)
    buckets = sy.classify(long.select("factor").distinct(), "all")
    sy.fitted_structure(norm, buckets, "2024-01-09", days=3).write.parquet(str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    order = {r.bucket: r.ord for r in back.collect()}
    assert sorted(order, key=order.get) == [b for b in sy.BUCKETS if b in NAMES] and back.count() == 9
    own = sy.chain(long.where("date = '2024-01-04' and factor <> 'ROC_2'"), back)
    assert {r.style for r in own.select("style").distinct().collect()} == {"Volatility", "Liquidity"}
    other = sy.fitted_structure(norm, buckets, "2024-01-02", ["Liquidity"]).select("bucket", "ord").distinct().collect()
    assert {r.bucket: r.ord for r in other} == {"Liquidity": 0, "Momentum": 1, "Quality/Stability": 2, "Volatility": 3}
    assert sy.chain(long.limit(0), back).count() == 0
    with pytest.raises(ValueError):
        sy.chain(long)
