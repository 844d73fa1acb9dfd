"""Factor analysis against its own dense form, and total losses in curves."""

import numpy as np
from pyspark.sql import functions as F

from panelspark.operators import diagnostics as dg
from panelspark.operators import latent
from panelspark.operators import performance as pf


def dense_em(s, k, steps, tol):
    """The same iteration by dense inverses; likelihoods by the density's formula."""
    p = len(s)
    values, vectors = np.linalg.eigh(s)
    order = np.argsort(-values)
    load = vectors[:, order[:k]] * np.sqrt(np.maximum(values[order[:k]] - values[order[k:]].mean(), latent.LEAST))
    u, trail = np.maximum(np.diag(s - load @ load.T), latent.LEAST), []
    for _ in range(steps):
        sigma = load @ load.T + np.diag(u)
        inv = np.linalg.inv(sigma)
        trail.append(-0.5 * (p * np.log(2 * np.pi) + np.log(np.linalg.det(sigma)) + np.trace(inv @ s)))
        if len(trail) > 1 and trail[-1] - trail[-2] < tol:
            break
        beta = load.T @ inv
        second = np.eye(k) - beta @ load + beta @ s @ beta.T
        load = s @ beta.T @ np.linalg.inv(second)
        u = np.maximum(np.diag(s - load @ beta @ s), latent.LEAST)
    return load, u, trail


def test_factor_analysis(spark):
    rng = np.random.default_rng(6)
    names = [f"f{i}" for i in range(7)]
    true = rng.normal(size=(7, 2))
    rows = []
    for day in range(1, 5):
        x = rng.normal(size=(60, 2)) @ true.T + rng.normal(size=(60, 7)) * 0.5
        for t in range(60):
            v = [None if rng.random() < 0.05 else float(e) for e in x[t]]
            if day == 3:
                v[6] = 1.5  # flat on one date
            if day == 4:
                v[5] = None  # absent on one date
            rows.append((f"2024-01-0{day}", f"t{t}", *v))
    wide = spark.createDataFrame(rows, "date string, ticker string, " + ", ".join(f"{n} double" for n in names)).withColumn("date", F.to_date("date"))
    z = latent.standardized(wide, names)
    fit = latent.factor_analysis(latent.moments(z, names), names, 2)
    got = {str(d): p.set_index("factor") for d, p in fit.toPandas().groupby("date")}
    section = {str(d): p for d, p in z.toPandas().groupby("date")}
    assert sorted(got) == sorted(section) and [len(got[d]) for d in sorted(got)] == [7, 7, 6, 6]
    scores = {(str(r.date), r.ticker, r.component): r.value for r in latent.component_scores(z, names, fit).collect()}
    for d, own in got.items():
        own = own.loc[[n for n in names if n in own.index]]
        x = section[d][list(own.index)].to_numpy()
        load, u, trail = dense_em(x.T @ x / len(x), 2, 1000, 1e-8)
        assert len(trail) == own["steps"].iloc[0] and np.all(np.diff(trail) > -1e-10) and abs(trail[-1] - own["log_likelihood"].iloc[0]) < 1e-9
        mine = np.array(own["loadings"].tolist())
        assert np.abs(mine @ mine.T - load @ load.T).max() < 1e-6 and np.abs(own["uniqueness"].to_numpy() - u).max() < 1e-6
        gram = mine.T @ (mine / u[:, None])
        assert abs(gram[0, 1]) < 1e-6 * gram[0, 0] and gram[0, 0] >= gram[1, 1]
        want = x @ np.linalg.inv(mine @ mine.T + np.diag(u)) @ mine
        for i, t in enumerate(section[d]["ticker"]):
            assert np.allclose([scores[d, t, 1], scores[d, t, 2]], want[i], atol=1e-6)
    # the planted plane is found
    fitted = np.array(got["2024-01-01"].loc[names, "loadings"].tolist())
    true /= np.sqrt((true**2).sum(1, keepdims=True) + 0.25)
    assert min(np.linalg.svd(np.linalg.qr(fitted)[0].T @ np.linalg.qr(true)[0])[1]) > 0.97


def test_factor_analysis_of_few(spark):
    wide = spark.createDataFrame([("2024-01-01", "a", 1.0, 2.0), ("2024-01-02", "a", 1.0, 2.0), ("2024-01-02", "b", 2.0, None)], "date string, ticker string, x double, y double").withColumn("date", F.to_date("date"))
    z = latent.standardized(wide, ["x", "y"])
    assert latent.factor_analysis(latent.moments(z, ["x", "y"]), ["x", "y"], 2).count() == 0
    one = latent.factor_analysis(latent.moments(z, ["x", "y"]), ["x", "y"], 1).collect()
    assert [(str(r.date), r.factor) for r in one] == [("2024-01-02", "x")]
    assert latent.factor_analysis(latent.moments(z.limit(0), ["x", "y"]), ["x", "y"], 1).count() == 0


def test_total_loss(spark):
    rows = [("2024-01-30", 0.1), ("2024-01-31", -1.0), ("2024-02-01", 0.1), ("2024-02-02", -1.5), ("2024-02-03", None)]
    r = spark.createDataFrame(rows, "date string, x double").withColumn("date", F.to_date("date"))
    nav = [round(x.nav, 9) for x in pf.curve(r, "x").orderBy("date").collect()]
    assert nav == [1.1, 0, 0, 0, 0]
    short = [(x.nav, x.drawdown) for x in pf.curve(r.where("date > '2024-01-31'"), "x").orderBy("date").collect()]
    assert np.allclose(short, [(1.1, 0), (-0.55, -1.5), (-0.55, -1.5)])
    assert np.allclose([x.x for x in pf.monthly(r, "x").orderBy("month").collect()], [-1, 1.1 * -0.5 - 1])
    s = pf.risk_summary(r, "x").first()
    assert abs(s.total_return + 1) < 1e-12 and abs(s.max_drawdown + 1) < 1e-12
    ls = dg.long_short_stats(r.where("x is not null").select("date", F.lit("f").alias("factor"), F.col("x").alias("ls_return"))).first()
    assert ls.total_return == -1 and ls.max_drawdown == -1
