"""Saved models, preparation fitted on training dates, importances from node tables."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import modelstore as ms


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(1, 29):
        for t in range(20):
            a, b, c = rng.normal(size=3)
            rows.append((f"2024-02-{d:02d}", f"t{t}", None if rng.random() < 0.1 else float(a * 3 + 1), float(b), float("nan") if rng.random() < 0.1 else float(c), None if rng.random() < 0.05 else float(2 * a + (b > 0)), int(rng.integers(0, 5))))
    return spark.createDataFrame(rows, "date string, ticker string, a double, b double, c double, label double, bin int").withColumn("date", F.to_date("date")).cache()


def test_prepared_on_training_dates_only(spark, panel):
    got = {}
    for fold, model, test in ms.fold_fits(panel, ["a", "c"], n=4, kind="linear"):
        got[fold] = (model.stages[0], test)
    assert sorted(got) == [1, 2, 3]
    p = panel.toPandas()
    dates = np.array_split(np.array(sorted(p["date"].unique())), 4)
    for fold, (ready, test) in got.items():
        own = p[p["date"].isin(np.concatenate(dates[:fold])) & p["label"].notna()]
        for r in ready.table(spark).collect():
            x = own[r.feature].to_numpy(float)
            filled = np.where(np.isnan(x), np.nanmedian(x), x)
            assert abs(r.median - np.nanmedian(x)) < 1e-12 and abs(r["mean"] - filled.mean()) < 1e-9 and abs(r.sd - filled.std()) < 1e-9
        assert set(test.toPandas()["date"]) == set(dates[fold])
        ready_rows = ready.transform(test)
        assert ready_rows.where("a__x is null or c__x is null or isnan(c__x)").count() == 0


def test_reload_in_another_session(spark, panel, tmp_path):
    path = str(tmp_path / "m")
    model = ms.fit(panel, ["a", "b", "c"], maxIter=5)
    ms.save(model, path, spark)
    want = ms.scores(model, panel).orderBy("date", "ticker").collect()
    back = ms.load(spark, path)
    assert back.features == ["a", "b", "c"]
    assert back.score(panel, least=1).orderBy("date", "ticker").collect() == want
    # a process of its own, with a column less, one more and another order
    panel.select("b", "ticker", "date", "a", "c", F.lit(1).alias("more")).write.parquet(str(tmp_path / "rows"))
    code = f"""
import sys; sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from panelspark.operators import modelstore as ms
rows = s.read.parquet({str(tmp_path / "rows")!r})
m = ms.load(s, {path!r})
m.score(rows, least=1).write.parquet({str(tmp_path / "out")!r})
m.score(rows.drop("c"), "2024-02-05", "2024-02-09", 1).write.parquet({str(tmp_path / "less")!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200, capture_output=True)
    assert spark.read.parquet(str(tmp_path / "out")).orderBy("date", "ticker").collect() == want
    less = spark.read.parquet(str(tmp_path / "less"))
    assert less.count() == 100
    assert sorted(less.collect()) == sorted(back.score(panel.withColumn("c", F.lit(None).cast("double")), "2024-02-05", "2024-02-09", 1).collect())


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_importances_from_nodes(spark, panel, tmp_path, kind):
    path = str(tmp_path / kind)
    model = ms.fit(panel, ["a", "b", "c"], kind=kind, **({"maxIter": 4} if kind == "gbt" else {"numTrees": 5}))
    ms.save(model, path, spark)
    table = ms.nodes(spark, model, path)
    got = {r.feature: r.importance for r in ms.importances(table, each_tree=kind == "forest").collect()}
    want = dict(zip(["a", "b", "c"], model.stages[-1].featureImportances.toArray(), strict=True))
    assert all(abs(got.get(k, 0.0) - v) < 1e-9 for k, v in want.items())
    # nodes are a tree: each but the roots is the child of one
    n = table.count()
    kids = table.where("left is not null").select("tree", F.explode(F.array("left", "right")).alias("node"))
    assert kids.count() == kids.distinct().count() == n - table.where("node = 0").count()


def test_walk_forward_tables(spark, panel, tmp_path):
    pred, imp, prep = ms.walk_forward(panel, ["a", "b", "c"], str(tmp_path / "w"), n=3, maxIter=3)
    assert pred.select("fold").distinct().count() == 2 and pred.count() == panel.where("label is not null and date > '2024-02-10'").count()
    assert all(abs(r.s - 1) < 1e-9 for r in imp.groupBy("fold").agg(F.sum("importance").alias("s")).collect())
    top = ms.top_features(imp, ["fold"], 2).orderBy("fold", "rank").collect()
    assert [(r.fold, r["rank"]) for r in top] == [(1, 1), (1, 2), (2, 1), (2, 2)] and top[0].feature == "a"
    assert prep.count() == 6
    _, none, _ = ms.walk_forward(panel, ["a"], str(tmp_path / "l"), n=2, kind="linear")
    assert none.count() == 0


def test_precision_recall(spark):
    rows = [("d", t, p, b) for t, p, b in (("A", 3.0, 4), ("B", 2.0, 0), ("C", 1.0, 3), ("D", None, 4), ("E", 0.5, None))] + [("e", "A", 1.0, 0)]
    df = spark.createDataFrame(rows, "date string, ticker string, prediction double, bin int")
    got = {r.date: (r.precision, r.recall, r.hits, r.relevant) for r in ms.precision_recall(df, 2, 3).collect()}
    assert got == {"d": (0.5, 0.5, 1, 2), "e": (0.0, None, 0, 1 - 1)}
