"""Stores by date, the refresh job over them, and bucketed tables."""

import glob
import os

from pyspark.sql import functions as F

from panelspark.functions import expr as ex
from panelspark.operators import alphas as al
from panelspark.plans import jobs
from panelspark.sources import stores


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/day=*/*.parquet")}


def rows(spark, days, tickers="AB", add=0.0):
    data = [(f"2024-01-{d:02d}", t, d + add + ord(t) / 100) for d in days for t in tickers]
    return spark.createDataFrame(data, "date string, ticker string, x double").withColumn("date", F.to_date("date"))


def read(df):
    return sorted((str(r.date), r.ticker, r.x) for r in df.collect())


def test_replace_and_upsert_touch_their_dates_only(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "s"))
    assert not s.exists()
    s.upsert(rows(spark, range(1, 6)))
    assert s.exists() and read(s.read()) == read(rows(spark, range(1, 6)))
    before = files(s.path)
    assert len(before) == 5
    s.replace(rows(spark, [3], "C", 0.5))
    after = files(s.path)
    changed = set(before.items()) ^ set(after.items())
    assert {f.split("day=")[1][:10] for f, _ in changed} == {"2024-01-03"}
    assert read(s.read("2024-01-03", "2024-01-03")) == [("2024-01-03", "C", 4.17)]
    s.upsert(rows(spark, [2, 7], "BC", 9))
    want = [("2024-01-02", t, x) for t, x in (("A", 2.65), ("B", 11.66), ("C", 11.67))]
    assert read(s.read("2024-01-02", "2024-01-02")) == want and read(s.read("2024-01-06")) == read(rows(spark, [7], "BC", 9))
    kept = {f: t for f, t in files(s.path).items() if "01-02" not in f and "01-07" not in f}
    assert kept == {f: t for f, t in after.items() if "01-02" not in f}
    s.add_missing(rows(spark, [1, 8], "Z"))
    assert s.read("2024-01-01", "2024-01-01").where("ticker = 'Z'").count() == 0 and s.read("2024-01-08").count() == 1
    s.replace(rows(spark, []))
    assert s.dates().count() == 7


def test_new_columns(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "s"))
    s.replace(rows(spark, [1, 2]))
    s.upsert(rows(spark, [2], "B").withColumn("y", F.lit(1)))
    got = {(r.date.day, r.ticker): (round(r.x, 9), r.y) for r in s.read().collect()}
    assert got == {(1, "A"): (1.65, None), (1, "B"): (1.66, None), (2, "A"): (2.65, None), (2, "B"): (2.66, 1)}


def test_span_comes_from_the_footers(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "s"))
    s.replace(rows(spark, range(2, 12)))
    span = s.span()
    r = span.first()
    assert (str(r.first), str(r["last"]), r.rows) == ("2024-01-02", "2024-01-11", 20) or (str(r["first"]), str(r["last"]), r["rows"]) == ("2024-01-02", "2024-01-11", 20)
    plan = span._jdf.queryExecution().toString()
    assert "PushedAggregation: [MIN(date), MAX(date), COUNT(*)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_folders_are_pruned(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "s"))
    s.replace(rows(spark, range(1, 20)))
    plan = s.read("2024-01-10", "2024-01-12")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and len(s.read("2024-01-10", "2024-01-12").inputFiles()) == 19  # listed; the scan reads three


def test_refresh_job(spark, tmp_path):
    data = [(f"2024-{m:02d}-{d:02d}", f"t{k}", float((d * 7 + k * (3 + d % 4) + 3 * m) % 11 + 1)) for m in (1, 2) for d in range(1, 21) for k in range(12)]
    panel = spark.createDataFrame(data, "date string, ticker string, close double").withColumn("date", F.to_date("date"))
    panel = panel.select("date", "ticker", *(F.col("close").alias(c) for c in ("open", "high", "low", "close", "adj_close")), F.lit(1.0).alias("volume"))
    trees = {"mom": al.C / al.lag(5, al.C) - 1, "sd": al.sd(6, al.r)}
    factors, ics = stores.Store(spark, str(tmp_path / "f")), stores.Store(spark, str(tmp_path / "i"))
    jobs.update_stores(panel.where("date < '2024-02-01'"), trees, factors, ics, 10)
    old = files(factors.path)
    assert len(old) == 20
    assert ics.read("2024-01-20").where("ic is not null").count() == 0
    jobs.update_stores(panel, trees, factors, ics, 10)
    new = files(factors.path)
    assert {f: t for f, t in new.items() if f in old} == old and len(new) == 40
    want = ex.evaluate(panel, trees).select("date", "ticker", "mom", "sd")
    assert sorted(map(repr, factors.read().select("date", "ticker", "mom", "sd").collect())) == sorted(map(repr, want.collect()))
    # the last date of the first run has its next return now
    assert ics.read("2024-01-20", "2024-01-20").where("ic is not null").count() == 2
    first = sorted(map(repr, ics.read().collect()))
    jobs.update_stores(panel, trees, factors, ics, 10)
    assert files(factors.path) == new and sorted(map(repr, ics.read().collect())) == first
    jobs.update_stores(panel, trees, factors, ics, 10, "2024-02-03", "2024-02-04", force=True)
    forced = files(factors.path)
    assert {f.split("day=")[1][:10] for f, _ in set(new.items()) ^ set(forced.items())} == {"2024-02-03", "2024-02-04"}
    assert sorted(map(repr, factors.read().select("date", "ticker", "mom", "sd").collect())) == sorted(map(repr, want.collect()))


def test_bucketed_table_needs_no_exchange(spark, tmp_path):
    t = stores.bucketed(rows(spark, range(1, 20), "ABCDEFG"), "bucketed_prices", 4, str(tmp_path / "t"))
    w = spark.sql("SELECT date, ticker, sum(x) OVER (PARTITION BY ticker ORDER BY date) AS s, lag(x) OVER (PARTITION BY ticker ORDER BY date) AS l FROM bucketed_prices")
    both = t.join(t.groupBy("ticker").agg(F.max("x").alias("m")), "ticker")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for df in (w, both):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    assert w.count() == both.count() == 19 * 7
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
