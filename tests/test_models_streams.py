"""Sequential portfolios, model metrics, fusion, and streams against their batch forms."""

import math
import random
import tempfile

from pyspark.sql import functions as F

from panelspark.operators import models as md
from panelspark.operators import sequential as sq
from panelspark.operators import trades as tr
from panelspark.streaming import fills as st


def test_dropout_steps():
    names = list("ABCDEFGH")
    assert sq.dropout_step([], names, 3, 1) == ["A", "B", "C"]
    assert sq.dropout_step(["F", "G", "H"], names, 3, 1) == ["A", "F", "G"]
    assert sq.dropout_step(["A", "B", "C"], names, 3, 1) == ["A", "B", "C"]
    assert sq.dropout_step(["A", "X"], names, 2, 1) == ["A", "B"]  # X has no score any more


def test_top_k_dropout(spark):
    rows = [(s, f"2024-01-0{d}", t, float((ord(t) * (d + 3 * (s == "b"))) % 7)) for s in "ab" for d in range(1, 6) for t in "ABCDEFG"]
    df = spark.createDataFrame(rows, "strategy string, date string, ticker string, prediction double").withColumn("date", F.to_date("date"))
    w = sq.top_k_dropout(df, 3, 1).groupBy("strategy", "date").agg(F.count("*").alias("n"), F.sum("weight").alias("s")).collect()
    assert len(w) == 10 and all(r.n == 3 and abs(r.s - 1) < 1e-12 for r in w)
    # the same as by steps over whole dates, with many more names than can be chosen
    rng = random.Random(2)
    rows = [("a", f"2024-01-{d:02d}", f"t{k:03d}", None if rng.random() < 0.1 else float(rng.randint(0, 60))) for d in range(1, 16) for k in range(80) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "strategy string, date string, ticker string, prediction double")
    held, want = [], set()
    for d in sorted({r[1] for r in rows}):
        held = sq.dropout_step(held, [t for _, _, t, p in sorted((r for r in rows if r[1] == d and r[3] is not None), key=lambda r: (-r[3], r[2]))], 4, 2)
        want |= {(d, t) for t in held}
    got = sq.top_k_dropout(df.withColumn("date", F.to_date("date")), 4, 2).collect()
    assert {(str(r.date), r.ticker) for r in got} == want


def test_ndcg_and_fusion(spark):
    rows = [("d", t, p, b) for t, p, b in (("A", 3.0, 0), ("B", 2.0, 2), ("C", 1.0, 1))]
    df = spark.createDataFrame(rows, "date string, ticker string, prediction double, bin int")
    want = (0 + 3 / math.log2(3)) / (3 + 1 / math.log2(3))
    assert abs(md.ndcg(df, 2).first().ndcg - want) < 1e-12
    w = md.adaptive_weights({"x": 0.04, "y": 0.01, "z": -0.1})
    assert abs(sum(w.values()) - 1) < 1e-12 and abs(w["x"] / w["y"] - 2) < 1e-9 and w["z"] > 0
    s = spark.createDataFrame([("d", "A", 1.0, -0.5, -0.2), ("d", "B", None, 2.0, None), ("d", "C", None, None, None)], "date string, ticker string, x double, y double, z double")
    got = {r.ticker: r.prediction for r in md.fused(s, {"x": 0.5, "y": 0.3, "z": 0.2}, vote=True).collect()}
    assert got["A"] < 0 and got["B"] == 2.0 and got["C"] is None


def test_walk_forward(spark):
    rows = [(f"2024-01-{d:02d}", f"t{t}", float(t), float((t * d) % 5), float(t) + 0.01 * d) for d in range(1, 25) for t in range(12)]
    df = spark.createDataFrame(rows, "date string, ticker string, a double, b double, label double").withColumn("date", F.to_date("date"))
    out = md.walk_forward(df, ["a", "b"], "label", 3, kind="linear").join(df, ["date", "ticker"])
    assert out.where(F.abs(F.col("prediction") - F.col("label")) > 1).count() == 0 and out.select("fold").distinct().count() == 2
    assert md.walk_forward(df, ["a", "b"], "label", 2, maxIter=2).count() == 12 * 12


def test_streams_equal_batch(spark):
    work = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    rows = [(i, f"2024-01-{1 + i // 10:02d} 10:00:{i % 60:02d}", 1.0 + i, 2.0) for i in range(40)]
    fills = spark.createDataFrame(rows, "exec_id long, t string, quantity double, price double").select("exec_id", F.to_timestamp("t").alias("time"), "quantity", "price")
    fills.repartition(2).write.parquet(f"{work}/fills")
    com = fills.where("exec_id % 2 = 0").select("exec_id", (F.col("time") + F.expr("INTERVAL 5 SECONDS")).alias("reported"), F.lit(0.5).alias("commission"))
    com.write.parquet(f"{work}/com")
    files = lambda name, like, n: st.files(spark, f"{work}/{name}", like.schema, n)

    def run(df, name, mode):
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(60)
        return spark.table(name)

    daily = run(st.daily_activity(files("fills", fills, 1), "30 days"), "daily", "complete")
    assert sorted(daily.collect()) == sorted(tr.daily_activity(fills).collect())
    seen = []
    st.refresh(files("fills", fills, 1), lambda df, k: seen.append(df.count()), f"{work}/cp").awaitTermination(60)
    assert sum(seen) == 40
    # files that come in any order: in one trigger, and one at a time within the delay
    for name, n, delay in (("joined_all", None, "10 minutes"), ("joined_each", 1, "30 days")):
        got = run(st.with_commissions(files("fills", fills, n), files("com", com, n), delay), name, "append").where("commission > 0")
        assert got.count() == 20 and got.where("exec_id % 2 <> 0").count() == 0


def test_unmatched_fills_come_once_the_watermark_has_passed(spark):
    """Files in event-time order, a short delay: late rows are none, and fills without commission get 0."""
    work = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    rows = [(i, f"2024-01-{1 + i:02d} 10:00:00", 1.0, 2.0) for i in range(8)]
    fills = spark.createDataFrame(rows, "exec_id long, t string, quantity double, price double").select("exec_id", F.to_timestamp("t").alias("time"), "quantity", "price")
    com = fills.where("exec_id % 2 = 0").select("exec_id", (F.col("time") + F.expr("INTERVAL 5 SECONDS")).alias("reported"), F.lit(0.5).alias("commission"))
    for name, df in (("fills", fills), ("com", com)):
        df.coalesce(1).write.parquet(f"{work}/{name}")
    joined = st.with_commissions(st.files(spark, f"{work}/fills", fills.schema), st.files(spark, f"{work}/com", com.schema), "10 minutes")
    joined.writeStream.outputMode("append").format("memory").queryName("passed").trigger(availableNow=True).start().awaitTermination(60)
    got = {r.exec_id: r.commission for r in spark.table("passed").collect()}
    assert {i: c for i, c in got.items() if i < 7} == {i: 0.5 * (i % 2 == 0) for i in range(6)} | {6: 0.5}
