"""Stateful streams, read file by file, against the batch forms."""

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelspark.operators import indicators as ti
from panelspark.operators import sequential as sq
from panelspark.streaming import fills as st
from panelspark.streaming import state as ss


def by_parts(spark, df, column, cuts, work, name):
    """Writes df in files in order of time, and reads them as a stream of one file a trigger."""
    import time

    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        df.where((F.col(column) >= a) & (F.col(column) < b)).coalesce(1).write.mode("append").parquet(f"{work}/{name}")
        time.sleep(0.05)
    return st.files(spark, f"{work}/{name}", df.schema, 1)


def collected(df, name):
    df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name).toPandas()


def test_running_indicators(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2024-01-01", periods=60).date
    rows = []
    for t in "ab":
        c = 100 + np.cumsum(rng.normal(0, 1, 60))
        rows += [(d, t, x + 1, x - 1.5, x, float(v)) for d, x, v in zip(days, c, rng.integers(1, 99, 60))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["date", "ticker", "high", "low", "close", "volume"]), "date date, ticker string, high double, low double, close double, volume double")
    stream = by_parts(spark, df, "date", ["2024-01-01", "2024-01-06", "2024-01-20", "2024-02-15", "2024-04-01"], tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp"), "bars")
    got = collected(ss.running_indicators(stream), "running").set_index(["ticker", "date"]).sort_index()
    assert len(got) == 120
    for t in "ab":
        p = df.where(F.col("ticker") == t).toPandas().sort_values("date")
        c, own = p["close"].to_numpy(), got.loc[t]
        assert np.allclose(own["ema_12"], ti.ema(c, 12), equal_nan=True) and np.allclose(own["rsi_14"], ti.rsi(c, 14), equal_nan=True)
        assert np.allclose(own["obv"], np.cumsum(np.sign(np.diff(c, prepend=c[0] - 1)) * p["volume"]))
    again = ss.Indicators()
    assert again.step(1.0, 1.0, 1.0, 5.0) == (None, None, 5.0, 0.0)


def test_running_holdings(spark):
    rows = [(s, f"2024-01-{d:02d}", t, None if t == "G" and d == 3 else float((ord(t) * (d + 3 * (s == "b"))) % 7)) for s in "ab" for d in range(1, 13) for t in "ABCDEFG"]
    df = spark.createDataFrame(rows, "strategy string, date string, ticker string, prediction double").withColumn("date", F.to_date("date"))
    stream = by_parts(spark, df, "date", ["2024-01-01", "2024-01-03", "2024-01-07", "2024-02-01"], tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp"), "scores")
    got = collected(ss.running_holdings(stream, 3, 1), "holdings")
    want = sq.top_k_dropout(df, 3, 1).toPandas()
    key = lambda x: sorted(map(tuple, x[["strategy", "date", "ticker", "weight"]].astype(str).to_numpy()))
    assert key(got) == key(want) and len(got) == 2 * 12 * 3
