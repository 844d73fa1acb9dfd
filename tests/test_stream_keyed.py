"""Streams with timers and an initial state against their batch forms, over restarts and late rows."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import sequential as sq
from panelspark.streaming import fills as st
from panelspark.streaming import keyed
from panelspark.streaming.state import Indicators

BARS = "date date, ticker string, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def stream(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.use_rocks(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def bars_of(rng, days, tickers):
    rows = []
    for d in range(1, days + 1):
        for t in tickers:
            c = rng.randint(5, 50) / 2
            rows.append((f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", t, c + 1, c - 1.5, c + rng.choice([-1, 0, 0.5]), float(rng.randint(1, 9))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS.replace("date date", "date string")).withColumn("date", F.to_date("date"))


def expected(rows):
    out, state = {}, {}
    for d, t, h, lo, c, v in sorted(rows):
        out[d, t] = state.setdefault(t, Indicators()).step(h, lo, c, v)
    return out


def drain(df, out, checkpoint):
    q = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_indicators_over_restarts(stream, tmp_path):
    """Shuffled bars over several files and three runs of the query give what all bars in order give."""
    rng = random.Random(4)
    rows = bars_of(rng, 40, "ABC")
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    late = []
    for part in range(4):
        own = rows[part * 30 : part * 30 + 30]
        rng.shuffle(own)
        for half in (own[:13], own[13:]):
            frame(stream, half).coalesce(1).write.mode("append").parquet(src)
        if part == 2:  # long past the delay
            late = [(rows[0][0], "A", 1.0, 1.0, 1.0, 1.0)] * 2
            frame(stream, late).coalesce(1).write.mode("append").parquet(src)
        q = drain(keyed.indicators(st.files(stream, src, frame(stream, []).schema, 1), "15 days"), out, cp)
        if part == 2:
            assert keyed.late_rows(q) == 2
    frame(stream, [("2025-06-01", "Z", 1.0, 1.0, 1.0, 1.0)]).write.mode("append").parquet(src)
    drain(keyed.indicators(st.files(stream, src, frame(stream, []).schema, 1), "15 days"), out, cp)
    got = {(str(r.date), r.ticker): (r.ema_12, r.rsi_14, r.obv, r.ad) for r in stream.read.parquet(out).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_indicators_begin_with_a_batch(stream, tmp_path):
    rows = bars_of(random.Random(7), 40, "AB")
    split = rows[49][0]
    history = keyed.state_of(frame(stream, [r for r in rows if r[0] <= split]))
    src = str(tmp_path / "in")
    # the last days of the history come once more
    again = sorted({r[0] for r in rows if r[0] <= split})[-3:]
    frame(stream, [r for r in rows if r[0] > split or r[0] in again] + [("2025-06-01", "Z", 1.0, 1.0, 1.0, 1.0)]).coalesce(1).write.parquet(src)
    drain(keyed.indicators(st.files(stream, src, frame(stream, []).schema), "1 day", history), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(str(r.date), r.ticker): (r.ema_12, r.rsi_14, r.obv, r.ad) for r in stream.read.parquet(str(tmp_path / "out")).collect()}
    want = {k: v for k, v in expected(rows).items() if k[0] > split}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_idle_tickers_are_forgotten(stream, tmp_path):
    """After more than `idle` days without a bar a ticker begins anew."""
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    first = [(f"2024-01-{d:02d}", "A", 2.0, 1.0, float(d), 1.0) for d in range(1, 15)]
    clock = [("2024-03-01", "Z", 2.0, 1.0, 1.0, 1.0)]
    again = [("2024-03-02", "A", 2.0, 1.0, 9.0, 4.0), ("2024-05-01", "Z", 2.0, 1.0, 1.0, 1.0)]
    for part in (first, clock, again):
        frame(stream, part).coalesce(1).write.mode("append").parquet(src)
        drain(keyed.indicators(st.files(stream, src, frame(stream, []).schema, 1), "0 days", idle=20), out, cp)
    got = {(str(r.date), r.ticker): r for r in stream.read.parquet(out).collect()}
    assert got["2024-01-14", "A"].obv == 14 and got["2024-01-14", "A"].ema_12 is not None
    assert got["2024-03-02", "A"].obv == 4 and got["2024-03-02", "A"].ema_12 is None


def test_holdings_in_pieces(stream, tmp_path):
    """A date's scores come in several triggers; the portfolio is that of the batch operator."""
    rng = random.Random(3)
    kinds = "strategy string, date string, ticker string, prediction double"
    rows = [(s, f"2024-01-{d:02d}", f"t{k:02d}", float(rng.randint(0, 40))) for d in range(1, 21) for s in "ab" for k in range(12) if rng.random() < 0.9]
    df = stream.createDataFrame(rows, kinds).withColumn("date", F.to_date("date"))
    src = str(tmp_path / "in")
    own = list(rows)
    rng.shuffle(own)
    for part in range(3):
        stream.createDataFrame(own[part::3], kinds).withColumn("date", F.to_date("date")).coalesce(1).write.mode("append").parquet(src)
    stream.createDataFrame([("z", "2025-01-01", "t", 1.0)], kinds).withColumn("date", F.to_date("date")).coalesce(1).write.mode("append").parquet(src)
    drain(keyed.holdings(st.files(stream, src, df.schema, 1), 4, 2, "30 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.strategy, str(r.date), r.ticker, r.weight) for r in stream.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.strategy, str(r.date), r.ticker, r.weight) for r in sq.top_k_dropout(df, 4, 2).collect()}
