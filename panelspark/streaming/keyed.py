"""Streams whose rows wait in state until their date is complete, by event-time timers.

Rows may come in any order and in any number of triggers. They wait, in the state store, until the watermark has passed
their date; then a timer takes the waiting dates in order. What comes later than the watermark is left out by
Spark and counted (late_rows). State begins with a batch table and ends where a key has been idle for long.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelspark.operators.sequential import dropout_step

from .state import INDICATORS, Indicators

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = "n long, close double, ema double, gain double, loss double, obv double, ad double, last string"
DAY_MS = 86_400_000


def use_rocks(spark: SparkSession) -> None:
    """State in RocksDB, on the executors' disks and with a log of changes in the checkpoint: state isn't bounded by
    their heaps. The timers of this module need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def late_rows(query) -> int:
    """Rows of a query that came after the watermark and were left out, over the progress reports that the query still has."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def millis(day: str) -> int:
    return (dt.date.fromisoformat(day) - dt.date(1970, 1, 1)).days * DAY_MS


class Waiting(StatefulProcessor):
    """Rows wait under (day, name) until the watermark has passed the day; released() then gets each day's rows in order.

    A key has one timer for each waiting day; the first that fires takes all days that have passed. A key that had no
    new day for `idle` days of event time loses its state.
    """

    values = ""
    out = ""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day string, name string", self.values)
        self.open_state(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        days = set()
        for p in rows:
            for r in p.itertuples(index=False):
                if not any(v is None or v != v for v in r):
                    day = r.time.date().isoformat()
                    self.waiting.updateValue((day, self.name_of(r)), self.value_of(r))
                    days.add(day)
        known = set(self.handle.listTimers())
        for at in {millis(d) + DAY_MS for d in days} - known:
            self.handle.registerTimer(at)
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        ready: dict[str, dict] = {}
        left = False
        for (day, name), value in self.waiting.iterator():
            if millis(day) + DAY_MS <= passed:
                ready.setdefault(day, {})[name] = value
            else:
                left = True
        found = []
        for day in sorted(ready):
            found += self.released(key, day, ready[day])
            for name in ready[day]:
                self.waiting.removeKey((day, name))
        if self.idle is not None:
            if ready:
                self.handle.registerTimer(millis(max(ready)) + (1 + self.idle) * DAY_MS)
            elif not left and self.last_day() and millis(self.last_day()) + (1 + self.idle) * DAY_MS <= passed:
                self.forget()
        yield self.frame(found)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        kinds = dict(c.split(" ") for c in self.out.split(", "))
        df = pd.DataFrame(rows, columns=list(kinds))
        return df.astype({c: "float64" for c, k in kinds.items() if k == "double"})

    def close(self) -> None:
        pass


class BarIndicators(Waiting):
    values = "high double, low double, close double, volume double"
    out = INDICATORS

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", KEPT)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[0]
        self.kept.update((int(r["n"]), *(float(r[c]) for c in ("close", "ema", "gain", "loss", "obv", "ad")), str(r["last"])))

    def name_of(self, r) -> str:
        return ""

    def value_of(self, r) -> tuple:
        return r.high, r.low, r.close, r.volume

    def last_day(self) -> str:
        return self.kept.get()[-1] if self.kept.exists() else ""

    def forget(self) -> None:
        self.kept.clear()

    def released(self, key: tuple, day: str, rows: dict) -> list[tuple]:
        one = Indicators(tuple(self.kept.get()) if self.kept.exists() else None)
        if day <= one.last:  # the initial state has it
            return []
        values = one.step(*rows[""])
        one.last = day
        self.kept.update(one.state())
        return [(dt.date.fromisoformat(day), key[0], *values)]


def indicators(bars: DataFrame, delay: str, history: DataFrame | None = None, idle: int | None = None) -> DataFrame:
    """date, ticker, ema_12, rsi_14, obv, ad of a stream of bars (date, ticker, high, low, close, volume), each when the
    watermark (`delay` behind the latest date) has passed its date. The last of several bars of a date counts; bars with
    a null are left out.

    history: a batch table of the state (ticker and the columns of KEPT, as state_of() makes it) that tickers begin
    with; bars of its dates are ignored. idle: days after which a ticker without bars loses its state.
    """
    own = bars.select(F.col("date").cast("timestamp").alias("time"), "ticker", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")))
    first = None if history is None else history.groupBy("ticker")
    return own.withWatermark("time", delay).groupBy("ticker").transformWithStateInPandas(BarIndicators(idle), INDICATORS, "append", "eventtime", first)


def state_of(bars: DataFrame) -> DataFrame:
    """ticker and the columns of KEPT after all bars of a batch table: the initial state of a stream that follows it. A task
    holds one ticker's bars."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        one = Indicators()
        for r in p.dropna().sort_values("date").itertuples(index=False):
            one.step(r.high, r.low, r.close, r.volume)
            one.last = str(r.date)
        return pd.DataFrame([(p["ticker"].iloc[0], *one.state())], columns=["ticker", *(c.split(" ")[0] for c in KEPT.split(", "))])

    own = bars.select(F.col("date").cast("date").alias("date"), "ticker", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")))
    return own.groupBy("ticker").applyInPandas(run, f"ticker string, {KEPT}")


class Holdings(Waiting):
    values = "prediction double"
    out = "strategy string, date date, ticker string, weight double"

    def __init__(self, k: int, n_drop: int, idle: int | None = None):
        super().__init__(idle)
        self.k, self.n_drop = k, n_drop

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "last string, held array<string>")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[0]
        self.kept.update((str(r["last"]), list(r["held"])))

    def name_of(self, r) -> str:
        return r.ticker

    def value_of(self, r) -> tuple:
        return (r.prediction,)

    def last_day(self) -> str:
        return self.kept.get()[0] if self.kept.exists() else ""

    def forget(self) -> None:
        self.kept.clear()

    def released(self, key: tuple, day: str, rows: dict) -> list[tuple]:
        last, held = self.kept.get() if self.kept.exists() else ("", [])
        if day <= last:
            return []
        held = dropout_step(list(held), sorted(rows, key=lambda t: (-rows[t][0], t)), self.k, self.n_drop)
        self.kept.update((day, held))
        return [(key[0], dt.date.fromisoformat(day), t, 1.0 / len(held)) for t in held]


def holdings(scores: DataFrame, k: int, n_drop: int, delay: str, history: DataFrame | None = None, idle: int | None = None) -> DataFrame:
    """strategy, date, ticker, weight of top-k with dropout over a stream of scores (strategy, date, ticker, prediction). A date
    is taken when the watermark has passed it, so its scores may come in several triggers. history: strategy, last, held
    that strategies begin with."""
    own = scores.select(F.col("date").cast("timestamp").alias("time"), "strategy", "ticker", F.col("prediction").cast("double").alias("prediction"))
    first = None if history is None else history.groupBy("strategy")
    return own.withWatermark("time", delay).groupBy("strategy").transformWithStateInPandas(Holdings(k, n_drop, idle), Holdings.out, "append", "eventtime", first)
