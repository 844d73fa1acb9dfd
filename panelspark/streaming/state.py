"""Streams that carry small state: indicators per ticker, holdings per strategy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelspark.operators.sequential import dropout_step

EMA_DAYS, RSI_DAYS = 12, 14


class Indicators:
    """Running values of one ticker: the exponential mean of 12 closes, RSI of 14 (Wilder), on-balance volume
    and the accumulation line. A step costs the same however long the history is."""

    def __init__(self, state: tuple | None = None):
        names = ("n", "close", "ema", "gain", "loss", "obv", "ad", "last")
        self.__dict__.update(zip(names, state or (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "")))

    def state(self) -> tuple:
        return self.n, self.close, self.ema, self.gain, self.loss, self.obv, self.ad, self.last

    def step(self, high: float, low: float, close: float, volume: float) -> tuple[float | None, float | None, float, float]:
        d = close - self.close
        self.n += 1
        n = self.n
        # the first values make a plain mean, later ones are weighed in
        self.ema += (close - self.ema) * (1 / n if n <= EMA_DAYS else 2 / (EMA_DAYS + 1))
        if n > 1:
            a = 1 / min(n - 1, RSI_DAYS)
            self.gain += (max(d, 0.0) - self.gain) * a
            self.loss += (max(-d, 0.0) - self.loss) * a
        self.obv += volume if n == 1 else volume * ((d > 0) - (d < 0))
        spread = high - low
        self.ad += ((close - low) - (high - close)) / spread * volume if spread > 0 else 0.0
        self.close = close
        both = self.gain + self.loss
        rsi = None if n <= RSI_DAYS else 100 * self.gain / both if both > 0 else 0.0
        return self.ema if n >= EMA_DAYS else None, rsi, self.obv, self.ad


INDICATORS = "date date, ticker string, ema_12 double, rsi_14 double, obv double, ad double"


def running_indicators(bars: DataFrame) -> DataFrame:
    """date, ticker, ema_12, rsi_14, obv, ad of a stream of bars (date, ticker, high, low, close, volume), in
    order of date within a trigger. A bar that isn't later than the ticker's last one is ignored, and so is one
    with a null; give bars in order, or a backlog in one trigger."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one = Indicators(state.get if state.exists else None)
        rows = []
        for r in pd.concat(list(batches)).dropna().sort_values("date").itertuples(index=False):  # one trigger's bars of a ticker
            day = str(r.date)
            if day > one.last:
                rows.append((r.date, key[0], *one.step(r.high, r.low, r.close, r.volume)))
                one.last = day
        state.update(one.state())
        yield pd.DataFrame(rows, columns=["date", "ticker", "ema_12", "rsi_14", "obv", "ad"]).astype({c: "float64" for c in ("ema_12", "rsi_14", "obv", "ad")})

    kept = "n long, close double, ema double, gain double, loss double, obv double, ad double, last string"
    own = bars.select(F.col("date").cast("date").alias("date"), "ticker", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")))
    return own.groupBy("ticker").applyInPandasWithState(run, INDICATORS, kept, "append", GroupStateTimeout.NoTimeout)


def running_holdings(scores: DataFrame, k: int, n_drop: int) -> DataFrame:
    """strategy, date, ticker, weight of top-k with dropout over a stream of scores (strategy, date, ticker,
    prediction). Each strategy's state is its last date and the names it holds. All scores of a date must come
    in one trigger; a date that isn't later than the last one is ignored, as are null scores."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else ("", [])
        held, rows = list(held), []
        for day, p in pd.concat(list(batches)).dropna(subset=["date", "prediction"]).groupby("date", sort=True):
            if str(day) > last:
                held = dropout_step(held, p.sort_values(["prediction", "ticker"], ascending=[False, True])["ticker"].tolist(), k, n_drop)
                last = str(day)
                rows += [(key[0], day, t, 1.0 / len(held)) for t in held]
        state.update((last, held))
        yield pd.DataFrame(rows, columns=["strategy", "date", "ticker", "weight"]).astype({"weight": "float64"})

    own = scores.select("strategy", F.col("date").cast("date").alias("date"), "ticker", F.col("prediction").cast("double").alias("prediction"))
    return own.groupBy("strategy").applyInPandasWithState(run, "strategy string, date date, ticker string, weight double", "last string, held array<string>", "append", GroupStateTimeout.NoTimeout)
