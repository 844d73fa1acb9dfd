"""Technical indicators.

Those with a window of fixed length, and running totals, are expression trees (`window_groups`); those
that are defined by a recursion over a ticker's whole history run in one Arrow task per ticker
(`recursive`). Warm-up rows are null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelspark.functions.expr import Node, col, ew, tw

O, H, L, C, V = (col(x) for x in ("open", "high", "low", "adj_close", "volume"))
TP = (H + L + C) / 3


def lag(x, n=1):
    return tw("lag", x, n=n)


def sma(x, n):
    return tw("sma", x, n=n)


def total(x, n):
    return tw("sum", x, n=n)


def lo(x, n):
    return tw("tmin", x, n=n)


def hi(x, n):
    return tw("tmax", x, n=n)


def true_range() -> Node:
    before = lag(C)
    return ew("max", ew("max", H - L, ew("abs", H - before)), ew("abs", L - before))


def cci(n: int) -> Node:
    return (TP - sma(TP, n)) / (0.015 * tw("mad", TP, n=n))


def mfi(n: int) -> Node:
    flow = TP * V
    up, down = ew("if", TP > lag(TP), flow, 0), ew("if", TP < lag(TP), flow, 0)
    known = lag(TP) * 0  # null in the first row
    return 100 * total(up + known, n) / (total(up + known, n) + total(down + known, n))


def ultimate() -> Node:
    before = lag(C)
    low, high = ew("min", L, before) + before * 0, ew("max", H, before) + before * 0
    bp, tr = C - low, high - low
    part = lambda n: total(bp, n) / total(tr, n)
    return 100 * (4 * part(7) + 2 * part(14) + part(28)) / 7


def aroon(x: Node, op: str) -> Node:
    """100 * (14 - rows since the extreme) / 14 over 15 rows; of equal extremes the latest counts."""
    return 100 * (tw(op, x, n=15) - 1) / 14


def fast_k(n: int = 14) -> Node:
    return 100 * (C - lo(L, n)) / (hi(H, n) - lo(L, n))


def bollinger() -> dict[str, Node]:
    mid, spread = sma(C, 20), tw("stdp", C, n=20)
    up, down = mid + 2 * spread, mid - 2 * spread
    return {"bb_upper": up, "bb_middle": mid, "bb_lower": down, "bb_width": (up - down) / mid}


def body(k: int = 0) -> Node:
    return ew("abs", (lag(C, k) if k else C) - (lag(O, k) if k else O))


def _at(x, k):
    return lag(x, k) if k else x


def long_body(k: int) -> Node:
    """Whether the body k bars ago is longer than the mean body of the ten bars before it."""
    return _at(ew("abs", C - O), k) > lag(sma(ew("abs", C - O), 10), k + 1)


def red(k: int) -> Node:
    return _at(C, k) < _at(O, k)


def white(k: int) -> Node:
    return _at(O, k) < _at(C, k)


def all_of(*conditions: Node) -> Node:
    out = conditions[0]
    for c in conditions[1:]:
        out = out * c
    return out


def patterns() -> dict[str, Node]:
    """Three candle patterns as -100, 0 or 100."""
    gap_up = ew("min", _at(O, 1), _at(C, 1)) > ew("max", _at(O, 2), _at(C, 2))
    crows2 = all_of(white(2), long_body(2), red(1), gap_up, red(0), O < _at(O, 1), O > _at(C, 1), C > _at(O, 2), C < _at(C, 2))
    short_tail = lambda k: (_at(C, k) - _at(L, k)) < lag(sma(H - L, 10), k + 1) * 0.1
    crows3 = all_of(white(3), red(2), short_tail(2), red(1), short_tail(1), red(0), short_tail(0), _at(O, 1) < _at(O, 2), _at(O, 1) > _at(C, 2), O < _at(O, 1), O > _at(C, 1), _at(H, 3) > _at(C, 2), _at(C, 2) > _at(C, 1), _at(C, 1) > C)
    short = _at(ew("abs", C - O), 1) <= lag(sma(ew("abs", C - O), 10), 2)
    within = all_of(ew("max", _at(C, 1), _at(O, 1)) < ew("max", _at(C, 2), _at(O, 2)), ew("min", _at(C, 1), _at(O, 1)) > ew("min", _at(C, 2), _at(O, 2)))
    up = all_of(long_body(2), short, within, red(2), white(0), C > _at(O, 2))
    down = all_of(long_body(2), short, within, white(2), red(0), C < _at(O, 2))
    return {"cdl_2crows": -100 * crows2, "cdl_3blackcrows": -100 * crows3, "cdl_3inside": 100 * up - 100 * down}


def window_groups() -> dict[str, dict[str, Node]]:
    spread = H - L
    return {
        "ta_momentum": {"mom_10": C - lag(C, 10), "mom_20": C - lag(C, 20), "roc_10": (C / lag(C, 10) - 1) * 100, "roc_20": (C / lag(C, 20) - 1) * 100, "willr_14": -100 * (hi(H, 14) - C) / (hi(H, 14) - lo(L, 14))},
        "ta_cci_mfi": {"cci_14": cci(14), "cci_20": cci(20), "mfi_14": mfi(14), "mfi_20": mfi(20), "ultosc": ultimate()},
        "ta_bands": bollinger() | {"stddev_20": tw("stdp", C, n=20)},
        "ta_averages": {f"sma_{n}": sma(C, n) for n in (5, 10, 20, 30)} | {"wma_20": tw("wma", C, n=20), "apo": sma(C, 12) - sma(C, 26)},
        "ta_volume": {"obv": tw("total", ew("fill", ew("sign", C - lag(C)), 1) * V), "ad": tw("total", ew("fill", ((C - L) - (H - C)) / spread, 0) * V), "vwap": TP},
        "ta_aroon_stoch": {"aroon_up": aroon(H, "lastmax"), "aroon_down": aroon(L, "lastmin"), "aroonosc": aroon(H, "lastmax") - aroon(L, "lastmin"), "stochf_k": fast_k(), "stochf_d": sma(fast_k(), 3), "stoch_k": sma(fast_k(), 3), "stoch_d": sma(sma(fast_k(), 3), 3)},
        "ta_prices": {"trange": true_range(), "avgprice": (O + H + L + C) / 4, "medprice": (H + L) / 2, "typprice": TP, "wclprice": (H + L + 2 * C) / 4, "bop": ew("fill", (C - O) / spread, 0)},
        "ta_candles": patterns(),
    }


# --- recursions ------------------------------------------------------------------------------------


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean with weight 2 / (n + 1), begun by the mean of the first n values."""
    return _smooth(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean: weight 1 / n, begun by the mean of the first n values."""
    return _smooth(x, n, 1 / n)


def _smooth(x: np.ndarray, n: int, a: float) -> np.ndarray:
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(~np.isnan(x))
    if len(ok) and (first := int(ok[0])) + n <= len(x):
        y = x[first : first + n].mean()
        out[first + n - 1] = y
        for i in range(first + n, len(x)):
            y += a * (x[i] - y)
            out[i] = y
    return out


def rsi(c: np.ndarray, n: int) -> np.ndarray:
    d = np.diff(c, prepend=np.nan)
    gain, loss = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)
    both = gain + loss
    return np.where(both > 0, 100 * gain / np.where(both > 0, both, 1), np.where(np.isnan(both), np.nan, 0.0))


def directional(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Plus and minus direction, DX and ADX by Wilder's sums."""
    up, down = np.diff(h, prepend=np.nan), -np.diff(l, prepend=np.nan)
    plus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(up), np.nan, np.where((down > up) & (down > 0), down, 0.0))
    before = np.concatenate(([np.nan], c[:-1]))
    tr = np.fmax(np.fmax(h - l, np.abs(h - before)), np.abs(l - before))
    tr[:1] = np.nan
    p, m, t = wilder_sum(plus, n), wilder_sum(minus, n), wilder_sum(tr, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        pdi, mdi = np.where(t > 0, 100 * p / t, np.where(np.isnan(t), np.nan, 0)), np.where(t > 0, 100 * m / t, np.where(np.isnan(t), np.nan, 0))
        s = pdi + mdi
        dx = np.where(s > 0, 100 * np.abs(pdi - mdi) / s, np.where(np.isnan(s), np.nan, 0))
    return pdi, mdi, dx, wilder(dx, n)


def wilder_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's running sum: begun by the sum of the first n - 1 values, then s - s / n + x."""
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(~np.isnan(x))
    if len(ok) and (first := int(ok[0])) + n <= len(x):
        s = x[first : first + n - 1].sum()
        for i in range(first + n - 1, len(x)):
            s += x[i] - s / n
            out[i] = s
    return out


RECURSIVE = ("rsi_14", "rsi_6", "rsi_30", "macd", "macd_signal", "macd_hist", "ema_12", "ema_26", "dema_20", "atr_14", "atr_20", "natr_14", "adosc", "adx_14", "adx_20", "adxr_14", "dx_14", "minus_di_14", "plus_di_14")
LEAST_ROWS = 50


def one_ticker(p: pd.DataFrame) -> pd.DataFrame:
    """All recursive indicators of one ticker's bars; tickers with fewer than 50 bars give no rows."""
    p = p.dropna(subset=["high", "low", "adj_close", "volume"]).sort_values("date")
    if len(p) < LEAST_ROWS:
        none = {"date": pd.Series(dtype="object"), "ticker": pd.Series(dtype="object")}
        return pd.DataFrame(none | {k: pd.Series(dtype="float64") for k in RECURSIVE})
    h, l, c, v = (p[x].to_numpy(np.float64) for x in ("high", "low", "adj_close", "volume"))
    slow, fast = ema(c, 26), _aligned(c, 12, 26)
    macd = fast - slow
    signal = ema(macd, 9)
    macd = np.where(np.isnan(signal), np.nan, macd)
    e1 = ema(c, 20)
    before = np.concatenate(([np.nan], c[:-1]))
    tr = np.fmax(np.fmax(h - l, np.abs(h - before)), np.abs(l - before))
    tr[:1] = np.nan
    atr14, atr20 = wilder(tr, 14), wilder(tr, 20)
    spread = h - l
    ad = np.cumsum(np.where(spread > 0, ((c - l) - (h - c)) / np.where(spread > 0, spread, 1), 0) * v)
    adosc = np.full(len(c), np.nan)
    f = s = ad[0]
    for i in range(len(c)):
        f += (ad[i] - f) * 2 / 4
        s += (ad[i] - s) * 2 / 11
        if i >= 9:
            adosc[i] = f - s
    pdi, mdi, dx, adx = directional(h, l, c, 14)
    adx20 = directional(h, l, c, 20)[3]
    adxr = (adx + np.concatenate((np.full(13, np.nan), adx[:-13]))) / 2
    values = (rsi(c, 14), rsi(c, 6), rsi(c, 30), macd, signal, macd - signal, ema(c, 12), slow, 2 * e1 - ema(e1, 20), atr14, atr20, 100 * atr14 / c, adosc, adx, adx20, adxr, dx, mdi, pdi)
    return pd.DataFrame({"date": p["date"].to_numpy(), "ticker": p["ticker"].to_numpy(), **dict(zip(RECURSIVE, values, strict=True))})


def _aligned(c: np.ndarray, fast: int, slow: int) -> np.ndarray:
    """The fast mean begun so that both means start at the same row."""
    out = np.full(len(c), np.nan)
    out[slow - fast :] = ema(c[slow - fast :], fast)
    return out


def recursive(panel: DataFrame) -> DataFrame:
    """Recursive indicators, one Arrow task per ticker; a group is one ticker's history."""
    kinds = "date date, ticker string, " + ", ".join(f"{k} double" for k in RECURSIVE)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = one_ticker(p)
        return out.astype({k: "float64" for k in RECURSIVE}).where(out.notna(), None) if len(out) else out

    return panel.select("date", "ticker", "high", "low", "adj_close", "volume").groupBy("ticker").applyInPandas(run, kinds)
