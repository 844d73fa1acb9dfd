"""Queries over factor expressions: primitives, the formulaic signals, composites and window indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.functions.expr import Node, col, dw, evaluate, ew, rounded, to_sql, tw
from panelspark.operators import alphas as al
from panelspark.operators import indicators as ti
from panelspark.sources.panel import bars, densify, grid_sql


def _query(factors: dict[str, Node], ticker: str = "p_brand"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(evaluate(densify(bars(spark, sf_dir, ticker)), factors), list(factors))

    return run, to_sql(grid_sql(ticker), factors)


def primitives() -> dict[str, dict[str, Node]]:
    C, V, H = col("close"), col("volume"), col("high")
    return {
        "ts_sums_means": {"ts_sum5": tw("sum", C, n=5), "sma20": tw("sma", V, n=20), "stddev20": tw("std", C, n=20), "ts_min10": tw("tmin", C, n=10), "ts_max10": tw("tmax", H, n=10), "delta3": tw("delta", C, n=3), "delay2": tw("lag", C, n=2), "pct_change1": C / tw("lag", C, n=1) - 1},
        "ts_pairs": {"correlation10": tw("corr", C, V, n=10), "covariance10": tw("cov", C / 1000, H / 1000, n=10)},
        "ts_ordered": {"ts_rank9": tw("tsrank", C, n=9), "ts_argmax8": tw("argmax", C, n=8), "ts_argmin8": tw("argmin", C, n=8), "product3": tw("product", C / 1000, n=3), "decay_linear10": al.dl(10, C), "ffill_close": tw("ffill", C)},
        "cs_rank_scale": {"rank_close": dw("rank", C), "rank_volume": dw("rank", V), "scale_compat": tw("scale", C), "scale_paper": dw("day_scale", C), "day_mean_close": dw("day_mean", C)},
        "elementwise": {"abs_x": ew("abs", C - H), "sign_x": ew("sign", C - H), "log_v": ew("log", V), "root_c": C**0.5, "if_x": ew("if", C < H, C, H), "zero_to_x": ew("zero_to", C - H, 0.0001)},
    }


def composites() -> dict[str, Node]:
    """Five momentum and liquidity composites."""
    C, V, H, L, E = al.C, al.V, al.H, al.L, al.E
    return {
        "custom_rs": C / dw("day_mean", C) - 1,
        "custom_lar": al.r * V / (al.m(20, V) + E),
        "custom_pms": (C / al.lag(5, C) - 1) * (C / al.lag(20, C) - 1),
        "custom_var": (al.FILLED / al.lag(20, al.FILLED) - 1) / (al.sd(20, al.r) + E),
        "custom_ppf": (C - al.mn(20, L)) / (al.mx(20, H) - al.mn(20, L) + E),
    }


def entries() -> dict[str, tuple]:
    out = {name: _query(f) for name, f in primitives().items()}
    out["cs_rank_gappy"] = _query({"rank_close": dw("rank", al.C), "sma5": al.m(5, al.C), "delta1": al.d(1, al.C)}, "l_suppkey")
    signals = al.alphas()
    # the power of two unbounded terms: shown on a log scale
    signals["alpha084"] = ew("sign", signals["alpha084"]) * ew("log", 1 + ew("abs", signals["alpha084"]))
    names = list(signals)
    for k in range(0, len(names), 5):
        group = {n: signals[n] for n in names[k : k + 5]}
        out[f"alphas_{names[k][-3:]}_{list(group)[-1][-3:]}"] = _query(group)
    paper = al.alphas("paper")
    differ = [n for n in names if n != "alpha084" and repr(paper[n]) != repr(signals[n])]
    for k in range(0, len(differ), 4):
        group = {n: paper[n] for n in differ[k : k + 4]}
        out[f"alphas_paper_{differ[k][-3:]}_{list(group)[-1][-3:]}"] = _query(group)
    out["custom_composites"] = _query(composites())
    for name, group in ti.window_groups().items():
        out[name] = _query(group)
    return out
