"""Portfolios whose weights depend on the ones before: top-k with dropout. Parallel over strategies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dropout_step(held: list[str], scores: list[str], k: int, n_drop: int) -> list[str]:
    """Next holdings. scores: names from best to worst. Of the held names and the best new candidates
    together, held ones among the n_drop worst are sold; the best unheld names fill up to k."""
    place = {t: i for i, t in enumerate(scores)}
    last = [t for t in held if t in place]
    fresh = [t for t in scores if t not in set(last)]
    today = fresh[: n_drop + k - len(last)]
    both = sorted(last + today, key=place.__getitem__)
    worst = set(both[-n_drop:]) if n_drop else set()
    sold = {t for t in last if t in worst}
    kept = [t for t in last if t not in sold]
    bought = [t for t in today if t not in sold][: max(0, len(sold) + k - len(last))]
    return sorted(kept + bought, key=place.__getitem__)[:k]


def top_k_dropout(scores: DataFrame, k: int = 50, n_drop: int = 5) -> DataFrame:
    """strategy, date, ticker, weight; ties in score go by ticker, null scores are left out. The holdings are
    carried from date to date, so a strategy is one group, but of its rows only those of names that were
    among the 2k + n_drop best on that date or before: no other name can be held or bought."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        held: list[str] = []
        rows = []
        for date, day in p.dropna(subset=["prediction"]).groupby("date", sort=True):
            order = day.sort_values(["prediction", "ticker"], ascending=[False, True])["ticker"].tolist()
            held = dropout_step(held, order, k, n_drop)
            rows += [(p["strategy"].iloc[0], date, t, 1.0 / len(held)) for t in held]
        out = pd.DataFrame(rows, columns=["strategy", "date", "ticker", "weight"])
        return out.astype({"weight": "float64"})

    ranked = scores.where("prediction is not null").select("strategy", "date", "ticker", "prediction", F.row_number().over(Window.partitionBy("strategy", "date").orderBy(F.desc("prediction"), "ticker")).alias("_r"))
    past = Window.partitionBy("strategy", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    able = ranked.withColumn("_b", F.min("_r").over(past)).where(F.col("_b") <= 2 * k + n_drop)
    return able.select("strategy", "date", "ticker", "prediction").groupBy("strategy").applyInPandas(one, "strategy string, date date, ticker string, weight double")
