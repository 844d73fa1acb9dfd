"""Walk-forward models with Spark ML, their metrics, and the fusion of several scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diagnostics import date_chunks


def folds(panel: DataFrame, n: int = 4) -> DataFrame:
    """panel with chunk: fold i trains on chunks 0..i-1 and tests on chunk i."""
    return panel.join(date_chunks(panel, n), "date")


def walk_forward(panel: DataFrame, features: list[str], label: str, n: int = 4, kind: str = "gbt", **params) -> DataFrame:
    """date, ticker, prediction, fold of every test fold. The last tenth of the training dates is the
    validation part of boosted trees (early stop). Rows with a null label or feature are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(folds(panel, n).dropna(subset=[label, *features]))
    out = None
    for fold in range(1, n):
        train, test = rows.where(F.col("chunk") < fold), rows.where(F.col("chunk") == fold)
        if kind == "gbt":
            dates = train.select("date").distinct().withColumn("_p", F.percent_rank().over(Window.orderBy("date")))  # one row per date
            train = train.join(F.broadcast(dates), "date").withColumn("held", F.col("_p") > 0.9)
            model = GBTRegressor(labelCol=label, validationIndicatorCol="held", **({"maxIter": 20, "maxDepth": 4, "seed": 1} | params))
        elif kind == "forest":
            model = RandomForestRegressor(labelCol=label, **({"numTrees": 20, "seed": 1} | params))
        else:
            model = LinearRegression(labelCol=label, **params)
        scored = model.fit(train).transform(test).select("date", "ticker", "prediction", F.lit(fold).alias("fold"))
        out = scored if out is None else out.unionAll(scored)
    return out


def ndcg(scores: DataFrame, k: int, gain: str = "bin") -> DataFrame:
    """date, ndcg: discounted gain 2^bin - 1 of the k best by prediction, against the best order."""
    got = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("prediction"), "ticker"))
    best = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(gain), "ticker"))
    x = scores.where(F.col(gain).isNotNull() & F.col("prediction").isNotNull()).withColumn("_r", got).withColumn("_b", best)
    dcg = lambda r: F.sum(F.when(F.col(r) <= k, (F.pow(F.lit(2.0), F.col(gain)) - 1) / F.log2(F.col(r) + 1)))
    return x.groupBy("date").agg(F.try_divide(dcg("_r"), dcg("_b")).alias("ndcg"))


def adaptive_weights(performance: dict[str, float], floor: float = 0.05) -> dict[str, float]:
    """Weights by the root of performance over the best, at least the floor, summing to 1."""
    top = max(performance.values(), default=0.0)
    raw = {k: max(floor, (max(v, 0.0) / top) ** 0.5 if top > 0 else 0.0) for k, v in performance.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def fused(scores: DataFrame, weights: dict[str, float], vote: bool = False) -> DataFrame:
    """date, ticker, prediction from one column per model: the weighted mean, or with vote its size with
    the sign of the majority (ties by the weighted mean's sign). A row without any score is null."""
    known: list[Column] = [F.when(F.col(m).isNotNull(), F.lit(w)) for m, w in weights.items()]
    total = sum((F.coalesce(k, F.lit(0.0)) for k in known), F.lit(0.0))
    mean = F.try_divide(sum((F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in weights.items()), F.lit(0.0)), total)
    if not vote:
        return scores.select("date", "ticker", mean.alias("prediction"))
    signs = sum((F.coalesce(F.signum(m), F.lit(0.0)) for m in weights), F.lit(0.0))
    return scores.select("date", "ticker", (F.when(signs != 0, F.signum(signs)).otherwise(F.signum(mean)) * F.abs(mean)).alias("prediction"))
