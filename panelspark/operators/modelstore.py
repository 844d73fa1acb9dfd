"""Models that are fitted once, saved with all they need, and scored in another session.

A saved model is one Spark ML pipeline: gaps filled by the training medians, columns standardised by the training
moments, the assembled vector, the regressor. Its feature list is saved beside it as a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cleaning import enough_rows
from .models import folds
from .selection import date_range

#: Suffix of the prepared columns.
READY = "__x"


class _Prepared(HasInputCols):
    scale = Param(Params._dummy(), "scale", "whether columns are centred and divided by their spread", typeConverter=TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(scale=True)


class FillScaleModel(Model, _Prepared, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a prepared column, named with READY, for each input column."""

    medians = Param(Params._dummy(), "medians", "a column's fill value", typeConverter=TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean of the filled column", typeConverter=TypeConverters.toListFloat)
    sds = Param(Params._dummy(), "sds", "population spread of the filled column, 1 where it is 0", typeConverter=TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scale = self.getOrDefault(self.scale)
        moments = zip(self.getInputCols(), *(self.getOrDefault(p) for p in (self.medians, self.means, self.sds)), strict=True)
        ready = {}
        for c, median, mean, sd in moments:
            x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(median))
            ready[c + READY] = (x - mean) / sd if scale else x
        return dataset.withColumns(ready)

    def table(self, spark: SparkSession) -> DataFrame:
        """ord, feature, median, mean, sd."""
        rows = zip(range(len(self.getInputCols())), self.getInputCols(), *(self.getOrDefault(p) for p in (self.medians, self.means, self.sds)), strict=True)
        return spark.createDataFrame(list(rows), "ord int, feature string, median double, mean double, sd double")


class FillScale(Estimator, _Prepared, DefaultParamsReadable, DefaultParamsWritable):
    """Learns exact medians, and the moments of the columns with their gaps filled, in one aggregate over the
    rows it is fitted on: give it training dates only. A column without any value is filled with 0."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, scale: bool = True):  # noqa: N803
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FillScaleModel:
        columns = self.getInputCols()
        known = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
        aggs = [f(x).alias(f"{n}{k}") for k, x in enumerate(known) for n, f in (("median", F.median), ("mean", F.avg), ("var", F.var_pop), ("n", F.count))]
        row = dataset.agg(F.count("*").alias("rows"), *aggs).first()
        medians, means, sds = [], [], []
        for k in range(len(columns)):
            n, rows = row[f"n{k}"], max(1, row["rows"])
            median, mean, var = (row[f"{c}{k}"] or 0.0 for c in ("median", "mean", "var"))
            share = n / rows  # the filled rows are a group at the median
            whole = share * mean + (1 - share) * median
            spread = (share * (var + (mean - whole) ** 2) + (1 - share) * (median - whole) ** 2) ** 0.5
            medians.append(median)
            means.append(whole)
            sds.append(spread if spread > 1e-12 else 1.0)
        made = FillScaleModel()._resetUid(self.uid)
        return made._set(inputCols=columns, scale=self.getOrDefault(self.scale), medians=medians, means=means, sds=sds)


def with_held(rows: DataFrame, share: float) -> DataFrame:
    """rows with `held`: whether the date is among the last `share` of the dates, by which boosting stops."""
    dates = rows.select("date").distinct().withColumn("held", F.percent_rank().over(Window.orderBy("date")) > 1 - share)  # one row per date
    return rows.join(F.broadcast(dates), "date")


def fit(rows: DataFrame, features: list[str], label: str = "label", kind: str = "gbt", held: float = 0.1, **params) -> PipelineModel:
    """The fitted pipeline over rows with a label. The last `held` of the dates only stop the boosting of kind
    `gbt`: medians, moments and trees come from the dates before. `forest` and `linear` use all dates."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    known = rows.where(F.col(label).isNotNull())
    known = with_held(known, held) if kind == "gbt" else known.withColumn("held", F.lit(False))
    ready = FillScale(inputCols=features).fit(known.where("not held"))
    vector = VectorAssembler(inputCols=[c + READY for c in features], outputCol="features")
    if kind == "gbt":
        model = GBTRegressor(labelCol=label, validationIndicatorCol="held", **({"maxIter": 20, "maxDepth": 4, "seed": 1} | params))
    elif kind == "forest":
        model = RandomForestRegressor(labelCol=label, **({"numTrees": 20, "seed": 1} | params))
    else:
        model = LinearRegression(labelCol=label, **params)
    return PipelineModel([ready, vector, model.fit(vector.transform(ready.transform(known)))])


def scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("date", "ticker", "prediction")


def save(model: PipelineModel, path: str, spark: SparkSession) -> None:
    """path/model, and path/features with the features in their order, their medians and moments."""
    model.write().overwrite().save(f"{path}/model")
    model.stages[0].table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


@dataclass
class Saved:
    model: PipelineModel
    features: list[str]

    def score(self, wide: DataFrame, start: str | None = None, end: str | None = None, least: int = 30) -> DataFrame:
        """date, ticker, prediction of a range of dates, without dates of fewer than `least` rows. Features that
        the table lacks count as missing, further columns are ignored."""
        absent = {c: F.lit(None).cast("double") for c in self.features if c not in wide.columns}
        rows = enough_rows(date_range(wide, start, end).withColumns(absent), least)
        return scores(self.model, rows.select("date", "ticker", *self.features))


def load(spark: SparkSession, path: str) -> Saved:
    names = [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("ord").collect()]  # a row a feature
    return Saved(PipelineModel.load(f"{path}/model"), names)


def nodes(spark: SparkSession, model: PipelineModel, path: str) -> DataFrame:
    """tree, node, feature, threshold, gain, rows, left, right, prediction: the saved model's trees as a table with
    a row a node; leaves have no feature. model: the pipeline that was saved (or loaded) at path."""
    from pyspark.ml.pipeline import PipelineSharedReadWrite

    last = len(model.stages) - 1
    at = PipelineSharedReadWrite.getStagePath(model.stages[last].uid, last, len(model.stages), f"{path}/model/stages")
    names = F.lit([c.removesuffix(READY) for c in model.stages[-2].getInputCols()])
    n = F.col("nodeData")
    split = n["leftChild"] >= 0
    rows = spark.read.parquet(f"{at}/data")
    return rows.select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        F.when(split, F.get(names, n["split"]["featureIndex"])).alias("feature"),
        F.when(split, F.get(n["split"]["leftCategoriesOrThreshold"], 0)).alias("threshold"),
        F.when(split, n["gain"]).alias("gain"),
        F.get(n["impurityStats"], 0).alias("rows"),
        F.when(split, n["leftChild"]).alias("left"),
        F.when(split, n["rightChild"]).alias("right"),
        n["prediction"].alias("prediction"),
    )


def importances(tree_nodes: DataFrame, by: list[str] | None = None, each_tree: bool = False) -> DataFrame:
    """by, feature, importance: gain times rows summed over the splits by a feature, over the sum of all, with the
    rows of each tree in proportion to its root's; with each_tree (forests) every tree counts alike."""
    by = by or []
    split = tree_nodes.where("feature is not null").withColumn("g", F.col("gain") * F.col("rows"))
    total = split.groupBy(*by, "tree").agg(F.sum("g").alias("t"))
    if not each_tree:
        total = tree_nodes.where("node = 0").select(*by, "tree", F.col("rows").alias("t"))
    shares = split.join(total, [*by, "tree"]).groupBy(*by, "feature").agg(F.sum(F.try_divide("g", "t")).alias("s"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))  # a row a feature
    return shares.select(*by, "feature", F.try_divide("s", F.sum("s").over(whole)).alias("importance"))


def top_features(shares: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """by, rank, feature, importance of the k features of greatest importance (ties by name)."""
    order = Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    return shares.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "rank", "feature", "importance")


def fold_fits(panel: DataFrame, features: list[str], label: str = "label", n: int = 4, kind: str = "gbt", **params) -> Iterator[tuple[int, PipelineModel, DataFrame]]:
    """fold, the pipeline fitted on the chunks of dates before the fold (medians and moments too), and the fold's
    rows. A fold is one after the other a job of Spark; there are n - 1 of them."""
    rows = folds(panel, n)
    for fold in range(1, n):
        yield fold, fit(rows.where(F.col("chunk") < fold), features, label, kind, **params), rows.where(F.col("chunk") == fold)


def walk_forward(panel: DataFrame, features: list[str], path: str, label: str = "label", n: int = 4, kind: str = "gbt", **params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of all folds: predictions (date, ticker, prediction, fold), importances (fold, feature, importance; tree
    kinds only, else empty) and the preparation's moments (fold, ord, feature, median, mean, sd). The folds' models are saved
    under path/fold=<n>."""
    spark = panel.sparkSession
    found: list[list[DataFrame]] = [[], [], []]
    for fold, model, test in fold_fits(panel, features, label, n, kind, **params):
        at = f"{path}/fold={fold}"
        save(model, at, spark)
        one = F.lit(fold).alias("fold")
        found[0].append(scores(model, test.where(F.col(label).isNotNull())).select("*", one))
        if kind != "linear":
            found[1].append(importances(nodes(spark, model, at), each_tree=kind == "forest").select(one, "*"))
        found[2].append(spark.read.parquet(f"{at}/features").select(one, "*"))
    empty = ["", "fold int, feature string, importance double", ""]
    out = []
    for tables, kinds in zip(found, empty, strict=True):
        all_ = spark.createDataFrame([], kinds) if not tables else tables[0]
        for t in tables[1:]:
            all_ = all_.unionAll(t)
        out.append(all_)
    return out[0], out[1], out[2]


def precision_recall(scored: DataFrame, k: int, good: int, gain: str = "bin") -> DataFrame:
    """date, precision, recall, hits, relevant: of the k rows of a date with the highest prediction, the share that is
    good (`gain` of at least `good`), and the share of the date's good rows that they hold. Rows without prediction or
    gain are left out; a date without a good row has no recall."""
    r = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("prediction"), "ticker"))
    x = scored.where(F.col(gain).isNotNull() & F.col("prediction").isNotNull()).withColumn("_r", r)
    is_good = F.col(gain) >= good
    s = x.groupBy("date").agg(F.count_if(is_good & (F.col("_r") <= k)).alias("hits"), F.count_if(is_good).alias("relevant"), F.least(F.count("*"), F.lit(k)).alias("_k"))
    return s.select("date", F.try_divide("hits", "_k").alias("precision"), F.try_divide("hits", "relevant").alias("recall"), "hits", "relevant")
