"""Jobs that read, extend and write the stores: build, refresh, score, weigh, and the style risk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import evaluate
from panelspark.operators import cleaning as cl
from panelspark.operators import combine as cb
from panelspark.operators import diagnostics as dg
from panelspark.operators import performance as pf
from panelspark.operators import risk as rk
from panelspark.operators import selection as sl
from panelspark.sources.stores import Store

#: User factors: name to an expression tree over the panel, as those of functions.expr.
FACTORS: dict[str, object] = {}


def register_factor(name: str, tree: object) -> None:
    """Adds a user factor; build() computes it with the others. A name can't be taken twice."""
    if name in FACTORS:
        raise ValueError(f"factor {name} exists")
    FACTORS[name] = tree


def build(panel: DataFrame, trees: dict[str, object], universe: DataFrame | None = None, process: str = "none") -> DataFrame:
    """date, ticker and all factors (given and registered) of the panel's universe, processed per date:
    `none`, `zscore`, `rank` or `winsorize`. One wide table from one chain of windows."""
    rows = panel if universe is None else sl.in_universe(panel, universe)
    every = trees | FACTORS
    wide = evaluate(rows, every)
    if process == "none":
        return wide
    how = {"zscore": cl.zscore, "rank": cl.rank_normalize, "winsorize": cl.winsorize}[process]
    return how(cl.to_long(wide, list(every))).groupBy("date", "ticker").pivot("factor", list(every)).agg(F.first("value"))


def medians(wide: DataFrame, features: list[str]) -> DataFrame:
    """feature, ord, median: the feature list with its training medians, to be written beside the model."""
    one = wide.agg(*(F.median(c).alias(f"m{k}") for k, c in enumerate(features)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(k).alias("ord"), F.col(f"m{k}").alias("median")) for k, c in enumerate(features)))).alias("x")).select("x.*")


def scored(wide: DataFrame, saved: DataFrame, score, start: str | None = None, end: str | None = None, least: int = 30) -> DataFrame:
    """date, ticker, prediction of a range of dates: the saved features in their order, gaps by the saved
    medians, dates with fewer than `least` rows left out. `score` is a function of the aligned table (a fitted
    model's transform, say) that returns date, ticker, prediction."""
    rows = saved.orderBy("ord").collect()  # a row for each feature
    names, fill = [r.feature for r in rows], {r.feature: r["median"] or 0.0 for r in rows}
    return score(cl.enough_rows(cl.align(sl.date_range(wide, start, end), names, fill), least))


def linear_score(coefficients: dict[str, float], intercept: float = 0.0):
    return lambda df: df.select("date", "ticker", sum((F.col(c) * w for c, w in coefficients.items()), F.lit(intercept)).alias("prediction"))


def segments(df: DataFrame, train: tuple[str, str], valid: tuple[str, str], test: tuple[str, str]) -> DataFrame:
    """df with `segment`, rows outside all three left out; without rows in the test range the validation rows
    are the test rows too."""
    inside = lambda s: F.col("date").between(F.lit(s[0]).cast("date"), F.lit(s[1]).cast("date"))
    out = df.withColumn("segment", F.when(inside(train), "train").when(inside(valid), "valid").when(inside(test), "test")).where("segment is not null")
    empty = not out.where("segment = 'test'").limit(1).count()
    return out.unionAll(out.where("segment = 'valid'").withColumn("segment", F.lit("test"))) if empty else out


def ranker_panel(wide: DataFrame, labels: DataFrame, features: list[str], bins: int = 5, lag: int = 0, least: int = 100) -> DataFrame:
    """date, ticker, features, label, bin for ranking models: features lagged, gaps by the date's median, quantile
    bins of the label, rows without label and dates with fewer than `least` rows left out."""
    own = sl.lagged(wide.select("date", "ticker", *features), features, lag) if lag else wide.select("date", "ticker", *features)
    day = Window.partitionBy("date")
    own = own.select("date", "ticker", *(F.coalesce(F.col(c), F.median(c).over(day)).alias(c) for c in features))
    return cl.enough_rows(dg.quantile_label(own.join(labels, ["date", "ticker"]).where("label is not null"), bins), least)


def regression_panel(wide: DataFrame, labels: DataFrame, features: list[str], summary: DataFrame | None = None, least_icir: float = 0.0) -> DataFrame:
    """date, ticker, features, label for regression models: rows with a label, without features that are
    constant or, with a summary, whose |ICIR| is below the limit."""
    if summary is not None:
        good = {r.factor for r in cb.by_icir(summary, least_icir, features).collect()}  # a row for each feature
        features = [c for c in features if c in good]
    rows = wide.select("date", "ticker", *features).join(labels.where("label is not null"), ["date", "ticker"])
    varied = rows.agg(*(F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(c) for c in features)).first()
    return rows.select("date", "ticker", *(c for c in features if varied[c]), "label")


def append_bars(store: DataFrame, new: DataFrame) -> DataFrame:
    """The price store with the new bars: a key's newest version stays, so a revised bar can't double it."""
    return sl.upsert(store, sl.first_of(new, ["date", "ticker"], *(F.desc(c) for c in new.columns if c not in ("date", "ticker"))), ["date", "ticker"])


def date_span(store: DataFrame) -> DataFrame:
    """One row: first and last date, and how many there are."""
    return store.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("dates"))


def refresh_factors(panel: DataFrame, store: DataFrame, trees: dict[str, object], look_back: int, start: str | None = None, end: str | None = None, force: bool = False) -> DataFrame:
    """Factor rows of the panel's dates that the store lacks (all of the range with force), in one job:
    factors are computed on the missing dates and the `look_back` dates before the first of them."""
    dates = sl.date_range(panel.select("date").distinct(), start, end)
    missing = dates if force else dates.join(store.select("date").distinct(), "date", "left_anti")
    cal = panel.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))  # one row per date
    first = missing.join(cal, "date").agg((F.min("_i") - look_back).alias("_from"))
    rows = panel.join(F.broadcast(cal.join(F.broadcast(first), F.col("_i") >= F.col("_from")).select("date")), "date", "left_semi")
    return evaluate(rows, trees).join(F.broadcast(missing), "date", "left_semi")


def update_stores(panel: DataFrame, trees: dict[str, object], factors: Store, ics: Store, look_back: int, start: str | None = None, end: str | None = None, force: bool = False) -> None:
    """Fills the factor store for the range of dates and then the store of rank ICs (date, factor, ic, n).

    All missing dates (with force all dates of the range) are computed in one job and written into their own folders;
    known dates' files aren't touched. ICs are computed for every date of the range, known ones too, as a date's
    next return comes after the date. A second run changes no factor file and gives the same ICs.
    """
    known = factors.dates() if factors.exists() else panel.select("date").limit(0)
    factors.replace(refresh_factors(panel, known, trees, look_back, start, end, force))
    if factors.exists():
        long = cl.to_long(factors.read(start, end), list(trees))
        ics.replace(dg.rank_ic(long, dg.forward_return(panel)))


def daily_chain(prices: DataFrame, new: DataFrame, store: DataFrame, trees: dict[str, object], look_back: int, saved: DataFrame, score, k: int, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The day's tables by name: prices, factors (the new rows), predictions and weights of the newest date.
    Steps named in skip are left out, and so is what needs them."""
    out = {"prices": prices if "prices" in skip else append_bars(prices, new)}
    if "factors" not in skip:
        out["factors"] = refresh_factors(out["prices"], store, trees, look_back)
        if "predictions" not in skip:
            out["predictions"] = scored(out["factors"], saved, score)
            if "weights" not in skip:
                newest = out["predictions"].agg(F.max("date").alias("date"))
                out["weights"] = pf.top_k(out["predictions"].join(F.broadcast(newest), "date", "left_semi"), k)
    return out


def as_table(df: DataFrame, name: str = "prices") -> DataFrame:
    """The panel as a named table for SQL."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def risk_table(wide: DataFrame, labels: DataFrame, weights: DataFrame, styles: list[str], last: int = 30) -> DataFrame:
    """date, style, exposure, contribution, total_variance of the last dates: factor returns, their covariance
    over earlier dates, portfolio exposures and the specific part in one plan. Only style names appear."""
    returns = rk.factor_returns(wide, labels, styles)
    scores = cl.to_long(wide, styles).select("date", "ticker", F.col("factor").alias("bucket"), F.col("value").alias("score"))
    exposure = rk.portfolio_exposure(scores, weights)
    parts = rk.decomposition(exposure, rk.ridged_covariance(rk.previous_covariance(returns)).drop("ridged"), rk.specific_risk(rk.residuals(wide, labels, returns, styles), weights))
    return sl.last_dates(parts, last).join(exposure, ["date", "style"], "left").select("date", "style", "exposure", "contribution", "total_variance")


def joined_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new rows with the columns of both, null where one lacks a column; whole rows once."""
    return old.unionByName(new, allowMissingColumns=True).dropDuplicates()
