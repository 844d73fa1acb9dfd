"""The build job: factors of a universe, processed, orthogonal, stable, enhanced and stored, with its reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import evaluate
from panelspark.operators import cleaning as cl
from panelspark.operators import combine as cb
from panelspark.operators import diagnostics as dg
from panelspark.operators import risk as rk
from panelspark.operators import selection as sl
from panelspark.sources.stores import Store, stored

from . import jobs

#: Ways to process factors across a date's section.
PROCESSES = {
    "mad": cl.mad_winsorize,  # cut at three median absolute deviations, nothing else
    "standard": lambda long: cl.zscore(cl.winsorize(long)),
    "rank": cl.rank_normalize,
    "light": lambda long: long,  # the scan has made infinite values null
}


def stability_report(long: DataFrame, window: int = 60, threshold: float = 3.0, min_coverage: float = 0.25) -> DataFrame:
    """factor, median_spread, coverage, kept: the median over all cells of the tickers' rolling spread (over at least half
    of the window and five rows), the share of cells that have one, and whether they meet the limits."""
    w = Window.partitionBy("factor", "ticker").orderBy("date").rowsBetween(-(window - 1), 0)
    cells = long.withColumn("_s", F.when(F.count("value").over(w) >= max(5, window // 2), F.stddev_samp("value").over(w)))
    s = cells.groupBy("factor").agg(F.median("_s").alias("median_spread"), (F.count("_s") / F.count("*")).alias("coverage"))
    kept = F.coalesce((F.col("coverage") >= min_coverage) & (F.col("median_spread") <= threshold), F.lit(False))
    return s.withColumn("kept", kept)


def ic_statistics(long: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """factor, ic_mean, icir (sample spread), win_rate of the daily rank ICs."""
    ics = dg.rank_ic(long, labels, least=least)
    s = dg.ic_summary(ics).join(ics.groupBy("factor").agg(F.stddev_samp("ic").alias("ic_std_sample")), "factor")
    return cb.quality(s).select("factor", "ic_mean", "icir", "win_rate")


def combined(long: DataFrame, weights: DataFrame, name: str = "COMBINED") -> DataFrame:
    """date, ticker, factor, value: the weighted sum of all weighted factors; null where a row lacks one of them."""
    n = weights.agg(F.count("*").alias("_n"))  # one row
    s = long.join(F.broadcast(weights), "factor").groupBy("date", "ticker").agg(F.sum(F.col("value") * F.col("weight")).alias("_v"), F.count("value").alias("_k"))  # a row a factor
    return s.crossJoin(F.broadcast(n)).select("date", "ticker", F.lit(name).alias("factor"), F.when(F.col("_k") == F.col("_n"), F.col("_v")).alias("value"))


@dataclass
class Enhancement:
    """Steps of enhance() that are to be taken; None leaves a step out."""

    min_quality: tuple[float, float, float] | None = (0.0, 0.0, 0.0)  # |mean IC|, |ICIR|, share of days above 0
    share: float | None = None  # of the variance that a date's components reach
    combine: str | None = "ic_weighted"


REPORT = ["step", "factor", "ic_mean", "icir", "win_rate", "kept", "weight"]


def enhance(long: DataFrame, labels: DataFrame, how: Enhancement | None = None) -> tuple[DataFrame, DataFrame]:
    """The factors (date, ticker, factor, value) after the steps, and the report (REPORT, a row a step and factor).

    quality: factors below the limits go. components: each date's rows become its principal components PCA_1, PCA_2, ... .
    combination: a further factor COMBINED, weighted by the factors' own ICs at that point.
    """
    how = how or Enhancement()
    now, report = long, None

    def told(step: str, rows: DataFrame) -> None:
        nonlocal report
        own = rows.withColumn("step", F.lit(step)).select(*(F.col(c) if c in rows.columns or c == "step" else F.lit(None).cast("boolean" if c == "kept" else "double").alias(c) for c in REPORT))
        report = own if report is None else report.unionByName(own)

    if how.min_quality is not None:
        low = how.min_quality
        s = ic_statistics(now, labels)
        s = s.withColumn("kept", F.coalesce((F.abs("ic_mean") >= low[0]) & (F.abs("icir") >= low[1]) & (F.col("win_rate") >= low[2]), F.lit(False)))
        told("quality", s)
        now = now.join(F.broadcast(s.where("kept").select("factor")), "factor", "left_semi")  # a row a factor
    if how.share is not None:
        names = sorted(r.factor for r in now.select("factor").distinct().collect())  # a row a factor
        parts = stored(cb.principal_components(cl.to_wide(now, names), names, how.share)) if names else None
        if parts is not None:
            now = parts.select("date", "ticker", F.concat(F.lit("PCA_"), F.col("component").cast("string")).alias("factor"), "value")
            told("components", now.groupBy("factor").agg(F.count("*").alias("rows")).withColumn("kept", F.lit(True)))
    if how.combine is not None:
        s = ic_statistics(now, labels)
        weights = cb.combination_weights(s, how.combine)
        told("combination", s.join(weights, "factor"))
        now = now.select("date", "ticker", "factor", "value").unionByName(combined(now, weights))
    if report is None:
        report = long.sparkSession.createDataFrame([], "step string, factor string, ic_mean double, icir double, win_rate double, kept boolean, weight double")
    return now.select("date", "ticker", "factor", "value"), report


@dataclass
class Built:
    factors: list[str]
    missing: DataFrame  # names of the universe without prices
    reports: dict[str, DataFrame] = field(default_factory=dict)


def build_and_store(panel: DataFrame, trees: dict[str, object], store: Store, universe: DataFrame | None = None, start: str | None = None, end: str | None = None, process: str = "mad", orthogonal: bool = False, stability: dict | None = None, enhancement: Enhancement | None = None) -> Built:
    """Computes the given and all registered factors of the universe's names, processes them, takes the steps asked for and
    writes one wide table, a folder a date, into the store. Reports: stability, enhancement, ics (of what is stored).

    orthogonal: Gram-Schmidt on each date in the order of falling |mean IC|. stability: arguments of stability_report();
    factors that fail it go, and it is an error if all do. Factors are windows over all rows of the panel; start and
    end cut what follows.
    """
    missing = panel.select("ticker").limit(0) if universe is None else sl.missing_from(panel, universe)
    rows = panel if universe is None else sl.in_universe(panel, universe)
    every = trees | jobs.FACTORS
    labels = stored(dg.forward_return(rows))
    long = stored(PROCESSES[process](cl.to_long(sl.date_range(evaluate(rows, every), start, end), list(every))).select("date", "ticker", "factor", "value"))
    built = Built([], missing)
    if orthogonal:
        order = cb.ic_order(ic_statistics(long, labels))
        order += [c for c in every if c not in order]
        long = stored(cl.to_long(rk.orthogonal(cl.to_wide(long, order), order, unit=False), order))
    if stability is not None:
        report = built.reports["stability"] = stability_report(long, **stability)
        names = [r.factor for r in report.where("kept").collect()]  # a row a factor
        if not names:
            raise ValueError("no factor is stable: relax threshold or min_coverage")
        long = long.where(F.col("factor").isin(names))
    if enhancement is not None:
        long, built.reports["enhancement"] = enhance(long, labels, enhancement)
    built.factors = sorted(r.factor for r in long.select("factor").distinct().collect())  # a row a factor
    store.replace(cl.to_wide(long, built.factors))
    written = cl.to_long(store.read(start, end), built.factors)
    built.reports["ics"] = ic_statistics(written, labels)
    return built
