"""Labels and predictive power of factors: forward returns, rank IC, its summaries, long-short returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def forward_return(panel: DataFrame, horizon: int = 1, delay: int = 0, price: str = "adj_close") -> DataFrame:
    """date, ticker, label = price[t + delay + horizon] / price[t + delay] - 1 on the panel's rows (densify
    first where tickers have gaps)."""
    start = F.lead(price, delay).over(by_ticker()) if delay else F.col(price)
    return panel.select("date", "ticker", (F.try_divide(F.lead(price, delay + horizon).over(by_ticker()), start) - 1).alias("label"))


def label_series(panel: DataFrame, horizon: int = 1, shift: int = 0, price: str = "adj_close") -> DataFrame:
    """date, ticker, label: the return over `horizon` rows that begins `shift` rows later: the forward return, moved back
    per ticker. (forward_return with a delay is the same from prices; this also moves labels of other kinds.)"""
    own = forward_return(panel, horizon, 0, price)
    return own if not shift else own.select("date", "ticker", F.lead("label", shift).over(by_ticker()).alias("label"))


def rolling_rank_ic(predictions: DataFrame, labels: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """date, rank_ic, rank_ic_roll of out-of-fold predictions (date, ticker, prediction): the day's rank IC and its mean over the
    last `window` days that have one, from `least` of them on."""
    long = predictions.select("date", "ticker", F.lit("oof").alias("factor"), F.col("prediction").alias("value"))
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)  # one row a date
    ics = rank_ic(long, labels)
    return ics.select("date", F.col("ic").alias("rank_ic"), F.when(F.count("ic").over(w) >= least, F.avg("ic").over(w)).alias("rank_ic_roll"))


def quantile_label(df: DataFrame, q: int, value: str = "label") -> DataFrame:
    """bin 0..q-1 of the value on its date: quantile bins of first-come ranks, fewer where a date has few
    rows, null where it has fewer than two."""
    n = F.count(value).over(Window.partitionBy("date"))
    r = F.row_number().over(Window.partitionBy("date").orderBy(F.col(value).asc_nulls_last(), "ticker"))
    k = F.least(F.lit(q), n)
    b = F.greatest(F.ceil((r - 1) * k / F.greatest(n - 1, F.lit(1))) - 1, F.lit(0))
    return df.withColumn("bin", F.when(F.col(value).isNotNull() & (n >= 2), b.cast("int")))


def date_chunks(df: DataFrame, n: int) -> DataFrame:
    """(date, chunk 0..n-1): the dates in order cut into n parts of near-equal length, longer ones first.
    One row per date, so the single window is over the calendar only."""
    dates = df.select("date").distinct()
    d = dates.withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    size, extra = F.floor(F.col("_n") / n), F.col("_n") % n
    long = extra * (size + 1)
    return d.select("date", F.when(F.col("_i") < long, F.floor(F.col("_i") / (size + 1))).otherwise(extra + F.floor((F.col("_i") - long) / F.greatest(size, F.lit(1)))).cast("int").alias("chunk"))


def average_rank(x: Column, keys: list[str]) -> Column:
    """Average-tie rank of x within its keys; null stays null."""
    w = Window.partitionBy(keys).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), (F.rank().over(w) + F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2)


def first_rank(x: Column, keys: list[str]) -> Column:
    return F.when(x.isNotNull(), F.row_number().over(Window.partitionBy(keys).orderBy(x.asc_nulls_last(), "ticker")).cast("double"))


def rank_ic(long: DataFrame, labels: DataFrame, ties: str = "average", least: int = 2, null_ic: float | None = None) -> DataFrame:
    """date, factor, ic, n: rank correlation of factor and label on each date over the rows that have both,
    null (or null_ic) with fewer than `least` rows or without variation. Sums are pre-aggregated by key."""
    keys = ["date", "factor"]
    both = long.join(labels, ["date", "ticker"]).where("value is not null and label is not null")
    rank = average_rank if ties == "average" else first_rank
    r = both.select(*keys, rank(F.col("value"), keys).alias("x"), rank(F.col("label"), keys).alias("y"))
    s = r.groupBy(keys).agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("a"), F.stddev_pop("y").alias("b"))
    ic = F.when((F.col("n") >= least) & (F.col("a") > 0) & (F.col("b") > 0), F.try_divide("c", F.col("a") * F.col("b")))
    return s.select(*keys, (ic if null_ic is None else F.coalesce(ic, F.lit(null_ic))).alias("ic"), "n")


def ic_summary(ics: DataFrame) -> DataFrame:
    """One row per factor over its days with an IC: mean, spread (population), ICIR, share of days above 0,
    t statistic, mean size, extremes, days and samples."""
    x = ics.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.stddev_samp("ic").alias("_s"), F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"), F.avg(F.abs("ic")).alias("ic_abs_mean"), F.max("ic").alias("ic_max"), F.min("ic").alias("ic_min"), F.count("ic").alias("days"), F.sum(F.when(F.col("ic").isNotNull(), F.col("n"))).alias("samples"))
    return x.withColumn("icir", F.try_divide("ic_mean", "ic_std")).withColumn("t_stat", F.try_divide("ic_mean", F.col("_s") / F.sqrt("days"))).drop("_s")


def student_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or t is None or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a, b, x):
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or tiny)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + k * d) or tiny)
                c = (1 + k / c) or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def with_p_values(summary: DataFrame) -> DataFrame:
    """summary with p_value and significant (p < 0.05). One value per factor: a few hundred rows."""

    @F.pandas_udf("double")
    def p(t, n):
        import pandas as pd

        return pd.Series([student_p(a, int(b) - 1) for a, b in zip(t, n, strict=True)], dtype="float64")

    return summary.withColumn("p_value", p("t_stat", "days")).withColumn("significant", F.col("p_value") < 0.05)


def ic_screen(summary: DataFrame, levels=(0.01, 0.02, 0.05, 0.5, 1.0)) -> DataFrame:
    """How many factors reach each ICIR level."""
    return summary.select(F.explode(F.lit(list(levels))).alias("level"), F.abs("icir").alias("x")).groupBy("level").agg(F.count_if(F.col("x") > F.col("level")).alias("factors"))


def rolling_ic(ics: DataFrame, window: int = 60, least: int | None = None) -> DataFrame:
    """Rolling mean, 1.96-sigma band, ICIR and t statistic of each factor's IC."""
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(-(window - 1), 0)
    n = F.count("ic").over(w)
    ok = n >= (least or window)
    m, s = F.avg("ic").over(w), F.stddev_samp("ic").over(w)
    ratio = F.try_divide(m, s)
    return ics.select("date", "factor", F.when(ok, m).alias("ic_mean"), F.when(ok, m + 1.96 * s).alias("upper"), F.when(ok, m - 1.96 * s).alias("lower"), F.when(ok, ratio).alias("icir"), F.when(ok, ratio * F.sqrt(n)).alias("t_stat"))


def long_short(long: DataFrame, labels: DataFrame, groups: int = 5, least: int = 20) -> DataFrame:
    """Daily returns of the top and the bottom group of each factor and their difference; dates with fewer
    than `least` rows are left out. The top group is n / groups rounded up, the bottom one rounded down."""
    keys = ["date", "factor"]
    both = long.join(labels, ["date", "ticker"]).where("value is not null and label is not null")
    n = F.count("*").over(Window.partitionBy(keys))
    x = both.withColumn("r", F.row_number().over(Window.partitionBy(keys).orderBy("value", "ticker"))).withColumn("n", n).where(F.col("n") >= least)
    up = F.col("r") > F.col("n") - F.ceil(F.col("n") / groups)
    down = F.col("r") <= F.floor(F.col("n") / groups)
    out = x.groupBy(keys).agg(F.avg(F.when(up, F.col("label"))).alias("long_return"), F.avg(F.when(down, F.col("label"))).alias("short_return"))
    return out.withColumn("ls_return", F.col("long_return") - F.col("short_return"))


def long_short_stats(daily: DataFrame, days: int = 252) -> DataFrame:
    """Per factor: annual mean return, Sharpe ratio, total return, largest drawdown of the difference.
    After a return of -1 the curve stays 0."""
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("nav", F.product(1 + F.col("ls_return")).over(w))
    curve = curve.withColumn("dd", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)
    return curve.groupBy("factor").agg((F.avg("ls_return") * days).alias("annual_return"), F.try_divide(F.avg("ls_return"), F.stddev_samp("ls_return")).alias("_s"), F.min("dd").alias("max_drawdown"), F.max_by("nav", "date").alias("_n"), F.count("*").alias("days")).select("factor", "annual_return", (F.col("_s") * math.sqrt(days)).alias("sharpe"), (F.col("_n") - 1).alias("total_return"), "max_drawdown", "days")


def factor_correlation(wide: DataFrame, factors: list[str]) -> DataFrame:
    """factor_a, factor_b, correlation over the rows that have both (pairwise complete), 1 on the diagonal,
    0 where undefined. All moments come from one aggregate per block of pairs."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    out = None
    for k in range(0, max(1, len(pairs)), 150):
        aggs = []
        for i, (a, b) in enumerate(pairs[k : k + 150]):
            x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
            aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias("c")).alias(f"p{i}"))
        if not aggs:
            break
        block = wide.agg(*aggs).select(F.explode(F.array(*(f"p{i}" for i in range(len(aggs))))).alias("p"))
        out = block if out is None else out.unionAll(block)
    own = wide.sparkSession.createDataFrame([(f, f, 1.0) for f in factors], "factor_a string, factor_b string, correlation double")
    if out is None:
        return own
    c = F.coalesce(F.col("p.c"), F.lit(0.0)).alias("correlation")
    return own.unionAll(out.select("p.a", "p.b", c)).unionAll(out.select("p.b", "p.a", c))
