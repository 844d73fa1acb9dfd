"""Filters, date selection, keys, joins and upserts on the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end, both included; the filter reaches the scan."""
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df.where(F.col("date") <= F.lit(end).cast("date")) if end else df


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    return df.join(universe.select("ticker").distinct(), "ticker", "left_semi")


def missing_from(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Universe members without any row."""
    return universe.select("ticker").distinct().join(df.select("ticker").distinct(), "ticker", "left_anti")


def repaired(df: DataFrame) -> DataFrame:
    """Negative adjusted closes become null, negative volumes 0."""
    return df.withColumn("adj_close", F.when(F.col("adj_close") >= 0, F.col("adj_close"))).withColumn("volume", F.when(F.col("volume") < 0, 0.0).otherwise(F.col("volume")))


def repair_counts(df: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col(c) < 0)
    return df.agg(n("close").alias("negative_close"), n("adj_close").alias("negative_adj_close"), n("volume").alias("negative_volume"), F.count("*").alias("rows"))


def ticker_market(ticker: Column) -> Column:
    """`cn` for exchange-prefixed or six-digit names, `us` for letters (with one - or .), else `other`."""
    return F.when(ticker.rlike(r"^(?i)(sh|sz|bj)[0-9]{6}$") | ticker.rlike(r"^[0-9]{6}([.][A-Za-z]{2})?$"), "cn").when(ticker.rlike(r"^[A-Z]{1,5}([-.][A-Z]{1,2})?$"), "us").otherwise("other")


def canonical_ticker(ticker: Column) -> Column:
    """Upper case, dots and inner blanks as hyphens; the class-less alias of one well-known name."""
    t = F.regexp_replace(F.upper(F.trim(ticker)), "[. ]+", "-")
    return F.when(t == "BRK", "BRK-B").otherwise(t)


def as_of(left: DataFrame, right: DataFrame, on: str = "date") -> DataFrame:
    """left date and the latest right date not after it. Only distinct dates meet, in one ordered pass."""
    x = left.select(on).distinct().select(F.col(on), F.lit(None).cast("date").alias("_r"), F.lit(1).alias("_k"))
    y = right.select(on).distinct().select(F.col(on), F.col(on).alias("_r"), F.lit(0).alias("_k"))
    w = Window.orderBy(on, "_k").rowsBetween(Window.unboundedPreceding, 0)
    return x.unionAll(y).withColumn("as_of", F.last("_r", ignorenulls=True).over(w)).where("_k = 1").select(on, "as_of")


def nearest_date(df: DataFrame, day: str) -> DataFrame:
    """The latest date not after `day`, else the first date."""
    d = F.lit(day).cast("date")
    return df.agg(F.coalesce(F.max(F.when(F.col("date") <= d, F.col("date"))), F.min("date")).alias("date"))


def last_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of the last n dates."""
    days = df.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return df.join(days, "date", "left_semi")


def last_months(df: DataFrame, n: int) -> DataFrame:
    """Rows after the date n months before the last one."""
    start = df.agg(F.add_months(F.max("date"), -n).alias("_from"))
    return df.crossJoin(F.broadcast(start)).where(F.col("date") >= F.col("_from")).drop("_from")  # one row


def next_dates(df: DataFrame) -> DataFrame:
    """Rows moved to the next date of the calendar; those of the last date go."""
    d = df.select("date").distinct().withColumn("_n", F.lead("date").over(Window.orderBy("date")))
    return df.join(d, "date").where("_n is not null").withColumn("date", F.col("_n")).drop("_n")


def lagged(df: DataFrame, columns: list[str], k: int = 1) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    return df.select(*[F.lag(c, k).over(w).alias(c) if c in columns else F.col(c) for c in df.columns])


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first by the given order (give descending columns for the last)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new; columns by name, missing ones null."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def overlap(a: DataFrame, b: DataFrame, keys: list[str], least: float = 0.1) -> DataFrame:
    """Rows of a whose key is in b; fails where they are fewer than the least share of a's."""
    both = a.join(b.select(keys).distinct(), keys, "left_semi")
    n, k = a.count(), both.count()
    if n and k < least * n:
        raise ValueError(f"only {k} of {n} keys overlap")
    return both


def held_and_target(held: DataFrame, target: DataFrame) -> DataFrame:
    """ticker and state: `sell` (held only), `buy` (target only), `keep` (both)."""
    x = held.select("ticker").distinct().withColumn("_h", F.lit(1))
    y = target.select("ticker").distinct().withColumn("_t", F.lit(1))
    return x.join(y, "ticker", "full_outer").select("ticker", F.when(F.col("_t").isNull(), "sell").when(F.col("_h").isNull(), "buy").otherwise("keep").alias("state"))


def latest_prices(panel: DataFrame, tickers: DataFrame, days: int = 5) -> DataFrame:
    """ticker and the last positive adjusted close within the last `days` dates, whatever the case of the name."""
    recent = last_dates(panel, days).where("adj_close > 0").groupBy(F.upper("ticker").alias("_u")).agg(F.max_by("adj_close", "date").alias("price"), F.max("date").alias("price_date"))
    return tickers.join(recent, F.upper(tickers["ticker"]) == recent["_u"], "left").drop("_u")


def wide_vendor_to_panel(df: DataFrame, sep: str = "|") -> DataFrame:
    """Columns `field|ticker` (or `ticker|field`) to date, ticker, one column per field."""
    fields = {"open", "high", "low", "close", "adj close", "volume"}
    names = [c for c in df.columns if c != "date"]
    swapped = sum(c.split(sep)[-1].lower() in fields for c in names) > sum(c.split(sep)[0].lower() in fields for c in names)
    parts = F.split("name", F.lit("\\" + sep))
    x = df.unpivot("date", names, "name", "value").select("date", parts[0 if swapped else 1].alias("ticker"), F.lower(F.regexp_replace(parts[1 if swapped else 0], " ", "_")).alias("field"), "value")
    found = sorted({c.split(sep)[-1 if swapped else 0].lower().replace(" ", "_") for c in names})
    return x.groupBy("date", "ticker").pivot("field", found).agg(F.first("value", ignorenulls=True))


def data_profile(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """One row: dates, rows, rows per day, and the label's share missing, mean, spread and quantiles."""
    day = df.groupBy("date").agg(F.count("*").alias("n"))
    a = day.agg(F.count("*").alias("dates"), F.sum("n").alias("rows"), F.min("n").alias("rows_min"), F.max("n").alias("rows_max"), F.avg("n").alias("rows_mean"), F.median("n").alias("rows_median"))
    b = df.agg(F.avg(F.col(label).isNull().cast("double")).alias("label_missing"), F.avg(label).alias("label_mean"), F.stddev_samp(label).alias("label_std"), *(F.percentile(label, q).alias(f"label_q{int(q * 100)}") for q in (0.1, 0.5, 0.9)), *(F.avg(F.col(f).isNull().cast("double")).alias(f"missing_{f}") for f in features))
    return a.crossJoin(b)  # one row each


def share_of_total(df: DataFrame, value: str, keys: list[str], out: str = "share") -> DataFrame:
    """Percent of the keys' total; 0 where the total isn't positive."""
    t = F.sum(value).over(Window.partitionBy(keys))
    return df.withColumn(out, F.when(t > 0, F.try_divide(F.col(value) * 100, t)).otherwise(0.0))
