"""Fills, positions and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ny_time(utc: Column) -> Column:
    """Timestamps or texts (with or without a time) from UTC to New York."""
    t = F.coalesce(F.try_to_timestamp(utc.cast("string"), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(utc.cast("string"), F.lit("yyyy-MM-dd")), F.try_to_timestamp(utc.cast("string")))
    return F.from_utc_timestamp(t, "America/New_York")


def normalized_fills(fills: DataFrame, commissions: DataFrame | None = None) -> DataFrame:
    """BOT and SLD as BUY and SELL, amount, commission (0 where none is known); only rows with positive
    quantity and price."""
    side = F.when(F.upper("side").isin("BOT", "BUY"), "BUY").when(F.upper("side").isin("SLD", "SELL"), "SELL").otherwise(F.upper("side"))
    x = fills.withColumn("side", side).where("quantity > 0 and price > 0").withColumn("amount", F.col("quantity") * F.col("price"))
    if commissions is None:
        return x.withColumn("commission", F.lit(0.0))
    c = commissions.groupBy("exec_id").agg(F.sum("commission").alias("commission"))
    return x.join(c, "exec_id", "left").withColumn("commission", F.coalesce("commission", F.lit(0.0)))


def outside_windows(fills: DataFrame, windows: DataFrame, time: str = "time") -> DataFrame:
    """Fills outside all bad windows (start and end included); fills without a time stay. Windows are joined
    by the days they touch."""
    days = windows.where("start <= end").withColumn("_day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    own = fills.withColumn("_day", F.to_date(F.col(time)))
    return own.join(days.select("_day", "start", "end"), (own["_day"] == days["_day"]) & F.col(time).between(F.col("start"), F.col("end")), "left_anti").drop("_day")


def filtered(fills: DataFrame, start: str | None = None, end: str | None = None, symbol: str | None = None, time: str = "time") -> DataFrame:
    day = F.to_date(time)
    if start:
        fills = fills.where(day >= F.lit(start).cast("date"))
    if end:
        fills = fills.where(day <= F.lit(end).cast("date"))
    return fills.where(F.upper("symbol") == symbol.upper()) if symbol else fills


def daily_activity(fills: DataFrame, time: str = "time") -> DataFrame:
    return fills.groupBy(F.to_date(time).alias("date")).agg(F.count("*").alias("trades"), F.sum(F.col("quantity") * F.col("price")).alias("notional"))


def positions(rows: DataFrame) -> DataFrame:
    """Market value, unrealised profit where a cost is known, and the weight within the account."""
    v = F.col("shares") * F.col("current_price")
    w = F.sum("market_value").over(Window.partitionBy("account"))
    x = rows.withColumn("market_value", v).withColumn("unrealized_pnl", F.when(F.col("avg_cost") > 0, v - F.col("shares") * F.col("avg_cost")).otherwise(0.0))
    return x.withColumn("weight", F.coalesce(F.try_divide("market_value", w), F.lit(0.0)))


def model_positions(weights: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """quantity = capital * weight / price; 0 where there is no price."""
    x = weights.join(prices, "ticker", "left")
    return x.withColumn("quantity", F.coalesce(F.try_divide(F.lit(capital) * F.col("weight"), F.col("price")), F.lit(0.0)))


def usable_capital(buying_power: Column, ratio: float, requested: Column) -> Column:
    cap = buying_power * ratio
    return F.when(requested.isNull() | (requested <= 0), cap).otherwise(F.least(cap, requested))


def trade_deltas(targets: DataFrame, held: DataFrame, capital: float, cash: float, least_buy: float = 100.0) -> DataFrame:
    """account, ticker, delta: whole shares to trade. Changes under one share and buys under least_buy are
    skipped; names held but not targeted are closed, short ones too; buys take the cash left in order of
    `ord` and are trimmed to it. The cash rule is sequential, so an account's orders are folded as one
    array (bounded by the names an account trades)."""
    j = targets.join(held.select("account", "ticker", F.col("shares").alias("held")), ["account", "ticker"], "full_outer")
    want = F.coalesce(F.floor(F.try_divide(F.lit(capital) * F.col("weight"), F.col("price"))), F.lit(0)).cast("double")
    j = j.withColumn("raw", want - F.coalesce("held", F.lit(0.0)))
    j = j.where((F.abs("raw") >= 1) & ((F.col("raw") < 0) | F.col("weight").isNull() | (F.col("raw") * F.col("price") >= least_buy)))
    rows = j.groupBy("account").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(1 << 30)).alias("ord"), "ticker", F.col("raw").cast("double").alias("raw"), F.coalesce("price", F.lit(0.0)).alias("price")))).alias("x"))
    start = F.struct(F.lit(float(cash)).alias("cash"), F.array().cast("array<struct<ticker:string,delta:double>>").alias("out"))

    def step(acc, v):
        buy = (v["raw"] > 0) & (v["price"] > 0)
        n = F.when(buy, F.least(v["raw"], F.floor(F.try_divide(acc["cash"], v["price"])).cast("double"))).otherwise(v["raw"])
        n = F.coalesce(F.greatest(n, F.when(buy, F.lit(0.0)).otherwise(n)), F.lit(0.0))
        left = F.when(buy, acc["cash"] - n * v["price"]).otherwise(acc["cash"])
        return F.struct(left.alias("cash"), F.concat(acc["out"], F.array(F.struct(v["ticker"].alias("ticker"), n.alias("delta")))).alias("out"))

    folded = rows.select("account", F.aggregate("x", start, step)["out"].alias("out"))
    return folded.select("account", F.explode("out").alias("o")).select("account", "o.ticker", "o.delta").where("delta <> 0")


def account_values(rows: DataFrame, tags: list[str]) -> DataFrame:
    """(account, tag, value as text) to one row per account; values that are no numbers are skipped."""
    x = rows.withColumn("v", F.expr("try_cast(value AS double)")).where("v is not null")
    return x.groupBy("account").pivot("tag", tags).agg(F.max("v"))


def mid_price(bid: Column, ask: Column, delayed_bid: Column, delayed_ask: Column) -> Column:
    return F.coalesce(F.when((bid > 0) & (ask > 0), (bid + ask) / 2), F.when((delayed_bid > 0) & (delayed_ask > 0), (delayed_bid + delayed_ask) / 2))
