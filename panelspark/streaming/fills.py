"""Fills and bars as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream. A backlog is read in one trigger, so its files may come in any order;
    with per_trigger files at a time the delays of what follows must cover how far they are out of order."""
    stream = spark.readStream.schema(schema)
    return (stream if per_trigger is None else stream.option("maxFilesPerTrigger", per_trigger)).parquet(path)


def daily_activity(fills: DataFrame, delay: str, time: str = "time") -> DataFrame:
    """Trades and notional per day; fills later than `delay` after the latest one seen are dropped."""
    w = fills.withWatermark(time, delay).groupBy(F.window(time, "1 day"))
    return w.agg(F.count("*").alias("trades"), F.sum(F.col("quantity") * F.col("price")).alias("notional")).select(F.to_date("window.start").alias("date"), "trades", "notional")


def with_commissions(fills: DataFrame, commissions: DataFrame, delay: str, within: str = "1 minute") -> DataFrame:
    """Fills with the commission reported for them within a time bound; 0 where none comes.

    `delay` is how much later than the latest row seen a row may still come in event time, on either
    side; what comes later still is dropped (a fill with its row, a commission leaves its fill at 0). Take
    it from the source's real lateness: it has no default.
    """
    f = fills.withWatermark("time", delay).alias("f")
    c = commissions.withWatermark("reported", delay).alias("c")
    on = (F.col("f.exec_id") == F.col("c.exec_id")) & F.col("c.reported").between(F.col("f.time"), F.col("f.time") + F.expr(f"INTERVAL {within}"))
    return f.join(c, on, "left_outer").select("f.*", F.coalesce("c.commission", F.lit(0.0)).alias("commission"))


def refresh(bars: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `each` (a factor refresh, say) on the new bars of each micro-batch until all files are read."""
    return bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
