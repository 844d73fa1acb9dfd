"""Shared inputs of the queries: a small factor table on the weekly panel, its long form, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.expr import evaluate, round_to, rounded, sql_round, to_sql
from panelspark.operators import alphas as al
from panelspark.operators.cleaning import to_long
from panelspark.operators.diagnostics import forward_return
from panelspark.sources.panel import bars, densify, grid_sql

FACTORS = {"mom20": al.C / al.lag(20, al.C) - 1, "rev5": -(al.C / al.lag(5, al.C) - 1), "vol20": al.sd(20, al.r), "liq20": al.V / al.m(20, al.V), "range1": (al.H - al.L) / al.C}
NAMES = list(FACTORS)
BUCKETS = {"Momentum": ["mom20", "rev5"], "Volatility": ["vol20", "range1"], "Liquidity": ["liq20"]}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(bars(spark, sf_dir))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate(panel(spark, sf_dir), FACTORS), NAMES)


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(wide(spark, sf_dir), NAMES)


def labels(spark: SparkSession, sf_dir: str, horizon: int = 1, delay: int = 0) -> DataFrame:
    return forward_return(panel(spark, sf_dir), horizon, delay)


PANEL = f"panel AS MATERIALIZED ({grid_sql()})"
WIDE = f"wide AS MATERIALIZED ({to_sql(grid_sql(), FACTORS)})"
LONG = "long AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT date, ticker, '{n}' AS factor, {n} AS value FROM wide" for n in NAMES) + ")"
LABELS = "labels AS MATERIALIZED (SELECT date, ticker, lead(adj_close, 1) OVER o / nullif(adj_close, 0) - 1 AS label FROM panel WINDOW o AS (PARTITION BY ticker ORDER BY date))"
RANKS = """both_known AS (SELECT date, ticker, factor, value, label FROM long JOIN labels l USING (date, ticker) WHERE value IS NOT NULL AND label IS NOT NULL),
ranks AS MATERIALIZED (SELECT date, factor, (rank() OVER x + count(*) OVER (PARTITION BY date, factor ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 AS x,
 (rank() OVER y + count(*) OVER (PARTITION BY date, factor ORDER BY label RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 AS y,
 row_number() OVER (PARTITION BY date, factor ORDER BY value, ticker) AS fx, row_number() OVER (PARTITION BY date, factor ORDER BY label, ticker) AS fy FROM both_known
 WINDOW x AS (PARTITION BY date, factor ORDER BY value), y AS (PARTITION BY date, factor ORDER BY label))"""


def ic_sql(x: str = "x", y: str = "y", least: int = 10) -> str:
    return f"ics AS MATERIALIZED (SELECT date, factor, CASE WHEN count(*) >= {least} AND stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END AS ic, count(*) AS n FROM ranks GROUP BY date, factor)"


def rd(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The named columns rounded (all doubles if none is named)."""
    own = set(names) or {c for c, t in df.dtypes if t == "double"}
    return df.select(*[round_to(F.col(c), digits).alias(c) if c in own else F.col(c) for c in df.columns])


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"{sql_round(x, digits)} AS {name or x}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)
