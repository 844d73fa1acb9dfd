"""Queries over selection, joins, fills, positions and the risk model."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import indicators as ti
from panelspark.operators import risk as rk
from panelspark.operators import selection as sl
from panelspark.operators import trades as tr
from panelspark.sources.panel import bars, bars_sql, densify, grid_sql, table

from . import portfolios as pl
from . import twins as tw
from .base import BUCKETS, LABELS, NAMES, PANEL, WIDE, LONG, labels, long, panel, r, rd, rs, wide

FILLS = "fills AS MATERIALIZED (SELECT event_id AS exec_id, CAST(user_id AS VARCHAR) AS account, event_type AS symbol, CASE WHEN event_id % 3 = 0 THEN 'BOT' WHEN event_id % 3 = 1 THEN 'SLD' ELSE 'buy' END AS side, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, value AS price, ts AS time FROM events)"
COMMISSIONS = "commissions AS (SELECT event_id AS exec_id, value * 0.001 AS commission FROM events WHERE event_id % 2 = 0)"
DAY = "CAST(time AS DATE)"


def fills(s, d):
    e = table(s, d, "events")
    k = F.col("event_id") % 3
    return e.select(F.col("event_id").alias("exec_id"), F.col("user_id").cast("string").alias("account"), F.col("event_type").alias("symbol"), F.when(k == 0, "BOT").when(k == 1, "SLD").otherwise("buy").alias("side"), F.get_json_object("props", "$.k").cast("double").alias("quantity"), F.col("value").alias("price"), F.col("ts").alias("time"))


def commissions(s, d):
    return table(s, d, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("exec_id"), (F.col("value") * 0.001).alias("commission"))


def bad_windows(s):
    return s.sql("SELECT timestamp'2024-01-03 08:00:00' AS start, timestamp'2024-01-03 16:00:00' AS end UNION ALL SELECT timestamp'2024-01-10 00:00:00', timestamp'2024-01-10 23:59:59'")


def held(s, d):
    return table(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_brand").alias("ticker")).where("ticker < 'Brand#15'").distinct()


def target(s, d):
    return pl.universe(s, d, 10).select("ticker")


def entries() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    # sources and keys
    q["panel_bars"] = (lambda s, d: rd(bars(s, d), digits=4), f"SELECT date, ticker, {rs('open', 'high', 'low', 'close', 'adj_close', 'volume', digits=4)} FROM ({bars_sql()})")
    q["panel_densify"] = (lambda s, d: rd(densify(bars(s, d, "l_suppkey")).select("date", "ticker", "close"), digits=4), f"SELECT date, ticker, {r('close', digits=4)} FROM ({grid_sql('l_suppkey')})")
    q["panel_densify_span"] = (
        lambda s, d: densify(bars(s, d, "l_suppkey"), True).groupBy("ticker").agg(F.count("*").alias("rows"), F.count("close").alias("bars")),
        f"WITH g AS (SELECT *, min(CASE WHEN close IS NOT NULL THEN date END) OVER (PARTITION BY ticker) AS a, max(CASE WHEN close IS NOT NULL THEN date END) OVER (PARTITION BY ticker) AS b FROM ({grid_sql('l_suppkey')})) SELECT ticker, count(*) AS rows, count(close) AS bars FROM g WHERE date BETWEEN a AND b GROUP BY ticker",
    )
    q["date_range"] = (lambda s, d: rd(sl.date_range(bars(s, d), "1996-01-01", "1996-12-31").select("date", "ticker", "close"), digits=4), f"SELECT date, ticker, {r('close', digits=4)} FROM ({bars_sql()}) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
    u10 = "u AS (SELECT p_brand AS ticker FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, 1 LIMIT 10)"
    q["universe_filter"] = (lambda s, d: sl.in_universe(bars(s, d), target(s, d)).groupBy("ticker").agg(F.count("*").alias("bars")), f"WITH {u10} SELECT ticker, count(*) AS bars FROM ({bars_sql()}) WHERE ticker IN (SELECT ticker FROM u) GROUP BY ticker")
    q["universe_missing"] = (lambda s, d: sl.missing_from(sl.date_range(bars(s, d, "l_suppkey"), None, "1995-01-15"), table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"))), f"SELECT CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier WHERE CAST(s_suppkey AS VARCHAR) NOT IN (SELECT ticker FROM ({bars_sql('l_suppkey')}) WHERE date <= DATE '1995-01-15')")
    odd = lambda s, d: bars(s, d).withColumn("adj_close", F.col("adj_close") - 2000).withColumn("volume", F.col("volume") - 20)
    odd_sql = f"odd AS (SELECT date, ticker, close, adj_close - 2000 AS adj_close, volume - 20 AS volume FROM ({bars_sql()}))"
    q["repair"] = (lambda s, d: rd(sl.repaired(odd(s, d)).select("date", "ticker", "adj_close", "volume"), digits=4), f"WITH {odd_sql} SELECT date, ticker, {r('CASE WHEN adj_close >= 0 THEN adj_close END', 'adj_close', 4)}, {r('CASE WHEN volume < 0 THEN 0 ELSE volume END', 'volume', 4)} FROM odd")
    q["repair_counts"] = (lambda s, d: sl.repair_counts(odd(s, d)), f"WITH {odd_sql} SELECT count(*) FILTER (close < 0) AS negative_close, count(*) FILTER (adj_close < 0) AS negative_adj_close, count(*) FILTER (volume < 0) AS negative_volume, count(*) AS rows FROM odd")
    q["canonical_ticker"] = (lambda s, d: table(s, d, "part").select(sl.canonical_ticker(F.col("p_name")).alias("ticker")).groupBy("ticker").count().withColumnRenamed("count", "n"), "SELECT regexp_replace(upper(trim(p_name)), '[. ]+', '-', 'g') AS ticker, count(*) AS n FROM part GROUP BY 1")
    q["nearest_date"] = (lambda s, d: sl.nearest_date(bars(s, d), "1997-05-07"), f"SELECT max(date) AS date FROM ({bars_sql()}) WHERE date <= DATE '1997-05-07'")
    q["last_dates"] = (lambda s, d: sl.last_dates(bars(s, d), 5).groupBy("date").agg(F.count("*").alias("n")), f"SELECT date, count(*) AS n FROM ({bars_sql()}) GROUP BY date ORDER BY date DESC LIMIT 5")
    q["last_months"] = (lambda s, d: sl.last_months(bars(s, d), 12).groupBy("date").agg(F.count("*").alias("n")), f"WITH b AS ({bars_sql()}) SELECT date, count(*) AS n FROM b WHERE date >= (SELECT max(date) - INTERVAL 12 MONTH FROM b) GROUP BY date")
    q["next_dates"] = (lambda s, d: rd(sl.next_dates(wide(s, d).select("date", "ticker", "mom20"))), f"WITH {PANEL}, {WIDE} SELECT next AS date, ticker, {r('mom20')} FROM wide JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM wide)) USING (date) WHERE next IS NOT NULL")
    q["feature_lag"] = (lambda s, d: rd(sl.lagged(wide(s, d).select("date", "ticker", "mom20", "vol20"), ["mom20"], 2)), f"WITH {PANEL}, {WIDE} SELECT date, ticker, {r('lag(mom20, 2) OVER (PARTITION BY ticker ORDER BY date)', 'mom20')}, {r('vol20')} FROM wide")
    q["dedupe_first"] = (
        lambda s, d: sl.first_of(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity")),
        "SELECT l_linenumber, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem) WHERE k = 1 GROUP BY 1",
    )
    q["as_of_join"] = (
        lambda s, d: sl.as_of(bars(s, d), pl.weights(s, d).where(F.month("date") % 3 == 0)).withColumn("as_of", F.col("as_of").cast("string")),
        f"WITH {pl.W5}, x AS (SELECT DISTINCT date FROM ({bars_sql()})), y AS (SELECT DISTINCT date FROM w5 WHERE month(date) % 3 = 0) SELECT x.date, CAST(max(y.date) AS VARCHAR) AS as_of FROM x LEFT JOIN y ON y.date <= x.date GROUP BY x.date",
    )
    q["upsert"] = (
        lambda s, d: rd(sl.upsert(bars(s, d).select("date", "ticker", "close"), sl.date_range(bars(s, d), "2000-01-01").select("date", "ticker", (F.col("close") * 2).alias("close")), ["date", "ticker"]), digits=4),
        f"SELECT date, ticker, {r('CASE WHEN date >= DATE ' + chr(39) + '2000-01-01' + chr(39) + ' THEN close * 2 ELSE close END', 'close', 4)} FROM ({bars_sql()})",
    )
    hs = "h AS (SELECT DISTINCT p_brand AS ticker FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#15')"
    q["held_and_target"] = (lambda s, d: sl.held_and_target(held(s, d), target(s, d)), f"WITH {u10}, {hs} SELECT coalesce(h.ticker, u.ticker) AS ticker, CASE WHEN u.ticker IS NULL THEN 'sell' WHEN h.ticker IS NULL THEN 'buy' ELSE 'keep' END AS state FROM h FULL JOIN u ON h.ticker = u.ticker")
    q["latest_prices"] = (
        lambda s, d: rd(sl.latest_prices(bars(s, d), table(s, d, "part").select(F.lower("p_brand").alias("ticker")).distinct()), digits=4),
        f"WITH b AS ({bars_sql()}), l AS (SELECT DISTINCT date FROM b ORDER BY date DESC LIMIT 5), x AS (SELECT upper(ticker) AS t, arg_max(adj_close, date) AS price, max(date) AS price_date FROM b WHERE date IN (SELECT date FROM l) AND adj_close > 0 GROUP BY 1) SELECT ticker, {r('price', digits=4)}, price_date FROM (SELECT DISTINCT lower(p_brand) AS ticker FROM part) LEFT JOIN x ON upper(ticker) = t",
    )
    q["data_profile"] = (
        lambda s, d: rd(sl.data_profile(wide(s, d).join(labels(s, d), ["date", "ticker"]), ["mom20", "vol20"])),
        f"WITH {PANEL}, {WIDE}, {LABELS}, j AS (SELECT * FROM wide JOIN labels USING (date, ticker)), c AS (SELECT date, count(*) AS n FROM j GROUP BY date) SELECT (SELECT count(*) FROM c) AS dates, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS rows, (SELECT min(n) FROM c) AS rows_min, (SELECT max(n) FROM c) AS rows_max, {r('(SELECT avg(n) FROM c)', 'rows_mean')}, {r('(SELECT median(n) FROM c)', 'rows_median')}, {r('avg(CAST(label IS NULL AS DOUBLE))', 'label_missing')}, {r('avg(label)', 'label_mean')}, {r('stddev_samp(label)', 'label_std')}, {r('quantile_cont(label, 0.1)', 'label_q10')}, {r('quantile_cont(label, 0.5)', 'label_q50')}, {r('quantile_cont(label, 0.9)', 'label_q90')}, {r('avg(CAST(mom20 IS NULL AS DOUBLE))', 'missing_mom20')}, {r('avg(CAST(vol20 IS NULL AS DOUBLE))', 'missing_vol20')} FROM j",
    )
    q["share_of_total"] = (lambda s, d: rd(sl.share_of_total(bars(s, d).select("date", "ticker", "volume"), "volume", ["date"]).drop("volume")), f"SELECT date, ticker, {r('CASE WHEN sum(volume) OVER (PARTITION BY date) > 0 THEN volume * 100 / sum(volume) OVER (PARTITION BY date) ELSE 0 END', 'share')} FROM ({bars_sql()})")
    # fills and positions
    side = "CASE WHEN upper(side) IN ('BOT', 'BUY') THEN 'BUY' WHEN upper(side) IN ('SLD', 'SELL') THEN 'SELL' ELSE upper(side) END AS side"
    q["fills_normalized"] = (
        lambda s, d: rd(tr.normalized_fills(fills(s, d), commissions(s, d)).select("exec_id", "account", "symbol", "side", "quantity", "amount", "commission")),
        f"WITH {FILLS}, {COMMISSIONS} SELECT exec_id, account, symbol, {side}, {r('quantity')}, {r('quantity * price', 'amount')}, {r('coalesce(commission, 0)', 'commission')} FROM fills LEFT JOIN commissions USING (exec_id) WHERE quantity > 0 AND price > 0",
    )
    q["fills_outside_windows"] = (lambda s, d: tr.outside_windows(fills(s, d), bad_windows(s)).select("exec_id"), f"WITH {FILLS} SELECT exec_id FROM fills WHERE NOT (time BETWEEN TIMESTAMP '2024-01-03 08:00:00' AND TIMESTAMP '2024-01-03 16:00:00') AND NOT (time BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 23:59:59')")
    q["fills_filtered"] = (lambda s, d: tr.filtered(fills(s, d), "2024-01-05", "2024-01-07", "Click").select("exec_id"), f"WITH {FILLS} SELECT exec_id FROM fills WHERE {DAY} BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' AND symbol = 'click'")
    q["fills_ny_time"] = (lambda s, d: fills(s, d).select("exec_id", F.date_format(tr.ny_time(F.date_format("time", "yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("ny")), f"WITH {FILLS} SELECT exec_id, strftime(date_trunc('second', time) - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS ny FROM fills")
    q["daily_activity"] = (lambda s, d: rd(tr.daily_activity(fills(s, d)), digits=4), f"WITH {FILLS} SELECT {DAY} AS date, count(*) AS trades, {r('sum(quantity * price)', 'notional', 4)} FROM fills GROUP BY 1")
    rows = lambda s, d: fills(s, d).groupBy("account", F.col("symbol").alias("ticker")).agg(F.sum("quantity").alias("shares"), F.min("price").alias("avg_cost"), F.max_by("price", F.struct("time", "exec_id")).alias("current_price"))
    rows_sql = "pos AS (SELECT account, symbol AS ticker, sum(quantity) AS shares, min(price) AS avg_cost, arg_max(price, row(time, exec_id)) AS current_price FROM fills GROUP BY 1, 2)"
    q["positions"] = (lambda s, d: rd(tr.positions(rows(s, d)).select("account", "ticker", "market_value", "unrealized_pnl", "weight"), digits=5), f"WITH {FILLS}, {rows_sql} SELECT account, ticker, {r('shares * current_price', 'market_value', 5)}, {r('CASE WHEN avg_cost > 0 THEN shares * current_price - shares * avg_cost ELSE 0 END', 'unrealized_pnl', 5)}, {r('coalesce(shares * current_price / nullif(sum(shares * current_price) OVER (PARTITION BY account), 0), 0)', 'weight', 5)} FROM pos")
    q["model_positions"] = (
        lambda s, d: rd(tr.model_positions(pl.weights(s, d), bars(s, d).where("volume > 0").groupBy("ticker").agg(F.max_by("adj_close", "date").alias("price")), 1e6).select("date", "ticker", "quantity")),
        f"WITH {pl.W5}, p AS (SELECT ticker, arg_max(adj_close, date) AS price FROM ({bars_sql()}) WHERE volume > 0 GROUP BY 1) SELECT date, ticker, {r('coalesce(1e6 * weight / nullif(price, 0), 0)', 'quantity')} FROM w5 LEFT JOIN p USING (ticker)",
    )
    q["usable_capital"] = (lambda s, d: rd(table(s, d, "customer").select("c_custkey", tr.usable_capital(F.col("c_acctbal"), 0.9, F.when(F.col("c_custkey") % 3 != 0, F.lit(500.0))).alias("capital"))), f"SELECT c_custkey, {r('CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 0.9 ELSE least(c_acctbal * 0.9, 500.0) END', 'capital')} FROM customer")
    q["account_values"] = (
        lambda s, d: rd(tr.account_values(table(s, d, "events").select(F.col("user_id").cast("string").alias("account"), F.col("event_type").alias("tag"), F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value")), ["click", "view"])),
        f"SELECT CAST(user_id AS VARCHAR) AS account, {r(chr(109) + 'ax(CASE WHEN event_type = ' + chr(39) + 'click' + chr(39) + ' THEN value END)', 'click')}, {r('max(CASE WHEN event_type = ' + chr(39) + 'view' + chr(39) + ' THEN value END)', 'view')} FROM events WHERE event_id % 5 <> 0 GROUP BY 1",
    )
    # risk model
    R = f"{PANEL}, {WIDE}, {LONG}, {LABELS}"
    single = lambda s, d: long(s, d).select("date", "ticker", F.col("factor").alias("bucket"), F.col("value").alias("score"))
    q["portfolio_exposure"] = (lambda s, d: rd(rk.portfolio_exposure(single(s, d), pl.weights(s, d)), digits=4), f"WITH {pl.W5}, {LONG} SELECT date, factor AS style, {r('sum(weight * value) / nullif(sum(weight), 0)', 'exposure', 4)} FROM long JOIN w5 USING (date, ticker) WHERE value IS NOT NULL GROUP BY 1, 2")
    q["raw_exposure"] = (
        lambda s, d: rd(rk.raw_exposure(long(s, d), pl.weights(s, d), 3)),
        f"WITH {pl.W5}, {LONG}, m AS (SELECT date, factor, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY 1, 2), h AS (SELECT date, factor, sum(weight * value) / nullif(sum(weight), 0) AS h FROM long JOIN w5 USING (date, ticker) WHERE value IS NOT NULL GROUP BY 1, 2), e AS (SELECT date, factor, (h - m) / nullif(s, 0) AS exposure FROM h JOIN m USING (date, factor)), f AS (SELECT *, 100 * exposure * exposure / nullif(sum(exposure * exposure) OVER (PARTITION BY date), 0) AS share, row_number() OVER (PARTITION BY date ORDER BY abs(exposure) DESC, factor) AS k FROM e WHERE exposure IS NOT NULL) SELECT date, factor, {rs('exposure', 'share')} FROM f WHERE k <= 3",
    )
    q["style_exposure"] = (
        lambda s, d: rd(rk.style_exposure(long(s, d), single(s, d))),
        f"WITH {R}, j AS (SELECT a.date, a.factor, b.factor AS style, a.value AS x, b.value AS y FROM long a JOIN long b USING (date, ticker) WHERE a.value IS NOT NULL AND b.value IS NOT NULL), c AS (SELECT date, factor, style, count(*) AS n, covar_pop(x, y) AS c, stddev_pop(x) AS a, stddev_pop(y) AS b FROM j GROUP BY 1, 2, 3) SELECT factor, style, {r('avg(c / (a * b))', 'exposure')} FROM c WHERE n >= 10 AND a > 1e-12 AND b > 1e-12 GROUP BY 1, 2",
    )
    q["dominant_style"] = (
        lambda s, d: rd(rk.dominant_style(rk.style_exposure(long(s, d), single(s, d)), 0.3)),
        f"WITH {R}, j AS (SELECT a.date, a.factor, b.factor AS style, a.value AS x, b.value AS y FROM long a JOIN long b USING (date, ticker) WHERE a.value IS NOT NULL AND b.value IS NOT NULL), c AS (SELECT date, factor, style, count(*) AS n, covar_pop(x, y) AS c, stddev_pop(x) AS a, stddev_pop(y) AS b FROM j GROUP BY 1, 2, 3), e AS (SELECT factor, style, avg(c / (a * b)) AS exposure FROM c WHERE n >= 10 AND a > 1e-12 AND b > 1e-12 GROUP BY 1, 2) SELECT factor, CASE WHEN max(abs(exposure)) >= 0.3 THEN arg_max(style, abs(exposure)) ELSE 'Custom' END AS dominant_style, {r('max(abs(exposure))', 'size')} FROM e GROUP BY 1",
    )
    q["ewma_covariance"] = (
        lambda s, d: rd(rk.ewma_covariance(_two_returns(s, d)), digits=5),
        f"WITH {TWO}, a AS (SELECT *, row_number() OVER (ORDER BY date DESC) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM two)), w AS (SELECT date, pow(0.94, k) * CASE WHEN k = n - 1 THEN 1 ELSE 0.06 END AS w FROM a), j AS (SELECT x.style AS style_a, y.style AS style_b, w, x.factor_return AS x, y.factor_return AS y FROM two x JOIN two y USING (date) JOIN w USING (date)) SELECT style_a, style_b, {r('(sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) * (sum(w) * sum(w) / (sum(w) * sum(w) - sum(w * w)))', 'covariance', 5)} FROM j GROUP BY 1, 2",
    )
    q["factor_return_single"] = (
        lambda s, d: rd(rk.factor_returns(wide(s, d), labels(s, d), ["mom20"]), digits=5),
        f"WITH {R}, j AS (SELECT date, mom20 AS x, label AS y FROM wide JOIN labels USING (date, ticker) WHERE mom20 IS NOT NULL AND label IS NOT NULL) SELECT date, 'mom20' AS style, {r('regr_slope(y, x)', 'factor_return', 5)} FROM j GROUP BY date HAVING count(*) > 2",
    )
    q["bucket_scores"] = (lambda s, d: rd(rk.bucket_scores(wide(s, d), BUCKETS), digits=5), tw.bucket_scores_sql(BUCKETS))
    q["orthogonal_styles"] = (lambda s, d: rd(rk.orthogonal(wide(s, d), ["mom20", "vol20", "liq20"])), tw.orthogonal_sql(["mom20", "vol20", "liq20"]))
    q["ta_recursive"] = (lambda s, d: rd(ti.recursive(bars(s, d)), digits=5), tw.recursive_sql())
    return q


TWO = f"{PANEL}, m AS (SELECT date, avg(close) AS c, avg(volume) AS v FROM panel GROUP BY date), t AS (SELECT date, c / lag(c) OVER (ORDER BY date) - 1 AS price, v / lag(v) OVER (ORDER BY date) - 1 AS volume FROM m), two AS MATERIALIZED (SELECT date, 'price' AS style, price AS factor_return FROM t WHERE price IS NOT NULL UNION ALL SELECT date, 'volume', volume FROM t WHERE price IS NOT NULL)"


def _two_returns(s, d):
    from pyspark.sql import Window

    m = panel(s, d).groupBy("date").agg(F.avg("close").alias("c"), F.avg("volume").alias("v"))
    w = Window.orderBy("date")  # one row per date
    t = m.select("date", (F.col("c") / F.lag("c").over(w) - 1).alias("price"), (F.col("v") / F.lag("v").over(w) - 1).alias("volume")).where("price is not null")
    return t.unpivot("date", ["price", "volume"], "style", "factor_return")
