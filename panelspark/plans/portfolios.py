"""Queries over weights, returns and performance reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import diagnostics as dg
from panelspark.operators import models as md
from panelspark.operators import performance as pf
from panelspark.operators import sequential as sq

from . import twins as tw
from .base import LABELS, PANEL, WIDE, labels, panel, r, rd, rs, wide

W5 = f"{PANEL}, {WIDE}, {LABELS}, w5 AS MATERIALIZED (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom20 DESC, ticker) AS k FROM wide WHERE mom20 IS NOT NULL) WHERE k <= 5)"
RET = "ret AS MATERIALIZED (SELECT date, sum(weight * coalesce(label, 0)) AS gross_return FROM w5 LEFT JOIN labels USING (date, ticker) GROUP BY date)"
TURN = """turn AS MATERIALIZED (SELECT date, sum(abs(w)) AS turnover FROM (SELECT date, ticker, sum(w) AS w FROM (SELECT date, ticker, weight AS w FROM w5 UNION ALL
 SELECT next AS date, ticker, -weight AS w FROM w5 JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM w5)) USING (date) WHERE next IS NOT NULL) GROUP BY 1, 2) GROUP BY date)"""
NET = "net AS MATERIALIZED (SELECT date, gross_return, turnover, coalesce(turnover, 0) * 0.001 AS cost, gross_return - coalesce(turnover, 0) * 0.001 AS net_return FROM ret LEFT JOIN turn USING (date))"
BENCH = "bench AS MATERIALIZED (SELECT date, avg(p / lag_p - 1) AS benchmark_return FROM (SELECT date, ticker, p, lag(p) OVER (PARTITION BY ticker ORDER BY date) AS lag_p FROM (SELECT date, ticker, coalesce(last_value(adj_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(adj_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p FROM panel)) GROUP BY date)"
ALL = f"{W5}, {RET}, {TURN}, {NET}"
PAST = "OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)"
NAV = f"nav AS MATERIALIZED (SELECT *, nav / greatest(max(nav) {PAST}, 1) - 1 AS drawdown FROM (SELECT *, product(1 + net_return) {PAST} AS nav FROM net))"


def weights(s, d):
    return pf.top_k(wide(s, d), 5, "mom20")


def net(s, d):
    w = weights(s, d)
    return pf.net_returns(pf.portfolio_returns(w, labels(s, d)), pf.turnover(w))


def with_benchmark(s, d):
    return net(s, d).join(pf.benchmark_returns(panel(s, d)), "date")


def universe(s, d, k=10):
    p = s.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_retailprice").alias("cap"))
    return p.orderBy(F.desc("cap"), "ticker").limit(k)


def entries() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    q["top_k_weights"] = (lambda s, d: rd(weights(s, d)), f"WITH {W5} SELECT date, ticker, {r('weight')} FROM w5")
    q["inverse_volatility"] = (lambda s, d: rd(pf.inverse_volatility(wide(s, d).select("date", "ticker", F.col("vol20").alias("sd")))), f"WITH {PANEL}, {WIDE} SELECT date, ticker, {r('(1 / vol20) / sum(1 / vol20) OVER (PARTITION BY date)', 'weight')} FROM wide WHERE vol20 > 0")
    q["universe_top_by_cap"] = (lambda s, d: rd(universe(s, d), digits=2), f"SELECT p_brand AS ticker, {r('sum(p_retailprice)', 'cap', 2)} FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, 1 LIMIT 10")
    q["restrict_weights"] = (
        lambda s, d: rd(pf.restrict(weights(s, d), universe(s, d))),
        f"WITH {W5}, u AS (SELECT p_brand AS ticker FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, 1 LIMIT 10) SELECT date, ticker, {r('CASE WHEN sum(weight) OVER (PARTITION BY date) > 0 THEN weight / sum(weight) OVER (PARTITION BY date) ELSE 0 END', 'weight')} FROM w5 WHERE ticker IN (SELECT ticker FROM u)",
    )
    q["portfolio_returns"] = (lambda s, d: rd(net(s, d)), f"WITH {ALL} SELECT date, {rs('gross_return', 'turnover', 'cost', 'net_return')} FROM net")
    q["portfolio_curve"] = (lambda s, d: rd(pf.curve(net(s, d), "net_return").select("date", "nav", "drawdown")), f"WITH {ALL}, {NAV} SELECT date, {rs('nav', 'drawdown')} FROM nav")
    q["risk_summary"] = (
        lambda s, d: rd(pf.risk_summary(net(s, d), "net_return")),
        f"WITH {ALL}, {NAV} SELECT count(net_return) AS days, min(date) AS start, max(date) AS \"end\", {r('avg(net_return)', 'mean')}, {r('stddev_samp(net_return)', 'sd')}, {r('arg_max(nav, date) - 1', 'total_return')}, {r('min(drawdown)', 'max_drawdown')}, (SELECT date FROM nav ORDER BY drawdown, date LIMIT 1) AS max_drawdown_date, {r('avg(net_return) * 252', 'annual_return')}, {r('stddev_samp(net_return) * sqrt(252)', 'annual_volatility')}, {r('avg(net_return) / stddev_samp(net_return) * sqrt(252)', 'information_ratio')} FROM nav",
    )
    w = "OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    ok = lambda x: f"CASE WHEN count(net_return) {w} >= 60 THEN {x} END"
    q["rolling_performance"] = (
        lambda s, d: rd(pf.rolling_performance(net(s, d), "net_return")),
        f"WITH {ALL} SELECT date, {r(ok(f'avg(net_return) {w} * 252'), 'rolling_return')}, {r(ok(f'stddev_pop(net_return) {w} * sqrt(252)'), 'rolling_volatility')}, {r(ok(f'avg(net_return) {w} / nullif(stddev_pop(net_return) {w}, 0) * sqrt(252)'), 'rolling_sharpe')} FROM net",
    )
    beta = ok(f"covar_pop(net_return, benchmark_return) {w} / nullif(var_pop(benchmark_return) {w}, 0)")
    q["alpha_beta"] = (
        lambda s, d: rd(pf.alpha_beta(with_benchmark(s, d), "net_return", "benchmark_return")),
        f"WITH {ALL}, {BENCH}, j AS (SELECT * FROM net JOIN bench USING (date)), b AS (SELECT date, {beta} AS beta, avg(net_return) {w} AS m, avg(benchmark_return) {w} AS k FROM j) SELECT date, {r('beta')}, {r('(m - beta * k) * 252', 'alpha')} FROM b",
    )
    q["benchmark_mean_of_returns"] = (lambda s, d: rd(pf.benchmark_returns(panel(s, d))), f"WITH {PANEL}, {BENCH} SELECT date, {r('benchmark_return')} FROM bench")
    q["benchmark_return_of_mean"] = (lambda s, d: rd(pf.benchmark_returns(panel(s, d), "return_of_mean")), f"WITH {PANEL}, m AS (SELECT date, avg(adj_close) AS m FROM panel GROUP BY date) SELECT date, {r('m / lag(m) OVER (ORDER BY date) - 1', 'benchmark_return')} FROM m")
    q["excess_returns"] = (lambda s, d: rd(with_benchmark(s, d).select("date", (F.col("net_return") - F.coalesce("benchmark_return", F.lit(0.0))).alias("excess_return"))), f"WITH {ALL}, {BENCH} SELECT date, {r('net_return - coalesce(benchmark_return, 0)', 'excess_return')} FROM net JOIN bench USING (date)")
    lost = lambda s, d: net(s, d).select("date", F.explode(F.array(F.lit(-1.0), F.lit(-1.5))).alias("loss")).join(net(s, d), "date").withColumn("value", F.when((F.month("date") == 6) & (F.year("date") % 2 == 0), F.col("loss")).otherwise(F.col("net_return")))
    lost_sql = f"{ALL}, lost AS MATERIALIZED (SELECT date, loss, CASE WHEN month(date) = 6 AND year(date) % 2 = 0 THEN loss ELSE net_return END AS value FROM net, (VALUES (-1.0::DOUBLE), (-1.5::DOUBLE)) v(loss))"
    along = "OVER (PARTITION BY loss ORDER BY date ROWS UNBOUNDED PRECEDING)"
    q["curve_total_loss"] = (
        lambda s, d: rd(pf.curve(lost(s, d), "value", ["loss"]).select("date", "loss", "nav", "drawdown")),
        f"WITH {lost_sql}, n AS (SELECT date, loss, product(1 + value) {along} AS nav FROM lost) SELECT date, loss, {r('nav')}, {r(f'nav / greatest(max(nav) {along}, 1) - 1', 'drawdown')} FROM n",
    )
    q["monthly_total_loss"] = (lambda s, d: rd(pf.monthly(lost(s, d).where("loss = -1.5"), "value")), f"WITH {lost_sql} SELECT last_day(date) AS month, {r('product(1 + value) - 1', 'value')}, count(*) AS days FROM lost WHERE loss = -1.5 GROUP BY 1")
    q["monthly_returns"] = (lambda s, d: rd(pf.monthly(with_benchmark(s, d), "net_return", "benchmark_return")), f"WITH {ALL}, {BENCH} SELECT last_day(date) AS month, {r('product(1 + net_return) - 1', 'net_return')}, {r('product(1 + benchmark_return) - 1', 'benchmark_return')}, count(*) AS days FROM net JOIN bench USING (date) GROUP BY 1")
    q["best_worst_month"] = (
        lambda s, d: rd(pf.monthly(net(s, d), "net_return").agg(F.max_by("month", "net_return").alias("best_month"), F.max("net_return").alias("best"), F.min_by("month", "net_return").alias("worst_month"), F.min("net_return").alias("worst"))),
        f"WITH {ALL}, m AS (SELECT last_day(date) AS month, product(1 + net_return) - 1 AS x FROM net GROUP BY 1) SELECT arg_max(month, x) AS best_month, {r('max(x)', 'best')}, arg_min(month, x) AS worst_month, {r('min(x)', 'worst')} FROM m",
    )
    q["return_histogram"] = (
        lambda s, d: rd(pf.histogram(rd(net(s, d), "net_return", digits=8), "net_return", 50), digits=5),
        f"WITH {ALL}, x AS (SELECT {r('net_return', 'v', 8)} FROM net), l AS (SELECT min(v) AS a, max(v) AS b FROM x) SELECT CAST(CASE WHEN b > a THEN least(floor((v - a) / ((b - a) / 50)), 49) ELSE 0 END AS INTEGER) AS bin, count(*) AS n, {r('min(a + CASE WHEN b > a THEN least(floor((v - a) / ((b - a) / 50)), 49) ELSE 0 END * ((b - a) / 50))', 'low', 5)} FROM x, l GROUP BY 1",
    )
    scored = lambda s, d: wide(s, d).select("date", "ticker", F.col("mom20").alias("prediction"), "rev5")
    q["top_k_dropout"] = (lambda s, d: sq.top_k_dropout(scored(s, d).withColumn("strategy", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("prediction", F.when(F.col("strategy") == "a", F.col("prediction")).otherwise(F.col("rev5"))), 5, 2), tw.dropout_sql(5, 2))
    q["score_ndcg"] = (
        lambda s, d: rd(md.ndcg(dg.quantile_label(labels(s, d), 5).join(scored(s, d), ["date", "ticker"]), 10)),
        f"WITH {PANEL}, {WIDE}, {LABELS}, b AS (SELECT date, ticker, CASE WHEN label IS NOT NULL AND n >= 2 THEN greatest(ceil((k - 1) * least(5, n) / (n - 1.0)) - 1, 0) END AS bin FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY label NULLS LAST, ticker) AS k, count(label) OVER (PARTITION BY date) AS n FROM labels)), x AS (SELECT date, bin, row_number() OVER (PARTITION BY date ORDER BY mom20 DESC, ticker) AS p, row_number() OVER (PARTITION BY date ORDER BY bin DESC, ticker) AS t FROM b JOIN wide USING (date, ticker) WHERE bin IS NOT NULL AND mom20 IS NOT NULL) SELECT date, {r('sum(CASE WHEN p <= 10 THEN (pow(2, bin) - 1) / log2(p + 1) END) / nullif(sum(CASE WHEN t <= 10 THEN (pow(2, bin) - 1) / log2(t + 1) END), 0)', 'ndcg')} FROM x GROUP BY date",
    )
    q["score_fusion"] = (
        lambda s, d: rd(md.fused(wide(s, d).select("date", "ticker", "mom20", "rev5", "vol20"), {"mom20": 0.5, "rev5": 0.3, "vol20": 0.2}, vote=True), digits=5),
        f"WITH {PANEL}, {WIDE}, m AS (SELECT date, ticker, (coalesce(mom20 * 0.5, 0) + coalesce(rev5 * 0.3, 0) + coalesce(vol20 * 0.2, 0)) / nullif(CASE WHEN mom20 IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN rev5 IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN vol20 IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END, 0) AS m, coalesce(sign(mom20), 0) + coalesce(sign(rev5), 0) + coalesce(sign(vol20), 0) AS v FROM wide) SELECT date, ticker, {r('CASE WHEN v <> 0 THEN sign(v) ELSE sign(m) END * abs(m)', 'prediction', 5)} FROM m",
    )
    return q
