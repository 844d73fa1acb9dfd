"""Queries over reports, combinations, covariances, the risk job and the store jobs, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.expr import to_sql
from panelspark.operators import cleaning as cl
from panelspark.operators import combine as cb
from panelspark.operators import covariance as cv
from panelspark.operators import diagnostics as dg
from panelspark.operators import models as md
from panelspark.operators import reports as rp
from panelspark.operators import risk as rk
from panelspark.operators import trades as tr
from panelspark.sources.panel import bars, bars_sql, grid_sql

from . import jobs
from . import portfolios as pl
from . import twins as tw
from .base import BUCKETS, FACTORS, LABELS, LONG, NAMES, PANEL, WIDE, ic_sql, labels, long, panel, r, rd, rs, wide
from .research import IC, QUANTILE, SUMMARY_SQL, ics

ICS = f"{IC}, {ic_sql()}, summary AS MATERIALIZED ({SUMMARY_SQL}), sampled AS MATERIALIZED (SELECT factor, stddev_samp(ic) AS ic_std_sample FROM ics GROUP BY factor)"
STYLES = ["mom20", "vol20"]
PRED = "pred AS MATERIALIZED (SELECT date, ticker, mom20 AS prediction FROM wide WHERE mom20 IS NOT NULL)"
RETS = f"b AS MATERIALIZED ({bars_sql()}), rets AS MATERIALIZED (SELECT date, ticker, ret FROM (SELECT date, ticker, adj_close / nullif(lag(adj_close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM b) WHERE ret IS NOT NULL)"
PAIRS = f"{RETS}, pairs AS (SELECT date, a.ticker AS ticker_a, b.ticker AS ticker_b, a.ret AS x, b.ret AS y FROM rets a JOIN rets b USING (date))"
# one date's least squares of the label on mom20 and vol20 with intercept, by its normal equations
OLS = """fit AS MATERIALIZED (SELECT date, n, (c1y * v22 - c2y * v12) / (v11 * v22 - v12 * v12) AS f1, (c2y * v11 - c1y * v12) / (v11 * v22 - v12 * v12) AS f2 FROM (SELECT date, count(*) AS n, covar_pop(mom20, label) AS c1y, covar_pop(vol20, label) AS c2y, var_pop(mom20) AS v11, var_pop(vol20) AS v22, covar_pop(mom20, vol20) AS v12 FROM wide JOIN labels USING (date, ticker) WHERE mom20 IS NOT NULL AND vol20 IS NOT NULL AND label IS NOT NULL GROUP BY date) WHERE n > 3)"""
FR = "fr AS MATERIALIZED (SELECT date, 'mom20' AS style, f1 AS factor_return FROM fit UNION ALL SELECT date, 'vol20', f2 FROM fit)"
EXPO = "expo AS MATERIALIZED (SELECT date, factor AS style, sum(weight * value) / nullif(sum(weight), 0) AS exposure FROM long JOIN w5 USING (date, ticker) WHERE factor IN ('mom20', 'vol20') AND value IS NOT NULL GROUP BY 1, 2)"
PREV = """cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM fr)), fi AS (SELECT i, style, factor_return AS x FROM fr JOIN cal USING (date)),
 pw AS (SELECT c.date, a.style AS style_a, b.style AS style_b, a.x, b.x AS y, pow(0.94, c.i - a.i - 1) * CASE WHEN c.i - a.i = least(c.i - 1, 252) THEN 1.0 ELSE 0.06 END AS w FROM cal c JOIN fi a ON a.i < c.i AND a.i >= c.i - 252 JOIN fi b ON b.i = a.i),
 prev AS MATERIALIZED (SELECT date, style_a, style_b, (sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) * (sum(w) * sum(w) / nullif(sum(w) * sum(w) - sum(w * w), 0)) AS covariance FROM pw GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
RESID = "resid AS MATERIALIZED (SELECT date, ticker, label - mom20 * f1 - vol20 * f2 AS residual FROM wide JOIN labels USING (date, ticker) JOIN fit USING (date) WHERE mom20 IS NOT NULL AND vol20 IS NOT NULL AND label IS NOT NULL)"
SPEC = "spec AS MATERIALIZED (SELECT date, stddev_samp(residual) AS specific_sd, sum(weight * weight * residual * residual) AS specific_variance FROM resid LEFT JOIN w5 USING (date, ticker) GROUP BY date HAVING count(weight) > 0)"
DECO = """own AS (SELECT a.date, a.style, sum(a.exposure * covariance * b.exposure) AS v FROM expo a JOIN prev p ON p.date = a.date AND style_a = a.style JOIN expo b ON b.date = a.date AND style_b = b.style GROUP BY 1, 2),
 part AS (SELECT own.* FROM own SEMI JOIN spec USING (date) UNION ALL SELECT date, 'Specific', specific_variance FROM spec SEMI JOIN own USING (date)),
 deco AS MATERIALIZED (SELECT date, style, 100 * v / total AS contribution, total AS total_variance FROM (SELECT *, sum(v) OVER (PARTITION BY date) AS total FROM part) WHERE total > 0)"""
RISK = f"{pl.W5}, {LONG}, {OLS}, {FR}, {EXPO}, {PREV}, {RESID}, {SPEC}, {DECO}"


def scores(s, d, names=STYLES):
    return cl.to_long(wide(s, d), names).select("date", "ticker", F.col("factor").alias("bucket"), F.col("value").alias("score"))


def summary(s, d):
    own = ics(s, d)
    return dg.ic_summary(own).join(own.groupBy("factor").agg(F.stddev_samp("ic").alias("ic_std_sample")), "factor")


def predictions(s, d):
    return wide(s, d).select("date", "ticker", F.col("mom20").alias("prediction")).where("prediction is not null")


def returns(s, d):
    return cv.returns_of(bars(s, d))


def names(s, d):
    """Factor names of all kinds, from the parts' sizes and keys."""
    kinds = [*[f"{p}{'' if p.endswith('_') else '_X'}" for ps in rk.BUCKETS.values() for p in ps], "Alpha", "foo_bar_"]
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select(F.concat(F.get(F.lit(kinds), (F.col("p_partkey") % len(kinds)).cast("int")), F.col("p_size").cast("string")).alias("factor")).distinct(), kinds


def names_sql() -> str:
    kinds = [*[f"{p}{'' if p.endswith('_') else '_X'}" for ps in rk.BUCKETS.values() for p in ps], "Alpha", "foo_bar_"]
    return f"SELECT DISTINCT ({kinds})[CAST(p_partkey % {len(kinds)} AS INTEGER) + 1] || CAST(p_size AS VARCHAR) AS factor FROM part"


def ticker_names(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    k, six = F.col("p_partkey"), F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0")
    up = F.upper(F.regexp_replace("p_name", "[^A-Za-z]", ""))
    name = F.when(k % 7 == 0, F.concat(F.lit("sh"), six)).when(k % 7 == 1, six).when(k % 7 == 2, F.concat(six, F.lit(".SZ"))).when(k % 7 == 3, F.substring(up, 1, 4)).when(k % 7 == 4, F.concat(F.substring(up, 1, 3), F.lit("-B"))).when(k % 7 == 5, F.col("p_name")).otherwise(F.concat(F.lit("BJ"), six, F.lit("9")))
    return p.select(name.alias("name")).distinct()


TICKERS = """SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN 'sh' || six WHEN 1 THEN six WHEN 2 THEN six || '.SZ' WHEN 3 THEN substr(up, 1, 4) WHEN 4 THEN substr(up, 1, 3) || '-B' WHEN 5 THEN p_name ELSE 'BJ' || six || '9' END AS name
 FROM (SELECT p_partkey, p_name, lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS six, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS up FROM part)"""


def entries() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    from panelspark.operators import selection as sl

    q["ticker_market"] = (
        lambda s, d: ticker_names(s, d).select("name", sl.ticker_market(F.col("name")).alias("market")),
        f"SELECT name, CASE WHEN regexp_full_match(lower(name), '(sh|sz|bj)[0-9]{{6}}') OR regexp_full_match(name, '[0-9]{{6}}([.][A-Za-z]{{2}})?') THEN 'cn' WHEN regexp_full_match(name, '[A-Z]{{1,5}}([-.][A-Z]{{1,2}})?') THEN 'us' ELSE 'other' END AS market FROM ({TICKERS})",
    )
    case = " ".join(f"WHEN {' OR '.join(f'contains(factor, {chr(39)}{p}{chr(39)})' for p in ps)} THEN '{b}'" for b, ps in rk.BUCKETS.items())
    q["bucket_classify"] = (lambda s, d: rk.classify(names(s, d)[0]), f"SELECT factor, CASE {case} ELSE 'Unclassified' END AS bucket FROM ({names_sql()})")
    every = " UNION ALL ".join(f"SELECT factor, '{b}' AS bucket FROM n WHERE {' OR '.join(f'contains(factor, {chr(39)}{p}{chr(39)})' for p in ps)}" for b, ps in rk.BUCKETS.items())
    q["bucket_classify_all"] = (lambda s, d: rk.classify(names(s, d)[0], "all"), f"WITH n AS ({names_sql()}) {every}")
    # reports
    passed = "SELECT 'moderate' AS rule, factor FROM summary WHERE abs(ic_mean) > 0.005 AND abs(icir) > 0.05 AND win_rate > 0.5 UNION ALL SELECT 'strict', factor FROM summary WHERE abs(ic_mean) > 0.02 AND abs(icir) > 0.5 AND win_rate > 0.6 AND abs(t_stat) > 1.97"
    q["ic_rules"] = (lambda s, d: rp.screened(dg.ic_summary(ics(s, d))), f"WITH {ICS} {passed}")
    q["daily_factor_report"] = (
        lambda s, d: rd(rp.daily_factor_report(ics(s, d), "1997-06-15", 3)),
        f"WITH {ICS}, a AS (SELECT max(date) AS newest FROM ics WHERE date <= DATE '1997-06-15'), h AS (SELECT factor, max(newest) AS date, max(CASE WHEN date = newest THEN ic END) AS ic, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS win_rate FROM ics, a WHERE date <= newest GROUP BY factor) SELECT factor, date, {rs('ic', 'icir', 'win_rate')} FROM h WHERE h.ic IS NOT NULL ORDER BY abs(h.ic) DESC, factor LIMIT 3",
    )
    q["factors_on_date"] = (lambda s, d: rd(rp.factors_on(long(s, d), "1996-07-01").select("ticker", F.explode("factors").alias("factor", "value"))), f"WITH {PANEL}, {WIDE}, {LONG} SELECT ticker, factor, {r('value')} FROM long WHERE date = DATE '1996-07-01' AND value IS NOT NULL")
    q["factor_contribution"] = (lambda s, d: rd(rp.contribution(ics(s, d), ["mom20", "rev5", "liq20"])), f"WITH {ICS} SELECT factor, {r('avg(ic)', 'daily_ic_mean')}, {r('stddev_samp(ic)', 'daily_ic_std')}, count(ic) AS coverage_days FROM ics WHERE factor IN ('mom20', 'rev5', 'liq20') GROUP BY factor")
    q["prediction_stats"] = (lambda s, d: rd(rp.latest_prediction_stats(predictions(s, d))), f"WITH {PANEL}, {WIDE}, {PRED} SELECT date, {r('avg(prediction)', 'mean')}, {r('stddev_samp(prediction)', 'std')}, {r('min(prediction)', 'min')}, {r('max(prediction)', 'max')}, count(prediction) AS n FROM pred WHERE date = (SELECT max(date) FROM pred) GROUP BY date")
    q["live_report"] = (lambda s, d: rd(rp.live_report(predictions(s, d), labels(s, d))), f"WITH {IC}, {ic_sql(least=2)} SELECT date, {r('ic')}, n FROM ics WHERE factor = 'mom20'")
    q["correlation_top"] = (
        lambda s, d: rd(rp.top_submatrix(dg.factor_correlation(wide(s, d), NAMES), rp.factor_score(summary(s, d)), 20)),
        f"WITH {PANEL}, {WIDE}, {LONG} SELECT a.factor AS factor_a, b.factor AS factor_b, {r('CASE WHEN a.factor = b.factor THEN 1.0 ELSE coalesce(corr(a.value, b.value), 0) END', 'correlation')} FROM long a JOIN long b USING (date, ticker) WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2",
    )
    q["clusters"] = (
        lambda s, d: rd(rp.clusters(dg.ic_summary(ics(s, d)), rk.style_exposure(long(s, d), scores(s, d)), 0.3)),
        f"WITH {ICS}, j AS (SELECT a.date, a.factor, b.factor AS style, a.value AS x, b.value AS y FROM long a JOIN long b USING (date, ticker) WHERE b.factor IN ('mom20', 'vol20') AND a.value IS NOT NULL AND b.value IS NOT NULL), c AS (SELECT date, factor, style, count(*) AS n, covar_pop(x, y) AS c, stddev_pop(x) AS a, stddev_pop(y) AS b FROM j GROUP BY 1, 2, 3), e AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY abs(exposure) DESC, style) AS k FROM (SELECT factor, style, avg(c / (a * b)) AS exposure FROM c WHERE n >= 10 AND a > 1e-12 AND b > 1e-12 GROUP BY 1, 2)), t AS (SELECT factor, max(CASE WHEN k = 1 THEN style END) AS style_1, max(CASE WHEN k = 1 THEN exposure END) AS exposure_1, max(CASE WHEN k = 2 THEN style END) AS style_2, max(CASE WHEN k = 2 THEN exposure END) AS exposure_2 FROM e GROUP BY factor) SELECT factor, {rs('ic_mean', 'icir')}, style_1, {r('exposure_1')}, style_2, {r('exposure_2')}, CASE WHEN abs(t.exposure_1) >= 0.3 THEN style_1 ELSE 'Custom' END AS dominant_style, coalesce(t.exposure_1 = 0, true) AS degenerate FROM summary LEFT JOIN t USING (factor)",
    )
    q["cumulative_to_daily"] = (
        lambda s, d: rd(rp.daily_from_cumulative(panel(s, d).where("close is not null").groupBy("date").agg(F.avg("close").alias("cumulative")).withColumn("factor", F.lit("mean")))),
        f"WITH {PANEL}, c AS (SELECT date, avg(close) AS cumulative, 'mean' AS factor FROM panel WHERE close IS NOT NULL GROUP BY date) SELECT date, {r('cumulative')}, factor, {r('cumulative / nullif(lag(cumulative) OVER (ORDER BY date), 0) - 1', 'daily')} FROM c",
    )
    q["statement_totals"] = (
        lambda s, d: rd(rp.statement_totals(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("account"), *(F.when(F.col("event_type") == e, F.col("value")).alias(c) for e, c in (("click", "realized"), ("view", "unrealized"), ("purchase", "cash_flow"))), "value")), digits=4),
        f"SELECT CAST(user_id AS VARCHAR) AS account, {r(chr(99) + 'oalesce(sum(value) FILTER (event_type = ' + chr(39) + 'click' + chr(39) + '), 0)', 'realized', 4)}, {r('coalesce(sum(value) FILTER (event_type = ' + chr(39) + 'view' + chr(39) + '), 0)', 'unrealized', 4)}, {r('coalesce(sum(value) FILTER (event_type = ' + chr(39) + 'purchase' + chr(39) + '), 0)', 'cash_flow', 4)}, {r('coalesce(sum(value), 0) + coalesce(sum(value) FILTER (event_type = ' + chr(39) + 'purchase' + chr(39) + '), 0)', 'net_liquidation', 4)} FROM events GROUP BY user_id",
    )
    # choosing and combining
    q["factor_quality"] = (lambda s, d: rd(cb.quality(summary(s, d), 0.001, 0.01, 0.45)), f"WITH {ICS} SELECT factor, {r('ic_mean')}, {r('coalesce(ic_mean / nullif(ic_std_sample, 0), 0)', 'icir')}, {r('win_rate')}, abs(summary.ic_mean) >= 0.001 AND abs(coalesce(summary.ic_mean / nullif(ic_std_sample, 0), 0)) >= 0.01 AND summary.win_rate >= 0.45 AS kept FROM summary JOIN sampled USING (factor)")
    q["keep_by_icir"] = (lambda s, d: cb.by_icir(dg.ic_summary(ics(s, d)), 0.02), f"WITH {ICS} SELECT factor FROM summary WHERE abs(icir) >= 0.02")
    size = {"ic_weighted": "abs(ic_mean)", "icir_weighted": "abs(coalesce(ic_mean / nullif(ic_std_sample, 0), 0))", "equal_weight": "1.0"}
    for method in size:
        q[f"combined_{method}"] = (
            lambda s, d, m=method: rd(cb.combined(long(s, d), cb.combination_weights(cb.quality(summary(s, d)), m))),
            f"WITH {ICS}, cw AS (SELECT factor, x / sum(x) OVER () AS weight FROM (SELECT factor, {size[method]} AS x FROM summary JOIN sampled USING (factor))) SELECT date, ticker, {r('CASE WHEN count(value) = count(*) THEN sum(value * weight) END', 'combined')} FROM long JOIN cw USING (factor) GROUP BY 1, 2",
        )
    z = "zs AS (SELECT date, ticker, factor, (value - avg(value) OVER g) / (CASE WHEN stddev_pop(value) OVER g > 1e-12 THEN stddev_pop(value) OVER g ELSE 1 END) AS after FROM long WINDOW g AS (PARTITION BY date, factor))"
    avg_rank = lambda c: f"(rank() OVER (PARTITION BY factor ORDER BY {c}) + count(*) OVER (PARTITION BY factor ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0"
    kept = f"k AS (SELECT factor, value, after, {avg_rank('value')} AS x, {avg_rank('after')} AS y FROM long JOIN zs USING (date, ticker, factor) WHERE value IS NOT NULL AND after IS NOT NULL)"
    ok = lambda e, n: r(f"CASE WHEN count(*) >= 100 THEN coalesce({e}, 0) ELSE 0.0 END", n, 5)
    q["information_kept"] = (lambda s, d: rd(cb.information_kept(long(s, d), rd(cl.zscore(long(s, d)), digits=12)), digits=5), f"WITH {PANEL}, {WIDE}, {LONG}, {z.replace('AS after', 'AS a0').replace('zs AS (', 'zs AS (SELECT date, ticker, factor, round(a0, 12) AS after FROM (')}), {kept} SELECT factor, {ok('corr(value, after)', 'pearson')}, {ok('corr(x, y)', 'spearman')}, {ok('stddev_samp(after) / nullif(stddev_samp(value), 0)', 'std_ratio')}, count(*) AS samples FROM k GROUP BY factor")
    how = {"none": lambda x: x, "zscore": cl.zscore, "rank": cl.rank_normalize, "winsorize": cl.winsorize}
    q["compared_processing"] = (lambda s, d: rd(cb.compared_processing(long(s, d), how), digits=5), tw.compared_sql(QUANTILE))
    q["orthogonal_by_ic"] = (lambda s, d: rd(rk.orthogonal(wide(s, d), cb.ic_order(dg.ic_summary(ics(s, d))), unit=False)), tw.orthogonal_by_ic_sql(ICS, NAMES))
    q["principal_components"] = (lambda s, d: cb.principal_components(wide(s, d), NAMES), None)
    # covariances and weights
    q["covariance_sample"] = (lambda s, d: rd(cv.sample_covariance(returns(s, d)), digits=6), f"WITH {PAIRS} SELECT ticker_a, ticker_b, {r('covar_samp(x, y)', 'covariance', 6)} FROM pairs GROUP BY 1, 2")
    q["covariance_ewma"] = (
        lambda s, d: rd(cv.ewma_covariance(returns(s, d)), digits=6),
        f"WITH {PAIRS}, age AS (SELECT date, pow(0.94, row_number() OVER (ORDER BY date DESC) - 1) AS w FROM (SELECT DISTINCT date FROM rets)) SELECT ticker_a, ticker_b, {r('(sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) * (sum(w) * sum(w) / nullif(sum(w) * sum(w) - sum(w * w), 0))', 'covariance', 6)} FROM pairs JOIN age USING (date) GROUP BY 1, 2",
    )
    q["covariance_shrunk"] = (
        lambda s, d: rd(cv.shrunk_covariance(returns(s, d)), digits=6),
        f"WITH {RETS}, f AS (SELECT date, ticker, coalesce(ret, 0) AS ret FROM (SELECT DISTINCT date FROM rets) CROSS JOIN (SELECT DISTINCT ticker FROM rets) LEFT JOIN rets USING (date, ticker)), c AS MATERIALIZED (SELECT date, ticker, ret - avg(ret) OVER (PARTITION BY ticker) AS ret FROM f), m AS MATERIALIZED (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, avg(a.ret * b.ret) AS s FROM c a JOIN c b USING (date) GROUP BY 1, 2), one AS (SELECT sum(CASE WHEN ticker_a = ticker_b THEN s END) / count(*) FILTER (ticker_a = ticker_b) AS mu, sum(s * s) AS norm, count(*) FILTER (ticker_a = ticker_b) AS p FROM m), q AS (SELECT sum(q * q) AS fourth, count(*) AS n FROM (SELECT date, sum(ret * ret) AS q FROM c GROUP BY date)), sh AS (SELECT mu, least(greatest((fourth / n - norm) / n / p, 0), norm / p - mu * mu) / nullif(norm / p - mu * mu, 0) AS sh FROM one, q) SELECT ticker_a, ticker_b, {r('(1 - sh) * s + CASE WHEN ticker_a = ticker_b THEN sh * mu ELSE 0 END', 'covariance', 6)} FROM m, sh",
    )
    q["weights_least_variance"] = (lambda s, d: cv.optimal_weights(cv.shrunk_covariance(returns(s, d))), None)
    q["weights_risk_parity"] = (lambda s, d: cv.optimal_weights(cv.shrunk_covariance(returns(s, d)), "rp"), None)
    q["weights_inverse_volatility"] = (
        lambda s, d: rd(cv.optimal_weights(cv.sample_covariance(returns(s, d)), "inv").select("ticker", "weight")),
        f"WITH {RETS}, v AS (SELECT ticker, 1 / stddev_samp(ret) AS i FROM rets GROUP BY ticker) SELECT ticker, {r('i / sum(i) OVER ()', 'weight')} FROM v",
    )
    raw = lambda s, d: pl.weights(s, d).withColumn("weight", F.when(F.month("date") == 2, 0.0).otherwise(F.col("weight") * F.length("ticker")))
    raw_sql = "raw AS (SELECT date, ticker, CASE WHEN month(date) = 2 THEN 0.0 ELSE weight * length(ticker) END AS weight FROM w5), dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM panel)), us AS (SELECT date, ticker, CASE WHEN coalesce(n, 0) < 30 OR t <= 0 THEN 1.0 / k ELSE weight / t END AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY date) AS t, count(*) OVER (PARTITION BY date) AS k FROM raw LEFT JOIN dn USING (date)))"
    q["weights_usable"] = (lambda s, d: rd(cv.usable(raw(s, d), panel(s, d))), f"WITH {pl.W5}, {raw_sql} SELECT date, ticker, {r('weight')} FROM us")
    q["weight_diagnostics"] = (lambda s, d: rd(cv.weight_diagnostics(cv.usable(raw(s, d), panel(s, d)))), f"WITH {pl.W5}, {raw_sql} SELECT date, count(*) FILTER (weight > 0) AS names, {r('max(weight)', 'largest')}, {r('1 / nullif(sum(weight * weight), 0)', 'effective')} FROM us GROUP BY date")
    earliest = lambda s, d: predictions(s, d).orderBy("date", F.desc("prediction"), "ticker").limit(5).select("ticker")
    q["weights_newest"] = (lambda s, d: rd(cv.weights_for_newest(predictions(s, d), predictions(s, d).limit(0), 5, 2)), tw.newest_sql(5, 2, held=False))
    q["weights_newest_held"] = (lambda s, d: rd(cv.weights_for_newest(predictions(s, d), earliest(s, d), 5, 2)), tw.newest_sql(5, 2, held=True))
    # risk
    q["factor_returns_ols"] = (lambda s, d: rd(rk.factor_returns(wide(s, d), labels(s, d), STYLES), digits=4), f"WITH {PANEL}, {WIDE}, {LABELS}, {OLS}, {FR} SELECT date, style, {r('factor_return', digits=4)} FROM fr")
    fr = lambda s, d: rk.factor_returns(wide(s, d), labels(s, d), STYLES)
    last = "age AS (SELECT date, pow(0.94, k) * CASE WHEN k = n - 1 THEN 1 ELSE 0.06 END AS w FROM (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM fr))), cov AS (SELECT x.style AS style_a, y.style AS style_b, (sum(w * x.factor_return * y.factor_return) / sum(w) - sum(w * x.factor_return) / sum(w) * sum(w * y.factor_return) / sum(w)) * (sum(w) * sum(w) / (sum(w) * sum(w) - sum(w * w))) AS covariance FROM fr x JOIN fr y USING (date) JOIN age USING (date) GROUP BY 1, 2)"
    q["risk_shares"] = (
        lambda s, d: rd(rk.risk_shares(rk.portfolio_exposure(scores(s, d), pl.weights(s, d)), rk.ewma_covariance(fr(s, d)), 0.01), digits=3),
        f"WITH {pl.W5}, {LONG}, {OLS}, {FR}, {EXPO}, {last}, v AS (SELECT a.date, a.style, sum(a.exposure * covariance * b.exposure) AS v FROM expo a JOIN cov ON style_a = a.style JOIN expo b ON b.date = a.date AND style_b = b.style GROUP BY 1, 2), t AS (SELECT *, sum(v) OVER (PARTITION BY date) + 0.01 AS total FROM v) SELECT date, style, {r('100 * v / total', 'contribution', 3)}, {r('1.0 / total', 'specific', 3)} FROM t WHERE total > 0",
    )
    q["walk_forward_linear"] = (lambda s, d: rd(md.walk_forward(wide(s, d).join(labels(s, d), ["date", "ticker"]), ["mom20", "vol20"], "label", 3, kind="linear"), digits=5), tw.walk_forward_sql("mom20", "vol20", 3))
    trades = lambda s, d: bars(s, d).groupBy("ticker").agg(F.max_by("adj_close", "date").alias("price"), F.count("*").alias("n"))
    q["trade_deltas"] = (
        lambda s, d: rd(tr.trade_deltas(trades(s, d).where("n % 2 = 0").select(F.lit("x").alias("account"), "ticker", F.lit(0.04).alias("weight"), "price", F.lit(1).alias("ord")), trades(s, d).where("n % 3 = 0").select(F.lit("x").alias("account"), "ticker", F.col("n").cast("double").alias("shares")), 1e6, 1e9)),
        f"WITH x AS (SELECT ticker, arg_max(adj_close, date) AS price, count(*) AS n FROM ({bars_sql()}) GROUP BY ticker), j AS (SELECT ticker, price, n, CASE WHEN n % 2 = 0 THEN floor(1e6 * 0.04 / price) ELSE 0 END - CASE WHEN n % 3 = 0 THEN n ELSE 0 END AS raw FROM x WHERE n % 2 = 0 OR n % 3 = 0) SELECT 'x' AS account, ticker, {r('CAST(raw AS DOUBLE)', 'delta')} FROM j WHERE abs(raw) >= 1 AND (raw < 0 OR n % 2 <> 0 OR raw * price >= 100)",
    )
    q["covariance_of_previous"] = (lambda s, d: rd(rk.previous_covariance(fr(s, d)), digits=4), f"WITH {PANEL}, {WIDE}, {LABELS}, {OLS}, {FR}, {PREV} SELECT date, style_a, style_b, {r('covariance', digits=4)} FROM prev")
    q["specific_risk"] = (lambda s, d: rd(rk.specific_risk(rk.residuals(wide(s, d), labels(s, d), fr(s, d), STYLES), pl.weights(s, d)), digits=5), f"WITH {pl.W5}, {OLS}, {RESID}, {SPEC} SELECT date, {rs('specific_sd', 'specific_variance', digits=5)} FROM spec")
    q["risk_table"] = (lambda s, d: rd(jobs.risk_table(wide(s, d), labels(s, d), pl.weights(s, d), STYLES), digits=3), f"WITH {RISK} SELECT date, style, {r('exposure', digits=3)}, {r('contribution', digits=3)}, {r('total_variance', digits=3)} FROM deco LEFT JOIN expo USING (date, style) WHERE date IN (SELECT DISTINCT date FROM deco ORDER BY date DESC LIMIT 30)")
    q["risk_table_day"] = (lambda s, d: rd(rp.style_rows(jobs.risk_table(wide(s, d), labels(s, d), pl.weights(s, d), STYLES), "2001-08-01"), digits=3), f"WITH {RISK}, t AS (SELECT date, style, exposure, contribution, total_variance FROM deco LEFT JOIN expo USING (date, style) WHERE date IN (SELECT DISTINCT date FROM deco ORDER BY date DESC LIMIT 30)) SELECT date, style, {rs('exposure', 'contribution', 'total_variance', digits=3)} FROM t WHERE date = (SELECT max(date) FROM t WHERE date <= DATE '2001-08-01')")
    q["regression_exposure"] = (
        lambda s, d: rd(rk.regression_exposure(long(s, d), scores(s, d, ["mom20"]), ["mom20"]), digits=4),
        f"WITH {PANEL}, {WIDE}, {LONG}, j AS (SELECT date, factor, regr_slope(value, mom20) AS b FROM long JOIN wide USING (date, ticker) WHERE value IS NOT NULL AND mom20 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5) SELECT factor, 'mom20' AS style, {r('avg(b)', 'exposure', 4)} FROM j GROUP BY factor",
    )
    q["regression_exposure_two"] = (lambda s, d: rd(rk.regression_exposure(long(s, d), scores(s, d), STYLES), digits=4), tw.regression_exposure_sql(*STYLES))
    q["unweighted_exposure"] = (
        lambda s, d: rd(rk.unweighted_exposure(long(s, d)), digits=5),
        f"WITH {PANEL}, {WIDE}, {LONG}, z AS (SELECT date, factor, (value - avg(value) OVER g) / nullif(stddev_samp(value) OVER g, 0) AS z FROM long WHERE value IS NOT NULL WINDOW g AS (PARTITION BY date, factor)) SELECT date, factor, {r('median(z)', 'exposure', 5)}, {r('var_samp(z)', 'variance', 5)} FROM z GROUP BY 1, 2",
    )
    q["fixed_structure_scores"] = (lambda s, d: rd(rk.applied_structure(wide(s, d), rk.fixed_structure(wide(s, d), BUCKETS, "1995-06-01")), digits=5), tw.fixed_structure_sql(BUCKETS, "1995-06-01"))
    # stores and jobs
    q["prices_table"] = (lambda s, d: rd(jobs.as_table(bars(s, d)).sparkSession.sql("SELECT ticker, count(*) AS bars, max(close) AS high FROM prices GROUP BY ticker")), f"SELECT ticker, count(*) AS bars, {r('max(close)', 'high')} FROM ({bars_sql()}) GROUP BY ticker")
    q["training_medians"] = (lambda s, d: rd(jobs.medians(wide(s, d), NAMES)), f"WITH {PANEL}, {WIDE} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {k} AS ord, {r(f'median({c})', 'median')} FROM wide" for k, c in enumerate(NAMES)))
    q["scored_range"] = (
        lambda s, d: rd(jobs.scored(wide(s, d), jobs.medians(wide(s, d), ["mom20", "vol20"]), jobs.linear_score({"mom20": 2.0, "vol20": -1.0}, 0.5), "1996-01-01", "1996-12-31", 20).withColumn("n", F.lit(1))),
        f"WITH {PANEL}, {WIDE}, m AS (SELECT median(mom20) AS a, median(vol20) AS b FROM wide), x AS (SELECT date, ticker, coalesce(mom20, a) * 2 - coalesce(vol20, b) + 0.5 AS prediction, count(*) OVER (PARTITION BY date) AS k FROM wide, m WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') SELECT date, ticker, {r('prediction')}, 1 AS n FROM x WHERE k >= 20",
    )
    seg = (("1992-01-01", "1995-12-31"), ("1996-01-01", "1996-12-31"), ("1997-01-01", "2099-12-31"))
    q["date_segments"] = (lambda s, d: jobs.segments(panel(s, d), *seg).groupBy("segment").agg(F.countDistinct("date").alias("dates"), F.count("*").alias("rows")), f"WITH {PANEL} SELECT segment, count(DISTINCT date) AS dates, count(*) AS rows FROM (SELECT date, CASE WHEN date BETWEEN DATE '1992-01-01' AND DATE '1995-12-31' THEN 'train' WHEN year(date) = 1996 THEN 'valid' WHEN date >= DATE '1997-01-01' THEN 'test' END AS segment FROM panel) WHERE segment IS NOT NULL GROUP BY 1")
    bin_ = "CAST(CASE WHEN n >= 2 THEN greatest(ceil((k - 1) * least(5, n) / (n - 1.0)) - 1, 0) END AS INTEGER) AS bin"
    q["ranker_panel"] = (
        lambda s, d: rd(jobs.ranker_panel(wide(s, d), labels(s, d), ["mom20", "vol20"], lag=1, least=20).drop("label")),
        f"WITH {PANEL}, {WIDE}, {LABELS}, l AS (SELECT date, ticker, lag(mom20) OVER o AS mom20, lag(vol20) OVER o AS vol20 FROM wide WINDOW o AS (PARTITION BY ticker ORDER BY date)), f AS (SELECT date, ticker, coalesce(mom20, median(mom20) OVER g) AS mom20, coalesce(vol20, median(vol20) OVER g) AS vol20 FROM l WINDOW g AS (PARTITION BY date)), j AS (SELECT f.*, label, row_number() OVER (PARTITION BY date ORDER BY label, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM f JOIN labels USING (date, ticker) WHERE label IS NOT NULL) SELECT date, ticker, {rs('mom20', 'vol20')}, {bin_} FROM j WHERE n >= 20",
    )
    q["regression_panel"] = (lambda s, d: rd(jobs.regression_panel(wide(s, d).withColumn("flat", F.lit(1.0)), labels(s, d), ["mom20", "flat", "vol20"]).drop("label")), f"WITH {PANEL}, {WIDE}, {LABELS} SELECT date, ticker, {rs('mom20', 'vol20')} FROM wide JOIN labels USING (date, ticker) WHERE label IS NOT NULL")
    old = lambda s, d: bars(s, d).where("date < '1997-01-01'").select("date", "ticker", "close")
    new = lambda s, d: bars(s, d).where("date >= '1996-12-01'").select("date", "ticker", (F.col("close") + 1).alias("close"))
    q["append_bars"] = (lambda s, d: rd(jobs.append_bars(old(s, d), new(s, d).unionAll(new(s, d).withColumn("close", F.col("close") - 1))), digits=4), f"SELECT date, ticker, {r('CASE WHEN date >= DATE ' + chr(39) + '1996-12-01' + chr(39) + ' THEN close + 1 ELSE close END', 'close', 4)} FROM ({bars_sql()})")
    q["date_span"] = (lambda s, d: jobs.date_span(bars(s, d)), f"SELECT min(date) AS first, max(date) AS last, count(DISTINCT date) AS dates FROM ({bars_sql()})")
    store = lambda s, d: panel(s, d).where("date < '1998-01-01'").select("date", "ticker")
    q["refresh_factors"] = (lambda s, d: rd(jobs.refresh_factors(panel(s, d), store(s, d), FACTORS, 25).select("date", "ticker", *NAMES)), f"SELECT date, ticker, {rs(*NAMES)} FROM ({to_sql(grid_sql(), FACTORS)}) WHERE date >= DATE '1998-01-01'")
    scaled = ", ".join(r(f"({c} - avg({c}) OVER g) / (CASE WHEN stddev_pop({c}) OVER g > 1e-12 THEN stddev_pop({c}) OVER g ELSE 1 END)", c, 2) for c in NAMES)
    q["factor_build"] = (
        lambda s, d: rd(jobs.build(panel(s, d), FACTORS, pl.universe(s, d, 10).select("ticker"), "zscore"), digits=2),
        f"WITH {PANEL}, u AS (SELECT p_brand AS ticker FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, 1 LIMIT 10), x AS (SELECT date, ticker, {', '.join(NAMES)} FROM ({to_sql(grid_sql(), FACTORS)}) SEMI JOIN u USING (ticker)) SELECT date, ticker, {scaled} FROM x WINDOW g AS (PARTITION BY date)",
    )
    q["joined_columns"] = (lambda s, d: rd(jobs.joined_columns(bars(s, d), bars(s, d).drop("close")).groupBy("ticker").agg(F.count("*").alias("n"), F.count("close").alias("known"))), f"SELECT ticker, 2 * count(*) AS n, count(close) AS known FROM ({bars_sql()}) GROUP BY ticker")
    return q
