"""Queries over factor analysis, saved models, stores by date, rolling covariances and the style chain."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelspark.functions.expr import to_sql
from panelspark.operators import diagnostics as dg
from panelspark.operators import latent
from panelspark.operators import modelstore as ms
from panelspark.operators import performance as pf
from panelspark.operators import risk as rk
from panelspark.operators import rolling as ro
from panelspark.operators import styles as sy
from panelspark.sources import stores
from panelspark.sources.panel import bars, bars_sql, grid_sql

from . import buildjob as bj
from . import jobs
from .base import FACTORS, LABELS, LONG, NAMES, PANEL, WIDE, labels, long, panel, r, rd, rs, wide
from .extras import FR, OLS, PREV, RETS, STYLES, predictions, returns
from .base import RANKS, ic_sql
from .portfolios import ALL, BENCH, net
from .research import CHUNKS, G, QUANTILE

MODEL = ["mom20", "rev5", "vol20"]


def labelled(s, d):
    return wide(s, d).join(labels(s, d), ["date", "ticker"])


def walked(s, d, kind="gbt", **params):
    return ms.walk_forward(labelled(s, d), MODEL, stores.scratch(s), n=3, kind=kind, **params)


def final_scores(s, d):
    """The newest year's scores by a model that was fitted on the years before, saved and loaded again."""
    path = stores.scratch(s)
    ms.save(ms.fit(labelled(s, d).where("date < '1998-01-01'"), MODEL, maxIter=10), path, s)
    return ms.load(s, path).score(wide(s, d), "1998-01-01", None, 20)


def final_moments(s, d):
    path = stores.scratch(s)
    ms.save(ms.fit(labelled(s, d), MODEL, kind="linear"), path, s)
    return s.read.parquet(f"{path}/features")


def final_nodes(s, d):
    path = stores.scratch(s)
    model = ms.fit(labelled(s, d), MODEL, maxIter=5)
    ms.save(model, path, s)
    return ms.nodes(s, model, path)


def stored_factors(s, d):
    """The factor store after a first fill and a refresh that finds the newer dates missing."""
    factors, ics = (stores.Store(s, stores.scratch(s)) for _ in range(2))
    jobs.update_stores(panel(s, d), FACTORS, factors, ics, 25, None, "1997-12-31")
    jobs.update_stores(panel(s, d), FACTORS, factors, ics, 25)
    return factors, ics


def stored_bars(s, d):
    store = stores.Store(s, stores.scratch(s))
    own = bars(s, d).select("date", "ticker", "close")
    store.replace(own.where("date < '1997-01-01'"))
    store.upsert(own.where("date >= '1996-12-01' AND ticker <> 'Brand#11'").withColumn("close", F.col("close") + 1))
    return store


UPSERTED = f"SELECT date, ticker, CASE WHEN date >= DATE '1996-12-01' AND ticker <> 'Brand#11' THEN close + 1 ELSE close END AS close FROM ({bars_sql()}) WHERE date < DATE '1997-01-01' OR ticker <> 'Brand#11'"


def window_over_buckets(s, d):
    name = f"prices_{uuid.uuid4().hex}"
    stores.bucketed(bars(s, d), name, 8, stores.scratch(s))
    return s.sql(f"SELECT date, ticker, avg(close) OVER w AS mean, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM {name} WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING)")


def built(s, d, **how):
    store = stores.Store(s, stores.scratch(s))
    job = bj.build_and_store(panel(s, d), FACTORS, store, **how)
    return bj.cl.to_long(store.read(), job.factors)


def enhanced(s, d):
    return bj.enhance(long(s, d), labels(s, d), bj.Enhancement((0.004, 0.0, 0.0), None, "ic_weighted"))


MAD = f"""mm AS (SELECT *, median(value) OVER g AS m FROM long {G}), md AS (SELECT *, median(abs(value - m)) OVER g AS dev FROM mm {G}),
 mad AS MATERIALIZED (SELECT date, ticker, factor, CASE WHEN value IS NOT NULL AND dev > 0 THEN least(greatest(value, m - 3 * dev), m + 3 * dev) ELSE value END AS value FROM md)"""
ENHANCED = f"""{PANEL}, {WIDE}, {LONG}, {LABELS}, {RANKS}, {ic_sql(least=2)}, stats AS MATERIALIZED (SELECT factor, avg(ic) AS ic_mean, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS icir, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS win_rate FROM ics GROUP BY factor),
 kept AS MATERIALIZED (SELECT factor FROM stats WHERE abs(ic_mean) >= 0.004), w AS MATERIALIZED (SELECT factor, abs(ic_mean) / sum(abs(ic_mean)) OVER () AS weight FROM stats SEMI JOIN kept USING (factor))"""


def months(s, d):
    """The last date of each month."""
    return returns(s, d).groupBy(F.last_day("date")).agg(F.max("date").alias("date")).select("date")


WINDOWS = f"""{RETS}, cal AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM rets)),
 x AS MATERIALIZED (SELECT i, ticker, ret FROM rets JOIN cal USING (date)), asked AS MATERIALIZED (SELECT max(date) AS date, max(i) AS i FROM cal GROUP BY last_day(date))"""

STYLE_BUCKETS = {"Momentum": ["mom20", "rev5"], "Volatility": ["vol20", "range1"], "Liquidity": ["liq20"]}


def buckets(s):
    return s.createDataFrame([(f, b) for b, fs in STYLE_BUCKETS.items() for f in fs], "factor string, bucket string")


def styles(s, d, **how):
    return sy.chain(long(s, d), None, "1995-06-01", buckets(s), list(STYLE_BUCKETS), **how)


def style_sql(keep: bool) -> str:
    """The chain in closed form: components of two features, and the second (third) style less what the first ones explain."""
    pair = lambda b, x, y: f"""{b}m AS (SELECT avg({x}) AS mx, avg({y}) AS my, var_pop({x}) AS a, covar_pop({x}, {y}) AS b, var_pop({y}) AS c FROM p, ref WHERE date = ref.day AND {x} IS NOT NULL AND {y} IS NOT NULL),
 {b}e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l FROM {b}m),
 {b}v AS (SELECT *, CASE WHEN abs(v1) >= abs(v2) * (1 - 1e-9) THEN sign(v1) ELSE sign(v2) END / sqrt(v1 * v1 + v2 * v2) AS k, l / (a + c) AS share FROM (SELECT *, CASE WHEN a >= c THEN l - c ELSE b END AS v1, CASE WHEN a >= c THEN b ELSE l - a END AS v2 FROM {b}e)),
 {b} AS (SELECT date, ticker, (v1 * ({x} - mx) + v2 * ({y} - my)) * k AS s, CASE WHEN share >= 0.5 THEN 'component' ELSE 'under_share' END AS path FROM p, {b}v WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""  # noqa: E731
    last = f""" UNION ALL SELECT date, ticker, 'Liquidity' AS style, 2 AS ord, {r('w / sqrt(sum(w * w) OVER (PARTITION BY date))', 'score')}, 'single' AS path FROM (SELECT *, z - sum(z * u) OVER d / sum(u * u) OVER d * u - sum(z * v) OVER d / sum(v * v) OVER d * v AS w FROM o WINDOW d AS (PARTITION BY date)) UNION ALL SELECT date, ticker, 'Liquidity', 2, {r('liq20 / sqrt(sum(liq20 * liq20) OVER (PARTITION BY date))', 'score')}, 'single' FROM p WHERE liq20 IS NOT NULL AND date NOT IN (SELECT date FROM o)""" if keep else ""
    return f"""WITH {PANEL}, {WIDE}, {LONG}, v AS (SELECT date, ticker, factor, CASE WHEN stddev_samp(value) OVER g >= 1e-8 THEN value END AS value FROM long {G}),
 c AS (SELECT date, ticker, factor, {QUANTILE.format(a=0.025, b=0.975)} AS value FROM v {G}), n AS (SELECT date, ticker, factor, CASE WHEN value IS NOT NULL THEN CASE WHEN stddev_samp(value) OVER g >= 1e-8 THEN (value - avg(value) OVER g) / stddev_samp(value) OVER g ELSE 0 END END AS value FROM c {G}),
 p AS MATERIALIZED (SELECT date, ticker, {", ".join(f"max(value) FILTER (factor = '{c}') AS {c}" for c in NAMES)} FROM n GROUP BY 1, 2), ref AS (SELECT max(date) AS day FROM p WHERE date <= DATE '1995-06-01'),
 {pair('mo', 'mom20', 'rev5')}, {pair('vo', 'range1', 'vol20')},
 o AS MATERIALIZED (SELECT *, y - sum(x * y) OVER d / sum(x * x) OVER d * x AS v, x AS u FROM (SELECT mo.date, mo.ticker, mo.s AS x, vo.s AS y, mo.path AS px, vo.path AS py{', liq20 AS z' if keep else ''} FROM mo JOIN vo ON vo.date = mo.date AND vo.ticker = mo.ticker{' JOIN p ON p.date = mo.date AND p.ticker = mo.ticker WHERE liq20 IS NOT NULL' if keep else ''}) WINDOW d AS (PARTITION BY date))
 SELECT date, ticker, 'Momentum' AS style, 0 AS ord, {r('u / sqrt(sum(u * u) OVER (PARTITION BY date))', 'score')}, px AS path FROM o UNION ALL SELECT date, ticker, 'Volatility', 1, {r('v / sqrt(sum(v * v) OVER (PARTITION BY date))', 'score')}, py FROM o{last}"""


def entries() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    # factor analysis
    standard = lambda s, d: latent.standardized(wide(s, d), NAMES)
    fit = lambda s, d: latent.factor_analysis(latent.moments(standard(s, d), NAMES), NAMES, 2)
    filled = ", ".join(f"coalesce({c}, median({c}) OVER g) AS {c}" for c in NAMES)
    z = ", ".join(f"CASE WHEN stddev_pop({c}) OVER g > 1e-12 THEN ({c} - avg({c}) OVER g) / stddev_pop({c}) OVER g ELSE 0 END AS {c}" for c in NAMES)
    products = " UNION ALL ".join(f"SELECT date, count(*) AS n, {a} AS a, {b} AS b, {r(f'coalesce(avg({x} * {y}), 0)', 'product')} FROM z GROUP BY date" for a, x in enumerate(NAMES) for b, y in enumerate(NAMES) if a <= b)
    q["factor_moments"] = (
        lambda s, d: rd(latent.moments(standard(s, d), NAMES)),
        f"WITH {PANEL}, {WIDE}, f AS (SELECT date, ticker, {filled} FROM wide WINDOW g AS (PARTITION BY date)), z AS MATERIALIZED (SELECT date, ticker, {z} FROM f WINDOW g AS (PARTITION BY date)) {products}",
    )
    q["factor_loadings"] = (fit, None)
    q["factor_components"] = (lambda s, d: latent.component_scores(standard(s, d), NAMES, fit(s, d)), None)
    # saved models
    q["walk_forward_boosted"] = (lambda s, d: walked(s, d, maxIter=10)[0], None)
    q["fold_importances"] = (lambda s, d: ms.top_features(walked(s, d, maxIter=10)[1], ["fold"]), None)
    q["final_model_scores"] = (final_scores, None)
    q["final_model_nodes"] = (final_nodes, None)
    known = f"{PANEL}, {WIDE}, {LABELS}, known AS MATERIALIZED (SELECT * FROM wide JOIN labels USING (date, ticker) WHERE label IS NOT NULL)"
    moment = lambda k, c, rows: f"SELECT {k} AS ord, '{c}' AS feature, {r(f'any_value(m)', 'median')}, {r('avg(coalesce(x, m))', 'mean')}, {r('stddev_pop(coalesce(x, m))', 'sd')} FROM (SELECT {c} AS x, median({c}) OVER () AS m FROM {rows})"
    q["final_model_moments"] = (lambda s, d: rd(final_moments(s, d)), f"WITH {known} " + " UNION ALL ".join(moment(k, c, "known") for k, c in enumerate(MODEL)))
    three = CHUNKS.replace("% 4", "% 3").replace("// 4", "// 3")
    by_fold = " UNION ALL ".join(f"SELECT {fold} AS fold, * FROM ({moment(k, c, f'(SELECT * FROM known JOIN chunks USING (date) WHERE chunk < {fold})')})" for fold in (1, 2) for k, c in enumerate(MODEL))
    q["fold_moments"] = (lambda s, d: rd(walked(s, d, "linear")[2]), f"WITH {known}, {three} {by_fold}")
    bin_ = "CASE WHEN label IS NOT NULL AND n >= 2 THEN greatest(ceil((k - 1) * least(5, n) / (n - 1.0)) - 1, 0) END AS bin FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY label NULLS LAST, ticker) AS k, count(label) OVER (PARTITION BY date) AS n FROM labels)"
    q["precision_recall"] = (
        lambda s, d: rd(ms.precision_recall(dg.quantile_label(labels(s, d), 5).join(wide(s, d).select("date", "ticker", F.col("mom20").alias("prediction")), ["date", "ticker"]), 5, 3)),
        f"WITH {PANEL}, {WIDE}, {LABELS}, b AS (SELECT date, ticker, {bin_}), x AS (SELECT date, bin, row_number() OVER (PARTITION BY date ORDER BY mom20 DESC, ticker) AS p FROM b JOIN wide USING (date, ticker) WHERE bin IS NOT NULL AND mom20 IS NOT NULL), h AS (SELECT date, count(*) FILTER (bin >= 3 AND p <= 5) AS hits, count(*) FILTER (bin >= 3) AS relevant, least(count(*), 5) AS k FROM x GROUP BY date) SELECT date, {r('hits / k', 'precision')}, {r('hits / nullif(relevant, 0)', 'recall')}, hits, relevant FROM h",
    )
    # stores
    q["store_refreshed"] = (lambda s, d: rd(stored_factors(s, d)[0].read().select("date", "ticker", *NAMES)), f"SELECT date, ticker, {rs(*NAMES)} FROM ({to_sql(grid_sql(), FACTORS)})")
    q["store_upserted"] = (lambda s, d: rd(stored_bars(s, d).read(), digits=4), f"SELECT date, ticker, {r('close', digits=4)} FROM ({UPSERTED})")
    q["store_span"] = (lambda s, d: stored_bars(s, d).span(), f"SELECT min(date) AS first, max(date) AS last, count(*) AS rows FROM ({UPSERTED})")
    q["bucketed_windows"] = (
        lambda s, d: rd(window_over_buckets(s, d)),
        f"SELECT date, ticker, {r('avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING)', 'mean')}, {r('lag(close) OVER (PARTITION BY ticker ORDER BY date)', 'before')} FROM ({bars_sql()})",
    )
    # moving windows
    q["rolling_covariance"] = (
        lambda s, d: rd(ro.rolling_covariance(returns(s, d), months(s, d), 60, 2, size=8)),
        f"WITH {WINDOWS} SELECT e.date, a.ticker AS ticker_a, b.ticker AS ticker_b, {r('covar_samp(a.ret, b.ret)', 'covariance')} FROM asked e JOIN x a ON a.i BETWEEN e.i - 59 AND e.i JOIN x b ON b.i = a.i GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    )
    scored = lambda s, d: predictions(s, d).join(months(s, d), "date", "left_semi")
    q["weights_by_date"] = (
        lambda s, d: rd(ro.weights_by_date(scored(s, d), returns(s, d))),
        f"WITH {WINDOWS}, {PANEL}, {WIDE}, p AS (SELECT date, i, ticker FROM wide JOIN asked USING (date) WHERE mom20 IS NOT NULL), v AS (SELECT p.date, p.ticker, 1 / nullif(stddev_samp(ret), 0) AS w FROM p JOIN x ON x.ticker = p.ticker AND x.i BETWEEN p.i - 59 AND p.i WHERE p.i >= 29 GROUP BY 1, 2), t AS (SELECT date, ticker, w, sum(w) OVER d AS t, count(*) OVER d AS k FROM p LEFT JOIN v USING (date, ticker) WINDOW d AS (PARTITION BY date)) SELECT date, ticker, {r('CASE WHEN t > 0 THEN coalesce(w, 0) / t ELSE 1 / k END', 'weight')} FROM t",
    )
    q["weights_by_date_gmv"] = (lambda s, d: ro.weights_by_date(scored(s, d), returns(s, d), "gmv", alpha=1e-4), None)
    q["weights_by_date_rp"] = (lambda s, d: ro.weights_by_date(scored(s, d), returns(s, d), "rp", lam=0.94), None)
    # the style chain
    q["style_chain"] = (lambda s, d: rd(styles(s, d)), style_sql(False))
    q["style_chain_singletons"] = (lambda s, d: rd(styles(s, d, keep_singletons=True)), style_sql(True))
    # the build job
    q["factor_build_stable"] = (
        lambda s, d: rd(built(s, d, process="mad", stability={"window": 20, "threshold": 0.5, "min_coverage": 0.25})),
        f"WITH {PANEL}, wide AS MATERIALIZED ({to_sql(grid_sql(), FACTORS, 12)}), {LONG}, {MAD}, c AS (SELECT factor, value, CASE WHEN count(value) OVER w >= 10 THEN stddev_samp(value) OVER w END AS s FROM mad WINDOW w AS (PARTITION BY factor, ticker ORDER BY date ROWS 19 PRECEDING)), k AS (SELECT factor FROM c GROUP BY factor HAVING median(s) <= 0.5 AND count(s) / count(*) >= 0.25) SELECT date, ticker, factor, {r('value')} FROM mad SEMI JOIN k USING (factor)",
    )
    q["factor_build_whole"] = (lambda s, d: built(s, d, process="standard", orthogonal=True, stability={"window": 20}, enhancement=bj.Enhancement((0.0, 0.0, 0.0), 0.9, "icir_weighted")), None)
    q["enhanced_factors"] = (
        lambda s, d: rd(enhanced(s, d)[0]),
        f"WITH {ENHANCED} SELECT date, ticker, factor, {r('value')} FROM long SEMI JOIN kept USING (factor) UNION ALL SELECT date, ticker, 'COMBINED', {r('CASE WHEN count(value) = any_value(n) THEN sum(value * weight) END', 'value')} FROM long JOIN w USING (factor), (SELECT count(*) AS n FROM w) GROUP BY 1, 2",
    )
    q["enhancement_report"] = (
        lambda s, d: rd(enhanced(s, d)[1]),
        f"WITH {ENHANCED} SELECT 'quality' AS step, factor, {r('ic_mean')}, {r('icir')}, {r('win_rate')}, abs(stats.ic_mean) >= 0.004 AS kept, NULL::DOUBLE AS weight FROM stats UNION ALL SELECT 'combination', factor, {r('ic_mean')}, {r('icir')}, {r('win_rate')}, NULL, {r('weight')} FROM stats JOIN w USING (factor)",
    )
    # smaller pieces
    q["label_series"] = (lambda s, d: rd(dg.label_series(panel(s, d), 3, 2)), f"WITH {PANEL} SELECT date, ticker, {r('lead(adj_close, 5) OVER o / nullif(lead(adj_close, 2) OVER o, 0) - 1', 'label')} FROM panel WINDOW o AS (PARTITION BY ticker ORDER BY date)")
    q["rolling_rank_ic"] = (
        lambda s, d: rd(dg.rolling_rank_ic(predictions(s, d), labels(s, d))),
        f"WITH {PANEL}, {WIDE}, {LONG}, {LABELS}, {RANKS}, {ic_sql(least=2)} SELECT date, {r('ic', 'rank_ic')}, {r('CASE WHEN count(ic) OVER w >= 20 THEN avg(ic) OVER w END', 'rank_ic_roll')} FROM ics WHERE factor = 'mom20' WINDOW w AS (ORDER BY date ROWS 59 PRECEDING)",
    )
    monthly = lambda s, d: pf.benchmark_returns(panel(s, d)).withColumn("m", F.last_day("date")).groupBy("m").agg(F.max("date").alias("date"), F.max_by("benchmark_return", "date").alias("benchmark_return")).select("date", "benchmark_return")
    q["aligned_benchmark"] = (
        lambda s, d: rd(pf.aligned_series(net(s, d).select("date", "net_return"), monthly(s, d), "benchmark_return")),
        f"WITH {ALL}, {BENCH}, m AS (SELECT max(date) AS date, arg_max(benchmark_return, date) AS x FROM bench GROUP BY last_day(date)) SELECT n.date, {r('n.net_return', 'net_return')}, {r('coalesce((SELECT arg_max(x, m.date) FROM m WHERE m.date <= n.date AND x IS NOT NULL), 0)', 'benchmark_return')} FROM net n",
    )
    q["covariance_ridged"] = (
        lambda s, d: rd(rk.ridged_covariance(rk.previous_covariance(rk.factor_returns(wide(s, d), labels(s, d), STYLES))), digits=4),
        f"WITH {PANEL}, {WIDE}, {LABELS}, {OLS}, {FR}, {PREV}, m AS (SELECT date, max(covariance) FILTER (style_a = 'mom20' AND style_b = 'mom20') AS a, max(covariance) FILTER (style_a <> style_b) AS b, max(covariance) FILTER (style_a = 'vol20' AND style_b = 'vol20') AS c FROM prev GROUP BY date), e AS (SELECT date, (a + c) / 2 AS h, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l FROM m), f AS (SELECT date, h, (2 * h - l) * 1e12 < l AS ridged FROM e) SELECT date, style_a, style_b, {r('covariance + CASE WHEN ridged AND style_a = style_b THEN 1e-6 * h ELSE 0 END', 'covariance', 4)}, ridged FROM prev JOIN f USING (date)",
    )
    return q
