"""Queries over labels, cleaning and factor diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import cleaning as cl
from panelspark.operators import diagnostics as dg

from .base import LABELS, LONG, NAMES, PANEL, RANKS, WIDE, ic_sql, labels, long, panel, r, rd, rs, wide

L = f"{PANEL}, {WIDE}, {LONG}"
IC = f"{L}, {LABELS}, {RANKS}"
QUANTILE = "CASE WHEN value IS NOT NULL THEN least(greatest(value, quantile_cont(value, {a}) OVER g), quantile_cont(value, {b}) OVER g) END"
G = "WINDOW g AS (PARTITION BY date, factor)"


def ics(spark, d):
    return dg.rank_ic(long(spark, d), labels(spark, d), least=10)


SUMMARY = "ic_mean", "ic_std", "win_rate", "ic_abs_mean", "ic_max", "ic_min", "icir", "t_stat"
SUMMARY_SQL = "SELECT factor, avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS win_rate, avg(abs(ic)) AS ic_abs_mean, max(ic) AS ic_max, min(ic) AS ic_min, count(ic) AS days, CAST(sum(CASE WHEN ic IS NOT NULL THEN n END) AS BIGINT) AS samples, avg(ic) / nullif(stddev_pop(ic), 0) AS icir, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) AS t_stat FROM ics GROUP BY factor"
LS = """ls AS MATERIALIZED (SELECT date, factor, avg(CASE WHEN k > n - ceil(n / 5.0) THEN label END) AS long_return, avg(CASE WHEN k <= floor(n / 5.0) THEN label END) AS short_return,
 avg(CASE WHEN k > n - ceil(n / 5.0) THEN label END) - avg(CASE WHEN k <= floor(n / 5.0) THEN label END) AS ls_return
 FROM (SELECT *, row_number() OVER (PARTITION BY date, factor ORDER BY value, ticker) AS k, count(*) OVER (PARTITION BY date, factor) AS n FROM both_known) WHERE n >= 20 GROUP BY date, factor)"""
CHUNKS = "chunks AS (SELECT date, CAST(CASE WHEN i < (n % 4) * (n // 4 + 1) THEN i // (n // 4 + 1) ELSE n % 4 + (i - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) END AS INTEGER) AS chunk FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)))"


def neutral_input(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    caps = p.groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_retailprice").alias("cap"), F.min("p_type").alias("industry"))
    return long(spark, d).join(caps, "ticker")


NEUTRAL = "caps AS (SELECT p_brand AS ticker, sum(p_retailprice) AS cap, min(p_type) AS industry FROM part GROUP BY 1), ni AS MATERIALIZED (SELECT long.*, cap, industry FROM long JOIN caps USING (ticker))"


def entries() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    # labels and splits
    q["label_forward"] = (lambda s, d: rd(labels(s, d, 5), digits=9), f"WITH {PANEL} SELECT date, ticker, {r('lead(adj_close, 5) OVER o / nullif(adj_close, 0) - 1', 'label', 9)} FROM panel WINDOW o AS (PARTITION BY ticker ORDER BY date)")
    q["label_delayed"] = (lambda s, d: rd(labels(s, d, 1, 1), digits=9), f"WITH {PANEL} SELECT date, ticker, {r('lead(adj_close, 2) OVER o / nullif(lead(adj_close, 1) OVER o, 0) - 1', 'label', 9)} FROM panel WINDOW o AS (PARTITION BY ticker ORDER BY date)")
    q["label_quantile"] = (
        lambda s, d: dg.quantile_label(labels(s, d), 5).select("date", "ticker", "bin"),
        f"WITH {PANEL}, {LABELS} SELECT date, ticker, CAST(CASE WHEN label IS NOT NULL AND n >= 2 THEN greatest(ceil((k - 1) * least(5, n) / (n - 1.0)) - 1, 0) END AS INTEGER) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY label NULLS LAST, ticker) AS k, count(label) OVER (PARTITION BY date) AS n FROM labels)",
    )
    q["walk_forward_chunks"] = (lambda s, d: dg.date_chunks(panel(s, d), 4), f"WITH {PANEL}, {CHUNKS} SELECT * FROM chunks")
    # cleaning
    q["clean_winsorize"] = (lambda s, d: rd(cl.winsorize(long(s, d)), digits=10), f"WITH {L} SELECT date, ticker, factor, {r(QUANTILE.format(a=0.01, b=0.99), 'value', 10)} FROM long {G}")
    q["clean_winsorize_wide_cut"] = (lambda s, d: rd(cl.winsorize(long(s, d), 0.025, 0.975), digits=10), f"WITH {L} SELECT date, ticker, factor, {r(QUANTILE.format(a=0.025, b=0.975), 'value', 10)} FROM long {G}")
    q["clean_mad"] = (
        lambda s, d: rd(cl.mad_winsorize(long(s, d)), digits=8),
        f"WITH {L}, a AS (SELECT *, median(value) OVER g AS m FROM long {G}), b AS (SELECT *, median(abs(value - m)) OVER g AS dev FROM a {G}) SELECT date, ticker, factor, {r('CASE WHEN value IS NOT NULL AND dev > 0 THEN least(greatest(value, m - 3 * dev), m + 3 * dev) ELSE value END', 'value', 8)} FROM b",
    )
    q["clean_rank_normalize"] = (lambda s, d: rd(cl.rank_normalize(long(s, d)), digits=9), f"WITH {L} SELECT date, ticker, factor, {r('CASE WHEN value IS NOT NULL THEN row_number() OVER (PARTITION BY date, factor ORDER BY value NULLS LAST, ticker) / count(value) OVER g END', 'value', 9)} FROM long {G}")
    q["clean_zscore"] = (lambda s, d: rd(cl.zscore(long(s, d))), f"WITH {L} SELECT date, ticker, factor, {r('(value - avg(value) OVER g) / (CASE WHEN stddev_pop(value) OVER g > 1e-12 THEN stddev_pop(value) OVER g ELSE 1 END)', 'value')} FROM long {G}")
    q["clean_zscore_sample"] = (lambda s, d: rd(cl.zscore(long(s, d), sample=True)), f"WITH {L} SELECT date, ticker, factor, {r('CASE WHEN value IS NOT NULL THEN CASE WHEN stddev_samp(value) OVER g >= 1e-8 THEN (value - avg(value) OVER g) / stddev_samp(value) OVER g ELSE 0 END END', 'value')} FROM long {G}")
    q["clean_fill_median"] = (lambda s, d: rd(cl.fill_median(long(s, d)), digits=8), f"WITH {L} SELECT date, ticker, factor, {r('coalesce(value, median(value) OVER g, 0)', 'value', 8)} FROM long {G}")
    own = ["date", "ticker", "factor", "value"]
    q["neutral_industry"] = (lambda s, d: rd(cl.neutralize(neutral_input(s, d), group="industry").select(own), digits=9), f"WITH {L}, {NEUTRAL} SELECT date, ticker, factor, {r('value - avg(value) OVER (PARTITION BY date, factor, industry)', 'value', 9)} FROM ni")
    q["neutral_size_industry"] = (
        lambda s, d: rd(cl.neutralize(neutral_input(s, d), size="cap", group="industry").select(own)),
        f"WITH {L}, {NEUTRAL}, c AS (SELECT *, value - avg(value) OVER h AS y, CASE WHEN value IS NOT NULL THEN ln(cap) END - avg(CASE WHEN value IS NOT NULL THEN ln(cap) END) OVER h AS x FROM ni WINDOW h AS (PARTITION BY date, factor, industry)) SELECT date, ticker, factor, {r('y - coalesce(sum(x * y) OVER g / nullif(sum(x * x) OVER g, 0), 0) * x', 'value')} FROM c {G}",
    )
    q["feature_profile"] = (
        lambda s, d: rd(cl.feature_profile(long(s, d))),
        f"WITH {L}, day AS (SELECT factor, date, count(*) AS n, count(value) AS k, min(value) AS a, max(value) AS b, stddev_pop(value) AS s FROM long GROUP BY 1, 2) SELECT factor, {r('1 - sum(k) / sum(n)', 'missing')}, {r('min(a)', 'low')}, {r('max(b)', 'high')}, {r('avg(CAST(coalesce(s < 1e-9, true) AS DOUBLE))', 'flat_days')} FROM day GROUP BY factor",
    )
    q["factor_stability"] = (
        lambda s, d: rd(cl.stability(long(s, d), 20)),
        f"WITH {L}, a AS (SELECT *, CASE WHEN count(value) OVER w >= 10 THEN stddev_samp(value) OVER w END AS s FROM long WINDOW w AS (PARTITION BY factor, ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT factor, {r('median(s)', 'stability')}, {r('count(value) / count(*)', 'coverage')} FROM a GROUP BY factor",
    )
    q["drop_small_dates"] = (lambda s, d: cl.enough_rows(wide(s, d).where("mom20 > 0"), 10).groupBy("date").agg(F.count("*").alias("n")), f"WITH {PANEL}, {WIDE} SELECT date, count(*) AS n FROM wide WHERE mom20 > 0 GROUP BY date HAVING count(*) >= 10")
    q["mostly_filled_rows"] = (
        lambda s, d: cl.mostly_filled_rows(wide(s, d), NAMES, 0.5).select("date", "ticker"),
        f"WITH {PANEL}, {WIDE} SELECT date, ticker FROM wide WHERE {' + '.join(f'CAST({n} IS NULL AS INTEGER)' for n in NAMES)} < 2.5",
    )
    q["align_features"] = (lambda s, d: rd(cl.align(wide(s, d), ["vol20", "unknown", "mom20"], {"mom20": 0.5})), f"WITH {PANEL}, {WIDE} SELECT date, ticker, {r('coalesce(vol20, 0)', 'vol20')}, 0.0::DOUBLE AS unknown, {r('coalesce(mom20, 0.5)', 'mom20')} FROM wide")
    # diagnostics
    q["rank_ic_daily"] = (lambda s, d: rd(ics(s, d)), f"WITH {IC}, {ic_sql()} SELECT date, factor, {r('ic')}, n FROM ics")
    q["rank_ic_first_ties"] = (lambda s, d: rd(dg.rank_ic(long(s, d), labels(s, d), "first", 2)), f"WITH {IC}, {ic_sql('fx', 'fy', 2)} SELECT date, factor, {r('ic')}, n FROM ics")
    q["rank_ic_zero_filled"] = (lambda s, d: rd(dg.rank_ic(long(s, d), labels(s, d), least=10, null_ic=0.0)), f"WITH {IC}, {ic_sql()} SELECT date, factor, {r('coalesce(ic, 0)', 'ic')}, n FROM ics")
    q["rank_ic_summary"] = (lambda s, d: rd(dg.ic_summary(ics(s, d))), f"WITH {IC}, {ic_sql()}, x AS ({SUMMARY_SQL}) SELECT factor, days, samples, {rs(*SUMMARY)} FROM x")
    q["ic_screen"] = (lambda s, d: dg.ic_screen(dg.ic_summary(ics(s, d))), f"WITH {IC}, {ic_sql()}, x AS ({SUMMARY_SQL}) SELECT CAST(level AS DOUBLE) AS level, count(*) FILTER (abs(icir) > level) AS factors FROM x, (SELECT unnest([0.01, 0.02, 0.05, 0.5, 1.0]) AS level) GROUP BY level")
    roll = "WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    ok = lambda x: f"CASE WHEN count(ic) OVER w >= 60 THEN {x} END"
    q["ic_rolling"] = (
        lambda s, d: rd(dg.rolling_ic(ics(s, d))),
        f"WITH {IC}, {ic_sql()} SELECT date, factor, {r(ok('avg(ic) OVER w'), 'ic_mean')}, {r(ok('avg(ic) OVER w + 1.96 * stddev_samp(ic) OVER w'), 'upper')}, {r(ok('avg(ic) OVER w - 1.96 * stddev_samp(ic) OVER w'), 'lower')}, {r(ok('avg(ic) OVER w / nullif(stddev_samp(ic) OVER w, 0)'), 'icir')}, {r(ok('avg(ic) OVER w / nullif(stddev_samp(ic) OVER w, 0) * sqrt(count(ic) OVER w)'), 't_stat')} FROM ics {roll}",
    )
    q["long_short_daily"] = (lambda s, d: rd(dg.long_short(long(s, d), labels(s, d))), f"WITH {IC}, {LS} SELECT date, factor, {rs('long_return', 'short_return', 'ls_return')} FROM ls")
    w = "OVER (PARTITION BY factor ORDER BY date ROWS UNBOUNDED PRECEDING)"
    q["long_short_stats"] = (
        lambda s, d: rd(dg.long_short_stats(dg.long_short(long(s, d), labels(s, d)).withColumn("ls_return", F.col("ls_return") / 1000)), digits=5),
        f"WITH {IC}, {LS}, small AS (SELECT date, factor, ls_return / 1000 AS ls_return FROM ls), nav AS (SELECT *, product(1 + ls_return) {w} AS nav FROM small), dd AS (SELECT *, nav / greatest(max(nav) {w}, 1) - 1 AS dd FROM nav) SELECT factor, {r('avg(ls_return) * 252', 'annual_return', 5)}, {r('avg(ls_return) / nullif(stddev_samp(ls_return), 0) * sqrt(252)', 'sharpe', 5)}, {r('arg_max(nav, date) - 1', 'total_return', 5)}, {r('min(dd)', 'max_drawdown', 5)}, count(*) AS days FROM dd GROUP BY factor",
    )
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, {r('1.0' if a == b else f'coalesce(covar_samp({a}, {b}) / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END), 0), 0)', 'correlation')} FROM wide" + (" LIMIT 1" if False else "") for a in NAMES for b in NAMES)
    pairs = pairs.replace(f"{r('1.0', 'correlation')} FROM wide", "1.0::DOUBLE AS correlation")
    q["factor_correlation"] = (lambda s, d: rd(dg.factor_correlation(wide(s, d), NAMES)), f"WITH {PANEL}, {WIDE} {pairs}")
    return q
