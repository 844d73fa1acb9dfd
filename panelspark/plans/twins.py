"""SQL twins of what recurs from bar to bar, of portfolios that depend on the ones before, and of small linear systems.

They are written by hand from the definitions: recursions as recursive queries with their state in columns,
projections by window sums, components of two columns and least squares on two columns in closed form.
"""

from __future__ import annotations

from panelspark.operators.indicators import LEAST_ROWS, RECURSIVE
from panelspark.sources.panel import bars_sql

from .base import LABELS, LONG, PANEL, WIDE, r, rs


def smoothed(state: str, x: str, n: int, weight: float, lead: int) -> str:
    """The next state of an exponential mean: the sum of the first n values from row `lead` on, then their mean,
    then a step of `weight` towards each value."""
    return f"CASE WHEN i < {lead} THEN 0 WHEN i < {lead + n - 1} THEN {state} + ({x}) WHEN i = {lead + n - 1} THEN ({state} + ({x})) / {n} ELSE {state} + {weight!r}::DOUBLE * (({x}) - {state}) END"


def summed(state: str, x: str, n: int) -> str:
    """The next state of Wilder's sum of rows 1 to n - 1, then s - s / n + x."""
    return f"CASE WHEN i < 1 THEN 0 WHEN i < {n} THEN {state} + ({x}) ELSE {state} + (({x}) - {state} / {n}) END"


def _index(plus: str, minus: str) -> str:
    return f"CASE WHEN {plus} + {minus} > 0 THEN 100 * abs({plus} - {minus}) / ({plus} + {minus}) ELSE 0 END"


def _share(x: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN 100 * {x} / {whole} ELSE 0 END"


def recursive_sql() -> str:
    """All recursive indicators: one recursive query over the row numbers of all tickers at once."""
    first = {
        "fast": smoothed("fast", "c", 12, 2 / 13, 14),
        "e12": smoothed("e12", "c", 12, 2 / 13, 0),
        "e26": smoothed("e26", "c", 26, 2 / 27, 0),
        "e20": smoothed("e20", "c", 20, 2 / 21, 0),
        "ad": "ad + CASE WHEN h - l > 0 THEN ((c - l) - (h - c)) / (h - l) ELSE 0 END * v",
    }
    for n in (6, 14, 30):
        first |= {f"gain{n}": smoothed(f"gain{n}", "greatest(c - pc, 0)", n, 1 / n, 1), f"loss{n}": smoothed(f"loss{n}", "greatest(pc - c, 0)", n, 1 / n, 1)}
    for n in (14, 20):
        first |= {f"atr{n}": smoothed(f"atr{n}", "tr", n, 1 / n, 1), f"up{n}": summed(f"up{n}", "up", n), f"down{n}": summed(f"down{n}", "down", n), f"tr{n}": summed(f"tr{n}", "tr", n)}
    new = {x: f"n_{x}" for x in first}
    dx = {n: _index(_share(f"n_up{n}", f"n_tr{n}"), _share(f"n_down{n}", f"n_tr{n}")) for n in (14, 20)}
    second = {
        "signal": smoothed("signal", "n_fast - n_e26", 9, 2 / 10, 25),
        "twice": smoothed("twice", "n_e20", 20, 2 / 21, 19),
        "adx14": smoothed("adx14", dx[14], 14, 1 / 14, 14),
        "adx20": smoothed("adx20", dx[20], 20, 1 / 20, 20),
        "quick": "CASE WHEN i = 0 THEN n_ad ELSE quick + (n_ad - quick) * 2 / 4 END",
        "slow": "CASE WHEN i = 0 THEN n_ad ELSE slow + (n_ad - slow) * 2 / 11 END",
    }
    states = [*first, *second]
    after = lambda row, x: f"CASE WHEN i >= {row} THEN {x} END"
    rsi = lambda n: after(n, f"CASE WHEN gain{n} + loss{n} > 0 THEN 100 * gain{n} / (gain{n} + loss{n}) ELSE 0 END")
    plus, minus = _share("up14", "tr14"), _share("down14", "tr14")
    out = {
        "rsi_14": rsi(14),
        "rsi_6": rsi(6),
        "rsi_30": rsi(30),
        "macd": after(33, "fast - e26"),
        "macd_signal": after(33, "signal"),
        "macd_hist": after(33, "fast - e26 - signal"),
        "ema_12": after(11, "e12"),
        "ema_26": after(25, "e26"),
        "dema_20": after(38, "2 * e20 - twice"),
        "atr_14": after(14, "atr14"),
        "atr_20": after(20, "atr20"),
        "natr_14": after(14, "100 * atr14 / c"),
        "adosc": after(9, "quick - slow"),
        "adx_14": after(27, "adx14"),
        "adx_20": after(39, "adx20"),
        "adxr_14": after(40, "(adx14 + lag(adx14, 13) OVER (PARTITION BY ticker ORDER BY i)) / 2"),
        "dx_14": after(14, _index(plus, minus)),
        "minus_di_14": after(14, minus),
        "plus_di_14": after(14, plus),
    }
    return f"""WITH RECURSIVE own AS (
    SELECT date, ticker, high AS h, low AS l, adj_close AS c, volume AS v, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n,
        lag(high) OVER o AS ph, lag(low) OVER o AS pl, lag(adj_close) OVER o AS pc
    FROM ({bars_sql()}) WHERE high IS NOT NULL AND low IS NOT NULL AND adj_close IS NOT NULL AND volume IS NOT NULL
    WINDOW o AS (PARTITION BY ticker ORDER BY date)),
rows AS MATERIALIZED (
    SELECT date, ticker, i, h, l, c, v, pc, greatest(h - l, abs(h - pc), abs(l - pc)) AS tr,
        CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END AS up, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END AS down
    FROM own WHERE n >= {LEAST_ROWS}),
steps(ticker, date, i, c, {", ".join(states)}) AS (
    SELECT DISTINCT ticker, NULL::DATE, -1::BIGINT, NULL::DOUBLE, {", ".join("0::DOUBLE" for _ in states)} FROM rows
    UNION ALL
    SELECT ticker, date, i, c, {", ".join(new.values())}, {", ".join(second.values())}
    FROM (SELECT *, {", ".join(f"{e} AS {new[x]}" for x, e in first.items())}
          FROM (SELECT x.*, {", ".join(states)} FROM steps s JOIN rows x ON x.ticker = s.ticker AND x.i = s.i + 1))),
found AS (SELECT date, ticker, {", ".join(f"{out[k]} AS {k}" for k in RECURSIVE)} FROM steps WHERE i >= 0)
SELECT date, ticker, {rs(*RECURSIVE, digits=5)} FROM found"""


def dropout_sql(k: int, n_drop: int) -> str:
    """Top-k with dropout of two strategies, with the held names as a list in the state of a recursive query."""
    return f"""WITH RECURSIVE {PANEL}, {WIDE},
preds AS (SELECT 'a' AS strategy, date, ticker, mom20 AS prediction FROM wide UNION ALL SELECT 'b', date, ticker, rev5 FROM wide),
days AS MATERIALIZED (
    SELECT strategy, date, list(ticker ORDER BY prediction DESC, ticker) AS best, row_number() OVER (PARTITION BY strategy ORDER BY date) AS i
    FROM preds WHERE prediction IS NOT NULL GROUP BY strategy, date),
held(strategy, date, i, names) AS (
    SELECT DISTINCT strategy, NULL::DATE, 0::BIGINT, []::VARCHAR[] FROM days
    UNION ALL
    SELECT strategy, date, i, list_filter(best, lambda t: list_contains(kept, t) OR list_contains(fresh[1:greatest(0, {k} - len(kept))], t))[1:{k}]
    FROM (SELECT *, list_filter(here, lambda t: NOT list_contains(worst, t)) AS kept
          FROM (SELECT *, list_filter(best, lambda t: list_contains(here, t) OR list_contains(fresh, t))[-{n_drop}:] AS worst
                FROM (SELECT *, list_filter(best, lambda t: NOT list_contains(here, t))[1:{n_drop + k} - len(here)] AS fresh
                      FROM (SELECT d.strategy, d.date, d.i, d.best, list_filter(h.names, lambda t: list_contains(d.best, t)) AS here
                            FROM held h JOIN days d ON d.strategy = h.strategy AND d.i = h.i + 1)))))
SELECT strategy, date, unnest(names) AS ticker, 1.0::DOUBLE / len(names) AS weight FROM held WHERE i > 0"""


def newest_sql(k: int, n_drop: int, held: bool) -> str:
    """One step of top-k with dropout on the newest date, from no holdings or from the best names of the first date."""
    before = f"(SELECT ticker FROM pred ORDER BY date, prediction DESC, ticker LIMIT {k})" if held else "(SELECT ticker FROM pred WHERE false)"
    return f"""WITH {PANEL}, {WIDE}, pred AS MATERIALIZED (SELECT date, ticker, mom20 AS prediction FROM wide WHERE mom20 IS NOT NULL),
newest AS (SELECT date, ticker, row_number() OVER (ORDER BY prediction DESC, ticker) AS place, ticker IN {before} AS own FROM pred WHERE date = (SELECT max(date) FROM pred)),
sizes AS (SELECT *, count(*) FILTER (own) OVER () AS n_own, row_number() OVER (PARTITION BY own ORDER BY place) AS fresh FROM newest),
asked AS (SELECT *, row_number() OVER (ORDER BY place DESC) AS worst FROM sizes WHERE own OR fresh <= {n_drop + k} - n_own),
kept AS (SELECT *, own AND worst > {n_drop} AS stays FROM asked),
chosen AS (SELECT *, count(*) FILTER (stays) OVER () AS n_kept FROM kept),
final AS (SELECT date, ticker FROM chosen WHERE stays OR (NOT own AND fresh <= {k} - n_kept) ORDER BY place LIMIT {k})
SELECT date, ticker, {r("1.0 / count(*) OVER ()", "weight")} FROM final"""


def projected(source: str, columns: list[str], unit: bool) -> str:
    """CTEs that end in `free`: date, ticker and the columns, each less its projections on those before it, within a date.
    Rows with a null column and dates of one complete row are left out."""
    full = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    ctes = [f"p0 AS MATERIALIZED (SELECT * FROM (SELECT date, ticker, {', '.join(columns)}, count(*) OVER (PARTITION BY date) AS n_full FROM {source} WHERE {full}) WHERE n_full >= 2)"]

    def replaced(column: str, value: str) -> None:
        ctes.append(f"p{len(ctes)} AS MATERIALIZED (SELECT * REPLACE ({value} AS {column}) FROM p{len(ctes) - 1} WINDOW g AS (PARTITION BY date))")

    for j, b in enumerate(columns):
        for a in columns[:j] * 2:
            replaced(b, f"{b} - CASE WHEN sum({a} * {a}) OVER g > 1e-20 THEN (sum({a} * {b}) OVER g) / (sum({a} * {a}) OVER g) ELSE 0 END * {a}")
        if unit:
            replaced(b, f"{b} / CASE WHEN sqrt(sum({b} * {b}) OVER g) > 1e-10 THEN sqrt(sum({b} * {b}) OVER g) ELSE 1 END")
    return ", ".join([*ctes, f"free AS (SELECT * FROM p{len(ctes) - 1})"])


def orthogonal_sql(columns: list[str]) -> str:
    return f"WITH {PANEL}, {WIDE}, {projected('wide', columns, True)} SELECT w.date, w.ticker, {', '.join(r(f'f.{c}', c) for c in columns)} FROM wide w LEFT JOIN free f USING (date, ticker)"


def orthogonal_by_ic_sql(ics: str, names: list[str]) -> str:
    """The factors in the order of their mean rank IC, which the query finds itself: by place, then back by name."""
    places = [f"c{k}" for k in range(1, len(names) + 1)]
    back = ", ".join(r("max(CASE " + " ".join(f"WHEN factor = '{n}' AND place = {k} THEN f.{c}" for k, c in enumerate(places, 1)) + " END)", n) for n in names)
    return f"""WITH {ics}, places AS MATERIALIZED (SELECT factor, row_number() OVER (ORDER BY abs(ic_mean) DESC NULLS LAST, factor) AS place FROM summary),
placed AS MATERIALIZED (SELECT date, ticker, {", ".join(f"max(value) FILTER (place = {k}) AS {c}" for k, c in enumerate(places, 1))} FROM long JOIN places USING (factor) GROUP BY date, ticker),
{projected("placed", places, False)}
SELECT date, ticker, {back} FROM placed a LEFT JOIN free f USING (date, ticker), places GROUP BY date, ticker"""


def component(a: str, b: str, x: str = "x") -> tuple[str, str, str]:
    """The first component's loadings on two columns and its share, from their variances {x}.vaa, {x}.vbb and covariance
    {x}.vab; the larger loading is positive."""
    top = f"(({x}.vaa + {x}.vbb) / 2 + sqrt(pow(({x}.vaa - {x}.vbb) / 2, 2) + {x}.vab * {x}.vab))"
    la, lb = f"(CASE WHEN {x}.vaa >= {x}.vbb THEN {top} - {x}.vbb ELSE {x}.vab END)", f"(CASE WHEN {x}.vaa >= {x}.vbb THEN {x}.vab ELSE {top} - {x}.vaa END)"
    size = f"(sqrt({la} * {la} + {lb} * {lb}) * CASE WHEN {x}.vaa >= {x}.vbb THEN sign({la}) ELSE sign({lb}) END)"
    return f"{la} / {size}", f"{lb} / {size}", f"{top} / ({x}.vaa + {x}.vbb)"


def bucket_scores_sql(buckets: dict[str, list[str]]) -> str:
    """Scores of buckets of one or two columns that vary on each date."""
    parts = []
    for name, cols in buckets.items():
        a, b = cols[0], cols[-1]
        m = f"SELECT date, avg({a}) AS ma, avg({b}) AS mb, var_samp({a}) AS vaa, var_samp({b}) AS vbb, covar_samp({a}, {b}) AS vab FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY date HAVING count(*) >= 2 AND stddev_samp({a}) > 1e-12"
        la, lb, share = component(a, b)
        score, part = (a, "1.0::DOUBLE") if a == b else (f"({a} - ma) * {la} + ({b} - mb) * {lb}", share)
        parts.append(f"SELECT date, ticker, '{name}' AS bucket, {r(score, 'score', 5)}, {r(part, 'explained', 5)} FROM wide JOIN ({m}) x USING (date) WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return f"WITH {PANEL}, {WIDE} " + " UNION ALL ".join(parts)


def fixed_structure_sql(buckets: dict[str, list[str]], reference: str, days: int = 126) -> str:
    """Scores by loadings from the `days` dates up to the reference date, on all rows."""
    parts = []
    for name, cols in buckets.items():
        a, b = cols[0], cols[-1]
        m = f"SELECT avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS vaa, var_pop({b}) AS vbb, covar_pop({a}, {b}) AS vab FROM wide SEMI JOIN last USING (date) WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        la, lb, _ = component(a, b)
        score = f"{a} - ma" if a == b else f"({a} - ma) * {la} + ({b} - mb) * {lb}"
        parts.append(f"SELECT date, ticker, '{name}' AS bucket, {r(score, 'score', 5)} FROM wide, ({m}) x")
    return f"WITH {PANEL}, {WIDE}, last AS MATERIALIZED (SELECT DISTINCT date FROM wide WHERE date <= DATE '{reference}' ORDER BY date DESC LIMIT {days}) " + " UNION ALL ".join(parts)


def two_slopes(y: str, a: str, b: str) -> str:
    """Slopes fa, fb of y on a and b with intercept, as aggregates."""
    va, vb, ab, ya, yb = f"var_pop({a})", f"var_pop({b})", f"covar_pop({a}, {b})", f"covar_pop({y}, {a})", f"covar_pop({y}, {b})"
    return f"({ya} * {vb} - {yb} * {ab}) / ({va} * {vb} - {ab} * {ab}) AS fa, ({yb} * {va} - {ya} * {ab}) / ({va} * {vb} - {ab} * {ab}) AS fb"


def regression_exposure_sql(a: str, b: str) -> str:
    """A factor that is itself one of the styles has the slopes 1 and 0."""
    return f"""WITH {PANEL}, {WIDE}, {LONG}, fits AS MATERIALIZED (
    SELECT date, factor, {two_slopes("value", a, b)} FROM long JOIN wide USING (date, ticker) WHERE value IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY date, factor HAVING count(*) >= 5)
SELECT factor, '{a}' AS style, {r("avg(fa)", "exposure", 4)} FROM fits GROUP BY factor UNION ALL SELECT factor, '{b}', {r("avg(fb)", "exposure", 4)} FROM fits GROUP BY factor"""


def walk_forward_sql(a: str, b: str, n: int) -> str:
    """Least squares on all earlier chunks of dates, applied to each chunk; the first n's remainder of chunks is one date longer."""
    return f"""WITH {PANEL}, {WIDE}, {LABELS},
counted AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
chunks AS (SELECT date, CASE WHEN i < (n % {n}) * (n // {n} + 1) THEN i // (n // {n} + 1) ELSE n % {n} + (i - (n % {n}) * (n // {n} + 1)) // (n // {n}) END AS chunk FROM counted),
known AS MATERIALIZED (SELECT date, ticker, chunk, label, {a}, {b} FROM wide JOIN labels USING (date, ticker) JOIN chunks USING (date) WHERE label IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL),
fits AS (SELECT fold, {two_slopes("label", a, b)}, avg(label) AS my, avg({a}) AS ma, avg({b}) AS mb FROM known, range(1, {n}) f(fold) WHERE chunk < fold GROUP BY fold)
SELECT date, ticker, {r(f"my + fa * ({a} - ma) + fb * ({b} - mb)", "prediction", 5)}, fold::INTEGER AS fold FROM known JOIN fits ON chunk = fold"""


def compared_sql(cut: str) -> str:
    """What four ways to process keep of the raw values; ranks over all rows of a factor."""
    rank = lambda c: f"(rank() OVER (PARTITION BY method, factor ORDER BY {c}) + count(*) OVER (PARTITION BY method, factor ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0"
    kept = lambda e, n: r(f"CASE WHEN count(*) >= 100 THEN coalesce({e}, 0) ELSE 0.0 END", n, 5)
    how = {
        "none": "value",
        "zscore": "(value - avg(value) OVER g) / (CASE WHEN stddev_pop(value) OVER g > 1e-12 THEN stddev_pop(value) OVER g ELSE 1 END)",
        "rank": "(row_number() OVER (PARTITION BY date, factor ORDER BY value, ticker))::DOUBLE / count(*) OVER g",
        "winsorize": cut.format(a=0.01, b=0.99),
    }
    done = " UNION ALL ".join(f"SELECT '{m}' AS method, factor, value, {e} AS after FROM known WINDOW g AS (PARTITION BY date, factor)" for m, e in how.items())
    return f"""WITH {PANEL}, {WIDE}, {LONG}, known AS MATERIALIZED (SELECT * FROM long WHERE value IS NOT NULL), done AS MATERIALIZED ({done}),
ranked AS (SELECT *, {rank("value")} AS x, {rank("after")} AS y FROM done)
SELECT method, factor, {kept("corr(value, after)", "pearson")}, {kept("corr(x, y)", "spearman")}, {kept("stddev_samp(after) / nullif(stddev_samp(value), 0)", "std_ratio")}, count(*) AS samples FROM ranked GROUP BY method, factor"""
