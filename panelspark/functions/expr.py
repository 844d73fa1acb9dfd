"""Expression trees for panel factors, evaluated in stages.

A factor is a small tree of nodes: columns of the panel, element-wise steps, windows along time per
instrument (key `ticker`) and windows across instruments per date (key `date`). `evaluate` shares equal
sub-trees, computes all windows that are ready for one key before it changes the key, and so needs one
exchange for each change of key on the deepest path instead of one for each window. Each node also writes
itself as SQL, which the tests run on another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TICKER, DATE = "ticker", "date"


@dataclass(frozen=True, eq=False)
class Node:
    """op names the step; args are nodes or plain numbers; key is the window's key, None for element-wise."""

    op: str
    args: tuple
    key: str | None = None
    n: int = 0

    @property
    def id(self) -> str:
        return f"{self.op}{self.n or ''}({','.join(a.id if isinstance(a, Node) else repr(a) for a in self.args)})"

    def __eq__(self, other):  # structural
        return isinstance(other, Node) and self.id == other.id

    def __hash__(self):
        return hash(self.id)

    def __add__(self, o):
        return ew("+", self, o)

    def __radd__(self, o):
        return ew("+", o, self)

    def __sub__(self, o):
        return ew("-", self, o)

    def __rsub__(self, o):
        return ew("-", o, self)

    def __mul__(self, o):
        return ew("*", self, o)

    def __rmul__(self, o):
        return ew("*", o, self)

    def __truediv__(self, o):
        return ew("/", self, o)

    def __rtruediv__(self, o):
        return ew("/", o, self)

    def __neg__(self):
        return ew("neg", self)

    def __pow__(self, o):
        return ew("pow", self, o)

    def __lt__(self, o):
        return ew("<", self, o)

    def __gt__(self, o):
        return ew("<", o, self)

    def __le__(self, o):
        return ew("<=", self, o)

    def __ge__(self, o):
        return ew("<=", o, self)

    def __or__(self, o):
        return ew("or", self, o)


def col(name: str) -> Node:
    return Node("col", (name,))


def ew(op: str, *args) -> Node:
    return Node(op, args)


def tw(op: str, *args, n: int = 0) -> Node:
    return Node(op, args, TICKER, n)


def dw(op: str, *args) -> Node:
    return Node(op, args, DATE)


# --- element-wise steps: Spark columns and SQL text -------------------------------------------------

EW: dict[str, tuple[Callable[..., Column], Callable[..., str]]] = {
    "+": (lambda a, b: a + b, lambda a, b: f"({a} + {b})"),
    "-": (lambda a, b: a - b, lambda a, b: f"({a} - {b})"),
    "*": (lambda a, b: a * b, lambda a, b: f"({a} * {b})"),
    # division by zero is null in both
    "/": (lambda a, b: F.try_divide(a, b), lambda a, b: f"({a} / nullif({b}, 0))"),
    "neg": (lambda a: -a, lambda a: f"(-{a})"),
    "abs": (lambda a: F.abs(a), lambda a: f"abs({a})"),
    "sign": (lambda a: F.signum(a), lambda a: f"CAST(sign({a}) AS DOUBLE)"),
    # log of zero or less is null
    "log": (lambda a: F.when(a > 0, F.log(a)), lambda a: f"(CASE WHEN {a} > 0 THEN ln({a}) END)"),
    # log with log(0) at the bottom of any ranking, as minus infinity would be
    "log0": (lambda a: F.when(a > 0, F.log(a)).when(a == 0, F.lit(-1e300)), lambda a: f"(CASE WHEN {a} > 0 THEN ln({a}) WHEN {a} = 0 THEN -1e300 END)"),
    # power; a negative base with a broken exponent, and what overflows, is null
    "pow": (
        lambda a, b: F.when((a >= 0) | (b == F.floor(b)), F.when((a != 0) | (b >= 0), finite(F.pow(a, b)))),
        lambda a, b: f"(CASE WHEN ({a} >= 0 OR {b} = floor({b})) AND ({a} <> 0 OR {b} >= 0) THEN CASE WHEN isfinite(pow({a}, {b})) THEN pow({a}, {b}) END END)",
    ),
    # comparisons are 1 or 0, and 0 where a side is missing
    "<": (lambda a, b: F.coalesce(a < b, F.lit(False)).cast("double"), lambda a, b: f"CAST(coalesce({a} < {b}, false) AS DOUBLE)"),
    "<=": (lambda a, b: F.coalesce(a <= b, F.lit(False)).cast("double"), lambda a, b: f"CAST(coalesce({a} <= {b}, false) AS DOUBLE)"),
    "or": (lambda a, b: F.greatest(a, b), lambda a, b: f"greatest({a}, {b})"),
    "if": (lambda p, a, b: F.when(p > 0, a).otherwise(b), lambda p, a, b: f"(CASE WHEN {p} > 0 THEN {a} ELSE {b} END)"),
    # a plain condition with a missing side keeps the value missing
    "zero_to": (lambda a, b: F.when(a == 0, b).otherwise(a), lambda a, b: f"(CASE WHEN {a} = 0 THEN {b} ELSE {a} END)"),
    "fill": (lambda a, b: F.coalesce(a, b), lambda a, b: f"coalesce({a}, {b})"),
    "max": (lambda a, b: F.greatest(a, b), lambda a, b: f"greatest({a}, {b})"),
    "min": (lambda a, b: F.least(a, b), lambda a, b: f"least({a}, {b})"),
    "only": (lambda p, a: F.when(p > 0, a), lambda p, a: f"(CASE WHEN {p} > 0 THEN {a} END)"),
}


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def sql_lit(x) -> str:
    return x if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)"


# --- windows ---------------------------------------------------------------------------------------


def over_time(n: int):
    return Window.partitionBy(TICKER).orderBy(DATE).rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, value: Column, least: int | None = None) -> Column:
    """value where the frame of n rows has n (or `least`) values of x."""
    return F.when(F.count(x).over(over_time(n)) >= (least or n), value)


def snap(x: Column) -> Column:
    """x to about 39 bits, and to 1e-12: values that only rounding errors tell apart tie in rankings."""
    near = F.rint(x * 1e12) / 1e12
    far = near * 16385.0
    return far - (far - near)


def sql_snap(x: str) -> str:
    near = f"(round_even(({x}) * 1e12, 0) / 1e12)"
    return f"({near} * 16385.0::DOUBLE - ({near} * 16385.0::DOUBLE - {near}))"


def both(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), x)


def safe_corr(x: Column, y: Column, w) -> Column:
    """Pearson correlation over a frame; null, not an error, where a side is constant. The frame's spread
    counts as none if it is lost in the rounding of the values; the result is given to 1e-8."""
    x, y = both(x, y), both(y, x)
    sx, sy = F.stddev_samp(x).over(w), F.stddev_samp(y).over(w)
    steady = (sx > F.lit(1e-9) * F.max(F.abs(x)).over(w)) & (sy > F.lit(1e-9) * F.max(F.abs(y)).over(w))
    return F.when(steady, F.rint(F.try_divide(F.covar_samp(x, y).over(w), sx * sy) * 1e8) / 1e8)


def _lag(x, n):
    return F.lag(x, n).over(Window.partitionBy(TICKER).orderBy(DATE))


def _decay(x, n):
    """Weights 1..n over n; missing values are filled forward, then backward, then by 0; the first n-1 rows
    stay as they are."""
    whole = Window.partitionBy(TICKER).orderBy(DATE)
    past = F.last(x, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.first(x, ignorenulls=True).over(whole.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(past, coming, F.lit(0.0))


#: name -> (Spark, SQL) of windows along time; {w} is the frame of n rows, {o} the whole ordered history.
TW: dict[str, tuple[Callable, Callable]] = {
    "lag": (lambda n, x: _lag(x, n), lambda n, x: f"lag({x}, {n}) OVER o"),
    "lead": (lambda n, x: F.lead(x, n).over(Window.partitionBy(TICKER).orderBy(DATE)), lambda n, x: f"lead({x}, {n}) OVER o"),
    "delta": (lambda n, x: x - _lag(x, n), lambda n, x: f"({x} - lag({x}, {n}) OVER o)"),
    "sum": (lambda n, x: full(x, n, F.sum(x).over(over_time(n))), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN sum({x}) OVER w{n} END)"),
    "sma": (lambda n, x: full(x, n, F.avg(x).over(over_time(n))), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN avg({x}) OVER w{n} END)"),
    "std": (lambda n, x: full(x, n, F.stddev_samp(x).over(over_time(n))), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN stddev_samp({x}) OVER w{n} END)"),
    "stdp": (lambda n, x: full(x, n, F.stddev_pop(x).over(over_time(n))), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN stddev_pop({x}) OVER w{n} END)"),
    "tmin": (lambda n, x: full(x, n, F.min(x).over(over_time(n))), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN min({x}) OVER w{n} END)"),
    "tmax": (lambda n, x: full(x, n, F.max(x).over(over_time(n))), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN max({x}) OVER w{n} END)"),
    "corr": (
        lambda n, x, y: full(both(x, y), n, safe_corr(x, y, over_time(n))),
        lambda n, x, y: (
            f"(CASE WHEN count({x} + {y}) OVER w{n} = {n} AND stddev_samp({x}) OVER w{n} > 1e-9 * max(abs({x})) OVER w{n} AND stddev_samp({y}) OVER w{n} > 1e-9 * max(abs({y})) OVER w{n} "
            f"THEN round_even(covar_samp({x}, {y}) OVER w{n} / (stddev_samp({x}) OVER w{n} * stddev_samp({y}) OVER w{n}) * 1e8, 0) / 1e8 END)"
        ),
    ),
    "cov": (lambda n, x, y: full(both(x, y), n, F.covar_samp(x, y).over(over_time(n))), lambda n, x, y: f"(CASE WHEN count({x} + {y}) OVER w{n} = {n} THEN covar_samp({x}, {y}) OVER w{n} END)"),
    # average rank of the last value, 1..n
    "tsrank": (
        lambda n, x: full(x, n, F.aggregate(F.collect_list(snap(x)).over(over_time(n)), F.lit(0.5), lambda a, v: a + F.when(v < snap(x), 1.0).when(v == snap(x), 0.5).otherwise(0.0))),
        lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN 0.5 + list_sum(list_transform(list({sql_snap(x)}) OVER w{n}, lambda v: CASE WHEN v < {sql_snap(x)} THEN 1.0::DOUBLE WHEN v = {sql_snap(x)} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)) END)",
    ),
    # place of the first extreme, oldest = 1
    "argmax": (lambda n, x: full(x, n, F.array_position(F.collect_list(snap(x)).over(over_time(n)), F.max(snap(x)).over(over_time(n))).cast("double")), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN CAST(list_position(list({sql_snap(x)}) OVER w{n}, max({sql_snap(x)}) OVER w{n}) AS DOUBLE) END)"),
    "argmin": (lambda n, x: full(x, n, F.array_position(F.collect_list(snap(x)).over(over_time(n)), F.min(snap(x)).over(over_time(n))).cast("double")), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN CAST(list_position(list({sql_snap(x)}) OVER w{n}, min({sql_snap(x)}) OVER w{n}) AS DOUBLE) END)"),
    "product": (lambda n, x: full(x, n, F.aggregate(F.collect_list(x).over(over_time(n)), F.lit(1.0), lambda a, v: a * v)), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN list_reduce(list({x}) OVER w{n}, lambda a, v: a * v) END)"),
    # filled, as decay_linear takes its input
    "filled": (
        lambda n, x: _decay(x, n),
        lambda n, x: f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({x} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0)",
    ),
    "ffill": (
        lambda n, x: F.last(x, ignorenulls=True).over(Window.partitionBy(TICKER).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)),
        lambda n, x: f"last_value({x} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    ),
    # place of the last extreme, oldest = 1
    "lastmax": (lambda n, x: full(x, n, (n + 1 - F.array_position(F.reverse(F.collect_list(snap(x)).over(over_time(n))), F.max(snap(x)).over(over_time(n)))).cast("double")), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN CAST({n + 1} - list_position(list_reverse(list({sql_snap(x)}) OVER w{n}), max({sql_snap(x)}) OVER w{n}) AS DOUBLE) END)"),
    "lastmin": (lambda n, x: full(x, n, (n + 1 - F.array_position(F.reverse(F.collect_list(snap(x)).over(over_time(n))), F.min(snap(x)).over(over_time(n)))).cast("double")), lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN CAST({n + 1} - list_position(list_reverse(list({sql_snap(x)}) OVER w{n}), min({sql_snap(x)}) OVER w{n}) AS DOUBLE) END)"),
    # mean absolute distance from the mean of the frame
    "mad": (
        lambda n, x: full(x, n, F.aggregate(F.transform(F.collect_list(x).over(over_time(n)), lambda v: F.abs(v - F.avg(x).over(over_time(n)))), F.lit(0.0), lambda a, v: a + v) / n),
        lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN list_sum(list_transform(list({x}) OVER w{n}, lambda v: abs(v - avg({x}) OVER w{n}))) / {n} END)",
    ),
    # weights 1..n, newest heaviest
    "wma": (
        lambda n, x: full(x, n, F.aggregate(F.zip_with(F.collect_list(x).over(over_time(n)), F.sequence(F.lit(1), F.lit(n)), lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v) / (n * (n + 1) / 2)),
        lambda n, x: f"(CASE WHEN count({x}) OVER w{n} = {n} THEN list_sum(list_transform(list_zip(list({x}) OVER w{n}, range(1, {n + 1})), lambda p: p[1] * p[2])) / {n * (n + 1) / 2} END)",
    ),
    # running total
    "total": (lambda n, x: F.sum(x).over(Window.partitionBy(TICKER).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)), lambda n, x: f"sum({x}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    # weighted mean of a filled series, newest heaviest; raw = the unfilled series for the first n-1 rows
    "weighted": (
        lambda n, x, raw: F.when(
            F.row_number().over(Window.partitionBy(TICKER).orderBy(DATE)) < n, raw
        ).otherwise(F.aggregate(F.zip_with(F.collect_list(x).over(over_time(n)), F.sequence(F.lit(1), F.lit(n)), lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v) / (n * (n + 1) / 2)),
        lambda n, x, raw: f"(CASE WHEN row_number() OVER o < {n} THEN {raw} ELSE list_sum(list_transform(list_zip(list({x}) OVER w{n}, range(1, {n + 1})), lambda p: p[1] * p[2])) / {n * (n + 1) / 2} END)",
    ),
    # x / sum(abs(x)) down the whole history
    "scale": (
        lambda n, x: F.try_divide(x, F.sum(F.abs(x)).over(Window.partitionBy(TICKER))),
        lambda n, x: f"({x} / nullif(sum(abs({x})) OVER (PARTITION BY ticker), 0))",
    ),
}


def _rank(x: Column) -> Column:
    x = snap(x)
    w = Window.partitionBy(DATE).orderBy(x.asc_nulls_last())
    upto = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    all_ = F.count(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / 2 / all_)


def _sql_rank(x: str) -> str:
    x = sql_snap(x)
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + count({x}) OVER (PARTITION BY date ORDER BY {x} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 / count({x}) OVER (PARTITION BY date) END)"



def _day():
    return Window.partitionBy(DATE)


DW: dict[str, tuple[Callable, Callable]] = {
    "rank": (lambda x: _rank(x), _sql_rank),
    "day_scale": (lambda x: F.try_divide(x, F.sum(F.abs(x)).over(_day())), lambda x: f"({x} / nullif(sum(abs({x})) OVER (PARTITION BY date), 0))"),
    "day_max": (lambda x: F.max(x).over(_day()), lambda x: f"max({x}) OVER (PARTITION BY date)"),
    "day_min": (lambda x: F.min(x).over(_day()), lambda x: f"min({x}) OVER (PARTITION BY date)"),
    "day_mean": (lambda x: F.avg(x).over(_day()), lambda x: f"avg({x}) OVER (PARTITION BY date)"),
}


# --- evaluation ------------------------------------------------------------------------------------


def _windows(roots: list[Node]) -> list[Node]:
    """All window nodes below the roots, each once, arguments before users."""
    seen: dict[Node, None] = {}

    def walk(x):
        if isinstance(x, Node) and x not in seen:
            for a in x.args:
                walk(a)
            seen[x] = None

    for r in roots:
        walk(r)
    return [x for x in seen if x.key]


def schedule(roots: list[Node]) -> list[tuple[str, list[Node]]]:
    """Passes (key, nodes): all that is ready for one key, level by level, before the key changes."""
    todo, done, key = _windows(roots), set(), TICKER
    needs = {x: [w for w in _windows([x]) if w != x] for x in todo}
    passes = []
    while todo:
        ready = [x for x in todo if x.key == key and all(w in done for w in needs[x])]
        if not ready:
            key = DATE if key == TICKER else TICKER
            continue
        passes.append((key, ready))
        done.update(ready)
        todo = [x for x in todo if x not in done]
    return passes


def lookback(x) -> int:
    """Rows of history before a date that its value needs (windows over the whole history count as none)."""
    if not isinstance(x, Node):
        return 0
    own = {"lag": x.n, "delta": x.n}.get(x.op, x.n - 1 if x.key == TICKER and x.n else 0)
    return own + max([lookback(a) for a in x.args], default=0)


def _spark(x, made: dict[Node, str]) -> Column:
    if not isinstance(x, Node):
        return lit(x)
    if x in made:
        return F.col(made[x])
    if x.op == "col":
        return F.col(x.args[0])
    args = [_spark(a, made) for a in x.args]
    if x.key == TICKER:
        return TW[x.op][0](x.n, *args)
    return (DW if x.key else EW)[x.op][0](*args)


def evaluate(panel: DataFrame, factors: dict[str, Node], keep: list[str] | None = None) -> DataFrame:
    """panel (date, ticker and columns) -> date, ticker, the columns in `keep`, and one column per factor.

    Inputs of a pass that are not columns yet are made columns first, so a window never nests in another.
    Columns that no later pass needs are dropped as soon as possible."""
    made: dict[Node, str] = {}
    passes = schedule(list(factors.values()))
    keep = [DATE, TICKER, *(keep or [])]
    base = {x.args[0] for r in factors.values() for x in _all(r) if x.op == "col"}
    df = panel.select(*dict.fromkeys([*keep, *sorted(base)]))
    for k, (_, nodes) in enumerate(passes):
        inputs = {a for x in nodes for a in x.args if isinstance(a, Node) and a.op != "col" and a not in made}
        if inputs:
            names = {a: f"_i{k}_{i}" for i, a in enumerate(sorted(inputs, key=lambda a: a.id))}
            df = df.select("*", *(_spark(a, made).alias(n) for a, n in names.items()))
            made |= names
        names = {x: f"_w{k}_{i}" for i, x in enumerate(nodes)}
        df = df.select("*", *(_spark(x, made).alias(n) for x, n in names.items()))
        made |= names
        later = [x for _, xs in passes[k + 1 :] for x in xs]
        needed = _needed(later, made) | _needed(list(factors.values()), made, later)
        df = df.select(*dict.fromkeys([*keep, *sorted(base)]), *(n for x, n in made.items() if x in needed and n in df.columns))
        made = {x: n for x, n in made.items() if x in needed}
    return df.select(*keep, *(_spark(x, made).alias(n) for n, x in factors.items()))


def _all(x) -> list[Node]:
    return [x, *(y for a in x.args for y in _all(a))] if isinstance(x, Node) else []


def _needed(users: list[Node], made: dict[Node, str], later: list[Node] | None = None) -> set[Node]:
    """Made nodes that the users read directly, through steps that aren't made yet."""
    out: set[Node] = set()

    def walk(x, top=False):
        if not isinstance(x, Node):
            return
        if x in made and not top:
            out.add(x)
            return
        if x in made:
            out.add(x)
        for a in x.args:
            walk(a)

    for u in users:
        walk(u, top=u in made)
    return out


def to_sql(source: str, factors: dict[str, Node], digits: int = 6) -> str:
    """A SELECT over `source` (date, ticker, columns) with the factors rounded, as CTEs in the same passes."""
    made: dict[Node, str] = {}

    def text(x) -> str:
        if not isinstance(x, Node):
            return sql_lit(float(x))
        if x in made:
            return made[x]
        if x.op == "col":
            return x.args[0]
        args = [text(a) for a in x.args]
        if x.key == TICKER:
            return TW[x.op][1](x.n, *args)
        return (DW if x.key else EW)[x.op][1](*args)

    ctes, last = [f"p0 AS ({source})"], "p0"
    for k, (key, nodes) in enumerate(schedule(list(factors.values()))):
        inputs = sorted({a for x in nodes for a in x.args if isinstance(a, Node) and a.op != "col" and a not in made}, key=lambda a: a.id)
        if inputs:
            names = {a: f"i{k}_{i}" for i, a in enumerate(inputs)}
            ctes.append(f"q{k} AS MATERIALIZED (SELECT *, {', '.join(f'{text(a)} AS {n}' for a, n in names.items())} FROM {last})")
            made |= names
            last = f"q{k}"
        names = {x: f"w{k}_{i}" for i, x in enumerate(nodes)}
        frames = sorted({x.n for x in nodes if x.n})
        windows = " WINDOW o AS (PARTITION BY ticker ORDER BY date)" + "".join(f", w{n} AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in frames) if key == TICKER else ""
        ctes.append(f"r{k} AS MATERIALIZED (SELECT *, {', '.join(f'{text(x)} AS {n}' for x, n in names.items())} FROM {last}{windows})")
        made |= names
        last = f"r{k}"
    out = ", ".join(f"{sql_round(text(x), digits)} AS {n}" for n, x in factors.items())
    return f"WITH {', '.join(ctes)} SELECT date, ticker, {out} FROM {last}"


def round_to(x: Column, digits: int = 6) -> Column:
    """Rounded half to even on the scaled value, which engines agree on; no negative zero."""
    return F.rint(x * float(10**digits)) / float(10**digits) + F.lit(0.0)


def sql_round(x: str, digits: int = 6) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits} + 0.0)"


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[round_to(F.col(c), digits).alias(c) if c in names else c for c in df.columns])
