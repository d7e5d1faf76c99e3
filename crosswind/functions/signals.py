"""Signals: a tree of Column steps together with the rows of history it needs.

``rank(delta(field("close"), 5))`` is one Column expression (``col``) where a cross-section fits one task. Where it does not,
``attach`` cuts the tree at its cross-sectional steps, stores their inputs, and has ``CrossSection`` add each as a column of its
own before what stands above it is computed. ``lookback`` says how
many earlier rows per instrument must be present before the value can be trusted, which
is what an incremental job needs to slice its input. ``stages`` splits that need at each
cross-sectional step: rows of history above the outermost one, then below it, and so on,
since below a cross-section the history of every instrument of a date counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crosswind.session import durable

MAX_WINDOW = 750


@dataclass(frozen=True)
class Keys:
    """Key columns of a panel; ``extra`` lets many factors or configs share one job."""

    date: str = "trade_date"
    instrument: str = "instrument"
    extra: tuple[str, ...] = ()

    @property
    def row(self) -> tuple[str, ...]:
        return (*self.extra, self.date, self.instrument)

    @property
    def cross(self) -> tuple[str, ...]:
        return (*self.extra, self.date)

    @property
    def series(self) -> tuple[str, ...]:
        return (*self.extra, self.instrument)

    def over_series(self) -> WindowSpec:
        return Window.partitionBy(*self.series).orderBy(self.date)

    def trailing(self, n: int) -> WindowSpec:
        return self.over_series().rowsBetween(-(n - 1), 0)

    def over_cross(self) -> WindowSpec:
        return Window.partitionBy(*self.cross)


KEYS = Keys()


Make = Callable[..., Column]
#: Adds a cross-sectional column: (section, frame, names of the input columns, name of the new one) -> frame.
Cross = Callable[..., DataFrame]


@dataclass(frozen=True, eq=False)
class Signal:
    """``leaf`` or ``make`` of the columns of ``parts``; ``cross`` is how a cross-sectional step is done outside one task."""

    leaf: Column | None = None
    lookback: int = 0
    stages: tuple[int, ...] | None = None
    parts: tuple["Signal", ...] = ()
    make: Make | None = None
    cross: Cross | None = None

    def __post_init__(self):
        if self.stages is None:
            object.__setattr__(self, "stages", (self.lookback,))

    @property
    def col(self) -> Column:
        """The whole signal as one expression."""
        return self.leaf if self.make is None else self.make(*[p.col for p in self.parts])

    def then(self, make: Make, rows: int = 0) -> "Signal":
        """A value made from this one and its ``rows`` earlier values of the same instrument."""
        return Signal(None, self.lookback + rows, (self.stages[0] + rows, *self.stages[1:]), (self,), make)

    def across(self, make: Make, cross: Cross) -> "Signal":
        """A value made from this one at all instruments of a date."""
        return Signal(None, self.lookback, (0, *self.stages), (self,), make, cross)

    def beside(self, other: "Signal", make: Make) -> "Signal":
        """A value made from two; needs of like depth below the result are merged."""
        stages = tuple(max(pair) for pair in zip_longest(self.stages, other.stages, fillvalue=0))
        return Signal(None, max(self.lookback, other.lookback), stages, (self, other), make)

    def __neg__(self):
        return self.then(lambda c: -c)

    def __pos__(self):
        return self

    def __add__(self, other):
        return _binary(self, other, lambda a, b: a + b)

    def __radd__(self, other):
        return _binary(other, self, lambda a, b: a + b)

    def __sub__(self, other):
        return _binary(self, other, lambda a, b: a - b)

    def __rsub__(self, other):
        return _binary(other, self, lambda a, b: a - b)

    def __mul__(self, other):
        return _binary(self, other, lambda a, b: a * b)

    def __rmul__(self, other):
        return _binary(other, self, lambda a, b: a * b)

    def __truediv__(self, other):
        return _binary(self, other, F.try_divide)

    def __rtruediv__(self, other):
        return _binary(other, self, F.try_divide)


def field(name: str) -> Signal:
    """A panel column as double; a dotted name refers to its last part."""
    return Signal(F.col(name.rsplit(".", 1)[-1]).cast("double"))


def const(value: float) -> Signal:
    return Signal(F.lit(float(value)))


def as_signal(x) -> Signal:
    if isinstance(x, Signal):
        return x
    if isinstance(x, str):
        return field(x)
    if isinstance(x, Column):
        return Signal(x)
    return const(x)


def _binary(a, b, op) -> Signal:
    a, b = as_signal(a), as_signal(b)
    return a.beside(b, op)


def window_length(n: float) -> int:
    """Windows are floored, at least one row and at most 750."""
    rows = max(1, int(n))
    if rows > MAX_WINDOW:
        raise ValueError(f"window must not exceed {MAX_WINDOW} rows")
    return rows


def clean(x: Column) -> Column:
    """NaN to NULL, so that aggregates skip missing values."""
    return F.when(~F.isnan(x), x)


# --- element-wise -------------------------------------------------------------------


def absolute(x) -> Signal:
    return as_signal(x).then(F.abs)


def log(x) -> Signal:
    return as_signal(x).then(lambda c: F.when(c > 0, F.ln(c)))


def sign(x) -> Signal:
    return as_signal(x).then(F.signum)


def signedpower(x, p) -> Signal:
    return _binary(x, p, lambda a, b: F.signum(a) * F.pow(F.abs(a), b))


def pairwise_min(x, y) -> Signal:
    return _binary(x, y, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)))


def pairwise_max(x, y) -> Signal:
    return _binary(x, y, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)))


# --- time series per instrument -----------------------------------------------------


def delay(x, n: int, keys: Keys = KEYS) -> Signal:
    x, n = as_signal(x), window_length(n)
    return x.then(lambda c: F.lag(c, n).over(keys.over_series()), n)


def delta(x, n: int, keys: Keys = KEYS) -> Signal:
    x = as_signal(x)
    return x - delay(x, n, keys)


def _rolling(x, n, keys, agg) -> Signal:
    x, n = as_signal(x), window_length(n)
    w = keys.trailing(n)
    return x.then(lambda c: F.when(F.count(c).over(w) == n, agg(c).over(w)), n - 1)


def ts_sum(x, n: int, keys: Keys = KEYS) -> Signal:
    return _rolling(x, n, keys, F.sum)


def ts_mean(x, n: int, keys: Keys = KEYS) -> Signal:
    return _rolling(x, n, keys, F.avg)


def ts_min(x, n: int, keys: Keys = KEYS) -> Signal:
    return _rolling(x, n, keys, F.min)


def ts_max(x, n: int, keys: Keys = KEYS) -> Signal:
    return _rolling(x, n, keys, F.max)


def stddev(x, n: int, keys: Keys = KEYS) -> Signal:
    return _rolling(x, n, keys, F.stddev_samp)


def smaller(x, y, keys: Keys = KEYS) -> Signal:
    """Minimum against another series, or over the last ``y`` rows when ``y`` is a number."""
    return ts_min(x, y, keys) if isinstance(y, (int, float)) else pairwise_min(x, y)


def larger(x, y, keys: Keys = KEYS) -> Signal:
    """Maximum against another series, or over the last ``y`` rows when ``y`` is a number."""
    return ts_max(x, y, keys) if isinstance(y, (int, float)) else pairwise_max(x, y)


def finite(x: Column) -> Column:
    """The value itself, or null for infinities and NaN."""
    return F.when(F.abs(x.cast("double")) < float("inf"), x)


def ts_rank(x, n: int, keys: Keys = KEYS) -> Signal:
    """Average-tie percentile of the newest value among the finite ones of its window; needs ``n`` rows."""
    x, n = as_signal(x), window_length(n)

    def value(c: Column) -> Column:
        newest = finite(c)
        held = F.collect_list(F.struct(newest.alias("v"))).over(keys.trailing(n))
        # One pass over the bounded window: rows below, rows equal, rows present.
        zero = F.struct(F.lit(0).alias("lt"), F.lit(0).alias("eq"), F.lit(0).alias("n"))

        def step(acc, e):
            return F.struct(
                (acc["lt"] + F.when(e["v"] < newest, 1).otherwise(0)).alias("lt"),
                (acc["eq"] + F.when(e["v"] == newest, 1).otherwise(0)).alias("eq"),
                (acc["n"] + F.when(e["v"].isNotNull(), 1).otherwise(0)).alias("n"),
            )

        pct = F.aggregate(held, zero, step, lambda a: F.try_divide(a["lt"] + (a["eq"] + 1) / 2.0, a["n"]))
        return F.when(newest.isNotNull() & (F.size(held) == n), pct)

    return x.then(value, n - 1)


def decay_linear(x, n: int, keys: Keys = KEYS) -> Signal:
    """Linearly weighted mean, newest row heaviest, from two running sums."""
    x, n = as_signal(x), window_length(n)
    w = keys.trailing(n)
    pos = F.row_number().over(keys.over_series())

    def value(c: Column) -> Column:
        weighted = F.sum(c * pos).over(w) - (pos - n) * F.sum(c).over(w)
        return F.when(F.count(c).over(w) == n, weighted / (n * (n + 1) / 2.0))

    return x.then(value, n - 1)


def _rows_since(x, n, keys, sign_) -> Signal:
    x, n = as_signal(x), window_length(n)
    w = keys.trailing(n)
    pos = F.row_number().over(keys.over_series())

    def value(c: Column) -> Column:
        best = F.max_by(pos, F.struct(sign_ * c, pos)).over(w)
        return F.when(F.count(finite(c)).over(w) == n, (pos - best).cast("double"))

    return x.then(value, n - 1)


def ts_argmax(x, n: int, keys: Keys = KEYS) -> Signal:
    """Rows since the most recent maximum; 0 means the newest row."""
    return _rows_since(x, n, keys, F.lit(1.0))


def ts_argmin(x, n: int, keys: Keys = KEYS) -> Signal:
    return _rows_since(x, n, keys, F.lit(-1.0))


def _paired(x, y, n, keys, value) -> Signal:
    x, y, n = as_signal(x), as_signal(y), window_length(n)
    w = keys.trailing(n)

    def joint(c: Column, d: Column) -> Column:
        both = c.isNotNull() & d.isNotNull()
        a, b = F.when(both, c), F.when(both, d)
        return F.when(F.count(a).over(w) == n, value(a, b, w))

    pair = x.beside(y, joint)
    return replace(pair, lookback=pair.lookback + n - 1, stages=(pair.stages[0] + n - 1, *pair.stages[1:]))


def correlation(x, y, n: int, keys: Keys = KEYS) -> Signal:
    def value(a, b, w):
        varies = (F.min(a).over(w) < F.max(a).over(w)) & (F.min(b).over(w) < F.max(b).over(w))
        scale = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
        return F.when(varies, F.try_divide(F.covar_pop(a, b).over(w), scale))

    return _paired(x, y, n, keys, value)


def covariance(x, y, n: int, keys: Keys = KEYS) -> Signal:
    return _paired(x, y, n, keys, lambda a, b, w: F.covar_samp(a, b).over(w))


# --- cross-section per date: the expression for one that fits one task, and its CrossSection form ----


def _over(keys: Keys, *more: Column) -> WindowSpec:
    return Window.partitionBy(*keys.cross, *more)


def peers(ordered: WindowSpec) -> WindowSpec:
    """Rows tied with the current one; same sort as the ordered window it comes from."""
    return ordered.rangeBetween(Window.currentRow, Window.currentRow)


def _with(section, keys: Keys):
    return replace(section, keys=keys)


def rank_column(c: Column, keys: Keys = KEYS) -> Column:
    ordered = keys.over_cross().orderBy(c.asc_nulls_last())
    below, ties = F.rank().over(ordered), F.count(c).over(peers(ordered))
    share = F.try_divide(below + (ties - 1) / 2.0, F.count(c).over(keys.over_cross()))
    return F.when(c.isNotNull(), share)


def rank(x, keys: Keys = KEYS) -> Signal:
    """Percentile rank with average ties; missing values neither rank nor count."""
    return as_signal(x).across(lambda c: rank_column(c, keys), lambda xs, df, c, out: _with(xs, keys).rank(df, c, out))


def zscore(x, keys: Keys = KEYS) -> Signal:
    w = keys.over_cross()

    def value(c: Column) -> Column:
        spread = F.when(F.min(c).over(w) < F.max(c).over(w), F.stddev_samp(c).over(w))
        return F.try_divide(c - F.avg(c).over(w), spread)

    return as_signal(x).across(value, lambda xs, df, c, out: _with(xs, keys).zscore(df, c, out))


def winsorize(x, q: float, keys: Keys = KEYS) -> Signal:
    check_tail(q)
    w = keys.over_cross()

    def value(c: Column) -> Column:
        low, high = F.percentile(c, F.lit(q)).over(w), F.percentile(c, F.lit(1.0 - q)).over(w)
        return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))

    return as_signal(x).across(value, lambda xs, df, c, out: _with(xs, keys).winsorize(df, c, q, out))


def ntile(x, n: int, keys: Keys = KEYS) -> Signal:
    """Bucket 1..n by percentile rank; tied values share a bucket."""
    check_buckets(n)

    def value(c: Column) -> Column:
        bucket = F.least(F.greatest(F.ceil(rank_column(c, keys) * n), F.lit(1)), F.lit(n)).cast("double")
        return F.when(c.isNotNull(), bucket)

    return as_signal(x).across(value, lambda xs, df, c, out: _with(xs, keys).ntile(df, c, n, out))


def scale(x, target: float = 1.0, keys: Keys = KEYS) -> Signal:
    def value(c: Column) -> Column:
        return F.try_divide(c, F.sum(F.abs(c)).over(keys.over_cross())) * F.lit(float(target))

    return as_signal(x).across(value, lambda xs, df, c, out: _with(xs, keys).scale(df, c, out, target))


def group_neutralize(x, group: str, keys: Keys = KEYS) -> Signal:
    def value(c: Column) -> Column:
        return F.when(F.col(group).isNotNull(), c - F.avg(c).over(_over(keys, F.col(group))))

    return as_signal(x).across(value, lambda xs, df, c, out: _with(xs, keys).group_neutralize(df, c, group, out))


def finite_pair(y: Column, x: Column) -> tuple[Column, Column]:
    inf = float("inf")
    ok = y.isNotNull() & x.isNotNull() & (F.abs(y) < inf) & (F.abs(x) < inf)
    return F.when(ok, y), F.when(ok, x)


def residualize(y, x, keys: Keys = KEYS) -> Signal:
    """Residual of a per-date regression of ``y`` on ``x`` with intercept."""
    w = keys.over_cross()

    def value(c: Column, d: Column) -> Column:
        a, b = finite_pair(c, d)
        slope = F.try_divide(F.covar_pop(a, b).over(w), F.var_pop(b).over(w))
        residual = a - (F.avg(a).over(w) + slope * (b - F.avg(b).over(w)))
        return F.when(F.min(b).over(w) < F.max(b).over(w), residual)

    pair = as_signal(y).beside(as_signal(x), value)
    section = lambda xs, df, c, d, out: _with(xs, keys).residualize(df, c, d, out)
    return replace(pair, stages=(0, *pair.stages), cross=section)


def attach(df: DataFrame, signal: Signal, section, out: str) -> DataFrame:
    """``df`` with the signal as a column.

    On a wide section, cross-sectional steps are taken from the innermost outwards: all inputs of the steps of a depth become columns of one
    stored table, each step adds its column, and what stands above reads that. So no task holds a date, and no step computes what is below it twice.
    """
    if not section.wide:
        return df.withColumn(out, signal.col)
    known: dict[int, Signal] = {}
    depths: dict[int, int] = {}

    def depth(s: Signal) -> int:
        if id(s) not in depths:
            depths[id(s)] = max([depth(p) for p in s.parts], default=0) + (s.cross is not None)
            known[id(s)] = s
        return depths[id(s)]

    done: dict[int, str] = {}

    def value(s: Signal) -> Column:
        if id(s) in done:
            return F.col(done[id(s)])
        return s.leaf if s.make is None else s.make(*[value(p) for p in s.parts])

    taken = set(df.columns)

    def fresh(what: str) -> str:
        name = next(n for n in (f"_{what}{i}" for i in range(len(taken) + 1)) if n not in taken)
        taken.add(name)
        return name

    columns = df.columns
    for level in range(1, depth(signal) + 1):
        steps = [s for k, s in known.items() if s.cross is not None and depths[k] == level]
        inputs = {id(s): [fresh("in") for _ in s.parts] for s in steps}
        df = durable(df.withColumns({name: value(p) for s in steps for name, p in zip(inputs[id(s)], s.parts, strict=True)}))
        for s in steps:
            name = fresh("step")
            df = durable(s.cross(section, df, *inputs[id(s)], name))
            done[id(s)] = name
    return df.withColumn(out, value(signal)).select(*[c for c in columns if c != out], out)


def check_tail(q: float) -> None:
    if not 0.0 <= q < 0.5:
        raise ValueError("the winsorize tail must be in [0, 0.5)")


def check_buckets(n: int) -> None:
    if n < 2:
        raise ValueError("ntile needs at least two buckets")
