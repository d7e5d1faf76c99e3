"""Evaluation: forward-return labels, daily rank IC, summaries by horizon and sample split.

All frames are long and carry ``factor_id`` and ``horizon``, so any number of factors and
horizons runs as one job: one shuffle by instrument for labels, one by date for ranks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswind.functions.signals import KEYS, Keys
from crosswind.operators.cross_section import CrossSection

# Fixed values.
DEFAULT_HORIZONS = (5, 10, 21, 63)
ZERO = 1e-12
RELATIVE_ZERO = 1e-6


@dataclass(frozen=True)
class Split:
    name: str
    fraction: float
    weight: float


DEFAULT_SPLITS = (Split("IS", 0.5, 0.5), Split("OOS1", 0.3, 0.3), Split("OOS2", 0.2, 0.2))

GROUP = ("factor_id", "horizon")
DAY = (*GROUP, "trade_date")
DAY_KEYS = Keys(extra=GROUP)


def unique_horizons(primary: int, requested: tuple[int, ...] = DEFAULT_HORIZONS) -> tuple[int, ...]:
    horizons = tuple(dict.fromkeys((primary, *requested)))
    if min(horizons) < 1:
        raise ValueError("horizons must be positive")
    return horizons


def check_splits(splits: tuple[Split, ...]) -> tuple[Split, ...]:
    if not splits:
        raise ValueError("no sample split is declared")
    if len({s.name for s in splits}) != len(splits):
        raise ValueError("two sample splits share a name")
    if sum(s.fraction for s in splits) <= 0 or sum(s.weight for s in splits) <= 0:
        raise ValueError("sample split fractions and weights must sum to a positive value")
    return splits


def forward_return(horizon: int, delay: int = 1, keys: Keys = KEYS) -> Column:
    """Return from ``delay`` rows ahead to ``delay + horizon`` rows ahead, per instrument."""
    if delay < 1:
        raise ValueError("the execution delay must be at least 1")
    w = keys.over_series()
    return F.try_divide(F.lead("close", delay + horizon).over(w), F.lead("close", delay).over(w)) - 1


def label_scored_panel(
    df: DataFrame, scores: dict[str, str], horizons: tuple[int, ...], delay: int = 1
) -> DataFrame:
    """Long labelled frame from a panel that already holds one score column per factor.

    Scores and labels sit on the same rows, so no join is needed.
    """
    wide = df.select(
        "trade_date",
        "instrument",
        *[F.col(c).alias(f"_s{i}") for i, c in enumerate(scores.values())],
        *[forward_return(h, delay).alias(f"_f{h}") for h in horizons],
    )
    cells = [
        F.struct(
            F.lit(f).alias("factor_id"),
            F.lit(h).alias("horizon"),
            F.col(f"_s{i}").alias("score"),
            F.col(f"_f{h}").alias("forward_return"),
        )
        for i, f in enumerate(scores)
        for h in horizons
    ]
    return wide.select("trade_date", "instrument", F.inline(F.array(*cells)))


def labels(panel: DataFrame, horizons: tuple[int, ...], delay: int = 1) -> DataFrame:
    """(horizon, trade_date, instrument, forward_return), nulls at each instrument's tail."""
    wide = panel.select("trade_date", "instrument", *[forward_return(h, delay).alias(f"_f{h}") for h in horizons])
    cells = [F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("forward_return")) for h in horizons]
    return wide.select("trade_date", "instrument", F.inline(F.array(*cells)))


def labelled_join(labelled: DataFrame, scores: DataFrame, factor_id: str) -> DataFrame:
    """Labels left join scores: a row without a score stays, unscored."""
    return labelled.join(scores.select("trade_date", "instrument", "score"), ["trade_date", "instrument"], "left").withColumn(
        "factor_id", F.lit(factor_id)
    )


def daily_rank_ic(labelled: DataFrame, xs: CrossSection, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Per group and date: row counts and the Pearson correlation of average ranks.

    ``ic`` is null unless both sides take at least two values that day.
    """
    both = F.col("score").isNotNull() & F.col("forward_return").isNotNull()
    keys = Keys(extra=group)
    ranks = CrossSection(keys, xs.wide)
    rows = labelled.select(
        *keys.row,
        "score",
        "forward_return",
        F.when(both, F.col("score")).alias("_s"),
        F.when(both, F.col("forward_return")).alias("_f"),
    )
    rows = ranks.average_rank(ranks.average_rank(rows, "_s", "_rs"), "_f", "_rf")
    varies = (F.min("_rs") < F.max("_rs")) & (F.min("_rf") < F.max("_rf"))
    ic = F.when(varies, F.try_divide(F.covar_pop("_rs", "_rf"), F.stddev_pop("_rs") * F.stddev_pop("_rf")))
    return rows.groupBy(*group, "trade_date").agg(
        ic.alias("ic"),
        F.count("_s").alias("joint_rows"),
        F.count(F.lit(1)).alias("raw_rows"),
        F.count("score").alias("score_rows"),
        F.count("forward_return").alias("label_rows"),
    )


# Column types whose every value is a double.
DOUBLES = ("double", "float", "int", "smallint", "tinyint")
DAY_COUNTS = ("joint_rows", "raw_rows", "score_rows", "label_rows")


def panel_rank_ic(df: DataFrame, scores: dict[str, str], horizons: tuple[int, ...], xs: CrossSection, delay: int = 1) -> DataFrame:
    """``daily_rank_ic`` of ``label_scored_panel``.

    A row goes to its date once, whatever the number of factors and horizons, and a date sorts each score and label once; each pair takes the
    rows that hold both from these orders. A date is bounded by the number of instruments; one too wide for a task goes the long way.
    """
    types = dict(df.dtypes)
    if xs.wide or not all(types[c] in DOUBLES for c in ("close", *scores.values())):
        return daily_rank_ic(label_scored_panel(df, scores, horizons, delay), xs)
    own, ahead = {f: f"_s{i}" for i, f in enumerate(scores)}, {h: f"_f{h}" for h in horizons}
    rows = df.select(
        "trade_date",
        *[F.col(scores[f]).cast("double").alias(c) for f, c in own.items()],
        *[forward_return(h, delay).alias(c) for h, c in ahead.items()],
    )
    names = (*own.values(), *ahead.values())

    # Both functions travel whole to the workers, so these need no module of this package.
    def average_ranks(x, order):
        """Average-tie ranks 1..n of the rows that ``order`` lists by value, each at its row; NaN is one value above all others."""
        v = x[order]
        first = np.ones(len(v), bool)
        first[1:] = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
        start = np.flatnonzero(first)
        count = np.diff(start, append=len(v))
        ranks = np.zeros(len(x))
        ranks[order] = np.repeat(start + (count + 1) / 2.0, count)
        return ranks

    def day(key, table):
        held = {c: table.column(c).is_valid().to_numpy() for c in names}
        values = {c: table.column(c).to_numpy() for c in names}
        orders = {c: np.argsort(values[c]) for c in names}
        out = {c: [] for c in (*GROUP, "ic", *DAY_COUNTS)}
        for f, s in own.items():
            for h, r in ahead.items():
                both = held[s] & held[r]
                a, b = (average_ranks(values[c], orders[c][both[orders[c]]])[both] for c in (s, r))
                spread = a.std() * b.std() if len(a) else 0.0
                ic = float((a - a.mean()) @ (b - b.mean())) / len(a) / float(spread) if spread > 0 else None
                counts = (len(a), len(both), int(held[s].sum()), int(held[r].sum()))
                for c, v in zip(out, (f, h, ic, *counts), strict=True):
                    out[c].append(v)
        return pa.table(
            {
                **{c: pa.array(v, kind) for (c, v), kind in zip(out.items(), (pa.string(), pa.int32(), pa.float64(), *[pa.int64()] * len(DAY_COUNTS)), strict=True)},
                "trade_date": pa.array([key[0].as_py()] * len(out["ic"]), key[0].type),
            }
        )

    schema = f"factor_id string, horizon int, ic double, {', '.join(f'{c} bigint' for c in DAY_COUNTS)}, trade_date {types['trade_date']}"
    return rows.groupBy("trade_date").applyInArrow(day, schema).select(*DAY, "ic", *DAY_COUNTS)


def _hac_error(c: Column, horizon: Column) -> Column:
    """Newey-West standard error of the mean of an ordered, centred array, lag = horizon - 1.

    ``c`` must be a materialised column: it is sliced once per lag.
    """
    n = F.size(c)

    def product(k: Column) -> Column:
        pairs = F.zip_with(F.slice(c, k + 1, n - k), F.slice(c, F.lit(1), n - k), lambda a, b: a * b)
        return F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x), n)

    lag = F.least(F.greatest(horizon - 1, F.lit(0)), n - 1)
    lags = F.when(lag >= 1, F.sequence(F.lit(1), F.greatest(lag, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    extra = F.aggregate(lags, F.lit(0.0), lambda a, k: a + (1.0 - F.try_divide(k, lag + 1)) * 2.0 * product(k))
    variance = product(F.lit(0)) + extra
    error = F.sqrt(F.try_divide(variance, n))
    return F.when((n > 1) & (variance > ZERO) & (error > ZERO), error)


# A published Chebyshev fit of ln(erfc(x) / t) + x * x in t = 1 / (1 + x / 2); relative error under 1.2e-7.
ERFC_FIT = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x: Column) -> Column:
    """Complementary error function of values that are not negative."""
    t = 1.0 / (1.0 + 0.5 * x)
    power = F.lit(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        power = c + t * power
    return t * F.exp(power - x * x)


def two_sided_p(t: Column) -> Column:
    """Two-sided normal p-value."""
    return erfc(F.abs(t) / math.sqrt(2.0))


def ic_summary(
    daily: DataFrame, by: tuple[str, ...] = GROUP, p_values: bool = False, more: tuple[Column, ...] = ()
) -> DataFrame:
    """Mean, std, ICIR, naive and HAC t, coverage counts and warning codes per group.

    The ordered IC array of a group holds one value per date, so it is bounded by the calendar.
    """
    agg = daily.groupBy(*by).agg(
        F.count("ic").alias("ic_days"),
        F.avg("ic").alias("_mean"),
        F.stddev_samp("ic").alias("_std"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("ic").isNotNull(), F.struct("trade_date", "ic")))), lambda e: e["ic"]
        ).alias("_series"),
        *[F.sum(c).alias(c) for c in ("raw_rows", "score_rows", "label_rows", "joint_rows")],
        *more,
    )
    mean = F.coalesce("_mean", F.lit(0.0))
    floor = F.greatest(F.lit(ZERO), F.abs(mean) * RELATIVE_ZERO)
    degenerate = (F.col("ic_days") > 1) & (F.abs("_std") < floor)
    std = F.when(degenerate, 0.0).otherwise(F.coalesce("_std", F.lit(0.0)))
    out = agg.withColumns({"rank_ic_mean": mean, "rank_ic_std": std, "_degenerate": degenerate})
    out = out.withColumn("_centred", F.transform("_series", lambda x: x - F.col("_mean")))
    ratio = F.when(F.col("rank_ic_std") > 0, F.col("rank_ic_mean") / F.col("rank_ic_std"))
    out = out.withColumns(
        {
            "rank_icir": F.coalesce(ratio, F.lit(0.0)),
            "t_stat_naive": ratio * F.sqrt("ic_days"),
            "hac_error": _hac_error(F.col("_centred"), F.col("horizon")),
            "hac_lag": F.greatest(F.col("horizon") - 1, F.lit(0)),
        }
    )
    out = out.withColumn("t_stat_hac", F.try_divide("rank_ic_mean", "hac_error"))
    if p_values:
        out = out.withColumn("p_value_hac", two_sided_p(F.col("t_stat_hac")))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    codes = F.array_compact(
        F.array(
            F.when((F.col("horizon") > 1) & (F.col("ic_days") > 1), "OVERLAPPING_IC_REQUIRES_HAC"),
            F.when(F.col("raw_rows") > F.col("label_rows"), "INCOMPLETE_FORWARD_HORIZON_DROPPED"),
            F.when(F.col("_degenerate"), "DEGENERATE_IC_SERIES"),
        )
    )
    return out.withColumns(
        {
            "factor_coverage": share("score_rows", "raw_rows"),
            "label_coverage": share("label_rows", "raw_rows"),
            "coverage": share("joint_rows", "label_rows"),
            "dropped_boundary_rows": F.col("raw_rows") - F.col("label_rows"),
            "warning_codes": codes,
        }
    ).drop("_mean", "_std", "_series", "_centred", "_degenerate")


def split_bounds(n: Column, splits: tuple[Split, ...]) -> list[Column]:
    """Exclusive end positions of each split; banker's rounding, the last takes the rest."""
    total, cum, ends = sum(s.fraction for s in splits), 0.0, []
    for s in splits[:-1]:
        cum += s.fraction
        ends.append(F.bround(F.lit(cum / total) * n).cast("bigint"))
    return [*ends, n.cast("bigint")]


def assign_splits(dates: DataFrame, splits: tuple[Split, ...], by: tuple[str, ...], date: str, embargo: Column) -> DataFrame:
    """Cut ordered dates into named splits and drop each non-final split's embargoed tail.

    ``dates`` has one row per (by, date) and keeps its other columns; windows over it are
    bounded by the calendar.
    """
    check_splits(splits)
    whole = Window.partitionBy(*by)
    d = dates.withColumns(
        {"_i": F.row_number().over(whole.orderBy(date)).cast("bigint"), "_n": F.count(F.lit(1)).over(whole)}
    )
    ends = split_bounds(F.col("_n"), splits)
    name = F.lit(None).cast("string")
    end = F.lit(None).cast("bigint")
    for s, e in zip(reversed(splits), reversed(ends), strict=True):
        name = F.when(F.col("_i") <= e, s.name).otherwise(name)
        end = F.when(F.col("_i") <= e, e).otherwise(end)
    d = d.withColumns({"split": name, "_end": end})
    keep = (F.col("split") == splits[-1].name) | (F.col("_end") - F.col("_i") >= embargo)
    return d.where(keep).drop("_i", "_n", "_end")


def sample_splits(daily: DataFrame, splits: tuple[Split, ...] = DEFAULT_SPLITS, delay: int = 1, embargo: int | None = None) -> DataFrame:
    """The daily rows that have labels, with their ``split``."""
    gap = F.col("horizon") + delay if embargo is None else F.lit(embargo)
    return assign_splits(daily.where(F.col("label_rows") > 0), splits, GROUP, "trade_date", gap)


def split_metrics(daily: DataFrame, splits: tuple[Split, ...] = DEFAULT_SPLITS, delay: int = 1, embargo: int | None = None) -> DataFrame:
    """IC summary per split, with its dates and score weight.

    Every factor and horizon has every declared split; one that the embargo or a lack of labels empties has no days, an ICIR of 0 and no
    significance.
    """
    chosen = sample_splits(daily, splits, delay, embargo)
    spans = (F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count(F.lit(1)).alias("date_count"))
    declared = daily.select(*GROUP).distinct().select(
        *GROUP, F.inline(F.array(*[F.struct(F.lit(s.name).alias("split"), F.lit(float(s.weight)).alias("score_weight")) for s in splits]))
    )
    found = ic_summary(chosen, (*GROUP, "split"), more=spans)
    out = declared.join(found, [*GROUP, "split"], "left").select(*found.columns, "score_weight")
    lag = F.greatest(F.col("horizon") - 1, F.lit(0))
    return out.na.fill(0, EMPTY_AS_ZERO).withColumns(
        {"hac_lag": F.coalesce("hac_lag", lag), "warning_codes": F.coalesce("warning_codes", F.array().cast("array<string>"))}
    )


EMPTY_AS_ZERO = [
    "ic_days", "raw_rows", "score_rows", "label_rows", "joint_rows", "date_count", "rank_ic_mean", "rank_ic_std", "rank_icir",
    "factor_coverage", "label_coverage", "coverage", "dropped_boundary_rows",
]


def oos_decay(metrics: DataFrame) -> DataFrame:
    """Out-of-sample splits that fall behind an in-sample ICIR of at least 1."""
    base = metrics.where(F.upper("split") == "IS").select(
        *GROUP, F.col("rank_icir").alias("is_icir"), F.col("rank_ic_mean").alias("is_mean")
    )
    oos = metrics.where(F.upper("split").startswith("OOS"))
    weak = (F.abs("rank_icir") < F.abs("is_icir") * 0.5) | (F.col("rank_ic_mean") * F.col("is_mean") < 0)
    return oos.join(base, list(GROUP)).select(
        *GROUP, "split", "is_icir", "rank_icir", ((F.abs("is_icir") >= 1.0) & weak).alias("decays")
    )


def metric_rows(summary: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Long metric rows; the value is null unless the metric is available."""

    def row(metric, unit, value, ok, minimum, method):
        return F.struct(
            F.lit(metric).alias("metric"),
            F.when(ok, value).alias("value"),
            F.lit(unit).alias("unit"),
            F.when(ok, "available").otherwise("insufficient_sample").alias("status"),
            F.lit(minimum).alias("minimum_required"),
            F.lit(method).alias("method"),
        )

    n = F.col("ic_days")
    rows = F.array(
        row("rank_ic_t_stat", "t_stat", F.col("t_stat_hac"), F.col("t_stat_hac").isNotNull(), 2, "newey_west_bartlett"),
        row("rank_icir", "ratio", F.col("rank_icir"), (n > 1) & (F.col("rank_ic_std") > 0), 2, "rank_ic_mean_over_std"),
        row("rank_ic_mean", "correlation", F.col("rank_ic_mean"), n > 0, 1, "daily_rank_ic_mean"),
    )
    return summary.select(*by, n.alias("observation_count"), "warning_codes", F.inline(rows))


def weighted_split_icir(metrics: DataFrame) -> DataFrame:
    """Every factor and horizon gets a row; one without a usable split has 0.0."""
    usable = (F.col("ic_days") > 0) & (F.col("score_weight") > 0)
    value = F.try_divide(F.sum(F.when(usable, F.col("score_weight") * F.col("rank_icir"))), F.sum(F.when(usable, F.col("score_weight"))))
    return metrics.groupBy(*GROUP).agg(F.coalesce(value, F.lit(0.0)).alias("weighted_split_icir"))


def status_counts(rows: DataFrame) -> DataFrame:
    """Bench summary: how many metric rows have each status."""
    return rows.groupBy("metric", "status").agg(F.count(F.lit(1)).alias("rows"))
