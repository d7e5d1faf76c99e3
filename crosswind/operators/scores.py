"""Factor scores: build, mask, smooth, restrict; reuse stored values where they are complete."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswind.functions.signals import KEYS, Keys, Signal, as_signal, attach
from crosswind.operators.cross_section import CrossSection
from crosswind.session import durable

ROW = ["trade_date", "instrument"]


def spread(df: DataFrame) -> DataFrame:
    """A join side with a row for each key: never broadcast, as keys compress well in a file and take far more in the driver."""
    return df.hint("merge")


MIN_DISPLAY_DATES = 126

# Types of a write order that an aggregate compares in place.
WHOLE = ("int", "bigint")

# The universe filters understood, all meaning "not under special treatment".
UNIVERSE_FILTERS = ("is_st == false", "is_st == 0", "not is_st")


@dataclass(frozen=True)
class Factor:
    """A factor: how to add ``score`` to a panel, and how much history that needs.

    ``stages`` are the rows of history above and below each cross-sectional step (see ``Signal``). A factor that
    does not state them may rank dates anywhere, so its whole look-back counts for every instrument of a date, and
    a build with cross-sections inside time series must state them.
    """

    factor_id: str
    build: Callable[[DataFrame, CrossSection], DataFrame]
    lookback: int = 0
    filters: tuple[str, ...] = ()
    horizon: int = 5
    formula: str = ""
    stages: tuple[int, ...] | None = None

    @property
    def needs(self) -> tuple[int, ...]:
        return self.stages or (0, self.lookback)

    @classmethod
    def of(cls, factor_id: str, signal: Signal | str, **kw) -> "Factor":
        """A factor that is one signal; its look-back comes with it."""
        sig = as_signal(signal)
        return cls(factor_id, lambda df, xs: attach(df, sig, xs, "score"), lookback=sig.lookback, stages=sig.stages, **kw)


def eligible(filters: tuple[str, ...]) -> Column:
    """True where a row passes every universe filter."""
    for f in filters:
        if f.strip().lower() not in UNIVERSE_FILTERS:
            raise ValueError(f"no such universe filter: {f}")
    return ~F.coalesce(F.col("is_st"), F.lit(False)) if filters else F.lit(True)


def date_window(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "trade_date") -> DataFrame:
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def context_window(df: DataFrame, lookback: int, start: str | None, end: str | None) -> DataFrame:
    """With look-back the history before ``start`` stays; without it both bounds apply."""
    return date_window(df, None if lookback > 0 else start, end)


def universe_mask(df: DataFrame, filters: tuple[str, ...], score: str = "score") -> DataFrame:
    """Null the score of names outside the universe; applied after scoring, rows stay."""
    return df.withColumn(score, F.when(eligible(filters), F.col(score))) if filters else df


def ewm_decay(df: DataFrame, span: int, score: str = "score", keys: Keys = KEYS) -> DataFrame:
    """Exponentially weighted mean per instrument; gaps age the weight and stay missing.

    One Arrow batch per instrument: its rows are bounded by the number of dates.
    """
    if span <= 1:
        return df
    date = keys.date

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="mergesort")
        raw = pdf[score].astype("float64")
        pdf[score] = raw.ewm(span=span, adjust=False).mean().where(raw.notna())
        return pdf

    return df.groupBy(*keys.series).applyInPandas(smooth, df.schema)


def factor_scores(
    panel: DataFrame,
    factor: Factor,
    xs: CrossSection,
    start: str | None = None,
    end: str | None = None,
    decay: int = 0,
) -> DataFrame:
    """[trade_date, instrument, score] of one factor inside the window."""
    need = max(factor.lookback, 1 if decay > 1 else 0)
    scored = universe_mask(factor.build(context_window(panel, need, start, end), xs), factor.filters)
    scored = ewm_decay(scored.select(*ROW, "score"), decay)
    return date_window(scored, start, end)


def restrict_to_keys(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    return scores.join(spread(wanted), ROW, "left_semi")


def missing_keys(required: DataFrame, cached: DataFrame) -> DataFrame:
    return required.select(*ROW).join(spread(cached.select(*ROW)), ROW, "left_anti")


def required_keys(panel: DataFrame, filters: tuple[str, ...] = ()) -> DataFrame:
    return panel.where(eligible(filters)).where(F.col("close").isNotNull() if filters else F.lit(True)).select(*ROW).distinct()


def dedupe_last(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Keep the row with the highest ``seq`` per key (combined map-side, so hot keys are cheap).

    A number and a whole-number ``seq`` are kept side by side, which a hash aggregate holds in place; other rows as one struct, which sorts.
    """
    rest, types = [c for c in df.columns if c not in keys], dict(df.dtypes)
    if len(rest) == 2 and seq in rest and types[seq] in WHOLE and all(types[c] in (*WHOLE, "double", "date", "boolean") for c in rest):
        # One value column, so no row can be put together from two.
        (value,) = [c for c in rest if c != seq]
        best = df.groupBy(*keys).agg(F.max_by(value, seq).alias("_value"), F.max(seq).alias("_seq"))
        return best.select(*keys, F.col("_value").alias(value), F.col("_seq").alias(seq)).select(*df.columns)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return best.select(*keys, "_last.*").select(*df.columns)


def warm_up_keys(panel: DataFrame, lookback: int) -> DataFrame:
    """The first ``lookback`` rows of each instrument."""
    place = F.row_number().over(KEYS.over_series())
    return panel.select(*ROW, place.alias("_p")).where(F.col("_p") <= lookback).select(*ROW)


def trusted_cache(cached: DataFrame, panel: DataFrame, lookback: int) -> DataFrame:
    """Cached values that hold: non-null ones, and nulls only inside the warm-up."""
    if lookback <= 0:
        return cached.where(F.col("score").isNotNull())
    # Only the nulls meet the warm-up, so the other stored rows stay where they are.
    early = cached.where(F.col("score").isNull()).join(spread(warm_up_keys(panel, lookback)), ROW, "left_semi")
    return cached.where(F.col("score").isNotNull()).unionByName(early.select(*cached.columns))


def _near(panel: DataFrame, keys: DataFrame, before: int, after: int) -> DataFrame:
    """Rows of the panel that have one of the keys, same instrument, from ``before`` rows earlier to ``after`` rows later."""
    own = panel.select(*ROW, F.lit(True).alias("_own"))
    both = own.unionByName(keys.select(*ROW, F.lit(False).alias("_own")).na.drop(subset=ROW)).repartition(*KEYS.series)
    # One exchange and one sort by instrument serve the match of the keys and the rows around them.
    marked = both.withColumn("_key", F.bool_or(~F.col("_own")).over(Window.partitionBy(*KEYS.series, KEYS.date))).where("_own")
    around = KEYS.over_series().rowsBetween(-before, after)
    return marked.select(*ROW, F.bool_or("_key").over(around).alias("_near")).where("_near").select(*ROW)


def _whole_dates(panel: DataFrame, keys: DataFrame) -> DataFrame:
    return panel.select(*ROW).join(keys.select("trade_date").distinct(), "trade_date", "left_semi")


def _dates_before(panel: DataFrame, dates: DataFrame, rows: int) -> DataFrame:
    """``dates`` (stored, one row each), and those of the ``rows`` rows before them of any instrument of these dates."""
    marked = panel.select(*ROW).join(dates.withColumn("_day", F.lit(True)), "trade_date", "left")
    ahead = KEYS.over_series().rowsBetween(0, rows)
    return marked.select("trade_date", F.bool_or("_day").over(ahead).alias("_near")).where("_near").select("trade_date").distinct()


def context_dates(panel: DataFrame, missing: DataFrame, stages: int | tuple[int, ...]) -> DataFrame:
    """Dates needed to recompute the missing keys, stored: each row whose instrument is missing
    at that row or within the next look-back rows. Below a cross-sectional step every
    instrument of the dates found so far counts as missing.

    The dates of each step are written, one row for each, so that the next step knows how few they are."""
    above, *below = (stages,) if isinstance(stages, int) else stages
    if above:
        found = _near(panel, missing, 0, above)
    else:
        found = panel.select(*ROW).join(spread(missing.select(*ROW)), ROW, "left_semi")
    dates = durable(found.select("trade_date").distinct())
    for rows in below:
        if rows:
            dates = durable(_dates_before(panel, dates, rows))
    return dates


def affected_keys(panel: DataFrame, changed: DataFrame, stages: int | tuple[int, ...]) -> DataFrame:
    """Keys whose score depends on one of the changed keys: the way of ``context_dates`` in reverse."""
    *below, above = reversed((stages,) if isinstance(stages, int) else stages)
    keys = changed
    for rows in below:
        keys = _whole_dates(panel, _near(panel, keys, rows, 0))
    return _near(panel, keys, above, 0)


def incremental_report(panel: DataFrame, required: DataFrame, missing: DataFrame, stages: int | tuple[int, ...]) -> DataFrame:
    """One row: mode and the counts that decide it."""
    dates = context_dates(panel, missing, stages)
    context = panel.join(dates, "trade_date", "left_semi")

    def part(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    counts = (
        part(panel, "panel")
        .unionByName(part(required, "required"))
        .unionByName(part(missing, "missing"))
        .unionByName(part(context, "context"))
    )
    one = counts.agg(
        *[F.max(F.when(F.col("what") == w, F.col("n"))).alias(f"{w}_rows") for w in ("panel", "required", "missing", "context")]
    )
    ratio = F.coalesce(F.try_divide(F.col("missing_rows"), F.col("required_rows")), F.lit(0.0))
    expanded = F.col("context_rows") >= F.floor(F.col("panel_rows") * 0.8)
    incremental = F.when(ratio >= 0.05, "date_block_incremental").otherwise("sparse_incremental")
    mode = F.when(F.col("missing_rows") == 0, "cache_only")
    if stages if isinstance(stages, int) else any(stages):
        mode = mode.when(ratio >= 0.5, "full_recompute").when(expanded, "full_recompute")
    mode = mode.otherwise(incremental)
    rows = F.when(mode == "cache_only", F.lit(0)).when(mode == "full_recompute", F.col("panel_rows")).otherwise(F.col("context_rows"))
    return one.select(
        mode.alias("mode"), "required_rows", "missing_rows", ratio.alias("missing_ratio"), rows.alias("context_rows")
    )


def incremental_scores(panel: DataFrame, factor: Factor, cached: DataFrame, xs: CrossSection, mode: str) -> DataFrame:
    """Scores of the required keys: stored values where trusted, computed ones elsewhere.

    ``mode`` comes from ``incremental_report``; every mode that computes gives the same scores.
    """
    stored = trusted_cache(cached.select(*ROW, "score"), panel, factor.lookback).withColumn("_held", F.lit(True))
    # One join tells the keys that are held from those to compute; it is written, as both sides are read again.
    keys = durable(required_keys(panel, factor.filters).join(spread(stored), ROW, "left"))
    held, todo = keys.where("_held").drop("_held"), keys.where("_held is null").select(*ROW)
    if mode == "cache_only":
        context = panel.where(F.lit(False))
    elif mode == "full_recompute":
        context = panel
    else:
        context = panel.join(context_dates(panel, todo, factor.needs), "trade_date", "left_semi")
    fresh = universe_mask(factor.build(context, xs), factor.filters).select(*ROW, "score")
    return held.withColumn("source", F.lit("cached")).unionByName(
        restrict_to_keys(fresh, todo).withColumn("source", F.lit("computed"))
    )


def cache_only_scores(panel: DataFrame, cached: DataFrame, filters: tuple[str, ...] = ()) -> DataFrame:
    """Stored values for panel keys, masked by the universe; nothing is computed."""
    allowed = panel.select(*ROW, eligible(filters).alias("_in"))
    return cached.join(spread(allowed), ROW).select(*ROW, F.when(F.col("_in"), F.col("score")).alias("score"))


def score_source(counts: DataFrame) -> DataFrame:
    """Label (cached_rows, computed_rows, required_rows, cache_only) counts by where scores came from."""
    cache_only = (
        F.when(F.col("cached_rows") <= 0, "factor_values_missing")
        .when((F.col("required_rows") > 0) & (F.col("cached_rows") < F.col("required_rows")), "factor_values_cached_partial")
        .otherwise("factor_values_cached")
    )
    computed = (
        F.when(F.col("computed_rows") > 0, "factor_values_incremental")
        .when(F.col("cached_rows") > 0, "factor_values_cached")
        .otherwise("computed_formula")
    )
    return counts.withColumn("score_source", F.when(F.col("cache_only"), cache_only).otherwise(computed))


def min_window_guard(df: DataFrame, minimum: int = MIN_DISPLAY_DATES) -> DataFrame:
    """One row: distinct dates in the window and whether they reach the minimum."""
    return df.agg(F.count_distinct("trade_date").alias("dates")).select(
        "dates", F.lit(minimum).alias("minimum_required"), (F.col("dates") >= minimum).alias("ok")
    )


