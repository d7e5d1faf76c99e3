"""Long/short backtests as set operations, for many runs in one job.

A *schedule* is a rebalance grid (start, holding, delay); a *run* is a factor traded on a
schedule with a quantile, a group count and costs. Every period depends only on its own
dates; what carries over (previous book, NAV base) is a window over the traded periods of
a run, which are bounded by the calendar.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from crosswind.operators.cross_section import CrossSection
from crosswind.operators.evaluate import DEFAULT_SPLITS, Split, assign_splits
from crosswind.operators.scores import spread
from crosswind.session import durable

# Fixed values.
YEAR = 252
MIN_ANNUAL_DAYS = 126
MIN_CROSS_SECTION = 4
NO_COVERAGE = "REBALANCE_SKIPPED_NO_COVERAGE"
THIN = "REBALANCE_SKIPPED_THIN"

SLOT = ["schedule_id", "signal_idx"]
PERIOD = ["run_id", "signal_idx"]


@dataclass(frozen=True)
class Schedule:
    schedule_id: str
    holding: int
    delay: int = 1
    start_idx: int = 0
    partial: bool = False


@dataclass(frozen=True)
class Run:
    run_id: str
    factor_id: str
    schedule_id: str
    top_quantile: float = 0.3
    group_count: int = 5
    commission_bps: float = 0.0
    slippage_bps: float = 0.0
    borrow_bps_annual: float = 0.0

    def __post_init__(self):
        if not 0.0 < self.top_quantile <= 0.5:
            raise ValueError("a leg takes more than none and at most half of the names")


def declared(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Declared rows as a relation of known size, so that a table joined to them stays where it is."""
    typed = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(typed.names, r, strict=True)) for r in rows], typed))


def schedules_table(spark: SparkSession, schedules: list[Schedule]) -> DataFrame:
    rows = [(s.schedule_id, s.holding, s.delay, s.start_idx, s.partial) for s in schedules]
    return declared(spark, rows, "schedule_id string, holding int, delay int, start_idx int, partial boolean")


def runs_table(spark: SparkSession, runs: list[Run]) -> DataFrame:
    rows = [
        (r.run_id, r.factor_id, r.schedule_id, r.top_quantile, r.group_count, r.commission_bps, r.slippage_bps, r.borrow_bps_annual)
        for r in runs
    ]
    return declared(
        spark,
        rows,
        "run_id string, factor_id string, schedule_id string, top_quantile double, group_count int, "
        "commission_bps double, slippage_bps double, borrow_bps_annual double",
    )


# --- calendar and grid ---------------------------------------------------------------


def calendar(panel: DataFrame) -> DataFrame:
    """(idx, trade_date, total): distinct dates numbered from 0; one row per date."""
    dates = panel.select("trade_date").distinct()
    return dates.select(
        (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("idx"),
        "trade_date",
        F.count(F.lit(1)).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int").alias("total"),
    )


def start_index(cal: DataFrame, first_date: str) -> DataFrame:
    """Index of the first date at or after the given one; the calendar length when none."""
    target = F.lit(first_date).cast("date")
    return cal.agg(F.coalesce(F.min(F.when(F.col("trade_date") >= target, F.col("idx"))), F.max("total")).alias("start_idx"))


def rebalance_grid(cal: DataFrame, schedules: DataFrame) -> DataFrame:
    """Signal indices start, start + holding, ... below total - delay - 1."""
    last = F.col("total") - F.col("delay") - 2
    sized = schedules.withColumn("idx", F.lit(0)).join(cal.select("idx", "total"), "idx").drop("idx")
    return sized.where(last >= F.col("start_idx")).withColumn(
        "signal_idx", F.explode(F.sequence(F.col("start_idx"), last, F.col("holding")))
    )


def date_at(df: DataFrame, cal: DataFrame, idx: str, name: str, how: str = "inner") -> DataFrame:
    return df.join(cal.select(F.col("idx").alias(idx), F.col("trade_date").alias(name)), idx, how)


def schedule(cal: DataFrame, schedules: DataFrame) -> DataFrame:
    """Periods with signal, entry and exit; an incomplete tail is dropped, or marked at the last date."""
    entry = F.col("signal_idx") + F.col("delay")
    planned = entry + F.col("holding")
    grid = rebalance_grid(cal, schedules).withColumns({"entry_idx": entry, "scheduled_exit_idx": planned})
    complete = F.col("scheduled_exit_idx") < F.col("total")
    grid = grid.withColumns(
        {
            "is_complete": complete,
            "exit_idx": F.when(complete, F.col("scheduled_exit_idx")).when(F.col("partial"), F.col("total") - 1),
        }
    ).where(F.col("exit_idx") > F.col("entry_idx"))
    for idx, name in (("signal_idx", "signal_date"), ("entry_idx", "entry_date"), ("exit_idx", "exit_date")):
        grid = date_at(grid, cal, idx, name)
    return grid.withColumn("days_held", F.col("exit_idx") - F.col("entry_idx"))


def excluded_tail(cal: DataFrame, schedules: DataFrame) -> DataFrame:
    """Schedules whose last slot was dropped because its exit lies beyond the data."""
    beyond = F.col("signal_idx") + F.col("delay") + F.col("holding") >= F.col("total")
    return rebalance_grid(cal, schedules).groupBy("schedule_id").agg(
        F.bool_or(beyond & ~F.col("partial")).alias("excluded_final_partial")
    )


# --- returns of the grid periods ------------------------------------------------------


def forward_marks(panel: DataFrame, cal: DataFrame, lengths: list[int]) -> DataFrame:
    """(instrument, idx, close) of every quote, and `h<n>`: the last quote (idx, close) at most n calendar days on.

    One exchange and one sort by instrument serve all lengths; each is a frame that only grows, as the quote itself is always in it.
    """
    dated = panel.where(F.col("close").isNotNull()).select("trade_date", "instrument", "close").join(cal.select("idx", "trade_date"), "trade_date")
    ordered = Window.partitionBy("instrument").orderBy("idx")
    quote = F.struct("idx", "close")
    return dated.select(
        "instrument", "idx", "close", *[F.last(quote).over(ordered.rangeBetween(Window.unboundedPreceding, n)).alias(f"h{n}") for n in lengths]
    )


def period_returns(panel: DataFrame, cal: DataFrame, periods: DataFrame) -> DataFrame:
    """Per period and name: entry close, return to the last quote in (entry, exit], lost flag.

    The last quotes are found once for each distinct length of a period, whatever the number of periods; periods then pick their
    entry day's rows. The periods are stored, so their size is known and other days' rows go before anything moves.
    """
    slots = durable(periods.select(*SLOT, F.col("entry_idx").alias("idx"), (F.col("exit_idx") - F.col("entry_idx")).alias("_n")).distinct())
    # As many as the holding periods declared, and one more for each tail that is marked early.
    lengths = sorted(r["_n"] for r in slots.select("_n").distinct().collect())
    marks = forward_marks(panel, cal, lengths).join(slots, "idx")
    own = F.struct("idx", "close")  # the answer of no length, where there are no periods
    last = F.coalesce(*[F.when(F.col("_n") == n, F.col(f"h{n}")) for n in lengths], own)
    found = marks.select(*SLOT, "instrument", F.col("close").alias("entry_close"), (F.col("idx") + F.col("_n")).alias("exit_idx"), last.alias("_last"))
    return found.select(
        *SLOT,
        "instrument",
        "entry_close",
        (F.try_divide(F.col("_last.close"), F.col("entry_close")) - 1).alias("period_return"),
        (F.col("_last.idx") != F.col("exit_idx")).alias("lost"),
    )


def last_quotes(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """One row a name: `first_idx`, its first quoted day, and for each day from there `closes`, the last quote, and `quoted`, whether it is that day's.

    The arrays are bounded by the calendar. One exchange by instrument makes them.
    """
    dated = panel.where(F.col("close").isNotNull()).select("trade_date", "instrument", "close").join(cal.select("idx", "trade_date", "total"), "trade_date")
    following = F.lead("idx").over(Window.partitionBy("instrument").orderBy("idx"))
    days = F.coalesce(following, F.col("total")) - F.col("idx")
    quoted = F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), days - 1))
    runs = dated.select("instrument", F.struct("idx", F.array_repeat("close", days).alias("closes"), quoted.alias("quoted")).alias("_r"))
    names = runs.groupBy("instrument").agg(F.sort_array(F.collect_list("_r")).alias("_runs"))
    return names.select(
        "instrument", F.col("_runs.idx")[0].alias("first_idx"), F.flatten("_runs.closes").alias("closes"), F.flatten("_runs.quoted").alias("quoted")
    )


@dataclass
class Backtest:
    """All tables of a set of runs, each built lazily from the ones before it."""

    panel: DataFrame
    scores: DataFrame
    schedules: DataFrame
    runs: DataFrame
    xs: CrossSection
    reuse: bool = False

    def _kept(self, df: DataFrame) -> DataFrame:
        return durable(df) if self.reuse else df

    @cached_property
    def calendar(self) -> DataFrame:
        return self._kept(calendar(self.panel))

    @cached_property
    def periods(self) -> DataFrame:
        """Grid periods of every run."""
        return self._kept(schedule(self.calendar, self.schedules).join(self.runs, "schedule_id"))

    @cached_property
    def signals(self) -> DataFrame:
        """Scored names on each run's signal dates."""
        slots = self.periods.select("run_id", "factor_id", *SLOT, F.col("signal_date").alias("trade_date"))
        scored = self.scores.where(F.col("score").isNotNull())
        return self._kept(scored.join(slots, ["factor_id", "trade_date"]).select("run_id", *SLOT, "instrument", "score"))

    @cached_property
    def matched(self) -> DataFrame:
        """Signals with a tradable return."""
        returns = period_returns(self.panel, self.calendar, schedule(self.calendar, self.schedules))
        return self._kept(self.signals.join(returns, [*SLOT, "instrument"]).where(F.col("period_return").isNotNull()))

    @cached_property
    def slots(self) -> DataFrame:
        """Every grid slot with its counts and, when it cannot trade, the reason."""
        scored = self.signals.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("signal_count"))
        traded = self.matched.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("matched_count"))
        out = self.periods.join(scored, PERIOD, "left").join(traded, PERIOD, "left").na.fill(0, ["signal_count", "matched_count"])
        need = F.greatest(F.lit(MIN_CROSS_SECTION), F.col("group_count"))
        reason = F.when(F.col("signal_count") == 0, NO_COVERAGE).when(F.col("matched_count") < need, THIN)
        return out.withColumns({"skip_reason": reason, "skipped": reason.isNotNull()})

    @cached_property
    def positions(self) -> DataFrame:
        """Traded cross-sections in (score, instrument) order with legs and quantile group."""
        placed = self.xs.ordinal(self.matched, "score", "pos", "n", tuple(PERIOD))
        need = F.greatest(F.lit(MIN_CROSS_SECTION), F.col("group_count"))
        params = self.runs.select("run_id", "top_quantile", "group_count")
        placed = placed.join(params, "run_id").where(F.col("n") >= need)
        k = F.greatest(F.lit(1), F.floor(F.col("n") * F.col("top_quantile")))
        size, extra = F.floor(F.col("n") / F.col("group_count")), F.col("n") % F.col("group_count")
        big = extra * (size + 1)
        group = F.when(F.col("pos") <= big, F.ceil(F.col("pos") / (size + 1))).otherwise(extra + F.ceil((F.col("pos") - big) / size))
        legged = placed.withColumn("k", k).withColumns(
            {"is_short": F.col("pos") <= F.col("k"), "is_long": F.col("pos") > F.col("n") - F.col("k"), "group": group}
        )
        return self._kept(legged.drop("top_quantile", "group_count"))

    @cached_property
    def legs(self) -> DataFrame:
        """Members of the two legs with their signed weights."""
        held = self.positions.where(F.col("is_long") | F.col("is_short"))
        weight = F.col("is_long").cast("double") / F.col("k") - F.col("is_short").cast("double") / F.col("k")
        return held.withColumn("weight", weight)

    @cached_property
    def leg_returns(self) -> DataFrame:
        """Per traded period: leg means, gross return, lost names, traded sequence number."""
        r = F.col("period_return")
        agg = self.legs.groupBy(*PERIOD).agg(
            F.avg(F.when(F.col("is_long"), r)).alias("long_return"),
            F.avg(F.when(F.col("is_short"), r)).alias("short_return"),
            F.count_if("is_long").alias("long_count"),
            F.count_if("is_short").alias("short_count"),
            (F.count_if(F.col("lost") & F.col("is_long")) + F.count_if(F.col("lost") & F.col("is_short"))).alias("lost_count"),
        )
        seq = F.row_number().over(Window.partitionBy("run_id").orderBy("signal_idx")) - 1
        return agg.withColumns({"gross_return": F.col("long_return") - F.col("short_return"), "period_id": seq})

    @cached_property
    def groups(self) -> DataFrame:
        """Mean return of each quantile group per period."""
        return self.positions.groupBy(*PERIOD, "group").agg(F.avg("period_return").alias("group_return"))

    @cached_property
    def group_means(self) -> DataFrame:
        return self.groups.groupBy("run_id", "group").agg(
            F.avg("group_return").alias("mean_return"), F.count(F.lit(1)).alias("periods")
        )

    @cached_property
    def turnover(self) -> DataFrame:
        """Per traded period: traded notional, turnover and leg replacement against the previous book.

        Each member counts for its own period and, negated, for the next one; summing per
        name gives the weight change without joining two books.
        """
        book = self.legs.join(self.leg_returns.select(*PERIOD, "period_id"), PERIOD)
        sides = F.array(
            F.struct(F.col("period_id").alias("at"), F.col("weight").alias("w"), F.lit(1).alias("now")),
            F.struct((F.col("period_id") + 1).alias("at"), (-F.col("weight")).alias("w"), F.lit(0).alias("now")),
        )
        moves = book.select("run_id", "instrument", "is_long", "is_short", F.inline(sides))
        names = moves.groupBy("run_id", F.col("at").alias("period_id"), "instrument").agg(
            F.sum("w").alias("change"),
            F.count_if("is_long").alias("longs"),
            F.count_if("is_short").alias("shorts"),
        )
        per = names.groupBy("run_id", "period_id").agg(
            F.sum(F.abs("change")).alias("traded"),
            F.count_if(F.col("longs") == 2).alias("long_kept"),
            F.count_if(F.col("shorts") == 2).alias("short_kept"),
        )
        w = Window.partitionBy("run_id").orderBy("period_id")
        sized = self.leg_returns.join(per, ["run_id", "period_id"]).withColumns(
            {"_pl": F.lag("long_count").over(w), "_ps": F.lag("short_count").over(w)}
        )

        def replaced(kept, now, before):
            return 1 - F.col(kept) / F.greatest(F.col(before), F.col(now), F.lit(1))

        later = F.col("period_id") > 0
        rate = (replaced("long_kept", "long_count", "_pl") + replaced("short_kept", "short_count", "_ps")) / 2
        return sized.select(
            *PERIOD,
            "period_id",
            F.col("traded").alias("traded_notional"),
            (F.col("traded") / 2).alias("turnover_rate"),
            F.when(~later, F.col("traded") / 2).alias("initial_build_turnover"),
            F.when(later, F.col("traded") / 2).alias("rebalance_turnover"),
            F.when(later, rate).alias("rebalance_rate"),
        )

    @cached_property
    def period_table(self) -> DataFrame:
        """Traded periods with returns, turnover, cost and net return."""
        base = self.leg_returns.join(self.turnover.drop("period_id"), PERIOD).join(
            self.periods.select(
                *PERIOD, "signal_date", "entry_idx", "exit_idx", "entry_date", "exit_date", "is_complete", "days_held",
                "holding", "commission_bps", "slippage_bps", "borrow_bps_annual",
            ),
            PERIOD,
        )
        cost = transaction_cost(
            F.col("traded_notional"), F.col("days_held"), F.col("commission_bps"), F.col("slippage_bps"), F.col("borrow_bps_annual")
        )
        out = base.withColumn("cost", cost).withColumn("net_return", F.col("gross_return") - F.col("cost"))
        return self._kept(out.drop("commission_bps", "slippage_bps", "borrow_bps_annual"))

    @cached_property
    def leg_marks(self) -> DataFrame:
        """Mean cumulative return per leg and day; null on a day when no held name is quoted.

        A name's last mark carries forward, and its entry day has one, so a member cuts its days out of the name's series of last quotes.
        """
        spans = self.periods.select(*PERIOD, "entry_idx", "exit_idx")
        members = self.legs.select(*PERIOD, "instrument", "is_long", "entry_close").join(spans, PERIOD)
        held = spread(members).join(last_quotes(self.panel, self.calendar), "instrument")
        cut = lambda c: F.slice(c, F.col("entry_idx") - F.col("first_idx") + 1, F.col("exit_idx") - F.col("entry_idx") + 1)
        days = held.select(*PERIOD, "is_long", "entry_close", "entry_idx", F.posexplode(F.arrays_zip(cut("closes").alias("close"), cut("quoted").alias("quoted"))).alias("_k", "_d"))
        mark = F.try_divide(F.col("_d.close"), F.col("entry_close")) - 1
        filled = days.select(*PERIOD, "is_long", (F.col("entry_idx") + F.col("_k")).alias("idx"), F.when(F.col("_d.quoted"), mark).alias("_m"), mark.alias("_f"))
        per = filled.groupBy(*PERIOD, "is_long", "idx").agg(F.count("_m").alias("fresh"), F.avg("_f").alias("_mean"))
        # One row a leg and day; read twice by what follows.
        return self._kept(per.select(*PERIOD, "is_long", "idx", "fresh", F.when(F.col("fresh") > 0, F.col("_mean")).alias("leg_return")))

    @cached_property
    def period_nav(self) -> DataFrame:
        """Gross and net NAV of each period on each of its days, starting from 1."""
        side = lambda long: F.max(F.when(F.col("is_long") == F.lit(long), F.col("leg_return")))
        legs = self.leg_marks.groupBy(*PERIOD, "idx").agg(side(True).alias("_l"), side(False).alias("_s"))
        costs = self.period_table.select(*PERIOD, "period_id", "cost")
        gross = 1 + (F.col("_l") - F.col("_s"))
        return legs.join(costs, PERIOD).select(
            *PERIOD, "period_id", "idx", gross.alias("gross_period_nav"), (gross - F.col("cost")).alias("net_period_nav")
        )

    @cached_property
    def nav(self) -> DataFrame:
        """Daily NAV compounded over the traded periods from each period's last markable day."""
        per = self.period_nav
        ends = per.groupBy("run_id", "period_id").agg(
            F.max_by("gross_period_nav", F.when(F.col("gross_period_nav").isNotNull(), F.col("idx"))).alias("_g"),
            F.max_by("net_period_nav", F.when(F.col("net_period_nav").isNotNull(), F.col("idx"))).alias("_n"),
        )
        before = Window.partitionBy("run_id").orderBy("period_id").rowsBetween(Window.unboundedPreceding, -1)
        base = lambda c: F.coalesce(F.product(F.coalesce(F.col(c), F.lit(1.0))).over(before), F.lit(1.0))
        bases = ends.select("run_id", "period_id", base("_g").alias("_gb"), base("_n").alias("_nb"))
        out = per.join(bases, ["run_id", "period_id"]).join(self.calendar.select("idx", "trade_date"), "idx")
        return self._kept(
            out.select(
                "run_id", "period_id", "idx", "trade_date", "gross_period_nav", "net_period_nav",
                (F.col("_gb") * F.col("gross_period_nav")).alias("gross_nav"),
                (F.col("_nb") * F.col("net_period_nav")).alias("net_nav"),
            )
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Daily returns against cash; an exit day repeats as the next entry day, by period."""
        w = Window.partitionBy("run_id").orderBy("period_id", "idx")
        rows = self.nav.where(F.col("gross_nav").isNotNull() & F.col("net_nav").isNotNull())
        step = lambda c: F.try_divide(F.col(c), F.coalesce(F.lag(c).over(w), F.lit(1.0))) - 1
        return rows.select(
            "run_id", "period_id", "trade_date", "gross_nav", "net_nav",
            F.lit(1.0).alias("benchmark_nav"),
            F.col("net_nav").alias("relative_nav"),
            step("gross_nav").alias("daily_gross_return"),
            step("net_nav").alias("daily_net_return"),
            F.lit(0.0).alias("benchmark_return"),
            step("net_nav").alias("daily_active_return"),
            F.lit(2.0).alias("gross_exposure"),
            F.lit(0.0).alias("net_exposure"),
            F.row_number().over(w).alias("day_no"),
        )

    @cached_property
    def active_risk(self) -> DataFrame:
        """Annualised tracking error and information ratio after the first ledger day."""
        a = self.ledger.where("day_no > 1").groupBy("run_id").agg(
            F.count("daily_active_return").alias("_n"), F.stddev_samp("daily_active_return").alias("_s"), F.avg("daily_active_return").alias("_m")
        )
        ok = F.col("_n") >= 2
        return a.select(
            "run_id",
            F.when(ok, F.col("_s") * YEAR**0.5).alias("tracking_error"),
            F.when(ok & (F.col("_s") > 0), F.col("_m") / F.col("_s") * YEAR**0.5).alias("information_ratio"),
        )

    @cached_property
    def drawdown(self) -> DataFrame:
        """Largest fall from a running peak that starts at 1, for gross and net NAV."""
        w = Window.partitionBy("run_id").orderBy("period_id", "idx").rowsBetween(Window.unboundedPreceding, 0)

        def fall(c):
            return F.try_divide(F.col(c), F.greatest(F.lit(1.0), F.max(c).over(w))) - 1

        falls = self.nav.select("run_id", fall("gross_nav").alias("_g"), fall("net_nav").alias("_n"))
        return falls.groupBy("run_id").agg(
            F.least(F.lit(0.0), F.min("_g")).alias("max_drawdown"), F.least(F.lit(0.0), F.min("_n")).alias("net_max_drawdown")
        )

    @cached_property
    def exposure(self) -> DataFrame:
        """Days in the market, span in trading days, span in calendar days."""
        return self.period_table.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("periods"),
            F.sum("days_held").alias("exposure_days"),
            (F.max("exit_idx") - F.min("entry_idx")).alias("span_days"),
            (F.datediff(F.max("exit_date"), F.min("entry_date")) + 1).alias("calendar_days"),
        )

    @cached_property
    def skips(self) -> DataFrame:
        return self.slots.groupBy("run_id").agg(
            F.count_if(F.col("skip_reason") == NO_COVERAGE).alias("skipped_no_coverage"),
            F.count_if(F.col("skip_reason") == THIN).alias("skipped_thin"),
        )

    @cached_property
    def metrics(self) -> DataFrame:
        """One row per run with every headline figure; a run without periods has counts and returns of 0."""
        out = self.runs.select("run_id")
        for part in (
            return_summary(self.period_table, ["run_id"]), self.exposure.drop("periods", "exposure_days"), self.skips, self.drawdown, self.active_risk
        ):
            out = out.join(part, "run_id", "left")
        out = out.na.fill(0, [*EMPTY_AS_ZERO, "span_days", "calendar_days", "skipped_no_coverage", "skipped_thin"])
        skipped = F.col("skipped_no_coverage") + F.col("skipped_thin") > 0
        out = out.withColumns(
            {
                "headline_days": F.when(skipped, F.col("span_days")).otherwise(F.col("exposure_days")),
                "headline_basis": F.when(skipped, "calendar_trading_days").otherwise("exposure_days"),
            }
        )
        for side in ("gross", "net"):
            cum = F.col(f"{side}_cumulative")
            out = out.withColumns(
                {
                    f"{side}_annual_exposure": reportable_annual(cum, F.col("exposure_days")),
                    f"{side}_annual_calendar": reportable_annual(cum, F.col("span_days")),
                    f"{side}_annual": reportable_annual(cum, F.col("headline_days")),
                    f"{side}_annual_extrapolated": annual_return(cum, F.col("headline_days")),
                }
            )
        return out

    def segments(self, splits: tuple[Split, ...] = DEFAULT_SPLITS) -> DataFrame:
        """Metrics per run and declared sample segment; a period reaching into the next segment is purged."""
        dated = self.period_table.select("run_id", "signal_date").distinct()
        assigned = assign_splits(dated, splits, ("run_id",), "signal_date", F.lit(0))
        starts = assigned.groupBy("run_id", "split").agg(F.min("signal_date").alias("_start"))
        w = Window.partitionBy("run_id").orderBy("_start")
        starts = starts.withColumn("_next", F.lead("_start").over(w))
        rows = self.period_table.join(assigned, ["run_id", "signal_date"]).join(starts, ["run_id", "split"])
        rows = rows.withColumn("_kept", F.col("_next").isNull() | (F.col("exit_date") < F.col("_next")))
        purged = rows.groupBy("run_id", "split").agg(F.count_if(~F.col("_kept")).alias("purged"))
        kept = rows.where("_kept")
        by = ["run_id", "split"]
        summary = return_summary(kept, by)
        spans = kept.groupBy(*by).agg(F.min("signal_date").alias("start_date"), F.max("signal_date").alias("end_date"))
        declared = self.runs.select("run_id", F.explode(F.array(*[F.lit(s.name) for s in splits])).alias("split"))
        out = declared.join(purged, by, "left").join(summary, by, "left").join(spans, by, "left").na.fill(0, ["purged", *EMPTY_AS_ZERO])
        for side in ("gross", "net"):
            out = out.withColumn(f"{side}_annual", reportable_annual(F.col(f"{side}_cumulative"), F.col("exposure_days")))
        return out

    def warnings(self, splits: tuple[Split, ...] = DEFAULT_SPLITS) -> DataFrame:
        """Warning tokens per run, in a fixed order."""
        seg = self.segments(splits)
        base = seg.where((F.col("split") == "IS") & (F.col("net_annual") > 0)).select("run_id", F.col("net_annual").alias("_is"))
        oos = seg.where(F.col("split").startswith("OOS") & (F.col("periods") > 0)).join(base, "run_id")
        decays = oos.groupBy("run_id").agg(F.bool_or(F.col("net_annual") < F.col("_is") * 0.5).alias("_decay"))
        tail = self.runs.join(excluded_tail(self.calendar, self.schedules), "schedule_id").select("run_id", "excluded_final_partial")
        m = self.metrics.join(decays, "run_id", "left").join(tail, "run_id", "left")
        days = F.col("headline_days")
        codes = F.array_compact(
            F.array(
                F.when(F.col("periods") < 2, "TOO_FEW_PERIODS"),
                F.when((days > 0) & (days < MIN_ANNUAL_DAYS), "SHORT_ANNUALIZATION_WINDOW"),
                F.when(F.col("rebalance_rate") > 0.8, "HIGH_REBALANCE_RATE"),
                F.when(F.col("turnover_rate") > 1.5, "HIGH_TURNOVER_RATE"),
                F.when((F.col("gross_annual") > 0) & (F.col("net_annual") < F.col("gross_annual") * 0.5), "COST_SENSITIVE"),
                F.when(F.col("_decay"), "OOS_SEGMENT_DECAY"),
                F.when(F.col("partial_periods") > 0, "PARTIAL_FINAL_PERIOD"),
                F.when(F.col("excluded_final_partial"), "FINAL_PARTIAL_PERIOD_EXCLUDED"),
                F.when(F.col("lost_positions") > 0, "POSITIONS_LOST_BEFORE_EXIT"),
                F.when(F.col("skipped_no_coverage") > 0, NO_COVERAGE),
                F.when(F.col("skipped_thin") > 0, THIN),
                F.when(F.col("headline_basis") == "calendar_trading_days", "ANNUALIZATION_BASIS_CALENDAR_TIME"),
            )
        )
        return m.select("run_id", codes.alias("warnings"))

    @cached_property
    def reconciliation(self) -> DataFrame:
        """Total cost, terminal equities and the excess over cash in both forms."""
        s = return_summary(self.period_table, ["run_id"])
        return s.select(
            "run_id",
            "cost_sum",
            (1 + F.col("gross_cumulative")).alias("gross_terminal"),
            (1 + F.col("net_cumulative")).alias("net_terminal"),
            F.col("net_cumulative").alias("arithmetic_excess"),
            ((1 + F.col("net_cumulative")) / F.lit(1.0) - 1).alias("relative_excess"),
        )


EMPTY_AS_ZERO = ["periods", "exposure_days", "partial_periods", "lost_positions", "cost_sum", "gross_cumulative", "net_cumulative"]


def transaction_cost(traded: Column, days: Column, commission: Column, slippage: Column, borrow: Column) -> Column:
    return traded * (commission + slippage) / 10000.0 + borrow / 10000.0 * days / YEAR


def annual_return(cumulative: Column, days: Column) -> Column:
    equity = 1 + cumulative
    grown = F.pow(equity, F.try_divide(F.lit(float(YEAR)), days)) - 1
    return F.when(days > 0, F.when(equity <= 0, F.lit(-1.0)).otherwise(grown))


def reportable_annual(cumulative: Column, days: Column) -> Column:
    """The annualised return, only when the history is long enough or the book is lost."""
    return F.when((1 + cumulative <= 0) | (days >= MIN_ANNUAL_DAYS), annual_return(cumulative, days))


def return_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Compounded return, volatility and Sharpe (complete periods only) per group of periods."""
    aggs = [
        F.count(F.lit(1)).alias("periods"),
        F.sum("days_held").alias("exposure_days"),
        F.max("holding").alias("_h"),
        F.count_if(~F.col("is_complete")).alias("partial_periods"),
        F.sum("lost_count").alias("lost_positions"),
        F.sum("cost").alias("cost_sum"),
        F.avg("rebalance_rate").alias("rebalance_rate"),
        F.avg("rebalance_turnover").alias("turnover_rate"),
        F.count_if("is_complete").alias("_c"),
    ]
    for side in ("gross", "net"):
        r = F.col(f"{side}_return")
        whole = F.when(F.col("is_complete"), r)
        aggs += [
            F.product(1 + r).alias(f"_{side}_p"),
            F.max(r).alias(f"_{side}_one"),
            F.stddev_samp(whole).alias(f"_{side}_s"),
            F.avg(whole).alias(f"_{side}_m"),
        ]
    out = rows.groupBy(*by).agg(*aggs)
    scale = F.sqrt(F.lit(float(YEAR)) / F.col("_h"))
    for side in ("gross", "net"):
        s, enough = F.col(f"_{side}_s"), F.col("_c") >= 2
        out = out.withColumns(
            {
                f"{side}_cumulative": F.when(F.col("periods") == 1, F.col(f"_{side}_one")).otherwise(F.col(f"_{side}_p") - 1),
                f"{side}_volatility": F.when(enough, s * scale),
                f"{side}_sharpe": F.when(enough & (s > 0), F.col(f"_{side}_m") / s * scale),
            }
        )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


# --- staggered entry ------------------------------------------------------------------


def formation_dates(cal: DataFrame, delay: int, first: int | None = None) -> DataFrame:
    """Eligible start dates: the first N, or those in the first calendar month."""
    eligible = cal.where(F.col("idx") + delay < F.col("total"))
    if first is not None:
        if first < 1:
            raise ValueError("the number of formation dates must be positive")
        return eligible.where(F.col("idx") < first)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    month = F.trunc("trade_date", "MM")
    return eligible.withColumn("_m", F.min(month).over(whole)).where(month == F.col("_m")).drop("_m")


def cohort_tables(formation: DataFrame, factor_id: str, holding: int, delay: int = 1, **run) -> tuple[DataFrame, DataFrame]:
    """A schedule and a run per formation date."""
    schedules = formation.select(
        F.col("trade_date").cast("string").alias("schedule_id"),
        F.lit(holding).alias("holding"),
        F.lit(delay).alias("delay"),
        F.col("idx").alias("start_idx"),
        F.lit(False).alias("partial"),
    )
    base = Run("", factor_id, "", **run)
    runs = schedules.select(
        F.col("schedule_id").alias("run_id"),
        F.lit(factor_id).alias("factor_id"),
        "schedule_id",
        F.lit(base.top_quantile).alias("top_quantile"),
        F.lit(base.group_count).alias("group_count"),
        F.lit(base.commission_bps).alias("commission_bps"),
        F.lit(base.slippage_bps).alias("slippage_bps"),
        F.lit(base.borrow_bps_annual).alias("borrow_bps_annual"),
    )
    return schedules, runs


def staggered_nav(nav: DataFrame, cal: DataFrame, runs: DataFrame) -> DataFrame:
    """Equal-capital mix of cohort NAVs per date; cash before a cohort starts, last mark carried."""
    daily = nav.groupBy("run_id", "idx").agg(F.max_by("net_nav", "period_id").alias("net_nav"), F.lit(1).alias("_has"))
    total = cal.where("idx = 0").select("idx", "total")
    grid = runs.select("run_id").withColumn("idx", F.lit(0)).join(total, "idx").select(
        "run_id", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("idx")
    )
    w = Window.partitionBy("run_id").orderBy("idx")
    cells = grid.join(daily, ["run_id", "idx"], "left").select(
        "run_id",
        "idx",
        F.coalesce(F.last("net_nav", ignorenulls=True).over(w), F.lit(1.0)).alias("_nav"),
        F.coalesce(F.max("_has").over(w), F.lit(0)).alias("_on"),
    )
    per = cells.groupBy("idx").agg(
        F.avg("_nav").alias("net_nav"),
        F.sum("_on").alias("active_cohorts"),
        (1 - F.avg("_on")).alias("inactive_cash_weight"),
    )
    order = Window.orderBy("idx")
    return per.join(cal.select("idx", "trade_date"), "idx").select(
        "trade_date",
        "net_nav",
        F.col("net_nav").alias("relative_nav"),
        (F.try_divide(F.col("net_nav"), F.coalesce(F.lag("net_nav").over(order), F.lit(1.0))) - 1).alias("daily_net_return"),
        "active_cohorts",
        "inactive_cash_weight",
    )
