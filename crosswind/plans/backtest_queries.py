"""Registered queries: schedules, period returns, legs, turnover, NAV, metrics, cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswind.operators import backtest as B
from crosswind.plans.common import cross, panel
from crosswind.plans.registry import panel_sql, query, r6, register
from crosswind.session import durable

SCHEDULES = [B.Schedule("ten", 10), B.Schedule("monthly", 21, delay=2, start_idx=3, partial=True)]
RUNS = [
    B.Run("MOM-10", "MOM", "ten", 0.3, 5, 5.0, 5.0, 50.0),
    B.Run("VOL-21", "VOL", "monthly", 0.2, 4, 3.0, 2.0, 0.0),
]


def scores(df):
    """Two factors; momentum has an uncovered half-year and a thin spring."""
    day, name = F.col("trade_date"), F.col("instrument")
    gap = day.between("1999-01-01", "1999-06-30")
    thin = day.between("2000-01-01", "2000-04-30") & (name > "S000000000002")
    cells = F.array(
        F.struct(F.lit("MOM").alias("factor_id"), F.when(~gap & ~thin, F.col("return_5d")).alias("score")),
        F.struct(F.lit("VOL").alias("factor_id"), F.col("volume").alias("score")),
    )
    return df.select("trade_date", "instrument", F.inline(cells))


def backtest(spark, d, reuse=False) -> B.Backtest:
    df = panel(spark, d).select("trade_date", "instrument", "close", "volume", "return_5d")
    df = durable(df) if reuse else df
    return B.Backtest(
        df.select("trade_date", "instrument", "close"), scores(df), B.schedules_table(spark, SCHEDULES), B.runs_table(spark, RUNS), cross(spark, d), reuse
    )


CAL_SQL = """
cal AS (SELECT trade_date, CAST(ROW_NUMBER() OVER (ORDER BY trade_date) - 1 AS INTEGER) AS idx, CAST(COUNT(*) OVER () AS INTEGER) AS n
        FROM (SELECT DISTINCT trade_date FROM panel)),
sc AS (
  SELECT 'MOM' AS factor_id, trade_date, instrument, CASE WHEN trade_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' THEN NULL
         WHEN trade_date BETWEEN DATE '2000-01-01' AND DATE '2000-04-30' AND instrument > 'S000000000002' THEN NULL ELSE return_5d END AS score FROM panel
  UNION ALL SELECT 'VOL', trade_date, instrument, volume FROM panel)"""
RUNS_SQL = """
runs AS (
  SELECT * FROM (VALUES ('MOM-10', 'MOM', 0, 10, 1, CAST(0.3 AS DOUBLE), 5, FALSE, 5.0, 5.0, 50.0), ('VOL-21', 'VOL', 3, 21, 2, CAST(0.2 AS DOUBLE), 4, TRUE, 3.0, 2.0, 0.0))
    AS t(run_id, factor_id, start_idx, holding, delay, q, g, partial, comm, slip, borrow))"""
CORE_SQL = """
slots AS (
  SELECT r.*, c.idx AS signal_idx, c.trade_date AS signal_date, n, idx + delay AS entry_idx, idx + delay + holding AS planned,
         idx + delay + holding < n AS is_complete,
         CASE WHEN idx + delay + holding < n THEN idx + delay + holding WHEN partial THEN n - 1 END AS exit_idx
  FROM runs r JOIN cal c ON idx >= start_idx AND (idx - start_idx) % holding = 0 AND idx < n - delay - 1),
grid AS (
  SELECT s.*, e.trade_date AS entry_date, x.trade_date AS exit_date, exit_idx - entry_idx AS days_held
  FROM slots s JOIN cal e ON e.idx = entry_idx JOIN cal x ON x.idx = exit_idx WHERE exit_idx > entry_idx),
pc AS (SELECT instrument, idx, trade_date, close FROM panel JOIN cal USING (trade_date)),
lastq AS (
  SELECT run_id, signal_idx, instrument, arg_max(close, idx) AS last_close, MAX(idx) AS last_idx
  FROM grid JOIN pc ON idx > entry_idx AND idx <= exit_idx GROUP BY 1, 2, 3),
pret AS (
  SELECT g.run_id, g.signal_idx, e.instrument, e.close AS entry_close, COALESCE(last_close, e.close) / e.close - 1 AS period_return,
         last_idx IS NULL OR last_idx <> exit_idx AS lost
  FROM grid g JOIN pc e ON e.idx = g.entry_idx
  LEFT JOIN lastq l ON l.run_id = g.run_id AND l.signal_idx = g.signal_idx AND l.instrument = e.instrument),
sig AS (
  SELECT g.run_id, g.signal_idx, s.instrument, s.score FROM grid g JOIN sc s ON s.factor_id = g.factor_id AND s.trade_date = g.signal_date
  WHERE s.score IS NOT NULL),
mt AS (SELECT sig.*, entry_close, period_return, lost FROM sig JOIN pret USING (run_id, signal_idx, instrument) WHERE period_return IS NOT NULL),
cnt AS (
  SELECT g.run_id, g.signal_idx, g.g, g.q, (SELECT COUNT(*) FROM sig s WHERE s.run_id = g.run_id AND s.signal_idx = g.signal_idx) AS signal_count,
         (SELECT COUNT(*) FROM mt m WHERE m.run_id = g.run_id AND m.signal_idx = g.signal_idx) AS matched_count FROM grid g),
sk AS (SELECT *, CASE WHEN signal_count = 0 THEN 'REBALANCE_SKIPPED_NO_COVERAGE' WHEN matched_count < GREATEST(4, g) THEN 'REBALANCE_SKIPPED_THIN' END AS skip_reason FROM cnt),
pos AS (
  SELECT m.*, ROW_NUMBER() OVER w AS pos, COUNT(*) OVER (PARTITION BY run_id, signal_idx) AS n,
         CAST(GREATEST(1, FLOOR(matched_count * q)) AS BIGINT) AS k,
         CASE WHEN g = 5 THEN NTILE(5) OVER w ELSE NTILE(4) OVER w END AS grp
  FROM mt m JOIN sk USING (run_id, signal_idx) WHERE skip_reason IS NULL WINDOW w AS (PARTITION BY run_id, signal_idx ORDER BY score, instrument)),
lg AS (SELECT *, pos <= k AS is_short, pos > n - k AS is_long FROM pos),
per0 AS (
  SELECT run_id, signal_idx, AVG(period_return) FILTER (WHERE is_long) AS long_return, AVG(period_return) FILTER (WHERE is_short) AS short_return,
         COUNT(*) FILTER (WHERE is_long) AS long_count, COUNT(*) FILTER (WHERE is_short) AS short_count,
         COUNT(*) FILTER (WHERE lost AND is_long) + COUNT(*) FILTER (WHERE lost AND is_short) AS lost_count
  FROM lg GROUP BY 1, 2),
per AS (SELECT *, long_return - short_return AS gross_return, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY signal_idx) - 1 AS period_id FROM per0),
wt AS (
  SELECT lg.run_id, period_id, instrument, is_long, is_short, CASE WHEN is_long THEN 1.0 / k ELSE 0.0 END - CASE WHEN is_short THEN 1.0 / k ELSE 0.0 END AS w
  FROM lg JOIN per USING (run_id, signal_idx) WHERE is_long OR is_short),
tov AS (
  SELECT p.run_id, p.period_id, (SELECT SUM(ABS(COALESCE(a.w, 0) - COALESCE(b.w, 0))) FROM (SELECT * FROM wt x WHERE x.run_id = p.run_id AND x.period_id = p.period_id) a
           FULL OUTER JOIN (SELECT * FROM wt y WHERE y.run_id = p.run_id AND y.period_id = p.period_id - 1) b ON a.instrument = b.instrument) AS traded,
         (SELECT COUNT(*) FROM wt a JOIN wt b ON a.instrument = b.instrument AND a.is_long AND b.is_long WHERE a.run_id = p.run_id AND b.run_id = p.run_id
            AND a.period_id = p.period_id AND b.period_id = p.period_id - 1) AS long_kept,
         (SELECT COUNT(*) FROM wt a JOIN wt b ON a.instrument = b.instrument AND a.is_short AND b.is_short WHERE a.run_id = p.run_id AND b.run_id = p.run_id
            AND a.period_id = p.period_id AND b.period_id = p.period_id - 1) AS short_kept
  FROM per p),
pt AS (
  SELECT p.*, traded AS traded_notional, traded / 2 AS turnover_rate, CASE WHEN period_id = 0 THEN traded / 2 END AS initial_build_turnover,
         CASE WHEN period_id > 0 THEN traded / 2 END AS rebalance_turnover,
         CASE WHEN period_id > 0 THEN ((1 - CAST(long_kept AS DOUBLE) / GREATEST(LAG(long_count) OVER w, long_count, 1))
           + (1 - CAST(short_kept AS DOUBLE) / GREATEST(LAG(short_count) OVER w, short_count, 1))) / 2 END AS rebalance_rate,
         signal_date, entry_idx, exit_idx, entry_date, exit_date, is_complete, days_held, holding,
         traded * (comm + slip) / 10000.0 + borrow / 10000.0 * days_held / 252 AS cost
  FROM per p JOIN tov USING (run_id, period_id) JOIN grid USING (run_id, signal_idx) WINDOW w AS (PARTITION BY run_id ORDER BY period_id)),
ptab AS (SELECT *, gross_return - cost AS net_return FROM pt)"""
NAV_SQL = """
dense AS (
  SELECT l.run_id, l.signal_idx, l.instrument, is_long, c.idx, pc.close / entry_close - 1 AS mark
  FROM lg l JOIN grid g USING (run_id, signal_idx) JOIN cal c ON c.idx BETWEEN g.entry_idx AND g.exit_idx
  LEFT JOIN pc ON pc.idx = c.idx AND pc.instrument = l.instrument WHERE is_long OR is_short),
filled AS (SELECT *, LAST_VALUE(mark IGNORE NULLS) OVER (PARTITION BY run_id, signal_idx, is_long, instrument ORDER BY idx) AS f FROM dense),
marks AS (SELECT run_id, signal_idx, is_long, idx, COUNT(mark) AS fresh, CASE WHEN COUNT(mark) > 0 THEN AVG(f) END AS leg_return FROM filled GROUP BY 1, 2, 3, 4),
pnav AS (
  SELECT a.run_id, period_id, a.idx, 1 + (a.leg_return - b.leg_return) AS gross_period_nav, 1 + (a.leg_return - b.leg_return) - cost AS net_period_nav
  FROM marks a JOIN marks b ON a.run_id = b.run_id AND a.signal_idx = b.signal_idx AND a.idx = b.idx AND a.is_long AND NOT b.is_long
  JOIN ptab p ON p.run_id = a.run_id AND p.signal_idx = a.signal_idx),
ends AS (
  SELECT run_id, period_id, arg_max(gross_period_nav, idx) FILTER (WHERE gross_period_nav IS NOT NULL) AS ge,
         arg_max(net_period_nav, idx) FILTER (WHERE net_period_nav IS NOT NULL) AS ne FROM pnav GROUP BY 1, 2),
bases AS (
  SELECT run_id, period_id, COALESCE(PRODUCT(COALESCE(ge, 1.0)) OVER w, 1.0) AS gb, COALESCE(PRODUCT(COALESCE(ne, 1.0)) OVER w, 1.0) AS nb
  FROM ends WINDOW w AS (PARTITION BY run_id ORDER BY period_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
nav AS (SELECT run_id, period_id, idx, trade_date, gross_period_nav, net_period_nav, gb * gross_period_nav AS gross_nav, nb * net_period_nav AS net_nav
        FROM pnav JOIN bases USING (run_id, period_id) JOIN cal USING (idx)),
ledger AS (
  SELECT run_id, period_id, trade_date, gross_nav, net_nav, ROW_NUMBER() OVER w AS day_no,
         gross_nav / COALESCE(LAG(gross_nav) OVER w, 1.0) - 1 AS daily_gross_return, net_nav / COALESCE(LAG(net_nav) OVER w, 1.0) - 1 AS daily_net_return
  FROM nav WHERE gross_nav IS NOT NULL AND net_nav IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY period_id, idx)),
dd AS (
  SELECT run_id, LEAST(0.0, MIN(g)) AS max_drawdown, LEAST(0.0, MIN(nn)) AS net_max_drawdown FROM (
    SELECT run_id, gross_nav / GREATEST(1.0, MAX(gross_nav) OVER w) - 1 AS g, net_nav / GREATEST(1.0, MAX(net_nav) OVER w) - 1 AS nn
    FROM nav WINDOW w AS (PARTITION BY run_id ORDER BY period_id, idx)) GROUP BY 1)"""


def summary_sql(source: str, by: str, name: str) -> str:
    sides = ", ".join(
        f"CASE WHEN COUNT(*) = 1 THEN MAX({s}_return) ELSE PRODUCT(1 + {s}_return) - 1 END AS {s}_cumulative, "
        f"CASE WHEN COUNT(*) FILTER (WHERE is_complete) >= 2 THEN STDDEV_SAMP({s}_return) FILTER (WHERE is_complete) * sqrt(252.0 / MAX(holding)) END AS {s}_volatility, "
        f"CASE WHEN COUNT(*) FILTER (WHERE is_complete) >= 2 AND STDDEV_SAMP({s}_return) FILTER (WHERE is_complete) > 0 THEN AVG({s}_return) FILTER (WHERE is_complete) "
        f"/ STDDEV_SAMP({s}_return) FILTER (WHERE is_complete) * sqrt(252.0 / MAX(holding)) END AS {s}_sharpe"
        for s in ("gross", "net")
    )
    return (
        f"{name} AS (SELECT {by}, COUNT(*) AS periods, CAST(SUM(days_held) AS BIGINT) AS exposure_days, COUNT(*) FILTER (WHERE NOT is_complete) AS partial_periods, "
        f"CAST(SUM(lost_count) AS BIGINT) AS lost_positions, SUM(cost) AS cost_sum, AVG(rebalance_rate) AS rebalance_rate, AVG(rebalance_turnover) AS turnover_rate, "
        f"MAX(exit_idx) - MIN(entry_idx) AS span_days, CAST(MAX(exit_date) - MIN(entry_date) + 1 AS BIGINT) AS calendar_days, {sides} FROM {source} GROUP BY {by})"
    )


def annual_sql(cum: str, days: str, reportable: bool = True) -> str:
    core = f"CASE WHEN {days} > 0 THEN CASE WHEN 1 + {cum} <= 0 THEN -1.0 ELSE POW(1 + {cum}, 252.0 / {days}) - 1 END END"
    return f"CASE WHEN 1 + {cum} <= 0 OR {days} >= 126 THEN {core} END" if reportable else core


RUN_SUMMARY = summary_sql("ptab", "run_id", "rs")
METRICS_SQL = """
ms AS (
  SELECT rs.*, no_cov AS skipped_no_coverage, thin AS skipped_thin, max_drawdown, net_max_drawdown,
         CASE WHEN no_cov + thin > 0 THEN span_days ELSE exposure_days END AS headline_days,
         CASE WHEN no_cov + thin > 0 THEN 'calendar_trading_days' ELSE 'exposure_days' END AS headline_basis
  FROM rs JOIN (SELECT run_id, COUNT(*) FILTER (WHERE skip_reason LIKE '%NO_COVERAGE') AS no_cov, COUNT(*) FILTER (WHERE skip_reason LIKE '%THIN') AS thin FROM sk GROUP BY 1) USING (run_id)
  JOIN dd USING (run_id))"""
SEGMENT_SQL = (
    """
sgd AS (SELECT run_id, signal_date, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY signal_date) AS i, COUNT(*) OVER (PARTITION BY run_id) AS n FROM (SELECT DISTINCT run_id, signal_date FROM ptab)),
sga AS (SELECT run_id, signal_date, CASE WHEN i <= round_even(CAST(0.5 AS DOUBLE) * n, 0) THEN 'IS' WHEN i <= round_even(CAST(0.8 AS DOUBLE) * n, 0) THEN 'OOS1' ELSE 'OOS2' END AS split FROM sgd),
sgs AS (SELECT run_id, split, LEAD(MIN(signal_date)) OVER (PARTITION BY run_id ORDER BY MIN(signal_date)) AS nxt FROM sga GROUP BY 1, 2),
sgr AS (SELECT p.*, split, nxt IS NULL OR exit_date < nxt AS kept FROM ptab p JOIN sga USING (run_id, signal_date) JOIN sgs USING (run_id, split)),
sgk AS (SELECT * FROM sgr WHERE kept),"""
    + summary_sql("sgk", "run_id, split", "sgm")
    + """,
seg AS (SELECT a.run_id, a.split, purged, COALESCE(periods, 0) AS periods, exposure_days, gross_cumulative, net_cumulative, gross_sharpe, net_sharpe, """
    + annual_sql("gross_cumulative", "exposure_days") + " AS gross_annual, " + annual_sql("net_cumulative", "exposure_days")
    + """ AS net_annual, start_date, end_date FROM (SELECT run_id, split, COUNT(*) FILTER (WHERE NOT kept) AS purged FROM sgr GROUP BY 1, 2) a
  LEFT JOIN sgm USING (run_id, split) LEFT JOIN (SELECT run_id, split, MIN(signal_date) AS start_date, MAX(signal_date) AS end_date FROM sgk GROUP BY 1, 2) USING (run_id, split))"""
)

BASE = (CAL_SQL, RUNS_SQL, CORE_SQL)


def table(name: str, pick, columns: str, source: str, *ctes: str, reuse: bool = False) -> None:
    """Register one table of the backtest; ``columns`` marks floats to round with a ~."""
    names = [c.strip() for c in columns.split(",")]

    def run(spark, d):
        df = pick(backtest(spark, d, reuse))
        return df.select(*[r6(c[1:]).alias(c[1:]) if c.startswith("~") else F.col(c) for c in names])

    shown = ", ".join(f"ROUND({c[1:]}, 6) AS {c[1:]}" if c.startswith("~") else c for c in names)
    register(name, run, panel_sql(f"SELECT {shown} FROM {source}", *BASE, *ctes))


def grid_only(b):
    return B.rebalance_grid(b.calendar, b.schedules).join(b.runs, "schedule_id")


table("b01_rebalance_grid", grid_only, "run_id, signal_idx", "slots")


@query("b02_start_index", panel_sql("SELECT MIN(idx) AS start_idx FROM cal WHERE trade_date >= DATE '1999-02-03'", CAL_SQL))
def start_index(spark, d):
    return B.start_index(B.calendar(panel(spark, d)), "1999-02-03")


table(
    "b03_schedule", lambda b: b.periods, "run_id, signal_idx, entry_idx, exit_idx, signal_date, entry_date, exit_date, is_complete, days_held", "grid"
)
table(
    "b04_period_return",
    lambda b: B.period_returns(b.panel, b.calendar, B.schedule(b.calendar, b.schedules)).join(b.runs.select("run_id", "schedule_id"), "schedule_id"),
    "run_id, signal_idx, instrument, entry_close, period_return, lost", "pret",
)
table("b05_signal_join", lambda b: b.matched, "run_id, signal_idx, instrument, score, period_return, lost", "mt")
table("b06_skip_stubs", lambda b: b.slots, "run_id, signal_idx, signal_count, matched_count, skip_reason", "sk")
table("b07_legs", lambda b: b.positions, "run_id, signal_idx, instrument, pos, n, k, is_short, is_long", "lg")
table(
    "b08_leg_returns", lambda b: b.leg_returns,
    "run_id, signal_idx, period_id, ~long_return, ~short_return, ~gross_return, long_count, short_count, lost_count", "per",
)
register(
    "b09_quantile_groups",
    lambda spark, d: backtest(spark, d).group_means.withColumn("mean_return", r6("mean_return")),
    panel_sql(
        'SELECT run_id, grp AS "group", ROUND(AVG(m), 6) AS mean_return, COUNT(*) AS periods FROM (SELECT run_id, signal_idx, grp, AVG(period_return) AS m FROM lg GROUP BY 1, 2, 3) GROUP BY 1, 2',
        *BASE,
    ),
)
table("b10_rebalance_rate", lambda b: b.turnover, "run_id, period_id, ~rebalance_rate", "ptab", reuse=True)
register(
    "b11_weights",
    lambda spark, d: backtest(spark, d).legs.select("run_id", "signal_idx", "instrument", r6("weight").alias("weight")),
    panel_sql(
        "SELECT run_id, signal_idx, instrument, ROUND(w, 6) AS weight FROM wt JOIN (SELECT run_id, signal_idx, period_id FROM per) USING (run_id, period_id)", *BASE
    ),
)
table(
    "b12_turnover", lambda b: b.turnover, "run_id, period_id, ~traded_notional, ~turnover_rate, ~initial_build_turnover, ~rebalance_turnover", "ptab", reuse=True)
table("b13_transaction_cost", lambda b: b.period_table, "run_id, period_id, ~cost, ~net_return", "ptab", reuse=True)
table("b14_leg_daily_marks", lambda b: b.leg_marks, "run_id, signal_idx, is_long, idx, fresh, ~leg_return", "marks", NAV_SQL)
table("b15_period_nav", lambda b: b.period_nav, "run_id, period_id, idx, ~gross_period_nav, ~net_period_nav", "pnav", NAV_SQL, reuse=True)
table("b16_nav_compounding", lambda b: b.nav, "run_id, period_id, trade_date, ~gross_nav, ~net_nav", "nav", NAV_SQL, reuse=True)
table(
    "b17_daily_ledger", lambda b: b.ledger, "run_id, period_id, trade_date, day_no, ~gross_nav, ~net_nav, ~daily_gross_return, ~daily_net_return",
    "ledger", NAV_SQL, reuse=True)
register(
    "b18_active_risk",
    lambda spark, d: backtest(spark, d, True).active_risk.select("run_id", r6("tracking_error").alias("tracking_error"), r6("information_ratio").alias("information_ratio")),
    panel_sql(
        "SELECT run_id, ROUND(STDDEV_SAMP(daily_net_return) * sqrt(252), 6) AS tracking_error, ROUND(AVG(daily_net_return) / STDDEV_SAMP(daily_net_return) * sqrt(252), 6) AS information_ratio "
        "FROM ledger WHERE day_no > 1 GROUP BY 1",
        *BASE, NAV_SQL,
    ),
)
table("b19_cumulative_return", lambda b: B.return_summary(b.period_table, ["run_id"]), "run_id, periods, ~gross_cumulative, ~net_cumulative", "rs", RUN_SUMMARY, reuse=True)
ANNUAL = {
    f"{s}_annual{suffix}": annual_sql(f"{s}_cumulative", days, rep)
    for s in ("gross", "net")
    for suffix, days, rep in (("", "headline_days", True), ("_exposure", "exposure_days", True), ("_calendar", "span_days", True), ("_extrapolated", "headline_days", False))
}
ANNUAL_SQL = "ann AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in ANNUAL.items()) + " FROM ms)"
table(
    "b20_annualised_return", lambda b: b.metrics, "run_id, headline_days, headline_basis, " + ", ".join(f"~{k}" for k in ANNUAL), "ann",
    NAV_SQL, RUN_SUMMARY, METRICS_SQL, ANNUAL_SQL, reuse=True)
table("b21_volatility", lambda b: B.return_summary(b.period_table, ["run_id"]), "run_id, ~gross_volatility, ~net_volatility", "rs", RUN_SUMMARY, reuse=True)
table("b22_sharpe", lambda b: B.return_summary(b.period_table, ["run_id"]), "run_id, ~gross_sharpe, ~net_sharpe", "rs", RUN_SUMMARY, reuse=True)
table("b23_max_drawdown", lambda b: b.drawdown, "run_id, ~max_drawdown, ~net_max_drawdown", "dd", NAV_SQL, reuse=True)
table("b24_exposure_days", lambda b: b.exposure, "run_id, periods, exposure_days, span_days, calendar_days", "rs", RUN_SUMMARY, reuse=True)
table(
    "b25_segment_metrics", lambda b: b.segments(),
    "run_id, split, start_date, end_date, purged, periods, ~gross_cumulative, ~net_cumulative, ~gross_annual, ~net_annual, ~gross_sharpe, ~net_sharpe",
    "seg", SEGMENT_SQL, reuse=True)
register(
    "b26_backtest_warnings",
    lambda spark, d: backtest(spark, d, True).warnings().select("run_id", F.array_join("warnings", ",").alias("warnings")),
    panel_sql(
        "SELECT run_id, concat_ws(',', CASE WHEN periods < 2 THEN 'TOO_FEW_PERIODS' END, CASE WHEN headline_days > 0 AND headline_days < 126 THEN 'SHORT_ANNUALIZATION_WINDOW' END, "
        "CASE WHEN rebalance_rate > 0.8 THEN 'HIGH_REBALANCE_RATE' END, CASE WHEN turnover_rate > 1.5 THEN 'HIGH_TURNOVER_RATE' END, "
        "CASE WHEN gross_annual > 0 AND net_annual < gross_annual * 0.5 THEN 'COST_SENSITIVE' END, "
        "CASE WHEN (SELECT MAX(s.net_annual) FROM seg s WHERE s.run_id = ann.run_id AND split = 'IS') > 0 AND EXISTS (SELECT 1 FROM seg o, seg i WHERE o.run_id = ann.run_id AND i.run_id = ann.run_id "
        "AND i.split = 'IS' AND o.split LIKE 'OOS%' AND o.periods > 0 AND o.net_annual < i.net_annual * 0.5) THEN 'OOS_SEGMENT_DECAY' END, "
        "CASE WHEN partial_periods > 0 THEN 'PARTIAL_FINAL_PERIOD' END, CASE WHEN EXISTS (SELECT 1 FROM slots z WHERE z.run_id = ann.run_id AND NOT is_complete AND NOT partial) THEN 'FINAL_PARTIAL_PERIOD_EXCLUDED' END, "
        "CASE WHEN lost_positions > 0 THEN 'POSITIONS_LOST_BEFORE_EXIT' END, CASE WHEN skipped_no_coverage > 0 THEN 'REBALANCE_SKIPPED_NO_COVERAGE' END, "
        "CASE WHEN skipped_thin > 0 THEN 'REBALANCE_SKIPPED_THIN' END, CASE WHEN headline_basis = 'calendar_trading_days' THEN 'ANNUALIZATION_BASIS_CALENDAR_TIME' END) AS warnings FROM ann",
        *BASE, NAV_SQL, RUN_SUMMARY, METRICS_SQL, ANNUAL_SQL, SEGMENT_SQL,
    ),
)
register(
    "b27_cost_reconciliation",
    lambda spark, d: backtest(spark, d, True).reconciliation.select(
        "run_id", *[r6(c).alias(c) for c in ("cost_sum", "gross_terminal", "net_terminal", "arithmetic_excess", "relative_excess")]
    ),
    panel_sql(
        "SELECT run_id, ROUND(cost_sum, 6) AS cost_sum, ROUND(1 + gross_cumulative, 6) AS gross_terminal, ROUND(1 + net_cumulative, 6) AS net_terminal, "
        "ROUND(net_cumulative, 6) AS arithmetic_excess, ROUND(net_cumulative, 6) AS relative_excess FROM rs",
        *BASE, RUN_SUMMARY,
    ),
)


@query(
    "b28_run_backtest",
    panel_sql(
        "SELECT run_id, periods, exposure_days, span_days, lost_positions, skipped_no_coverage, skipped_thin, headline_basis, "
        + ", ".join(
            f"ROUND({c}, 6) AS {c}"
            for c in ("gross_cumulative", "net_cumulative", "gross_annual", "net_annual", "gross_sharpe", "net_sharpe", "max_drawdown", "net_max_drawdown", "rebalance_rate", "turnover_rate")
        )
        + " FROM ann",
        *BASE, NAV_SQL, RUN_SUMMARY, METRICS_SQL, ANNUAL_SQL,
    ),
)
def run_backtest(spark, d):
    m = backtest(spark, d, reuse=True).metrics
    floats = ("gross_cumulative", "net_cumulative", "gross_annual", "net_annual", "gross_sharpe", "net_sharpe", "max_drawdown", "net_max_drawdown", "rebalance_rate", "turnover_rate")
    return m.select(
        "run_id", "periods", "exposure_days", "span_days", "lost_positions", "skipped_no_coverage", "skipped_thin", "headline_basis",
        *[r6(c).alias(c) for c in floats],
    )


@query(
    "b29_formation_dates",
    panel_sql(
        "SELECT 'month' AS rule, idx, trade_date FROM cal WHERE idx + 1 < n AND date_trunc('month', trade_date) = (SELECT MIN(date_trunc('month', trade_date)) FROM cal) "
        "UNION ALL SELECT 'first', idx, trade_date FROM cal WHERE idx < 7 AND idx + 1 < n",
        CAL_SQL,
    ),
)
def formation(spark, d):
    cal = B.calendar(panel(spark, d))
    month = B.formation_dates(cal, 1).withColumn("rule", F.lit("month"))
    return month.unionByName(B.formation_dates(cal, 1, 7).withColumn("rule", F.lit("first"))).select("rule", "idx", "trade_date")


COHORT_RUNS = """
runs AS (SELECT CAST(trade_date AS VARCHAR) AS run_id, 'VOL' AS factor_id, idx AS start_idx, 10 AS holding, 1 AS delay, CAST(0.3 AS DOUBLE) AS q, 5 AS g, FALSE AS partial,
         5.0 AS comm, 5.0 AS slip, 0.0 AS borrow FROM cal WHERE idx < 4)"""


def cohort_backtest(spark, d, reuse=False):
    df = panel(spark, d).select("trade_date", "instrument", "close", "volume", "return_5d")
    df = durable(df) if reuse else df
    small = df.select("trade_date", "instrument", "close")
    first = B.formation_dates(B.calendar(small), 1, 4)
    schedules, runs = B.cohort_tables(first, "VOL", 10, commission_bps=5.0, slippage_bps=5.0)
    return B.Backtest(small, scores(df), schedules, runs, cross(spark, d), reuse)


@query(
    "b30_staggered_cohorts",
    panel_sql("SELECT run_id, periods, exposure_days, ROUND(gross_cumulative, 6) AS gross_cumulative, ROUND(net_cumulative, 6) AS net_cumulative FROM rs", CAL_SQL, COHORT_RUNS, CORE_SQL, RUN_SUMMARY),
)
def cohorts(spark, d):
    s = B.return_summary(cohort_backtest(spark, d, True).period_table, ["run_id"])
    return s.select("run_id", "periods", "exposure_days", r6("gross_cumulative").alias("gross_cumulative"), r6("net_cumulative").alias("net_cumulative"))


STAGGER_SQL = """
sday AS (SELECT run_id, idx, arg_max(net_nav, period_id) AS v FROM nav GROUP BY 1, 2),
scell AS (SELECT r.run_id, c.idx, c.trade_date, v, MIN(CASE WHEN s.idx IS NOT NULL THEN s.idx END) OVER (PARTITION BY r.run_id) AS first_idx,
          LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY r.run_id ORDER BY c.idx) AS f FROM runs r CROSS JOIN cal c LEFT JOIN sday s ON s.run_id = r.run_id AND s.idx = c.idx),
smix AS (SELECT idx, trade_date, SUM(CASE WHEN idx < first_idx THEN 1.0 ELSE COALESCE(f, 1.0) END) / COUNT(*) AS net_nav,
         COUNT(*) FILTER (WHERE idx >= first_idx) AS active_cohorts, COUNT(*) FILTER (WHERE idx < first_idx) / CAST(COUNT(*) AS DOUBLE) AS inactive_cash_weight FROM scell GROUP BY 1, 2)"""


@query(
    "b31_staggered_nav",
    panel_sql(
        "SELECT trade_date, ROUND(net_nav, 6) AS net_nav, ROUND(net_nav / COALESCE(LAG(net_nav) OVER (ORDER BY idx), 1.0) - 1, 6) AS daily_net_return, active_cohorts, "
        "ROUND(inactive_cash_weight, 6) AS inactive_cash_weight FROM smix",
        CAL_SQL, COHORT_RUNS, CORE_SQL, NAV_SQL, STAGGER_SQL,
    ),
)
def stagger(spark, d):
    b = cohort_backtest(spark, d, True)
    out = B.staggered_nav(b.nav, b.calendar, b.runs)
    return out.select("trade_date", r6("net_nav").alias("net_nav"), r6("daily_net_return").alias("daily_net_return"), "active_cohorts", r6("inactive_cash_weight").alias("inactive_cash_weight"))
