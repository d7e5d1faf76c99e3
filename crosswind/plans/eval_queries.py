"""Registered queries: forward returns, rank IC, splits, metric rows, falsification."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswind.operators import evaluate as E
from crosswind.operators import falsify as X
from crosswind.operators import scores as C
from crosswind.plans.common import cross, momentum_scores, panel
from crosswind.plans.panel_queries import KEY
from crosswind.plans.registry import panel_sql, query, r6, register
from crosswind.plans.score_queries import ST_FILTER
from crosswind.session import durable

FACTORS = {"MOM": "return_5d", "VOL": "volume"}
ONE = (5,)
ALL = E.DEFAULT_HORIZONS


def lab_sql(factors: dict[str, str], horizons: tuple[int, ...], delay: int = 1, source: str = "panel") -> str:
    w = "OVER (PARTITION BY instrument ORDER BY trade_date)"
    parts = [
        f"SELECT '{f}' AS factor_id, {h} AS horizon, trade_date, instrument, {c} AS score, "
        f"LEAD(close, {delay + h}) {w} / LEAD(close, {delay}) {w} - 1 AS f FROM {source}"
        for f, c in factors.items()
        for h in horizons
    ]
    return "lab AS (" + " UNION ALL ".join(parts) + ")"


def daily_sql(source: str = "lab", by: str = "factor_id, horizon", name: str = "daily") -> str:
    day = f"{by}, trade_date" if by else "trade_date"
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in day.split(","))
    shown = ", ".join(f"a.{c.strip()}" for c in day.split(","))
    return f"""
{name}_both AS (SELECT * FROM {source} WHERE score IS NOT NULL AND f IS NOT NULL),
{name}_rk AS (
  SELECT {day}, RANK() OVER (PARTITION BY {day} ORDER BY score) + (COUNT(*) OVER (PARTITION BY {day}, score) - 1) / 2.0 AS rs,
         RANK() OVER (PARTITION BY {day} ORDER BY f) + (COUNT(*) OVER (PARTITION BY {day}, f) - 1) / 2.0 AS rf FROM {name}_both),
{name}_ic AS (
  SELECT {day}, COUNT(*) AS joint_rows, CASE WHEN MIN(rs) < MAX(rs) AND MIN(rf) < MAX(rf)
         THEN COVAR_POP(rs, rf) / (STDDEV_POP(rs) * STDDEV_POP(rf)) END AS ic FROM {name}_rk GROUP BY {day}),
{name}_raw AS (SELECT {day}, COUNT(*) AS raw_rows, COUNT(score) AS score_rows, COUNT(f) AS label_rows FROM {source} GROUP BY {day}),
{name} AS (SELECT {shown}, ic, COALESCE(joint_rows, 0) AS joint_rows, raw_rows, score_rows, label_rows
           FROM {name}_raw a LEFT JOIN {name}_ic b ON {on})"""


def summary_sql(source: str = "daily", by: str = "factor_id, horizon", name: str = "summ") -> str:
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    cols = ", ".join(f"a.{c.strip()}" for c in by.split(","))
    return f"""
{name}_s AS (SELECT {by}, ic - AVG(ic) OVER (PARTITION BY {by}) AS c, COUNT(*) OVER (PARTITION BY {by}) AS n,
         ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY trade_date) AS rn FROM {source} WHERE ic IS NOT NULL),
{name}_g AS (SELECT {cols}, a.n, b.rn - a.rn AS k, SUM(a.c * b.c) / MAX(a.n) AS g FROM {name}_s a JOIN {name}_s b ON {on}
         AND b.rn >= a.rn AND b.rn - a.rn <= LEAST(a.horizon - 1, a.n - 1) GROUP BY {cols}, a.n, b.rn - a.rn),
{name}_v AS (SELECT {by}, n, SUM(CASE WHEN k = 0 THEN g ELSE 2.0 * (1 - k / (LEAST(horizon - 1, n - 1) + 1.0)) * g END) AS lrv FROM {name}_g GROUP BY {by}, n),
{name}_a AS (SELECT {by}, COUNT(ic) AS ic_days, COALESCE(AVG(ic), 0.0) AS rank_ic_mean, COALESCE(STDDEV_SAMP(ic), 0.0) AS sd0,
         CAST(SUM(raw_rows) AS BIGINT) AS raw_rows, CAST(SUM(score_rows) AS BIGINT) AS score_rows, CAST(SUM(label_rows) AS BIGINT) AS label_rows,
         CAST(SUM(joint_rows) AS BIGINT) AS joint_rows FROM {source} GROUP BY {by}),
{name}_b AS (SELECT a.*, ic_days > 1 AND sd0 < GREATEST(1e-12, ABS(rank_ic_mean) * 1e-6) AS deg,
         CASE WHEN b.n > 1 AND lrv > 1e-12 AND sqrt(lrv / b.n) > 1e-12 THEN sqrt(lrv / b.n) END AS hac_error
         FROM {name}_a a LEFT JOIN {name}_v b ON {on}),
{name}_c AS (SELECT *, CASE WHEN deg THEN 0.0 ELSE sd0 END AS rank_ic_std FROM {name}_b),
{name} AS (SELECT *, CASE WHEN rank_ic_std > 0 THEN rank_ic_mean / rank_ic_std ELSE 0.0 END AS rank_icir,
         CASE WHEN rank_ic_std > 0 THEN rank_ic_mean / rank_ic_std * sqrt(ic_days) END AS t_stat_naive,
         GREATEST(horizon - 1, 0) AS hac_lag, rank_ic_mean / hac_error AS t_stat_hac,
         COALESCE(score_rows / NULLIF(CAST(raw_rows AS DOUBLE), 0), 0) AS factor_coverage,
         COALESCE(label_rows / NULLIF(CAST(raw_rows AS DOUBLE), 0), 0) AS label_coverage,
         COALESCE(joint_rows / NULLIF(CAST(label_rows AS DOUBLE), 0), 0) AS coverage,
         raw_rows - label_rows AS dropped_boundary_rows,
         concat_ws(',', CASE WHEN horizon > 1 AND ic_days > 1 THEN 'OVERLAPPING_IC_REQUIRES_HAC' END,
           CASE WHEN raw_rows > label_rows THEN 'INCOMPLETE_FORWARD_HORIZON_DROPPED' END, CASE WHEN deg THEN 'DEGENERATE_IC_SERIES' END) AS warning_codes
         FROM {name}_c)"""


def splits_sql(daily: str = "daily", delay: int = 1) -> str:
    return f"""
sd AS (SELECT factor_id, horizon, trade_date, ROW_NUMBER() OVER (PARTITION BY factor_id, horizon ORDER BY trade_date) AS i,
       COUNT(*) OVER (PARTITION BY factor_id, horizon) AS n FROM {daily} WHERE label_rows > 0),
se AS (SELECT *, CAST(round_even(CAST(0.5 AS DOUBLE) * n, 0) AS BIGINT) AS e1, CAST(round_even(CAST(0.8 AS DOUBLE) * n, 0) AS BIGINT) AS e2 FROM sd),
splits AS (SELECT factor_id, horizon, trade_date, CASE WHEN i <= e1 THEN 'IS' WHEN i <= e2 THEN 'OOS1' ELSE 'OOS2' END AS split
       FROM se WHERE i > e2 OR CASE WHEN i <= e1 THEN e1 ELSE e2 END - i >= horizon + {delay}),
sdaily AS (SELECT d.*, split FROM {daily} d JOIN splits USING (factor_id, horizon, trade_date))"""


SPLIT_SUMMARY = summary_sql("sdaily", "factor_id, horizon, split", "ss")
SPLIT_FULL = SPLIT_SUMMARY + """,
sm AS (SELECT ss.*, start_date, end_date, date_count, CASE split WHEN 'IS' THEN 0.5 WHEN 'OOS1' THEN 0.3 ELSE 0.2 END AS score_weight FROM ss
       JOIN (SELECT factor_id, horizon, split, MIN(trade_date) AS start_date, MAX(trade_date) AS end_date, COUNT(*) AS date_count FROM sdaily GROUP BY 1, 2, 3)
       USING (factor_id, horizon, split))"""


def labelled(spark, d, factors=None, horizons=ONE, delay=1):
    df = panel(spark, d)
    return E.label_scored_panel(df, factors or {"MOM": "return_5d"}, horizons, delay)


def daily(spark, d, factors=None, horizons=ONE):
    return E.panel_rank_ic(panel(spark, d), factors or {"MOM": "return_5d"}, horizons, cross(spark, d))


def summary(spark, d, factors=None, horizons=ONE, **kw):
    return E.ic_summary(daily(spark, d, factors, horizons), **kw)


def joined(codes="warning_codes"):
    return F.array_join(codes, ",").alias(codes)


def rounded(*names):
    return [r6(n).alias(n) for n in names]


MOM_SQL = (lab_sql({"MOM": "return_5d"}, ONE), daily_sql())
MANY_SQL = (lab_sql(FACTORS, ALL), daily_sql())

register(
    "v01_forward_return",
    lambda spark, d: panel(spark, d).select("trade_date", "instrument", E.forward_return(5, 2).alias("forward_return")),
    panel_sql(f"SELECT {KEY}, f AS forward_return FROM lab", lab_sql({"MOM": "return_5d"}, ONE, 2)),
)


@query(
    "v02_labelled_join",
    panel_sql(f"SELECT factor_id, horizon, {KEY}, CASE WHEN NOT is_st THEN score END AS score, f AS forward_return FROM lab JOIN (SELECT {KEY}, is_st FROM panel) USING ({KEY})",
              lab_sql({"MOM": "return_5d"}, (5, 10))),
)
def labelled_left(spark, d):
    df = panel(spark, d)
    scores = momentum_scores(df.where("not is_st"))
    return E.labelled_join(E.labels(df, (5, 10)), scores, "MOM")


register(
    "v03_daily_rank_ic",
    lambda spark, d: daily(spark, d).where("ic is not null").select("trade_date", r6("ic").alias("ic"), "joint_rows"),
    panel_sql("SELECT trade_date, ROUND(ic, 6) AS ic, joint_rows FROM daily WHERE ic IS NOT NULL", *MOM_SQL),
)
register(
    "v04_ic_summary",
    lambda spark, d: summary(spark, d, FACTORS).select(
        "factor_id", "ic_days", *rounded("rank_ic_mean", "rank_ic_std", "rank_icir", "t_stat_naive")
    ),
    panel_sql(
        "SELECT factor_id, ic_days, ROUND(rank_ic_mean, 6) AS rank_ic_mean, ROUND(rank_ic_std, 6) AS rank_ic_std, ROUND(rank_icir, 6) AS rank_icir, "
        "ROUND(t_stat_naive, 6) AS t_stat_naive FROM summ",
        lab_sql(FACTORS, ONE), daily_sql(), summary_sql(),
    ),
)
register(
    "v05_hac_standard_error",
    lambda spark, d: summary(spark, d, FACTORS, ALL).select("factor_id", "horizon", "hac_lag", *rounded("hac_error", "t_stat_hac")),
    panel_sql(
        "SELECT factor_id, horizon, hac_lag, ROUND(hac_error, 6) AS hac_error, ROUND(t_stat_hac, 6) AS t_stat_hac FROM summ",
        *MANY_SQL, summary_sql(),
    ),
)
register(
    "v06_hac_t_and_p",
    lambda spark, d: summary(spark, d, FACTORS, ALL, p_values=True).select(
        "factor_id", "horizon", *rounded("t_stat_hac", "p_value_hac")
    ),
    panel_sql(
        "SELECT factor_id, horizon, ROUND(t_stat_hac, 6) AS t_stat_hac, ROUND(t * EXP(-x * x - 1.26551223e0 + t * (1.00002368e0 + t * (0.37409196e0 + "
        "t * (0.09678418e0 + t * (-0.18628806e0 + t * (0.27886807e0 + t * (-1.13520398e0 + t * (1.48851587e0 + t * (-0.82215223e0 + "
        "t * 0.17087277e0))))))))), 6) AS p_value_hac FROM (SELECT *, 1 / (1 + x / 2) AS t FROM (SELECT *, ABS(t_stat_hac) / SQRT(2) AS x FROM summ))",
        *MANY_SQL, summary_sql(),
    ),
)
register(
    "v07_coverage_lineage",
    lambda spark, d: summary(spark, d, FACTORS, ALL).select(
        "factor_id", "horizon", "raw_rows", "score_rows", "label_rows", "joint_rows", *rounded("factor_coverage", "label_coverage", "coverage")
    ),
    panel_sql(
        "SELECT factor_id, horizon, raw_rows, score_rows, label_rows, joint_rows, ROUND(factor_coverage, 6) AS factor_coverage, "
        "ROUND(label_coverage, 6) AS label_coverage, ROUND(coverage, 6) AS coverage FROM summ",
        *MANY_SQL, summary_sql(),
    ),
)
register(
    "v08_boundary_diagnostics_warnings",
    lambda spark, d: summary(spark, d, FACTORS, (1, 5)).select("factor_id", "horizon", "dropped_boundary_rows", joined()),
    panel_sql(
        "SELECT factor_id, horizon, dropped_boundary_rows, warning_codes FROM summ",
        lab_sql(FACTORS, (1, 5)), daily_sql(), summary_sql(),
    ),
)
SUMMARY_COLUMNS = ("rank_ic_mean", "rank_ic_std", "rank_icir", "t_stat_naive", "t_stat_hac", "coverage")
SUMMARY_SHOWN = ", ".join(f"ROUND({c}, 6) AS {c}" for c in SUMMARY_COLUMNS)
register(
    "v09_horizon_matrix",
    lambda spark, d: summary(spark, d, FACTORS, E.unique_horizons(10)).select(
        "factor_id", "horizon", "ic_days", "joint_rows", *rounded(*SUMMARY_COLUMNS), joined()
    ),
    panel_sql(f"SELECT factor_id, horizon, ic_days, joint_rows, {SUMMARY_SHOWN}, warning_codes FROM summ", *MANY_SQL, summary_sql()),
)
register(
    "v10_sample_splits",
    lambda spark, d: E.sample_splits(daily(spark, d, None, (5, 21)), embargo=0).groupBy("horizon", "split").agg(
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count(F.lit(1)).alias("dates")
    ),
    panel_sql(
        "SELECT horizon, CASE WHEN i <= e1 THEN 'IS' WHEN i <= e2 THEN 'OOS1' ELSE 'OOS2' END AS split, MIN(trade_date) AS start_date, "
        "MAX(trade_date) AS end_date, COUNT(*) AS dates FROM se GROUP BY 1, 2",
        lab_sql({"MOM": "return_5d"}, (5, 21)), daily_sql(), splits_sql(),
    ),
)
register(
    "v11_embargo",
    lambda spark, d: E.sample_splits(daily(spark, d, None, (5, 21))).select("horizon", "trade_date", "split"),
    panel_sql("SELECT horizon, trade_date, split FROM splits", lab_sql({"MOM": "return_5d"}, (5, 21)), daily_sql(), splits_sql()),
)
register(
    "v12_split_metrics",
    lambda spark, d: E.split_metrics(daily(spark, d, FACTORS, ALL)).select(
        "factor_id", "horizon", "split", "start_date", "end_date", "date_count", "score_weight", "ic_days", *rounded(*SUMMARY_COLUMNS)
    ),
    panel_sql(
        f"SELECT factor_id, horizon, split, start_date, end_date, date_count, score_weight, ic_days, {SUMMARY_SHOWN} FROM sm",
        *MANY_SQL, splits_sql(), SPLIT_FULL,
    ),
)
register(
    "v13_oos_decay_warning",
    lambda spark, d: E.oos_decay(E.split_metrics(durable(daily(spark, d, FACTORS, ALL)))).select(
        "factor_id", "horizon", "split", *rounded("is_icir", "rank_icir"), "decays"
    ),
    panel_sql(
        "SELECT o.factor_id, o.horizon, o.split, ROUND(i.rank_icir, 6) AS is_icir, ROUND(o.rank_icir, 6) AS rank_icir, ABS(i.rank_icir) >= 1 AND "
        "(ABS(o.rank_icir) < ABS(i.rank_icir) * 0.5 OR o.rank_ic_mean * i.rank_ic_mean < 0) AS decays FROM sm o JOIN sm i ON i.factor_id = o.factor_id "
        "AND i.horizon = o.horizon AND i.split = 'IS' WHERE o.split LIKE 'OOS%'",
        *MANY_SQL, splits_sql(), SPLIT_FULL,
    ),
)
METRIC_SQL = """
m AS (
  SELECT factor_id, horizon, 'rank_ic_t_stat' AS metric, t_stat_hac AS value, 't_stat' AS unit,
         CASE WHEN t_stat_hac IS NOT NULL THEN 'available' ELSE 'insufficient_sample' END AS status, ic_days AS observation_count FROM {src}
  UNION ALL SELECT factor_id, horizon, 'rank_icir', CASE WHEN ic_days > 1 AND rank_ic_std > 0 THEN rank_icir END, 'ratio',
         CASE WHEN ic_days > 1 AND rank_ic_std > 0 THEN 'available' ELSE 'insufficient_sample' END, ic_days FROM {src}
  UNION ALL SELECT factor_id, horizon, 'rank_ic_mean', CASE WHEN ic_days > 0 THEN rank_ic_mean END, 'correlation',
         CASE WHEN ic_days > 0 THEN 'available' ELSE 'insufficient_sample' END, ic_days FROM {src})
"""
# A factor that never has a value shows the unavailable states.
SPARSE = {**FACTORS, "NONE": "CASE WHEN volume < 0 THEN volume END"}


def sparse_daily(spark, d, horizons):
    df = panel(spark, d).withColumn("never", F.when(F.col("volume") < 0, F.col("volume")))
    return E.panel_rank_ic(df, {**FACTORS, "NONE": "never"}, horizons, cross(spark, d))


register(
    "v14_metric_status",
    lambda spark, d: E.metric_rows(E.ic_summary(sparse_daily(spark, d, (5, 10)))).select(
        "factor_id", "horizon", "metric", r6("value").alias("value"), "unit", "status", "observation_count"
    ),
    panel_sql(
        "SELECT factor_id, horizon, metric, ROUND(value, 6) AS value, unit, status, observation_count FROM m",
        lab_sql(SPARSE, (5, 10)), daily_sql(), summary_sql(), METRIC_SQL.format(src="summ"),
    ),
)


@query(
    "v15_evaluate_factor",
    panel_sql(
        f"SELECT factor_id, horizon, 'all' AS split, ic_days, {SUMMARY_SHOWN}, warning_codes FROM summ UNION ALL "
        f"SELECT factor_id, horizon, split, ic_days, {SUMMARY_SHOWN}, warning_codes FROM ss",
        lab_sql({"MOM": "CASE WHEN NOT is_st THEN return_5d END"}, ALL), daily_sql(), summary_sql(), splits_sql(), SPLIT_SUMMARY,
    ),
)
def evaluate_factor(spark, d):
    """Universe mask, labels, ranks, overall and split summaries in one plan."""
    df = C.universe_mask(panel(spark, d).withColumn("score", F.col("return_5d")), ST_FILTER)
    # One row per horizon and date: kept once for the overall and the split summaries.
    day = durable(E.panel_rank_ic(df, {"MOM": "score"}, ALL, cross(spark, d)))
    shown = ("factor_id", "horizon", "split", "ic_days", *rounded(*SUMMARY_COLUMNS), joined())
    return E.ic_summary(day).withColumn("split", F.lit("all")).select(*shown).unionByName(
        E.split_metrics(day).select(*shown)
    )


register(
    "v16_evaluate_many",
    lambda spark, d: E.status_counts(E.metric_rows(E.ic_summary(sparse_daily(spark, d, ALL)))),
    panel_sql(
        "SELECT metric, status, COUNT(*) AS rows FROM m GROUP BY 1, 2",
        lab_sql(SPARSE, ALL), daily_sql(), summary_sql(), METRIC_SQL.format(src="summ"),
    ),
)
register(
    "v17_weighted_split_icir",
    lambda spark, d: E.weighted_split_icir(E.split_metrics(daily(spark, d, FACTORS, ALL))).select(
        "factor_id", "horizon", *rounded("weighted_split_icir")
    ),
    panel_sql(
        "SELECT factor_id, horizon, ROUND(COALESCE(SUM(score_weight * rank_icir) FILTER (WHERE ic_days > 0 AND score_weight > 0) / "
        "SUM(score_weight) FILTER (WHERE ic_days > 0 AND score_weight > 0), 0.0), 6) AS weighted_split_icir FROM sm GROUP BY 1, 2",
        *MANY_SQL, splits_sql(), SPLIT_FULL,
    ),
)

# --- falsification ------------------------------------------------------------------


def frame(spark, d):
    return labelled(spark, d).drop("factor_id", "horizon")


FRAME_SQL = lab_sql({"MOM": "return_5d"}, ONE)
FDAILY = daily_sql("lab", "", "fd")
LAG_SQL = (
    "lags AS (SELECT k AS lag, trade_date, f, CASE k "
    + " ".join(f"WHEN {k} THEN LAG(score, {k}) OVER (PARTITION BY instrument ORDER BY trade_date)" for k in range(1, 6))
    + " END AS score FROM lab, (SELECT UNNEST([1, 2, 3, 4, 5]) AS k))"
).replace("PARTITION BY instrument", "PARTITION BY k, instrument")
LAG_MEAN = "lm AS (SELECT lag, COUNT(ic) AS dates, CASE WHEN COUNT(ic) >= 2 THEN AVG(ic) END AS mean_ic FROM ld GROUP BY 1)"


@query(
    "f01_frame_checks",
    "SELECT CAST(l_shipdate AS DATE) AS trade_date, CAST(l_suppkey AS VARCHAR) AS instrument, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
def frame_checks(spark, d):
    from crosswind.sources.panel import table

    rows = table(spark, d, "lineitem").select(
        F.to_date("l_shipdate").alias("trade_date"), F.col("l_suppkey").cast("string").alias("instrument"),
        F.col("l_quantity").alias("score"), F.col("l_discount").alias("forward_return"),
    )
    return X.frame_checks(rows)


register(
    "f02_daily_rank_samples",
    lambda spark, d: E.daily_rank_ic(frame(spark, d), cross(spark, d), ()).select("trade_date", r6("ic").alias("ic"), "joint_rows"),
    panel_sql("SELECT trade_date, ROUND(ic, 6) AS ic, joint_rows FROM fd", FRAME_SQL, FDAILY),
)
PLACEBO_SQL = """
pr AS (SELECT trade_date, instrument, RANK() OVER (PARTITION BY trade_date ORDER BY score) + (COUNT(*) OVER (PARTITION BY trade_date, score) - 1) / 2.0 AS rs,
              RANK() OVER (PARTITION BY trade_date ORDER BY f) + (COUNT(*) OVER (PARTITION BY trade_date, f) - 1) / 2.0 AS rf
       FROM lab WHERE score IS NOT NULL AND f IS NOT NULL),
ps AS (SELECT *, AVG(rs) OVER t AS ms, AVG(rf) OVER t AS mf, STDDEV_POP(rs) OVER t AS ss, STDDEV_POP(rf) OVER t AS sf, COUNT(*) OVER t AS n
       FROM pr WINDOW t AS (PARTITION BY trade_date)),
pz AS (SELECT trade_date, instrument, (rs - ms) / ss AS zs, (rf - mf) / sf AS zf, n, ROW_NUMBER() OVER (PARTITION BY trade_date ORDER BY instrument) AS place
       FROM ps WHERE ss > 0 AND sf > 0),
ph AS (SELECT perm, trade_date, zf, ROW_NUMBER() OVER (PARTITION BY perm, trade_date ORDER BY md5(concat_ws('|', '7', perm, trade_date, instrument)), instrument) AS place
       FROM pz, (SELECT UNNEST(range(1, 51)) AS perm)),
pm AS (SELECT perm, AVG(ic) AS mean_ic FROM (SELECT perm, trade_date, SUM(pz.zs * ph.zf) / MAX(n) AS ic FROM ph JOIN pz USING (trade_date, place) GROUP BY 1, 2) GROUP BY 1),
rl AS (SELECT AVG(ic) AS real_ic, COUNT(*) AS dates FROM (SELECT SUM(zs * zf) / MAX(n) AS ic FROM pz GROUP BY trade_date)),
pp AS (SELECT SUM(CASE WHEN mean_ic < real_ic THEN 1.0 WHEN mean_ic = real_ic THEN 0.5 ELSE 0.0 END) / COUNT(*) AS percentile, MAX(real_ic) AS real_mean_ic,
              COUNT(*) AS permutations, MAX(dates) AS evaluable_dates FROM pm, rl)"""
register(
    "f03_placebo_percentile",
    lambda spark, d: X.placebo_percentile(frame(spark, d), cross(spark, d), seed=7).select(
        *rounded("percentile", "real_mean_ic"), "permutations", "evaluable_dates"
    ),
    panel_sql(
        "SELECT ROUND(percentile, 6) AS percentile, ROUND(real_mean_ic, 6) AS real_mean_ic, permutations, evaluable_dates FROM pp", FRAME_SQL, PLACEBO_SQL
    ),
)
register(
    "f04_lag_ic",
    lambda spark, d: X.lagged_ic(frame(spark, d), cross(spark, d)).withColumn("mean_ic", r6("mean_ic")),
    panel_sql("SELECT lag, dates, ROUND(mean_ic, 6) AS mean_ic FROM lm", FRAME_SQL, LAG_SQL, daily_sql("lags", "lag", "ld"), LAG_MEAN),
)
register(
    "f05_ic_half_life",
    lambda spark, d: X.half_life(X.lagged_ic(frame(spark, d), cross(spark, d))).select(
        "points", *rounded("decay_rate", "half_life"), "warning"
    ),
    panel_sql(
        "SELECT points, ROUND(CASE WHEN points >= 2 AND s < 0 THEN -s END, 6) AS decay_rate, ROUND(CASE WHEN points >= 2 AND s < 0 THEN LN(2.0) / -s END, 6) AS half_life, "
        "CASE WHEN points < 2 THEN 'INSUFFICIENT_POSITIVE_LAG_ICS' WHEN s >= 0 THEN 'NON_POSITIVE_IC_DECAY' ELSE '' END AS warning FROM "
        "(SELECT COUNT(*) AS points, REGR_SLOPE(LN(mean_ic), lag) AS s FROM lm WHERE mean_ic > 0)",
        FRAME_SQL, LAG_SQL, daily_sql("lags", "lag", "ld"), LAG_MEAN,
    ),
)
BLOCK_SQL = (
    "bl AS (SELECT block, COUNT(*) AS dates, AVG(ic) AS mean_ic, MIN(trade_date) AS start_date, MAX(trade_date) AS end_date FROM "
    "(SELECT *, NTILE(3) OVER (ORDER BY trade_date) AS block FROM fd WHERE ic IS NOT NULL) GROUP BY 1)"
)
register(
    "f06_date_blocks",
    lambda spark, d: X.date_blocks(E.daily_rank_ic(frame(spark, d), cross(spark, d), ())).withColumn("mean_ic", r6("mean_ic")),
    panel_sql("SELECT block, dates, ROUND(mean_ic, 6) AS mean_ic, start_date, end_date FROM bl", FRAME_SQL, FDAILY, BLOCK_SQL),
)
register(
    "f06_block_stability",
    lambda spark, d: X.block_stability(X.date_blocks(E.daily_rank_ic(frame(spark, d), cross(spark, d), ()))).select(
        *rounded("spread", "sign_consistency"), "warning"
    ),
    panel_sql(
        "SELECT ROUND(MAX(mean_ic) - MIN(mean_ic), 6) AS spread, ROUND(ABS(SUM(SIGN(mean_ic))) / 3.0, 6) AS sign_consistency, "
        "CASE WHEN ABS(SUM(SIGN(mean_ic))) / 3.0 < 1 THEN 'WEAK_BLOCK_SIGN_CONSISTENCY' ELSE '' END AS warning FROM bl",
        FRAME_SQL, FDAILY, BLOCK_SQL,
    ),
)
register(
    "f07_floor_report",
    lambda spark, d: X.floor_status(E.daily_rank_ic(frame(spark, d), cross(spark, d), ())).withColumn(
        "real_rank_ic_mean", r6("real_rank_ic_mean")
    ),
    panel_sql(
        "SELECT n AS evaluable_dates, CASE WHEN n >= 30 THEN ROUND(m, 6) END AS real_rank_ic_mean, CASE WHEN n >= 30 THEN 'available' ELSE 'insufficient_sample' END AS status, "
        "CASE WHEN n >= 30 THEN '' ELSE 'BELOW_FALSIFICATION_SAMPLE_FLOOR' END AS warning FROM (SELECT COUNT(ic) AS n, AVG(ic) AS m FROM fd)",
        FRAME_SQL, FDAILY,
    ),
)
register(
    "f08_run_falsification",
    lambda spark, d: X.falsification_report(frame(spark, d), cross(spark, d), seed=7).withColumn("value", r6("value")),
    panel_sql(
        "SELECT metric, segment, CASE WHEN (SELECT COUNT(ic) FROM fd) >= 30 THEN ROUND(value, 6) END AS value, observations FROM ("
        "SELECT 'real_rank_ic_mean' AS metric, '' AS segment, AVG(ic) AS value, COUNT(ic) AS observations FROM fd "
        "UNION ALL SELECT 'placebo_percentile', '', percentile, evaluable_dates FROM pp "
        "UNION ALL SELECT 'lag_ic', 'lag_' || lag, mean_ic, dates FROM lm "
        "UNION ALL SELECT 'ic_half_life', '', CASE WHEN points >= 2 AND s < 0 THEN LN(2.0) / -s END, points FROM hl "
        "UNION ALL SELECT 'ic_decay_rate', '', CASE WHEN points >= 2 AND s < 0 THEN -s END, points FROM hl "
        "UNION ALL SELECT 'block_ic', 'block_' || block, mean_ic, dates FROM bl "
        "UNION ALL SELECT 'block_ic_spread', '', MAX(mean_ic) - MIN(mean_ic), 3 FROM bl "
        "UNION ALL SELECT 'block_sign_consistency', '', ABS(SUM(SIGN(mean_ic))) / 3.0, 3 FROM bl)",
        FRAME_SQL, FDAILY, LAG_SQL, daily_sql("lags", "lag", "ld"), LAG_MEAN, BLOCK_SQL, PLACEBO_SQL,
        "hl AS (SELECT COUNT(*) AS points, REGR_SLOPE(LN(mean_ic), lag) AS s FROM lm WHERE mean_ic > 0)",
    ),
)
