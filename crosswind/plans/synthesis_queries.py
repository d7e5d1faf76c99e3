"""Registered queries: composites, fitted weights, redundancy, coverage, provenance checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswind.operators import backtest as B
from crosswind.operators import evaluate as E
from crosswind.operators import scores as C
from crosswind.operators import synthesis as M
from crosswind.plans.backtest_queries import CORE_SQL, NAV_SQL, RUN_SUMMARY
from crosswind.plans.common import cross, panel
from crosswind.plans.eval_queries import SUMMARY_COLUMNS, SUMMARY_SHOWN, daily_sql, summary_sql
from crosswind.plans.panel_queries import KEY, with_sql
from crosswind.plans.registry import panel_sql, query, r6, register
from crosswind.plans.score_queries import DEFS_SQL, CURRENT_SQL, definitions
from crosswind.session import durable, scratch_path
from crosswind.sources.values import current_definitions

MEMBERS = {"MOM": 1, "VOL": -1, "CAP": 1}
NAMES = list(MEMBERS)
WEIGHTS = {"MOM": 0.5, "VOL": 0.3, "CAP": -0.2}
PLAN = B.Schedule("fit", 5, delay=1)


def member_scores(df):
    """Three members; momentum misses its warm-up, cap is absent for flagged names."""
    cells = F.array(
        F.struct(F.lit("MOM").alias("factor_id"), F.col("return_5d").alias("score")),
        F.struct(F.lit("VOL").alias("factor_id"), F.col("volume").alias("score")),
        F.struct(F.lit("CAP").alias("factor_id"), F.when(~F.col("is_st"), F.col("market_cap")).alias("score")),
    )
    return df.select("trade_date", "instrument", F.inline(cells))


def member_columns(df):
    """The same three members, one row a key."""
    cap = F.when(~F.col("is_st"), F.col("market_cap"))
    return df.select("trade_date", "instrument", F.col("return_5d").alias("MOM"), F.col("volume").alias("VOL"), cap.alias("CAP"))


SCORES_SQL = """
ms0 AS (SELECT 'MOM' AS factor_id, trade_date, instrument, return_5d AS score FROM panel UNION ALL
        SELECT 'VOL', trade_date, instrument, volume FROM panel UNION ALL
        SELECT 'CAP', trade_date, instrument, CASE WHEN NOT is_st THEN market_cap END FROM panel)"""


def standard_sql(how: str) -> str:
    w = "OVER (PARTITION BY factor_id, trade_date)"
    flat = f"MIN(score) {w} = MAX(score) {w}"
    if how == "zscore":
        z = f"(score - AVG(score) {w}) / STDDEV_SAMP(score) {w}"
    else:
        z = f"2.0 * (ROW_NUMBER() OVER (PARTITION BY factor_id, trade_date ORDER BY score NULLS LAST, instrument) / CAST(COUNT(score) {w} AS DOUBLE)) - 1.0"
    return (
        f"st AS (SELECT *, COALESCE({flat}, FALSE) AND score IS NOT NULL AS degenerate, CASE WHEN score IS NOT NULL THEN CASE WHEN {flat} THEN 0.0 ELSE {z} END END AS z FROM ms0),\n"
        "dir AS (SELECT *, z * CASE factor_id WHEN 'VOL' THEN -1 ELSE 1 END AS t FROM st)"
    )


def composite_sql(weight: str, minimum: int, name: str = "comp", source: str = "dir") -> str:
    return (
        f"{name}0 AS (SELECT trade_date, instrument, CASE WHEN COUNT(t) >= {minimum} THEN SUM({weight} * t) END AS score FROM {source} GROUP BY 1, 2),\n"
        f"{name} AS (SELECT trade_date, instrument, CASE WHEN MIN(score) OVER d < MAX(score) OVER d THEN score END AS score, "
        f"COALESCE(MIN(score) OVER d = MAX(score) OVER d, TRUE) AS degenerate FROM {name}0 WINDOW d AS (PARTITION BY trade_date))"
    )


def directed(spark, d, how="rank", df=None):
    df = panel(spark, d) if df is None else df
    return M.directed_scores(member_scores(df), MEMBERS, how, cross(spark, d))


def combined_apriori(spark, d, weights, minimum=None, df=None):
    df = panel(spark, d) if df is None else df
    return M.composite(member_columns(df), MEMBERS, "zscore", cross(spark, d), weights, minimum)


register(
    "m01_build_matrix",
    lambda spark, d: M.score_matrix(member_scores(panel(spark, d)).where("not (factor_id = 'MOM' and score is null)"), NAMES),
    panel_sql("SELECT factor_id, trade_date, instrument, score FROM ms0", SCORES_SQL),
)
register(
    "m02_standardize_zscore",
    lambda spark, d: directed(spark, d, "zscore").select("factor_id", "trade_date", "instrument", r6("z").alias("z")),
    panel_sql("SELECT factor_id, trade_date, instrument, ROUND(z, 6) AS z FROM st", SCORES_SQL, standard_sql("zscore")),
)
register(
    "m03_standardize_rank",
    lambda spark, d: directed(spark, d).select("factor_id", "trade_date", "instrument", r6("z").alias("z")),
    panel_sql("SELECT factor_id, trade_date, instrument, ROUND(z, 6) AS z FROM st", SCORES_SQL, standard_sql("rank")),
)
register(
    "m04_apply_directions",
    lambda spark, d: directed(spark, d).select("factor_id", "trade_date", "instrument", r6("t").alias("t")),
    panel_sql("SELECT factor_id, trade_date, instrument, ROUND(t, 6) AS t FROM dir", SCORES_SQL, standard_sql("rank")),
)
register(
    "m05_coverage_rule",
    lambda spark, d: M.coverage_report(directed(spark, d), 3, 2).withColumn("coverage_ratio", r6("coverage_ratio")),
    panel_sql(
        "SELECT factor_id, COUNT(t) AS rows_scored, COUNT(t) FILTER (WHERE n >= 2) AS rows_in_composite, ROUND(COUNT(t) FILTER (WHERE n >= 2) / CAST(COUNT(t) AS DOUBLE), 6) AS coverage_ratio "
        "FROM (SELECT *, COUNT(t) OVER (PARTITION BY trade_date, instrument) AS n FROM dir) GROUP BY 1",
        SCORES_SQL, standard_sql("rank"),
    ),
)
register(
    "m05_coverage_totals",
    lambda spark, d: M.coverage_totals(directed(spark, d), 3),
    panel_sql(
        "SELECT COUNT(*) AS rows_required, COUNT(*) FILTER (WHERE n = 3) AS rows_full_coverage FROM (SELECT COUNT(t) AS n FROM dir GROUP BY trade_date, instrument)",
        SCORES_SQL, standard_sql("rank"),
    ),
)
register(
    "m06_combine_equal",
    lambda spark, d: combined_apriori(spark, d, M.apriori_weights(NAMES)).select("trade_date", "instrument", r6("score").alias("score")),
    panel_sql(f"SELECT {KEY}, ROUND(score, 6) AS score FROM comp", SCORES_SQL, standard_sql("zscore"), composite_sql("(1.0 / CAST(3 AS DOUBLE))", 3)),
)
WEIGHT_SQL = "CASE factor_id WHEN 'MOM' THEN CAST(0.5 AS DOUBLE) WHEN 'VOL' THEN CAST(0.3 AS DOUBLE) ELSE CAST(-0.2 AS DOUBLE) END"
register(
    "m07_combine_weighted",
    lambda spark, d: combined_apriori(spark, d, M.apriori_weights(NAMES, WEIGHTS), 2).select("trade_date", "instrument", r6("score").alias("score")),
    panel_sql(f"SELECT {KEY}, ROUND(score, 6) AS score FROM comp", SCORES_SQL, standard_sql("zscore"), composite_sql(WEIGHT_SQL, 2)),
)


@query(
    "m08_mask_degenerate_dates",
    panel_sql(
        f"SELECT {KEY}, CASE WHEN MIN(s) OVER d < MAX(s) OVER d THEN s END AS score, COALESCE(MIN(s) OVER d = MAX(s) OVER d, TRUE) AS degenerate FROM "
        f"(SELECT {KEY}, CASE WHEN month(trade_date) = 3 THEN 1.0 WHEN month(trade_date) <> 4 THEN volume END AS s FROM panel) WINDOW d AS (PARTITION BY trade_date)"
    ),
)
def mask(spark, d):
    month = F.month("trade_date")
    df = panel(spark, d).select("trade_date", "instrument", F.when(month == 3, 1.0).when(month != 4, F.col("volume")).alias("score"))
    return M.mask_degenerate(df, cross(spark, d))


SWEEP_SQL = (
    """
cal AS (SELECT trade_date, CAST(ROW_NUMBER() OVER (ORDER BY trade_date) - 1 AS INTEGER) AS idx, CAST(COUNT(*) OVER () AS INTEGER) AS n
        FROM (SELECT DISTINCT trade_date FROM panel)),
gd AS (SELECT idx AS signal_idx, trade_date AS signal_date, n, idx + 6 < n AS closed FROM cal WHERE idx % 5 = 0 AND idx < n - 2),
pc AS (SELECT instrument, idx, close FROM panel JOIN cal USING (trade_date)),
fr AS (SELECT signal_idx, e.instrument, COALESCE((SELECT arg_max(q.close, q.idx) FROM pc q WHERE q.instrument = e.instrument AND q.idx > e.idx AND q.idx <= e.idx + 5), e.close) / e.close - 1 AS f
       FROM gd JOIN pc e ON e.idx = signal_idx + 1 WHERE closed),
swin AS (SELECT factor_id, signal_idx, signal_date AS trade_date, dir.instrument, t AS score, f FROM gd JOIN dir ON dir.trade_date = signal_date JOIN fr USING (signal_idx, instrument) WHERE t IS NOT NULL),"""
    + daily_sql("swin", "factor_id, signal_idx", "sweep")
)


def fitted_sql(method: str) -> str:
    raw = "mean_ic" if method == "ic_weighted" else "CASE WHEN sd > ABS(mean_ic) * 1e-12 THEN mean_ic / sd END"
    return f"""
fm AS (SELECT UNNEST(['MOM', 'VOL', 'CAP']) AS factor_id),
elig AS (SELECT factor_id, a.signal_idx, (SELECT COUNT(*) FROM gd b WHERE b.closed AND b.signal_idx + 6 <= a.signal_idx) AS eligible_periods,
         (SELECT AVG(ic) FROM sweep s WHERE s.factor_id = fm.factor_id AND s.signal_idx + 6 <= a.signal_idx) AS mean_ic,
         (SELECT STDDEV_POP(ic) FROM sweep s WHERE s.factor_id = fm.factor_id AND s.signal_idx + 6 <= a.signal_idx) AS sd FROM gd a CROSS JOIN fm),
rw AS (SELECT *, GREATEST(COALESCE({raw}, 0), 0) AS raw FROM elig),
fl AS (SELECT *, SUM(raw) OVER (PARTITION BY signal_idx) AS total FROM rw),
fw AS (SELECT factor_id, signal_idx, eligible_periods, CASE WHEN eligible_periods < 6 THEN 'WARM_UP_IC_UNFITTED' WHEN total <= 0 THEN 'IC_DEGENERATE_EQUAL_WEIGHT' END AS flag,
       CASE WHEN eligible_periods < 6 OR total <= 0 THEN 1.0 / CAST(3 AS DOUBLE) ELSE raw / total END AS weight FROM fl),
dw AS (SELECT factor_id, cal.trade_date, arg_max(weight, signal_idx) AS weight FROM cal JOIN fw ON signal_idx <= cal.idx GROUP BY 1, 2),
fdir AS (SELECT dir.factor_id, dir.trade_date, instrument, CASE WHEN weight IS NOT NULL THEN t END AS t, weight FROM dir LEFT JOIN dw ON dw.factor_id = dir.factor_id AND dw.trade_date = dir.trade_date)"""


RANKED = (SCORES_SQL, standard_sql("rank"), SWEEP_SQL)


def stored_panel(spark, d):
    return durable(panel(spark, d).select("trade_date", "instrument", "close", "volume", "return_5d", "market_cap", "is_st"))


def sweep(spark, d, df=None):
    """The sweep is read by several consumers, so it is kept once."""
    df = stored_panel(spark, d) if df is None else df
    cal = durable(B.calendar(df))
    xs = cross(spark, d)
    on_grid = M.directed_scores(M.signal_rows(member_scores(df), cal, PLAN), MEMBERS, "rank", xs)
    return M.period_ic_sweep(on_grid, df, cal, PLAN, xs), cal, directed(spark, d, "rank", df)


def fitted(spark, d, method="ic_weighted", df=None):
    s, cal, dirs = sweep(spark, d, df)
    return M.fitted_weights(durable(s), cal, NAMES, PLAN, method), cal, dirs


register(
    "m09_period_ic_sweep",
    lambda spark, d: sweep(spark, d)[0].withColumn("ic", r6("ic")),
    panel_sql("SELECT factor_id, signal_idx, ROUND(ic, 6) AS ic FROM sweep", *RANKED),
)
for _name, _method in (("m10_ic_weights", "ic_weighted"), ("m11_icir_weights", "icir_weighted")):
    register(
        _name,
        (lambda method: lambda spark, d: fitted(spark, d, method)[0].withColumn("weight", r6("weight")))(_method),
        panel_sql("SELECT factor_id, signal_idx, eligible_periods, ROUND(weight, 6) AS weight, flag FROM fw", *RANKED, fitted_sql(_method)),
    )


@query("m12_weights_as_of", panel_sql("SELECT factor_id, trade_date, ROUND(weight, 6) AS weight FROM dw", *RANKED, fitted_sql("ic_weighted")))
def as_of(spark, d):
    w, cal, _ = fitted(spark, d)
    return M.weights_as_of(w, cal, NAMES).withColumn("weight", r6("weight"))


@query(
    "m13_combine_fitted",
    panel_sql(f"SELECT {KEY}, ROUND(score, 6) AS score FROM comp", *RANKED, fitted_sql("ic_weighted"), composite_sql("weight", 2, source="fdir")),
)
def combined(spark, d):
    df = stored_panel(spark, d)
    w, cal, _ = fitted(spark, d, df=df)
    out = M.composite(member_columns(df), MEMBERS, "rank", cross(spark, d), M.weights_as_of(w, cal, NAMES), 2)
    return out.select("trade_date", "instrument", r6("score").alias("score"))


@query(
    "m13_fitted_summary",
    panel_sql(
        "SELECT COUNT(*) FILTER (WHERE flag IS NULL) AS fitted_periods, COUNT(*) FILTER (WHERE flag LIKE 'WARM%') AS warm_up_periods, COUNT(*) FILTER (WHERE flag LIKE 'IC_D%') AS fallback_periods, "
        "ROUND(COUNT(*) FILTER (WHERE flag IS NULL) / CAST(COUNT(*) AS DOUBLE), 6) AS fitted_fraction, MAX(signal_idx) FILTER (WHERE flag IS NULL) AS latest_fitted_idx, "
        "COUNT(*) FILTER (WHERE flag IS NULL) > 0 AS is_fitted FROM (SELECT DISTINCT signal_idx, flag FROM fw)",
        *RANKED, fitted_sql("ic_weighted"),
    ),
)
def summary(spark, d):
    return M.fitted_summary(fitted(spark, d)[0]).withColumn("fitted_fraction", r6("fitted_fraction"))


register(
    "m14_redundancy_matrix",
    lambda spark, d: M.redundancy_matrix(sweep(spark, d)[0], NAMES).withColumn("correlation", r6("correlation")),
    panel_sql(
        "SELECT a.factor_id, b.factor_id AS other_id, COUNT(*) AS common_periods, ROUND(CASE WHEN COUNT(*) >= 2 AND MIN(a.ic) < MAX(a.ic) AND MIN(b.ic) < MAX(b.ic) "
        "THEN COVAR_POP(a.ic, b.ic) / (STDDEV_POP(a.ic) * STDDEV_POP(b.ic)) END, 6) AS correlation FROM sweep a JOIN sweep b USING (signal_idx) "
        "WHERE a.ic IS NOT NULL AND b.ic IS NOT NULL GROUP BY 1, 2",
        *RANKED,
    ),
)


@query(
    "m15_prescan_coverage",
    panel_sql(
        "SELECT signal_idx, signal_date AS trade_date, COUNT(score) AS finite_count, CASE WHEN COUNT(score) = 0 THEN 'empty' WHEN COUNT(score) < 5 THEN 'thin' ELSE 'ok' END AS status "
        "FROM gd LEFT JOIN (SELECT trade_date, CASE WHEN year(trade_date) = 1999 THEN NULL WHEN year(trade_date) = 2000 AND instrument > 'S000000000002' THEN NULL ELSE return_5d END AS score FROM panel) c "
        "ON c.trade_date = signal_date WHERE closed GROUP BY 1, 2",
        *RANKED,
    ),
)
def prescan(spark, d):
    df, year = panel(spark, d), F.year("trade_date")
    thin = (year == 2000) & (F.col("instrument") > "S000000000002")
    scored = df.select("trade_date", "instrument", F.when((year != 1999) & ~thin, F.col("return_5d")).alias("score"))
    return M.prescan_coverage(scored, B.calendar(df), PLAN)


register(
    "m16_window_guard",
    lambda spark, d: M.window_guard(B.calendar(panel(spark, d)), 1, 63),
    panel_sql(
        "SELECT COUNT(DISTINCT trade_date) AS dates, GREATEST(0, CAST(FLOOR((COUNT(DISTINCT trade_date) - 1 - 1 - 63) / 63.0) AS BIGINT) + 1) AS periods, "
        "GREATEST(0, CAST(FLOOR((COUNT(DISTINCT trade_date) - 1 - 1 - 63) / 63.0) AS BIGINT) + 1) >= 2 AS ok FROM panel"
    ),
)


@query(
    "m17_resolve_universe",
    with_sql(
        "SELECT factor_id AS composite_id, COUNT(DISTINCT u) AS declared, CASE WHEN COUNT(DISTINCT u) <= 1 THEN COALESCE(MAX(u), '') END AS universe, "
        "CASE WHEN COUNT(DISTINCT u) > 1 THEN 'UNIVERSE_MISMATCH' ELSE '' END AS problem FROM (SELECT factor_id, CASE WHEN filters <> '' THEN filters END AS u FROM defs) GROUP BY 1",
        DEFS_SQL,
    ),
)
def universe(spark, d):
    members = definitions(spark, d).select(F.col("factor_id").alias("composite_id"), F.col("seq").alias("factor_id"), F.array("filters").alias("filters"))
    return M.resolve_universe(members)


def composite_run(spark, d):
    """Equal z-score composite, stored and read back, traded on the ten-row schedule."""
    df = stored_panel(spark, d)
    xs = cross(spark, d)
    comp = combined_apriori(spark, d, M.apriori_weights(NAMES), df=df)
    cid = M.composite_id(list(MEMBERS.items()), "equal", "zscore", 10)
    stored = M.materialize(spark, comp, cid, scratch_path(spark, "composite"))
    plan = B.Schedule("ten", 10)
    run = B.Run("COMPOSITE", cid, "ten", 0.3, 5, 5.0, 5.0, 50.0)
    small = df.select("trade_date", "instrument", "close")
    return B.Backtest(small, stored, B.schedules_table(spark, [plan]), B.runs_table(spark, [run]), xs, True), stored, df


COMPOSITE_RUN = (
    SCORES_SQL,
    standard_sql("zscore"),
    composite_sql("(1.0 / CAST(3 AS DOUBLE))", 3),
    """
cal AS (SELECT trade_date, CAST(ROW_NUMBER() OVER (ORDER BY trade_date) - 1 AS INTEGER) AS idx, CAST(COUNT(*) OVER () AS INTEGER) AS n
        FROM (SELECT DISTINCT trade_date FROM panel)),
sc AS (SELECT 'COMPOSITE' AS factor_id, trade_date, instrument, score FROM comp),
runs AS (SELECT 'COMPOSITE' AS run_id, 'COMPOSITE' AS factor_id, 0 AS start_idx, 10 AS holding, 1 AS delay, CAST(0.3 AS DOUBLE) AS q, 5 AS g, FALSE AS partial, 5.0 AS comm, 5.0 AS slip, 50.0 AS borrow)""",
    CORE_SQL,
)


@query(
    "m18_composite_id",
    with_sql(
        "SELECT seq, 'COMPOSITE_' || upper(substr(sha256('{\"backtest_end\":null,\"backtest_start\":null,\"coverage_rule\":\"all_factors\",\"decay_days\":0,\"execution_delay_days\":1,\"factor_refs\":[[\"' "
        "|| factor_id || '\",1],[\"MOM\",-1]],\"holding_days\":' || CAST(horizon AS VARCHAR) || ',\"method\":\"equal\",\"method_params\":{},\"min_factor_coverage\":null,\"standardization\":\"zscore\",\"top_quantile\":0.3,\"universe_filters\":[]}'), 1, 12)) AS composite_id FROM defs",
        DEFS_SQL,
    ),
)
def composite_ids(spark, d):
    """Ids of the pairs each definition would form with the momentum member."""
    return definitions(spark, d).select("seq", M.composite_id_column([(F.col("factor_id"), 1), (F.lit("MOM"), -1)], "equal", "zscore", F.col("horizon")).alias("composite_id"))


@query(
    "m19_materialize_composite",
    panel_sql(
        "SELECT periods, exposure_days, ROUND(gross_cumulative, 6) AS gross_cumulative, ROUND(net_cumulative, 6) AS net_cumulative, ROUND(gross_sharpe, 6) AS gross_sharpe, "
        "ROUND(max_drawdown, 6) AS max_drawdown FROM rs JOIN dd USING (run_id)",
        *COMPOSITE_RUN, NAV_SQL, RUN_SUMMARY,
    ),
)
def materialized(spark, d):
    m = composite_run(spark, d)[0].metrics
    return m.select("periods", "exposure_days", *[r6(c).alias(c) for c in ("gross_cumulative", "net_cumulative", "gross_sharpe", "max_drawdown")])


@query(
    "m20_grid_fidelity",
    panel_sql(
        "SELECT COUNT(*) AS matched, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unexpected, TRUE AS ok FROM grid", *COMPOSITE_RUN
    ),
)
def fidelity(spark, d):
    b = composite_run(spark, d)[0]
    return M.grid_fidelity(b.slots, B.schedule(b.calendar, b.schedules))


@query(
    "m21_same_window_evaluation",
    panel_sql(
        f"SELECT factor_id, horizon, ic_days, {SUMMARY_SHOWN}, (SELECT COUNT(DISTINCT trade_date) FROM panel) >= 126 AS window_ok FROM summ",
        SCORES_SQL, standard_sql("zscore"), composite_sql("(1.0 / CAST(3 AS DOUBLE))", 3),
        "lab AS (SELECT 'COMPOSITE' AS factor_id, 5 AS horizon, trade_date, instrument, c.score, LEAD(close, 6) OVER w / LEAD(close, 1) OVER w - 1 AS f FROM panel LEFT JOIN comp c "
        "USING (trade_date, instrument) WINDOW w AS (PARTITION BY instrument ORDER BY trade_date))",
        daily_sql(), summary_sql(),
    ),
)
def same_window(spark, d):
    _, stored, df = composite_run(spark, d)
    lab = E.labelled_join(E.labels(df, (5,)), stored, "COMPOSITE")
    ok = C.min_window_guard(df).select(F.col("ok").alias("window_ok"), F.lit("COMPOSITE").alias("factor_id"))
    out = E.ic_summary(E.daily_rank_ic(lab, cross(spark, d))).join(ok, "factor_id")
    return out.select("factor_id", "horizon", "ic_days", *[r6(c).alias(c) for c in SUMMARY_COLUMNS], "window_ok")


@query(
    "m22_formula_drift",
    with_sql(
        "SELECT p.factor_id, p.formula AS pinned_formula, cur.formula AS registry_formula FROM (SELECT factor_id, arg_min(formula, seq) AS formula FROM defs GROUP BY 1) p "
        "JOIN cur USING (factor_id) WHERE p.formula <> cur.formula",
        DEFS_SQL, CURRENT_SQL,
    ),
)
def drift(spark, d):
    defs = definitions(spark, d)
    pinned = defs.groupBy("factor_id").agg(F.min_by("formula", "seq").alias("formula"))
    return M.formula_drift(pinned, current_definitions(defs))
