"""Small data sets with known answers: alignment, delisting, splits, costs, degeneracy, annualisation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosswind.operators import backtest as B
from crosswind.operators import evaluate as E
from crosswind.operators import falsify as X
from crosswind.operators import ledgers as L
from crosswind.operators.cross_section import CrossSection

D0 = dt.date(2024, 1, 1)
XS = CrossSection()


def grid_panel(spark, names, days, close):
    rows = [(D0 + dt.timedelta(days=t), f"N{i}", float(close(i, t))) for i in range(names) for t in range(days)]
    return spark.createDataFrame(rows, "trade_date date, instrument string, close double")


def test_alignment_canary(spark):
    """A score equal to the future return has IC 1, its negative has IC -1."""
    df = grid_panel(spark, 8, 40, lambda i, t: 100 * (1 + 0.001 * (i + 1)) ** t)
    df = df.withColumn("good", E.forward_return(5)).withColumn("bad", -F.col("good"))
    s = {r.factor_id: r for r in E.ic_summary(E.daily_rank_ic(E.label_scored_panel(df, {"G": "good", "B": "bad"}, (5,)), XS)).collect()}
    assert abs(s["G"].rank_ic_mean - 1) < 1e-12 and abs(s["B"].rank_ic_mean + 1) < 1e-12
    # A constant IC series has no spread, so no ratio.
    assert s["G"].rank_ic_std == 0 and s["G"].rank_icir == 0 and "DEGENERATE_IC_SERIES" in s["G"].warning_codes


def test_forward_return_delays(spark):
    df = grid_panel(spark, 1, 8, lambda i, t: 10 + t)
    first = lambda h, d: df.select("trade_date", E.forward_return(h, d).alias("f")).orderBy("trade_date").first().f
    assert abs(first(5, 1) - (16 / 11 - 1)) < 1e-12 and abs(first(3, 3) - (16 / 13 - 1)) < 1e-12


def test_hac_error_by_hand(spark):
    daily = spark.createDataFrame(
        [("F", 2, D0 + dt.timedelta(days=i), v, 4, 4, 4, 4) for i, v in enumerate([0.1, 0.3, 0.2, 0.4])],
        "factor_id string, horizon int, trade_date date, ic double, joint_rows long, raw_rows long, score_rows long, label_rows long",
    )
    c = [-0.15, 0.05, -0.05, 0.15]
    gamma0, gamma1 = sum(x * x for x in c) / 4, sum(a * b for a, b in zip(c[1:], c, strict=False)) / 4
    want = ((gamma0 + 2 * 0.5 * gamma1) / 4) ** 0.5
    assert abs(E.ic_summary(daily).first().hac_error - want) < 1e-12


def test_delisted_name_keeps_its_loss(spark):
    rows = [(D0 + dt.timedelta(days=t), n, c) for n, cs in (("A", [10, 10, 12]), ("B", [10, 6, None]), ("C", [10, 10, 10])) for t, c in enumerate(cs) if c is not None]
    df = spark.createDataFrame([(d, n, float(c)) for d, n, c in rows], "trade_date date, instrument string, close double")
    cal = B.calendar(df)
    period = spark.createDataFrame([("s", 0, 0, 2)], "schedule_id string, signal_idx int, entry_idx int, exit_idx int")
    got = {r.instrument: r for r in B.period_returns(df, cal, period).collect()}
    assert abs(got["B"].period_return + 0.4) < 1e-12 and got["B"].lost and not got["A"].lost and abs(got["A"].period_return - 0.2) < 1e-12


def run_one(spark, df, score, holding=3, **run):
    plan = B.Schedule("s", holding)
    scores = df.select("trade_date", "instrument", score.alias("score")).withColumn("factor_id", F.lit("F"))
    return B.Backtest(df, scores, B.schedules_table(spark, [plan]), B.runs_table(spark, [B.Run("r", "F", "s", **run)]), XS, True)


def test_costs_and_ledger_reconcile(spark):
    df = grid_panel(spark, 8, 32, lambda i, t: 50 + i + (i - 3.5) * t * 0.1 + ((i * 7 + t * 3) % 5) * 0.3)
    b = run_one(spark, df, F.pmod(F.hash("instrument", "trade_date"), F.lit(100)).cast("double"), commission_bps=10.0, slippage_bps=5.0)
    p = b.period_table.orderBy("period_id").collect()
    assert abs(p[0].turnover_rate - 1.0) < 1e-12 and p[0].rebalance_rate is None
    for r in p:
        assert abs(r.cost - r.traded_notional * 0.0015) < 1e-12 and abs(r.net_return - (r.gross_return - r.cost)) < 1e-12
    m = b.metrics.first()
    wealth = 1.0
    for r in p:
        wealth *= 1 + r.net_return
    assert abs(m.net_cumulative - (wealth - 1)) < 1e-12
    last = b.ledger.orderBy(F.col("day_no").desc()).first()
    assert abs(last.net_nav - wealth) < 1e-9


def test_segment_boundary_purges_overlapping_periods(spark):
    df = grid_panel(spark, 8, 40, lambda i, t: 50 + i + (i - 3.5) * t * 0.1)
    b = run_one(spark, df, F.col("close"))
    seg = {r.split: r for r in b.segments().collect()}
    assert sum(r.periods + r.purged for r in seg.values()) == b.period_table.count() and seg["OOS2"].purged == 0
    assert seg["IS"].purged == 1  # its last exit falls after the next segment's first signal


@pytest.mark.parametrize("days, reported", [(125, False), (126, True)])
def test_annualisation_needs_126_days(spark, days, reported):
    row = spark.range(1).select(B.reportable_annual(F.lit(0.1), F.lit(days)).alias("v"), B.reportable_annual(F.lit(-1.2), F.lit(3)).alias("lost")).first()
    assert (row.v is not None) == reported and row.lost == -1.0


def test_planted_signal_beats_its_placebo(spark):
    rows = [(D0 + dt.timedelta(days=t), f"N{i}", float((i * 37 + t * 11) % 25), float((i * 37 + t * 11) % 25) + ((i * 13 + t * 7) % 10)) for i in range(25) for t in range(40)]
    frame = spark.createDataFrame(rows, "trade_date date, instrument string, score double, forward_return double")
    r = X.placebo_percentile(frame, XS, seed=3, permutations=20).first()
    assert r.percentile == 1.0 and r.permutations == 20 and r.evaluable_dates == 40
    again = X.placebo_percentile(frame, CrossSection(wide=True), seed=3, permutations=20).first()
    assert abs(again.real_mean_ic - r.real_mean_ic) < 1e-12 and again.percentile == r.percentile


def test_promotion_counts_runs_once(spark):
    obs = [("s", f"r{k % 3}", D0 + dt.timedelta(days=k), f"w{k % 2}", "gate_blocked", f"e{k}", "x", "global") for k in range(9)]
    cols = "signature string, run_id string, observed_at date, data_window string, failure_class string, evidence_ref string, statement string, scope string"
    got = {r.kind: r for r in L.promote(spark.createDataFrame(obs, cols)).collect()}
    assert set(got) == {"rule", "failure"} and got["rule"].observation_count == 3 and got["rule"].windows == 2


def test_ancestors_of_a_long_chain(spark):
    edges = spark.range(1, 41).select(F.col("id").alias("artifact_id"), (F.col("id") - 1).alias("parent"))
    got = L.ancestors(edges)
    assert got.count() == 40 * 41 // 2 and got.where("artifact_id - ancestor <> depth").count() == 0
