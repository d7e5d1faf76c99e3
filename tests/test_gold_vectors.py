"""Single operators against hand-computed values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from crosswind.functions import signals as S
from crosswind.functions import text as T
from crosswind.operators import candidates as R
from crosswind.operators import evaluate as E
from crosswind.operators import scores as C
from crosswind.operators.cross_section import CrossSection
from crosswind.sources import panel as P


def series(spark, values, name="A"):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), name, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "trade_date date, instrument string, close double")


def section(spark, values, groups=None, other=None):
    groups = groups or [None] * len(values)
    other = other or [None] * len(values)
    rows = [(dt.date(2024, 1, 1), f"N{i:03d}", v, g, o) for i, (v, g, o) in enumerate(zip(values, groups, other, strict=True))]
    return spark.createDataFrame(rows, "trade_date date, instrument string, close double, grp string, x double")


def over_time(df, signal):
    return [r[0] for r in df.orderBy("trade_date").select("trade_date", signal.col.alias("v")).orderBy("trade_date").select("v").collect()]


def across(df, out="v"):
    return [r[0] for r in df.orderBy("instrument").select(out).collect()]


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (w is None or math.isclose(g, w, abs_tol=1e-12)), (got, want)


def test_rows_since_extremes_take_the_latest_tie(spark):
    df = series(spark, [1.0, 3.0, 3.0, 2.0, 1.0, 1.0])
    near(over_time(df, S.ts_argmax("close", 3)), [None, None, 0.0, 1.0, 2.0, 2.0])
    near(over_time(df, S.ts_argmin("close", 3)), [None, None, 2.0, 0.0, 0.0, 0.0])


def test_rolling_operators_need_full_windows(spark):
    df = series(spark, [1.0, None, 3.0, 4.0, 5.0])
    near(over_time(df, S.ts_mean("close", 2)), [None, None, None, 3.5, 4.5])
    near(over_time(df, S.ts_sum("close", 3)), [None, None, None, None, 12.0])
    near(over_time(df, S.decay_linear("close", 2)), [None, None, None, (3 + 8) / 3, (4 + 10) / 3])


def test_ts_rank_counts_only_present_values(spark):
    df = series(spark, [2.0, None, 2.0, 1.0])
    near(over_time(df, S.ts_rank("close", 3)), [None, None, 0.75, 0.5])


def test_correlation_of_a_constant_window_is_missing(spark):
    df = series(spark, [1.0, 1.0, 1.0, 2.0, 4.0])
    near(over_time(df, S.correlation("close", S.field("close") * 2, 3)), [None, None, None, 1.0, 1.0])


def test_division_by_zero_and_log_of_non_positive_are_missing(spark):
    df = series(spark, [0.0, 2.0])
    near(over_time(df, S.const(1.0) / S.field("close")), [None, 0.5])
    near(over_time(df, S.log("close")), [None, math.log(2.0)])


def test_lookback_composes(spark):
    assert S.ts_mean("close", 60).lookback == 59
    assert (S.ts_mean(S.delta("close", 10), 10) - S.delay("close", 3)).lookback == 19
    with pytest.raises(ValueError):
        S.ts_mean("close", 751)


@pytest.mark.parametrize("wide", [False, True])
class TestCrossSection:
    def test_rank_shares_ties(self, spark, wide):
        out = CrossSection(wide=wide).rank(section(spark, [1.0, 2.0, 2.0, None, 4.0]), "close", "v")
        near(across(out), [0.25, 0.625, 0.625, None, 1.0])

    def test_winsorize_interpolates(self, spark, wide):
        out = CrossSection(wide=wide).winsorize(section(spark, [0.0, 1.0, 2.0, 3.0, 100.0]), "close", 0.1, "v")
        near(across(out), [0.4, 1.0, 2.0, 3.0, 61.2])

    def test_ntile_keeps_ties_together(self, spark, wide):
        out = CrossSection(wide=wide).ntile(section(spark, [1.0, 1.0, 1.0, 4.0]), "close", 2, "v")
        near(across(out), [1.0, 1.0, 1.0, 2.0])

    def test_group_neutralize(self, spark, wide):
        df = section(spark, [1.0, 3.0, 5.0, 7.0, None], ["a", "a", "b", None, "a"])
        near(across(CrossSection(wide=wide).group_neutralize(df, "close", "grp", "v")), [-1.0, 1.0, 0.0, None, None])

    def test_residualize_removes_the_line(self, spark, wide):
        df = section(spark, [3.0, 5.0, 7.0, 1.0], other=[1.0, 2.0, 3.0, None])
        near(across(CrossSection(wide=wide).residualize(df, "close", "x", "v")), [0.0, 0.0, 0.0, None])

    def test_zscore_of_a_constant_is_missing(self, spark, wide):
        near(across(CrossSection(wide=wide).zscore(section(spark, [2.0, 2.0]), "close", "v")), [None, None])


def test_ewm_ages_over_gaps(spark):
    df = series(spark, [1.0, None, 3.0]).withColumnRenamed("close", "score")
    got = [r.score for r in C.ewm_decay(df, 3).orderBy("trade_date").collect()]
    near(got, [1.0, None, (0.25 * 1.0 + 0.5 * 3.0) / 0.75])


def test_universe_is_masked_after_ranking(spark):
    df = section(spark, [1.0, 2.0, 3.0]).withColumn("is_st", F.col("instrument") == "N001")
    ranked = CrossSection().rank(df, "close", "score")
    near(across(C.universe_mask(ranked, ("is_st == false",)), "score"), [1 / 3, None, 1.0])
    with pytest.raises(ValueError):
        C.eligible(("close > 3",))


def test_redaction_and_fingerprints(spark):
    text = "see /home/me/file.txt and api_key = abc123 or file:///tmp/x"
    row = spark.createDataFrame([(text, "rank( close )", "RANK(close)")], "t string, a string, b string").select(
        T.redact(F.col("t")).alias("r"),
        (T.formula_fingerprint(F.col("a"), F.lit(5), F.array(F.lit("x"), F.lit("y"))) == T.formula_fingerprint(F.col("b"), F.lit(5), F.array(F.lit("y"), F.lit("x")))).alias("same"),
    ).first()
    assert row.r == "see <redacted-path> and api_key=<redacted> or <redacted-path>" and row.same


def test_two_sided_p_is_that_of_the_normal_distribution(spark):
    t = [0.0, 0.3, -1.0, 1.96, -2.5758, 4.0, 8.0]
    got = [r.p for r in spark.createDataFrame([(float(v),) for v in t], "t double").select(E.two_sided_p(F.col("t")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in t], rel=2e-7)
    assert spark.sql("SELECT CAST(NULL AS double) AS t").select(E.two_sided_p(F.col("t")).alias("p")).first().p is None


def test_a_split_emptied_by_its_embargo_reports(spark):
    days = spark.range(10).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"), F.lit("F").alias("factor_id"), F.lit(5).alias("horizon"),
        (F.col("id") / 10).alias("ic"), *[F.lit(3).cast("long").alias(c) for c in ("raw_rows", "score_rows", "label_rows", "joint_rows")])
    got = {r.split: r for r in E.split_metrics(days, embargo=50).collect()}
    assert set(got) == {s.name for s in E.DEFAULT_SPLITS}
    empty = got[E.DEFAULT_SPLITS[0].name]
    assert (empty.ic_days, empty.date_count, empty.rank_icir, empty.coverage, empty.t_stat_hac, empty.warning_codes) == (0, 0, 0.0, 0.0, None, [])
    assert got[E.DEFAULT_SPLITS[-1].name].ic_days > 0


def test_window_ranks_leave_out_what_is_not_finite(spark):
    df = series(spark, [1.0, math.inf, 3.0, 2.0, -math.inf, math.nan, 4.0])
    near(over_time(df, S.ts_rank(S.field("close"), 3)), [None, None, 1.0, 0.5, None, None, 1.0])
    near(over_time(df, S.ts_argmax(S.field("close"), 2)), [None, None, None, 1.0, None, None, None])


def test_a_stored_panel_with_faults_is_refused(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    schema = "trade_date date, instrument string, close double, market_cap double, is_st boolean"
    good = [(day, "A", 1.0, 2.0, False), (day, "B", 1.0, 2.0, False)]
    for name, rows in (("good", good), ("twice", [*good, good[0]]), ("gap", [*good, (day, "C", None, 1.0, False)]), ("empty", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/panel.parquet")
    assert P.read_panel(spark, f"{tmp_path}/good").count() == 2
    for name in ("twice", "gap", "empty"):
        with pytest.raises(ValueError, match="refused"):
            P.read_panel(spark, f"{tmp_path}/{name}")
    with pytest.raises(FileNotFoundError):
        P.read_panel(spark, f"{tmp_path}/none")


def test_a_snapshot_that_contradicts_itself_is_refused(spark):
    price = spark.createDataFrame([("20240101", "A", 1.0, 1.0), ("20240101", "A", 1.0, 1.0)], "trade_date string, ts_code string, close double, vol double")
    basic = spark.createDataFrame([("20240101", "A", 1.0, 1.0)], "trade_date string, ts_code string, total_mv double, circ_mv double")
    assert P.load_snapshot(price, basic).count() == 1
    with pytest.raises(ValueError, match="refused"):
        P.load_snapshot(price.unionByName(price.withColumn("close", F.lit(2.0))), basic)


def test_feedback_of_failed_and_ungated_candidates(spark):
    rows = [("a", "boom", True, []), ("b", None, None, None), ("c", "", True, []), ("d", None, False, ["field missing"]), ("e", None, False, ["turnover high"])]
    df = spark.createDataFrame(rows, "factor_id string, error string, passed boolean, blocking array<string>")
    got = {r.factor_id: (r.feedback, r.hint, r.requires_user_decision) for r in R.feedback_label(df).collect()}
    assert got == {
        "a": ("failed", "REPAIR_ERROR", False), "b": ("pending_gate", "EVALUATE_GATE", False), "c": ("accepted_for_candidate", "NEARBY_VARIANTS", False),
        "d": ("blocked", "MAP_FIELD", True), "e": ("blocked", "REDUCE_TURNOVER", False),
    }
