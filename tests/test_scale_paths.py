"""The multi-task paths give the same answers as the one-task paths, on skewed data."""

import pytest
from pyspark.sql import functions as F

from crosswind.functions import signals as S
from crosswind.functions.signals import Keys
from crosswind.operators import backtest as B
from crosswind.operators import candidates as R
from crosswind.operators import evaluate as E
from crosswind.operators import scores as C
from crosswind.operators import synthesis as M
from crosswind.operators.cross_section import CrossSection, range_positions
from crosswind.plans.backtest_queries import RUNS, SCHEDULES, scores
from crosswind.plans.common import panel
from crosswind.plans.synthesis_queries import MEMBERS, member_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """One date holds a third of all rows, and a third of its values are the same."""
    i = F.col("id")
    day = F.when(i % 3 == 0, F.lit("2024-01-01")).otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (1 + i % 40).cast("int")).cast("string"))
    value = F.when(i % 3 == 0, F.when(i % 9 == 0, 1.0).otherwise(F.pmod(F.xxhash64(i), F.lit(5000)) / 10.0)).otherwise(F.pmod(F.xxhash64(i), F.lit(700)) / 10.0)
    df = spark.range(9000).select(
        day.cast("date").alias("trade_date"), F.concat(F.lit("K"), F.lpad(i.cast("string"), 6, "0")).alias("instrument"), value.alias("v"),
        F.pmod(F.hash(i), F.lit(7)).cast("string").alias("grp"), F.pmod(F.xxhash64(i, F.lit(1)), F.lit(900)).cast("double").alias("x"),
    )
    path = B.durable(df)
    return path


def rows(df, *cols):
    return [tuple(r) for r in df.select("trade_date", "instrument", *[F.round(c, 9) for c in cols]).orderBy("trade_date", "instrument").collect()]


@pytest.mark.parametrize(
    "apply",
    [
        lambda xs, df: xs.rank(df, "v", "out"),
        lambda xs, df: xs.ntile(df, "v", 5, "out"),
        lambda xs, df: xs.winsorize(df, "v", 0.07, "out"),
        lambda xs, df: xs.zscore(df, "v", "out"),
        lambda xs, df: xs.scale(df, "v", "out"),
        lambda xs, df: xs.group_neutralize(df, "v", "grp", "out"),
        lambda xs, df: xs.residualize(df, "v", "x", "out"),
        lambda xs, df: xs.ordinal(df, "v", "out", "n").withColumn("out", F.col("out") + F.col("n") / 1e6),
    ],
)
def test_wide_equals_narrow(skewed, apply):
    assert rows(apply(CrossSection(wide=True), skewed), "out") == rows(apply(CrossSection(wide=False), skewed), "out")


def test_range_positions_number_every_group(skewed):
    out = range_positions(skewed, ("trade_date",), ["v", "instrument"], "pos", "n")
    bad = out.groupBy("trade_date").agg(F.count_distinct("pos").alias("d"), F.max("pos").alias("m"), F.max("n").alias("n"), F.count(F.lit(1)).alias("c"))
    assert bad.where("d <> c or m <> c or n <> c").count() == 0


def test_bound_decides_the_path():
    assert not CrossSection.sized(10, limit=10).wide and CrossSection.sized(11, limit=10).wide


def test_rank_ic_is_the_same_on_both_paths(spark):
    df = panel(spark, SF)
    frame = E.label_scored_panel(df, {"MOM": "return_5d", "VOL": "volume"}, (5, 10))
    pick = lambda wide: sorted(map(tuple, E.daily_rank_ic(frame, CrossSection(wide=wide)).select("factor_id", "horizon", "trade_date", F.round("ic", 9)).collect()), key=str)
    assert pick(True) == pick(False)


def test_backtest_is_the_same_on_both_paths(spark):
    df = panel(spark, SF)

    def run(wide):
        b = B.Backtest(df, scores(df), B.schedules_table(spark, SCHEDULES), B.runs_table(spark, RUNS), CrossSection(wide=wide), True)
        return [tuple(r) for r in b.period_table.select("run_id", "period_id", *[F.round(c, 9) for c in ("gross_return", "cost", "turnover_rate")]).orderBy("run_id", "period_id").collect()]

    assert run(True) == run(False)


def test_composite_is_the_same_on_both_paths(spark):
    df = panel(spark, SF)
    make = lambda wide: M.combine_apriori(
        M.directed_scores(member_scores(df), MEMBERS, "rank", CrossSection(wide=wide)), M.apriori_weights(list(MEMBERS)), CrossSection(wide=wide)
    )
    assert rows(make(True), "score") == rows(make(False), "score")


def test_trial_ranking_is_the_same_on_both_paths(spark):
    df = spark.range(500).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("run_id"), F.when(F.col("id") % 5 > 0, (F.col("id") * 7 % 50) / 10.0).alias("score"),
        (F.col("id") % 11 / 10.0).alias("split_icir"), (F.col("id") % 4 / 10.0).alias("rank_ic_mean"),
    )
    pick = lambda wide: sorted(map(tuple, R.rank_trials(df, wide=wide).select("seq", "place", "total").collect()))
    assert pick(True) == pick(False)


def test_row_order_and_partitions_do_not_matter(spark):
    df = panel(spark, SF).select("trade_date", "instrument", "close", "is_st")
    factor = C.Factor.of("F", C.as_signal("close"))
    base = rows(C.factor_scores(df, factor, CrossSection(), decay=5), "score")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(C.factor_scores(df.orderBy(F.rand(1)), factor, CrossSection(), decay=5), "score") == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_extra_keys_run_many_factors_at_once(spark):
    df = panel(spark, SF).select("trade_date", "instrument", "volume")
    both = df.withColumn("factor_id", F.lit("A")).unionByName(df.withColumn("factor_id", F.lit("B")).withColumn("volume", -F.col("volume")))
    xs = CrossSection(Keys(extra=("factor_id",)))
    out = xs.rank(both, "volume", "r")
    assert rows(out.where("factor_id = 'A'"), "r") == rows(CrossSection().rank(df, "volume", "r"), "r")


@pytest.mark.parametrize("mode", ["sparse_incremental", "date_block_incremental", "full_recompute"])
@pytest.mark.parametrize("shape", ["rank", "rank of older rank", "older rank"])
def test_incremental_scores_are_those_of_a_full_run_on_a_gappy_panel(spark, mode, shape):
    """Names skip dates, one missing key each; a name far back in its own history still counts in the rank of the date."""
    i = F.col("id")
    df = B.durable(
        spark.range(60 * 12)
        .select(F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")).alias("trade_date"),
                F.concat(F.lit("K"), F.floor(i / 60).cast("string")).alias("instrument"),
                (F.pmod(F.xxhash64(i), F.lit(997)) + 1.0).alias("close"), F.lit(False).alias("is_st"))
        .where(F.pmod(F.xxhash64("instrument", "trade_date"), F.lit(4)) < 3 - F.pmod(F.hash("instrument"), F.lit(3)))
    )
    close, xs = S.field("close"), CrossSection()
    momentum = close / S.delay(close, 5) - 1
    factor = C.Factor.of("F", {"rank": S.rank(momentum), "rank of older rank": S.rank(S.delay(S.rank(momentum), 3)), "older rank": S.delay(S.rank(momentum), 3) - momentum}[shape])
    full = factor.build(df, xs).select("trade_date", "instrument", "score")
    cached = full.where("NOT (trade_date BETWEEN '2024-02-20' AND '2024-02-22' AND instrument < 'K3')")
    got = C.incremental_scores(df, factor, cached, xs, mode)
    assert got.where("source = 'computed'").count() > 0
    assert rows(got, "score") == rows(full, "score")


def test_late_day_restates_the_scores_that_look_back_on_it(spark):
    i = F.col("id")
    df = B.durable(spark.range(90).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")).alias("trade_date"), F.concat(F.lit("K"), F.floor(i / 30).cast("string")).alias("instrument")))
    late = df.where("trade_date = '2024-01-10' AND instrument = 'K1'")
    days = lambda stages: sorted((r.instrument, r.trade_date.day) for r in C.affected_keys(df, late, stages).collect())
    assert days(2) == [("K1", 10), ("K1", 11), ("K1", 12)]
    assert days((0, 1)) == [(k, day) for k in ("K0", "K1", "K2") for day in (10, 11)]
    assert days((1, 0)) == [(k, day) for k in ("K0", "K1", "K2") for day in (10, 11)]
