"""Headline timings: named queries on the given tables and one fitted composite backtest.

The composite runs on a generated panel of 5,600 names by 592 dates (3.3M rows), the size
at which the published baseline of about 230 s was measured. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from crosswind.operators import backtest as B
from crosswind.operators import synthesis as M
from crosswind.operators.cross_section import CrossSection
from crosswind.plans import QUERIES
from crosswind.plans.synthesis_queries import MEMBERS, NAMES, member_scores
from crosswind.session import durable, local_session, scratch_path
from crosswind.sources.panel import with_returns

HEADLINE = (
    "s01_panel_scan",
    "x01_rank",
    "x03_winsorize",
    "t08_ts_rank",
    "t14_ewm_decay",
    "p01_factor_scores",
    "p08_incremental_compute",
    "v15_evaluate_factor",
    "v16_evaluate_many",
    "f04_lag_ic",
    "b28_run_backtest",
    "m13_combine_fitted",
    "m19_materialize_composite",
    "r15_round_summary",
    "l05_promote",
    "l13_priors_table",
)
INSTRUMENTS, DATES = 5600, 592


def generated_panel(spark):
    """A deterministic daily panel, stored once so that timing starts at the scan."""
    cells = spark.range(INSTRUMENTS * DATES)
    i, t = F.floor(F.col("id") / DATES), F.pmod("id", F.lit(DATES))
    noise = lambda k: F.pmod(F.xxhash64(F.lit(k), i, t), F.lit(10000)) / 10000.0 - 0.5
    close = 20.0 + F.pmod(i, F.lit(97)) + F.sin(t / 9.0 + i) * 2.0 + noise(1)
    df = cells.select(
        F.date_add(F.lit("2022-01-03").cast("date"), t.cast("int")).alias("trade_date"),
        F.concat(F.lit("G"), F.lpad(i.cast("string"), 6, "0")).alias("instrument"),
        close.alias("close"),
        (100000.0 + F.pmod(i, F.lit(1009)) * 50 + noise(2) * 40000).alias("volume"),
        (close * (1.0e6 + F.pmod(i, F.lit(5003)) * 1.0e3)).alias("market_cap"),
        (F.pmod(F.xxhash64(F.lit(3), i), F.lit(50)) == 0).alias("is_st"),
    )
    path = scratch_path(spark, "bench-panel")
    df.write.parquet(path)
    return spark.read.parquet(path)


def fitted_composite(spark, panel) -> None:
    """Members, standardisation, IC sweep, fitted weights, composite, backtest metrics."""
    xs = CrossSection.sized(INSTRUMENTS)
    df = with_returns(panel)
    cal = durable(B.calendar(panel))
    plan = B.Schedule("fit", 5)
    on_grid = M.directed_scores(M.signal_rows(member_scores(df), cal, plan), MEMBERS, "zscore", xs)
    sweep = durable(M.period_ic_sweep(on_grid, panel, cal, plan, xs))
    weights = M.weights_as_of(M.fitted_weights(sweep, cal, NAMES, plan, "ic_weighted", 3), cal, NAMES)
    composite = durable(M.composite(member_scores(df), MEMBERS, "zscore", xs, weights, 2).select("trade_date", "instrument", "score"))
    run = B.Run("COMPOSITE", "COMPOSITE", "fit", 0.3, 5, 5.0, 5.0, 50.0)
    small = panel.select("trade_date", "instrument", "close")
    test = B.Backtest(
        small, composite.withColumn("factor_id", F.lit("COMPOSITE")), B.schedules_table(spark, [plan]), B.runs_table(spark, [run]), xs, True
    )
    test.metrics.collect()
    test.segments().collect()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["e01_field"](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM's code paths
    seconds = {}
    for name in HEADLINE if os.environ.get("BENCH_QUERIES", "1") == "1" else ():
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    if os.environ.get("BENCH_COMPOSITE", "1") == "1":
        panel = generated_panel(spark)
        start = time.perf_counter()
        fitted_composite(spark, panel)
        seconds["fitted_composite_3m_rows"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": os.environ.get("BENCH_CPUS", "8"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
