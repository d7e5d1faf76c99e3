"""Registered queries: the streams, run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswind.plans.common import cross, keyed, panel
from crosswind.plans.ledger_queries import OUTCOME_SQL, outcomes
from crosswind.plans.panel_queries import KEY, with_sql
from crosswind.plans.registry import panel_sql, query, r6
from crosswind.plans.score_queries import EWM_SQL, SIGNATURE, momentum
from crosswind.session import scratch_path
from crosswind.sources import values as V
from crosswind.streaming import jobs as W


@query(
    "w01_stream_outcome_ingest",
    with_sql("SELECT outcome_id, COUNT(DISTINCT outcome_id) AS appended FROM oc WHERE origin = 'local' GROUP BY 1", OUTCOME_SQL),
)
def stream_ingest(spark, d):
    return ingested(spark, d)[0].groupBy("outcome_id").agg(F.count(F.lit(1)).alias("appended"))


@query(
    "w01_stream_rejected",
    with_sql("SELECT seq, outcome_id, 'ORIGIN_MISMATCH' AS reason FROM oc WHERE origin IS DISTINCT FROM 'local'", OUTCOME_SQL),
)
def stream_rejected(spark, d):
    return ingested(spark, d)[1].select("seq", "outcome_id", "reason")


def ingested(spark, d):
    """The ledger and the rejected rows after two runs of several micro-batches each; the second has a new checkpoint and replays everything."""
    arrive, ledger, rejected = (scratch_path(spark, n) for n in ("events", "ledger", "rejected"))
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    files = spark.sparkContext.defaultParallelism  # of each batch, so that every core reads
    events.repartition(3 * files).write.parquet(arrive)
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(arrive)
        W.stream_outcome_ingest(outcomes(stream), ledger, scratch_path(spark, "mark"), rejected).awaitTermination()
    schema = outcomes(events).schema
    return W.bucketed(spark, ledger, schema).read(), W.rejected_table(spark, rejected, schema).read()


@query("w02_stream_factor_values", panel_sql(f"SELECT {KEY}, return_5d AS score FROM panel"))
def stream_values(spark, d):
    """Old years, then a late and a current stretch; the last run brings the right rows for days that came wrong in the first."""
    arrive, store, mark, whole = (scratch_path(spark, n) for n in ("arrive", "store", "mark", "panel"))
    df = keyed(panel(spark, d), "close", "is_st")
    year = F.year("trade_date")
    wrong = F.col("is_st") & (F.month("trade_date") > 10)
    first = df.where(year < 1999).withColumn("close", F.when(wrong, F.col("close") * 3).otherwise(F.col("close")))
    for part in (first, df.where(year.between(1999, 2000)), df.where((year > 2000) | ((year < 1999) & wrong))):
        part.write.mode("append").parquet(arrive)
        stream = spark.readStream.schema(df.schema).parquet(arrive)
        W.stream_factor_values(stream, whole, store, mark, momentum(), SIGNATURE, lambda _: cross(spark, d)).awaitTermination()
    return V.factor_values(V.read_values(spark, store, ["FTR-MOM"]), ["FTR-MOM"], SIGNATURE)


@query(
    "w03_stream_ewm",
    panel_sql(
        f"SELECT {KEY}, ROUND(CASE WHEN x IS NOT NULL THEN m END, 6) AS score FROM fold",
        "ewm_in AS (SELECT trade_date, instrument, CASE WHEN NOT is_st THEN return_1d END AS x FROM panel)",
        EWM_SQL,
    ),
)
def stream_ewm(spark, d):
    return smoothed(spark, d).where("not late").select("trade_date", "instrument", r6("score").alias("score"))


@query("w03_stream_ewm_late", panel_sql(f"SELECT {KEY} FROM panel WHERE is_st AND year(trade_date) < 2000"))
def stream_ewm_late(spark, d):
    return keyed(smoothed(spark, d).where("late"))


def smoothed(spark, d):
    """Two runs of the stream; the second also brings days that the first has passed."""
    arrive, sink, mark = (scratch_path(spark, n) for n in ("arrive", "sink", "mark"))
    rows = keyed(panel(spark, d), F.when(~F.col("is_st"), F.col("return_1d")).alias("score"), "is_st")
    early = F.year("trade_date") < 2000
    for part in (early, ~early | F.col("is_st")):
        df = rows.where(part).drop("is_st")
        df.write.mode("append").parquet(arrive)
        stream = spark.readStream.schema(df.schema).parquet(arrive)
        W.run_to_table(W.stream_ewm(stream, 5), sink, mark).awaitTermination()
    return spark.read.parquet(sink)
