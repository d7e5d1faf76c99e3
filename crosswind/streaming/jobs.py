"""Streams: replay-safe outcome ingest, factor values for new panel days, running EWMA.

Sinks are snapshot tables in shared storage. A micro-batch changes each of them in one switch, and a batch that is run
again after a failure gives the tables it gave before.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from crosswind.operators.cross_section import CrossSection
from crosswind.operators.ledgers import first_of, rejected_outcomes
from crosswind.operators.scores import Factor, affected_keys, context_dates, restrict_to_keys, spread, universe_mask
from crosswind.session import durable
from crosswind.sources import values as V
from crosswind.sources.snapshots import SnapshotTable

ROW = ["trade_date", "instrument"]
#: Parts of a ledger by outcome id; a batch reads the ids of the parts it touches.
BUCKETS = 64
#: The store that transformWithState needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Files that a part may gather before it is written anew.
FOLDERS = 16


def bucketed(spark: SparkSession, path: str, schema: StructType) -> SnapshotTable:
    return SnapshotTable(spark, path, ("bucket",), StructType(schema.fields + [StructField("bucket", IntegerType())]))


def rejected_table(spark: SparkSession, path: str, outcomes: StructType) -> SnapshotTable:
    extra = [StructField("reason", StringType()), StructField("row_id", StringType())]
    return bucketed(spark, path, StructType(outcomes.fields + extra))


def _add_once(table: SnapshotTable, rows: DataFrame, key: str, stream: str, batch_id: int) -> None:
    """Append the rows whose key the table does not hold, the first of each key by ``seq``, unless this batch of the stream is in.

    ``rows`` are read twice, so they should come from a stored table.
    """
    old = table.snapshot()
    if old.applied.get(stream, -1) >= batch_id:
        return
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    touched = {(str(r["bucket"]),) for r in rows.select("bucket").distinct().collect()}
    held = table.read(lambda k: k in touched, old).select("bucket", key)
    # One exchange and one sort serve the anti-join and the choice of the first row.
    fresh = first_of(rows.join(spread(held), ["bucket", key], "left_anti"), "bucket", key)
    crowded = [k for k in touched if len(old.parts.get(k, ())) >= FOLDERS]
    table.append(fresh, crowded, stream, batch_id, old)


def stream_outcome_ingest(
    outcomes: DataFrame, ledger: str, checkpoint: str, rejected: str, origin: str = "local"
) -> StreamingQuery:
    """Append outcomes once each, however late they come.

    Replays are dropped within the batch and by an anti-join with the parts of the ledger that the batch touches, so no event time
    decides what is kept. Rows of another origin go to the table `rejected` with their reason, each distinct row once. Both tables note
    the last batch of this checkpoint with the rows it brought, so a batch that is run again after a failure changes neither.
    """
    taken = bucketed(outcomes.sparkSession, ledger, outcomes.schema)
    refused = rejected_table(outcomes.sparkSession, rejected, outcomes.schema)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch = durable(batch)
        _add_once(taken, batch.where(F.col("origin") == origin), "outcome_id", checkpoint, batch_id)
        row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in batch.columns]), {"ignoreNullFields": "false"}), 256)
        _add_once(refused, rejected_outcomes(batch, origin).withColumn("row_id", row), "row_id", checkpoint, batch_id)

    return outcomes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class PanelStore:
    """A panel of one row per (trade_date, instrument), kept by year, with the number of rows of each instrument and year beside it.

    A day that comes again replaces the one before. The counts tell which years hold the rows before and after a key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        year = StructField("year", IntegerType())
        self.rows = SnapshotTable(spark, f"{path}/rows", ("year",), StructType(schema.fields + [year]))
        self.counts = SnapshotTable(spark, f"{path}/counts", ("year",), "instrument string, n long, year int")

    def merge(self, days: DataFrame) -> int:
        """Put ``days`` in the place of what is stored for their keys; only their years are read and written. Returns the snapshot's number.

        Equal rows count once; a key with two different rows is refused, with nothing written.
        """
        days = durable(days.distinct().withColumn("year", F.year("trade_date")))
        twice = days.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise ValueError(f"{twice.count()} keys come with different rows in one batch")
        old = self.rows.snapshot()
        years = {(str(r["year"]),) for r in days.select("year").distinct().collect()}
        stored = self.rows.read(lambda k: k in years, old).join(spread(days.select("year", *ROW)), ["year", *ROW], "left_anti")
        number = self.rows.replace(days.unionByName(stored), old=old).number
        merged = self.rows.read(lambda k: k in years)
        self.counts.replace(merged.groupBy("instrument", "year").agg(F.count(F.lit(1)).alias("n")))
        return number

    def years_around(self, changed: DataFrame, stages: tuple[int, ...]) -> set[str]:
        """The years with all rows that the scores of the changed keys, and of those that look back on them, need.

        ``changed`` has instrument and year. The way is that of ``affected_keys`` and then of ``context_dates``: as many rows on, and as many
        back, as each stage looks; at each cross-sectional step every instrument of the years found so far takes part.
        """
        counts = durable(self.counts.read())
        spans = changed.groupBy("instrument").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
        for forward, rows in [*[(True, r) for r in reversed(stages)], *[(False, r) for r in stages]]:
            if len(stages) > 1:
                ends = spans.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
                spans = counts.select("instrument").distinct().select("instrument", F.lit(ends["lo"]).alias("lo"), F.lit(ends["hi"]).alias("hi"))
            if rows:
                spans = _further(counts, spans, rows, forward)
        found = counts.join(spread(spans), "instrument").where(F.col("year").between(F.col("lo"), F.col("hi")))
        return {str(r["year"]) for r in found.select("year").distinct().collect()}

    def read(self, years: set[str] | None = None) -> DataFrame:
        return self.rows.read(None if years is None else lambda k: k[0] in years).drop("year")


def _further(counts: DataFrame, spans: DataFrame, rows: int, forward: bool) -> DataFrame:
    """Spans of years that reach on until ``rows`` more rows of the instrument are inside, or it has none left."""
    beyond = counts.join(spread(spans), "instrument").where(F.col("year") > F.col("hi") if forward else F.col("year") < F.col("lo"))
    order = Window.partitionBy("instrument").orderBy(F.asc("year") if forward else F.desc("year"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = (F.max if forward else F.min)("year").alias("end")
    reached = beyond.withColumn("before", before).where(F.col("before") < rows).groupBy("instrument").agg(end)
    new = F.coalesce(F.col("end"), F.col("hi" if forward else "lo"))
    return spans.join(spread(reached), "instrument", "left").withColumn("hi" if forward else "lo", new).drop("end")


def stream_factor_values(
    days: DataFrame, panel: str, store: str, checkpoint: str, factor: Factor, signature: str, cross: Callable[[DataFrame], CrossSection]
) -> StreamingQuery:
    """Keep factor values up to date as panel days arrive, late and corrected ones included.

    Each batch is merged into the panel table, the last row of a key in the place of the one before. Its keys, and stored ones that look back
    on them, are then computed from the years that hold what they need, and the touched factor/year partitions are merged. All steps
    give the same when a batch is run again.
    """
    held = PanelStore(days.sparkSession, panel, days.schema)

    def update(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = durable(batch)
        if batch.isEmpty():
            return
        number = held.merge(batch)
        keys = batch.select(*ROW).distinct()
        changed = keys.select("instrument", F.year("trade_date").alias("year")).distinct()
        whole = held.read(held.years_around(changed, factor.needs))
        if len(factor.needs) == 1:  # no cross-section: other instruments have no part in it
            whole = whole.join(spread(changed.select("instrument").distinct()), "instrument", "left_semi").select(*whole.columns)
        whole = durable(whole)
        new = durable(affected_keys(whole, keys, factor.needs))
        context = whole.join(context_dates(whole, new, factor.needs), "trade_date", "left_semi").select(*whole.columns)
        fresh = universe_mask(factor.build(context, cross(context)), factor.filters)
        # Snapshot numbers only grow, so these rows win over what is stored, under a new checkpoint too.
        rows = V.to_rows(restrict_to_keys(fresh.select(*ROW, "score"), new), factor.factor_id, signature, "incremental", number)
        V.upsert(spark, store, rows)

    return days.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EWM_OUTPUT = "trade_date date, instrument string, score double, late boolean, stopped boolean"
EWM_STATE = "last_date date, mean double, gap int, timer long"


class RunningEwm(StatefulProcessor):
    """EWMA per instrument over arriving days.

    The state is the last day, the last mean, the number of missing values since and the timer. A row at or before the last
    seen day, a day's second row, or one without a day, cannot enter a mean that is already out: it is passed on as `late` without a score. A name that
    sends nothing for ``idle_ms`` of processing time is reported once as `stopped`, with its last day and mean, and forgotten;
    rows that come later start anew. Without ``idle_ms`` no name stops.
    """

    def __init__(self, span: int, idle_ms: int | None = None):
        self.span, self.idle_ms = span, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("running", EWM_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, mean, gap, timer = self.state.get() or (None, None, 0, None)
        new = [(day, float(x)) for part in rows for day, x in zip(part["trade_date"].tolist(), part["score"].astype("float64").tolist())]
        days, means, late = [], [], []
        alpha = 2.0 / (self.span + 1)
        # One plain pass: a chain of pandas calls takes far longer than the few hundred rows of a name.
        for day, x in sorted(new, key=lambda row: (row[0] is None, row[0] or dt.date.min)):
            passed = day is None or (last is not None and day <= last)
            if not passed:
                last = day
                if math.isfinite(x):
                    kept = (1.0 - alpha) ** (gap + 1)
                    mean, gap = x if mean is None else (kept * mean + alpha * x) / (kept + alpha), 0
                elif mean is not None:
                    gap += 1
            days.append(day)
            means.append(math.nan if passed or math.isnan(x) or mean is None else mean)
            late.append(passed)
        if self.idle_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.state.update((last, mean, gap, timer))
        yield self._rows(days, key[0], means, late, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, mean, _, _ = self.state.get()
        self.state.clear()
        yield self._rows([last], key[0], [mean], [False], True)

    @staticmethod
    def _rows(days: list, name: str, means: list, late: list, stopped: bool) -> pd.DataFrame:
        return pd.DataFrame({"trade_date": days, "instrument": name, "score": np.array(means, "float64"), "late": np.array(late, bool), "stopped": stopped})

    def close(self) -> None:
        pass


def stream_ewm(scores: DataFrame, span: int, idle_ms: int | None = None) -> DataFrame:
    """A streaming frame (trade_date, instrument, score, late, stopped) smoothed per instrument, see ``RunningEwm``.

    A micro-batch holds at most its new days per instrument. The state lives in RocksDB, so it may outgrow the executors' memory.
    """
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return scores.groupBy("instrument").transformWithStateInPandas(RunningEwm(span, idle_ms), EWM_OUTPUT, "append", mode)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write what there is and end, or go on at the interval ``every``.

    A stream with timers has to go on: timers of processing time keep asking for batches, so that a run over what there is would never end.
    """
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
