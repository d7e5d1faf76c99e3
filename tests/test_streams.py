"""Streams under corrections, replays, late rows and names that stop; the tables they write."""

import datetime as dt
import math
import os
import random
import time
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosswind.functions import signals as S
from crosswind.operators import scores as C
from crosswind.operators.cross_section import CrossSection
from crosswind.session import scratch_path
from crosswind.sources import values as V
from crosswind.sources.snapshots import Conflict, SnapshotTable
from crosswind.streaming import jobs as W

DAY = "trade_date date, instrument string, close double, is_st boolean"


def day(text):
    return dt.date.fromisoformat(text)


class Days:
    """A stream of panel days into factor values, one run a call."""

    def __init__(self, spark, factor, fresh_marks=False):
        self.spark, self.factor, self.fresh = spark, factor, fresh_marks
        self.panel, self.store, self.mark = (scratch_path(spark, n) for n in ("panel", "store", "mark"))
        self.arrive = scratch_path(spark, "arrive")

    def send(self, rows):
        if self.fresh:
            self.arrive, self.mark = scratch_path(self.spark, "arrive"), scratch_path(self.spark, "mark")
        rows = rows if not isinstance(rows, list) else self.spark.createDataFrame([(day(d), i, c, False) for d, i, c in rows], DAY)
        rows.write.mode("append").parquet(self.arrive)
        stream = self.spark.readStream.schema(DAY).parquet(self.arrive)
        W.stream_factor_values(stream, self.panel, self.store, self.mark, self.factor, "sig", lambda _: CrossSection()).awaitTermination()

    def scores(self):
        got = V.factor_values(V.read_values(self.spark, self.store), [self.factor.factor_id], "sig")
        return {(str(r["trade_date"]), r["instrument"]): r["score"] for r in got.collect()}


@pytest.mark.parametrize("fresh", [False, True])
def test_a_corrected_day_restates_itself_and_what_looks_back(spark, fresh):
    s = Days(spark, C.Factor.of("F", S.delay("close", 1)), fresh)
    s.send([("2024-01-01", "A", 1.0), ("2024-01-02", "A", 2.0), ("2024-01-03", "A", 3.0)])
    s.send([("2024-01-02", "A", 2.5)])
    assert s.scores() == {("2024-01-01", "A"): None, ("2024-01-02", "A"): 1.0, ("2024-01-03", "A"): 2.5}
    held = W.PanelStore(spark, s.panel, spark.createDataFrame([], DAY).schema).read()
    assert held.count() == 3 and held.where("trade_date = '2024-01-02'").first()["close"] == 2.5
    s.send([("2024-01-02", "A", 2.5)])  # again
    assert s.scores()["2024-01-03", "A"] == 2.5 and held.count() == 3


def test_two_rows_for_a_key_in_one_batch_are_refused(spark):
    s = Days(spark, C.Factor.of("F", S.delay("close", 1)))
    s.send([("2024-01-01", "A", 1.0), ("2024-01-01", "A", 1.0)])  # equal ones count once
    with pytest.raises(Exception, match="different rows"):
        s.send([("2024-01-02", "A", 2.0), ("2024-01-02", "A", 2.1)])
    assert s.scores() == {("2024-01-01", "A"): None}


@pytest.mark.parametrize("shape", ["series", "rank of a series", "series of a rank"])
def test_corrections_over_years_equal_a_full_run(spark, shape):
    """Sparse names reach back over years; corrections in the middle change later years."""
    i = F.col("id")
    df = spark.range(7 * 40).select(
        F.date_add(F.lit("2019-03-01").cast("date"), (F.floor(i / 7) * 53).cast("int")).alias("trade_date"),
        F.concat(F.lit("K"), (i % 7).cast("string")).alias("instrument"), (F.pmod(F.xxhash64(i), F.lit(97)) + 1.0).alias("close"), F.lit(False).alias("is_st"),
    ).where((F.pmod(i, F.lit(7)) > 1) | (F.pmod(F.xxhash64(i, F.lit(3)), F.lit(5)) == 0))
    close = S.field("close")
    signal = {"series": close - S.delay(close, 3), "rank of a series": S.rank(S.delay(close, 2)), "series of a rank": S.delay(S.rank(S.delay(close, 1)), 2)}[shape]
    factor = C.Factor.of("F", signal)
    s = Days(spark, factor)
    bad = F.pmod(F.xxhash64("trade_date", "instrument"), F.lit(9)) == 0
    y = F.year("trade_date")
    s.send(df.where(y < 2022).withColumn("close", F.when(bad, F.lit(-5.0)).otherwise(F.col("close"))))
    s.send(df.where(y >= 2023))
    s.send(df.where((y == 2022) | (bad & (y < 2022))))
    want = {(str(r["trade_date"]), r["instrument"]): r["score"] for r in factor.build(df, CrossSection()).collect()}
    assert s.scores() == want


def test_a_batch_reads_only_the_years_it_needs(spark):
    s = W.PanelStore(spark, scratch_path(spark, "panel"), spark.createDataFrame([], DAY).schema)
    rows = [(day(f"{y}-06-{d:02d}"), k, 1.0, False) for y in range(2010, 2020) for d in (1, 2, 3) for k in ("A", "B") if k == "A" or y in (2010, 2019)]
    s.merge(spark.createDataFrame(rows, DAY))
    years = lambda name, year, stages: s.years_around(spark.createDataFrame([(name, year)], "instrument string, year int"), stages)
    assert years("A", 2015, (2,)) == {"2014", "2015", "2016"}
    assert years("A", 2015, (4,)) == {"2013", "2014", "2015", "2016", "2017"}
    assert years("A", 2015, (0,)) == {"2015"}
    assert years("B", 2019, (2,)) == {"2010", "2019"}
    before = s.rows.snapshot().parts
    s.merge(spark.createDataFrame([(day("2015-06-02"), "A", 9.0, False)], DAY))
    after = s.rows.snapshot().parts
    assert {k[0] for k in before if before[k] != after[k]} == {"2015"}


OUTCOME = "seq long, outcome_id string, origin string, note string"


def test_ingest_replays_change_neither_table(spark):
    ledger, rejected, arrive = (scratch_path(spark, n) for n in ("ledger", "rejected", "arrive"))
    schema = spark.createDataFrame([], OUTCOME).schema

    def send(rows, mark):
        spark.createDataFrame(rows, OUTCOME).coalesce(1).write.mode("append").parquet(arrive)
        stream = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(arrive)
        W.stream_outcome_ingest(stream, ledger, mark, rejected).awaitTermination()
        return [sorted(t.read().select("seq").collect()) for t in (W.bucketed(spark, ledger, schema), W.rejected_table(spark, rejected, schema))]

    mark = scratch_path(spark, "mark")
    first = [(1, "a", "local", "x"), (2, "b", "local", "x"), (3, "a", "local", "later"), (4, "f", "abroad", None), (4, "f", "abroad", None), (5, "g", None, "x")]
    assert send(first, mark) == [[(1,), (2,)], [(4,), (5,)]]
    late = [(6, "b", "local", "late again"), (7, "c", "local", "x"), (8, "f", "abroad", "another")]
    want = [[(1,), (2,), (7,)], [(4,), (5,), (8,)]]
    assert send(late, mark) == want
    for _ in range(2):  # everything again, under new checkpoints
        assert send([], scratch_path(spark, "mark")) == want
    table = W.bucketed(spark, ledger, schema)
    batch = spark.createDataFrame([(9, "z", "local", "x")], OUTCOME)
    W._add_once(table, batch, "outcome_id", mark, table.snapshot().applied[mark])  # a batch that is noted as in
    assert table.read().count() == 3


def test_crowded_parts_are_written_anew(spark):
    table = W.bucketed(spark, scratch_path(spark, "ledger"), spark.createDataFrame([], OUTCOME).schema)
    for n in range(W.FOLDERS + 2):
        rows = spark.createDataFrame([(n, f"id{n}-{k}", "local", "x") for k in range(200)], OUTCOME)
        W._add_once(table, rows, "outcome_id", "mark", n)
    assert max(len(f) for f in table.snapshot().parts.values()) <= W.FOLDERS
    assert table.read().select("outcome_id").distinct().count() == table.read().count() == 200 * (W.FOLDERS + 2)


def test_ewm_reports_late_rows_and_names_that_stop(spark):
    arrive, sink, mark = (scratch_path(spark, n) for n in ("arrive", "sink", "mark"))
    schema = "trade_date date, instrument string, score double"

    def send(rows):
        spark.createDataFrame([(day(d), i, x) for d, i, x in rows], schema).coalesce(1).write.mode("append").parquet(arrive)

    def run(enough):
        """Until the sink has what the step waits for, a minute at most."""
        stream = W.stream_ewm(spark.readStream.schema(schema).parquet(arrive), 3, idle_ms=4000)
        query, got = W.run_to_table(stream, sink, mark, "0 seconds"), []
        end = time.time() + 60
        try:
            while not enough(got) and time.time() < end:
                time.sleep(0.3)
                assert query.exception() is None
                if os.path.isdir(f"{sink}/_spark_metadata"):
                    got = [(str(r["trade_date"]), r["instrument"], r["score"], r["late"], r["stopped"]) for r in spark.read.schema(W.EWM_OUTPUT).parquet(sink).collect()]
        finally:
            query.stop()
        return sorted(got)

    send([("2024-01-01", "A", 4.0), ("2024-01-02", "A", 8.0), ("2024-01-01", "B", 1.0)])
    got = run(lambda rows: sum(r[4] for r in rows) >= 2)
    assert {("2024-01-01", "A", 4.0, False, False), ("2024-01-02", "A", 6.0, False, False), ("2024-01-01", "B", 1.0, False, False)} <= set(got)
    assert sorted(r for r in got if r[4]) == [("2024-01-01", "B", 1.0, False, True), ("2024-01-02", "A", 6.0, False, True)]


def test_ewm_reports_late_rows(spark):
    arrive, sink, mark = (scratch_path(spark, n) for n in ("arrive", "sink", "mark"))
    schema = "trade_date date, instrument string, score double"
    for rows in ([("2024-01-01", "A", 4.0), ("2024-01-02", "A", 8.0)], [("2024-01-03", "A", 10.0), ("2024-01-01", "A", 9.0), ("2024-01-03", "A", 11.0)]):
        spark.createDataFrame([(day(d), i, x) for d, i, x in rows], schema).coalesce(1).write.mode("append").parquet(arrive)
        W.run_to_table(W.stream_ewm(spark.readStream.schema(schema).parquet(arrive), 3), sink, mark).awaitTermination(60)
    got = sorted(((str(r["trade_date"]), r["score"], r["late"]) for r in spark.read.parquet(sink).collect()), key=lambda r: (r[0], r[2]))
    assert [r for r in got if not r[2]] == [("2024-01-01", 4.0, False), ("2024-01-02", 6.0, False), ("2024-01-03", 8.0, False)]
    assert [r[0] for r in got if r[2]] == ["2024-01-01", "2024-01-03"]


def test_readers_see_a_change_whole_or_not_at_all(spark):
    path = scratch_path(spark, "values")
    rows = lambda n, x, seq: spark.range(n).selectExpr("date_add(date'2020-01-01', cast(id * 40 as int)) as trade_date", "'A' as instrument", f"{x}D as score")
    put = lambda f, df, seq: V.to_rows(df, f, "s", "root", seq)
    V.write_values(put("F-1", rows(30, 1.0, 0), 0).unionByName(put("G", rows(30, 5.0, 0), 0)), path)
    old = V.read_values(spark, path)
    V.upsert(spark, path, put("F-1", rows(3, 2.0, 1), 1))
    new = V.read_values(spark, path)
    assert (old.agg(F.sum("factor_value")).first()[0], new.agg(F.sum("factor_value")).first()[0]) == (180.0, 183.0)
    table = V.store(spark, path)
    before = table.snapshot()
    table.append(put("G", rows(1, 0.0, 9), 9).limit(0))
    with pytest.raises(Conflict):
        table.replace(put("G", rows(1, 0.0, 9), 9), old=before)
    assert new.count() == 60 and V.read_values(spark, path).count() == 60


def test_removal_deletes_files_and_spares_what_others_own(spark):
    path = scratch_path(spark, "values")
    df = spark.range(5).selectExpr("date_add(date'2020-01-01', cast(id * 200 as int)) as trade_date", "'A' as instrument", "1D as score")
    for f in ("FTR-X", "ftr_x", "FTR-Y", "a/b=c%"):
        V.write_values(V.to_rows(df, f, "s", "root", 0), path)
    files = lambda: sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)
    owners = spark.createDataFrame([("FTR-X", "FTR-X"), ("FTR-Y", "OTHER")], "factor_id string, owner_id string")
    n = files()
    assert V.remove_factor(spark, path, "FTR-Y", owners) == 0 and V.remove_factor(spark, path, "none", owners) == 0
    assert V.remove_factor(spark, path, "FTR-X", owners.union(spark.createDataFrame([("Z", "ftr-x")], owners.schema))) == 0
    assert files() == n and V.has_values(spark, path, "FTR-X")
    assert V.remove_factor(spark, path, "FTR-X", owners) == 6  # both spellings, three years each
    assert not V.has_values(spark, path, "FTR-X") and not V.has_values(spark, path, "ftr_x") and V.has_values(spark, path, "a/b=c%")
    assert files() == n // 2 and V.read_values(spark, path).count() == 10
    only = V.read_values(spark, path, ["A/B=C%"])
    assert only.count() == 5 and all("_by_factor_id=a%2Fb%3Dc%25" in unquote(f) for f in only.inputFiles())


def test_partition_keys_survive_odd_values(spark):
    table = SnapshotTable(spark, scratch_path(spark, "odd"), ("k",), "k string, v int")
    keys = ["a/b", "x=y", "50%", "", None, "ü ñ", "data"]
    table.append(spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k string, v int"))
    assert {r["v"] for r in table.read().collect()} == set(range(7))
    assert [r["v"] for r in table.read(lambda k: k[0] == "a/b").collect()] == [0]
    assert table.drop([("50%",), ("absent",)]) == 1 and table.read().count() == 6


def test_a_batch_meets_its_ledger_in_one_exchange(spark, monkeypatch):
    schema = spark.createDataFrame([], OUTCOME).schema
    table = W.bucketed(spark, scratch_path(spark, "ledger"), schema)
    batch = W.durable(spark.createDataFrame([(n, f"id{n % 50}", "local", "x") for n in range(100)], OUTCOME))
    W._add_once(table, batch.where("seq % 50 < 30"), "outcome_id", "mark", 0)
    taken = []
    monkeypatch.setattr(W, "durable", None)  # the rows are stored already
    monkeypatch.setattr(table, "append", lambda rows, *_: taken.append(rows))
    W._add_once(table, batch, "outcome_id", "mark", 1)
    plan = taken[0]._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 2  # the rows and the ledger's keys
    assert sorted(r["seq"] for r in taken[0].collect()) == list(range(30, 50))


def test_running_ewm_is_the_batch_mean_without_pandas_steps(monkeypatch):
    """Cut anywhere, with missing, infinite, repeated and undated rows; names are many, so a row costs no pandas call."""
    held = {}

    class Held:
        get = staticmethod(lambda: held.get("state"))
        exists = staticmethod(lambda: "state" in held)
        update = staticmethod(lambda state: held.update(state=state))

    rng = random.Random(5)
    raw = pd.Series([rng.choice([None, math.inf, rng.random(), 2.0]) for _ in range(60)], dtype="float64")
    want = raw.ewm(span=5, adjust=False).mean().where(raw.notna())
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]

    def refuse(*_, **__):
        raise AssertionError("pandas step")

    for kind, name in ((pd.Series, "duplicated"), (pd.Series, "reindex"), (pd.DataFrame, "sort_values"), (pd.DataFrame, "assign")):
        monkeypatch.setattr(kind, name, refuse)
    for cuts in ([0, 60], [0, 1, 2, 30, 60], range(61)):
        job, got = W.RunningEwm(5), []
        job.state = Held
        held.clear()
        for a, b in zip(cuts, [*cuts][1:]):
            part = pd.DataFrame({"trade_date": days[a:b], "score": raw[a:b].tolist()}).iloc[::-1]
            more = pd.DataFrame({"trade_date": [days[b - 1], None], "score": [9.0, 9.0]})
            (out,) = job.handleInputRows(("N",), iter([part, more]), None)
            assert out["late"].sum() == 2 and out.loc[out["late"], "score"].isna().all() and (out["instrument"] == "N").all() and not out["stopped"].any()
            got += out.loc[~out["late"], "score"].tolist()
        assert np.allclose(got, want.to_numpy(), rtol=0, atol=1e-12, equal_nan=True)
