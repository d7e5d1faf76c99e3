"""What a plan or a loop must look like at scale, and greedy or iterative rules against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosswind import session
from crosswind.functions import signals as S
from crosswind.operators import backtest as B
from crosswind.operators import candidates as R
from crosswind.operators import cross_section, falsify
from crosswind.operators import evaluate as E
from crosswind.operators import ledgers as L
from crosswind.operators import scores as C
from crosswind.operators import synthesis as M
from crosswind.operators.cross_section import CrossSection
from crosswind.plans import QUERIES, backtest_queries, eval_queries, score_queries, synthesis_queries
from crosswind.plans.common import panel
from crosswind.plans.synthesis_queries import MEMBERS, member_columns, member_scores
from crosswind.sources import panel as panels
from crosswind.sources import values

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(monkeypatch):
    """The plans of all tables that are written on the way."""
    plans = []

    def keep(df, real=S.durable):
        plans.append(plan(df))
        return real(df)

    for module in (S, cross_section):
        monkeypatch.setattr(module, "durable", keep)
    return plans


def test_a_factor_on_wide_dates_has_no_window_over_a_date(spark, stored):
    df = panel(spark, SF)
    ranked = S.rank(S.delta(S.winsorize(S.field("return_5d"), 0.1), 3))
    signal = S.ntile(ranked, 5) - S.residualize(S.zscore("volume"), S.scale("close")) + S.group_neutralize(S.delay(ranked, 1), "industry")
    out = C.factor_scores(df, C.Factor.of("F", signal), CrossSection(wide=True))
    windows = re.findall(r"Window \[.*?\n", "".join([*stored, plan(out)]))
    by_date = [w for w in windows if re.search(r"\], \[trade_date#\d+\]", w)]
    # the only ones add up the counts of a date's partitions
    assert stored and by_date and all(re.search(r"sum\(_n#\d+L?\)", w) for w in by_date), by_date
    narrow = C.factor_scores(df, C.Factor.of("F", signal), CrossSection())
    rows = lambda f: sorted((r[0], r[1], None if r[2] is None else round(r[2], 9)) for r in f.select("trade_date", "instrument", "score").collect())
    assert rows(out) == rows(narrow)


def test_temporary_names_spare_the_panel(spark):
    df = panel(spark, SF).withColumnsRenamed({"volume": "_in0", "close": "_step0"})
    out = S.attach(df, S.rank(S.field("_in0")) + S.field("_step0"), CrossSection(wide=True), "score")
    assert out.columns == [*df.columns, "score"]
    assert out.where("score is not null and score <> _step0").count() > 0


def test_a_composite_has_one_exchange_by_date(spark):
    df = panel(spark, SF).select("trade_date", "instrument", "volume", "return_5d", "volatility_5d", "close", "market_cap", "is_st")
    path = B.durable(member_scores(df))
    for how in ("rank", "zscore"):
        text = plan(M.composite(path, MEMBERS, how, CrossSection(), M.apriori_weights(list(MEMBERS))))
        assert len(re.findall(r"Exchange (?!Single)", text)) == 1, text
        dated = spark.createDataFrame([("MOM", None, 1.0)], "factor_id string, trade_date date, weight double")
        text = plan(M.composite(path, MEMBERS, how, CrossSection(), dated, 1))
        assert len(re.findall(r"Exchange hashpartitioning\(trade_date", text)) <= 2, text  # the other is that of the weights


def test_composite_equals_the_long_way(spark):
    df = panel(spark, SF)
    for how in ("rank", "zscore"):
        for weights, least in ((M.apriori_weights(list(MEMBERS)), 2), (None, 1)):
            if weights is None:
                dates = df.select("trade_date").distinct().where(F.month("trade_date") < 7)
                weights = dates.select(F.explode(F.array(*[F.struct(F.lit(m).alias("factor_id"), F.lit(float(i + 1)).alias("weight")) for i, m in enumerate(MEMBERS)])).alias("x"), "trade_date").select("x.*", "trade_date")
            a, b = (M.composite(member_scores(df), MEMBERS, how, CrossSection(wide=w), weights, least) for w in (False, True))
            rows = lambda f: sorted((str(r[0]), r[1], r[2] if r[2] is None else round(r[2], 9)) for r in f.select("trade_date", "instrument", "score").collect())
            assert rows(a) == rows(b)


def test_rank_ics_of_many_horizons_send_a_row_to_its_date_once(spark):
    text = plan(eval_queries.daily(spark, SF, eval_queries.FACTORS, eval_queries.ALL))
    assert "hashpartitioning(trade_date" in text and "hashpartitioning(factor_id" not in text and "Generate" not in text


def test_rank_ics_of_a_date_equal_the_ranks_of_the_long_frame(spark):
    r = random.Random(9)
    odd = [None, float("nan"), 0.0, -0.0, float("inf"), 1.5, 1.5, 2.0]
    rows = [(f"2024-01-{1 + d:02d}", f"N{n}", r.choice([None, 0.0, 4.0, 5.0, r.uniform(4, 9)]), r.choice(odd), r.choice(odd[2:4]), None, r.randrange(3)) for d in range(28) for n in range(d % 12 + 1)]
    df = spark.createDataFrame(rows, "trade_date string, instrument string, close double, a double, same double, none double, i int")
    scores, horizons = {"A": "a", "S": "same", "N": "none", "I": "i"}, (1, 3)

    def shown(daily):
        return sorted((x.factor_id, x.horizon, x.trade_date, None if x.ic is None else round(x.ic, 9), x.joint_rows, x.raw_rows, x.score_rows, x.label_rows) for x in daily.collect())

    long = shown(E.daily_rank_ic(E.label_scored_panel(df, scores, horizons), CrossSection()))
    assert sum(x[3] is not None for x in long) > 40
    for panel_df in (df, df.withColumn("i", F.col("i").cast("bigint"))):
        for xs in (CrossSection(), CrossSection(wide=True)):
            assert [x[:3] + x[4:] for x in shown(E.panel_rank_ic(panel_df, scores, horizons, xs))] == [x[:3] + x[4:] for x in long]
        assert shown(E.panel_rank_ic(panel_df, scores, horizons, CrossSection())) == long


def test_period_returns_equal_a_search_day_by_day(spark):
    r = random.Random(6)
    quotes = {(i, n): r.uniform(5, 9) for i in range(40) for n in "ABC" if r.random() < (0.9, 0.5, 0.2)["ABC".index(n)]}
    rows = [(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", n, c) for (i, n), c in quotes.items()] + [(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", "Z", None) for i in range(40)]
    df = spark.createDataFrame(rows, "trade_date string, instrument string, close double").withColumn("trade_date", F.col("trade_date").cast("date"))
    periods = [("a", s, s + 1, min(s + 1 + 5, 39)) for s in range(0, 36, 5)] + [("b", s, s + 2, s + 2 + 9) for s in range(0, 28, 3)]
    got = {(x.schedule_id, x.signal_idx, x.instrument): (round(x.entry_close, 9), round(x.period_return, 9), x.lost) for x in B.period_returns(
        df, B.calendar(df), spark.createDataFrame(periods, "schedule_id string, signal_idx int, entry_idx int, exit_idx int")).collect()}
    want = {}
    for sid, signal, entry, end in periods:
        for n in "ABC":
            if (entry, n) in quotes:
                later = [i for i in range(entry + 1, end + 1) if (i, n) in quotes]
                last = quotes[later[-1], n] if later else quotes[entry, n]
                want[sid, signal, n] = (round(quotes[entry, n], 9), round(last / quotes[entry, n] - 1, 9), not later or later[-1] != end)
    assert got == want


def test_last_quotes_equal_a_search_day_by_day(spark):
    r = random.Random(10)
    quotes = {(i, n): r.uniform(5, 9) for i in range(30) for n in "ABC" if r.random() < (0.9, 0.5, 0.2)["ABC".index(n)] and (n, i) != ("B", 0)}
    rows = [(f"2024-03-{1 + i:02d}", n, c) for (i, n), c in quotes.items()] + [(f"2024-03-{1 + i:02d}", "Z", None) for i in range(30)]
    df = spark.createDataFrame(rows, "trade_date string, instrument string, close double")
    got = {x.instrument: (x.first_idx, x.closes, x.quoted) for x in B.last_quotes(df, B.calendar(df)).collect()}
    want = {}
    for n in "ABC":
        own = [i for i in range(30) if (i, n) in quotes]
        days = range(own[0], 30)
        want[n] = (own[0], [quotes[max(j for j in own if j <= i), n] for i in days], [i in own for i in days])
    assert got == want


def test_only_entry_days_move_and_members_meet_their_names_before_their_days(spark, monkeypatch):
    plans = []

    def keep(df, real=B.durable):
        plans.append(plan(df))
        return real(df)

    monkeypatch.setattr(B, "durable", keep)
    b = backtest_queries.backtest(spark, SF, True)
    assert b.matched.count() and b.leg_marks.count()
    assert not any("hashpartitioning(idx#" in p for p in plans)  # neither quotes by their day nor a row for each member and day
    assert sum("hashpartitioning(run_id" in p and "is_long" in p for p in plans) > 0


def test_cohorts_share_the_pass_over_the_panel(spark):
    df = panel(spark, SF).select("trade_date", "instrument", "close")
    cal = B.durable(B.calendar(df))

    def passes(cohorts):
        plans = B.schedules_table(spark, [B.Schedule(f"s{i}", 10, 1, i) for i in range(cohorts)])
        return len(re.findall(r"\blast\(", plan(B.period_returns(df, cal, B.durable(B.schedule(cal, plans)))).split("Window", 2)[1]))

    assert passes(1) == passes(12) > 0


def test_ancestors_of_requested_equal_the_closure(spark):
    r = random.Random(8)
    edges = [(a, r.randrange(a + 1, min(a + 9, 120))) for a in range(110) for _ in range(2)] + [(115, 100), (None, 3), (4, None)]  # 100 .. 115 close a cycle
    e = spark.createDataFrame(edges, "artifact_id long, parent long")
    up = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            up[a].add(b)
    want = {}
    for start in (0, 7, 100, 119):
        depth, front, seen = 0, {start}, set()
        while front:
            depth += 1
            front = {b for a in front for b in up[a]} - seen
            seen |= front
            want |= {(start, b): depth for b in front}
    ask = spark.createDataFrame([(0,), (7,), (7,), (100,), (119,), (None,), (555,)], "artifact_id long")
    assert {(x[0], x[1]): x[2] for x in L.ancestors_of(e, ask).collect()} == want
    assert L.ancestors_of(e, ask.where("artifact_id > 500")).count() == 0


@pytest.mark.parametrize("formula, diversity", [(True, True), (True, False), (False, True)])
def test_labels_follow_the_order_of_a_run(spark, formula, diversity):
    r = random.Random(3)
    rows, old = [], {"f1", "f20"}
    for seq in range(400):
        k = r.randrange(60)
        rows.append((seq, f"run{seq % 3}", f"f{k}", f"shape{k % 11}"))
    index, shapes, want = defaultdict(lambda: set(old)), defaultdict(int), {}
    for seq, run, print_, shape in rows:
        duplicate = formula and print_ in index[run]
        over = not duplicate and diversity and shapes[run, shape] >= 2
        want[seq] = (duplicate, over)
        if not duplicate and not over:
            index[run].add(print_)
            shapes[run, shape] += 1
    df = spark.createDataFrame(rows, "seq long, run_id string, fingerprint string, shape string").repartition(5)
    out = R.label_candidates(df, spark.createDataFrame([(x,) for x in old], "fingerprint string"), 2, formula=formula, diversity=diversity)
    assert {x.seq: (x.duplicate_formula, x.over_diversity_cap) for x in out.collect()} == want
    counts = R.skip_counts(out).agg(F.sum("formula_skipped"), F.sum("diversity_skipped"), F.sum("accepted")).first()
    assert tuple(counts) == (sum(a for a, _ in want.values()), sum(b for _, b in want.values()), sum(not a and not b for a, b in want.values()))


def test_placebo_moves_each_row_once(spark):
    rows = [(f"2024-01-{d:02d}", f"N{i}", float((i * 7 + d) % 13), float((i * 5 + d * d) % 11)) for d in range(1, 29) for i in range(20)]
    frame = spark.createDataFrame(rows, "trade_date string, instrument string, score double, forward_return double").withColumn("trade_date", F.col("trade_date").cast("date"))
    text = plan(falsify.placebo_day_ics(frame, 1, 50))
    assert "Generate" not in text and len(re.findall(r"Exchange ", text)) == 1
    flat = frame.withColumn("score", F.when(F.col("trade_date") < "2024-01-05", 1.0).otherwise(F.col("score")))
    a, b = (falsify.placebo_percentile(flat, CrossSection(wide=w), 4, 8).first() for w in (False, True))
    assert a.evaluable_dates == b.evaluable_dates == 24 and a.percentile == b.percentile and abs(a.real_mean_ic - b.real_mean_ic) < 1e-12


def test_hash_places_of_many_rows_are_those_of_md5():
    """Names of all lengths, beyond one stretch and beyond one block of the hash."""
    names = sorted({f"S{i:0{i % 9 + 6}d}".encode() for i in range(falsify.STRETCH + 40)} | {b"", "\u00e9".encode()})
    prefixes = [b"7|1|2024-01-01|", b"7|50|2024-01-01|"]
    for some in (names, [*names, b"x" * 39], [*names, b"x" * 40], [b"twice", b"twice"], [b""]):
        want = [np.array(sorted(range(len(some)), key=lambda i: (hashlib.md5(p + some[i]).digest(), i))) for p in prefixes]
        assert all((a == b).all() for a, b in zip(falsify._hash_orders(prefixes, some), want, strict=True))


def test_falsification_takes_one_exchange_by_date(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(falsify, "durable", lambda df: stored.append(plan(df)) or S.durable(df))
    rows = [(f"2024-01-{d:02d}", f"N{i}", None if i == d % 7 else float((i * 7 + d) % 13), None if d > 26 else 1.0 if d == 9 else float((i * 5 + d * d) % 11)) for d in range(1, 29) for i in range(20)]
    rows += [(f"2024-02-{d:02d}", f"N{i}", float((i * d) % 17), float((i * 3 + d * d) % 7)) for d in range(1, 15) for i in range(20)]
    frame = spark.createDataFrame(rows, "trade_date string, instrument string, score double, forward_return double").withColumn("trade_date", F.col("trade_date").cast("date"))
    got, wide = ({(r.metric, r.segment): (r.value, r.observations) for r in falsify.falsification_report(frame, CrossSection(wide=w), 4, 8).collect()} for w in (False, True))
    assert stored[0].count("FlatMapGroupsInArrow") == 1 and stored[0].count("Generate") == 0 and len(re.findall(r"Exchange ", stored[0])) == 2
    assert got.keys() == wide.keys() and len(got) == 14 and got["real_rank_ic_mean", ""][1] == 39
    for k, (value, n) in got.items():
        assert wide[k][1] == n and (value == wide[k][0] or abs(value - wide[k][0]) < 1e-9), k


def test_tables_of_keys_are_never_broadcast(spark):
    """A driver builds what is broadcast; keys grow with the panel."""
    df = S.durable(panel(spark, SF).select("trade_date", "instrument", "close", F.col("return_5d").alias("score")))
    keys = S.durable(df.where("close > 1000").select("trade_date", "instrument"))
    found = C.affected_keys(df, keys, (5,))
    for out in (C.restrict_to_keys(df, keys), C.missing_keys(df, keys), C.trusted_cache(df, df, 5), C.cache_only_scores(df, df), found):
        assert "Broadcast" not in plan(out)
    got, rows = {tuple(r) for r in found.collect()}, defaultdict(list)
    for r in df.orderBy("trade_date").collect():
        rows[r["instrument"]].append((r["trade_date"], r["close"] > 1000))
    assert got == {(d, k) for k, own in rows.items() for i, (d, _) in enumerate(own) if any(c for _, c in own[max(0, i - 5) : i + 1])}


@pytest.mark.parametrize("shape", ["forest", "two parents", "cycle", "own parent"])
def test_all_ancestors_equal_a_walk_and_trees_write_each_pair_once(spark, monkeypatch, shape):
    edges = [(i, i // 3) for i in range(3, 200)] + [(1000 + i, 1001 + i) for i in range(11)]
    edges += {"forest": [], "two parents": [(150, 7), (60, 4)], "cycle": [(1011, 1003)], "own parent": [(1, 1)]}[shape]
    written = []
    monkeypatch.setattr(L, "durable", lambda df, real=L.durable: written.append(real(df)) or written[-1])
    got = L.ancestors(spark.createDataFrame(edges, "artifact_id long, parent long"))
    rows, up, want = got.collect(), defaultdict(set), {}
    for a, p in edges:
        up[a].add(p)
    for a in list(up):
        at, depth = up[a], 1
        while at:
            new = {p for p in at if (a, p) not in want}
            want |= {(a, p): depth for p in new}
            at, depth = {q for p in new for q in up.get(p, ())}, depth + 1
    assert len(rows) == len(want) and {(r["artifact_id"], r["ancestor"]): r["depth"] for r in rows} == want
    if shape == "forest":
        assert sum(df.count() for df in written) == len(rows)


def test_steps_of_the_wide_nested_factor_store_no_column_it_does_not_read(spark, monkeypatch):
    from crosswind.plans.score_queries import nested

    stored = []
    monkeypatch.setattr(S, "durable", lambda df, real=S.durable: stored.append(set(df.columns)) or real(df))
    nested(spark, SF, CrossSection(wide=True))
    spare = {"amount", "close", "industry", "market_cap", "return_1d", "volatility_5d"}
    assert stored and not any(columns & spare for columns in stored)


def test_snapshot_rows_are_dealt_by_their_number(spark, monkeypatch):
    """The tasks that drop repeats and count keys grow in number with the rows, so one of them does not grow."""
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    price = S.durable(spark.range(3000).selectExpr("'20240101' AS trade_date", "CAST(id DIV 2 AS STRING) AS ts_code", "CAST(id % 4 = 1 AS DOUBLE) AS close", "1.0D AS vol"))
    basic = S.durable(price.selectExpr("trade_date", "ts_code", "close AS total_mv", "close AS circ_mv").where("close = 0").distinct())
    found = panels.snapshot_conflicts(price, basic)
    text = plan(found)
    assert "hashpartitioning(trade_date#" in text and {int(n) for n in re.findall(r"ts_code#\d+, (\d+)\), REPARTITION_BY_NUM", text)} == {60, 30}
    assert len(re.findall(r"Exchange ", text)) == 2 and {(r.source, r.copies) for r in found.collect()} == {("price", 2)} and found.count() == 750


def test_stored_scores_of_one_factor_are_kept_in_a_hash_table(spark):
    rows = spark.createDataFrame([("k", 1.5, 3), ("k", None, 4), ("m", 2.5, 1), ("n", 7.0, None)], "instrument string, score double, seq bigint")
    last = C.dedupe_last(rows, ["instrument"])
    assert {tuple(r) for r in last.collect()} == {("k", None, 4), ("m", 2.5, 1), ("n", None, None)}
    assert "SortAggregate" not in plan(last) and last.columns == rows.columns


def test_the_value_store_and_the_sources_of_a_compaction_read_the_panel_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(score_queries, "panel", lambda s, d: made.append(s.read.parquet(f"{d}/lineitem.parquet")) or panel(s, d))
    for name in ("s17_unsigned_value_policy", "s23_compact_factor_store"):
        made.clear()
        assert "l_shipdate" not in plan(QUERIES[name](spark, SF)) and len(made) == 1, name


def test_a_compaction_brings_the_rows_of_a_key_together_once(spark):
    rows = [("a", True, "F", 1.0), ("b", False, "f", 1.0), ("c", False, "F", 2.0), ("d", False, "g-1", 5.0), ("e", False, "G_1", 5.0)]
    src = spark.createDataFrame([(*r, d, "N") for r in rows for d in ("2024-01-02", "2024-01-03")] + [("a", True, "F", 9.0, None, "N")],
                                "source string, canonical boolean, factor_id string, factor_value double, trade_date string, instrument string")
    report = values.compact_store(src)[1]
    assert "Join" not in plan(report)
    got = {(r.factor_key, r.source): (r.source_rows, r.conflict_rows, r.new_rows, r.action) for r in report.collect()}
    assert got == {("f", "a"): (2, 2, 0, "canonical"), ("f", "b"): (2, 2, 0, "conflicted"), ("f", "c"): (2, 2, 0, "conflicted"),
                   ("g_1", "d"): (2, 0, 2, "create"), ("g_1", "e"): (2, 0, 2, "create")}


def test_dates_around_missing_scores_are_stored_step_by_step(spark):
    """Below a ranked step the dates go by, not every key of every date."""
    rows = [(f"2024-01-{d:02d}", f"N{i}") for d in range(1, 29) for i in range(5) if (d + i) % 6]
    df = S.durable(spark.createDataFrame(rows, "trade_date string, instrument string").withColumn("trade_date", F.col("trade_date").cast("date")))
    missing = S.durable(df.where("instrument = 'N3' and trade_date in ('2024-01-14', '2024-01-27')"))
    own = defaultdict(list)
    for d, i in sorted(rows):
        own[i].append(d)
    for stages in ((0, 2, 3), (1, 2), 2, (0, 0, 1)):
        first, *below = (stages,) if isinstance(stages, int) else stages
        want = {d for k, d in enumerate(own["N3"]) if {"2024-01-14", "2024-01-27"} & set(own["N3"][k : k + first + 1])}
        for n in below:
            want = {d for days in own.values() for k, d in enumerate(days) if want & set(days[k : k + n + 1])}
        found = C.context_dates(df, missing, stages)
        assert {str(r[0]) for r in found.collect()} == want, stages
        assert "Exchange" not in plan(found)


def test_only_stored_nulls_meet_the_warm_up(spark):
    df = S.durable(spark.createDataFrame([(d, i, None if d == 3 or d < 2 else 1.0) for d in range(5) for i in ("a", "b")], "trade_date int, instrument string, score double"))
    kept = C.trusted_cache(df, df, 1)
    assert {tuple(r) for r in kept.collect()} == {(0, i, None) for i in "ab"} | {(d, i, 1.0) for d in (2, 4) for i in "ab"}
    assert "LeftOuter" not in plan(kept) and "LeftSemi" in plan(kept)


def test_a_composite_of_columns_equals_the_long_way_without_a_pivot(spark):
    df = S.durable(panel(spark, SF))
    for how in ("zscore", "rank"):
        for wide in (False, True):
            out = [M.composite(f(df), MEMBERS, how, CrossSection(wide=wide), M.apriori_weights(list(MEMBERS)), 2) for f in (member_columns, member_scores)]
            a, b = ({(r.trade_date, r.instrument): (None if r.score is None else round(r.score, 9), r.degenerate) for r in o.collect()} for o in out)
            assert a == b and len(a) == df.count(), (how, wide)
        text = plan(M.composite(member_columns(df), MEMBERS, how, CrossSection(), M.apriori_weights(list(MEMBERS))))
        assert text.count("Exchange hashpartitioning") == 1 and "Aggregate" not in text and "Generate" not in text


def test_a_fitted_composite_builds_the_panel_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(synthesis_queries, "panel", lambda s, d: made.append(d) or panel(s, d))
    assert "l_shipdate" not in plan(QUERIES["m13_combine_fitted"](spark, SF)) and len(made) == 1
