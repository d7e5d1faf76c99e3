"""Registered queries: candidate scoring, gates, de-duplication, rounds, prescreens.

Candidates are the parts: each is a formula proposed by the research run of its brand, with
metrics measured on its order lines and one sample segment per return flag.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswind.operators import candidates as R
from crosswind.plans.backtest_queries import BASE, backtest
from crosswind.plans.panel_queries import with_sql
from crosswind.plans.registry import panel_sql, query, register
from crosswind.plans.score_queries import DEFS_SQL, definitions
from crosswind.session import WIDE_GROUP_ROWS, table_rows
from crosswind.sources.panel import table


def r9(x):
    """Finer rounding: ratios of small counts often end exactly on a tie at six digits."""
    return F.round(x, 9)


LINES_SQL = """
ln AS (
  SELECT l_partkey AS seq, COUNT(*) AS n, CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS dd, CAST(SUM(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tt,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qq, COUNT(*) FILTER (WHERE l_returnflag = 'A') AS na, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS nr,
         COUNT(*) FILTER (WHERE l_returnflag = 'N') AS nn FROM lineitem GROUP BY 1)"""
CAND_SQL = (
    DEFS_SQL.strip().rstrip()
    + ","
    + LINES_SQL
    + """,
cand0 AS (
  SELECT p_partkey AS seq, 'F' || CAST(p_partkey AS VARCHAR) AS factor_id, p_brand AS run_id, 'S' || p_type AS seed_id, p_size AS size,
         CASE WHEN p_size % 2 = 1 THEN 'negative' ELSE 'positive' END AS expected_direction, f.formula, f.horizon, f.filters,
         (CAST(dd AS DOUBLE) / n - 5) / 50 AS rank_ic_mean, (CAST(tt AS DOUBLE) / n - 4) / 5 AS rank_icir, CAST(dd - tt AS DOUBLE) / n / 5 AS split_icir,
         CAST(na AS DOUBLE) / n AS coverage, n AS ic_days, qq AS observations, n // 3 AS periods,
         CASE WHEN n >= 26 THEN CAST(dd - tt - n AS DOUBLE) / n / 10 END AS net_annual, CASE WHEN n >= 24 THEN CAST(dd - tt AS DOUBLE) / n / 10 END AS gross_annual,
         CASE WHEN n >= 25 THEN CAST(tt AS DOUBLE) / n - 3.9 END AS net_sharpe, CASE WHEN n >= 22 THEN -CAST(tt AS DOUBLE) / n / 25 END AS net_drawdown,
         CASE WHEN n >= 23 THEN CAST(nr AS DOUBLE) / n * 2 END AS rebalance_rate, CASE WHEN n >= 23 THEN CAST(nn AS DOUBLE) / n * 4 END AS turnover_rate,
         CASE WHEN n >= 27 THEN CAST(nr - nn AS DOUBLE) / n END AS active_correlation
  FROM part JOIN defs f ON f.seq = p_partkey LEFT JOIN ln ON ln.seq = p_partkey),
cand AS (SELECT *, split_icir / 10.0 * CAST(0.4 AS DOUBLE) + rank_ic_mean * CAST(0.25 AS DOUBLE) + rank_icir / 10.0 * CAST(0.2 AS DOUBLE) + net_annual * CAST(0.1 AS DOUBLE) + net_drawdown * CAST(0.05 AS DOUBLE) AS score FROM cand0),
seg AS (
  SELECT 'F' || CAST(l_partkey AS VARCHAR) AS factor_id, CASE l_returnflag WHEN 'A' THEN 'IS' WHEN 'N' THEN 'OOS1' ELSE 'OOS2' END AS segment,
         GREATEST(COUNT(*) - 5, 0) AS periods, CASE WHEN COUNT(*) >= 5 THEN CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) - 4 * COUNT(*) AS DOUBLE) / COUNT(*) / 10 END AS net_annual
  FROM lineitem GROUP BY 1, 2)"""
)


def candidates(spark, d):
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("seq")).agg(
        F.count(F.lit(1)).alias("n"), cents("l_discount").alias("dd"), cents("l_tax").alias("tt"), F.sum(F.col("l_quantity").cast("bigint")).alias("qq"),
        flag("A").alias("na"), flag("R").alias("nr"), flag("N").alias("nn"),
    )
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), "p_brand", "p_type", "p_size")
    defs = definitions(spark, d).select("seq", "formula", "horizon", "filters")
    n, x = F.col("n"), lambda e: F.col(e).cast("double") / F.col("n")
    ratio = lambda e: F.expr(e).cast("double") / n
    df = parts.join(defs, "seq").join(lines, "seq", "left")
    df = df.select(
        "seq",
        F.concat(F.lit("F"), F.col("seq").cast("string")).alias("factor_id"),
        F.col("p_brand").alias("run_id"),
        F.concat(F.lit("S"), F.col("p_type")).alias("seed_id"),
        F.col("p_size").alias("size"),
        F.when(F.col("p_size") % 2 == 1, "negative").otherwise("positive").alias("expected_direction"),
        "formula", "horizon", "filters",
        ((x("dd") - 5) / 50).alias("rank_ic_mean"),
        ((x("tt") - 4) / 5).alias("rank_icir"),
        (ratio("dd - tt") / 5).alias("split_icir"),
        x("na").alias("coverage"),
        n.alias("ic_days"),
        F.col("qq").alias("observations"),
        F.floor(n / 3).alias("periods"),
        F.when(n >= 26, ratio("dd - tt - n") / 10).alias("net_annual"),
        F.when(n >= 24, ratio("dd - tt") / 10).alias("gross_annual"),
        F.when(n >= 25, x("tt") - 3.9).alias("net_sharpe"),
        F.when(n >= 22, -x("tt") / 25).alias("net_drawdown"),
        F.when(n >= 23, x("nr") * 2).alias("rebalance_rate"),
        F.when(n >= 23, x("nn") * 4).alias("turnover_rate"),
        F.when(n >= 27, ratio("nr - nn")).alias("active_correlation"),
    )
    return df.withColumn("score", R.objective_score("balanced"))


def segments(spark, d):
    name = F.when(F.col("l_returnflag") == "A", "IS").when(F.col("l_returnflag") == "N", "OOS1").otherwise("OOS2")
    g = table(spark, d, "lineitem").groupBy(F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("factor_id"), name.alias("segment"))
    agg = g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("dd"))
    return agg.select(
        "factor_id", "segment", F.greatest(F.col("n") - 5, F.lit(0)).alias("periods"),
        F.when(F.col("n") >= 5, (F.col("dd") - 4 * F.col("n")).cast("double") / F.col("n") / 10).alias("net_annual"),
    )


def wide(spark, d) -> bool:
    """A run holds at most all parts; beyond one task's size the range-sorted path ranks them."""
    return table_rows(spark, f"{d}/part.parquet") > WIDE_GROUP_ROWS


def ranked(spark, d):
    return R.rank_trials(candidates(spark, d), wide=wide(spark, d))


RANK_SQL = """
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY score DESC NULLS LAST, split_icir DESC NULLS LAST, rank_ic_mean DESC NULLS LAST, seq) AS place,
       COUNT(*) OVER (PARTITION BY run_id) AS total FROM cand)"""


def listed(name: str):
    return F.array_join(name, "; ").alias(name)


register(
    "r01_objective_score",
    lambda spark, d: candidates(spark, d).select(
        "factor_id", *[r9(R.objective_score(o)).alias(o) for o in R.OBJECTIVES]
    ),
    with_sql(
        "SELECT factor_id, "
        + ", ".join(
            "ROUND(" + " + ".join(
                f"{m} * CAST({w} AS DOUBLE)" for m, w in zip(("split_icir / 10.0", "rank_ic_mean", "rank_icir / 10.0", "net_annual", "net_drawdown"), ws, strict=True) if w > 0
            ) + f", 9) AS {o}"
            for o, ws in R.OBJECTIVES.items()
        )
        + " FROM cand",
        CAND_SQL,
    ),
)
register(
    "r02_trial_ranking",
    lambda spark, d: ranked(spark, d).select("run_id", "factor_id", "place", "total"),
    with_sql("SELECT run_id, factor_id, place, total FROM rk", CAND_SQL, RANK_SQL),
)
register(
    "r03_successive_halving",
    lambda spark, d: R.survivors(ranked(spark, d), 0.3, 4).select("run_id", "factor_id", "place"),
    with_sql("SELECT run_id, factor_id, place FROM rk WHERE place <= LEAST(total, GREATEST(4, CEIL(total * CAST(0.3 AS DOUBLE))))", CAND_SQL, RANK_SQL),
)
PROFILES = [(0.2, 0), (0.3, 0), (0.3, 5), (0.4, 10)]
register(
    "r04_parameter_grid",
    lambda spark, d: R.parameter_grid(candidates(spark, d).select("factor_id"), PROFILES),
    with_sql(
        "SELECT factor_id, config_id, top_quantile, decay_days FROM cand, (VALUES "
        + ", ".join(f"({i}, CAST({q} AS DOUBLE), {k})" for i, (q, k) in enumerate(PROFILES))
        + ") AS p(config_id, top_quantile, decay_days)",
        CAND_SQL,
    ),
)

GATE = R.Gate(20, 0.25, 0.0, 7, 0.0, 0.8, 1.5, 0.3, 0.5, True)
SEG_SQL = """
sf AS (
  SELECT factor_id, list(segment || ' net_annualized_return below threshold' ORDER BY segment) FILTER (WHERE segment LIKE 'OOS%' AND net_annual IS NOT NULL AND periods > 0 AND net_annual < 0.0) AS violations,
         list('INSUFFICIENT_OOS_EVIDENCE: ' || segment || ' net_annualized_return unavailable' ORDER BY segment) FILTER (WHERE segment LIKE 'OOS%' AND NOT (net_annual IS NOT NULL AND periods > 0)) AS missing,
         COUNT(*) FILTER (WHERE segment LIKE 'OOS%') AS noos,
         MAX(net_annual) FILTER (WHERE segment = 'IS' AND periods > 0) AS is_return, MIN(net_annual) FILTER (WHERE segment LIKE 'OOS%' AND periods > 0) AS worst_oos
  FROM seg GROUP BY 1),
sg AS (SELECT *, COALESCE(CASE WHEN is_return > 0 THEN (is_return - worst_oos) / is_return > 0.5 ELSE worst_oos < is_return END, FALSE) AS decays,
       is_return IS NOT NULL AND worst_oos IS NOT NULL AS has_evidence FROM sf),
cg AS (
  SELECT c.*, COALESCE(violations, []) AS violations, CASE WHEN COALESCE(noos, 0) = 0 THEN ['INSUFFICIENT_OOS_EVIDENCE: no OOS net_annualized_return evidence'] ELSE COALESCE(missing, []) END AS missing,
         COALESCE(decays, FALSE) AS decays, COALESCE(has_evidence, FALSE) AS has_evidence, is_return, worst_oos,
         CASE WHEN net_annual IS NOT NULL AND gross_annual IS NOT NULL THEN CASE WHEN gross_annual <= 0 THEN CASE WHEN net_annual >= gross_annual THEN 1.0 ELSE 0.0 END ELSE net_annual / gross_annual END END AS retention
  FROM cand c LEFT JOIN sg USING (factor_id))"""
TURN_SQL = (
    "CASE WHEN rebalance_rate IS NULL THEN 'INSUFFICIENT_EVIDENCE: rebalance_rate evidence is unavailable' WHEN rebalance_rate > 0.8 THEN 'rebalance_rate above threshold' END, "
    "CASE WHEN turnover_rate IS NULL THEN 'INSUFFICIENT_EVIDENCE: turnover_rate evidence is unavailable' WHEN turnover_rate > 1.5 THEN 'turnover_rate above threshold' END"
)
RETAIN_SQL = "CASE WHEN retention < 0.3 THEN 'net_return_retention below threshold' END"
RETAIN_GONE = "CASE WHEN retention IS NULL THEN 'INSUFFICIENT_EVIDENCE: net/gross annualized return evidence is missing' END"
DECAY_SQL = "CASE WHEN decays THEN 'OOS net return decay exceeds threshold' END"
DECAY_GONE = "CASE WHEN NOT decays AND NOT has_evidence THEN 'INSUFFICIENT_OOS_EVIDENCE: IS/OOS net_annualized_return evidence is missing' END"
BASIC_SQL = (
    "CASE WHEN ic_days IS NULL OR ic_days < 20 THEN 'ic_days below threshold' END, CASE WHEN coverage IS NULL OR coverage < 0.25 THEN 'coverage below threshold' END, "
    "CASE WHEN periods IS NULL OR periods < 7 THEN 'backtest_periods below threshold' END, CASE WHEN score IS NULL OR score < 0 THEN 'score below threshold' END"
)
drop_null = "list_filter([{}], lambda e: e IS NOT NULL)".format
SMOKE_LIST = (
    f"list_concat({drop_null(BASIC_SQL)}, violations, {drop_null(RETAIN_SQL)}, {drop_null(DECAY_SQL)}, {drop_null(TURN_SQL)}, missing, {drop_null(RETAIN_GONE)}, {drop_null(DECAY_GONE)})"
)
GATED_SQL = f"gt AS (SELECT *, {SMOKE_LIST} AS blocking, len({SMOKE_LIST}) = 0 AS passed FROM cg)"


def gated(spark, d):
    return R.smoke_gate(candidates(spark, d), segments(spark, d), GATE)


register(
    "r05_smoke_gate",
    lambda spark, d: gated(spark, d).select("factor_id", "passed", listed("blocking"), listed("warnings")),
    with_sql("SELECT factor_id, passed, array_to_string(blocking, '; ') AS blocking, '' AS warnings FROM gt", CAND_SQL, SEG_SQL, GATED_SQL),
)
register(
    "r06_oos_return_gate",
    lambda spark, d: R.oos_return_findings(segments(spark, d), 0.0).select("factor_id", listed("violations"), listed("missing")),
    with_sql(
        "SELECT factor_id, COALESCE(array_to_string(violations, '; '), '') AS violations, CASE WHEN noos = 0 THEN 'INSUFFICIENT_OOS_EVIDENCE: no OOS net_annualized_return evidence' "
        "ELSE COALESCE(array_to_string(missing, '; '), '') END AS missing FROM sf",
        CAND_SQL, SEG_SQL,
    ),
)
register(
    "r07_oos_decay_gate",
    lambda spark, d: R.oos_decay_findings(segments(spark, d), 0.5).select("factor_id", r9("is_return").alias("is_return"), r9("worst_oos").alias("worst_oos"), "decays", "has_evidence"),
    with_sql("SELECT factor_id, ROUND(is_return, 9) AS is_return, ROUND(worst_oos, 9) AS worst_oos, decays, has_evidence FROM sg", CAND_SQL, SEG_SQL),
)
register(
    "r08_retention_gate",
    lambda spark, d: candidates(spark, d).select("factor_id", r9(R.retention(F.col("net_annual"), F.col("gross_annual"))).alias("retention")),
    with_sql("SELECT factor_id, ROUND(retention, 9) AS retention FROM cg", CAND_SQL, SEG_SQL),
)
register(
    "r09_turnover_gate",
    lambda spark, d: candidates(spark, d).select("factor_id", F.array_join(R.tokens(*R.turnover_findings(GATE)), "; ").alias("findings")),
    with_sql(f"SELECT factor_id, array_to_string({drop_null(TURN_SQL)}, '; ') AS findings FROM cand", CAND_SQL),
)
FULL = R.CandidateGate(
    0.0, 0.2, 300, 20, -0.01, -0.05, -0.2, -0.3, -0.17, 0.2, R.Gate(min_oos_return=0.0, max_rebalance_rate=0.8, max_turnover_rate=1.5, min_retention=0.3, max_oos_decay=0.5, missing_blocks=False), False
)
TURN = "CASE WHEN expected_direction = 'negative' THEN -1 ELSE 1 END"
low_sql = lambda v, t, n: f"CASE WHEN {v} IS NULL OR {v} < {t} THEN '{n} below threshold' END"
FULL_SQL = ", ".join(
    [
        low_sql("coverage", 0.2, "coverage"), low_sql("observations", 300, "observations"), low_sql("ic_days", 20, "ic_days"),
        low_sql(f"(rank_ic_mean * {TURN})", -0.01, "direction_adjusted_rank_ic"), low_sql(f"(rank_icir * {TURN})", -0.05, "direction_adjusted_rank_ic_ir"),
        "CASE WHEN COALESCE(score, 0) < 0 THEN 'score below threshold' END",
        low_sql(f"(COALESCE(net_annual, gross_annual) * {TURN})", -0.2, "direction_adjusted_total_return"),
        low_sql(f"(net_sharpe * {TURN})", -0.3, "direction_adjusted_sharpe"), low_sql("net_drawdown", -0.17, "max_drawdown"),
        "CASE WHEN active_correlation IS NULL THEN 'INSUFFICIENT_EVIDENCE: active-factor correlation is missing' WHEN ABS(active_correlation) > 0.2 THEN 'TOO_CLOSE_TO_ACTIVE_FACTOR' END",
    ]
)
register(
    "r10_candidate_gate",
    lambda spark, d: R.candidate_gate(candidates(spark, d), segments(spark, d), FULL).select("factor_id", "passed", listed("blocking"), listed("warnings")),
    with_sql(
        "SELECT factor_id, len(b) = 0 AS passed, array_to_string(b, '; ') AS blocking, array_to_string(w, '; ') AS warnings FROM (SELECT factor_id, "
        f"list_concat({drop_null(FULL_SQL)}, violations, {drop_null(RETAIN_SQL)}, {drop_null(DECAY_SQL)}) AS b, "
        f"list_concat(missing, {drop_null(RETAIN_GONE)}, {drop_null(DECAY_GONE)}, {drop_null(TURN_SQL)}) AS w FROM cg)",
        CAND_SQL, SEG_SQL,
    ),
)

# --- de-duplication -----------------------------------------------------------------

FP_SQL = """
fp AS (
  SELECT *, upper(substr(sha1('formula|' || lower(regexp_replace(formula, '\\s+', '', 'g')) || '|' || CAST(horizon AS VARCHAR) || '|' || lower(regexp_replace(filters, '\\s+', '', 'g'))), 1, 16)) AS fingerprint,
         upper(substr(sha1('shape|' || array_to_string(list_sort(list_distinct(regexp_extract_all(lower(formula), '([a-z_][a-z_0-9]*)', 1))), ',') || '|' || CAST(horizon AS VARCHAR) || '|' || lower(regexp_replace(filters, '\\s+', '', 'g'))), 1, 16)) AS shape
  FROM cand),
firsts AS (SELECT run_id, shape, fingerprint, MIN(seq) AS first FROM fp WHERE fingerprint NOT IN (SELECT fingerprint FROM fp WHERE size = 7) GROUP BY 1, 2, 3),
taken AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, shape ORDER BY first) AS place FROM firsts) WHERE place <= 2),
dup AS (
  SELECT fp.*, fingerprint IN (SELECT fingerprint FROM fp WHERE size = 7) OR COALESCE(seq <> first, FALSE) AS duplicate_formula, first IS NOT NULL AS got
  FROM fp LEFT JOIN taken USING (run_id, shape, fingerprint)),
divc AS (SELECT *, NOT duplicate_formula AND NOT got AS over_diversity_cap FROM dup)"""


def deduped(spark, d):
    c = R.with_fingerprints(candidates(spark, d))
    return R.label_candidates(c, c.where("size = 7"))


register(
    "r11_dedupe_formula",
    lambda spark, d: deduped(spark, d).select("factor_id", "fingerprint", "duplicate_formula"),
    with_sql("SELECT factor_id, fingerprint, duplicate_formula FROM dup", CAND_SQL, FP_SQL),
)
register(
    "r12_diversity_cap",
    lambda spark, d: deduped(spark, d).select("factor_id", "shape", "over_diversity_cap"),
    with_sql("SELECT factor_id, shape, over_diversity_cap FROM divc", CAND_SQL, FP_SQL),
)
register(
    "r12_skip_counts",
    lambda spark, d: R.skip_counts(deduped(spark, d)),
    with_sql(
        "SELECT run_id, COUNT(*) FILTER (WHERE duplicate_formula) AS formula_skipped, COUNT(*) FILTER (WHERE over_diversity_cap) AS diversity_skipped, "
        "COUNT(*) FILTER (WHERE NOT duplicate_formula AND NOT over_diversity_cap) AS accepted FROM divc GROUP BY 1",
        CAND_SQL, FP_SQL,
    ),
)
SIG_SQL = (
    "sg1 AS (SELECT *, upper(substr(sha1('result|' || "
    + " || '|' || ".join(f"COALESCE(printf('%.6f', CAST({m} AS DOUBLE)), 'missing')" for m in R.SIGNATURE_METRICS)
    + "), 1, 16)) AS signature FROM {src})"
)
COARSE = "cc AS (SELECT * REPLACE (FLOOR(rank_ic_mean * 1000) AS rank_ic_mean, NULL AS rank_icir, NULL AS coverage, NULL AS ic_days, NULL AS net_annual, NULL AS net_sharpe, NULL AS net_drawdown, NULL AS rebalance_rate, NULL AS turnover_rate) FROM cand)"


@query(
    "r13_result_signature",
    with_sql("SELECT factor_id, signature FROM sg1", CAND_SQL, SIG_SQL.format(src="cand")),
)
def signature(spark, d):
    return candidates(spark, d).select("factor_id", R.result_signature().alias("signature"))


@query(
    "r13_result_duplicates",
    with_sql(
        "SELECT factor_id, signature, seq <> MIN(seq) OVER s AS duplicate_result, CASE WHEN seq <> MIN(seq) OVER s THEN FIRST_VALUE(factor_id) OVER (PARTITION BY signature ORDER BY seq) END AS duplicate_of "
        "FROM sg1 WINDOW s AS (PARTITION BY signature)",
        CAND_SQL, COARSE, SIG_SQL.format(src="cc"),
    ),
)
def result_duplicates(spark, d):
    """Coarse results (only the floored IC) collide, so later ones are flagged."""
    c = candidates(spark, d).withColumn("rank_ic_mean", F.floor(F.col("rank_ic_mean") * 1000))
    c = c.withColumns({m: F.lit(None).cast("double") for m in R.SIGNATURE_METRICS[1:]})
    flagged = R.flag_result_duplicates(c.withColumn("signature", R.result_signature()))
    return flagged.select("factor_id", "signature", "duplicate_result", "duplicate_of")


@query(
    "r14_comparison_rows",
    with_sql(
        "SELECT 'candidate' AS role, c.factor_id, run_id, ROUND(rank_ic_mean, 9) AS rank_ic_mean, ROUND(i.net_annual, 9) AS selection_net_annual, CAST(i.periods AS DOUBLE) AS selection_periods, "
        "ROUND(o.net_annual, 9) AS oos_net_annual, CAST(o.periods AS DOUBLE) AS oos_periods FROM cand c LEFT JOIN seg i ON i.factor_id = c.factor_id AND i.segment = 'IS' "
        "LEFT JOIN seg o ON o.factor_id = c.factor_id AND o.segment = 'OOS2' UNION ALL "
        "SELECT 'seed', seed_id, run_id, ROUND(MAX(rank_ic_mean), 9), NULL, NULL, NULL, NULL FROM cand GROUP BY seed_id, run_id",
        CAND_SQL,
    ),
)
def comparison(spark, d):
    c, s = candidates(spark, d), segments(spark, d)
    pick = lambda name: s.where(F.col("segment") == name).select("factor_id", r9("net_annual").alias("net_annual"), F.col("periods").cast("double").alias("periods"))
    rows = R.comparison_rows(c.select("factor_id", "run_id", r9("rank_ic_mean").alias("rank_ic_mean")), pick("IS"), pick("OOS2"))
    seeds = c.groupBy(F.col("seed_id").alias("factor_id"), "run_id").agg(r9(F.max("rank_ic_mean")).alias("rank_ic_mean"))
    return rows.withColumn("role", F.lit("candidate")).unionByName(seeds.withColumn("role", F.lit("seed")), allowMissingColumns=True)


RESULT_SQL = """
sv AS (SELECT factor_id, CASE WHEN is_return > 0 THEN 1.0 - worst_oos / is_return END AS oos_decay FROM sg),
res AS (SELECT divc.*, gt.passed AND score IS NOT NULL AS passed, gt.blocking, oos_decay, CASE WHEN size % 11 = 0 THEN 'failed' WHEN score IS NULL THEN 'failed' ELSE 'result' END AS status,
        size % 13 = 0 AS duplicate_result, CAST(0.01 AS DOUBLE) AS seed_score FROM divc JOIN (SELECT factor_id, passed, blocking FROM gt) gt USING (factor_id) LEFT JOIN sv USING (factor_id))"""


def results(spark, d):
    full = deduped(spark, d)
    judged = gated(spark, d).select("factor_id", "passed", "blocking")
    df = full.join(judged, "factor_id").join(R.oos_decay_value(segments(spark, d)), "factor_id", "left")
    failed = (F.col("size") % 11 == 0) | F.col("score").isNull()
    return df.withColumns(
        {
            "passed": F.col("passed") & F.col("score").isNotNull(),
            "status": F.when(failed, "failed").otherwise("result"),
            "duplicate_result": F.col("size") % 13 == 0,
            "seed_score": F.lit(0.01),
        }
    )


ROUND_SQL = """
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY score DESC, split_icir DESC, rank_ic_mean DESC, seq) AS rn FROM res WHERE status = 'result') WHERE rn = 1),
rnd AS (
  SELECT r.run_id, planned_count, candidate_count, duplicate_count, LEAST(1.0, duplicate_count / CAST(planned_count AS DOUBLE)) AS duplicate_rate, seed_score, accepted_count,
         b.score AS best_score, b.score - seed_score AS score_delta, b.factor_id AS winner, b.oos_decay AS winner_oos_decay, array_to_string(b.blocking, '; ') AS winner_reasons
  FROM (SELECT run_id, COUNT(*) AS planned_count, COUNT(*) FILTER (WHERE status = 'result') AS candidate_count, COUNT(*) FILTER (WHERE duplicate_formula OR over_diversity_cap OR duplicate_result) AS duplicate_count,
               COUNT(*) FILTER (WHERE status = 'result' AND passed) AS accepted_count, MAX(seed_score) AS seed_score FROM res GROUP BY 1) r LEFT JOIN (SELECT run_id, score, factor_id, oos_decay, blocking FROM best) b USING (run_id))"""
ALL_RES = (CAND_SQL, SEG_SQL, GATED_SQL, FP_SQL, RESULT_SQL)
register(
    "r15_round_summary",
    lambda spark, d: R.round_summary(results(spark, d)).select(
        "run_id", "planned_count", "candidate_count", "duplicate_count", "accepted_count", "winner", listed("winner_reasons"),
        *[r9(c).alias(c) for c in ("duplicate_rate", "best_score", "score_delta", "winner_oos_decay")],
    ),
    with_sql(
        "SELECT run_id, planned_count, candidate_count, duplicate_count, accepted_count, winner, winner_reasons, ROUND(duplicate_rate, 9) AS duplicate_rate, ROUND(best_score, 9) AS best_score, "
        "ROUND(score_delta, 9) AS score_delta, ROUND(winner_oos_decay, 9) AS winner_oos_decay FROM rnd",
        *ALL_RES, ROUND_SQL,
    ),
)

# The trace of research rounds: every event is one entry of a user's seed chain.
TRACE_SQL = """
tr AS (
  SELECT event_id AS seq, 'seed' || CAST(user_id % 40 AS VARCHAR) AS seed_id, CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id,
         CASE event_type WHEN 'click' THEN 'experiment_result' WHEN 'view' THEN 'plan_blocked' WHEN 'error' THEN 'experiment_failed' WHEN 'purchase' THEN 'round_summary' ELSE 'hypothesis' END AS phase,
         event_id % 3 = 0 AS duplicate_plan, CASE WHEN event_id % 4 <> 0 THEN value / 500 END AS duplicate_rate, CASE WHEN event_id % 5 <> 0 THEN (value - 50) / 100 END AS score_delta,
         CASE WHEN event_id % 6 <> 0 THEN value / 100 END AS oos_decay,
         CASE event_id % 7 WHEN 0 THEN 'turnover_rate above threshold' WHEN 1 THEN 'max_drawdown below threshold' ELSE '' END AS gate_reason,
         value > 40 AS accepted, 'rank(' || props || ')' AS formula
  FROM events)"""
CTX_SQL = """
ctx AS (
  SELECT seed_id, COUNT(DISTINCT run_id) AS round_index, COUNT(*) FILTER (WHERE phase = 'experiment_result') AS candidate_count, COUNT(*) FILTER (WHERE phase = 'experiment_failed') AS failed_count,
         COUNT(*) FILTER (WHERE phase = 'plan_blocked') AS blocked_count, COUNT(*) FILTER (WHERE phase = 'plan_blocked' AND duplicate_plan) AS dups,
         MAX(seq) FILTER (WHERE phase = 'round_summary') AS last_seq, COUNT(DISTINCT formula) FILTER (WHERE phase = 'experiment_result' AND accepted) AS mechanisms FROM tr GROUP BY 1),
ctx2 AS (SELECT c.seed_id, round_index, candidate_count, failed_count, blocked_count, mechanisms, t.score_delta, t.oos_decay, COALESCE(t.gate_reason, '') AS gate_reason,
         GREATEST(0.0, LEAST(1.0, COALESCE(t.duplicate_rate, dups / CAST(NULLIF(candidate_count + failed_count + blocked_count, 0) AS DOUBLE), 0.0))) AS duplicate_rate
         FROM ctx c LEFT JOIN tr t ON t.seq = c.last_seq)"""


def trace(spark, d):
    k, v = F.col("event_id"), F.col("value")
    phase = F.when(F.col("event_type") == "click", "experiment_result")
    for kind, name in (("view", "plan_blocked"), ("error", "experiment_failed"), ("purchase", "round_summary")):
        phase = phase.when(F.col("event_type") == kind, name)
    return table(spark, d, "events").select(
        k.alias("seq"),
        F.concat(F.lit("seed"), (F.col("user_id") % 40).cast("string")).alias("seed_id"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("run_id"),
        phase.otherwise("hypothesis").alias("phase"),
        (k % 3 == 0).alias("duplicate_plan"),
        F.when(k % 4 != 0, v / 500).alias("duplicate_rate"),
        F.when(k % 5 != 0, (v - 50) / 100).alias("score_delta"),
        F.when(k % 6 != 0, v / 100).alias("oos_decay"),
        F.when(k % 7 == 0, "turnover_rate above threshold").when(k % 7 == 1, "max_drawdown below threshold").otherwise("").alias("gate_reason"),
        (v > 40).alias("accepted"),
        F.concat(F.lit("rank("), F.col("props"), F.lit(")")).alias("formula"),
    )


CTX_COLUMNS = "seed_id, round_index, candidate_count, failed_count, blocked_count, mechanisms, gate_reason, ROUND(duplicate_rate, 9) AS duplicate_rate, ROUND(score_delta, 9) AS score_delta, ROUND(oos_decay, 9) AS oos_decay"


def rounded_context(df):
    return df.withColumns({c: r9(c) for c in ("duplicate_rate", "score_delta", "oos_decay")})


register(
    "r16_strategy_context",
    lambda spark, d: rounded_context(R.strategy_context(trace(spark, d))),
    with_sql(f"SELECT {CTX_COLUMNS} FROM ctx2", TRACE_SQL, CTX_SQL),
)
register(
    "r17_strategy_rules",
    lambda spark, d: R.strategy_label(R.strategy_context(trace(spark, d))).select("seed_id", "strategy", "rule"),
    with_sql(
        "SELECT seed_id, CASE rule WHEN 'R2' THEN 'simplify' WHEN 'R3' THEN 'parameter_search' WHEN 'R4' THEN 'exploit' WHEN 'R5' THEN 'recombine' ELSE 'explore' END AS strategy, rule FROM "
        "(SELECT seed_id, CASE WHEN candidate_count = 0 OR duplicate_rate > 0.5 THEN 'R1' WHEN oos_decay > 0.5 OR contains(lower(gate_reason), 'drawdown') THEN 'R2' "
        "WHEN gate_reason LIKE 'turnover_rate%' THEN 'R3' WHEN score_delta > 0 AND round_index >= 1 THEN 'R4' WHEN round_index >= 2 AND mechanisms >= 2 AND score_delta <= 0 THEN 'R5' ELSE 'R6' END AS rule FROM ctx2)",
        TRACE_SQL, CTX_SQL,
    ),
)
register(
    "r18_oos_decay_value",
    lambda spark, d: R.oos_decay_value(segments(spark, d)).withColumn("oos_decay", r9("oos_decay")),
    with_sql("SELECT factor_id, ROUND(CASE WHEN is_return > 0 THEN 1.0 - worst_oos / is_return END, 9) AS oos_decay FROM sg", CAND_SQL, SEG_SQL),
)
register(
    "r19_recent_entries",
    lambda spark, d: R.recent_entries(trace(spark, d), ["experiment_result", "plan_blocked"], 25, F.col("seed_id") == "seed7").select("seq", "run_id", "phase"),
    with_sql("SELECT seq, run_id, phase FROM tr WHERE seed_id = 'seed7' AND phase IN ('experiment_result', 'plan_blocked') ORDER BY seq DESC LIMIT 25", TRACE_SQL),
)
register(
    "r20_optimization_status",
    lambda spark, d: R.optimization_status(
        R.round_summary(results(spark, d)).withColumns(
            {"chain": F.substring("run_id", 1, 7), "reason": F.when(F.col("winner_oos_decay") > 0.5, "no_new_seed").otherwise("fallback_best_score")}
        ), ("chain",),
    ),
    with_sql(
        "SELECT chain, generated, performed, CASE WHEN performed THEN 'performed' WHEN generated THEN 'attempted_no_acceptance' ELSE 'no_optimization_performed' END AS status FROM "
        "(SELECT substr(run_id, 1, 7) AS chain, BOOL_OR(candidate_count > 0 AND NOT COALESCE(winner_oos_decay > 0.5, FALSE)) AS generated, BOOL_OR(accepted_count > 0) AS performed FROM rnd GROUP BY 1)",
        *ALL_RES, ROUND_SQL,
    ),
)
register(
    "r20_accepted_ids",
    lambda spark, d: R.accepted_ids(results(spark, d)),
    with_sql("SELECT factor_id, seq AS first_seq FROM res WHERE passed", *ALL_RES),
)


def stated(spark, d):
    """Gated candidates of which some broke off with an error and some were not gated yet, by the last digit of their id."""
    last = F.right("factor_id", F.lit(1))
    return gated(spark, d).withColumns({"error": F.when(last == "7", "ENGINE_ERROR"), "passed": F.when(last != "3", F.col("passed"))})


register(
    "r21_feedback_label",
    lambda spark, d: R.feedback_label(stated(spark, d)).select("factor_id", "feedback", "hint", "requires_user_decision"),
    with_sql(
        "SELECT factor_id, CASE WHEN failed THEN 'failed' WHEN waits THEN 'pending_gate' WHEN passed THEN 'accepted_for_candidate' ELSE 'blocked' END AS feedback, CASE WHEN failed THEN 'REPAIR_ERROR' WHEN waits THEN 'EVALUATE_GATE' WHEN passed THEN 'NEARBY_VARIANTS' WHEN contains(t, 'field') THEN 'MAP_FIELD' "
        "WHEN contains(t, 'operator') THEN 'EXECUTABLE_OPERATORS' WHEN contains(t, 'direction') THEN 'CLARIFY_DIRECTION' WHEN contains(t, 'correlation') THEN 'REDUCE_CORRELATION' "
        "WHEN contains(t, 'turnover') OR contains(t, 'rebalance') THEN 'REDUCE_TURNOVER' WHEN contains(t, 'rank_ic') OR contains(t, 'icir') THEN 'REVISE_SIGNAL' ELSE 'BLOCKING_REASON' END AS hint, "
        "NOT failed AND NOT waits AND NOT passed AND (contains(array_to_string(blocking, '|'), 'missing') OR contains(array_to_string(blocking, '|'), 'unknown')) AS requires_user_decision "
        "FROM (SELECT *, lower(array_to_string(blocking, chr(10))) AS t, factor_id LIKE '%7' AS failed, factor_id LIKE '%3' AS waits FROM gt)",
        CAND_SQL, SEG_SQL, GATED_SQL,
    ),
)
SPEC = R.SubmissionSpec(0.05, 0.02, 0.125, 0.0, None, 1.3, None, None, "US", "CN")
CHECK_SQL = """
ck AS (
  SELECT factor_id, 'sharpe' AS "check", net_sharpe AS value, 0.05 AS threshold, TRUE AS hi FROM cand UNION ALL
  SELECT factor_id, 'fitness', net_sharpe * sqrt(ABS(net_annual) / GREATEST(turnover_rate, 0.125)), 0.02, TRUE FROM cand UNION ALL
  SELECT factor_id, 'annualized_return', net_annual, 0.0, TRUE FROM cand UNION ALL SELECT factor_id, 'turnover_min', NULL, NULL, TRUE FROM cand UNION ALL
  SELECT factor_id, 'turnover_max', turnover_rate, 1.3, FALSE FROM cand UNION ALL SELECT factor_id, 'max_single_name_weight', NULL, NULL, FALSE FROM cand UNION ALL
  SELECT factor_id, 'subwindow_sharpe', NULL, NULL, TRUE FROM cand)"""
register(
    "r22_submission_prescreen",
    lambda spark, d: R.submission_checks(
        candidates(spark, d).withColumns({"max_weight": F.lit(None).cast("double"), "subwindow_sharpe": F.lit(None).cast("double")}), SPEC, "factor_id"
    ).withColumn("value", r9("value")),
    with_sql(
        "SELECT factor_id, \"check\", ROUND(value, 9) AS value, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN threshold IS NULL THEN 'not_configured' WHEN value IS NULL THEN 'not_evaluable' "
        "WHEN CASE WHEN hi THEN value >= threshold ELSE value <= threshold END THEN 'passed' ELSE 'failed' END AS status, 'mismatched' AS region_alignment FROM ck",
        CAND_SQL, CHECK_SQL,
    ),
)
register(
    "r23_fitness",
    lambda spark, d: candidates(spark, d).select("factor_id", r9(R.fitness(F.col("net_sharpe"), F.col("net_annual"), F.col("turnover_rate"), 0.125)).alias("fitness")),
    # GREATEST skips nulls, so the turnover itself must be present.
    with_sql("SELECT factor_id, ROUND(CASE WHEN turnover_rate IS NOT NULL THEN net_sharpe * sqrt(ABS(net_annual) / GREATEST(turnover_rate, 0.125)) END, 9) AS fitness FROM cand", CAND_SQL),
)
register(
    "r24_subwindow_sharpe",
    lambda spark, d: R.subwindow_sharpe(backtest(spark, d, True).period_table).withColumn("subwindow_sharpe", r9("subwindow_sharpe")),
    panel_sql(
        "SELECT run_id, ROUND(MIN(v), 9) AS subwindow_sharpe FROM (SELECT run_id, half, AVG(net_return) / STDDEV_SAMP(net_return) * sqrt(252.0 / MAX(holding)) AS v FROM "
        "(SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY period_id) <= COUNT(*) OVER (PARTITION BY run_id) // 2 AS half FROM ptab WHERE is_complete) GROUP BY 1, 2) GROUP BY 1",
        *BASE,
    ),
)
register(
    "r25_max_single_weight",
    lambda spark, d: R.max_single_weight(backtest(spark, d, True).period_table).withColumn("max_weight", r9("max_weight")),
    panel_sql("SELECT run_id, ROUND(MAX(1.0 / LEAST(long_count, short_count) / 2), 9) AS max_weight FROM ptab GROUP BY 1", *BASE),
)
register(
    "r26_warnings_count",
    lambda spark, d: R.warnings_count(
        gated(spark, d).select("run_id", F.lit("message").alias("kind"), F.explode("blocking").alias("text")).unionByName(
            candidates(spark, d).where("net_annual is null").select("run_id", F.lit("code").alias("kind"), F.lit("INSUFFICIENT_ANNUALIZATION_HISTORY").alias("text"))
        )
    ),
    with_sql(
        "SELECT run_id, COUNT(DISTINCT kind || text) AS warnings_count FROM (SELECT run_id, 'message' AS kind, UNNEST(blocking) AS text FROM gt UNION ALL "
        "SELECT run_id, 'code', 'INSUFFICIENT_ANNUALIZATION_HISTORY' FROM cand WHERE net_annual IS NULL) GROUP BY 1",
        CAND_SQL, SEG_SQL, GATED_SQL,
    ),
)
REVIEW_SQL = (
    "SELECT factor_id, array_to_string(" + drop_null("CASE WHEN rank_ic_mean > 0 THEN 'IC_POSITIVE' END, CASE WHEN split_icir > 0 THEN 'SPLIT_ICIR_POSITIVE' END, CASE WHEN net_sharpe > 0 THEN 'NET_SHARPE_POSITIVE' END")
    + ", '; ') AS strengths, array_to_string(list_concat(" + drop_null(
        "CASE WHEN rank_ic_mean <= 0 THEN 'IC_NOT_POSITIVE' END, CASE WHEN split_icir <= 0 THEN 'SPLIT_ICIR_NOT_POSITIVE' END, CASE WHEN net_sharpe <= 0 THEN 'NET_SHARPE_NOT_POSITIVE' END, "
        "CASE WHEN rebalance_rate > 0.8 THEN 'NAMES_CHANGE_OFTEN' END, CASE WHEN turnover_rate > 1.5 THEN 'WEIGHTS_CHANGE_MUCH' END, CASE WHEN gross_annual > 0 AND net_annual < gross_annual * 0.5 THEN 'COSTS_TAKE_HALF' END, "
        "CASE WHEN net_drawdown < -0.2 THEN 'DEEP_DRAWDOWN' END, CASE WHEN rank_icir < -0.1 THEN 'ICIR_FADES' END, CASE WHEN decays THEN 'RETURN_FADES' END"
    )
    + ", CASE WHEN passed THEN [] ELSE blocking END), '; ') AS risks, CASE WHEN len(s) > 0 THEN array_to_string(s, '; ') ELSE 'TRY_CHEAPER_FORM' END AS next_steps FROM (SELECT *, "
    + drop_null("CASE WHEN rebalance_rate > 0.8 THEN 'HOLD_NAMES_LONGER' END, CASE WHEN turnover_rate > 1.5 THEN 'SMOOTH_WEIGHTS' END, CASE WHEN rank_icir < -0.1 THEN 'TRY_SIMPLER_FORM' END, CASE WHEN decays THEN 'CHECK_LATER_PERIOD' END")
    + " AS s FROM gt)"
)


@query("r27_self_review_flags", with_sql(REVIEW_SQL, CAND_SQL, SEG_SQL, GATED_SQL))
def review(spark, d):
    decays = R.oos_decay_findings(segments(spark, d), 0.5).select("factor_id", F.col("decays").alias("net_decays"))
    df = gated(spark, d).join(decays, "factor_id", "left").withColumn("icir_decays", F.col("rank_icir") < -0.1)
    return R.self_review(df).select("factor_id", listed("strengths"), listed("risks"), listed("next_steps"))


register(
    "r28_next_seed",
    lambda spark, d: R.next_seed(
        R.rank_trials(results(spark, d).withColumn("seed_id", F.when(F.col("run_id") == "Brand#1", F.col("factor_id")).otherwise("none")), wide=wide(spark, d))
    ),
    with_sql(
        "SELECT run_id, COALESCE(acc, best) AS next_seed, CASE WHEN acc IS NOT NULL THEN 'accepted_candidate' WHEN run_id = 'Brand#1' THEN 'best_candidate_is_seed' ELSE 'fallback_best_score' END AS reason FROM "
        "(SELECT run_id, arg_min(factor_id, place) FILTER (WHERE passed AND run_id <> 'Brand#1') AS acc, arg_min(factor_id, place) AS best FROM "
        "(SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY score DESC NULLS LAST, split_icir DESC NULLS LAST, rank_ic_mean DESC NULLS LAST, seq) AS place FROM res) GROUP BY 1)",
        *ALL_RES,
    ),
)


@query(
    "r29_metric_status_overlay",
    with_sql(
        "SELECT factor_id, ROUND(CASE WHEN size % 3 = 0 THEN rank_ic_mean WHEN ic_days >= 28 THEN rank_ic_mean * 2 END, 9) AS rank_ic_mean, "
        "CASE WHEN size % 3 = 0 THEN 'legacy' WHEN ic_days >= 28 THEN 'available' ELSE 'insufficient_sample' END AS rank_ic_mean_status, ROUND(rank_icir, 9) AS rank_icir, 'legacy' AS rank_icir_status FROM cand",
        CAND_SQL,
    ),
)
def overlay(spark, d):
    c = candidates(spark, d)
    metrics = c.where("size % 3 <> 0").select(
        "factor_id", F.lit("rank_ic_mean").alias("metric"), (F.col("rank_ic_mean") * 2).alias("value"),
        F.when(F.col("ic_days") >= 28, "available").otherwise("insufficient_sample").alias("status"),
    )
    out = R.metric_overlay(c.select("factor_id", "rank_ic_mean", "rank_icir"), metrics, ["rank_ic_mean", "rank_icir"])
    return out.withColumns({"rank_ic_mean": r9("rank_ic_mean"), "rank_icir": r9("rank_icir")})
