"""Registered queries: outcomes, promotion, reviews, priors, lineage, runs, goals, registry.

Outcomes, memory rows and reviews come from the event stream; runs, lineage and goals from
orders and order lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswind.operators import ledgers as L
from crosswind.plans.candidate_queries import CAND_SQL, GATED_SQL, SEG_SQL, gated
from crosswind.plans.eval_queries import FACTORS, labelled, lab_sql
from crosswind.plans.panel_queries import ROLE_ROWS, with_sql
from crosswind.plans.registry import panel_sql, query, r6, register
from crosswind.plans.score_queries import CURRENT_SQL, DEFS_SQL, definitions
from crosswind.sources.panel import FIELD_ROLES, table
from crosswind.sources.values import current_definitions

OUTCOME_SQL = """
oc0 AS (
  SELECT event_id AS seq, ts AS observed_at, CASE WHEN user_id % 5 = 0 THEN 'external_plugin' WHEN event_id % 97 = 0 THEN 'stranger' ELSE 'local' END AS origin,
         CASE event_type WHEN 'click' THEN 'gate' WHEN 'view' THEN 'evaluate' WHEN 'error' THEN 'backtest' WHEN 'purchase' THEN 'simulate' ELSE 'submit' END AS stage,
         CASE WHEN value < 15 THEN 'passed' WHEN value < 60 THEN 'blocked' WHEN value < 90 THEN 'unknown' ELSE 'not_applicable' END AS verdict,
         'fp' || CAST(user_id AS VARCHAR) AS factor_fingerprint, strftime(date_trunc('week', ts), '%Y-%m-%d') AS data_window,
         CASE WHEN event_id % 6 = 0 THEN 'out_of_sample' ELSE 'in_sample' END AS sample_role,
         list_extract(['', 'cn_a', 'us'], CAST(user_id % 3 AS INTEGER) + 1) AS asset_class, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'u' || CAST(user_id % 4 AS VARCHAR) END AS universe,
         'fam' || CAST(user_id % 7 AS VARCHAR) AS factor_family, CASE WHEN user_id % 6 = 0 THEN '' WHEN event_id % 53 = 0 THEN 'global' ELSE 'p' || CAST(user_id % 2 AS VARCHAR) END AS settings_profile
  FROM events),
oc1 AS (
  SELECT *, CASE WHEN verdict <> 'blocked' THEN ['NONE'] WHEN seq % 3 = 0 THEN ['SHARPE_BELOW_GATE'] WHEN seq % 3 = 1 THEN ['RETURNS_BELOW_GATE', 'TURNOVER_TOO_HIGH'] ELSE ['VALIDATION_ERROR'] END AS reason_codes,
         CASE WHEN stage <> 'submit' THEN '' WHEN verdict = 'passed' THEN 'accepted' WHEN verdict = 'blocked' THEN 'rejected' WHEN verdict = 'unknown' THEN 'submitted' ELSE '' END AS lifecycle,
         CASE stage WHEN 'simulate' THEN 'platform_simulated' WHEN 'submit' THEN 'submitted_live' ELSE 'local_backtest' END AS evidence_strength FROM oc0),
oc AS (
  SELECT *, sha256('{"factor_fingerprint":"' || factor_fingerprint || '","stage":"' || stage || '","window":"' || data_window || '"}') AS evidence_run_id,
         sha256('{"asset_class":"' || asset_class || '","data_window":"' || data_window || '","factor_family":"' || factor_family || '","factor_fingerprint":"' || factor_fingerprint || '","lifecycle":"' || lifecycle
           || '","origin":"' || origin || '","reason_codes":["' || array_to_string(reason_codes, '","') || '"],"sample_role":"' || sample_role || '","settings_profile":"' || settings_profile || '","stage":"' || stage
           || '","universe":"' || universe || '","verdict":"' || verdict || '"}') AS outcome_id FROM oc1)"""


def outcomes(events):
    k, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    stage = F.when(F.col("event_type") == "click", "gate").when(F.col("event_type") == "view", "evaluate").when(F.col("event_type") == "error", "backtest")
    base = events.select(
        k.alias("seq"),
        F.col("ts").alias("observed_at"),
        F.when(u % 5 == 0, "external_plugin").when(k % 97 == 0, "stranger").otherwise("local").alias("origin"),
        stage.when(F.col("event_type") == "purchase", "simulate").otherwise("submit").alias("stage"),
        F.when(v < 15, "passed").when(v < 60, "blocked").when(v < 90, "unknown").otherwise("not_applicable").alias("verdict"),
        F.concat(F.lit("fp"), u.cast("string")).alias("factor_fingerprint"),
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("data_window"),
        F.when(k % 6 == 0, "out_of_sample").otherwise("in_sample").alias("sample_role"),
        F.when(u % 3 == 0, "").when(u % 3 == 1, "cn_a").otherwise("us").alias("asset_class"),
        F.when(u % 4 == 0, "").otherwise(F.concat(F.lit("u"), (u % 4).cast("string"))).alias("universe"),
        F.concat(F.lit("fam"), (u % 7).cast("string")).alias("factor_family"),
        F.when(u % 6 == 0, "").when(k % 53 == 0, "global").otherwise(F.concat(F.lit("p"), (u % 2).cast("string"))).alias("settings_profile"),
    )
    s, words = F.col("seq"), lambda *w: F.array(*[F.lit(x) for x in w])
    reasons = (
        F.when(F.col("verdict") != "blocked", words("NONE")).when(s % 3 == 0, words("SHARPE_BELOW_GATE"))
        .when(s % 3 == 1, words("RETURNS_BELOW_GATE", "TURNOVER_TOO_HIGH")).otherwise(words("VALIDATION_ERROR"))
    )
    verdict = F.col("verdict")
    life = F.when(F.col("stage") != "submit", "").when(verdict == "passed", "accepted").when(verdict == "blocked", "rejected").when(verdict == "unknown", "submitted").otherwise("")
    return L.with_ids(base.withColumns({"reason_codes": reasons, "lifecycle": life}))


def all_outcomes(spark, d):
    return outcomes(table(spark, d, "events"))


@query(
    "l01_result_to_outcome",
    with_sql(
        "SELECT factor_id, CASE WHEN passed THEN 'passed' ELSE 'blocked' END AS verdict, array_to_string(codes, ',') AS reason_codes, ROUND(COALESCE(net_annual, gross_annual), 9) AS annualized_return, "
        "CASE WHEN net_annual IS NOT NULL THEN 'net' WHEN gross_annual IS NOT NULL THEN 'gross' END AS return_basis, ROUND(ABS(net_drawdown), 9) AS max_drawdown FROM ("
        "SELECT *, CASE WHEN passed THEN ['NONE'] ELSE list_sort(list_distinct(list_filter(list_transform(blocking, lambda r: CASE WHEN r LIKE 'ic_days%' OR r LIKE 'backtest_periods%' OR r LIKE 'INSUFFICIENT%' THEN 'INSUFFICIENT_SAMPLE' "
        "WHEN r LIKE 'coverage%' THEN 'DATA_UNAVAILABLE' WHEN r LIKE 'rebalance_rate%' OR r LIKE 'turnover_rate%' THEN 'TURNOVER_TOO_HIGH' WHEN r LIKE 'net_return_retention%' THEN 'RETURNS_BELOW_GATE' "
        "WHEN r LIKE 'score%' THEN 'OBJECTIVE_SCORE_BELOW_GATE' WHEN r LIKE 'OOS%' THEN 'RETURNS_BELOW_GATE' END), lambda c: c IS NOT NULL))) END AS codes FROM gt) WHERE len(codes) > 0",
        CAND_SQL, SEG_SQL, GATED_SQL,
    ),
)
def result_outcomes(spark, d):
    out = L.results_to_outcomes(gated(spark, d))
    return out.select(
        "factor_id", "verdict", F.array_join("reason_codes", ",").alias("reason_codes"), F.round("annualized_return", 9).alias("annualized_return"),
        "return_basis", F.round("max_drawdown", 9).alias("max_drawdown"),
    )


SIGN_SQL = """
os AS (
  SELECT *, COALESCE(NULLIF(concat_ws(';', CASE WHEN asset_class <> '' THEN 'asset=' || asset_class END, CASE WHEN universe <> '' THEN 'universe=' || universe END), ''), 'global') AS scope
  FROM (SELECT *, UNNEST(reason_codes) AS reason_code FROM oc)),
sig AS (
  SELECT *, sha256('{' || CASE WHEN factor_family <> '' AND settings_profile <> '' THEN '' ELSE '"disambiguator":"' || evidence_run_id || '",' END || '"factor_family":"' || factor_family || '","origin":"' || origin
         || '","reason_code":"' || reason_code || '","scope":"' || scope || '","settings_profile":"' || CASE WHEN settings_profile <> '' THEN settings_profile ELSE 'unknown' END || '","stage":"' || stage
         || '","verdict":"' || verdict || '"}') AS signature FROM os),
ob AS (
  SELECT seq, signature, verdict || ' ' || reason_code AS statement, evidence_run_id AS run_id, observed_at, data_window,
         CASE WHEN verdict <> 'blocked' THEN '' WHEN reason_code = 'VALIDATION_ERROR' THEN 'validation_error' ELSE 'gate_blocked' END AS failure_class, outcome_id AS evidence_ref, scope
  FROM sig WHERE verdict IN ('passed', 'blocked'))"""

register(
    "l02_outcome_ids",
    lambda spark, d: L.outcome_signatures(all_outcomes(spark, d)).select("seq", "reason_code", "evidence_run_id", "outcome_id", "signature", "evidence_strength"),
    with_sql("SELECT seq, reason_code, evidence_run_id, outcome_id, signature, evidence_strength FROM sig", OUTCOME_SQL, SIGN_SQL),
)
register(
    "l03_outcome_to_observations",
    lambda spark, d: L.outcome_observations(all_outcomes(spark, d)).select("seq", "signature", "statement", "run_id", "data_window", "failure_class", "evidence_ref", "scope"),
    with_sql("SELECT seq, signature, statement, run_id, data_window, failure_class, evidence_ref, scope FROM ob", OUTCOME_SQL, SIGN_SQL),
)
INGEST_SQL = with_sql(
    "SELECT outcome_id, MIN(seq) AS seq FROM oc WHERE origin = 'local' AND seq % 4 <> 0 AND outcome_id NOT IN (SELECT outcome_id FROM oc WHERE seq % 4 = 0) GROUP BY 1", OUTCOME_SQL
)


@query("l04_ingest_dedupe", INGEST_SQL)
def ingest(spark, d):
    rows = all_outcomes(spark, d)
    again = rows.where("seq % 4 <> 0 and seq % 10 = 1")
    return L.ingest_outcomes(rows.where("seq % 4 = 0"), rows.where("seq % 4 <> 0").unionByName(again)).select("outcome_id", "seq")


def observations(spark, d, where="true"):
    return L.outcome_observations(all_outcomes(spark, d).where(where))


def promote_sql(source: str, name: str) -> str:
    return f"""
{name}_u AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY signature, run_id ORDER BY observed_at, evidence_ref) AS rn FROM {source}) WHERE rn = 1),
{name}_g AS (SELECT signature, COUNT(*) AS observation_count, COUNT(DISTINCT NULLIF(data_window, '')) AS windows, BOOL_OR(failure_class IN ('gate_blocked', 'validation_error')) AS is_failure,
       MIN(observed_at) AS first_seen, MAX(observed_at) AS last_seen, arg_min(statement, {{'a': observed_at, 'b': run_id, 'c': evidence_ref}}) AS statement, arg_min(scope, {{'a': observed_at, 'b': run_id, 'c': evidence_ref}}) AS scope
       FROM {name}_u GROUP BY 1),
{name} AS (
  SELECT *, 'rule' AS kind, 'needs_human_review' AS status FROM {name}_g WHERE observation_count >= 3 AND windows >= 2
  UNION ALL SELECT *, 'failure', 'active' FROM {name}_g WHERE is_failure AND observation_count >= 2
  UNION ALL SELECT *, 'finding', 'active' FROM {name}_g WHERE NOT is_failure AND observation_count >= 2 AND NOT (observation_count >= 3 AND windows >= 2))"""


PROMOTE_SQL = promote_sql("ob", "pr")
register(
    "l05_promote",
    lambda spark, d: L.promote(observations(spark, d)).select("signature", "kind", "status", "observation_count", "windows", "first_seen", "last_seen", "statement", "scope"),
    with_sql("SELECT signature, kind, status, observation_count, windows, first_seen, last_seen, statement, scope FROM pr", OUTCOME_SQL, SIGN_SQL, PROMOTE_SQL),
)


@query(
    "l05_promotion_refs",
    with_sql("SELECT DISTINCT signature, evidence_ref FROM pr_u WHERE signature IN (SELECT signature FROM pr)", OUTCOME_SQL, SIGN_SQL, PROMOTE_SQL),
)
def refs(spark, d):
    obs = observations(spark, d)
    return L.promotion_refs(obs, L.promote(obs))


@query(
    "l05_promotion_runs",
    with_sql("SELECT signature, run_id, data_window FROM pr_u WHERE signature IN (SELECT signature FROM pr)", OUTCOME_SQL, SIGN_SQL, PROMOTE_SQL),
)
def promoted_runs(spark, d):
    obs = observations(spark, d)
    return L.promotion_runs(obs, L.promote(obs))


EARLY_SQL = ("ob1 AS (SELECT * FROM ob WHERE seq < (SELECT MAX(event_id) / 2 FROM events))", promote_sql("ob1", "p1"))


@query(
    "l06_superseding_rows",
    with_sql(
        "SELECT n.kind, n.signature, n.observation_count, COALESCE(o.statement, n.statement) AS statement, COALESCE(o.first_seen, n.first_seen) AS first_seen, n.last_seen, "
        "COALESCE(o.scope, n.scope) AS scope, o.signature IS NOT NULL AS supersedes_row FROM pr n LEFT JOIN p1 o ON o.kind = n.kind AND o.signature = n.signature "
        "WHERE o.signature IS NULL OR n.observation_count > o.observation_count",
        OUTCOME_SQL, SIGN_SQL, PROMOTE_SQL, *EARLY_SQL,
    ),
)
def superseding(spark, d):
    half = table(spark, d, "events").agg((F.max("event_id") / 2).alias("half"))
    early = observations(spark, d).join(half, F.col("seq") < F.col("half"), "left_semi")
    first = L.promote(early)
    none = first.select("kind", "signature", F.lit(None).cast("string").alias("entry_id"), "observation_count", "first_seen", "statement", "scope", "status").where("false")
    live = L.superseding_rows(first, none)
    out = L.superseding_rows(L.promote(observations(spark, d)), live)
    return out.select("kind", "signature", "observation_count", "statement", "first_seen", "last_seen", "scope", F.col("supersedes").isNotNull().alias("supersedes_row"))


# Memory rows and reviews: a signature gains a row per week; reviews name one of its rows.
MEMORY_SQL = """
mem AS (
  SELECT sg AS signature, sg || '/' || CAST(wk AS VARCHAR) AS entry_id, MIN(event_id) AS seq, MAX(ts) AS last_seen, CASE WHEN MIN(b) % 2 = 0 THEN 'rule' ELSE 'finding' END AS kind,
         CASE WHEN COUNT(*) % 2 = 0 THEN sg || '/' || CAST(CAST(wk - INTERVAL 7 DAY AS DATE) AS VARCHAR) END AS supersedes,
         CASE WHEN COUNT(*) % 7 = 0 THEN 'retracted' WHEN COUNT(*) % 3 = 0 THEN 'needs_human_review' ELSE 'active' END AS status,
         CASE MIN(b) % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'asset=cn_a' ELSE 'asset=us' END AS scope
  FROM (SELECT *, event_type || '-' || CAST(user_id % 30 AS VARCHAR) AS sg, user_id % 30 AS b, CAST(date_trunc('week', ts) AS DATE) AS wk FROM events) GROUP BY sg, wk),
rev AS (
  SELECT event_id AS seq, CASE WHEN user_id % 30 % 2 = 0 THEN 'rule' ELSE 'finding' END AS kind, sg AS signature, CASE WHEN event_id % 9 = 0 THEN 'nowhere' ELSE sg || '/' || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) END AS entry_id,
         CASE WHEN user_id % 30 % 2 = 0 THEN CASE WHEN event_id % 5 < 3 THEN 'activate' ELSE 'deactivate' END ELSE CASE WHEN event_id % 5 < 2 THEN 'retire' ELSE 'unretire' END END AS action
  FROM (SELECT *, list_extract(['click', 'view', 'purchase', 'signup'], CAST(event_id % 4 AS INTEGER) + 1) || '-' || CAST(user_id % 30 AS VARCHAR) AS sg FROM events WHERE event_type IN ('signup', 'error')) WHERE event_id % 3 = 0),
live AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind, signature ORDER BY seq DESC) AS rn FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem s WHERE s.kind = m.kind AND s.supersedes = m.entry_id)
         AND status IN ('active', 'needs_human_review')) WHERE rn = 1),
bound AS (SELECT r.kind, r.signature, arg_max(action, r.seq) AS action, MAX(r.seq) AS activation_seq FROM rev r JOIN live l ON l.kind = r.kind AND l.signature = r.signature AND l.entry_id = r.entry_id GROUP BY 1, 2),
lapsed AS (SELECT DISTINCT r.signature FROM rev r JOIN mem m ON m.signature = r.signature AND m.entry_id = r.entry_id AND m.kind = 'rule' WHERE r.kind = 'rule' AND NOT EXISTS (SELECT 1 FROM live l WHERE l.kind = 'rule' AND l.signature = r.signature AND l.entry_id = r.entry_id)),
st AS (SELECT l.*, activation_seq, CASE WHEN action = 'activate' THEN 'active' WHEN action IS NOT NULL THEN 'deactivated' WHEN l.signature IN (SELECT signature FROM lapsed) THEN 'lapsed_pending_re_review' ELSE 'never_reviewed' END AS state
       FROM live l LEFT JOIN bound b ON b.kind = l.kind AND b.signature = l.signature WHERE l.kind = 'rule')"""


def memory_rows(spark, d):
    b = F.col("user_id") % 30
    e = table(spark, d, "events").withColumns({"sg": F.concat_ws("-", "event_type", b.cast("string")), "b": b, "wk": F.to_date(F.date_trunc("week", "ts"))})
    g = e.groupBy("sg", "wk").agg(F.min("event_id").alias("seq"), F.max("ts").alias("last_seen"), F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select(
        F.col("sg").alias("signature"),
        F.concat_ws("/", "sg", F.col("wk").cast("string")).alias("entry_id"),
        "seq",
        "last_seen",
        F.when(F.col("b") % 2 == 0, "rule").otherwise("finding").alias("kind"),
        F.when(F.col("n") % 2 == 0, F.concat_ws("/", "sg", F.date_sub("wk", 7).cast("string"))).alias("supersedes"),
        F.when(F.col("n") % 7 == 0, "retracted").when(F.col("n") % 3 == 0, "needs_human_review").otherwise("active").alias("status"),
        F.when(F.col("b") % 3 == 0, "global").when(F.col("b") % 3 == 1, "asset=cn_a").otherwise("asset=us").alias("scope"),
    )


def reviews(spark, d):
    k, b = F.col("event_id"), F.col("user_id") % 30
    names = F.array(*[F.lit(n) for n in ("click", "view", "purchase", "signup")])
    e = table(spark, d, "events").where("event_type in ('signup', 'error') and event_id % 3 = 0")
    e = e.withColumns({"b": b, "signature": F.concat_ws("-", F.get(names, (k % 4).cast("int")), b.cast("string"))})
    rule = F.when(k % 5 < 3, "activate").otherwise("deactivate")
    other = F.when(k % 5 < 2, "retire").otherwise("unretire")
    return e.select(
        k.alias("seq"),
        F.when(F.col("b") % 2 == 0, "rule").otherwise("finding").alias("kind"),
        "signature",
        F.when(k % 9 == 0, "nowhere").otherwise(F.concat_ws("/", "signature", F.to_date(F.date_trunc("week", "ts")).cast("string"))).alias("entry_id"),
        F.when(F.col("b") % 2 == 0, rule).otherwise(other).alias("action"),
    )


@query("l07_live_rows", with_sql("SELECT kind, signature, entry_id, seq, status FROM live", MEMORY_SQL))
def live(spark, d):
    rows = memory_rows(spark, d)
    pick = lambda k: L.live_rows(rows, k).select("kind", "signature", "entry_id", "seq", "status")
    return pick("rule").unionByName(pick("finding"))


register(
    "l08_review_state",
    lambda spark, d: L.review_state(memory_rows(spark, d), reviews(spark, d)).select("signature", "entry_id", "state", F.col("activation_seq").cast("double").alias("activation_seq")),
    with_sql("SELECT signature, entry_id, state, CAST(activation_seq AS DOUBLE) AS activation_seq FROM st", MEMORY_SQL),
)
register(
    "l09_retired_signatures",
    lambda spark, d: L.retired_signatures(memory_rows(spark, d), reviews(spark, d), "finding"),
    with_sql("SELECT signature FROM bound WHERE kind = 'finding' AND action = 'retire'", MEMORY_SQL),
)
register(
    "l10_active_rules_topk",
    lambda spark, d: L.active_rules(L.review_state(memory_rows(spark, d), reviews(spark, d)), "asset=cn_a").select("place", "signature", "scope", "activation_seq"),
    with_sql(
        "SELECT ROW_NUMBER() OVER (ORDER BY tier, p) AS place, signature, scope, activation_seq FROM (SELECT *, SUM(CASE WHEN tier = 0 THEN 1 ELSE 0 END) OVER () AS ne, SUM(CASE WHEN tier = 1 THEN 1 ELSE 0 END) OVER () AS ng FROM "
        "(SELECT *, CASE WHEN scope = 'global' THEN 1 ELSE 0 END AS tier, ROW_NUMBER() OVER (PARTITION BY scope = 'global' ORDER BY activation_seq DESC, entry_id) AS p FROM st WHERE state = 'active' AND scope IN ('global', 'asset=cn_a'))) "
        "WHERE (tier = 0 AND p <= LEAST(ne, CASE WHEN ng > 0 THEN 4 ELSE 5 END)) OR (tier = 1 AND p <= 5 - LEAST(ne, 4))",
        MEMORY_SQL,
    ),
)
register(
    "l11_memory_feed",
    lambda spark, d: L.memory_feed(memory_rows(spark, d), reviews(spark, d), "finding", 20).select("signature", "entry_id"),
    with_sql(
        "SELECT signature, entry_id FROM (SELECT * FROM live WHERE kind = 'finding' ORDER BY last_seen DESC, signature LIMIT 20) WHERE signature NOT IN (SELECT signature FROM bound WHERE kind = 'finding' AND action = 'retire') "
        "AND signature NOT IN (SELECT signature FROM live WHERE kind = 'rule')",
        MEMORY_SQL,
    ),
)
VALID_SQL = """
env AS (SELECT *, origin IN ('local', 'external_plugin') AND settings_profile NOT IN ('unknown', 'global') AND NOT (stage = 'submit' AND verdict = 'not_applicable') AS valid FROM oc),
lat AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY evidence_run_id ORDER BY seq DESC) AS rn FROM env WHERE valid) WHERE rn = 1 AND sample_role <> 'out_of_sample'),
dimr AS (SELECT 'factor_family' AS dimension, factor_family AS bucket, * FROM lat UNION ALL SELECT 'settings_profile', settings_profile, * FROM lat UNION ALL SELECT 'asset_class', asset_class, * FROM lat UNION ALL SELECT 'universe', universe, * FROM lat),
top5 AS (SELECT dimension, bucket, string_agg(reason || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, reason) AS top_blocked FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension, bucket ORDER BY n DESC, reason) AS p FROM
  (SELECT dimension, bucket, reason, COUNT(*) AS n FROM (SELECT dimension, bucket, UNNEST(reason_codes) AS reason FROM dimr WHERE verdict = 'blocked') GROUP BY 1, 2, 3)) WHERE p <= 5 GROUP BY 1, 2),
prio AS (SELECT dimension, bucket, COUNT(*) AS evidence_runs, COUNT(*) FILTER (WHERE verdict = 'passed') AS passed, COUNT(*) FILTER (WHERE verdict = 'blocked') AS blocked, COUNT(*) FILTER (WHERE verdict = 'unknown') AS unknown,
         COALESCE(SUM(CASE evidence_strength WHEN 'submitted_live' THEN 1.0 WHEN 'platform_simulated' THEN 0.75 ELSE 0.5 END) FILTER (WHERE verdict = 'passed'), 0) AS wp,
         COALESCE(SUM(CASE evidence_strength WHEN 'submitted_live' THEN 1.0 WHEN 'platform_simulated' THEN 0.75 ELSE 0.5 END) FILTER (WHERE verdict = 'blocked'), 0) AS wb FROM dimr WHERE bucket <> '' GROUP BY 1, 2)"""
register(
    "l12_validate_envelopes",
    lambda spark, d: all_outcomes(spark, d).select("seq", L.valid_envelope().alias("valid")),
    with_sql("SELECT seq, valid FROM env", OUTCOME_SQL, VALID_SQL),
)
register(
    "l13_priors_table",
    lambda spark, d: L.priors(all_outcomes(spark, d)).select(
        "dimension", "bucket", "evidence_runs", "passed", "blocked", "unknown", r6("weighted_passed").alias("weighted_passed"), r6("weighted_blocked").alias("weighted_blocked"),
        r6("pass_rate").alias("pass_rate"), r6("weighted_pass_rate").alias("weighted_pass_rate"), "insufficient_sample", F.array_join("top_blocked", ",").alias("top_blocked"),
    ),
    with_sql(
        "SELECT dimension, bucket, evidence_runs, passed, blocked, unknown, ROUND(CAST(wp AS DOUBLE), 6) AS weighted_passed, ROUND(CAST(wb AS DOUBLE), 6) AS weighted_blocked, "
        "ROUND(CASE WHEN passed + blocked >= 2 THEN CAST(passed AS DOUBLE) / (passed + blocked) END, 6) AS pass_rate, ROUND(CASE WHEN passed + blocked >= 2 AND wp + wb > 0 THEN CAST(wp AS DOUBLE) / CAST(wp + wb AS DOUBLE) END, 6) AS weighted_pass_rate, "
        "passed + blocked < 2 AS insufficient_sample, COALESCE(top_blocked, '') AS top_blocked FROM prio LEFT JOIN top5 USING (dimension, bucket)",
        OUTCOME_SQL, VALID_SQL,
    ),
)
register(
    "l13_priors_unbucketed",
    lambda spark, d: L.unbucketed(all_outcomes(spark, d)),
    with_sql("SELECT dimension, COUNT(*) FILTER (WHERE bucket = '') AS unbucketed FROM dimr GROUP BY 1", OUTCOME_SQL, VALID_SQL),
)

# --- lineage and runs ---------------------------------------------------------------


@query(
    "l14_lineage_edges",
    "SELECT DISTINCT 'A' || CAST(l_partkey AS VARCHAR) AS artifact_id, 'O' || CAST(l_orderkey AS VARCHAR) AS parents, l_returnflag AS generated_by, l_linestatus AS artifact_type FROM lineitem a "
    "WHERE l_linenumber > 2 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber <= 2 AND b.l_partkey = a.l_partkey AND b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag AND b.l_linestatus = a.l_linestatus)",
)
def edges(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_linenumber",
        F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("artifact_id"),
        F.array(F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))).alias("parents"),
        F.col("l_returnflag").alias("generated_by"),
        F.col("l_linestatus").alias("artifact_type"),
    )
    old, new = rows.where("l_linenumber <= 2").drop("l_linenumber"), rows.where("l_linenumber > 2").drop("l_linenumber")
    return L.new_edges(old, new).withColumn("parents", F.array_join("parents", ","))


@query(
    "l15_lineage_ancestors",
    "WITH RECURSIVE e AS (SELECT o_orderkey AS c, o_orderkey // 3 AS p FROM orders WHERE o_orderkey >= 3), up AS (SELECT c, p, 1 AS depth FROM e UNION ALL SELECT up.c, e.p, depth + 1 FROM up JOIN e ON e.c = up.p) "
    "SELECT c AS artifact_id, p AS ancestor, MIN(depth) AS depth FROM up GROUP BY 1, 2",
)
def ancestors(spark, d):
    k = F.col("o_orderkey")
    return L.ancestors(table(spark, d, "orders").where(k >= 3).select(k.alias("artifact_id"), F.floor(k / 3).alias("parent")))


@query(
    "l15_ancestors_of_requested",
    "WITH RECURSIVE e AS (SELECT o_orderkey AS c, o_orderkey // 3 AS p FROM orders WHERE o_orderkey >= 3), "
    "up AS (SELECT c, p, 1 AS depth FROM e JOIN orders ON o_orderkey = c WHERE o_orderstatus = 'P' UNION ALL SELECT up.c, e.p, depth + 1 FROM up JOIN e ON e.c = up.p) "
    "SELECT c AS artifact_id, p AS ancestor, MIN(depth) AS depth FROM up GROUP BY 1, 2",
)
def ancestors_of_requested(spark, d):
    """Everything above the orders in process."""
    k, orders = F.col("o_orderkey"), table(spark, d, "orders")
    edges_ = orders.where(k >= 3).select(k.alias("artifact_id"), F.floor(k / 3).alias("parent"))
    return L.ancestors_of(edges_, orders.where("o_orderstatus = 'P'").select(k.alias("artifact_id")))


def run_index(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("factor_id"))
    heads = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"))
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("run_id"), "kind", "factor_id"
    )


RUNS_SQL = "ri AS (SELECT o_orderkey AS seq, 'R' || CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS kind, 'F' || CAST(l_partkey AS VARCHAR) AS factor_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def search_sql(where: str) -> str:
    return with_sql(
        f"SELECT * FROM (SELECT DISTINCT 'run' AS row_type, seq, run_id, kind FROM ri WHERE {where} ORDER BY seq DESC LIMIT 10) UNION ALL SELECT 'total', COUNT(DISTINCT run_id), NULL, NULL FROM ri WHERE {where}",
        RUNS_SQL,
    )


register(
    "l16_run_index_search",
    lambda spark, d: L.search_runs(run_index(spark, d), F.col("factor_id") == "F7", "F", 10),
    search_sql("factor_id = 'F7' AND kind = 'F'"),
)
register(
    "l22_factor_evidence",
    lambda spark, d: L.search_runs(run_index(spark, d), F.col("factor_id") == "F11", None, 10),
    search_sql("factor_id = 'F11'"),
)


@query(
    "l17_latest_bench",
    "SELECT 'R' || CAST(l_orderkey AS VARCHAR) AS run_id, 'F' || CAST(l_partkey AS VARCHAR) AS factor_id, l_linenumber AS metric_no, l_quantity AS value FROM lineitem "
    "WHERE l_orderkey = (SELECT MAX(o_orderkey) FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem))",
)
def latest_bench(spark, d):
    metrics = table(spark, d, "lineitem").select(
        F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("run_id"), F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("factor_id"),
        F.col("l_linenumber").alias("metric_no"), F.col("l_quantity").alias("value"),
    )
    return L.latest_run_metrics(run_index(spark, d), metrics, "P")


@query(
    "l18_goal_status",
    "SELECT c_custkey AS goal_id, COALESCE((SELECT CASE arg_max(o_orderstatus, o_orderkey) WHEN 'F' THEN 'complete' WHEN 'O' THEN 'active' ELSE 'abandoned' END FROM orders WHERE o_custkey = c_custkey HAVING COUNT(*) > 0), 'draft') AS effective_status FROM customer",
)
def goal_status(spark, d):
    to = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "active").otherwise("abandoned")
    moves = table(spark, d, "orders").select(F.col("o_custkey").alias("goal_id"), F.col("o_orderkey").alias("seq"), to.alias("to_status"))
    goals = table(spark, d, "customer").select(F.col("c_custkey").alias("goal_id"), F.lit("draft").alias("status"))
    return L.goal_status(goals, moves).select("goal_id", "effective_status")


GOAL_SQL = """
crit AS (SELECT c_custkey AS goal_id, UNNEST(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS criterion_id FROM customer),
aud AS (SELECT o_custkey AS goal_id, o_orderpriority AS criterion_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'satisfied' WHEN 'P' THEN 'not_applicable_user_accepted' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'not_satisfied' ELSE 'satisfied_with_caveat' END END, o_orderkey) AS result,
        arg_max(o_totalprice > 100000, o_orderkey) AS has FROM orders GROUP BY 1, 2),
cr AS (SELECT c.goal_id, c.criterion_id, CASE WHEN result IS NULL THEN c.criterion_id || ' has no audit row' WHEN result = 'not_satisfied' THEN c.criterion_id || ' latest result is ' || result
       WHEN result LIKE 'satisfied%' AND NOT has THEN c.criterion_id || ' cites no existing evidence' END AS failure, COALESCE(result LIKE 'satisfied%' AND has, FALSE) AS backed
       FROM crit c LEFT JOIN aud USING (goal_id, criterion_id) WHERE c.criterion_id <> '3-MEDIUM')"""


@query(
    "l19_goal_completion",
    with_sql(
        "SELECT goal_id, eb AS evidence_backed, CASE WHEN f = '' AND eb = 0 THEN 'nothing on file supports a required criterion' ELSE f END AS failures, f = '' AND eb > 0 AS can_complete FROM "
        "(SELECT goal_id, COUNT(*) FILTER (WHERE backed) AS eb, COALESCE(string_agg(failure, '; ' ORDER BY failure), '') AS f FROM cr GROUP BY 1)",
        GOAL_SQL,
    ),
)
def completion(spark, d):
    names = F.array(*[F.lit(n) for n in ("1-URGENT", "2-HIGH", "3-MEDIUM")])
    criteria = table(spark, d, "customer").select(F.col("c_custkey").alias("goal_id"), F.explode(names).alias("criterion_id"))
    criteria = criteria.withColumn("required", F.col("criterion_id") != "3-MEDIUM")
    status = F.col("o_orderstatus")
    result = F.when(status == "F", "satisfied").when(status == "P", "not_applicable_user_accepted").when(F.col("o_orderkey") % 2 == 0, "not_satisfied").otherwise("satisfied_with_caveat")
    audits = table(spark, d, "orders").select(
        F.col("o_custkey").alias("goal_id"), F.col("o_orderpriority").alias("criterion_id"), F.col("o_orderkey").alias("seq"), result.alias("result"),
        (F.col("o_totalprice") > 100000).alias("evidence_exists"),
    )
    return L.goal_completion(criteria, audits).select("goal_id", "evidence_backed", F.array_join("failures", "; ").alias("failures"), "can_complete")


# The operators offered and their categories.
OPERATORS = {
    **{n: "time_series" for n in ("delay", "delta", "ts_sum", "ts_mean", "ts_min", "ts_max", "stddev", "ts_rank", "decay_linear", "ts_argmax", "ts_argmin", "correlation", "covariance")},
    **{n: "cross_section" for n in ("rank", "zscore", "winsorize", "ntile", "scale", "group_neutralize", "residualize")},
    **{n: "arithmetic" for n in ("abs", "log", "sign", "signedpower", "wq_min", "wq_max")},
}


def tags(spark, d):
    defs = current_definitions(definitions(spark, d)).withColumn("category", F.when(F.col("source") == "rd", "synthetic").otherwise("original"))
    fields = spark.createDataFrame(list(FIELD_ROLES.items()), "field string, role string")
    ops = spark.createDataFrame(list(OPERATORS.items()), "name string, category string")
    return L.tag_table(defs, fields, ops)


OP_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in OPERATORS.items())
TAG_SQL = (
    f"tg AS (SELECT 'field' AS subject_kind, f AS subject_id, r AS theme, CAST(NULL AS INTEGER) AS horizon FROM (VALUES {ROLE_ROWS}) AS t(f, r) UNION ALL SELECT 'operator', n, c, NULL FROM (VALUES {OP_ROWS}) AS t(n, c) "
    "UNION ALL SELECT 'factor', factor_id, CASE WHEN source = 'rd' THEN 'synthetic' ELSE 'original' END, horizon FROM cur)"
)
register(
    "l20_tags",
    lambda spark, d: tags(spark, d).withColumn("horizon", F.col("horizon").cast("double")),
    with_sql("SELECT subject_kind, subject_id, theme, CAST(horizon AS DOUBLE) AS horizon FROM tg", DEFS_SQL, CURRENT_SQL, TAG_SQL),
)


@query(
    "l21_registry_table",
    with_sql(
        "SELECT factor_id, formula, theme, COALESCE(CAST(present AS VARCHAR), 'unknown') AS values_present FROM (SELECT factor_id, formula, theme, CASE WHEN formula LIKE 'precomputed:%' THEN factor_id IN (SELECT replace(p_brand, '#', '-') || '_' || p_type FROM part WHERE p_size > 25) END AS present FROM "
        "(SELECT factor_id, CASE WHEN seq % 3 = 0 THEN 'precomputed:' || factor_id ELSE formula END AS formula, CASE WHEN source = 'rd' THEN 'synthetic' ELSE 'original' END AS theme FROM cur))",
        DEFS_SQL, CURRENT_SQL,
    ),
)
def registry(spark, d):
    defs = current_definitions(definitions(spark, d))
    pre = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("precomputed:"), F.col("factor_id"))).otherwise(F.col("formula"))
    stored = table(spark, d, "part").where("p_size > 25").select(F.concat(F.regexp_replace("p_brand", "#", "-"), F.lit("_"), F.col("p_type")).alias("factor_id"))
    return L.registry_table(defs.withColumn("formula", pre), tags(spark, d), stored).select(
        "factor_id", "formula", "theme", F.coalesce(F.col("values_present").cast("string"), F.lit("unknown")).alias("values_present")
    )


register(
    "l23_data_window",
    lambda spark, d: L.data_window(labelled(spark, d, FACTORS, (5,))),
    panel_sql(
        "SELECT factor_id, MIN(trade_date) FILTER (WHERE f IS NOT NULL) AS start_date, MAX(trade_date) FILTER (WHERE f IS NOT NULL) AS end_date, 'available' AS status FROM lab GROUP BY 1",
        lab_sql(FACTORS, (5,)),
    ),
)
register(
    "l24_record_run",
    lambda spark, d: L.record_runs(run_index(spark, d)),
    with_sql(
        "SELECT DISTINCT 'definition' AS row_type, 'def:' || factor_id AS id, '' AS parent FROM ri UNION ALL SELECT DISTINCT 'artifact', 'art:' || run_id, 'def:' || factor_id FROM ri "
        "UNION ALL SELECT DISTINCT 'run', run_id, 'art:' || run_id FROM ri",
        RUNS_SQL,
    ),
)
