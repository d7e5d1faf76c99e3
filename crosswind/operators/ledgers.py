"""Append-only ledgers: outcomes, observations, promotion, reviews, priors, lineage, goals.

Every ledger row carries ``seq``, its append order, which settles "latest". Sets that grow
with the data (evidence references, runs, windows, accepted ids) stay long tables; nothing
collects an unbounded list per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswind.functions.text import canonical_fingerprint
from crosswind.session import durable

# Closed vocabularies.
ORIGINS = ("local", "external_plugin")
STAGE_STRENGTH = {
    "evaluate": "local_backtest",
    "backtest": "local_backtest",
    "gate": "local_backtest",
    "prescreen": "prescreen",
    "simulate": "platform_simulated",
    "submit": "submitted_live",
}
STRENGTH_WEIGHT = {"prescreen": 0.25, "local_backtest": 0.5, "platform_simulated": 0.75, "submitted_live": 1.0}
VERDICTS = ("passed", "blocked", "unknown", "not_applicable")
SAMPLE_ROLES = ("unspecified", "in_sample", "out_of_sample", "mixed")
LIFECYCLE_VERDICT = {"submitted": "unknown", "not_confirmed": "unknown", "accepted": "passed", "rejected": "blocked"}
REASONS = (
    "NONE", "SHARPE_BELOW_GATE", "RETURNS_BELOW_GATE", "SUBWINDOW_SHARPE_BELOW_GATE", "TURNOVER_TOO_HIGH", "TURNOVER_TOO_LOW", "DRAWDOWN_TOO_DEEP",
    "WEIGHT_CONCENTRATION_HIGH", "SELF_CORRELATION_HIGH", "REDUNDANCY_HIGH", "REGION_MISMATCH", "INSUFFICIENT_SAMPLE", "DATA_UNAVAILABLE",
    "OBJECTIVE_SCORE_BELOW_GATE", "VALIDATION_ERROR", "EXECUTION_ERROR",
)
FAMILY_REASON = {
    "ic_days": "INSUFFICIENT_SAMPLE",
    "backtest_periods": "INSUFFICIENT_SAMPLE",
    "insufficient_oos_evidence": "INSUFFICIENT_SAMPLE",
    "insufficient_evidence": "INSUFFICIENT_SAMPLE",
    "coverage": "DATA_UNAVAILABLE",
    "rebalance_rate": "TURNOVER_TOO_HIGH",
    "turnover_rate": "TURNOVER_TOO_HIGH",
    "net_return_retention": "RETURNS_BELOW_GATE",
    "score": "OBJECTIVE_SCORE_BELOW_GATE",
}
OOS_FAMILY = r"^oos[0-9]*([_.\-][a-z0-9_.\-]*)?$"
SCOPE_PATTERN = r"^[a-z0-9_.\-]{0,32}$"
SCOPE_SENTINELS = ("unknown", "global")
PRIOR_DIMENSIONS = ("factor_family", "settings_profile", "asset_class", "universe")
FAILURES = ("gate_blocked", "validation_error")
RULE_STATUS = "needs_human_review"
LIVE_STATUSES = ("active", RULE_STATUS)
COMPLETION_RESULTS = ("satisfied", "satisfied_with_caveat", "not_applicable_user_accepted")
EVIDENCE_RESULTS = ("satisfied", "satisfied_with_caveat")


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


# --- outcomes -------------------------------------------------------------------------


def reason_codes(reasons: Column) -> Column:
    """Closed codes of a row's gate reasons, sorted; unknown families map to nothing."""

    def code(reason: Column) -> Column:
        family = F.lower(F.trim(F.split(F.split(reason, ":")[0], " ")[0]))
        return F.coalesce(_map(FAMILY_REASON)[family], F.when(family.rlike(OOS_FAMILY), "RETURNS_BELOW_GATE"))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(reasons, code))))


def results_to_outcomes(results: DataFrame) -> DataFrame:
    """One outcome per representable candidate result; net figures before gross, drawdown as size."""
    codes = F.when(F.col("passed"), F.array(F.lit("NONE"))).otherwise(reason_codes(F.col("blocking")))
    net_first = lambda net, gross: F.coalesce(F.col(net), F.col(gross))
    out = results.withColumns(
        {
            "verdict": F.when(F.col("passed"), "passed").otherwise("blocked"),
            "reason_codes": codes,
            "annualized_return": net_first("net_annual", "gross_annual"),
            "return_basis": F.when(F.col("net_annual").isNotNull(), "net").when(F.col("gross_annual").isNotNull(), "gross"),
            "sharpe": F.col("net_sharpe"),
            "max_drawdown": F.abs("net_drawdown"),
            "turnover": F.col("turnover_rate"),
        }
    )
    return out.where(F.size("reason_codes") > 0)


def with_ids(outcomes: DataFrame) -> DataFrame:
    """Evidence run (subject, window, stage), outcome id (time excluded) and derived strength."""
    c = F.col
    run = canonical_fingerprint(factor_fingerprint=c("factor_fingerprint"), window=c("data_window"), stage=c("stage"))
    content = canonical_fingerprint(
        **{
            k: c(k)
            for k in (
                "origin", "stage", "verdict", "factor_fingerprint", "data_window", "sample_role", "lifecycle", "reason_codes",
                "factor_family", "settings_profile", "asset_class", "universe",
            )
        }
    )
    return outcomes.withColumns(
        {"evidence_run_id": run, "outcome_id": content, "evidence_strength": _map(STAGE_STRENGTH)[F.col("stage")]}
    )


def outcome_signatures(outcomes: DataFrame) -> DataFrame:
    """One row per outcome and reason with its signature; unknown scopes never unify."""
    filled = lambda name: F.when(F.col(name) != "", F.col(name)).otherwise("unknown")
    scope = F.concat_ws(
        ";",
        F.when(F.col("asset_class") != "", F.concat(F.lit("asset="), F.col("asset_class"))),
        F.when(F.col("universe") != "", F.concat(F.lit("universe="), F.col("universe"))),
    )
    scope = F.when(scope != "", scope).otherwise("global")
    known = (F.col("factor_family") != "") & (F.col("settings_profile") != "")
    rows = outcomes.withColumn("reason_code", F.explode("reason_codes"))
    signature = canonical_fingerprint(
        origin=F.col("origin"),
        stage=F.col("stage"),
        verdict=F.col("verdict"),
        reason_code=F.col("reason_code"),
        factor_family=filled("factor_family"),
        settings_profile=filled("settings_profile"),
        scope=scope,
        disambiguator=F.when(~known, F.col("evidence_run_id")),
    )
    return rows.withColumns({"scope": scope, "signature": signature})


def outcome_observations(outcomes: DataFrame) -> DataFrame:
    """Observations of the scientific verdicts, one per reason."""
    failure = (
        F.when(F.col("verdict") != "blocked", "")
        .when(F.col("reason_code").isin("VALIDATION_ERROR", "EXECUTION_ERROR"), "validation_error")
        .otherwise("gate_blocked")
    )
    rows = outcome_signatures(outcomes.where(F.col("verdict").isin("passed", "blocked")))
    return rows.select(
        "seq",
        "signature",
        F.concat_ws(" ", "verdict", "reason_code").alias("statement"),
        F.col("evidence_run_id").alias("run_id"),
        "observed_at",
        "data_window",
        failure.alias("failure_class"),
        F.col("outcome_id").alias("evidence_ref"),
        "scope",
    )


def first_of(df: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    """The earliest row of each key, by a keyed aggregate (combined before the shuffle)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*").select(*df.columns)


def rejected_outcomes(incoming: DataFrame, origin: str = "local") -> DataFrame:
    """Rows that ingest does not take, with the reason; a missing origin is a mismatch too."""
    return incoming.where(~F.col("origin").eqNullSafe(F.lit(origin))).withColumn("reason", F.lit("ORIGIN_MISMATCH"))


def ingest_outcomes(ledger: DataFrame, incoming: DataFrame, origin: str = "local") -> DataFrame:
    """Rows to append: right origin, not replayed, each outcome once. `rejected_outcomes` has the rows of another origin."""
    fresh = incoming.where(F.col("origin") == origin)
    return first_of(fresh.join(ledger.select("outcome_id"), "outcome_id", "left_anti"), "outcome_id")


# --- promotion ------------------------------------------------------------------------


def first_per_run(observations: DataFrame) -> DataFrame:
    """The earliest observation of each (signature, run); repeats and retries drop out."""
    order = F.struct("observed_at", "run_id", "evidence_ref")
    row = F.struct("observed_at", "data_window", "failure_class", "evidence_ref", "statement", "scope")
    best = observations.groupBy("signature", "run_id").agg(F.min_by(row, order).alias("_r"))
    return best.select("signature", "run_id", "_r.*")


def promote(observations: DataFrame) -> DataFrame:
    """Promotion decisions: signature, kind, status, counts, first and last sighting.

    Each run counts once. Three runs over two data windows propose a rule, and for a failing
    signature also a failure; two runs make a finding or a failure.
    """
    units = first_per_run(observations)
    order = F.struct("observed_at", "run_id", "evidence_ref")
    agg = units.groupBy("signature").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count_distinct(F.when(F.col("data_window") != "", F.col("data_window"))).alias("windows"),
        F.bool_or(F.col("failure_class").isin(*FAILURES)).alias("is_failure"),
        F.min("observed_at").alias("first_seen"),
        F.max("observed_at").alias("last_seen"),
        F.min_by("statement", order).alias("statement"),
        F.min_by("scope", order).alias("scope"),
    )
    kind = lambda k, s: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("status"))
    rule = (F.col("observation_count") >= 3) & (F.col("windows") >= 2)
    minor = F.when(F.col("is_failure"), kind("failure", "active")).otherwise(kind("finding", "active"))
    kinds = (
        F.when(rule & F.col("is_failure"), F.array(kind("rule", RULE_STATUS), kind("failure", "active")))
        .when(rule, F.array(kind("rule", RULE_STATUS)))
        .when(F.col("observation_count") >= 2, F.array(minor))
    )
    return agg.withColumn("_k", kinds).select(
        "signature", F.inline("_k"), "observation_count", "windows", "first_seen", "last_seen", "statement", "scope"
    )


def promotion_refs(observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Evidence references of promoted signatures, one row each."""
    refs = first_per_run(observations).select("signature", F.coalesce(F.when(F.col("evidence_ref") != "", F.col("evidence_ref")), F.col("run_id")).alias("evidence_ref"))
    return refs.join(decisions.select("signature"), "signature", "left_semi").distinct()


def promotion_runs(observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Runs and data windows behind each promoted signature, one row each; a set that grows with the data stays long."""
    units = first_per_run(observations).select("signature", "run_id", "data_window")
    return units.join(decisions.select("signature"), "signature", "left_semi")


def superseding_rows(decisions: DataFrame, live: DataFrame) -> DataFrame:
    """Rows to append: new signatures, or ones whose count grew; the first wording stays.

    ``live``: kind, signature, entry_id, observation_count, first_seen, statement, scope, status.
    """
    old = live.select("kind", "signature", *[F.col(c).alias(f"_{c}") for c in ("entry_id", "observation_count", "first_seen", "statement", "scope", "status")])
    joined = decisions.join(old, ["kind", "signature"], "left")
    grew = F.col("_entry_id").isNull() | (F.col("observation_count") > F.col("_observation_count"))
    keep = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    rows = joined.where(grew).select(
        "kind", "signature", keep("statement"), "observation_count", keep("first_seen"), "last_seen", keep("scope"), keep("status"),
        F.col("_entry_id").alias("supersedes"),
    )
    entry = canonical_fingerprint(**{c: F.col(c) for c in ("kind", "signature", "statement", "observation_count", "scope", "status", "supersedes")})
    return rows.withColumn("entry_id", entry)


def merged_refs(old_refs: DataFrame, new_refs: DataFrame) -> DataFrame:
    """Union of evidence references per signature, long."""
    return old_refs.unionByName(new_refs).distinct()


# --- reviews --------------------------------------------------------------------------


def live_rows(rows: DataFrame, kind: str) -> DataFrame:
    """Rows not superseded and still active, the last appended per signature."""
    own = rows.where(F.col("kind") == kind)
    gone = own.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("entry_id"))
    standing = own.join(gone, "entry_id", "left_anti").where(F.col("status").isin(*LIVE_STATUSES))
    rest = [c for c in rows.columns if c != "signature"]
    return standing.groupBy("signature").agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select("signature", "_r.*")


def bound_events(live: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """Latest review per live row among events that reviewed exactly that row."""
    own = events.where(F.col("kind") == kind).select("seq", "signature", "entry_id", "action")
    hit = own.join(live.select("signature", "entry_id"), ["signature", "entry_id"], "left_semi")
    return hit.groupBy("signature").agg(F.max_by(F.struct("action", "seq"), "seq").alias("_e")).select(
        "signature", F.col("_e.action").alias("action"), F.col("_e.seq").alias("activation_seq")
    )


def review_state(rows: DataFrame, events: DataFrame) -> DataFrame:
    """active, deactivated, lapsed_pending_re_review or never_reviewed for each live rule."""
    live = live_rows(rows, "rule")
    bound = bound_events(live, events, "rule")
    held = rows.where("kind = 'rule'").select("signature", "entry_id").distinct()
    own = events.where("kind = 'rule'").select("signature", "entry_id")
    lapsed = own.join(held, ["signature", "entry_id"], "left_semi").join(live.select("signature", "entry_id"), ["signature", "entry_id"], "left_anti")
    out = live.join(bound, "signature", "left").join(lapsed.select("signature").distinct().withColumn("_l", F.lit(True)), "signature", "left")
    state = (
        F.when(F.col("action") == "activate", "active")
        .when(F.col("action").isNotNull(), "deactivated")
        .when(F.col("_l"), "lapsed_pending_re_review")
        .otherwise("never_reviewed")
    )
    return out.withColumn("state", state).drop("_l", "action")


def retired_signatures(rows: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    return bound_events(live_rows(rows, kind), events, kind).where("action = 'retire'").select("signature")


def active_rules(states: DataFrame, builder_scope: str, limit: int = 5) -> DataFrame:
    """Top active rules: exact scope first, newest activation first, last slot kept for a global one."""
    order = [F.col("activation_seq").desc(), F.col("entry_id").asc()]
    on = states.where("state = 'active'")
    exact = on.where((F.col("scope") == builder_scope) & (F.lit(builder_scope) != "global")).orderBy(*order).limit(limit).withColumn("_tier", F.lit(0))
    world = on.where("scope = 'global'").orderBy(*order).limit(limit).withColumn("_tier", F.lit(1))
    # At most 2 * limit rows from here on.
    place = F.row_number().over(Window.partitionBy("_tier").orderBy(*order))
    pool = exact.unionByName(world).withColumn("_p", place)
    slots = F.count_if(F.col("_tier") == 0).over(Window.partitionBy(F.lit(1)))
    globals_ = F.count_if(F.col("_tier") == 1).over(Window.partitionBy(F.lit(1)))
    room = F.when(globals_ > 0, F.lit(limit - 1)).otherwise(F.lit(limit))
    pool = pool.withColumn("_room", F.least(slots, room))
    kept = pool.where(((F.col("_tier") == 0) & (F.col("_p") <= F.col("_room"))) | ((F.col("_tier") == 1) & (F.col("_p") <= limit - F.col("_room"))))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_tier", "_p"))
    return kept.withColumn("place", rank).drop("_tier", "_p", "_room")


def memory_feed(rows: DataFrame, events: DataFrame, kind: str, limit: int = 5) -> DataFrame:
    """The newest rows of a kind, then without retired ones and signatures already in the rule tier."""
    newest = live_rows(rows, kind).orderBy(F.col("last_seen").desc(), "signature").limit(limit)
    rules = live_rows(rows, "rule").select("signature")
    return newest.join(retired_signatures(rows, events, kind), "signature", "left_anti").join(rules, "signature", "left_anti")


# --- priors ---------------------------------------------------------------------------


def valid_envelope() -> Column:
    """Whether a stored outcome keeps the closed vocabularies and cross-field rules."""
    c = F.col
    reasons = c("reason_codes")
    known = F.forall(reasons, lambda r: r.isin(*REASONS)) & (F.size(reasons) > 0)
    none_only = F.forall(reasons, lambda r: r == "NONE")
    has_none = F.array_contains(reasons, "NONE")
    coherent = F.when(c("verdict") == "passed", none_only).when(c("verdict") == "blocked", ~has_none).otherwise(F.lit(True))
    lifecycle = F.when(c("stage") == "submit", F.coalesce(_map(LIFECYCLE_VERDICT)[c("lifecycle")] == c("verdict"), F.lit(False))).otherwise(c("lifecycle") == "")
    scopes = reduce(lambda a, b: a & b, [c(d).rlike(SCOPE_PATTERN) & ~c(d).isin(*SCOPE_SENTINELS) for d in PRIOR_DIMENSIONS])
    test = (
        c("evidence_run_id").rlike("^[0-9a-f]{64}$")
        & c("origin").isin(*ORIGINS)
        & c("stage").isin(*STAGE_STRENGTH)
        & c("verdict").isin(*VERDICTS)
        & (c("evidence_strength") == _map(STAGE_STRENGTH)[c("stage")])
        & c("sample_role").isin(*SAMPLE_ROLES)
        & known
        & coherent
        & lifecycle
        & scopes
    )
    return F.coalesce(test, F.lit(False))


def latest_evidence(envelopes: DataFrame) -> DataFrame:
    """Latest valid row per evidence run, without out-of-sample ones."""
    row = F.struct("verdict", "evidence_strength", "reason_codes", "sample_role", *PRIOR_DIMENSIONS)
    last = envelopes.where(valid_envelope()).groupBy("evidence_run_id").agg(F.max_by(row, "seq").alias("_r")).select("evidence_run_id", "_r.*")
    return last.where("sample_role <> 'out_of_sample'")


def by_dimension(evidence: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("bucket")) for d in PRIOR_DIMENSIONS]
    return evidence.select("*", F.inline(F.array(*cells)))


def priors(envelopes: DataFrame, floor: int = 2, top: int = 5) -> DataFrame:
    """Per dimension and bucket: verdict counts, weighted sums, pass rates, top blocking reasons.

    The four dimensions are independent groupings, computed in one pass over the long form.
    Reasons are a closed vocabulary, so a bucket ranks at most that many.
    """
    rows = by_dimension(latest_evidence(envelopes)).where("bucket <> ''")
    weight = F.coalesce(_map(STRENGTH_WEIGHT)[F.col("evidence_strength")], F.lit(0.0))
    is_v = lambda v: F.col("verdict") == v
    by = ["dimension", "bucket"]
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("evidence_runs"),
        *[F.count_if(is_v(v)).alias(v) for v in VERDICTS],
        F.sum(F.when(is_v("passed"), weight).otherwise(0.0)).alias("weighted_passed"),
        F.sum(F.when(is_v("blocked"), weight).otherwise(0.0)).alias("weighted_blocked"),
    )
    tested = F.col("passed") + F.col("blocked")
    thin = (tested < floor) | (tested == 0)
    total = F.col("weighted_passed") + F.col("weighted_blocked")
    agg = agg.withColumns(
        {
            "insufficient_sample": thin,
            "pass_rate": F.when(~thin, F.try_divide(F.col("passed"), tested)),
            "weighted_pass_rate": F.when(~thin & (total > 0), F.try_divide(F.col("weighted_passed"), total)),
        }
    )
    counts = rows.where(is_v("blocked")).select(*by, F.explode("reason_codes").alias("reason")).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "reason"))
    best = counts.withColumn("_p", place).where(F.col("_p") <= top)
    text = F.concat_ws(":", "reason", F.col("n").cast("string"))
    listed = best.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", text.alias("t")))), lambda e: e["t"]).alias("top_blocked"))
    return agg.join(listed, by, "left").withColumn("top_blocked", F.coalesce("top_blocked", F.array().cast("array<string>")))


def unbucketed(envelopes: DataFrame) -> DataFrame:
    return by_dimension(latest_evidence(envelopes)).groupBy("dimension").agg(F.count_if(F.col("bucket") == "").alias("unbucketed"))


# --- lineage and runs -----------------------------------------------------------------


def new_edges(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges not yet recorded with the same id, parents, generator and type."""
    key = ["artifact_id", "parents", "generated_by", "artifact_type"]
    return incoming.dropDuplicates(key).join(index, key, "left_anti")


def ancestors(edges: DataFrame, max_rounds: int = 32) -> DataFrame:
    """All (artifact, ancestor, depth) pairs of a parent table, shortest depth.

    A round joins the pairs of depth 2^k alone with all that are known, which gives those of depth 2^k + 1 to 2^(k+1); rounds are
    the logarithm of the depth. Where no artifact has two parents and none is its own ancestor, there is one way to each
    ancestor, so every pair comes up once and stays where it was written; else the shortest of each pair is kept after each round.
    """
    known = durable(edges.select("artifact_id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    own = "artifact_id = ancestor"
    one_way = known.where(own).isEmpty() and known.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    for k in range(max_rounds):
        far = known.where(F.col("depth") == 2**k).select("artifact_id", F.col("ancestor").alias("_at"))
        if far.isEmpty():
            return known
        hop = known.select(F.col("artifact_id").alias("_at"), "ancestor", (F.col("depth") + 2**k).alias("depth"))
        longer = far.join(hop.hint("merge"), "_at").select("artifact_id", "ancestor", "depth")
        if one_way:
            longer = durable(longer)
            # A pair that came up twice has its ancestor on a cycle no longer than this round reaches.
            one_way = longer.where(own).isEmpty()
        known = known.unionByName(longer)
        if not one_way:
            known = durable(known.groupBy("artifact_id", "ancestor").agg(F.min("depth").alias("depth")))
    raise RuntimeError(f"lineage is deeper than 2^{max_rounds}")


def ancestors_of(edges: DataFrame, requested: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(artifact, ancestor, depth) pairs of the requested artifact_ids alone, shortest depth; `edges` as for ``ancestors``.

    Semi-naive: a round joins only the pairs that the one before found with the edges, and keeps those not known yet, so the work
    grows with the answer and cycles end. Rounds are as many as the longest shortest way up.
    """
    up = durable(edges.select(F.col("artifact_id").alias("_at"), F.col("parent").alias("_up")).where("_at is not null and _up is not null").distinct())
    new = durable(requested.select("artifact_id").distinct().join(up, F.col("artifact_id") == F.col("_at")).select("artifact_id", F.col("_up").alias("ancestor"), F.lit(1).alias("depth")))
    known = new
    for depth in range(2, max_rounds + 1):
        if new.isEmpty():
            return known
        further = new.join(up, F.col("ancestor") == F.col("_at")).select("artifact_id", F.col("_up").alias("ancestor")).distinct()
        new = durable(further.join(known, ["artifact_id", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.union(new)
    raise RuntimeError(f"lineage is deeper than {max_rounds}")


def search_runs(runs: DataFrame, factor: Column, kind: str | None, limit: int) -> DataFrame:
    """Newest matching runs and the total; ``runs`` is long (seq, run_id, kind, factor_id)."""
    hits = runs.where(factor if kind is None else factor & (F.col("kind") == kind)).select("seq", "run_id", "kind").distinct()
    newest = hits.orderBy(F.col("seq").desc()).limit(limit).select(F.lit("run").alias("row_type"), "seq", "run_id", "kind")
    total = hits.agg(F.count(F.lit(1)).alias("seq")).select(
        F.lit("total").alias("row_type"), "seq", F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("kind")
    )
    return newest.unionByName(total)


def latest_run_metrics(runs: DataFrame, metrics: DataFrame, kind: str) -> DataFrame:
    """Metric rows of the newest run of a kind."""
    newest = runs.where(F.col("kind") == kind).agg(F.max_by("run_id", "seq").alias("run_id"))
    return metrics.join(newest, "run_id", "left_semi")


def record_runs(results: DataFrame) -> DataFrame:
    """Definition edge, artifact edge and run row of each result, deduplicated, as one long table."""
    definition = F.concat(F.lit("def:"), F.col("factor_id"))
    artifact = F.concat(F.lit("art:"), F.col("run_id"))
    row = lambda t, i, p: F.struct(F.lit(t).alias("row_type"), i.alias("id"), p.alias("parent"))
    rows = F.array(
        row("definition", definition, F.lit("")),
        row("artifact", artifact, definition),
        row("run", F.col("run_id"), artifact),
    )
    return results.select(F.inline(rows)).distinct()


# --- goals ----------------------------------------------------------------------------


def goal_status(goals: DataFrame, transitions: DataFrame) -> DataFrame:
    """Last status transition wins, else the initial status."""
    last = transitions.groupBy("goal_id").agg(F.max_by("to_status", "seq").alias("_to"))
    return goals.join(last, "goal_id", "left").withColumn("effective_status", F.coalesce("_to", "status")).drop("_to")


def goal_completion(criteria: DataFrame, audits: DataFrame) -> DataFrame:
    """Whether each goal's required criteria allow completion, with the failures.

    ``criteria``: goal_id, criterion_id, required (a goal declares a handful). ``audits``:
    goal_id, criterion_id, seq, result, evidence_exists.
    """
    last = audits.groupBy("goal_id", "criterion_id").agg(F.max_by(F.struct("result", "evidence_exists"), "seq").alias("_a"))
    rows = criteria.where("required").join(last, ["goal_id", "criterion_id"], "left")
    result, has = F.col("_a.result"), F.coalesce(F.col("_a.evidence_exists"), F.lit(False))
    needs = result.isin(*EVIDENCE_RESULTS)
    failure = (
        F.when(F.col("_a").isNull(), F.concat_ws(" ", "criterion_id", F.lit("has no audit row")))
        .when(~result.isin(*COMPLETION_RESULTS), F.concat_ws(" ", "criterion_id", F.lit("latest result is"), result))
        .when(needs & ~has, F.concat_ws(" ", "criterion_id", F.lit("cites no existing evidence")))
    )
    agg = rows.groupBy("goal_id").agg(
        F.array_sort(F.collect_list(failure)).alias("failures"),
        F.count_if(F.coalesce(needs & has, F.lit(False))).alias("evidence_backed"),
    )
    vacuous = (F.size("failures") == 0) & (F.col("evidence_backed") == 0)
    failures = F.when(vacuous, F.array(F.lit("nothing on file supports a required criterion"))).otherwise(F.col("failures"))
    return agg.withColumn("failures", failures).withColumn("can_complete", F.size("failures") == 0)


# --- registry -------------------------------------------------------------------------


def tag_table(factors: DataFrame, fields: DataFrame, operators: DataFrame) -> DataFrame:
    """Tags of factors, panel fields and operators in one table."""
    none = F.lit(None)
    return (
        fields.select(F.lit("field").alias("subject_kind"), F.col("field").alias("subject_id"), F.col("role").alias("theme"), none.cast("int").alias("horizon"))
        .unionByName(operators.select(F.lit("operator").alias("subject_kind"), F.col("name").alias("subject_id"), F.col("category").alias("theme"), none.cast("int").alias("horizon")))
        .unionByName(factors.select(F.lit("factor").alias("subject_kind"), F.col("factor_id").alias("subject_id"), F.col("category").alias("theme"), F.col("horizon").cast("int").alias("horizon")))
    )


def registry_table(definitions: DataFrame, tags: DataFrame, stored: DataFrame) -> DataFrame:
    """Definitions with their tags; value presence is null for formulas computed on demand."""
    t = tags.where("subject_kind = 'factor'").select(F.col("subject_id").alias("factor_id"), "theme")
    s = stored.select("factor_id").distinct().withColumn("_s", F.lit(True))
    out = definitions.join(t, "factor_id", "left").join(s, "factor_id", "left")
    present = F.when(F.col("formula").startswith("precomputed:"), F.coalesce(F.col("_s"), F.lit(False)))
    return out.withColumn("values_present", present).drop("_s")


def data_window(labelled: DataFrame) -> DataFrame:
    """Observed date range per factor; unavailable when nothing is labelled."""
    dated = F.when(F.col("forward_return").isNotNull(), F.col("trade_date"))
    agg = labelled.groupBy("factor_id").agg(F.min(dated).alias("start_date"), F.max(dated).alias("end_date"))
    return agg.withColumn("status", F.when(F.col("start_date").isNotNull(), "available").otherwise("unavailable"))
