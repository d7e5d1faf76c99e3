"""Registered queries: filters, text rules, score preparation, stored factor values."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswind.functions import signals as S
from crosswind.functions import text as T
from crosswind.operators import scores as C
from crosswind.operators.cross_section import CrossSection
from crosswind.plans.common import cross, keyed, panel
from crosswind.plans.panel_queries import KEY, RANK, with_sql
from crosswind.plans.registry import panel_sql, query, r6, register
from crosswind.session import durable, scratch_path
from crosswind.sources import jsonl as J
from crosswind.sources import values as V
from crosswind.sources.panel import parse_date, table

START, END = "1999-01-01", "2000-12-31"
ST_FILTER = ("is_st == false",)


def momentum(filters=()) -> C.Factor:
    """Row-lag momentum written as a signal, so its look-back (5 rows) is known."""
    close = S.field("close")
    return C.Factor.of("FTR-MOM", close / S.delay(close, 5) - 1, filters=filters, formula="close / delay(close, 5) - 1")


def ranked_momentum(df, xs):
    sig = S.field("close") / S.delay("close", 5) - 1
    return xs.rank(df.withColumn("_m", sig.col), "_m", "score").drop("_m")


RANKED = C.Factor("FTR-RANK-MOM", ranked_momentum, lookback=5, filters=ST_FILTER, formula="rank(close / delay(close, 5) - 1)")

# --- filters and coercions ----------------------------------------------------------

register(
    "e12_universe_filter",
    lambda spark, d: keyed(C.universe_mask(panel(spark, d).withColumn("score", F.col("return_5d")), ST_FILTER), "score"),
    panel_sql(f"SELECT {KEY}, CASE WHEN NOT is_st THEN return_5d END AS score FROM panel"),
)
register(
    "e13_date_window",
    lambda spark, d: keyed(C.date_window(panel(spark, d), START, END), "close"),
    panel_sql(f"SELECT {KEY}, close FROM panel WHERE trade_date BETWEEN DATE '{START}' AND DATE '{END}'"),
)
register(
    "e14_context_window",
    lambda spark, d: keyed(C.context_window(panel(spark, d), 5, START, END), "close"),
    panel_sql(f"SELECT {KEY}, close FROM panel WHERE trade_date <= DATE '{END}'"),
)

# Dates and numbers as loose text: compact, ISO or broken dates, broken numbers.
MESSY_SQL = """
messy AS (
  SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d')
         WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS day_text,
         CASE WHEN o_orderkey % 4 = 0 THEN 'bad' ELSE CAST(CAST(o_orderkey AS BIGINT) AS VARCHAR) END AS number_text
  FROM orders)
"""


@query(
    "e15_pct_coercions",
    with_sql(
        "SELECT o_orderkey, COALESCE(CAST(TRY_STRPTIME(day_text, '%Y%m%d') AS DATE), CAST(TRY_STRPTIME(day_text, '%Y-%m-%d') AS DATE)) AS day, "
        "TRY_CAST(number_text AS DOUBLE) AS number FROM messy",
        MESSY_SQL,
    ),
)
def coercions(spark, d):
    k = F.col("o_orderkey")
    messy = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise("n/a")
        .alias("day_text"),
        F.when(k % 4 == 0, "bad").otherwise(k.cast("string")).alias("number_text"),
    )
    return messy.select("o_orderkey", parse_date("day_text").alias("day"), F.col("number_text").try_cast("double").alias("number"))


# --- text rules ---------------------------------------------------------------------


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


REDACT_SQL = f"regexp_replace(text, {sql_text(T.SECRET)}, '\\1={T.REDACTED_VALUE}', 'g')"
for _pattern in T.PATHS:
    REDACT_SQL = f"regexp_replace({REDACT_SQL}, {sql_text(_pattern)}, '{T.REDACTED_PATH}', 'g')"

register(
    "e16_redact_text",
    lambda spark, d: table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted")),
    f"SELECT doc_id, {REDACT_SQL} AS redacted FROM documents",
)


def idea_sql(column: str) -> str:
    low = "lower(trim(text))"
    hit = lambda words: "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"
    cases = []
    for words, name, formula in T.IDEA_RULES:
        value = f"'{name if column == 'name' else formula}'"
        if column == "name" and name == "small_cap":
            value = f"CASE WHEN {hit(T.NON_ST_WORDS)} THEN 'small_cap_non_st' ELSE 'small_cap' END"
        cases.append(f"WHEN {hit(words)} THEN {value}")
    if column == "non_st":
        return hit(T.NON_ST_WORDS)
    return "CASE " + " ".join(cases) + f" ELSE '{T.IDEA_DEFAULT[column == 'formula']}' END"


@query(
    "e21_idea_keyword_rules",
    "WITH t AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' Small Cap' WHEN 1 THEN ' momentum non-ST' WHEN 2 THEN ' 波动' "
    "WHEN 3 THEN ' small cap, non ST' WHEN 4 THEN ' Liquidity' ELSE '' END AS text FROM documents) "
    f"SELECT doc_id, {idea_sql('name')} AS name, {idea_sql('formula')} AS formula, {idea_sql('non_st')} AS non_st FROM t",
)
def ideas(spark, d):
    k = F.col("doc_id") % 6
    tail = (
        F.when(k == 0, " Small Cap").when(k == 1, " momentum non-ST").when(k == 2, " 波动")
        .when(k == 3, " small cap, non ST").when(k == 4, " Liquidity").otherwise("")
    )
    rule = T.idea_rule(F.concat("text", tail))
    return table(spark, d, "documents").select("doc_id", rule.alias("r")).select("doc_id", "r.*")


# Definitions: every part is one version of a factor definition; few ids, many versions.
DEFS_SQL = """
defs AS (
  SELECT p_partkey AS seq, replace(p_brand, '#', '-') || '_' || p_type AS factor_id,
         list_extract(['ts_mean', 'ts_stddev', 'rolling_std', 'ts_corr', 'STDDEV', 'industry_neutralize'], CAST(p_size % 6 AS INTEGER) + 1)
           || '( ' || split_part(p_name, ' ', 1) || ', ' || CAST(p_size % 20 + 2 AS VARCHAR) || ' ) - Rank(' || split_part(p_name, ' ', 2) || ')' AS formula,
         list_extract([5, 10, 21, 63], CAST(p_partkey % 4 AS INTEGER) + 1) AS horizon,
         list_extract(['is_st == false', '', 'not is_st'], CAST(p_size % 3 AS INTEGER) + 1) AS filters,
         CASE WHEN p_size % 10 = 0 THEN 'rd' ELSE lower(p_type) END AS source,
         p_size % 7 = 0 AS deleted
  FROM part)
"""


def definitions(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    words = F.split("p_name", " ")
    ops = F.array(*[F.lit(o) for o in ("ts_mean", "ts_stddev", "rolling_std", "ts_corr", "STDDEV", "industry_neutralize")])
    return table(spark, d, "part").select(
        key.alias("seq"),
        F.concat(F.regexp_replace("p_brand", "#", "-"), F.lit("_"), F.col("p_type")).alias("factor_id"),
        F.concat(
            F.get(ops, size % 6), F.lit("( "), F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(", "), (size % 20 + 2).cast("string"),
            F.lit(" ) - Rank("), F.coalesce(F.get(words, F.lit(1)), F.lit("")), F.lit(")"),
        ).alias("formula"),
        F.get(F.array(*[F.lit(h) for h in (5, 10, 21, 63)]), (key % 4).cast("int")).alias("horizon"),
        F.get(F.array(F.lit("is_st == false"), F.lit(""), F.lit("not is_st")), size % 3).alias("filters"),
        F.when(size % 10 == 0, "rd").otherwise(F.lower("p_type")).alias("source"),
        (size % 7 == 0).alias("deleted"),
    )


register(
    "e17_canonical_fingerprint",
    lambda spark, d: definitions(spark, d).select(
        "seq", T.canonical_fingerprint(horizon=F.col("horizon"), factor_id=F.col("factor_id"), formula=F.col("formula")).alias("fingerprint")
    ),
    with_sql(
        "SELECT seq, sha256('{\"factor_id\":\"' || factor_id || '\",\"formula\":\"' || formula || '\",\"horizon\":' || CAST(horizon AS VARCHAR) || '}') AS fingerprint FROM defs",
        DEFS_SQL,
    ),
)
FINGERPRINT_SQL = (
    "sha256(lower(regexp_replace(formula, '\\s+', '', 'g')) || '|' || CAST(horizon AS VARCHAR) || '|' || "
    "lower(regexp_replace(filters, '\\s+', '', 'g')))"
)


def with_fingerprint(df):
    return df.withColumn("fingerprint", T.formula_fingerprint(F.col("formula"), F.col("horizon"), F.array("filters")))


register(
    "e18_formula_fingerprint",
    lambda spark, d: with_fingerprint(definitions(spark, d)).select("seq", "fingerprint"),
    with_sql(f"SELECT seq, {FINGERPRINT_SQL} AS fingerprint FROM defs", DEFS_SQL),
)
register(
    "e19_formula_signature",
    lambda spark, d: definitions(spark, d).select(
        "seq",
        T.canonical_fingerprint(
            factor_id=F.col("factor_id"), formula=F.col("formula"), universe_filters=F.array_compact(F.array(F.when(F.col("filters") != "", F.col("filters"))))
        ).alias("signature"),
    ),
    with_sql(
        "SELECT seq, sha256('{\"factor_id\":\"' || factor_id || '\",\"formula\":\"' || formula || '\",\"universe_filters\":[' || "
        "CASE WHEN filters <> '' THEN '\"' || filters || '\"' ELSE '' END || ']}') AS signature FROM defs",
        DEFS_SQL,
    ),
)
register(
    "e20_operator_alias_rewrite",
    lambda spark, d: definitions(spark, d).select(
        "seq", T.rewrite_aliases(F.col("formula")).alias("canonical"), T.alias_status(F.col("formula")).alias("status")
    ),
    with_sql(
        "SELECT seq, regexp_replace(formula, '\\bts_stddev\\s*\\(', 'stddev(', 'g') AS canonical, "
        "CASE WHEN regexp_matches(formula, '\\bindustry_neutralize\\s*\\(') THEN 'requires_draft' "
        "WHEN regexp_matches(formula, '\\b(rolling_std|ts_corr|ts_cov)\\s*\\(') THEN 'requires_repair' "
        "WHEN regexp_matches(formula, '\\bts_stddev\\s*\\(') THEN 'rewritten' ELSE 'canonical' END AS status FROM defs",
        DEFS_SQL,
    ),
)

# --- definitions and catalog --------------------------------------------------------

CURRENT_SQL = (
    "cur AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY factor_id ORDER BY seq DESC) AS rn FROM defs) WHERE rn = 1 AND NOT deleted)"
)
register(
    "s24_definitions_table",
    lambda spark, d: V.current_definitions(definitions(spark, d)).select("factor_id", "seq", "formula", "horizon", "filters", "source"),
    with_sql("SELECT factor_id, seq, formula, horizon, filters, source FROM cur", DEFS_SQL, CURRENT_SQL),
)


# Stored factors as found in several stores: every supplier claims one, under varying spelling.
LISTING_SQL = """
listing AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Brand-' ELSE 'brand_' END || CAST(s_suppkey % 40 AS VARCHAR) || '_ECONOMY' AS factor_id,
         CASE WHEN s_suppkey % 5 = 0 THEN 'mounted' ELSE 'local' END AS source, s_suppkey % 3 AS priority
  FROM supplier)
"""
CHOSEN_SQL = """
keyed AS (SELECT *, replace(lower(trim(factor_id)), '-', '_') AS factor_key FROM listing),
top AS (SELECT * FROM keyed k WHERE priority = (SELECT MAX(priority) FROM keyed j WHERE j.factor_key = k.factor_key)),
claims AS (SELECT factor_key, priority, COUNT(DISTINCT (source, factor_id)) AS claims, MIN({'s': source, 'f': factor_id}) AS pick
           FROM top GROUP BY 1, 2)
"""


def listing(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.when(k % 2 == 0, "Brand-").otherwise("brand_"), (k % 40).cast("string"), F.lit("_ECONOMY")).alias("factor_id"),
        F.when(k % 5 == 0, "mounted").otherwise("local").alias("source"),
        (k % 3).alias("priority"),
    )


@query(
    "s21_discover_precomputed",
    with_sql(
        "SELECT factor_key, priority, claims, CASE WHEN claims = 1 THEN pick.f END AS factor_id, CASE WHEN claims = 1 THEN pick.s END AS source FROM claims",
        LISTING_SQL,
        CHOSEN_SQL,
    ),
)
def discover(spark, d):
    chosen, clash = V.discover_precomputed(listing(spark, d))
    none = F.lit(None).cast("string")
    return chosen.withColumn("claims", F.lit(1).cast("bigint")).unionByName(
        clash.withColumns({"factor_id": none, "source": none})
    )


@query(
    "s22_import_precomputed",
    with_sql(
        "SELECT w AS wanted, CASE WHEN pick IS NULL THEN 'missing' ELSE 'draft' END AS status FROM "
        "(SELECT DISTINCT replace(p_brand, '#', '-') || '_ECONOMY' AS w FROM part) LEFT JOIN (SELECT * FROM claims WHERE claims = 1) "
        "ON factor_key = replace(lower(w), '-', '_')",
        LISTING_SQL,
        CHOSEN_SQL,
    ),
)
def import_factors(spark, d):
    wanted = table(spark, d, "part").select(F.concat(F.regexp_replace("p_brand", "#", "-"), F.lit("_ECONOMY")).alias("wanted")).distinct()
    hits, missing = V.import_precomputed(V.discover_precomputed(listing(spark, d))[0], wanted)
    found = wanted.withColumn("factor_key", V.canonical_id("wanted")).join(hits, "factor_key").select("wanted", "status")
    return found.unionByName(missing.withColumn("status", F.lit("missing")))


@query(
    "s25_list_catalog",
    with_sql(
        "SELECT factor_id, replace(lower(factor_id), '-', '_') AS factor_key, 'local' AS origin FROM cur UNION ALL "
        "SELECT pick.f, factor_key, 'discovered' FROM claims WHERE claims = 1 AND factor_key NOT IN (SELECT replace(lower(factor_id), '-', '_') FROM cur)",
        DEFS_SQL, CURRENT_SQL, LISTING_SQL, CHOSEN_SQL,
    ),
)
def catalog(spark, d):
    return V.list_catalog(V.current_definitions(definitions(spark, d)), V.discover_precomputed(listing(spark, d))[0])


@query(
    "s26_factor_category",
    "WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'gtja_rd_' WHEN 1 THEN 'RD_TOP' WHEN 2 THEN 'RD_TOPPING_' ELSE 'ftr_' END || "
    "CASE WHEN p_partkey % 4 = 1 THEN '' ELSE p_name END AS factor_id, CASE WHEN p_size % 9 = 0 THEN ' RD ' ELSE p_type END AS source FROM part) "
    "SELECT p_partkey, CASE WHEN lower(trim(source)) IN ('synthetic', 'composite', 'rd') OR regexp_matches(factor_id, '(?i)^GTJA_RD(_|$)') "
    "OR regexp_matches(factor_id, '(?i)^RD_(SYN|TOP)(_|$)') THEN 'synthetic' ELSE 'original' END AS category FROM n",
)
def category(spark, d):
    k = F.col("p_partkey") % 4
    fid = F.concat(
        F.when(k == 0, "gtja_rd_").when(k == 1, "RD_TOP").when(k == 2, "RD_TOPPING_").otherwise("ftr_"),
        F.when(k == 1, "").otherwise(F.col("p_name")),
    )
    source = F.when(F.col("p_size") % 9 == 0, " RD ").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", V.factor_category(fid, F.lit(None).cast("string"), source).alias("category"))


# --- score preparation --------------------------------------------------------------

EWM_SQL = """
seq AS (SELECT trade_date, instrument, x, ROW_NUMBER() OVER (PARTITION BY instrument ORDER BY trade_date) AS p FROM ewm_in),
fold AS (
  SELECT instrument, p, trade_date, x, x AS m, CAST(1.0 AS DOUBLE) AS w FROM seq WHERE p = 1
  UNION ALL
  SELECT s.instrument, s.p, s.trade_date, s.x,
         CASE WHEN f.m IS NULL THEN s.x WHEN s.x IS NULL THEN f.m
              ELSE (f.w * (1 - a) * f.m + a * s.x) / (f.w * (1 - a) + a) END,
         CASE WHEN f.m IS NULL OR s.x IS NOT NULL THEN 1.0 ELSE f.w * (1 - a) END
  FROM fold f JOIN seq s ON s.instrument = f.instrument AND s.p = f.p + 1, (SELECT 2.0 / (5 + 1.0) AS a))
"""
register(
    "t14_ewm_decay",
    lambda spark, d: C.ewm_decay(keyed(panel(spark, d), F.when(~F.col("is_st"), F.col("return_1d")).alias("score")), 5).withColumn("score", r6("score")),
    panel_sql(
        f"SELECT {KEY}, ROUND(CASE WHEN x IS NOT NULL THEN m END, 6) AS score FROM fold",
        "ewm_in AS (SELECT trade_date, instrument, CASE WHEN NOT is_st THEN return_1d END AS x FROM panel)",
        EWM_SQL,
    ),
)
register(
    "t15_forward_fill_mark",
    lambda spark, d: keyed(
        panel(spark, d).withColumn("v", F.when(~F.col("is_st"), F.col("close"))), F.last("v", ignorenulls=True).over(S.KEYS.over_series()).alias("value")
    ),
    panel_sql(f"SELECT {KEY}, LAST_VALUE(CASE WHEN NOT is_st THEN close END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY trade_date) AS value FROM panel"),
)


@query(
    "t16_look_back_rows",
    panel_sql(
        "SELECT COUNT(*) AS panel_rows, COUNT(*) FILTER (WHERE p <= 19) AS warm_up_rows, 19 AS lookback FROM "
        "(SELECT ROW_NUMBER() OVER (PARTITION BY instrument ORDER BY trade_date) AS p FROM panel)"
    ),
)
def look_back(spark, d):
    need = (S.ts_mean(S.delta("close", 10), 10) - S.delay("close", 3)).lookback
    df = panel(spark, d)
    warm = C.warm_up_keys(df, need).withColumn("warm", F.lit(1))
    return df.join(warm, C.ROW, "left").agg(
        F.count(F.lit(1)).alias("panel_rows"), F.count("warm").alias("warm_up_rows")
    ).withColumn("lookback", F.lit(need))


@query(
    "p01_factor_scores",
    panel_sql(
        f"SELECT {KEY}, ROUND(CASE WHEN x IS NOT NULL THEN m END, 6) AS score FROM fold WHERE trade_date >= DATE '{START}'",
        "win AS (SELECT * FROM panel WHERE trade_date <= DATE '" + END + "')",
        f"rk AS (SELECT trade_date, instrument, is_st, {RANK.format(x='return_5d')} AS r FROM win)",
        "ewm_in AS (SELECT trade_date, instrument, CASE WHEN NOT is_st THEN r END AS x FROM rk)",
        EWM_SQL,
    ),
)
def scores_end_to_end(spark, d):
    out = C.factor_scores(panel(spark, d), RANKED, cross(spark, d), START, END, decay=5)
    return out.withColumn("score", r6("score"))


NESTED_SQL = panel_sql(
    f"SELECT {KEY}, ROUND(CASE WHEN NOT is_st AND v IS NOT NULL THEN LEAST(GREATEST(CEIL(v * 5), 1), 5) - z END, 6) AS score FROM n3",
    f"n1 AS (SELECT *, {RANK.format(x='return_5d')} AS r FROM panel)",
    "n2 AS (SELECT *, r - LAG(r, 3) OVER (PARTITION BY instrument ORDER BY trade_date) AS d, "
    "(volume - AVG(volume) OVER w) / NULLIF(CASE WHEN MIN(volume) OVER w < MAX(volume) OVER w THEN STDDEV_SAMP(volume) OVER w END, 0) AS z FROM n1 WINDOW w AS (PARTITION BY trade_date))",
    f"n3 AS (SELECT *, {RANK.format(x='d')} AS v FROM n2)",
)


def nested(spark, d, xs):
    """Fifths of the change of a rank, less a standardised volume: cross-sections above a series above a cross-section."""
    ranked = S.rank(S.field("return_5d"))
    factor = C.Factor.of("NEST", S.ntile(S.delta(ranked, 3), 5) - S.zscore(S.field("volume")), filters=("is_st == false",))
    # Wide dates store each step with all columns of the panel, so it has those that the factor reads alone.
    return C.factor_scores(keyed(panel(spark, d), "return_5d", "volume", "is_st"), factor, xs).withColumn("score", r6("score"))


register("p01_nested_ranks", lambda spark, d: nested(spark, d, cross(spark, d)), NESTED_SQL)
register("p01_nested_ranks_wide", lambda spark, d: nested(spark, d, CrossSection(wide=True)), NESTED_SQL)

register(
    "p02_restrict_to_keys",
    lambda spark, d: C.restrict_to_keys(keyed(panel(spark, d), "close"), panel(spark, d).where("is_st")),
    panel_sql(f"SELECT {KEY}, close FROM panel WHERE is_st"),
)


def cached_scores(df):
    """A cache with holes: nothing stored from the given months, warm-up nulls kept."""
    hole = (F.year("trade_date") == 2000) & (F.month("trade_date") == 3)
    return keyed(df.where(~hole), F.col("return_5d").alias("score"))


HOLE = "(year(trade_date) = 2000 AND month(trade_date) = 3)"
POS_SQL = f"pos AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY instrument ORDER BY trade_date) AS p, CASE WHEN {HOLE} THEN 1 END AS miss FROM panel)"

register(
    "p03_missing_keys",
    lambda spark, d: C.missing_keys(C.required_keys(panel(spark, d)), cached_scores(panel(spark, d))),
    panel_sql(f"SELECT {KEY} FROM panel WHERE {HOLE}"),
)


@query(
    "p04_trusted_cache",
    panel_sql(f"SELECT {KEY}, CASE WHEN NOT is_st THEN return_5d END AS score FROM pos WHERE NOT {HOLE} AND (p <= 5 OR NOT is_st)", POS_SQL),
)
def trusted(spark, d):
    df = panel(spark, d)
    holed = C.universe_mask(df.withColumn("score", F.col("return_5d")), ST_FILTER)
    return C.trusted_cache(cached_scores(holed.withColumn("return_5d", F.col("score"))), df, 5)


register(
    "p05_required_keys",
    lambda spark, d: C.required_keys(panel(spark, d), ST_FILTER),
    panel_sql(f"SELECT {KEY} FROM panel WHERE NOT is_st"),
)
CONTEXT_SQL = (
    "need AS (SELECT trade_date FROM (SELECT trade_date, MAX(miss) OVER (PARTITION BY instrument ORDER BY trade_date "
    "ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS m FROM pos) WHERE m = 1 GROUP BY 1)"
)


@query("p06_look_back_context", panel_sql("SELECT trade_date FROM need", POS_SQL, CONTEXT_SQL))
def context(spark, d):
    df = panel(spark, d)
    return C.context_dates(df, C.missing_keys(C.required_keys(df), cached_scores(df)), 5)


@query(
    "p07_incremental_mode",
    panel_sql(
        "SELECT CASE WHEN missing_rows = 0 THEN 'cache_only' WHEN ratio >= 0.5 OR ctx >= FLOOR(panel_rows * 0.8) THEN 'full_recompute' "
        "WHEN ratio >= 0.05 THEN 'date_block_incremental' ELSE 'sparse_incremental' END AS mode, required_rows, missing_rows, "
        "ratio AS missing_ratio, CASE WHEN missing_rows = 0 THEN 0 WHEN ratio >= 0.5 OR ctx >= FLOOR(panel_rows * 0.8) THEN panel_rows ELSE ctx END AS context_rows FROM ("
        "SELECT COUNT(*) AS panel_rows, COUNT(*) AS required_rows, COUNT(miss) AS missing_rows, COUNT(miss) / CAST(COUNT(*) AS DOUBLE) AS ratio, "
        "COUNT(*) FILTER (WHERE trade_date IN (SELECT trade_date FROM need)) AS ctx FROM pos)",
        POS_SQL, CONTEXT_SQL,
    ),
)
def mode(spark, d):
    df = durable(panel(spark, d).select("trade_date", "instrument", "close", "return_5d"))
    required = C.required_keys(df)
    return C.incremental_report(df, required, C.missing_keys(required, cached_scores(df)), 5)


@query(
    "p08_incremental_compute",
    panel_sql(f"SELECT {KEY}, return_5d AS score, CASE WHEN {HOLE} THEN 'computed' ELSE 'cached' END AS source FROM panel"),
)
def incremental(spark, d):
    df = durable(panel(spark, d).select("trade_date", "instrument", "close", "is_st", "return_5d"))
    return C.incremental_scores(df, momentum(), cached_scores(df), cross(spark, d), "sparse_incremental")


def ranked_twice() -> C.Factor:
    """A rank of an older rank of momentum: history counts for all names of a date, twice."""
    close = S.field("close")
    return C.Factor.of("FTR-RANKED-TWICE", S.rank(S.delay(S.rank(close / S.delay(close, 5) - 1), 2)))


NAME_HOLE = "(instrument LIKE '%3' AND year(trade_date) = 1998 AND month(trade_date) = 3)"


@query(
    "p08_incremental_ranked",
    panel_sql(
        f"SELECT {KEY}, ROUND({RANK.format(x='older')}, 6) AS score, CASE WHEN {NAME_HOLE} THEN 'computed' ELSE 'cached' END AS source FROM lagged",
        f"ranked AS (SELECT {KEY}, {RANK.format(x='return_5d')} AS r FROM panel)",
        f"lagged AS (SELECT {KEY}, LAG(r, 2) OVER (PARTITION BY instrument ORDER BY trade_date) AS older FROM ranked)",
    ),
)
def incremental_ranked(spark, d):
    """Stored ranks lack some names on some dates; the mode is the one that the report names."""
    df, factor, xs = durable(keyed(panel(spark, d), "close", "is_st")), ranked_twice(), cross(spark, d)
    cached = durable(factor.build(df, xs).where(f"NOT {NAME_HOLE}").select("trade_date", "instrument", "score"))
    required = durable(C.required_keys(df))
    report = C.incremental_report(df, required, durable(C.missing_keys(required, cached)), factor.needs)
    out = C.incremental_scores(df, factor, cached, xs, report.first()["mode"])
    return keyed(out, r6("score").alias("score"), "source")


@query(
    "p09_dedupe_last",
    "SELECT l_orderkey, l_suppkey, l_linenumber AS seq, l_extendedprice AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, "
    "l_suppkey ORDER BY l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1",
)
def last_wins(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_suppkey", F.struct("l_linenumber", "l_extendedprice").alias("order"), F.col("l_extendedprice").alias("score")
    )
    kept = C.dedupe_last(rows, ["l_orderkey", "l_suppkey"], "order")
    return kept.select("l_orderkey", "l_suppkey", F.col("order.l_linenumber").alias("seq"), "score")


@query(
    "p10_score_source",
    panel_sql(
        "SELECT instrument, CASE WHEN co THEN CASE WHEN cached <= 0 THEN 'factor_values_missing' WHEN req > 0 AND cached < req THEN 'factor_values_cached_partial' "
        "ELSE 'factor_values_cached' END WHEN computed > 0 THEN 'factor_values_incremental' WHEN cached > 0 THEN 'factor_values_cached' ELSE 'computed_formula' END AS score_source "
        "FROM (SELECT instrument, MIN(industry) <> MAX(industry) OR CAST(substr(instrument, 13, 1) AS INTEGER) % 2 = 0 AS co, COUNT(*) FILTER (WHERE NOT is_st) AS req, "
        "COUNT(*) FILTER (WHERE year(trade_date) < 2001 AND NOT is_st) AS cached, COUNT(*) FILTER (WHERE year(trade_date) >= 2001 AND is_st) AS computed FROM panel GROUP BY 1)"
    ),
)
def source_label(spark, d):
    old = F.year("trade_date") < 2001
    counts = panel(spark, d).groupBy("instrument").agg(
        (F.substring("instrument", 13, 1).cast("int") % 2 == 0).alias("cache_only"),
        F.count_if(~F.col("is_st")).alias("required_rows"),
        F.count_if(old & ~F.col("is_st")).alias("cached_rows"),
        F.count_if(~old & F.col("is_st")).alias("computed_rows"),
    )
    return C.score_source(counts).select("instrument", "score_source")


register(
    "p11_min_window_guard",
    lambda spark, d: C.min_window_guard(C.date_window(panel(spark, d), START, END)),
    panel_sql(
        "SELECT COUNT(DISTINCT trade_date) AS dates, 126 AS minimum_required, COUNT(DISTINCT trade_date) >= 126 AS ok FROM panel "
        f"WHERE trade_date BETWEEN DATE '{START}' AND DATE '{END}'"
    ),
)
register(
    "p12_cache_only_scores",
    lambda spark, d: C.cache_only_scores(panel(spark, d), cached_scores(panel(spark, d)), ST_FILTER),
    panel_sql(f"SELECT {KEY}, CASE WHEN NOT is_st THEN return_5d END AS score FROM panel WHERE NOT {HOLE}"),
)

# --- stored values ------------------------------------------------------------------

SIGNATURE = V.formula_signature("FTR-MOM", "close / delay(close, 5) - 1")


def build_store(spark, d) -> str:
    """A store with an unsigned root layer, a signed incremental layer and another factor."""
    path = scratch_path(spark, "values")
    df = durable(keyed(panel(spark, d), "return_5d", "volume", "is_st"))  # every write reads it
    mom = keyed(df, F.col("return_5d").alias("score"))
    fresh = keyed(df.where("is_st"), (F.col("return_5d") * 2).alias("score"))
    V.write_values(V.to_rows(mom.where(F.year("trade_date") < 2000), "FTR-MOM", None, "root", 0), path)
    V.write_values(V.to_rows(mom.where(F.year("trade_date") >= 1999), "FTR-MOM", SIGNATURE, "incremental", 1), path)
    V.write_values(V.to_rows(fresh, "FTR-MOM", SIGNATURE, "incremental", 2), path)
    V.write_values(V.to_rows(keyed(df, F.col("volume").alias("score")), "FTR-VOL", "other", "root", 0), path)
    return path


SIGNED = f"SELECT {KEY}, CASE WHEN is_st THEN return_5d * 2 ELSE return_5d END AS score FROM panel WHERE is_st OR year(trade_date) >= 1999"


@query("s16_factor_values_scan", panel_sql(SIGNED))
def values_scan(spark, d):
    return V.factor_values(V.read_values(spark, build_store(spark, d), ["ftr_mom"]), ["ftr_mom"], SIGNATURE)


@query(
    "s17_unsigned_value_policy",
    panel_sql(SIGNED + f" UNION ALL SELECT {KEY}, return_5d FROM panel WHERE NOT is_st AND year(trade_date) < 1999"),
)
def unsigned_values(spark, d):
    return V.factor_values(V.read_values(spark, build_store(spark, d), ["FTR_MOM"]), ["FTR_MOM"], SIGNATURE, allow_unsigned=True)


@query(
    "s18_factor_values_upsert_sink",
    panel_sql(
        f"SELECT {KEY}, CASE WHEN is_st THEN -1.0 ELSE return_5d END AS factor_value, CASE WHEN is_st THEN 5 ELSE 1 END AS seq, 'FTR-MOM' AS factor_id "
        f"FROM panel WHERE year(trade_date) = 2000 UNION ALL SELECT {KEY}, return_5d, 1, 'FTR-MOM' FROM panel WHERE year(trade_date) <> 2000 UNION ALL "
        f"SELECT {KEY}, volume, 1, 'FTR-VOL' FROM panel"
    ),
)
def upsert_sink(spark, d):
    path = scratch_path(spark, "upsert")
    df = panel(spark, d)
    base = V.to_rows(keyed(df, F.col("return_5d").alias("score")), "FTR-MOM", SIGNATURE, "root", 1)
    V.write_values(base.unionByName(V.to_rows(keyed(df, F.col("volume").alias("score")), "FTR-VOL", "other", "root", 1)), path)
    fixes = df.where(F.col("is_st") & (F.year("trade_date") == 2000))
    V.upsert(spark, path, V.to_rows(keyed(fixes, F.lit(-1.0).alias("score")), "FTR-MOM", SIGNATURE, "incremental", 5))
    return V.read_values(spark, path).select("trade_date", "instrument", "factor_value", F.col("seq").cast("int").alias("seq"), "factor_id")


@query(
    "s19_has_stored_values",
    panel_sql(
        "SELECT 'FTR-MOM' AS factor_id, COUNT(*) FILTER (WHERE year(trade_date) < 2000) + COUNT(*) FILTER (WHERE year(trade_date) >= 1999) + COUNT(*) FILTER (WHERE is_st) AS stored_rows "
        "FROM panel UNION ALL SELECT 'FTR-VOL', COUNT(*) FROM panel"
    ),
)
def has_values(spark, d):
    path = build_store(spark, d)
    assert V.has_values(spark, path, "FTR-MOM") and not V.has_values(spark, path, "FTR-NONE")
    return V.stored_factors(V.read_values(spark, path))


@query("s20_remove_stored_values", panel_sql(f"SELECT {KEY}, volume AS factor_value, 'FTR-VOL' AS factor_id FROM panel"))
def remove_values(spark, d):
    path = build_store(spark, d)
    owners = spark.createDataFrame([("FTR-MOM", "FTR-MOM"), ("FTR-VOL", "OTHER")], "factor_id string, owner_id string")
    V.remove_factor(spark, path, "FTR-MOM", owners)
    V.remove_factor(spark, path, "FTR-VOL", owners)
    return V.read_values(spark, path).select("trade_date", "instrument", "factor_value", "factor_id")


COMPACT_SQL = """
src AS (
  SELECT 'store' AS source, TRUE AS canonical, 'Mom' AS factor_id, trade_date, instrument, close AS v FROM panel WHERE year(trade_date) < 2000
  UNION ALL SELECT 'late', FALSE, 'mom', trade_date, instrument, close FROM panel WHERE year(trade_date) >= 1999
  UNION ALL SELECT 'wrong', FALSE, 'MOM', trade_date, instrument, close + 1 FROM panel WHERE is_st
  UNION ALL SELECT 'same', FALSE, 'mom', trade_date, instrument, close FROM panel WHERE year(trade_date) = 1998 AND NOT is_st
  UNION ALL SELECT 'new', FALSE, 'vol-1', trade_date, instrument, volume FROM panel),
clash AS (SELECT replace(lower(factor_id), '-', '_') AS k, trade_date, instrument, MIN(v) < MAX(v) AS c, BOOL_OR(canonical) AS b FROM src GROUP BY 1, 2, 3),
per AS (
  SELECT k AS factor_key, source, canonical, COUNT(*) AS source_rows, COUNT(*) FILTER (WHERE c) AS conflict_rows, COUNT(*) FILTER (WHERE NOT b) AS new_rows
  FROM src JOIN clash USING (trade_date, instrument) WHERE k = replace(lower(factor_id), '-', '_') GROUP BY 1, 2, 3)
"""


@query(
    "s23_compact_factor_store",
    panel_sql(
        "SELECT factor_key, source, source_rows, conflict_rows, new_rows, CASE WHEN canonical THEN 'canonical' WHEN conflict_rows > 0 THEN 'conflicted' "
        "WHEN factor_key NOT IN (SELECT factor_key FROM per WHERE canonical) THEN 'create' WHEN new_rows > 0 THEN 'merge' ELSE 'skipped' END AS action FROM per",
        COMPACT_SQL,
    ),
)
def compact(spark, d):
    df = durable(keyed(panel(spark, d), "close", "volume", "is_st"))  # every source reads it

    def part(source, canonical, fid, rows, value="close"):
        return keyed(rows, F.col(value).alias("factor_value"), F.lit(source).alias("source"), F.lit(canonical).alias("canonical"), F.lit(fid).alias("factor_id"))

    year = F.year("trade_date")
    src = part("store", True, "Mom", df.where(year < 2000))
    for p in (
        part("late", False, "mom", df.where(year >= 1999)),
        part("wrong", False, "MOM", df.where("is_st").withColumn("close", F.col("close") + 1)),
        part("same", False, "mom", df.where((year == 1998) & ~F.col("is_st"))),
        part("new", False, "vol-1", df, "volume"),
    ):
        src = src.unionByName(p)
    return V.compact_store(src)[1]


# --- JSON ledgers -------------------------------------------------------------------


@query("s27_json_artifact_sink", panel_sql(f"SELECT {KEY}, volume, CASE WHEN volume > 25 THEN volume / (volume - 25) END AS ratio FROM panel"))
def artifact_sink(spark, d):
    path = scratch_path(spark, "artifact")
    ratio = F.when(F.col("volume") > 25, F.col("volume") / (F.col("volume") - 25)).otherwise(F.lit(float("nan")))
    J.write_results(keyed(panel(spark, d), "volume", ratio.alias("ratio")), path)
    return spark.read.schema("trade_date date, instrument string, volume double, ratio double").json(path)


@query(
    "s28_jsonl_tolerant_scan",
    "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0",
)
def tolerant_scan(spark, d):
    path = scratch_path(spark, "ledger")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    torn = F.when(F.col("event_id") % 7 == 0, F.expr("substring(line, 1, length(line) - 9)")).when(F.col("event_id") % 11 == 0, "[1, 2]")
    lines = table(spark, d, "events").select("event_id", line.alias("line")).select(F.coalesce(torn, "line").alias("value"))
    lines.write.text(path)
    rows = J.read_jsonl(spark, path, "event_id bigint, user_id bigint, event_type string, value double")
    return rows.where("event_id is not null")


@query("s29_jsonl_append_sink", "SELECT event_id, event_type FROM events")
def append_sink(spark, d):
    path = scratch_path(spark, "append")
    rows = table(spark, d, "events").select("event_id", "event_type")
    J.append_jsonl(rows.where("event_type = 'click'"), path)
    J.append_jsonl(rows.where("event_type <> 'click'"), path)
    return J.read_jsonl(spark, path, "event_id bigint, event_type string")


