"""Registered queries: panel sources, scalar, cross-sectional and time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswind.functions import signals as S
from crosswind.operators.cross_section import CrossSection
from crosswind.plans.common import cross, keyed, panel
from crosswind.plans.registry import ORACLES, QUERIES, PANEL_SQL, panel_sql, query, r6, register  # noqa: F401
from crosswind.session import dealt, durable, table_rows
from crosswind.sources import panel as P

KEY = "trade_date, instrument"
W = "OVER (PARTITION BY instrument ORDER BY trade_date)"


def trail(n: int) -> str:
    return f"OVER (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def signal(name: str, build, expr: str, exact: bool = False, frm: str = "panel", ctes: tuple[str, ...] = ()) -> None:
    """Register one Column-valued operator over the whole panel."""

    def run(spark, sf_dir):
        value = build().col
        return keyed(panel(spark, sf_dir), (value if exact else r6(value)).alias("value"))

    shown = expr if exact else f"ROUND({expr}, 6)"
    register(name, run, panel_sql(f"SELECT {KEY}, {shown} AS value FROM {frm}", *ctes))


# --- sources ------------------------------------------------------------------------


@query(
    "s01_panel_scan",
    panel_sql(
        f"SELECT {KEY}, close, volume, amount, market_cap, industry, is_st, return_1d, return_5d, "
        "ROUND(volatility_5d, 6) AS volatility_5d FROM panel"
    ),
)
def panel_scan(spark, sf_dir):
    df = panel(spark, sf_dir)
    return keyed(
        df, "close", "volume", "amount", "market_cap", "industry", "is_st", "return_1d", "return_5d",
        r6("volatility_5d").alias("volatility_5d"),
    )


@query(
    "s02_panel_path_resolve",
    panel_sql(
        f"SELECT {KEY}, close, market_cap, is_st, volume, ROUND(volatility_5d, 6) AS volatility_5d FROM panel"
    ),
)
def stored_panel(spark, sf_dir):
    """Written below a root folder with text dates and flags, found there, validated and read."""
    from crosswind.session import scratch_path

    root = scratch_path(spark, "root")
    loose = panel(spark, sf_dir).withColumn("trade_date", F.date_format("trade_date", "yyyy-MM-dd"))
    loose.write.parquet(f"{root}/data/panel.parquet")
    return keyed(P.read_panel(spark, root), "close", "market_cap", "is_st", "volume", r6("volatility_5d").alias("volatility_5d"))


signal("s06_return_1d", lambda: S.Signal(F.col("return_1d")), "return_1d", exact=True)
signal("s07_return_5d", lambda: S.Signal(F.col("return_5d")), "return_5d", exact=True)
signal("s08_volatility_5d", lambda: S.Signal(F.col("volatility_5d")), "volatility_5d")

# A snapshot: prices and fundamentals cut from the order lines of each day, with the gaps
# (a fundamental row is missing, or its cap is missing) that the join has to handle.
SNAPSHOT_SQL = """
sday AS (
  SELECT strftime(l_shipdate, '%Y%m%d') AS trade_date, CAST(l_suppkey AS VARCHAR) AS ts_code,
         SUM(CAST(l_quantity AS DECIMAL(18,2))) AS q, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS a,
         CAST(SUM(l_linenumber) AS BIGINT) AS h
  FROM lineitem GROUP BY 1, 2),
price AS (
  SELECT trade_date, ts_code, CAST(a AS DOUBLE) / CAST(q AS DOUBLE) AS close,
         CASE WHEN h % 11 <> 0 THEN CAST(q AS DOUBLE) END AS vol FROM sday),
basic AS (
  SELECT trade_date, ts_code, CASE WHEN h % 5 <> 0 THEN CAST(a AS DOUBLE) END AS total_mv,
         CASE WHEN h % 3 <> 0 THEN CAST(a AS DOUBLE) / 2 END AS circ_mv
  FROM sday WHERE h % 7 <> 0)
"""
SNAP_PANEL_SQL = """
sp0 AS (
  SELECT CAST(strptime(p.trade_date, '%Y%m%d') AS DATE) AS trade_date, p.ts_code AS instrument, close,
         COALESCE(vol, 0.0) AS volume, COALESCE(total_mv, circ_mv) AS market_cap, FALSE AS is_st
  FROM price p LEFT JOIN basic b ON p.trade_date = b.trade_date AND p.ts_code = b.ts_code),
sp1 AS (
  SELECT *, close / LAG(close, 1) OVER w - 1 AS return_1d, close / LAG(close, 5) OVER w - 1 AS return_5d
  FROM sp0 WINDOW w AS (PARTITION BY instrument ORDER BY trade_date)),
sp AS (
  SELECT *, CASE WHEN COUNT(return_1d) OVER w >= 2 THEN STDDEV_SAMP(return_1d) OVER w END AS volatility_5d
  FROM sp1 WINDOW w AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
"""


def with_sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + select


def snapshot(spark, sf_dir):
    lines = P.table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date"), F.col("l_suppkey").cast("string").alias("ts_code"),
        "l_quantity", "l_extendedprice", "l_linenumber",
    )
    day = (
        dealt(lines, table_rows(spark, f"{sf_dir}/lineitem.parquet"), "trade_date", "ts_code")
        .groupBy("trade_date", "ts_code")
        .agg(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("a"),
            F.sum("l_linenumber").alias("h"),
        )
    )
    price = day.select(
        "trade_date", "ts_code", (F.col("a") / F.col("q")).alias("close"), F.when(F.col("h") % 11 != 0, F.col("q")).alias("vol")
    )
    basic = day.where("h % 7 <> 0").select(
        "trade_date",
        "ts_code",
        F.when(F.col("h") % 5 != 0, F.col("a")).alias("total_mv"),
        F.when(F.col("h") % 3 != 0, F.col("a") / 2).alias("circ_mv"),
    )
    return price, basic


@query("s03_snapshot_scan", with_sql("SELECT trade_date, ts_code, close, vol FROM price", SNAPSHOT_SQL))
def snapshot_scan(spark, sf_dir):
    from crosswind.session import scratch_path

    root = scratch_path(spark, "snapshot")
    snapshot(spark, sf_dir)[0].withColumn("extra", F.lit("x")).write.parquet(f"{root}/price")
    return P.read_snapshot(spark, f"{root}/price", P.PRICE_COLUMNS)


@query("s04_partitioned_layout", with_sql("SELECT trade_date, ts_code, close, vol FROM price", SNAPSHOT_SQL))
def partitioned_layout(spark, sf_dir):
    from crosswind.session import scratch_path

    root = scratch_path(spark, "layout")
    price, basic = snapshot(spark, sf_dir)
    for market, frame in (("north", price), ("south", price.where("close is null"))):
        frame.write.parquet(f"{root}/provider=desk/market={market}/price")
    basic.write.parquet(f"{root}/provider=desk/market=north/daily_basic")
    return P.read_partitioned_snapshot(spark, root, "price", "desk", "north", P.PRICE_COLUMNS)


@query(
    "s05_snapshot_to_panel",
    with_sql(
        f"SELECT {KEY}, close, volume, market_cap, is_st, return_1d, return_5d, ROUND(volatility_5d, 6) AS volatility_5d FROM sp",
        SNAPSHOT_SQL,
        SNAP_PANEL_SQL,
    ),
)
def snapshot_panel(spark, sf_dir):
    return P.load_snapshot(*snapshot(spark, sf_dir)).withColumn("volatility_5d", r6("volatility_5d"))


# Order lines repeat a (day, supplier) key with different prices: a real conflict table.
@query(
    "s09_reject_conflicting_keys",
    "SELECT trade_date, ts_code, COUNT(*) AS copies, 'price' AS source FROM (SELECT DISTINCT strftime(l_shipdate, '%Y%m%d') "
    "AS trade_date, CAST(l_suppkey AS VARCHAR) AS ts_code, l_extendedprice, l_quantity FROM lineitem) "
    "GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
def conflicting_keys(spark, sf_dir):
    raw = P.table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date"),
        F.col("l_suppkey").cast("string").alias("ts_code"),
        F.col("l_extendedprice").alias("close"),
        F.col("l_quantity").alias("vol"),
    )
    return P.snapshot_conflicts(raw, durable(snapshot(spark, sf_dir)[1]))


@query(
    "s10_validate_panel",
    panel_sql(
        "SELECT COUNT(*) AS row_count, COUNT(DISTINCT instrument) AS instruments, COUNT(DISTINCT trade_date) AS dates, "
        "MIN(trade_date) AS min_date, MAX(trade_date) AS max_date, '' AS missing_columns, "
        "'amount,industry,return_1d,return_5d,volatility_5d,volume' AS optional_columns, COUNT(*) > 0 AS ok FROM panel"
    ),
)
def validate(spark, sf_dir):
    return P.validate_panel(panel(spark, sf_dir))


# A panel with faults: the cap is removed, made text or repeated by simple rules.
FAULTY_SQL = """
faulty AS (
  SELECT trade_date, instrument, CASE WHEN is_st THEN NULL ELSE close END AS close,
         CASE WHEN volume > 30 THEN 'n/a' ELSE CAST(amount AS VARCHAR) END AS market_cap, is_st FROM panel
  UNION ALL
  SELECT trade_date, instrument, close, '1' AS market_cap, is_st FROM panel WHERE is_st)
"""


def faulty_panel(spark, sf_dir):
    base = panel(spark, sf_dir)
    first = keyed(
        base,
        F.when(~F.col("is_st"), F.col("close")).alias("close"),
        F.when(F.col("volume") > 30, "n/a").otherwise(F.col("amount").cast("string")).alias("market_cap"),
        "is_st",
    )
    return first.unionByName(keyed(base.where("is_st"), "close", F.lit("1").alias("market_cap"), "is_st"))


@query(
    "s10_validate_faulty_panel",
    panel_sql(
        "SELECT COUNT(*) AS row_count, COUNT(DISTINCT instrument) AS instruments, COUNT(DISTINCT trade_date) AS dates, "
        "MIN(trade_date) AS min_date, MAX(trade_date) AS max_date, '' AS missing_columns, '' AS optional_columns, "
        "COUNT(*) > 0 AND COUNT(*) FILTER (WHERE close IS NULL OR TRY_CAST(market_cap AS DOUBLE) IS NULL) = 0 "
        "AND COUNT(*) = COUNT(DISTINCT (trade_date, instrument)) AS ok FROM faulty",
        FAULTY_SQL,
    ),
)
def validate_faulty(spark, sf_dir):
    return P.validate_panel(faulty_panel(spark, sf_dir))


@query(
    "s11_panel_quality",
    panel_sql(
        "SELECT problem, CAST(bad_rows AS BIGINT) AS bad_rows FROM ("
        "SELECT 'null:close' AS problem, COUNT(*) FILTER (WHERE close IS NULL) AS bad_rows FROM faulty UNION ALL "
        "SELECT 'dtype:market_cap', COUNT(*) FILTER (WHERE TRY_CAST(market_cap AS DOUBLE) IS NULL) FROM faulty UNION ALL "
        "SELECT 'duplicate_keys', COALESCE(SUM(n), 0) FROM (SELECT COUNT(*) AS n FROM faulty GROUP BY trade_date, instrument HAVING COUNT(*) > 1)"
        ") WHERE bad_rows > 0",
        FAULTY_SQL,
    ),
)
def quality(spark, sf_dir):
    return P.panel_quality(faulty_panel(spark, sf_dir))


@query(
    "s12_snapshot_synthesized",
    with_sql(
        "SELECT 'is_st' AS field UNION ALL SELECT 'market_cap' FROM (SELECT COUNT(*) AS n FROM price p LEFT JOIN basic b ON "
        "p.trade_date = b.trade_date AND p.ts_code = b.ts_code WHERE COALESCE(total_mv, circ_mv) IS NULL) WHERE n > 0",
        SNAPSHOT_SQL,
    ),
)
def synthesized(spark, sf_dir):
    return P.snapshot_synthesized(*snapshot(spark, sf_dir))


@query(
    "s13_validate_snapshot",
    with_sql(
        "SELECT 'coverage' AS section, item, status FROM (SELECT CAST(COUNT(*) AS VARCHAR) AS row_count, "
        "CAST(COUNT(DISTINCT instrument) AS VARCHAR) AS instruments, CAST(COUNT(DISTINCT trade_date) AS VARCHAR) AS dates, "
        "CAST(MIN(trade_date) AS VARCHAR) AS min_date, CAST(MAX(trade_date) AS VARCHAR) AS max_date, 'true' AS ok FROM sp) "
        "UNPIVOT (status FOR item IN (row_count, instruments, dates, min_date, max_date, ok)) "
        "UNION ALL SELECT 'field', 'is_st', 'synthesized' UNION ALL SELECT 'field', 'market_cap', 'synthesized' WHERE "
        "EXISTS (SELECT 1 FROM sp WHERE market_cap IS NULL)",
        SNAPSHOT_SQL,
        SNAP_PANEL_SQL,
    ),
)
def validate_snapshot(spark, sf_dir):
    return P.validate_snapshot(*snapshot(spark, sf_dir))


# The same report over a snapshot whose prices repeat a key with other values.
@query(
    "s13_validate_conflicting_snapshot",
    with_sql(
        "SELECT 'conflict' AS section, 'price' AS item, CAST(COUNT(*) AS VARCHAR) AS status FROM price WHERE vol IS NOT NULL HAVING COUNT(*) > 0 "
        "UNION ALL SELECT 'coverage', 'ok', CASE WHEN EXISTS (SELECT 1 FROM price WHERE vol IS NOT NULL) THEN 'false' ELSE 'true' END",
        SNAPSHOT_SQL,
    ),
)
def validate_conflicting_snapshot(spark, sf_dir):
    price, basic = snapshot(spark, sf_dir)
    twice = price.unionByName(price.where("vol is not null").withColumn("close", F.col("close") + 1))
    return P.validate_snapshot(twice, basic).where("section = 'conflict' or item = 'ok'")


ROLE_ROWS = ", ".join(f"('{f}', '{r}')" for f, r in P.FIELD_ROLES.items())
HELD_ROWS = "(SELECT UNNEST(['trade_date','instrument','volume','amount','close','industry','is_st','market_cap','return_1d','return_5d','volatility_5d']) AS held)"


@query(
    "s14_field_availability",
    panel_sql(
        "SELECT field, role, CASE WHEN held IS NULL THEN 'missing' WHEN field = 'is_st' AND (SELECT COUNT(*) FROM panel) > 0 "
        f"THEN 'synthesized' ELSE 'available' END AS availability FROM (VALUES {ROLE_ROWS}) AS t(field, role) LEFT JOIN {HELD_ROWS} ON held = field"
    ),
)
def availability(spark, sf_dir):
    df = panel(spark, sf_dir)
    made = df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("is_st").alias("field"))
    return P.field_availability(df, made)


@query(
    "s15_undeclared_columns",
    "SELECT column_name FROM (DESCRIBE lineitem) WHERE column_name NOT IN "
    f"({', '.join(repr(f) for f in P.FIELD_ROLES)})",
)
def undeclared(spark, sf_dir):
    return P.undeclared_columns(P.table(spark, sf_dir, "lineitem"))


@query(
    "l25_data_status",
    panel_sql(
        "SELECT 'coverage' AS section, item, status FROM (SELECT CAST(COUNT(*) AS VARCHAR) AS row_count, "
        "CAST(COUNT(DISTINCT instrument) AS VARCHAR) AS instruments, CAST(COUNT(DISTINCT trade_date) AS VARCHAR) AS dates, "
        "CAST(MIN(trade_date) AS VARCHAR) AS min_date, CAST(MAX(trade_date) AS VARCHAR) AS max_date, 'true' AS ok FROM panel) "
        "UNPIVOT (status FOR item IN (row_count, instruments, dates, min_date, max_date, ok)) UNION ALL "
        "SELECT 'field', field, CASE WHEN held IS NULL THEN 'missing' ELSE 'available' END "
        f"FROM (VALUES {ROLE_ROWS}) AS t(field, role) LEFT JOIN {HELD_ROWS} ON held = field"
    ),
)
def data_status(spark, sf_dir):
    return P.data_status(panel(spark, sf_dir))


# --- scalar operators ---------------------------------------------------------------

signal("e01_field", lambda: S.field("panel.close"), "close", exact=True)
signal("e02_constant", lambda: S.const(2.5), "CAST(2.5 AS DOUBLE)", exact=True)
signal("e03_neg", lambda: -S.field("close"), "-close", exact=True)
signal("e03_pos", lambda: +S.field("close"), "close", exact=True)
signal("e04_add", lambda: S.field("close") + S.field("return_5d"), "close + return_5d", exact=True)
signal("e04_sub", lambda: S.field("close") - S.field("return_5d"), "close - return_5d", exact=True)
signal("e04_mul", lambda: S.field("close") * S.field("volume"), "close * volume", exact=True)
signal(
    "e05_div",
    lambda: S.field("close") / (S.field("volume") - 25),
    "close / NULLIF(volume - 25, 0)",
    exact=True,
)
signal("e06_abs", lambda: S.absolute("return_5d"), "ABS(return_5d)", exact=True)
signal("e07_log", lambda: S.log("return_5d"), "CASE WHEN return_5d > 0 THEN LN(return_5d) END")
signal("e08_sign", lambda: S.sign("return_5d"), "CAST(SIGN(return_5d) AS DOUBLE)", exact=True)
signal("e09_signedpower", lambda: S.signedpower("return_5d", 0.5), "SIGN(return_5d) * POW(ABS(return_5d), 0.5)")
signal(
    "e10_pairwise_min",
    lambda: S.pairwise_min("return_1d", "return_5d"),
    "CASE WHEN return_1d IS NOT NULL AND return_5d IS NOT NULL THEN LEAST(return_1d, return_5d) END",
    exact=True,
)
signal(
    "e11_pairwise_max",
    lambda: S.pairwise_max("return_1d", "return_5d"),
    "CASE WHEN return_1d IS NOT NULL AND return_5d IS NOT NULL THEN GREATEST(return_1d, return_5d) END",
    exact=True,
)

# --- cross-sectional operators ------------------------------------------------------


def cross_query(name: str, apply, sql: str, exact: bool = False) -> None:
    """Register a cross-sectional operator on the path that the table's size chooses, and on the one for large dates."""

    def on(section):
        def run(spark, sf_dir):
            df = apply(section(spark, sf_dir), panel(spark, sf_dir))
            return keyed(df, F.col("value") if exact else r6("value").alias("value"))

        return run

    register(name, on(cross), sql)
    register(f"{name}_wide", on(lambda *_: CrossSection(wide=True)), sql)


RANK = (
    "CASE WHEN {x} IS NOT NULL THEN (RANK() OVER (PARTITION BY trade_date ORDER BY {x} ASC NULLS LAST) + "
    "(COUNT({x}) OVER (PARTITION BY trade_date, {x}) - 1) / 2.0) / COUNT({x}) OVER (PARTITION BY trade_date) END"
)
D = "OVER (PARTITION BY trade_date)"

cross_query(
    "x01_rank",
    lambda xs, df: xs.rank(df, "volume", "value"),
    panel_sql(f"SELECT {KEY}, ROUND({RANK.format(x='volume')}, 6) AS value FROM panel"),
)
cross_query(
    "x02_zscore",
    lambda xs, df: xs.zscore(df, "return_5d", "value"),
    panel_sql(
        f"SELECT {KEY}, ROUND((return_5d - AVG(return_5d) {D}) / CASE WHEN MIN(return_5d) {D} < MAX(return_5d) {D} "
        f"THEN STDDEV_SAMP(return_5d) {D} END, 6) AS value FROM panel"
    ),
)
cross_query(
    "x03_winsorize",
    lambda xs, df: xs.winsorize(df, "return_5d", 0.1, "value"),
    panel_sql(
        f"SELECT {KEY}, ROUND(CASE WHEN return_5d IS NOT NULL THEN LEAST(GREATEST(return_5d, lo), hi) END, 6) AS value "
        f"FROM (SELECT *, QUANTILE_CONT(return_5d, 0.1) {D} AS lo, QUANTILE_CONT(return_5d, 0.9) {D} AS hi FROM panel)"
    ),
)
cross_query(
    "x04_ntile",
    lambda xs, df: xs.ntile(df, "volume", 5, "value"),
    panel_sql(f"SELECT {KEY}, CAST(LEAST(GREATEST(CEIL(({RANK.format(x='volume')}) * 5), 1), 5) AS DOUBLE) AS value FROM panel"),
    exact=True,
)
cross_query(
    "x05_scale",
    lambda xs, df: xs.scale(df, "return_5d", "value"),
    panel_sql(f"SELECT {KEY}, ROUND(return_5d / NULLIF(SUM(ABS(return_5d)) {D}, 0), 6) AS value FROM panel"),
)
cross_query(
    "x06_group_neutralize",
    lambda xs, df: xs.group_neutralize(df, "return_5d", "industry", "value"),
    panel_sql(f"SELECT {KEY}, ROUND(return_5d - AVG(return_5d) OVER (PARTITION BY trade_date, industry), 6) AS value FROM panel"),
)
cross_query(
    "x07_residualize",
    lambda xs, df: xs.residualize(df.withColumn("size", F.ln("market_cap")), "return_5d", "size", "value"),
    panel_sql(
        f"SELECT {KEY}, ROUND(CASE WHEN MIN(b) {D} < MAX(b) {D} THEN a - (AVG(a) {D} + COVAR_POP(a, b) {D} / VAR_POP(b) {D} * "
        f"(b - AVG(b) {D})) END, 6) AS value FROM (SELECT trade_date, instrument, return_5d AS a, "
        "CASE WHEN return_5d IS NOT NULL THEN LN(market_cap) END AS b FROM panel)"
    ),
)

# --- time-series operators ----------------------------------------------------------


def full(n: int, agg: str, x: str) -> str:
    return f"CASE WHEN COUNT({x}) {trail(n)} = {n} THEN {agg}({x}) {trail(n)} END"


signal("t01_delay", lambda: S.delay("close", 3), f"LAG(close, 3) {W}", exact=True)
signal("t02_delta", lambda: S.delta("close", 3), f"close - LAG(close, 3) {W}", exact=True)
signal("t03_ts_sum", lambda: S.ts_sum("return_1d", 10), full(10, "SUM", "return_1d"))
signal("t04_ts_mean", lambda: S.ts_mean("return_1d", 10), full(10, "AVG", "return_1d"))
signal("t05_ts_min", lambda: S.ts_min("return_1d", 10), full(10, "MIN", "return_1d"), exact=True)
signal("t06_ts_max", lambda: S.larger("return_1d", 10), full(10, "MAX", "return_1d"), exact=True)
signal("t07_stddev", lambda: S.stddev("return_1d", 10), full(10, "STDDEV_SAMP", "return_1d"))
signal(
    "t08_ts_rank",
    lambda: S.ts_rank(F.when(F.col("return_5d") < 0.4, F.col("return_5d")), 10),
    "CASE WHEN x IS NOT NULL AND len(a) = 10 THEN (len(list_filter(a, lambda e: e < x)) + "
    "(len(list_filter(a, lambda e: e = x)) + 1) / 2.0) / len(list_filter(a, lambda e: e IS NOT NULL)) END",
    frm="t8",
    ctes=(
        f"t8 AS (SELECT trade_date, instrument, x, LIST(x) {trail(10)} AS a FROM (SELECT trade_date, instrument, "
        "CASE WHEN return_5d < 0.4 THEN return_5d END AS x FROM panel))",
    ),
)
signal(
    "t09_decay_linear",
    lambda: S.decay_linear("return_1d", 10),
    f"CASE WHEN COUNT(return_1d) {trail(10)} = 10 THEN ("
    + " + ".join(f"LAG(return_1d, {k}) {W} * {10 - k}" for k in range(10))
    + ") / 55.0 END",
)
for op_id, fn, pick in (("t10_ts_argmax", S.ts_argmax, "arg_max(p, {'x': x, 'p': p})"), ("t11_ts_argmin", S.ts_argmin, "arg_max(p, {'x': -x, 'p': p})")):
    signal(
        op_id,
        (lambda fn: lambda: fn("return_1d", 10))(fn),
        f"CASE WHEN COUNT(x) {trail(10)} = 10 THEN CAST(p - {pick} {trail(10)} AS DOUBLE) END",
        exact=True,
        frm="t10",
        ctes=(f"t10 AS (SELECT trade_date, instrument, return_1d AS x, ROW_NUMBER() {W} AS p FROM panel)",),
    )
PAIRED = (
    "tp AS (SELECT trade_date, instrument, CASE WHEN return_1d IS NOT NULL AND volume IS NOT NULL THEN return_1d END AS a, "
    "CASE WHEN return_1d IS NOT NULL AND volume IS NOT NULL THEN volume END AS b FROM panel)"
)
signal(
    "t12_correlation",
    lambda: S.correlation("return_1d", "volume", 10),
    f"CASE WHEN COUNT(a) {trail(10)} = 10 AND MIN(a) {trail(10)} < MAX(a) {trail(10)} AND MIN(b) {trail(10)} < MAX(b) {trail(10)} "
    f"THEN COVAR_POP(a, b) {trail(10)} / (STDDEV_POP(a) {trail(10)} * STDDEV_POP(b) {trail(10)}) END",
    frm="tp",
    ctes=(PAIRED,),
)
signal(
    "t13_covariance",
    lambda: S.covariance("return_1d", "volume", 10),
    f"CASE WHEN COUNT(a) {trail(10)} = 10 THEN COVAR_SAMP(a, b) {trail(10)} END",
    frm="tp",
    ctes=(PAIRED,),
)
