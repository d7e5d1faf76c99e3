"""Panels: load, build from order lines, validate, derive the return fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswind.functions.signals import KEYS
from crosswind.session import dealt, durable

# The declared panel fields and their roles.
FIELD_ROLES = {
    "trade_date": "key",
    "instrument": "key",
    "close": "required",
    "market_cap": "required",
    "is_st": "required",
    "open": "optional",
    "high": "optional",
    "low": "optional",
    "industry": "optional",
    "volume": "optional",
    "amount": "optional",
    "return_1d": "optional",
    "return_5d": "optional",
    "volatility_5d": "optional",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse_date(name: str):
    """Dates stored as date, ISO text, or yyyymmdd text or number."""
    text = F.col(name).cast("string")
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def with_returns(df: DataFrame, keys=KEYS) -> DataFrame:
    """return_1d, return_5d (row lags) and the 5-row volatility with at least 2 returns."""
    w = keys.over_series()
    df = df.withColumns(
        {
            "return_1d": F.try_divide("close", F.lag("close", 1).over(w)) - 1,
            "return_5d": F.try_divide("close", F.lag("close", 5).over(w)) - 1,
        }
    )
    t = keys.trailing(5)
    vol = F.when(F.count("return_1d").over(t) >= 2, F.stddev_samp("return_1d").over(t))
    return df.withColumn("volatility_5d", vol)


def cents(name: str):
    """A non-negative two-decimal amount as a whole number."""
    return F.floor(F.col(name) * 100 + 0.5)


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly supplier panel from order lines.

    Quantities and prices hold two decimals, so they are summed as whole cents: exact in any
    order, and faster than wide decimals.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy(
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date"), "l_suppkey"
    )
    cells = lines.agg(
        F.sum(cents("l_quantity")).alias("qty"),
        F.sum(cents("l_extendedprice")).alias("amt"),
        (2 * F.count_if(F.col("l_returnflag") == "R") > F.count(F.lit(1))).alias("is_st"),
    )
    names = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("industry"))
    )
    panel = cells.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "trade_date",
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0")).alias("instrument"),
        (F.col("qty") / 100.0).alias("volume"),
        (F.col("amt") / 100.0).alias("amount"),
        ((F.col("amt") / 100.0) / (F.col("qty") / 100.0)).alias("close"),
        "industry",
        "is_st",
        "amt",
    )
    cap = F.sum("amt").over(KEYS.trailing(13)) / 100.0
    return with_returns(panel.withColumn("market_cap", cap).drop("amt"))


def resolve_panel_path(spark: SparkSession, root: str) -> str:
    """A file itself, or the panel below a root folder."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for candidate in (root, f"{root}/panel.parquet", f"{root}/data/panel.parquet"):
        path = jvm.org.apache.hadoop.fs.Path(candidate)
        fs = path.getFileSystem(conf)
        if candidate.endswith(".parquet") and fs.exists(path):
            return candidate
    raise FileNotFoundError(f"no panel under {root}")


def read_panel(spark: SparkSession, root: str) -> DataFrame:
    """Read a stored panel, cast its keys and flags, turn NaN into NULL; a panel that does not validate is refused."""
    df = spark.read.parquet(resolve_panel_path(spark, root))
    missing = [c for c, role in FIELD_ROLES.items() if role != "optional" and c not in df.columns]
    if missing:
        raise ValueError(f"panel is missing columns: {missing}")
    if not validate_panel(df).first()["ok"]:
        raise ValueError("panel refused: " + (", ".join(r["problem"] for r in panel_quality(df).collect()) or "no rows"))
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns(
        {
            "trade_date": parse_date("trade_date"),
            "instrument": F.col("instrument").cast("string"),
            "is_st": F.col("is_st").cast("boolean"),
            **{c: F.when(~F.isnan(c), F.col(c).cast("double")) for c in doubles},
        }
    )


def validate_panel(df: DataFrame, quality: bool = True) -> DataFrame:
    """One row: counts, date range, missing and optional columns, ok.

    `ok` needs rows, all required columns and, with `quality`, no problem that `panel_quality` finds.
    """
    missing = [c for c, r in FIELD_ROLES.items() if r != "optional" and c not in df.columns]
    optional = [c for c, r in FIELD_ROLES.items() if r == "optional" and c in df.columns]
    clean = panel_quality(df).agg(F.count("*")).scalar() == 0 if quality and not missing else F.lit(True)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("instrument").alias("instruments"),
        F.count_distinct("trade_date").alias("dates"),
        F.min("trade_date").alias("min_date"),
        F.max("trade_date").alias("max_date"),
    ).withColumns(
        {
            "missing_columns": F.lit(",".join(sorted(missing))),
            "optional_columns": F.lit(",".join(sorted(optional))),
            "ok": (F.col("row_count") > 0) & F.lit(not missing) & clean,
        }
    )


def duplicate_keys(df: DataFrame, keys: tuple[str, ...] = ("trade_date", "instrument")) -> DataFrame:
    """Keys held by more than one row, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def panel_quality(df: DataFrame) -> DataFrame:
    """Problem tokens with the number of offending rows, one row per problem found."""
    required = [c for c, r in FIELD_ROLES.items() if r != "optional" and c in df.columns]
    counts = {f"null:{c}": F.count_if(F.col(c).isNull()) for c in required}
    for c in ("close", "market_cap"):
        if c in df.columns and dict(df.dtypes)[c] == "string":
            counts[f"dtype:{c}"] = F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
    if dict(df.dtypes).get("trade_date") != "date":
        counts["dtype:trade_date"] = F.count_if(F.col("trade_date").isNotNull() & parse_date("trade_date").isNull())
    one = df.agg(*[v.alias(k) for k, v in counts.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("problem"), F.col(f"`{k}`").alias("bad_rows")) for k in counts])
    flags = one.select(F.inline(pairs))
    dup = duplicate_keys(df).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("bad_rows"))
    return flags.unionByName(dup.select(F.lit("duplicate_keys").alias("problem"), "bad_rows")).where("bad_rows > 0")


def names_table(spark: SparkSession, names: list[str], column: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def field_availability(df: DataFrame, synthesized: DataFrame | None = None) -> DataFrame:
    """Declared fields marked available, synthesized or missing."""
    spark = df.sparkSession
    declared = spark.createDataFrame(list(FIELD_ROLES.items()), "field string, role string")
    held = names_table(spark, df.columns, "held")
    out = declared.join(held, F.col("field") == F.col("held"), "left")
    if synthesized is not None:
        out = out.join(synthesized.withColumnRenamed("field", "made"), F.col("field") == F.col("made"), "left")
    else:
        out = out.withColumn("made", F.lit(None).cast("string"))
    state = F.when(F.col("made").isNotNull(), "synthesized").when(F.col("held").isNotNull(), "available")
    return out.select("field", "role", state.otherwise("missing").alias("availability"))


def undeclared_columns(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return names_table(spark, df.columns, "column_name").join(
        names_table(spark, list(FIELD_ROLES), "column_name"), "column_name", "left_anti"
    )


# --- snapshots: price and daily_basic files ------------------------------------------

PRICE_COLUMNS = ("ts_code", "trade_date", "close", "vol")
BASIC_COLUMNS = ("ts_code", "trade_date", "total_mv", "circ_mv")


def read_snapshot(spark: SparkSession, root: str, columns: tuple[str, ...]) -> DataFrame:
    """All parquet files of a folder, only the wanted columns (hidden files are skipped)."""
    return spark.read.parquet(root).select(*columns)


def read_partitioned_snapshot(spark: SparkSession, root: str, kind: str, provider: str, market: str, columns) -> DataFrame:
    """``root/provider=*/market=*/<kind>``: partition discovery prunes to one provider and market."""
    df = spark.read.option("basePath", root).parquet(f"{root}/provider={provider}/market={market}/{kind}")
    return df.select(*columns)


def snapshot_conflicts(price: DataFrame, basic: DataFrame) -> DataFrame:
    """Keys that still repeat after exact duplicates are dropped, labelled by table. The tables are counted first, so they should be stored."""
    keys = ("trade_date", "ts_code")
    found = [
        duplicate_keys(dealt(df, df.count(), *keys).dropDuplicates(), keys).withColumn("source", F.lit(label))
        for label, df in (("price", price), ("daily_basic", basic))
    ]
    return reduce(DataFrame.unionByName, found)


def snapshot_to_panel(price: DataFrame, basic: DataFrame) -> DataFrame:
    """Join a snapshot's two tables into the 9-column panel. They are counted first, so they should be stored."""
    rows, keys = max(price.count(), basic.count()), ["trade_date", "ts_code"]
    joined = dealt(price, rows, *keys).dropDuplicates().join(dealt(basic, rows, *keys).dropDuplicates(), keys, "left")

    def number(name):
        return F.when(~F.isnan(F.col(name).try_cast("double")), F.col(name).try_cast("double"))

    out = joined.select(
        parse_date("trade_date").alias("trade_date"),
        F.col("ts_code").cast("string").alias("instrument"),
        number("close").alias("close"),
        F.coalesce(number("vol"), F.lit(0.0)).alias("volume"),
        F.coalesce(number("total_mv"), number("circ_mv")).alias("market_cap"),
        F.lit(False).alias("is_st"),
    ).na.drop(subset=["trade_date", "instrument", "close"])
    return with_returns(out)


def load_snapshot(price: DataFrame, basic: DataFrame) -> DataFrame:
    """The panel of a snapshot whose keys do not contradict each other; any other snapshot is refused."""
    price, basic = durable(price), durable(basic)
    if not snapshot_conflicts(price, basic).isEmpty():
        raise ValueError("snapshot refused: rows that differ share a key")
    return snapshot_to_panel(price, basic)


def snapshot_synthesized(price: DataFrame, basic: DataFrame) -> DataFrame:
    """Fields the snapshot does not really hold: is_st always, market_cap when any is missing."""
    spark = price.sparkSession
    missing = price.join(basic, ["trade_date", "ts_code"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    empty = basic.where(F.coalesce("total_mv", "circ_mv").isNull()).agg(F.count(F.lit(1)).alias("n"))
    cap = (
        missing.unionByName(empty)
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
        .select(F.lit("market_cap").alias("field"))
    )
    return names_table(spark, ["is_st"], "field").unionByName(cap)


def validate_snapshot(price: DataFrame, basic: DataFrame) -> DataFrame:
    """Long report: the panel's validation row, key conflicts and synthesized fields; a conflict makes `ok` false."""
    price, basic = durable(price), durable(basic)
    conflicts = durable(snapshot_conflicts(price, basic).groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    coverage = coverage_rows(snapshot_to_panel(price, basic))
    if not conflicts.isEmpty():
        coverage = coverage.withColumn("status", F.when(F.col("item") == "ok", "false").otherwise(F.col("status")))
    return (
        coverage
        .unionByName(conflicts.select(F.lit("conflict").alias("section"), F.col("source").alias("item"), F.col("n").cast("string").alias("status")))
        .unionByName(
            snapshot_synthesized(price, basic).select(
                F.lit("field").alias("section"), F.col("field").alias("item"), F.lit("synthesized").alias("status")
            )
        )
    )


def coverage_rows(df: DataFrame) -> DataFrame:
    """The validation row as (section, item, status) rows."""
    items = ("row_count", "instruments", "dates", "min_date", "max_date", "ok")
    pairs = [
        F.struct(F.lit("coverage").alias("section"), F.lit(c).alias("item"), F.col(c).cast("string").alias("status"))
        for c in items
    ]
    return validate_panel(df, quality=False).select(F.inline(F.array(*pairs)))


def data_status(df: DataFrame) -> DataFrame:
    """Validation, quality and field status as one long report."""
    rows = coverage_rows(df)
    missing = [c for c, r in FIELD_ROLES.items() if r != "optional" and c not in df.columns]
    schema = names_table(df.sparkSession, missing, "item").select(
        F.lit("schema").alias("section"), "item", F.lit("missing").alias("status")
    )
    quality = panel_quality(df).select(
        F.lit("quality").alias("section"), F.col("problem").alias("item"), F.col("bad_rows").cast("string").alias("status")
    )
    fields = field_availability(df).select(
        F.lit("field").alias("section"), F.col("field").alias("item"), F.col("availability").alias("status")
    )
    return rows.unionByName(schema).unionByName(quality).unionByName(fields)
