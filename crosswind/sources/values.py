"""Stored factor values: one table of snapshots, partitioned by factor_id and year.

Columns: trade_date, instrument, factor_value, formula_signature, layer (root or
incremental), seq (write order), factor_id, year.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswind.operators.scores import dedupe_last
from crosswind.session import durable
from crosswind.sources.panel import parse_date
from crosswind.sources.snapshots import SnapshotTable

KEY = ["trade_date", "instrument"]
SCHEMA = (
    "trade_date date, instrument string, factor_value double, formula_signature string, layer string, "
    "seq bigint, factor_id string, year int"
)
COLUMNS = [*KEY, "factor_value", "formula_signature", "layer", "seq", "factor_id", "year"]

# Accepted column names, first match wins.
DATE_NAMES = ("trade_date", "date")
INSTRUMENT_NAMES = ("instrument", "instrument_id", "provider_symbol", "ts_code")
SCORE_NAMES = ("score", "factor_value")


def formula_signature(factor_id: str, formula: str, filters: tuple[str, ...] = ()) -> str:
    payload = {"factor_id": factor_id, "formula": formula, "universe_filters": list(filters)}
    raw = json.dumps(payload, ensure_ascii=True, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(raw.encode("utf-8")).hexdigest()


def canonical_id(name):
    """Ids compare without case, and with - and _ alike."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.lower(F.trim(c.cast("string"))), "-", "_")


def spelling(name: str) -> str:
    """`canonical_id` of a name at hand."""
    return name.strip(" ").lower().replace("-", "_")


def to_rows(scores: DataFrame, factor_id: str, signature: str | None, layer: str, seq: int) -> DataFrame:
    return scores.select(
        *KEY,
        F.col("score").cast("double").alias("factor_value"),
        F.lit(signature).cast("string").alias("formula_signature"),
        F.lit(layer).alias("layer"),
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit(factor_id).alias("factor_id"),
        F.year("trade_date").alias("year"),
    )


def store(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, ("factor_id", "year"), SCHEMA)


def write_values(rows: DataFrame, path: str) -> None:
    """Add rows by factor and year; rebalancing splits a partition that holds most rows."""
    store(rows.sparkSession, path).append(rows)


def read_values(spark: SparkSession, path: str, aliases: list[str] | None = None) -> DataFrame:
    """All stored rows, or only the partitions of the factors that go by one of the aliases."""
    wanted = None if aliases is None else {spelling(a) for a in aliases}
    return store(spark, path).read(None if wanted is None else lambda k: k[0] is not None and spelling(k[0]) in wanted)


def normalise_columns(df: DataFrame) -> DataFrame:
    """[trade_date, instrument, score, rest...] from any accepted column names."""

    def first(names):
        found = [n for n in names if n in df.columns]
        if not found:
            raise ValueError(f"none of {names} present")
        return found[0]

    date, inst, score = first(DATE_NAMES), first(INSTRUMENT_NAMES), first(SCORE_NAMES)
    rest = [c for c in df.columns if c not in (date, inst, score)]
    number = F.col(score).try_cast("double")
    return df.select(
        parse_date(date).alias("trade_date"),
        F.col(inst).cast("string").alias("instrument"),
        F.when(~F.isnan(number), number).alias("score"),
        *rest,
    ).na.drop(subset=KEY)


def factor_values(values: DataFrame, aliases: list[str], signature: str, allow_unsigned: bool = False) -> DataFrame:
    """[trade_date, instrument, score] of one factor: alias filter, signature filter, last wins.

    Unsigned rows count only in the root layer and only when the caller allows them.
    """
    wanted = [spelling(a) for a in aliases]
    signed = F.col("formula_signature") == signature
    unsigned = F.lit(allow_unsigned) & F.col("formula_signature").isNull() & (F.col("layer") == "root")
    rows = values.where(canonical_id("factor_id").isin(wanted)).where(signed | unsigned)
    rows = normalise_columns(rows.drop("year")).select(*KEY, "score", "seq")
    return dedupe_last(rows, KEY).select(*KEY, "score")


def merge_updates(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Union of old and new rows; the later write wins per factor, signature, date and instrument."""
    return dedupe_last(existing.select(*COLUMNS).unionByName(updates.select(*COLUMNS)), ["factor_id", "formula_signature", *KEY])


def upsert(spark: SparkSession, path: str, updates: DataFrame) -> None:
    """Merge updates into the table, rewriting only the factor/year partitions they touch, in one switch."""
    table, updates = store(spark, path), durable(updates)
    old = table.snapshot()
    # As many as the folders that are written.
    touched = {(r["factor_id"], str(r["year"])) for r in updates.select("factor_id", "year").distinct().collect()}
    table.replace(merge_updates(table.read(lambda k: k in touched, old), updates), old=old)


def has_values(spark: SparkSession, path: str, factor_id: str) -> bool:
    return any(key[0] == factor_id for key in store(spark, path).keys())


def stored_factors(values: DataFrame) -> DataFrame:
    return values.groupBy("factor_id").agg(F.count(F.lit(1)).alias("stored_rows"))


def remove_factor(spark: SparkSession, path: str, factor_id: str, owners: DataFrame) -> int:
    """Remove the stored values of one factor, files included, under every spelling of its id; returns the partitions removed.

    ``owners`` lists (factor_id, owner_id): which registered ids rely on which stored factor. A spelling that another
    owner relies on, or that another registered id shares, stays.
    """
    own = spelling(factor_id)
    table = store(spark, path)
    names = {key[0] for key in table.keys() if key[0] is not None and spelling(key[0]) == own}
    if not own or not names:
        return 0
    other = owners.where(F.col("owner_id") != factor_id)
    if not other.where(canonical_id("owner_id") == own).isEmpty():
        return 0
    relied = {r["factor_id"] for r in other.where(F.col("factor_id").isin(*names)).select("factor_id").distinct().collect()}
    return table.drop([key for key in table.keys() if key[0] in names - relied])


def discover_precomputed(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Factors found in several stores: the best-priority one per canonical key, and conflicts.

    ``listing`` has factor_id, source, priority (higher wins). A key claimed by different
    factors at the same best priority is a conflict.
    """
    keyed = listing.withColumn("factor_key", canonical_id("factor_id"))
    best = keyed.groupBy("factor_key").agg(F.max("priority").alias("priority"))
    top = keyed.join(best, ["factor_key", "priority"])
    grouped = top.groupBy("factor_key", "priority").agg(
        F.min(F.struct("source", "factor_id")).alias("pick"), F.count_distinct("source", "factor_id").alias("claims")
    )
    chosen = grouped.where("claims = 1").select("factor_key", "priority", "pick.factor_id", "pick.source")
    return chosen, grouped.where("claims > 1").select("factor_key", "priority", "claims")


def import_precomputed(discovered: DataFrame, wanted: DataFrame | None, status: str = "draft") -> tuple[DataFrame, DataFrame]:
    """Registrations for the wanted ids or aliases (all when none given), and the ids not found."""
    if wanted is None:
        return discovered.withColumn("status", F.lit(status)), discovered.limit(0).select(F.col("factor_id").alias("wanted"))
    asked = wanted.select("wanted", canonical_id("wanted").alias("factor_key"))
    hits = discovered.join(asked, "factor_key", "left_semi").withColumn("status", F.lit(status))
    return hits, asked.join(discovered, "factor_key", "left_anti").select("wanted")


def compact_store(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Many legacy value sources into one table, with an action per source and factor.

    ``sources``: source, canonical (bool), factor_id, trade_date, instrument, factor_value.
    A key whose values differ between sources is a conflict; conflicting non-canonical
    sources are left out. The rows of one key meet in one exchange: as many as the sources that hold it. Rows without a whole key count nowhere.
    """
    rows = sources.withColumn("factor_key", canonical_id("factor_id"))
    key = ["factor_key", *KEY]
    cell = Window.partitionBy(*key)
    lo, hi, base = F.min("factor_value").over(cell), F.max("factor_value").over(cell), F.bool_or("canonical").over(cell)
    marked = rows.na.drop(subset=key).select("factor_key", "source", "canonical", (lo < hi).alias("_clash"), base.alias("_base"))
    per = marked.groupBy("factor_key", "source", "canonical").agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if("_clash").alias("conflict_rows"),
        F.count_if(~F.col("_base")).alias("new_rows"),
    )
    # One row for each source and factor, so this window is small.
    per = per.withColumn("_has", F.bool_or("canonical").over(Window.partitionBy("factor_key")))
    action = (
        F.when(F.col("canonical"), "canonical")
        .when(F.col("conflict_rows") > 0, "conflicted")
        .when(~F.col("_has"), "create")
        .when(F.col("new_rows") > 0, "merge")
        .otherwise("skipped")
    )
    report = per.select("factor_key", "source", "source_rows", "conflict_rows", "new_rows", action.alias("action"))
    taken = report.where(F.col("action").isin("canonical", "create", "merge")).select("factor_key", "source")
    table = rows.join(taken, ["factor_key", "source"], "left_semi").groupBy(*key).agg(F.max("factor_value").alias("factor_value"))
    return table, report


# --- definitions ---------------------------------------------------------------------


def current_definitions(history: DataFrame) -> DataFrame:
    """Latest row per factor from an append-only definition history; deleted ones drop out."""
    return dedupe_last(history, ["factor_id"]).where(~F.col("deleted")).drop("deleted")


def list_catalog(local: DataFrame, discovered: DataFrame) -> DataFrame:
    """Local definitions, then discovered ones whose key no local definition holds."""
    mine = local.select("factor_id", canonical_id("factor_id").alias("factor_key"), F.lit("local").alias("origin"))
    other = discovered.select("factor_id", canonical_id("factor_id").alias("factor_key"), F.lit("discovered").alias("origin"))
    return mine.unionByName(other.join(mine, "factor_key", "left_anti"))


def ambiguous_keys(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("factor_key").agg(F.count_distinct("factor_id").alias("ids")).where("ids > 1")


# What marks a factor as generated rather than original.
SYNTHETIC_SOURCES = ("synthetic", "composite", "rd")
SYNTHETIC_NAMES = (r"^GTJA_RD(_|$)", r"^RD_(SYN|TOP)(_|$)")


def factor_category(factor_id, name, source):
    """original or synthetic, from the source marker or a pattern in id or name."""
    test = F.coalesce(F.lower(F.trim(source)).isin(*SYNTHETIC_SOURCES), F.lit(False))
    for text in (factor_id, name):
        for pattern in SYNTHETIC_NAMES:
            test = test | F.coalesce(F.upper(F.trim(text)).rlike(pattern), F.lit(False))
    return F.when(test, "synthetic").otherwise("original")
