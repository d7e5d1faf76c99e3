"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.functions.signals import KEYS, Keys
from crosswind.operators.cross_section import CrossSection
from crosswind.session import table_rows
from crosswind.sources.panel import weekly_panel


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_panel(spark, sf_dir)


def cross(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> CrossSection:
    """Cross-section operators sized by the supplier count, which bounds a date's rows."""
    keys = Keys(extra=extra) if extra else KEYS
    return CrossSection.sized(table_rows(spark, f"{sf_dir}/supplier.parquet"), keys)


def keyed(df: DataFrame, *cols) -> DataFrame:
    return df.select("trade_date", "instrument", *cols)


def momentum_scores(panel_df: DataFrame) -> DataFrame:
    """The plain 5-row momentum factor (exact in both engines, so ranks are stable)."""
    return keyed(panel_df, F.col("return_5d").alias("score"))
