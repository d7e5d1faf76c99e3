"""Append-only JSON-lines ledgers: tolerant reading, appending, result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a ledger; torn, malformed and non-object lines are skipped."""
    raw = (
        spark.read.schema(schema + ", _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    return raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every floating-point column."""
    inf = float("inf")
    return df.withColumns(
        {c: F.when(~F.isnan(c) & (F.abs(c) < inf), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    )


def write_results(df: DataFrame, path: str) -> None:
    finite(df).write.mode("overwrite").json(path)
