"""Named queries and their SQL oracles.

Each entry is a callable (spark, sf_dir) -> DataFrame over the whole tables. The oracle is
the same result as one SQL statement over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        register(name, run, sql)
        return run

    return add


def r6(x):
    """Round computed floats, whose last bits depend on summation order."""
    return F.round(x, 6)


# The weekly supplier panel as SQL; `panel` adds the derived return fields.
PANEL_SQL = """
cells AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date, l_suppkey,
         SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS amt,
         2 * COUNT(*) FILTER (WHERE l_returnflag = 'R') > COUNT(*) AS is_st
  FROM lineitem GROUP BY 1, 2),
base AS (
  SELECT trade_date, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS instrument,
         CAST(qty AS DOUBLE) AS volume, CAST(amt AS DOUBLE) AS amount,
         CAST(amt AS DOUBLE) / CAST(qty AS DOUBLE) AS close, n_name AS industry, is_st,
         CAST(SUM(amt) OVER (PARTITION BY l_suppkey ORDER BY trade_date
              ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS DOUBLE) AS market_cap
  FROM cells JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
ret AS (
  SELECT *, close / LAG(close, 1) OVER (PARTITION BY instrument ORDER BY trade_date) - 1 AS return_1d,
         close / LAG(close, 5) OVER (PARTITION BY instrument ORDER BY trade_date) - 1 AS return_5d
  FROM base),
panel AS (
  SELECT *, CASE WHEN COUNT(return_1d) OVER w >= 2 THEN STDDEV_SAMP(return_1d) OVER w END AS volatility_5d
  FROM ret WINDOW w AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
"""


def panel_sql(select: str, *ctes: str) -> str:
    """A statement over the panel, with further named steps before the final select."""
    return "WITH RECURSIVE " + ",\n".join([PANEL_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + select.strip()
