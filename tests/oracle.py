"""Run queries next to their SQL oracles and compare whole results."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if str(s.dtype).startswith("datetime"):
            s = s.dt.strftime("%Y-%m-%d %H:%M:%S")
        if s.dtype == object or str(s.dtype) in ("string", "str"):
            s = s.map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else str(v).removesuffix(" 00:00:00"))
        elif str(s.dtype) in ("bool", "boolean"):
            s = s.astype(str)
        else:
            s = s.astype("float64").map(lambda v: None if v != v else repr(v + 0.0))
        df[c] = s.astype(object).where(s.notna(), "NULL")
    return df.sort_values(list(df.columns), kind="mergesort").reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty when equal, else the first difference."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    bad = (a != b).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        return f"{int(bad.sum())} rows differ, first {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return ""


def check(spark, con, name, run, sql, sf_dir):
    t0 = time.time()
    got = run(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return ("rows" if len(got) else "EMPTY"), len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    want = cur.df()
    t2 = time.time()
    why = compare(got, want)
    if not why and not len(got):
        why = "EMPTY"
    return why or "ok", len(got), t1 - t0, t2 - t1


def main() -> int:
    """usage: python -m tests.oracle <sf_dir> [name prefix ...]"""
    from crosswind.plans import ORACLES, QUERIES
    from crosswind.session import local_session

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con, bad = local_session(), connect(sf_dir), 0
    for name, run in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            verdict, rows, s, d = check(spark, con, name, run, ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on
            verdict, rows, s, d = "ERROR " + str(e)[:600], -1, 0.0, 0.0
        bad += verdict not in ("ok", "rows")
        print(f"{name:34s} {rows:8d} {s:6.2f}s {d:6.2f}s {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
