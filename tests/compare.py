"""Compare every query with its oracle on one data set: ``python -m tests.compare [sf] [query ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    return con


def normalized(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(
            lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v)
            else (str(v)[:10] if hasattr(v, "year") else (float(v) + 0.0 if isinstance(v, float) else v))
        ).astype(object)
        df[c] = df[c].map(lambda v: None if v is None else repr(v) if not isinstance(v, str) else v)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(set(ours.columns) ^ set(theirs.columns))}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = normalized(ours), normalized(theirs)
    wrong = (a.fillna("<null>") != b.fillna("<null>")).any(axis=1)
    if not wrong.any():
        return None
    i = wrong.idxmax()
    cells = {c: (a[c][i], b[c][i]) for c in a.columns if a[c][i] != b[c][i]}
    return f"{int(wrong.sum())} of {len(a)} rows differ, e.g. {cells}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), entry.oracle_sql(), 0
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        start = time.time()
        ours = entry.queries()[name](spark, sf_dir)
        types = {f.name: f.dataType.simpleString() for f in ours.schema}
        ours = ours.toPandas()
        spent = time.time() - start
        if name not in sqls:
            print(f"{name}: {len(ours)} rows, no oracle, {spent:.1f}s", flush=True)
            continue
        relation = con.sql(sqls[name])
        wanted = dict(zip(relation.columns, map(str, relation.types)))
        problem = difference(ours, relation.df())
        bad += problem is not None
        alias = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}
        odd = {c: (types[c], wanted[c]) for c in types if c in wanted and alias.get(wanted[c], wanted[c]) != types[c]}
        print(f"{name}: {'ok' if problem is None else 'DIFFERENT ' + problem} ({len(ours)} rows, {spent:.1f}s)"
              + (f" types {odd}" if odd else ""), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
