"""Holds a query's rows against its SQL in DuckDB. As a program: oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return int(x) if hasattr(x, "__index__") else str(x) if not isinstance(x, (int, str)) else x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {bad}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    where, names = sys.argv[1], sys.argv[2:]
    con, queries, sql = connect(where), entry.queries(), entry.oracle_sql()
    for name in names if names and not names[0].endswith("*") else [n for n in queries if n.startswith(names[0][:-1] if names else "") and n in sql]:
        began = time.time()
        try:
            said = difference(spark, con, queries[name], sql[name], where)
        except Exception as e:  # noqa: BLE001  a report of all queries
            said = f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{'ok  ' if not said else 'BAD '} {name} {time.time() - began:.1f} s {said[:700]}", flush=True)
