"""Compare registered queries with their SQL twins in DuckDB.

Usage: python -m tests.oracle_check [sf] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _rows(table: pa.Table) -> Counter:
    names = sorted(table.column_names)
    return Counter(tuple(_plain(v) for v in row) for row in zip(*[table.column(n).to_pylist() for n in names], strict=True))


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between the query's rows and the SQL's; empty if nothing does."""
    got = df.toArrow()
    want = con.sql(sql).to_arrow_table()
    problems = []
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} against {sorted(want.column_names)}"]
    for n in got.column_names:
        a, b = got.schema.field(n).type, want.schema.field(n).type
        if str(a).replace("large_", "") != str(b).replace("large_", ""):
            problems.append(f"type of {n}: {a} against {b}")
    if got.num_rows != want.num_rows:
        problems.append(f"{got.num_rows} rows against {want.num_rows}")
    a, b = _rows(got), _rows(want)
    if a != b:
        extra, missing = a - b, b - a
        problems.append(f"{sum(extra.values())} rows only in Spark, such as {list(extra)[:2]}; {sum(missing.values())} only in SQL, such as {list(missing)[:2]}")
    return problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tripweave.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle-check", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    twins, bad = oracle_sql(), 0
    for name, run in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        begin = time.time()
        try:
            df = run(spark, sf_dir)
            problems = differences(df, con, twins[name]) if name in twins else [] if df.count() >= 0 else ["no rows"]
            size = "" if name in twins else "  (no SQL twin)"
        except Exception as e:  # noqa: BLE001
            problems, size = [f"{type(e).__name__}: {str(e)[:800]}"], ""
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - begin:.1f}s{size}", *problems, sep="\n    " if problems else "", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
