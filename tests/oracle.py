"""Run registered queries next to their SQL and compare every value.

    python tests/oracle.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    """One value in a form that compares across engines."""
    if value is None or value is pd.NaT:
        return "null"
    if isinstance(value, float):
        return "null" if value != value else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


def arrow_kind(kind) -> str:
    text = str(kind)
    return text.replace("large_", "").replace("string_view", "string")


def compare(spark_df, sql_result) -> str:
    """Empty when columns, types and all rows agree, else what differs."""
    ours, theirs = spark_df.toArrow(), sql_result.to_arrow_table()
    names = sorted(ours.column_names)
    if names != sorted(theirs.column_names):
        return f"columns {names} / {sorted(theirs.column_names)}"
    kinds = [(n, arrow_kind(ours.schema.field(n).type), arrow_kind(theirs.schema.field(n).type))
             for n in names]
    differing = [k for k in kinds if k[1] != k[2]]
    left, right = (
        sorted(zip(*[[plain(v) for v in t.column(n).to_pylist()] for n in names]))
        for t in (ours, theirs))
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if unequal:
        a, b = unequal[0]
        return f"{len(unequal)} of {len(left)} rows differ, first: {str(a)[:400]} / {str(b)[:400]}"
    return f"types {differing}" if differing else ""


def main() -> int:
    import __spark_entry__ as entry
    from tessera.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(sf_dir)
    sql, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            rows = query(spark, sf_dir)
            if name in sql:
                verdict = compare(rows, connection.sql(sql[name]))
            else:
                verdict = f"no SQL, {rows.count()} rows"
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(verdict)
        print(f"{'ok  ' if not verdict else 'FAIL'} {name} {time.time() - started:.1f}s {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
