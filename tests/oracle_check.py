"""Run registered queries against their SQL: ``python -m tests.oracle_check [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        number = round(float(value), 4)
        return f"{number + 0.0:.4f}"
    return str(value)


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in data),
        key=lambda row: tuple((c is None, c or "") for c in row),
    )


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got = rows(df.columns, df.collect())
    relation = con.sql(sql)
    want = rows(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{str(a)[:400]} != {str(b)[:400]}"
    return None


def main() -> int:
    from colloquy.plans.oracles import ORACLES
    from colloquy.plans.registry import QUERIES
    from colloquy.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                count = len(QUERIES[name](spark, sf_dir).collect())
                problem, note = None, f"rows only: {count}"
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:34s} {time.time() - start:7.2f}s {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine; {sorted(set(ORACLES) - set(QUERIES))} without query")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
