"""Run registered queries next to their SQL and compare all values.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(
            tuple(
                None
                if value is None or value is pd.NA or (isinstance(value, float) and value != value)
                else (float(value) if isinstance(value, (int, float)) else str(value))
                for value in (v.item() if hasattr(v, "item") else v for v in row)
            )
        )
    return sorted(rows, key=repr)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    left, right = rows_of(spark_frame), rows_of(sql_frame)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}: {left[:2]} | {right[:2]}"
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(wrong)} of {len(left)} rows differ: {wrong[:2]}" if wrong else None


TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def type_difference(found, connection, statement: str) -> str | None:
    """Columns whose types differ between Spark and SQL."""
    described = connection.execute(f"DESCRIBE {statement}").fetchall()
    wanted = {row[0]: TYPES.get(row[1], row[1]) for row in described}
    ours = dict(found.dtypes)
    wrong = {name: (ours.get(name), kind) for name, kind in wanted.items() if ours.get(name) != kind}
    return f"types {wrong}" if wrong else None


def main() -> int:
    import __spark_entry__ as contract
    from lodestone.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    checks = contract.oracle_sql()
    failed = 0
    for name, run in contract.queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            frame = run(spark, folder)
            found = frame.toPandas()
            took = time.time() - started
            problem = "no check"
            if name in checks:
                started = time.time()
                connection = open_tables(folder)
                expected = connection.execute(checks[name]).df()
                problem = difference(found, expected)
                problem = problem or type_difference(frame, connection, checks[name])
            note = f"rows {len(found)} spark {took:.1f}s sql {time.time() - started:.1f}s"
        except Exception as error:  # noqa: BLE001 - reported per query
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem not in (None, "no check")
        print(f"{'OK  ' if problem is None else 'FAIL' if problem != 'no check' else 'none'}"
              f" {name} {note} {problem or ''}", flush=True)  # fmt: skip
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
