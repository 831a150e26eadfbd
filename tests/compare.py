"""Runs registered queries against their SQL and reports differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return tuple(value) if isinstance(value, list) else value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def difference(spark_df, connection, sql: str) -> str | None:
    found = connection.execute(sql)
    sql_columns = [d[0] for d in found.description]
    expected = canonical(sql_columns, found.fetchall())
    actual = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(sql_columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(sql_columns)}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows against {len(expected)}"
    for a, b in zip(actual, expected):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(sql_columns)}\n   spark {a}\n   sql   {b}"
    return None


def main(names: list[str], sf_dir: str) -> int:
    from tests.session import local_session
    from __spark_entry__ import oracle_sql, queries
    spark, connection = local_session(), duck(sf_dir)
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = difference(run(spark, sf_dir), connection, oracle_sql()[name]) if name in oracle_sql() else (
                None if run(spark, sf_dir).count() >= 0 else "no rows")
        except Exception as error:  # noqa: BLE001  (reported, not hidden)
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[2:], sys.argv[1]))
