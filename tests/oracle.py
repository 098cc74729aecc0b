"""Runs registered queries beside their oracle SQL and compares the rows."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, (bytearray, bytes)):
        return bytes(value).hex()
    return value if value is None else str(value)


def compare(spark, connection, name, query, sql, directory) -> tuple[bool, str]:
    started = time.time()
    frame = query(spark, directory)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(v) for v in row) for row in frame.select(*columns).collect())
    took = time.time() - started
    if sql is None:
        return True, f"{name}: {sum(got.values())} rows, no oracle, {took:.1f}s"
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return False, f"{name}: columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    if got == want:
        empty = "" if got else " EMPTY"
        return True, f"{name}: {sum(got.values())} rows equal{empty}, {took:.1f}s"
    extra, lost = list((got - want).items())[:3], list((want - got).items())[:3]
    return False, (
        f"{name}: {sum(got.values())} rows against {sum(want.values())}\n  columns {columns}\n"
        f"  only here: {extra}\n  only oracle: {lost}"
    )


def main(directory: str, prefixes: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import importlib

    from strongroom import plans
    from strongroom.plans.registry import ORACLES, QUERIES
    from strongroom.session import local_session

    for family in plans.FAMILIES:
        if importlib.util.find_spec(f"strongroom.plans.{family}"):
            importlib.import_module(f"strongroom.plans.{family}")
    spark, connection, bad = local_session(), connect(directory), 0
    for name, query in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, text = compare(spark, connection, name, query, ORACLES.get(name), directory)
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + text, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
