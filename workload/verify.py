"""Runs registered checks beside their SQL: ``python -m workload.verify FOLDER [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return int(value) if value == int(value) else value
    try:
        number = float(value)
        return int(value) if number == int(value) else number
    except (TypeError, ValueError):
        return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(con, df, sql: str | None) -> str:
    """Empty if equal, else what differs."""
    got = df.collect()
    names = df.columns
    if sql is None:
        return f"rows only: {len(got)}" if got else "no rows"
    rel = con.execute(sql)
    want_names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} / {sorted(want_names)}"
    a, b = rows_of(names, got), rows_of(want_names, want)
    if a == b:
        return "" if got else "equal but empty"
    return f"{len(got)} / {len(want)} rows; {sorted(names)}; spark only {list((a - b).items())[:2]}; sql only {list((b - a).items())[:2]}"


def main(argv: list[str]) -> int:
    from tagtide import build_session
    from workload.catalog import load

    sf, wanted = argv[0], argv[1:]
    spark = build_session("verify", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name, (run, sql) in load().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            plan = df._jdf.queryExecution().executedPlan().toString()
            crossed = [w for w in ("CartesianProduct", "NestedLoop") if w in plan]
            result = f"plan has {crossed}" if crossed else compare(con, df, sql)
        except Exception as error:  # noqa: BLE001  (report and go on)
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(result) and not result.startswith("rows only")
        print(f"{time.time() - start:6.2f}s {name}: {result or 'ok'}", flush=True)
    print("failing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
