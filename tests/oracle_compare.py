"""Run registered queries and their oracle SQL on the same tables and compare."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    return v


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_value(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, sf: str, name: str, run, sql: str | None) -> tuple[str, float, int]:
    start = time.time()
    frame = run(spark, sf).toPandas()
    took = time.time() - start
    if sql is None:
        return "rows-only", took, len(frame)
    want = con.execute(sql).df()
    if sorted(frame.columns) != sorted(want.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(want.columns)}", took, len(frame)
    got_rows, want_rows = rows_of(frame), rows_of(want)
    if len(got_rows) != len(want_rows):
        return f"rows {len(got_rows)} vs {len(want_rows)}", took, len(frame)
    bad = [(a, b) for a, b in zip(got_rows, want_rows) if a != b]
    if bad:
        return f"{len(bad)} differ: {bad[0]}", took, len(frame)
    return "ok", took, len(frame)


def main() -> None:
    import __spark_entry__ as entry
    from tidebar.session import build_session

    sf = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.01")
    names = sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = duck(sf), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        try:
            status, took, n = compare(spark, con, sf, name, run, oracles.get(name))
        except Exception as err:  # report and go on
            status, took, n = "ERROR " + str(err)[:600], 0.0, 0
        failed += status not in ("ok", "rows-only")
        print(f"{name:32s} {took:6.2f}s {n:7d} {status[:900]}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
