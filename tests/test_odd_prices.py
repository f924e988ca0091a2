"""Queries over event bars against their SQL where prices are odd: zeros below zero, series that never move, prices that are missing."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle_compare import TABLES, duck
from test_zero_prices import told_apart

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.01")
RANGES = "parkinson garman_klass rogers_satchell yang_zhang".split()
ROUGH = "log_variance_proxy log_variance_proxy_long_axis variogram hurst hurst_nugget fit_ou roughness_gate".split()


def minus_zero(i: int, kind: str, value: float):
    return -0.0 if i % 97 == 0 else value


def flat(i: int, kind: str, value: float):
    return 5.0 if kind == "view" else value


def missing(i: int, kind: str, value: float):
    return None if i % 7 == 0 else value


def same_as_sql(spark, folder: Path, change, name: str) -> None:
    """*name* gives what its SQL gives when ``change(number, type, value)`` makes the values of the small tables."""
    for table in TABLES:
        if table != "events":
            (folder / f"{table}.parquet").symlink_to(SF / f"{table}.parquet")
    events = pq.read_table(SF / "events.parquet")
    kinds, values = events["event_type"].to_pylist(), events["value"].to_pylist()
    changed = pa.array([change(i, k, v) for i, (k, v) in enumerate(zip(kinds, values))], pa.float64())
    pq.write_table(events.set_column(events.schema.get_field_index("value"), "value", changed), folder / "events.parquet")
    got = entry.queries()[name](spark, str(folder))
    want = duck(str(folder)).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert told_apart(got.collect(), got.columns) == told_apart(want.fetchall(), columns)


@pytest.mark.parametrize("name", RANGES)
def test_zeros_keep_their_sign(spark, tmp_path, name):
    same_as_sql(spark, tmp_path, minus_zero, name)


@pytest.mark.parametrize("name", ROUGH)
def test_series_that_never_move(spark, tmp_path, name):
    same_as_sql(spark, tmp_path, flat, name)


@pytest.mark.parametrize("name", ["bars_hourly", "stream_tick_to_bar", "garman_klass", *ROUGH])
def test_ticks_without_a_price(spark, tmp_path, name):
    same_as_sql(spark, tmp_path, missing, name)
