"""Queries over event bars against their SQL where prices are zero: quotients and logarithms are infinite or no number (NaN)."""

from __future__ import annotations

import math
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from oracle_compare import TABLES, duck

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.01")
QUERIES = (
    "parkinson garman_klass rogers_satchell yang_zhang log_variance_proxy log_variance_proxy_long_axis variogram hurst hurst_nugget fit_ou "
    "roughness_gate realised_vol_minutes"
).split()


def told_apart(rows, columns: list[str]) -> list[str]:
    """Rows as sorted text: null, NaN and infinity differ."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(["NaN" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in at]) for r in rows)


@pytest.fixture(scope="module", params=["low", "all"])
def tables(request, tmp_path_factory):
    """The small tables with a zero in the middle of some hours (``low``), or with whole hours at zero as well (``all``)."""
    folder = tmp_path_factory.mktemp("zero")
    for name in TABLES:
        if name != "events":
            (folder / f"{name}.parquet").symlink_to(SF / f"{name}.parquet")
    events = pq.read_table(SF / "events.parquet")
    hour = pc.floor_temporal(events["ts"], unit="hour")
    key = [f"{a} {b}" for a, b in zip(events["event_type"].to_pylist(), hour.to_pylist())]
    order = sorted(range(len(key)), key=lambda i: (key[i], events["ts"][i].as_py()))
    value, some = events["value"].to_pylist(), {}
    for i in order:
        some.setdefault(key[i], []).append(i)
    wide = [x for x in some.values() if len(x) >= 3]
    for rows in wide[5::61]:
        value[rows[1]] = 0.0
    if request.param == "all":
        for rows in list(some.values())[9::257]:
            for i in rows:
                value[i] = 0.0
    pq.write_table(events.set_column(events.schema.get_field_index("value"), "value", pa.array(value, pa.float64())), folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_zero_prices_follow_the_sql(spark, tables, name):
    got = entry.queries()[name](spark, tables)
    want = duck(tables).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert told_apart(got.collect(), got.columns) == told_apart(want.fetchall(), columns)
