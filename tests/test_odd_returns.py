"""Return statistics and drawdowns against their SQL where a series loses more than everything, never loses or never moves."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import pytest
from oracle_compare import TABLES, duck
from test_zero_prices import told_apart

import __spark_entry__ as entry
from tidebar.operators import stats, volatility
from tidebar.operators.ordered import Axis
from tidebar.plans import evaluation, registry

SF = Path("/root/testdata/sf0.01")
SPEC = (
    "symbol:s n:i mean:8 sharpe:6 volatility:6 avg_win:8 avg_loss:8 max_win:8 max_loss:8 win_rate:6 skew:6 kurtosis:6 total_return:8 "
    "max_drawdown:8 ulcer:8 cagr:8 sortino:6 profit_factor:6 omega:6 tail_ratio:6 calmar:6 var_95:8 es_95:8"
)
SERIES = {
    "ordinary": [0.01, -0.02, 0.03, -0.01, 0.02],
    "more than everything": [0.01, -0.02, -1.25, 0.02, -0.01],
    "twice": [0.01, -1.5, 0.02, -1.25, 0.03],
    "everything": [0.5, -0.25, -1.0, 0.25, 0.5],
    "everything at once": [-1.0, 0.25, -0.5],
    "no loss": [0.0, 0.25, 0.5],
    "no gain": [-0.25, 0.0, -0.5],
    "flat": [0.0] * 4,
    "one": [0.25],
    None: [0.25, -0.125, 0.5, -0.25],
}
RETURNS = [(s, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), r) for s, some in SERIES.items() for i, r in enumerate(some)]


def differing(got, want) -> tuple[list[str], list[str]]:
    columns = [d[0] for d in want.description]
    have, due = told_apart(got.collect(), got.columns), told_apart(want.fetchall(), columns)
    return [x for x in have if x not in due], [x for x in due if x not in have]


@pytest.fixture
def con():
    con = duckdb.connect()
    con.execute("CREATE TABLE sr (symbol VARCHAR, ts TIMESTAMP, ret DOUBLE)")
    con.executemany("INSERT INTO sr VALUES (?, ?, ?)", RETURNS)
    return con


def test_statistics_follow_the_sql(spark, con):
    made = stats.return_statistics(spark.createDataFrame(RETURNS, "symbol string, ts timestamp, ret double"), ["symbol"])
    sql = "WITH " + evaluation._STATS.removeprefix(evaluation._EARN).removeprefix(", ")
    assert differing(registry.present(made, SPEC), con.execute(registry.wrap_sql(sql, SPEC))) == ([], [])


@pytest.mark.parametrize("step", [86_400, 60])
def test_drawdown_follows_the_sql(spark, con, step):
    spec = "symbol:s ts:t equity:6 drawdown:6"
    returns = [r for r in RETURNS if r[0]]
    made = volatility.drawdown(spark.createDataFrame(returns, "symbol string, ts timestamp, ret double"), Axis(order="ts", step=step))
    sql = """WITH e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY ts)) AS equity FROM sr WHERE symbol IS NOT NULL)
    SELECT symbol, ts, equity, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS drawdown FROM e"""
    assert differing(registry.present(made, spec), con.execute(registry.wrap_sql(sql, spec))) == ([], [])


def test_return_stats_of_a_brand_that_loses_more_than_everything(spark, tmp_path):
    """The day of the worst return is four times as dear, so a short position loses more than there is."""
    given = duck(str(SF))
    symbol, ts = given.execute(evaluation._EARN + " SELECT arg_min(symbol, ret), arg_min(ts, ret) FROM sr").fetchone()
    for table in TABLES:
        if table != "lineitem":
            (tmp_path / f"{table}.parquet").symlink_to(SF / f"{table}.parquet")
    given.execute(f"""COPY (SELECT l.* REPLACE (CASE WHEN p_brand = '{symbol}' AND l_shipdate = TIMESTAMP '{ts}' - INTERVAL 1 DAY THEN 4 ELSE 1 END * l_extendedprice AS l_extendedprice)
    FROM lineitem l JOIN part ON l_partkey = p_partkey) TO '{tmp_path}/lineitem.parquet'""")
    changed = duck(str(tmp_path))
    assert changed.execute(evaluation._EARN + " SELECT min(ret) FROM sr").fetchone()[0] < -1
    got = entry.queries()["return_stats"](spark, str(tmp_path))
    assert differing(got, changed.execute(entry.oracle_sql()["return_stats"])) == ([], [])
