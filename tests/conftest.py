from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from tidebar.session import build_session

    session = build_session("tests", "local[8]", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def daily(spark):
    """Build daily bars from ``{symbol: closes}`` (a null close is a missing day)."""
    import datetime as dt

    def make(series: dict, start: dt.datetime = dt.datetime(2020, 1, 1)):
        rows = []
        for symbol, closes in series.items():
            for i, c in enumerate(closes):
                if c is not None:
                    open_ = start + dt.timedelta(days=i)
                    rows.append((symbol, open_, open_ + dt.timedelta(days=1), float(c), float(c), float(c), float(c), 1e6))
        return spark.createDataFrame(
            rows, "symbol string, ts_event timestamp, ts_init timestamp, open double, high double, low double, close double, volume double"
        )

    return make
