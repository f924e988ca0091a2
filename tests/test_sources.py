"""Stores on disk: appends, round trips, precision and migration."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidebar.operators import options, universe
from tidebar.sources import bars as store

DAY0 = dt.datetime(2024, 1, 1)


def raw(spark, first: int, n: int, symbol: str = "ES"):
    rows = [(symbol, "X", DAY0 + dt.timedelta(days=first - 1 + i), *[4500.25 + first + i] * 4, 10.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, venue string, ts_event timestamp, open double, high double, low double, close double, volume double")


def bars(spark, first, n, symbol="ES"):
    return store.normalize_bars(raw(spark, first, n, symbol), "ohlcv-1d", F.lit(2))


def test_append_outside_coverage(spark, tmp_path):
    path = str(tmp_path / "bars")
    total = 0
    for first, n, written in ((10, 10, 10), (15, 10, 5), (1, 12, 9), (5, 5, 0)):
        store.append_bars(bars(spark, first, n), path)
        total += written
        assert spark.read.parquet(path).count() == total
    got = store.read_bars(spark, path, "ES", "ohlcv-1d", "X", start=DAY0 + dt.timedelta(days=3), end=DAY0 + dt.timedelta(days=5))
    assert [r.close for r in got.orderBy("ts_init").collect()] == [4503.25, 4504.25, 4505.25]
    assert "PartitionFilters: [isnotnull(schema" in got._jdf.queryExecution().toString()
    assert store.resolve_venue(store.read_bars(spark, path), "ES") == "X"
    with pytest.raises(LookupError):
        store.resolve_venue(store.read_bars(spark, path), "NQ")
    store.compact_bars(spark, path, str(tmp_path / "packed"))
    whole = store.reconcile_bars(store.read_bars(spark, path), store.read_bars(spark, str(tmp_path / "packed")), store.SERIES)
    assert [r.ok for r in whole.collect()] == [True]


@pytest.mark.parametrize("values,places", [([4500.0, 4501.0], 0), ([4500.25, 4500.5], 2), ([110.015625, 110.03125], 6), ([0.0067235, 0.006724], 7)])
def test_precision(spark, values, places):
    frame = spark.createDataFrame([("s", v) for v in values], "symbol string, close double")
    assert store.infer_price_precision(frame, ["symbol"], ["close"]).first().precision == places


def test_decimals_are_exact(spark):
    got = spark.createDataFrame([(100.05,), (0.29,), (2.5,)], "x double").select(store.exact_decimal(F.col("x"), F.lit(2)).alias("d")).collect()
    assert [str(r.d) for r in got] == ["100.0500000000000000", "0.2900000000000000", "2.5000000000000000"]


def test_lossy_bars_fail(spark):
    frame = raw(spark, 1, 3)
    low = frame.select("symbol").distinct().withColumn("precision", F.lit(1))
    with pytest.raises(PySparkException):
        store.conform_precision(frame, low).collect()
    assert store.lossy_rows(frame, low).count() == 3
    assert store.conform_precision(frame, low.withColumn("precision", F.lit(2))).count() == 3


def test_gaps(spark):
    d = lambda n: DAY0 + dt.timedelta(days=n)
    stored = spark.createDataFrame([("a", d(20)), ("a", d(40)), ("b", d(4)), ("b", d(60))], "symbol string, ts_init timestamp")
    wanted = spark.createDataFrame([(s, d(0), d(50)) for s in "abc"], "symbol string, start timestamp, end timestamp")
    got = {(r.symbol, r.kind): (r.gap_start, r.gap_end) for r in store.coverage_gaps(wanted, stored, ["symbol"]).collect()}
    assert got == {("a", "head"): (d(0), d(20)), ("a", "tail"): (d(40), d(50)), ("c", "all"): (d(0), d(50))}


def test_small_stores(spark, tmp_path):
    spans = spark.createDataFrame([("ES", dt.date(2024, 1, 1), dt.date(2024, 3, 1), "ESH4")], "symbol string, d0 date, d1 date, raw_symbol string")
    store.write_spans(spans, str(tmp_path / "spans"))
    assert store.read_spans(spark, str(tmp_path / "spans")).collect() == spans.collect()
    returns = spark.createDataFrame([("s", 1, 0, DAY0, 0.1)], "study string, trial long, fold int, ts timestamp, ret double")
    for _ in range(2):
        store.write_returns(returns, str(tmp_path / "returns"))
    assert store.read_returns(spark, str(tmp_path / "returns")).where("study = 's'").count() == 2
    chain = spark.createDataFrame([(DAY0, "ESH4 P4490", 1.0, 1.0, 1.0, 1.0, 5.0)], "ts_event timestamp, symbol string, open double, high double, low double, close double, volume double")
    store.write_option_bars(options.tidy_options(chain), str(tmp_path / "chain"))
    assert store.read_option_bars(spark, str(tmp_path / "chain")).where("root = 'ES'").count() == 1
    with pytest.raises(PySparkException):
        store.write_option_bars(options.tidy_options(chain), str(tmp_path / "chain"))


def test_migration(spark, tmp_path):
    frame = raw(spark, 1, 5).drop("symbol", "venue")
    for symbol in ("ES", "NQ"):
        frame.unionByName(frame.limit(2)).coalesce(1).write.parquet(str(tmp_path / "w" / symbol))
        part = next((tmp_path / "w" / symbol).glob("part-*.parquet"))
        (tmp_path / "legacy" / "futures" / symbol).mkdir(parents=True)
        part.rename(tmp_path / "legacy" / "futures" / symbol / "ohlcv-1d.parquet")
    got = store.migrate_bars(spark, str(tmp_path / "legacy"))
    assert got.count() == 10 and {r.symbol for r in got.collect()} == {"ES", "NQ"}
    assert {(r.type, r.schema) for r in got.collect()} == {("futures", "ohlcv-1d")}


def test_option_rows(spark):
    rows = [("ESH4 P4490", 10.0), ("ESH4-ESM4", 3.0), ("ESH4 C4500", 0.0), ("ESH4 C4510", 2.0)]
    frame = spark.createDataFrame([(dt.datetime(2023, 12, 1), s, c, c, c, c, 1.0) for s, c in rows], "ts_event timestamp, symbol string, open double, high double, low double, close double, volume double")
    got = options.tidy_options(frame).orderBy("symbol").collect()
    assert [(r.right, r.strike, r.expiry, r.days_to_expiry) for r in got] == [("C", 4510.0, dt.date(2024, 3, 15), 105), ("P", 4490.0, dt.date(2024, 3, 15), 105)]


@pytest.mark.parametrize("under,on,expiry", [("ESH4", "2023-12-01", "2024-03-15"), ("ESH4", "2024-03-15", "2024-03-15"), ("ESH4", "2024-03-16", "2034-03-17"), ("ESZ9", "2020-02-01", "2029-12-21"), ("ESH24", "2019-05-01", "2024-03-15")])
def test_expiry(spark, under, on, expiry):
    row = spark.createDataFrame([(under, on)], "u string, d string").select(options.option_expiry(F.col("u"), F.to_date("d")).alias("e")).first()
    assert str(row.e) == expiry


HTML = """<table><tr><th>Symbol</th><th>Name</th></tr><tr><td><a href="x">AAPL</a></td><td>Apple &amp; Co</td></tr><TR><TD>MSFT</TD><TD>Micro
soft</TD></TR></table>"""
CHANGES = """<table><tr><th rowspan=2>Date</th></tr><tr><th>Ticker</th></tr>
<tr><td>March 3, 2020</td><td>AAA</td><td>A Co</td><td>BBB</td><td>B Co</td><td>Bought</td></tr>
<tr><td>April 4, 2021</td><td></td><td></td><td>CCC</td><td>C Co</td><td>Gone</td><td>x</td></tr>
<tr><td>someday</td><td>D</td><td>D</td><td>E</td><td>E</td><td>F</td></tr><tr><td>short</td></tr></table>"""


def test_membership_pages(spark):
    pages = spark.createDataFrame([(1, HTML), (2, CHANGES)], "page int, html string")
    rows = universe.html_table_rows(pages, ["page"])
    names = universe.parse_constituents(rows.where("page = 1")).collect()
    assert [tuple(r) for r in names] == [("AAPL", "Apple & Co"), ("MSFT", "Micro soft")]
    changes = universe.parse_changes(rows.where("page = 2")).orderBy("effective_date")
    assert [tuple(r) for r in changes.collect()] == [
        (dt.date(2020, 3, 3), "AAA", "BBB", "Bought"), (dt.date(2021, 4, 4), None, "CCC", "Gone"),
    ]
    current = spark.createDataFrame([("AAPL",)], "symbol string")
    ever = universe.ever_members(current, changes, "2021-01-01", None)
    assert {r.symbol for r in ever.collect()} == {"AAPL", "CCC"}


def test_merge_disjoint_rejects_overlap(spark, daily):
    from tidebar.operators.panel import merge_disjoint

    a, b = daily({"a": [1, 2]}), daily({"b": [3, 4]})
    assert merge_disjoint(a, b).count() == 4
    with pytest.raises(PySparkException):
        merge_disjoint(a, a).collect()


def test_migration_reads_nanosecond_stamps(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "old" / "equity" / "AA"
    folder.mkdir(parents=True)
    at = pa.array([1_600_000_000_000_000_123, 1_600_000_000_000_000_999, 1_600_000_060_000_000_000], pa.timestamp("ns"))
    pq.write_table(pa.table({"ts_event": at, "close": [1.0, 2.0, 3.0]}), folder / "ohlcv-1m.parquet", version="2.6")
    got = sorted((x.symbol, x.type, x.schema, x.ts_event.timestamp(), x.close) for x in store.migrate_bars(spark, str(tmp_path / "old")).collect())
    assert [x[4] for x in got] == [2.0, 3.0] and got[0][:3] == ("AA", "equity", "ohlcv-1m")
