"""The committed store: interrupted, replayed, concurrent and lossy writes, compaction and pruning."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebar.sources import bars as store
from tidebar.sources import committed

DAY0 = dt.datetime(2024, 1, 1)


def bars_of(spark, days, symbol="a", venue="X", cents=0.25):
    rows = [(symbol, venue, "ohlcv-1d", DAY0 + dt.timedelta(days=d), DAY0 + dt.timedelta(days=d + 1), *[d + cents] * 4, 1.0) for d in days]
    frame = spark.createDataFrame(rows, "symbol string, venue string, schema string, ts_event timestamp, ts_init timestamp, open double, high double, low double, close double, volume double")
    return frame.select(*[frame[f.name].cast(f.dataType) for f in store.BARS.fields])


def days_in(spark, path, **where):
    return sorted((r.symbol, int(r.close)) for r in committed.read(spark, path, **where).collect())


def test_appends_at_either_end_and_replays(spark, tmp_path):
    path = str(tmp_path)
    assert days_in(spark, path) == []
    assert committed.append(bars_of(spark, [10, 12]), path, "one")
    assert committed.append(bars_of(spark, [9, 11, 13]), path, "two")
    assert not committed.append(bars_of(spark, [20]), path, "two")
    assert committed.append(bars_of(spark, [11]), path, "nothing new") and not committed.append(bars_of(spark, [30]), path, "nothing new")
    assert committed.append(bars_of(spark, [5], "b"), path)
    assert days_in(spark, path) == [("a", 9), ("a", 10), ("a", 12), ("a", 13), ("b", 5)]
    cover = {r.symbol: (r.bars, (r.first - DAY0).days, (r.last - DAY0).days, r.precision) for r in committed.coverage(committed.read_log(spark, path)).where("symbol is not null").collect()}
    assert cover == {"a": (4, 10, 14, 2), "b": (1, 6, 6, 2)}


def test_a_writer_that_stops_before_its_commit_leaves_nothing(spark, tmp_path):
    path = str(tmp_path)
    committed.append(bars_of(spark, [1]), path, "one")
    lost = committed._write(bars_of(spark, [2, 3]), path)
    assert days_in(spark, path) == [("a", 1)]
    committed.append(bars_of(spark, [2, 3]), path, "two")
    assert days_in(spark, path) == [("a", 1), ("a", 2), ("a", 3)]
    assert committed.vacuum(spark, path) == [f"commit={lost}"] and len(days_in(spark, path)) == 3


def test_one_of_two_writers_gets_a_version(spark, tmp_path):
    path = str(tmp_path)
    committed.append(bars_of(spark, [1]), path)
    late = committed._write(bars_of(spark, [7]), path)
    committed.append(bars_of(spark, [2]), path)
    with pytest.raises(Exception, match="exist"):
        committed._commit(spark, path, late, None, 1)
    assert days_in(spark, path) == [("a", 1), ("a", 2)]


def test_series_keep_their_decimals(spark, tmp_path):
    path = str(tmp_path)
    committed.append(bars_of(spark, [1]), path)
    with pytest.raises(Exception, match="precision"):
        committed.append(bars_of(spark, [2], cents=0.125), path)
    committed.append(bars_of(spark, [3], cents=0.5), path)
    committed.append(bars_of(spark, [1], "b", cents=0.125), path)
    assert {r.symbol: r.precision for r in committed.coverage(committed.read_log(spark, path)).collect()}["b"] == 3


def test_compaction_and_bounds(spark, tmp_path):
    path = str(tmp_path)
    for d in range(4):
        committed.append(bars_of(spark, [d]), path, f"b{d}")
    committed.append(bars_of(spark, [50], "z", "Y"), path)
    before = days_in(spark, path)
    committed.compact(spark, path)
    assert days_in(spark, path) == before and committed.read_log(spark, path).select("commit").distinct().count() == 1
    assert len(committed.vacuum(spark, path)) == 5 and days_in(spark, path) == before
    assert not committed.append(bars_of(spark, [9]), path, "b2")  # names outlive compaction
    assert days_in(spark, path, symbol="a", start=DAY0 + dt.timedelta(days=2), end=DAY0 + dt.timedelta(days=3)) == [("a", 1), ("a", 2)]
    assert days_in(spark, path, venue="Y") == [("z", 50)] and days_in(spark, path, venue="Q") == []


def test_appending_reads_no_bars(spark, tmp_path):
    path = str(tmp_path)
    committed.append(bars_of(spark, [1, 2]), path)
    known = committed.coverage(committed.read_log(spark, path))
    ends = known.select(*store.SERIES, F.explode(F.array("first", "last")).alias("ts_init"))
    assert all("/log/" in f for f in ends.inputFiles())
    gaps = committed.coverage_gaps(ends.select(*store.SERIES).distinct().withColumns({"start": F.lit(DAY0), "end": F.lit(DAY0 + dt.timedelta(days=9))}), committed.read_log(spark, path))
    assert [(r.kind, (r.gap_end - r.gap_start).days) for r in gaps.collect()] == [("tail", 6)]
