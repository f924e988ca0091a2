"""Incremental behaviour the one-pass stream queries do not show."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from tidebar.operators.strategies import trend_following
from tidebar.plans.streams import ROCKS, fresh
from tidebar.sources import bars as store
from tidebar.sources import committed
from tidebar.streaming import bars as streaming
from tidebar.streaming import live

DAY0 = dt.datetime(2024, 1, 1)


def test_append_is_idempotent_and_drops_inside_rows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "bars")

    def land(days):
        rows = [("a", "X", "ohlcv-1d", DAY0 + dt.timedelta(days=d), DAY0 + dt.timedelta(days=d + 1), *[float(d)] * 5) for d in days]
        frame = spark.createDataFrame(rows, "symbol string, venue string, schema string, ts_event timestamp, ts_init timestamp, open double, high double, low double, close double, volume double")
        frame.select(*[frame[f.name].cast(f.dataType) for f in store.BARS.fields]).coalesce(1).write.mode("append").parquet(source)

    def drain(state):
        stream = spark.readStream.schema(store.BARS).parquet(source)
        streaming.stream_append_bars(stream, target, str(tmp_path / state)).awaitTermination()
        return sorted(int(r.close) for r in committed.read(spark, target).collect())

    land([10, 11, 12, 12])
    assert drain("s") == [10, 11, 12]
    land([9, 11, 13])
    assert drain("s") == [9, 10, 11, 12, 13]
    assert drain("again") == [9, 10, 11, 12, 13]  # a lost checkpoint replays everything


def test_live_targets_across_batches(spark, daily):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    closes = {s: [100 + 10 * math.sin(i / (5 + k)) + i / 9 for i in range(60)] for k, s in enumerate("ab")}
    bars = daily(closes).select("symbol", "ts_init", "close")
    root = fresh(spark)
    processor = streaming.TrendTargets(5, 12, vol_lookback=8)
    for lo, hi in ((0, 25), (20, 40), (40, 61)):  # the second batch overlaps the first
        part = bars.where(f"ts_init > TIMESTAMP '2020-01-01' + INTERVAL {lo} DAYS AND ts_init <= TIMESTAMP '2020-01-01' + INTERVAL {hi} DAYS")
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(bars.schema).parquet(f"{root}/in")
        out = streaming.live_targets(stream, processor).writeStream.format("parquet").outputMode("append")
        out.option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.symbol, r.ts_init): r.target for r in spark.read.parquet(f"{root}/out").collect()}
    want = {(r.symbol, r.ts_init): r.target for r in trend_following(bars, 5, 12, vol_lookback=8).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tail_targets_see_earlier_batches(spark, daily):
    from tidebar.operators.strategies import ts_momentum
    from tidebar.plans.streams import _tail_targets
    from tidebar.session import store_once

    closes = {s: [100 + 10 * math.sin(i / (15 + k)) + i / 9 for i in range(900)] for k, s in enumerate("abc")}
    bars = store_once(daily(closes).select("symbol", "ts_init", "close"))
    signals = lambda df: ts_momentum(df, 30, 3, vol_lookback=10)
    got = {(r.symbol, r.ts_init): r.target for r in _tail_targets(spark, bars, signals, 60).collect()}
    want = {(r.symbol, r.ts_init): r.target for r in signals(bars).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_closes_are_settled_by_count_or_by_a_later_close(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    day = lambda d: DAY0 + dt.timedelta(days=d)
    schema = "symbol string, ts_init timestamp, expected long"
    parts = [
        [("a", day(1), 2), ("b", day(1), 2), ("a", day(2), 3), ("b", day(2), 3), ("a", day(3), 2)],
        [("b", day(3), 2), ("a", day(3), 2), ("a", day(4), 2)],  # the other half of a close, and a bar that comes again
        [("c", day(2), 3), ("b", day(3), 2)],  # too late
        [("a", day(5), 1)],
    ]
    seen, root = [], fresh(spark)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        out = live.settled_closes(spark.readStream.schema(schema).parquet(f"{root}/in")).writeStream.format("parquet").outputMode("append")
        out.option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        now = sorted(((r.ts_init - DAY0).days, r.n_bars, r.complete) for r in spark.read.schema("ts_init timestamp, n_bars long, complete boolean").parquet(f"{root}/out").collect())
        seen.append([x for x in now if x not in sum(seen, [])])
    assert seen == [[(1, 2, True), (2, 2, False)], [(3, 2, True)], [], [(4, 1, False), (5, 1, True)]]


def test_live_ranks_are_those_of_the_panel(spark, daily):
    """Where every symbol has every bar, live targets are the batch strategy's at its rebalances."""
    from tidebar.operators import strategies
    from tidebar.operators.panel import align_union
    from tidebar.plans.streams import arriving, into_files

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    closes = {s: [100 + 10 * math.sin(i / (5 + k)) + i / (9 + k) for i in range(90)] for k, s in enumerate("abcdef")}
    bars = daily(closes).select("symbol", "ts_init", "close", "volume")
    t = F.datediff("ts_init", F.lit("2020-01-02").cast("date"))
    rows = bars.select("symbol", "ts_init", "close", t.alias("t"), F.lit(6).alias("expected"))
    follow = lambda df, root: into_files(live.live_xs_momentum(df, 12, 3, vol_lookback=8, rebal_freq=5), root)
    root = arriving(spark, [rows.where("t < 31"), rows.where("t >= 31 and t < 60"), rows.where("t >= 60")], follow)
    got = {(r.symbol, r.ts_init): r.target for r in spark.read.parquet(f"{root}/out").collect()}
    batch = strategies.xs_momentum(align_union(bars), 12, 3, vol_lookback=8, rebal_freq=5).where("t >= 15 and (t - 15) % 5 = 0").collect()
    want = {(r.symbol, r.ts_init): r.target for r in batch}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
