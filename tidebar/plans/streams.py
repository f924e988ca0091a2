"""Queries that run a stream over the given tables to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import panel
from ..operators.panel import calendar
from ..session import checkpoint_dir, store_once
from ..sources import bars as store
from ..sources import committed
from ..streaming import bars as streaming
from ..streaming import live
from . import inputs as src
from .ingest import _OLD, _STORE, old_part, stored
from .inputs import _EVENTS, BRAND, _sql_bars
from .registry import query
from .signals import QUERY_MOMENTUM, QUERY_TREND

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh(spark) -> str:
    """A new folder next to the checkpoints, shared by all executors."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(frame, spark):
    """Run a streaming frame over everything available and read its output."""
    out = fresh(spark)
    frame.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode(
        "append"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data")


def tick_stream(spark, sf):
    schema = src.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.lit(1.0).alias("size"), "event_id",
    )


def bar_stream(spark, bars):
    """Bars written out and read back as a stream."""
    path = fresh(spark)
    bars.write.parquet(path)
    return spark.readStream.schema(bars.schema).parquet(path)


_SEEN = " WHERE ts_init <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("symbol:s ts_event:t ts_init:t open:4 high:4 low:4 close:4 volume:2", "WITH " + _sql_bars(_EVENTS, "1 HOUR", "event_id", "bars") + " SELECT * FROM bars" + _SEEN)
def stream_tick_to_bar(spark, sf):
    """Hourly bars of the event stream whose close the watermark has passed."""
    return drain(streaming.tick_to_bar_stream(tick_stream(spark, sf), 3600, "10 minutes", ["event_id"]), spark)


@query("symbol:s ts_init:t open:4 close:4 volume:2", "WITH " + _sql_bars(_EVENTS, "15 MINUTE", "event_id", "bars") + """, x AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts_event) AS b, * EXCLUDE (symbol) FROM bars)
SELECT symbol, b + INTERVAL 1 HOUR AS ts_init, arg_min(open, ts_event) AS open, arg_max(close, ts_event) AS close, sum(volume) AS volume FROM x GROUP BY symbol, b HAVING b + INTERVAL 1 HOUR <= (SELECT max(ts_event) FROM bars)""")
def stream_resample(spark, sf):
    bars = src.event_bars(spark, sf, 900)
    return drain(streaming.resample_stream(bar_stream(spark, bars), 3600, "0 seconds"), spark)


@query("ts_init:t n_bars:i", BRAND + ", c AS (SELECT ts_init, count(*) AS n_bars FROM bars GROUP BY 1) SELECT * FROM c WHERE ts_init + INTERVAL 1 SECOND <= (SELECT max(ts_init) FROM bars)")
def stream_complete_batches(spark, sf):
    """Closes whose batch of bars is complete."""
    return drain(streaming.complete_batches(bar_stream(spark, src.brand_bars(spark, sf)), "0 seconds"), spark)


@query("symbol:s venue:s ts_init:t close:2", _STORE + _OLD + """, c AS (SELECT symbol, min(ts_init) AS f, max(ts_init) AS l FROM old GROUP BY symbol)
SELECT symbol, venue, ts_init, close FROM old UNION ALL SELECT sb.symbol, sb.venue, sb.ts_init, sb.close FROM sb LEFT JOIN c USING (symbol) WHERE f IS NULL OR ts_init < f OR ts_init > l""")
def stream_append_bars(spark, sf):
    """A store of older bars, then the whole bar stream appended under the coverage rule."""
    root = fresh(spark)
    price = {c: F.col(c).cast(store.PRICE) for c in [*store.OHLC, "volume"]}
    committed.append(old_part(spark, sf).withColumns(price), f"{root}/bars")
    incoming = bar_stream(spark, stored(spark, sf).withColumns(price))
    streaming.stream_append_bars(incoming, f"{root}/bars", f"{root}/state").awaitTermination()
    return committed.read(spark, f"{root}/bars", schema="ohlcv-1d")


@query("symbol:s ts_init:t target:6", QUERY_TREND)
def stream_live_targets(spark, sf):
    """Trend targets from a bounded per-symbol state, one per streamed bar."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    bars = src.brand_bars(spark, sf).select("symbol", "ts_init", "close")
    return drain(streaming.live_targets(bar_stream(spark, bars)), spark)


def arriving(spark, parts, run):
    """Let *parts* of a table arrive one after the other, each a set of files, and *run* the stream to its end after each.

    *run* takes the stream and the folder of its state. A part is one micro-batch of as many tasks as it has files.
    """
    root = fresh(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        run(spark.readStream.schema(part.schema).parquet(f"{root}/in"), root).awaitTermination()
    return root


def _tail_targets(spark, bars, signals, tail_days):
    """Run *signals* over bars that arrive year after year, one micro-batch each."""
    years = [r["y"] for r in bars.select(F.year("ts_init").alias("y")).distinct().orderBy("y").collect()]  # one row a year
    root = fresh(spark)

    def write(df, number):
        df.select("symbol", "ts_init", "target").write.mode("overwrite").parquet(f"{root}/targets/batch={number}")

    arriving(
        spark, [bars.where(F.year("ts_init") == y) for y in years],
        lambda late, _: streaming.stream_tail_targets(late, f"{root}/bars", signals, write, f"{root}/state", tail_days),
    )
    return spark.read.parquet(f"{root}/targets").drop("batch")


@query("symbol:s ts_init:t target:6", QUERY_MOMENTUM)
def stream_tail_targets(spark, sf):
    """Targets of each of several micro-batches, computed with the stored bars before it."""
    from ..operators.strategies import ts_momentum

    bars = src.brand_bars(spark, sf).select("symbol", "ts_init", "close")
    return _tail_targets(spark, store_once(bars), lambda df: ts_momentum(df, 60, 5, vol_lookback=20), 2000)


def into_files(frame, root):
    return frame.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode(
        "append"
    ).trigger(availableNow=True).start()


def calendar_parts(spark, sf, missing: int):
    """Bars with the place of their close in the calendar and the bars it is to have, in three parts that cut closes in two.

    Every third close is to have *missing* bars more than ever come. The last part repeats bars of the first, long after their closes.
    """
    bars = src.brand_bars(spark, sf).select("symbol", "ts_init", "close")
    days = calendar(bars).join(panel.universe_size(bars), "ts_init")
    days = days.withColumn("expected", F.col("n_bars") + F.when(F.col("t") % 3 == 2, missing).otherwise(0)).drop("n_bars")
    rows = store_once(bars.join(F.broadcast(days), "ts_init"))  # one row a close
    last = rows.agg(F.max("t")).scalar()
    place = F.col("t") + (F.col("symbol") > "Brand#3").cast("int") * 0.5  # the later half of a close's symbols
    parts = [rows.where(place <= F.floor(last * 0.4)), rows.where((place > F.floor(last * 0.4)) & (place <= F.floor(last * 0.7))), rows.where(place > F.floor(last * 0.7))]
    return [*parts[:2], parts[2].unionByName(rows.where("t < 50"))]


@query("ts_init:t n_bars:i complete:b", BRAND + """, c AS (SELECT ts_init, count(*) AS n_bars, row_number() OVER (ORDER BY ts_init) - 1 AS t, count(*) OVER () AS n FROM bars GROUP BY 1)
SELECT ts_init, n_bars, t % 3 <> 2 AS complete FROM c WHERE t % 3 <> 2 OR t < n - 1""")
def stream_settled_closes(spark, sf):
    """Closes settled by their count or by a later close, over batches that cut closes, with bars that never or too late come."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    root = arriving(spark, calendar_parts(spark, sf, 1), lambda bars, root: into_files(live.settled_closes(bars), root))
    return spark.read.parquet(f"{root}/out")


_LIVE = BRAND + """, c AS (SELECT ts_init, row_number() OVER (ORDER BY ts_init) - 1 AS t FROM (SELECT DISTINCT ts_init FROM bars)),
r AS (SELECT symbol, ts_init, close, t, close / lag(close) OVER w - 1 AS ret FROM bars JOIN c USING (ts_init) WINDOW w AS (PARTITION BY symbol ORDER BY ts_init)),
m AS (SELECT *, lag(close, 5) OVER w / lag(close, 65) OVER w - 1 AS mom, CASE WHEN t < 20 THEN 0.2 ELSE stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY ts_init ROWS 19 PRECEDING) * sqrt(252) END AS v
 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts_init)),
cuts AS (SELECT t, quantile_cont(mom, 0.75) AS hi, quantile_cont(mom, 0.25) AS lo FROM m WHERE t >= 65 AND (t - 65) % 7 = 0 AND (t % 3 <> 2 OR t < (SELECT max(t) FROM c)) GROUP BY t HAVING count(mom) >= 2)
SELECT symbol, ts_init, coalesce(CASE WHEN mom >= hi THEN least(0.1 / greatest(v, 1e-6), 2) WHEN mom <= lo THEN -least(0.1 / greatest(v, 1e-6), 2) ELSE 0 END, 0) AS target FROM m JOIN cuts USING (t)"""


@query("symbol:s ts_init:t target:6", _LIVE)
def stream_live_xs_momentum(spark, sf):
    """Cross-sectional targets of a bar stream: scores by symbol, then ranks by close."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    follow = lambda bars, root: into_files(live.live_xs_momentum(bars, 60, 5, vol_lookback=20, rebal_freq=7), root)
    root = arriving(spark, calendar_parts(spark, sf, 1), follow)
    return spark.read.parquet(f"{root}/out")
