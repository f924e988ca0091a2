"""Incremental bars and targets with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..sources import committed


def tick_to_bar_stream(ticks: DataFrame, seconds: int, late: str, ties: list[str]) -> DataFrame:
    """Bars of a tick stream, each emitted once the watermark has passed its close. A tick without a price only adds its size."""
    moment = F.when(F.col("price").isNotNull(), F.struct("ts", *ties))
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "symbol")
        .agg(
            F.min_by("price", moment).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", moment).alias("close"), F.sum("size").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts_event"), F.col("w.end").alias("ts_init"), "open", "high", "low", "close", "volume")
    )


def resample_stream(bars: DataFrame, seconds: int, late: str) -> DataFrame:
    """Longer bars of a bar stream."""
    return (
        bars.withWatermark("ts_event", late)
        .groupBy(F.window("ts_event", f"{seconds} seconds").alias("w"), "symbol")
        .agg(
            F.min_by("open", "ts_event").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts_event").alias("close"), F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts_event"), F.col("w.end").alias("ts_init"), "open", "high", "low", "close", "volume")
    )


def complete_batches(bars: DataFrame, late: str) -> DataFrame:
    """One row per close once no more bars of it can arrive."""
    return (
        bars.withWatermark("ts_init", late).groupBy(F.window("ts_init", "1 second").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_bars"))
        .select(F.col("w.start").alias("ts_init"), "n_bars")
    )


def stream_append_bars(bars: DataFrame, path: str, checkpoint: str):
    """Append a bar stream to a committed store under the batch coverage rule.

    Duplicates inside a batch are removed first. The log knows every batch of a checkpoint by its number, so one that is
    replayed after a failure adds nothing, and coverage is the log's, so no stored bar is read.
    """
    def sink(batch: DataFrame, number: int) -> None:
        committed.append(batch.dropDuplicates(["symbol", "venue", "schema", "ts_init"]), path, f"{checkpoint}#{number}")

    return bars.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_tail_targets(bars: DataFrame, path: str, strategy: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None],
                        checkpoint: str, tail_days: int):
    """Targets per micro-batch, single- or cross-sectional, over the tail of a store that grows with every batch.

    Each batch is stored under its number first, so the next one sees it; a batch that is replayed after a failure replaces
    itself. The strategy runs on the stored bars of the last *tail_days* before the batch, which must cover its lookback, and
    its targets for the batch's own bars go to ``write(targets, batch number)``.
    """
    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.dropDuplicates(["symbol", "ts_init"]).write.mode("overwrite").parquet(f"{path}/batch={number}")
        new = spark.read.schema(bars.schema).parquet(f"{path}/batch={number}")
        span = new.agg(F.min("ts_init").alias("a"), F.max("ts_init").alias("b")).first()
        if span["a"] is None:
            return
        known = spark.read.schema(bars.schema).parquet(path).select(*bars.columns)
        tail = known.where(F.col("ts_init").between(F.lit(span["a"]) - F.expr(f"INTERVAL {tail_days} DAYS"), F.lit(span["b"])))
        write(strategy(tail).join(new.select("symbol", "ts_init"), ["symbol", "ts_init"], "left_semi"), number)

    return bars.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TrendTargets(StatefulProcessor):
    """Per-symbol trend target over a bounded buffer of the latest closes."""

    def __init__(self, fast: int = 20, slow: int = 60, vol_target: float = 0.10, vol_lookback: int = 20):
        self.fast, self.slow, self.vol_target, self.vol_lookback = fast, slow, vol_target, vol_lookback
        self.keep = max(slow, fast, vol_lookback + 1)

    def init(self, handle) -> None:
        schema = T.StructType([T.StructField("closes", T.ArrayType(T.DoubleType())), T.StructField("last", T.LongType())])
        self.state = handle.getValueState("tail", schema)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        closes, last = self.state.get() if self.state.exists() else ([], None)
        closes = list(closes or [])
        out = []
        frame = pd.concat(list(rows)).sort_values("ts_init")
        for ts, close in zip(frame["ts_init"], frame["close"]):
            if last is not None and ts.value <= last:
                continue  # inside coverage already
            closes = (closes + [float(close)])[-self.keep :]
            last = ts.value
            out.append((key[0], ts, self._target(closes)))
        self.state.update((closes, last))
        yield pd.DataFrame(out, columns=["symbol", "ts_init", "target"])

    def _target(self, closes: list[float]) -> float:
        import numpy as np

        c = np.asarray(closes)
        if len(c) < max(self.slow, self.fast) or len(c) < self.vol_lookback + 1:
            return 0.0
        ret = c[1:] / c[:-1] - 1.0
        vol = ret[-self.vol_lookback :].std(ddof=1) * 252**0.5
        side = np.sign(c[-self.fast :].mean() - c[-self.slow :].mean())
        return float(side * min(self.vol_target / max(vol, 1e-6), 5.0))

    def close(self) -> None:
        pass


def live_targets(bars: DataFrame, processor: StatefulProcessor | None = None) -> DataFrame:
    """Targets of a bar stream, one per new bar, from a bounded per-symbol state."""
    return bars.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=processor or TrendTargets(),
        outputStructType="symbol string, ts_init timestamp, target double",
        outputMode="Append", timeMode="None",
    )
