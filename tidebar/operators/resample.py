"""Ticks to bars and bars to longer bars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(ts: str, seconds: int) -> Column:
    """Start of the *seconds*-long interval holding *ts*."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / F.lit(seconds)) * F.lit(seconds))


def moment_of(ticks: DataFrame, ties: list[str]) -> Column:
    """Order of ticks: time, then *ties*.

    With one whole-number tie, both fit one decimal. A fixed-width key lets the
    aggregation hash instead of sorting every tick, which a struct key would force.
    """
    if len(ties) == 1 and dict(ticks.dtypes)[ties[0]] in ("bigint", "int"):
        wide = F.lit(Decimal(2 * 10**19)).cast("decimal(20,0)")
        return F.unix_micros("ts").cast("decimal(18,0)") * wide + F.col(ties[0]).cast("decimal(19,0)")
    return F.struct("ts", *ties)


def tick_to_bar(ticks: DataFrame, seconds: int, ties: list[str]) -> DataFrame:
    """Bars of ``symbol, ts, price, size`` ticks; *ties* order ticks of one instant. A tick without a price only adds its size."""
    moment = F.when(F.col("price").isNotNull(), moment_of(ticks, ties))
    start = bucket("ts", seconds)
    return (
        ticks.groupBy("symbol", start.alias("ts_event"))
        .agg(
            F.min_by("price", moment).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", moment).alias("close"),
            F.sum("size").alias("volume"),
        )
        .withColumn("ts_init", F.col("ts_event") + F.expr(f"INTERVAL {seconds} SECONDS"))
    )


def resample_bars(bars: DataFrame, seconds: int) -> DataFrame:
    """Longer bars from shorter ones of the same symbol."""
    start = bucket("ts_event", seconds)
    return (
        bars.groupBy("symbol", start.alias("bucket"))
        .agg(
            F.min_by("open", "ts_event").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts_event").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "ts_event")
        .withColumn("ts_init", F.col("ts_event") + F.expr(f"INTERVAL {seconds} SECONDS"))
    )
