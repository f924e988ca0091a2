"""Explicit schemas of the logical tables, and the bar specifications."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(38, 16)

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("venue", T.StringType(), False),
        T.StructField("schema", T.StringType(), False),
        T.StructField("ts_event", T.TimestampType(), False),
        T.StructField("ts_init", T.TimestampType(), False),
        T.StructField("open", PRICE),
        T.StructField("high", PRICE),
        T.StructField("low", PRICE),
        T.StructField("close", PRICE),
        T.StructField("volume", PRICE),
    ]
)

TICKS = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("schema", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("price", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
    ]
)

SPANS = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("d0", T.DateType(), False),
        T.StructField("d1", T.DateType(), False),
        T.StructField("raw_symbol", T.StringType(), False),
    ]
)

INSTRUMENTS = T.StructType(
    [
        T.StructField("instrument_id", T.StringType(), False),
        T.StructField("raw_symbol", T.StringType(), False),
        T.StructField("venue", T.StringType(), False),
        T.StructField("underlying", T.StringType()),
        T.StructField("activation", T.TimestampType()),
        T.StructField("expiry", T.TimestampType()),
        T.StructField("multiplier", T.DoubleType()),
        T.StructField("tick", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("ts_init", T.TimestampType(), False),
    ]
)

OPTION_BARS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("underlying", T.StringType()),
        T.StructField("right", T.StringType()),
        T.StructField("strike", T.DoubleType()),
        T.StructField("expiry", T.DateType()),
        T.StructField("days_to_expiry", T.IntegerType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

RETURNS = T.StructType(
    [
        T.StructField("study", T.StringType(), False),
        T.StructField("trial", T.LongType(), False),
        T.StructField("fold", T.IntegerType()),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("ret", T.DoubleType()),
    ]
)

# Seconds per bar of each bar schema.
STEP_SECONDS = {"ohlcv-1s": 1, "ohlcv-1m": 60, "ohlcv-1h": 3600, "ohlcv-1d": 86400}

TRADING_DAYS = 252
