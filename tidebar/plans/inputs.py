"""Logical inputs built from the given tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import Axis
from ..operators.resample import tick_to_bar

HOURLY = Axis(step=3600)
DAY = 86_400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def line_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as trades of a part brand."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    line = table(spark, sf, "lineitem").select(
        *_LINE, F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"),
    )
    return line.join(part, line.l_partkey == part.p_partkey).drop("p_partkey")


def brand_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of the 25 brands: the ragged cross-section."""
    return tick_to_bar(line_ticks(spark, sf), DAY, _LINE)


def region_ticks(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    supplier = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("r_name").alias("symbol")
    )
    line = table(spark, sf, "lineitem").select(
        *_LINE, "l_linestatus", F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"),
    )
    return line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")


def region_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of the five supplier regions: nearly dense."""
    return tick_to_bar(region_ticks(spark, sf), DAY, _LINE)


def order_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of the five order priorities."""
    ticks = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("price"), F.lit(1.0).alias("size"), "o_orderkey",
    )
    return tick_to_bar(ticks, DAY, ["o_orderkey"])


def event_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id",
    )


def event_bars(spark: SparkSession, sf: str, seconds: int = 3600) -> DataFrame:
    """Bars of the event types; hourly unless stated otherwise."""
    return tick_to_bar(event_ticks(spark, sf), seconds, ["event_id"])


def _sql_bars(ticks: str, bucket: str, keys: str, name: str) -> str:
    return f"""{name}_ticks AS ({ticks}),
{name} AS (SELECT symbol, time_bucket(INTERVAL {bucket}, ts) AS ts_event,
  time_bucket(INTERVAL {bucket}, ts) + INTERVAL {bucket} AS ts_init,
  arg_min(price, row(ts, {keys})) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row(ts, {keys})) AS close, sum(size) AS volume
  FROM {name}_ticks GROUP BY 1, 2, 3)"""


_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
BRAND = "WITH RECURSIVE " + _sql_bars(
    f"SELECT p_brand AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size, {_K} "
    "FROM lineitem JOIN part ON l_partkey = p_partkey", "1 DAY", _K, "bars")
REGION = "WITH RECURSIVE " + _sql_bars(
    f"SELECT r_name AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size, l_linestatus, {_K} "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey", "1 DAY", _K, "bars")
ORDERS = "WITH RECURSIVE " + _sql_bars(
    "SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS price, 1.0::DOUBLE AS size, o_orderkey FROM orders",
    "1 DAY", "o_orderkey", "bars")
_EVENTS = "SELECT event_type AS symbol, ts, value AS price, 1.0::DOUBLE AS size, event_id FROM events"
EVENTS = "WITH RECURSIVE " + _sql_bars(_EVENTS, "1 HOUR", "event_id", "bars")
EVENTS_15M = "WITH RECURSIVE " + _sql_bars(_EVENTS, "15 MINUTE", "event_id", "bars")
EVENTS_1M = "WITH RECURSIVE " + _sql_bars(_EVENTS, "1 MINUTE", "event_id", "bars")
