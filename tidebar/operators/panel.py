"""Calendars and the union-aligned panel of a ragged universe."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import DAILY, Axis, over_rows, row_index


def calendar(bars: DataFrame, axis: Axis = DAILY, name: str = "t") -> DataFrame:
    """Distinct closes of the universe, numbered from zero."""
    return row_index(bars.select(axis.order).distinct(), replace(axis, keys=(), ties=()), name)


def small_calendar(days: DataFrame, axis: Axis) -> DataFrame:
    """Broadcast a table with one row per close where the bar length bounds its size."""
    return F.broadcast(days) if axis.bounded else days


def common_calendar(bars: DataFrame) -> DataFrame:
    """Closes at which every symbol has a bar."""
    symbols = bars.agg(F.count_distinct("symbol").alias("n")).scalar()
    return (
        bars.groupBy("ts_init")
        .agg(F.count_distinct("symbol").alias("n_symbols"))
        .where(F.col("n_symbols") == symbols)
    )


def universe_size(bars: DataFrame) -> DataFrame:
    """Symbols with a bar at each close (also the bars a close's batch waits for)."""
    return bars.groupBy("ts_init").agg(F.count(F.lit(1)).alias("n_bars"))


def align_union(bars: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Every symbol on every close of the universe within its own first and last bar.

    Each bar is stretched over the closes up to the symbol's next bar, which fills
    the gaps forward without a calendar-by-symbol product. Adds ``t`` (calendar
    position) and ``real`` (false for a filled row, whose volume is zero).
    """
    days = small_calendar(calendar(bars, axis), axis)
    placed = bars.join(days, axis.order)
    placed = over_rows(
        placed, axis, lambda df, w: df.withColumn("__next", F.lead("t").over(w)), after=1
    )
    until = F.coalesce(F.col("__next") - 1, F.col("t"))
    slots = placed.withColumn("slot", F.explode(F.sequence("t", until)))
    slots = slots.withColumn("real", F.col("slot") == F.col("t")).withColumn(
        "volume", F.when(F.col("real"), F.col("volume")).otherwise(F.lit(0.0))
    )
    return (
        slots.drop(axis.order, "t", "__next")
        .withColumnRenamed("slot", "t")
        .join(days, "t")
    )


def last_bars(bars: DataFrame, axis: Axis = DAILY, out: str = "is_last") -> DataFrame:
    """Flag each symbol's final bar."""
    return over_rows(
        bars, axis, lambda df, w: df.withColumn(out, F.lead(axis.order).over(w).isNull()), after=1
    )


def exit_delisted(targets: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Zero targets on the final bar of symbols that stop trading while others go on."""
    ends = targets.groupBy("symbol").agg(F.max(axis.order).alias("e"))
    horizon = ends.agg(F.max("e").alias("h")).scalar()
    several = ends.agg((F.count(F.lit(1)) >= 2).alias("m")).scalar()
    gone = F.col("is_last") & (F.col(axis.order) < horizon) & several
    return (
        last_bars(targets, axis)
        .withColumn("target", F.when(gone, F.lit(0.0)).otherwise(F.col("target")))
        .drop("is_last")
    )


def data_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.min("ts_init").alias("first"),
        F.max("ts_init").alias("last"),
        F.count(F.lit(1)).alias("bars"),
        F.count_if(F.col("volume") <= 0).alias("zero_volume"),
    )


def merge_disjoint(*datasets: DataFrame) -> DataFrame:
    """Union of datasets whose symbols do not overlap; a shared symbol fails the job."""
    tagged = [d.withColumn("__part", F.lit(i)) for i, d in enumerate(datasets)]
    merged = tagged[0]
    for d in tagged[1:]:
        merged = merged.unionByName(d, allowMissingColumns=True)
    owners = merged.groupBy("symbol").agg(F.count_distinct("__part").alias("__n"))
    clash = owners.where("__n > 1").agg(F.min("symbol").alias("s")).scalar()
    ok = F.when(clash.isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("symbol in more than one dataset: "), clash)).cast("boolean")
    )
    return merged.where(ok).drop("__part")


def select_symbols(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    return bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def signal_window(bars: DataFrame, end) -> DataFrame:
    """What a signal may see: everything up to *end*."""
    return bars.where(F.col("ts_init") <= F.lit(end))


def replay_window(bars: DataFrame, start, end) -> DataFrame:
    return bars.where(F.col("ts_init").between(F.lit(start), F.lit(end)))


def missing_symbols(configured: DataFrame, bars: DataFrame) -> DataFrame:
    return configured.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")
