"""Bar cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import DAILY, Axis, over_rows


def repair_prices(bars: DataFrame) -> DataFrame:
    """Keep bars that closed above zero, with open, high and low made consistent with the close."""
    opened = F.when(F.col("open") <= 0, F.col("close")).otherwise(F.col("open"))
    return (
        bars.where(F.col("close") > 0)
        .withColumn("open", opened)
        .withColumn("high", F.greatest("high", "open", "close"))
        .withColumn(
            "low", F.when(F.col("low") <= 0, F.least("open", "close")).otherwise(F.col("low"))
        )
    )


def drop_scale_glitches(bars: DataFrame, factor: float = 3.0, axis: Axis = DAILY) -> DataFrame:
    """Drop a bar whose close is off by more than *factor* from both neighbours."""

    def build(df, w):
        df = df.withColumns({"__p": F.lag("close").over(w), "__n": F.lead("close").over(w)})
        c = F.col("close")
        above = (c > F.col("__p") * factor) & (c > F.col("__n") * factor)
        below = (c < F.col("__p") / factor) & (c < F.col("__n") / factor)
        return df.withColumn("__bad", F.coalesce(above | below, F.lit(False)))

    return over_rows(bars, axis, build, before=1, after=1).where(~F.col("__bad")).drop("__p", "__n", "__bad")


def weekday_filter(bars: DataFrame) -> DataFrame:
    """Keep bars that open on Monday to Friday."""
    return bars.where(F.weekday("ts_event") < 5)


def drop_untraded(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("volume") > 0)


def midnight_sessions(bars: DataFrame) -> DataFrame:
    """Daily bars stamped at 00:00 UTC of their session date."""
    return bars.withColumn("ts_event", F.date_trunc("day", "ts_event")).withColumn(
        "ts_init", F.col("ts_event") + F.expr("INTERVAL 1 DAY")
    )


def null_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """Store missing values as null, never NaN."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
