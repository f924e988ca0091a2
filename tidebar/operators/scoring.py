"""Forecast scoring: CRPS, PIT, calibration and interval coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import cdf, pdf
from .ordered import range_blocks


def crps_gaussian(df: DataFrame, obs: str = "obs", mean: str = "mean", std: str = "std", out: str = "crps") -> DataFrame:
    df = df.withColumn("__z", F.when(F.col(std) > 0, (F.col(obs) - F.col(mean)) / F.col(std)))
    score = F.col(std) * (F.col("__z") * (2 * cdf("__z") - 1) + 2 * pdf("__z") - 1 / F.sqrt(F.pi()))
    return df.withColumn(out, F.when(F.col(std) > 0, score).otherwise(F.abs(F.col(obs) - F.col(mean)))).drop("__z")


def crps_ensemble(samples: DataFrame, keys: list[str]) -> DataFrame:
    """CRPS of ``obs`` under the draws of each observation (``draw`` column).

    Mean absolute error less half the mean absolute difference between draws. The
    second term comes from sorted draws, so no draw is paired with another.
    """
    w = Window.partitionBy(*keys)
    ranked = samples.withColumns(
        {"__i": F.row_number().over(w.orderBy("draw")), "__m": F.count(F.lit(1)).over(w)}
    )
    m = F.max("__m")
    spread = F.sum((2 * F.col("__i") - F.col("__m") - 1) * F.col("draw")) / (m * m)
    return ranked.groupBy(*keys).agg((F.avg(F.abs(F.col("draw") - F.col("obs"))) - spread).alias("crps"))


def pit_values(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Share of draws at or below the observation."""
    return samples.groupBy(*keys).agg(F.avg((F.col("draw") <= F.col("obs")).cast("double")).alias("pit"))


def calibration_error(pit: DataFrame, column: str = "pit") -> DataFrame:
    """Largest gap between the values' distribution and the uniform one.

    Equal values are counted first; the running count is taken within blocks of neighbouring values, whose borders
    come from a sample of them, so values may crowd anywhere and no task orders all.
    """
    distinct = pit.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("u")).agg(F.count(F.lit(1)).alias("c"))
    placed = range_blocks(distinct, "u")
    per_block = placed.groupBy("__block").agg(F.sum("c").alias("n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a shuffle partition
    base = per_block.select("__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = per_block.agg(F.sum("n").alias("n")).scalar()
    inner = Window.partitionBy("__block").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("c").over(inner)).join(F.broadcast(base), "__block")  # one row a shuffle partition
    upto = F.col("base") + F.col("upto")
    gap = F.greatest(upto / total - F.col("u"), F.col("u") - (upto - F.col("c")) / total)
    return placed.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("calibration_error"))


def coverage(df: DataFrame, obs: str = "obs", lower: str = "lower", upper: str = "upper") -> DataFrame:
    return df.agg(F.avg(F.col(obs).between(F.col(lower), F.col(upper)).cast("double")).alias("coverage"))
