"""Global order without one task: neighbouring rows in numbered blocks, and places in an order within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

ROWS = 1 << 17


def in_blocks(df: DataFrame, *order: str, rows: int = ROWS) -> DataFrame:
    """``df``, which should be stored, with ``block``: all rows of a block come before those of the next one in the order of ``order``.

    Spark takes the borders from a sample, so the numbers are fixed by writing them. Rows alike in ``order`` can lie in one block only.
    """
    width = partitions(df.sparkSession, df.count(), rows)
    return stored(df.repartitionByRange(width, *order).withColumn("block", F.spark_partition_id()), "blocks")


def numbered(df: DataFrame, group: str, *order: str, rows: int = ROWS) -> DataFrame:
    """Add ``at``, the place from 0 in the order of ``order`` among the rows of ``group`` (not null), and their number ``total``.

    A group may hold all rows: each block counts its own, and the blocks before it are summed. Ties are placed in any order.
    """
    placed = in_blocks(df, group, *order, rows=rows)
    sizes = placed.groupBy(group, "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({
        "before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(group)),
    }).drop("n")
    within = F.row_number().over(Window.partitionBy(group, "block").orderBy(*order))
    return placed.join(sizes, [group, "block"]).withColumn("at", F.col("before") + within - 1).drop("block", "before")
