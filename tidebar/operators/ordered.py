"""Ordered computation over long series without unbounded groups.

A bar series has at most one bar per interval, so the rows of one key are bounded
by the length of recorded history over the bar length. For hourly and daily bars
that bound is small and a plain ``partitionBy(key).orderBy(ts)`` window is right.
For minute and second bars one key can hold a large share of the whole table, so
the same computation is cut along time:

* a frame of fixed length runs over blocks of consecutive rows, each block also
  receiving the few rows before (and after) it that its frames reach into;
* a running total, product, maximum or last value is computed per block, carried
  across the (few) blocks of a key, and combined with the running value inside
  the block.

Callers state the key columns, the order column and the bar length in an ``Axis``
and get the right plan for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import store_once

HISTORY_SECONDS = 100 * 366 * 86_400


@dataclass(frozen=True)
class Axis:
    """How the rows of a long table are keyed and ordered."""

    keys: tuple[str, ...] = ("symbol",)
    order: str = "ts_init"
    step: int = 86_400
    ties: tuple[str, ...] = ()
    max_rows: int = 1 << 20
    block_rows: int = 1 << 16

    @property
    def bounded(self) -> bool:
        return HISTORY_SECONDS // max(self.step, 1) <= self.max_rows

    def by(self, *keys: str) -> Axis:
        return replace(self, keys=tuple(keys))

    def within(self, *keys: str) -> Axis:
        """The same axis with more key columns in front."""
        return replace(self, keys=(*keys, *self.keys))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order, *self.ties)

    def chunk(self) -> Column:
        """Time bucket that holds at most ``block_rows`` bars of one key."""
        width = max(self.step, 1) * self.block_rows
        return F.floor(F.unix_seconds(self.order) / F.lit(width))


DAILY = Axis()


def row_index(df: DataFrame, axis: Axis, name: str = "row_idx") -> DataFrame:
    """Zero-based position of each row within its key."""
    if axis.bounded:
        return df.withColumn(name, F.row_number().over(axis.window()).cast("long") - 1)
    keys = [*axis.keys, "__chunk"]
    df = df.withColumn("__chunk", axis.chunk())
    before = Window.partitionBy(*axis.keys).orderBy("__chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(axis.order, *axis.ties)) - 1
    return (
        df.withColumn("__local", local)
        .join(base, keys)
        .withColumn(name, (F.col("__base") + F.col("__local")).cast("long"))
        .drop("__chunk", "__local", "__base")
    )


def over_rows(
    df: DataFrame,
    axis: Axis,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Apply *build* (frames reaching at most *before* / *after* rows) along *axis*."""
    if axis.bounded:
        return build(df, axis.window())
    size = max(axis.block_rows, before + after + 1)
    indexed = row_index(df, axis, "__idx")
    home = F.floor(F.col("__idx") / size)
    offset = F.col("__idx") - F.col("__home") * size
    copies = F.array(
        F.col("__home"),
        F.when(offset >= size - before, F.col("__home") + 1),
        F.when((offset < after) & (F.col("__home") > 0), F.col("__home") - 1),
    )
    spread = indexed.withColumn("__home", home).withColumn(
        "__block", F.explode(F.array_compact(copies))
    )
    blocked = Window.partitionBy(*axis.keys, "__block").orderBy(axis.order, *axis.ties)
    return build(spread, blocked).where("__block = __home").drop("__idx", "__home", "__block")


_RUNNING = {
    "sum": F.sum,
    "product": F.product,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def _join(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull() & local.isNull(), F.lit(None)).otherwise(
            F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        )
    if kind == "product":
        return F.when(carried.isNull() & local.isNull(), F.lit(None)).otherwise(
            F.coalesce(carried, F.lit(1.0)) * F.coalesce(local, F.lit(1.0))
        )
    if kind == "max":
        return F.greatest(carried, local)
    return F.coalesce(local, carried) if kind == "last" else F.coalesce(carried, local)


def running(df: DataFrame, axis: Axis, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add running values ``out -> (kind, column)``, from the first row to the current.

    Kinds: ``sum``, ``product``, ``max``, ``last`` and ``first`` (non-null).
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    if axis.bounded:
        w = axis.window().rowsBetween(*upto)
        return df.withColumns({o: _RUNNING[k](F.col(c)).over(w) for o, (k, c) in specs.items()})
    keys = [*axis.keys, "__chunk"]
    df = df.withColumn("__chunk", axis.chunk())
    order = F.struct(axis.order, *axis.ties)

    def total(kind: str, column: str) -> Column:
        if kind in ("last", "first"):
            pick = F.max_by if kind == "last" else F.min_by
            return pick(F.col(column), F.when(F.col(column).isNotNull(), order))
        return _RUNNING[kind](F.col(column))

    totals = df.groupBy(*keys).agg(*[total(k, c).alias(f"__t_{o}") for o, (k, c) in specs.items()])
    before = Window.partitionBy(*axis.keys).orderBy("__chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = totals.select(
        *keys, *[_RUNNING[k](F.col(f"__t_{o}")).over(before).alias(f"__c_{o}") for o, (k, _) in specs.items()]
    )
    w = Window.partitionBy(*keys).orderBy(axis.order, *axis.ties).rowsBetween(*upto)
    out = df.withColumns({f"__l_{o}": _RUNNING[k](F.col(c)).over(w) for o, (k, c) in specs.items()})
    out = out.join(carried, keys)
    out = out.withColumns(
        {o: _join(k, F.col(f"__c_{o}"), F.col(f"__l_{o}")) for o, (k, _) in specs.items()}
    )
    return out.drop("__chunk", *[f"__{p}_{o}" for o in specs for p in ("l", "c")])


def asof_backward(
    left: DataFrame, right: DataFrame, axis: Axis, columns: list[str], right_order: str | None = None
) -> DataFrame:
    """Attach to each left row the *columns* of the last right row at or before it.

    One pass: both sides are stacked in time order and the right side's values are
    carried forward. No range join, so the work stays linear in both inputs. Right
    rows must be unique per key and time.
    """
    hit = right.select(
        *axis.keys,
        F.col(right_order or axis.order).alias(axis.order),
        F.struct(*columns).alias("__hit"),
        F.lit(0).alias("__side"),
    )
    stacked = left.withColumn("__side", F.lit(1)).unionByName(hit, allowMissingColumns=True)
    carried = running(
        stacked, replace(axis, ties=("__side", *axis.ties)), {"__last": ("last", "__hit")}
    )
    return carried.where("__side = 1").select(
        *left.columns, *[F.col("__last")[c].alias(c) for c in columns]
    )


def range_blocks(df: DataFrame, *order: str, name: str = "__block") -> DataFrame:
    """*df* with the number of a block: all rows of a block come before those of the next one in *order*.

    Spark takes the borders from a sample of the rows, so values that crowd together share blocks as evenly as others. The
    numbers are fixed by writing them.
    """
    df, width = store_once(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store_once(df.repartitionByRange(width, *order).withColumn(name, F.spark_partition_id()))


def full(value: Column, count: Column, n: int) -> Column:
    """*value* once *n* non-null inputs are in the frame, else null."""
    return F.when(count >= n, value)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in *order*. Combines map-side, unlike a row_number."""
    payload = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col("__best")[c].alias(c) for c in payload])
