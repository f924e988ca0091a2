"""Sweeps of declared strategies: one scan for all trials.

A rule names the indicators that a set of parameters needs and says how targets come from them. The indicators of all trials are
computed together, each once a bar; trials are exploded from an array that picks each one's indicators and carries its
parameters as columns; what follows runs once, keyed by trial. The plan has as many scans and exchanges for a thousand trials as for one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import TRADING_DAYS
from .ordered import DAILY, Axis, last_n, over_rows, row_index, running
from .panel import align_union, last_bars
from .strategies import finite
from .volatility import _rolling, pct_change

ANNUAL = TRADING_DAYS**0.5


@dataclass(frozen=True)
class Indicator:
    """A column over the rows of a symbol that reaches *before* rows back; ``__r`` is the bar return."""

    name: str
    before: int
    column: Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Rule:
    """A strategy as declared: defaults, the indicators by role, and targets of rows that carry roles and parameters as columns."""

    defaults: dict[str, float]
    indicators: Callable[[dict], dict[str, Indicator]]
    targets: Callable[[DataFrame, Axis], Column | DataFrame]
    across: bool = False  # ranks symbols: runs on the panel of all closes


def past(lookback: int, skip: int) -> Indicator:
    def column(w: WindowSpec) -> Column:
        recent = F.lag("close", skip).over(w) if skip else F.col("close")
        return F.try_divide(recent, F.lag("close", skip + lookback).over(w)) - 1

    return Indicator(f"past_{lookback}_{skip}", lookback + skip, column)


def sample_vol(n: int) -> Indicator:
    return Indicator(f"vol_{n}", n + 1, lambda w: _rolling(F.stddev_samp, "__r", w, n) * ANNUAL)


def panel_vol(n: int) -> Indicator:
    return Indicator(f"panel_vol_{n}", n + 1, lambda w: F.when(F.col("t") < n, F.lit(0.20)).otherwise(F.stddev_pop("__r").over(last_n(w, n)) * ANNUAL))


def _size() -> Column:
    return F.when(F.col("vol").isNotNull(), F.least(F.col("vol_target") / F.greatest("vol", F.lit(1e-6)), F.col("max_leverage")))


def _held_in_blocks(rows: DataFrame, axis: Axis) -> DataFrame:
    """The first known value of each block of ``rebal_freq`` rows stands to its end."""
    rows = rows.withColumn("__raw", F.signum("past") * _size()).withColumn("__blk", F.floor(F.col("__i") / F.col("rebal_freq")))
    w = Window.partitionBy(*axis.keys, "__blk").orderBy(axis.order, *axis.ties).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("target", F.coalesce(F.first("__raw", ignorenulls=True).over(w), F.lit(0.0)))


def _ranked(rows: DataFrame, axis: Axis) -> DataFrame:
    """Long the top and short the bottom quantile at each trial's own rebalances."""
    since = F.col("t") - F.col("lookback") - F.col("skip_recent")
    at = [k for k in axis.keys if k != "symbol"] + ["t"]
    due = rows.where((since >= 0) & (since % F.col("rebal_freq") == 0) & F.col("past").isNotNull())
    scores = due.groupBy(*at).agg(
        F.array_sort(F.collect_list("past")).alias("__s"), F.first(1 - F.col("top_quantile")).alias("__top"), F.first("bottom_quantile").alias("__bottom")
    ).where(F.size("__s") >= 2)  # one number a symbol

    def quantile(q: Column) -> Column:
        place = q * (F.size("__s") - 1)
        low, high = F.get("__s", F.floor(place).cast("int")), F.get("__s", F.ceil(place).cast("int"))
        return low + (place - F.floor(place)) * (high - low)

    cuts = scores.select(*at, quantile(F.col("__top")).alias("__hi"), quantile(F.col("__bottom")).alias("__lo"))
    joined = rows.join(cuts, at, "left")
    pick = F.when(F.col("past") >= F.col("__hi"), _size()).when(F.col("past") <= F.col("__lo"), -_size()).otherwise(F.lit(0.0))
    joined = joined.withColumn("__new", F.when(F.col("__hi").isNotNull(), F.coalesce(pick, F.lit(0.0))))
    return running(joined, axis, {"__h": ("last", "__new")}).withColumn("target", F.coalesce("__h", F.lit(0.0)))


TS_MOMENTUM = Rule(
    dict(lookback=252, skip_recent=0, vol_target=0.10, vol_lookback=63, max_leverage=2.0, rebal_freq=1),
    lambda p: {"past": past(p["lookback"], p["skip_recent"]), "vol": sample_vol(p["vol_lookback"])}, _held_in_blocks,
)
XS_MOMENTUM = Rule(
    dict(lookback=252, skip_recent=21, top_quantile=0.25, bottom_quantile=0.25, vol_target=0.10, vol_lookback=63, max_leverage=2.0, rebal_freq=21),
    lambda p: {"past": past(p["lookback"], p["skip_recent"]), "vol": panel_vol(p["vol_lookback"])}, _ranked, across=True,
)


def _gone(bars: DataFrame, axis: Axis) -> DataFrame:
    """Flag the final bar of symbols that stop trading while others go on."""
    ends = bars.groupBy("symbol").agg(F.max(axis.order).alias("e"))
    horizon, several = ends.agg(F.max("e")).scalar(), ends.agg(F.count("*") >= 2).scalar()
    return last_bars(bars, axis).withColumn("__gone", F.col("is_last") & (F.col(axis.order) < horizon) & several).drop("is_last")


def rule_targets(bars: DataFrame, rule: Rule, grid: list[dict], axis: Axis = DAILY) -> DataFrame:
    """``trial, symbol, ts_init, close, target`` of every set of parameters in *grid* under one rule."""
    sets = [rule.defaults | p for p in grid]
    roles = [rule.indicators(p) for p in sets]
    needed = {i.name: i for r in roles for i in r.values()}
    rows = _gone(bars, axis)
    rows = align_union(rows, axis) if rule.across else row_index(rows, axis, "__i")

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("__r", pct_change("close", w)).withColumns({name: i.column(w) for name, i in needed.items()})

    rows = over_rows(rows, axis, build, before=max(i.before for i in needed.values()))
    kept = [*axis.keys, axis.order, "close", "__gone", *(["t", "real"] if rule.across else ["__i"])]
    trials = [
        F.struct(F.lit(n).cast("long").alias("trial"), *[F.col(i.name).alias(role) for role, i in r.items()], *[F.lit(v).alias(k) for k, v in p.items()])
        for n, (p, r) in enumerate(zip(sets, roles))
    ]
    each = rows.select(*kept, F.explode(F.array(*trials)).alias("p")).select(*kept, "p.*")
    found = rule.targets(each, axis.within("trial"))
    if rule.across:
        found = found.where("real")
    target = F.when(F.col("__gone"), F.lit(0.0)).otherwise(finite(F.col("target")))
    return found.select("trial", *axis.keys, axis.order, "close", (target if rule.across else finite(F.col("target"))).alias("target"))
