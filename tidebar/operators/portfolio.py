"""Portfolio accounting in weight space: weights, returns, costs, equity, trades."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import DAILY, Axis, over_rows, running
from .volatility import pct_change


@dataclass(frozen=True)
class Costs:
    """Trading costs: a rate on notional or an amount per contract, plus expected slippage."""

    rate: float = 0.0
    per_contract: float = 0.0
    slippage_prob: float = 0.0

    def __post_init__(self):
        if self.rate and self.per_contract:
            raise ValueError("state costs as a rate or per contract, not both")
        if not 0.0 <= self.slippage_prob <= 1.0:
            raise ValueError("slippage_prob must be in [0, 1]")

    def unit(self, close: Column, multiplier: Column, tick: Column) -> Column:
        """Cost per unit of weight traded, as a fraction of equity."""
        per_unit = F.try_divide(F.lit(self.per_contract), close * multiplier) + F.try_divide(self.slippage_prob * tick, close)
        return F.lit(self.rate) + F.coalesce(per_unit, F.lit(0.0))


def weighted_targets(targets: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weight of each symbol: target x 1/N, or x an explicit weight per symbol."""
    if weights is None:
        names = targets.agg(F.count_distinct("symbol").alias("n")).scalar()
        return targets.withColumn("w", F.col("target") / names)
    return (
        targets.join(weights.select("symbol", "weight"), "symbol")
        .withColumn("w", F.col("target") * F.col("weight"))
        .drop("weight")
    )


def position_returns(weighted: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Add the bar return, the weight carried into the bar and what it earned."""

    def build(df, w):
        return df.withColumns(
            {
                "r": F.coalesce(pct_change("close", w), F.lit(0.0)),
                "w_prev": F.coalesce(F.lag("w").over(w), F.lit(0.0)),
            }
        )

    return over_rows(weighted, axis, build, before=1).withColumn("earned", F.col("w_prev") * F.col("r"))


def portfolio_returns(weighted: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Total, long and short return of the book at every close."""
    keys = [k for k in axis.keys if k != "symbol"]
    rows = position_returns(weighted, axis)
    return rows.groupBy(*keys, axis.order).agg(
        F.sum("earned").alias("total"),
        F.sum(F.when(F.col("w_prev") > 0, F.col("earned")).otherwise(0.0)).alias("long_leg"),
        F.sum(F.when(F.col("w_prev") < 0, F.col("earned")).otherwise(0.0)).alias("short_leg"),
    )


def trading_costs(weighted: DataFrame, costs: Costs, axis: Axis = DAILY) -> DataFrame:
    """Per-row weight change and its cost as a fraction of equity.

    The traded amount is measured against the weight as it drifted with returns.
    ``multiplier`` and ``tick`` default to 1 and 0.01 where the columns are absent.
    """
    keys = [k for k in axis.keys if k != "symbol"]
    rows = position_returns(weighted, axis)
    book = Window.partitionBy(*keys, axis.order)
    multiplier = F.col("multiplier") if "multiplier" in weighted.columns else F.lit(1.0)
    tick = F.col("tick") if "tick" in weighted.columns else F.lit(0.01)
    rows = rows.withColumn("book_ret", F.sum("earned").over(book))
    drifted = F.try_divide(F.col("w_prev") * (1 + F.col("r")), 1 + F.col("book_ret"))
    return rows.withColumn("traded", F.col("w") - drifted).withColumn(
        "cost", F.abs("traded") * costs.unit(F.col("close"), multiplier, tick)
    )


def ledger(weighted: DataFrame, costs: Costs = Costs(), capital: float = 1.0, axis: Axis = DAILY) -> DataFrame:
    """Equity before and after costs at every close.

    ``equity`` is marked with the weights of the previous close less the costs paid
    there: ``E[t+1] = E[t] (1 + R[t+1] - f[t])``. Exact without costs on a common
    calendar; with costs, exact to first order in them (see ``ledger.ledger_exact``).
    """
    keys = [k for k in axis.keys if k != "symbol"]
    by_close = trading_costs(weighted, costs, axis).groupBy(*keys, axis.order).agg(
        F.sum("earned").alias("ret"), F.sum("cost").alias("fee"), F.sum(F.abs("traded")).alias("turnover")
    )
    book = axis.by(*keys)
    grown = over_rows(
        by_close, book,
        lambda df, w: df.withColumn("__g", 1 + F.col("ret") - F.coalesce(F.lag("fee").over(w), F.lit(0.0))),
        before=1,
    )
    out = running(grown, book, {"__e": ("product", "__g")})
    return (
        out.withColumn("equity", F.col("__e") * capital)
        .withColumn("equity_post", F.col("equity") * (1 - F.col("fee")))
        .drop("__g", "__e")
    )


def trades(weighted: DataFrame, costs: Costs = Costs(), axis: Axis = DAILY, rounding: float = 1e-12) -> DataFrame:
    """One row per weight change: side, size and cost.

    A weight held through a bar is compared with itself times growth over growth; differences up to *rounding* are that
    arithmetic and no trades. With 0 only exact zeros are left out.
    """
    rows = trading_costs(weighted, costs, axis).where(F.abs("traded") > rounding)
    return rows.select(
        *axis.keys, axis.order,
        F.when(F.col("traded") > 0, F.lit("BUY")).otherwise(F.lit("SELL")).alias("side"),
        F.abs("traded").alias("size"), F.col("close").alias("price"), "cost",
    )


def lots(ledger_rows: DataFrame, increment: float = 1.0) -> DataFrame:
    """Half-even lot view of weights: needs ``w``, ``equity``, ``close``, ``multiplier``."""
    units = F.try_divide(F.col("w") * F.col("equity"), F.col("close") * F.col("multiplier")) / increment
    return ledger_rows.withColumn("lots", F.rint(units) * increment)


def turnover(traded: DataFrame, keys: list[str], years: float | Column) -> DataFrame:
    """Traded weight per year."""
    return traded.groupBy(*keys).agg((F.sum("size") / years).alias("turnover"))


def roll_events(weighted: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Closes at which a held symbol's active contract changes."""
    rows = over_rows(
        weighted, axis,
        lambda df, w: df.withColumns({"old": F.lag("instrument_id").over(w), "__h": F.lag("w").over(w)}),
        before=1,
    )
    return rows.where((F.col("old") != F.col("instrument_id")) & (F.col("__h") != 0)).select(
        *axis.keys, F.col(axis.order).alias("ts"), "old", F.col("instrument_id").alias("new")
    )


def calendar_fill(equity: DataFrame, capital: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Calendar-day returns of a post-cost equity path, labelled with their first day.

    Days without a close repeat the last equity; the first day's base is *capital*.
    """
    day = F.to_date("ts_init")
    daily = equity.groupBy(*keys, day.alias("d")).agg(F.max_by("equity_post", "ts_init").alias("e"))
    w = Window.partitionBy(*keys).orderBy("d")
    spans = daily.withColumns(
        {
            "nxt": F.lead("d").over(w),
            "nxt_e": F.lead("e").over(w),
            "base": F.when(F.row_number().over(w) == 1, F.lit(capital)).otherwise(F.col("e")),
        }
    ).where("nxt IS NOT NULL")
    # Between two closes only the last day changes the equity, and after a first
    # day whose base is the capital, the day after it.
    days = spans.withColumn("ts", F.explode(F.expr("sequence(d, date_sub(nxt, 1))")))
    start = F.when(F.col("ts") == F.col("d"), F.col("base")).otherwise(F.col("e"))
    end = F.when(F.date_add("ts", 1) == F.col("nxt"), F.col("nxt_e")).otherwise(F.col("e"))
    return days.select(*keys, F.col("ts").cast("timestamp").alias("ts"), (F.try_divide(end, start) - 1).alias("ret"))
