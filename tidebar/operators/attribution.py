"""Attribution of a book's gross returns and the quality of its signals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TRADING_DAYS
from .ordered import DAILY, Axis, asof_backward, over_rows, running
from .walkforward import sharpe

COMPONENTS = ["total", "long_leg", "short_leg", "market_timing", "selection", "beta_hedged"]


def attribution_series(panel: DataFrame, start=None, benchmark: DataFrame | None = None, axis: Axis = DAILY) -> DataFrame:
    """Daily components of an aligned panel with forward-filled ``target``.

    A position set at a close earns the next one. Timing is the mean live position
    times the summed live returns; selection is the rest. Without *benchmark*
    (``ts_init, bench``: its bar return) the equal-weight universe is used.
    """
    names = panel.agg(F.count_distinct("symbol").alias("n")).scalar()

    def build(df, w):
        return df.withColumns(
            {
                "__r": F.coalesce(F.try_divide(F.lead("close").over(w), F.col("close")) - 1, F.lit(0.0)),
                "__back": F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)),
            }
        )

    rows = over_rows(panel, axis, build, before=1, after=1).withColumn("__p", F.coalesce("target", F.lit(0.0)) / names)
    p, r = F.col("__p"), F.col("__r")
    # Keyed by the close the position is set at; what it earns belongs to the next.
    by_close = rows.groupBy("t").agg(
        F.max("ts_init").alias("ts_init"),
        F.sum(p * r).alias("total"),
        F.sum(F.greatest(p, F.lit(0.0)) * r).alias("long_leg"),
        F.sum(F.least(p, F.lit(0.0)) * r).alias("short_leg"),
        (F.avg(p) * F.sum(r)).alias("market_timing"),
        F.sum(p).alias("net"),
        F.sum(F.abs(p)).alias("gross"),
        F.avg("__back").alias("universe"),
    )
    series = over_rows(
        by_close, replace(axis, keys=(), ties=()),
        lambda df, w: df.withColumns({"ts": F.lead("ts_init").over(w), "bench": F.lead("universe").over(w)}), after=1,
    )
    series = series.where("ts IS NOT NULL").withColumn("selection", F.col("total") - F.col("market_timing"))
    if benchmark is not None:
        given = benchmark.select(F.col("ts_init").alias("ts"), F.col("bench"))
        series = series.drop("bench").join(given, "ts", "left").fillna(0.0, ["bench"])
    if start is not None:
        series = series.where(F.col("ts") >= start)
    return series.select("ts", "total", "long_leg", "short_leg", "market_timing", "selection", "net", "gross", "bench")


def benchmark_align(panel: DataFrame, benchmark: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Benchmark bar returns on the panel's calendar, its last close carried over gaps."""
    days = panel.select(axis.order).distinct().withColumn("__k", F.lit(0))
    line = replace(axis, keys=("__k",), ties=())
    carried = asof_backward(days, benchmark.select(axis.order, "close").withColumn("__k", F.lit(0)), line, ["close"])
    out = over_rows(
        carried, line,
        lambda df, w: df.withColumn("bench", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))),
        before=1,
    )
    return out.select(axis.order, "bench")


def hedged(series: DataFrame) -> DataFrame:
    """Add the beta to the benchmark and the beta-hedged return."""
    var = F.var_samp("bench")
    beta = series.agg(F.when(var > 0, F.covar_samp("total", "bench") / var).otherwise(F.lit(0.0)).alias("b")).scalar()
    return series.withColumn("beta", beta).withColumn("beta_hedged", F.col("total") - F.col("beta") * F.col("bench"))


def components(series: DataFrame) -> DataFrame:
    """Annualised return, volatility and Sharpe of every component."""
    long = hedged(series).unpivot(["ts"], COMPONENTS, "component", "value")
    v = F.col("value")
    return long.groupBy("component").agg(
        (F.avg(v) * TRADING_DAYS).alias("ann_return"),
        (F.stddev_samp(v) * TRADING_DAYS**0.5).alias("ann_vol"),
        sharpe(v).alias("sharpe"),
    )


def exposure(series: DataFrame) -> DataFrame:
    return hedged(series).agg(
        F.avg("net").alias("mean_net"), F.avg("gross").alias("mean_gross"), F.max("beta").alias("beta"),
        F.coalesce(F.when(F.stddev_pop("total") > 0, F.corr("total", "bench")), F.lit(0.0)).alias("correlation"),
    )


def cumulative_components(series: DataFrame) -> DataFrame:
    long = hedged(series).unpivot(["ts"], COMPONENTS, "component", "value").withColumn("__g", 1 + F.col("value"))
    axis = Axis(keys=("component",), order="ts")
    return running(long, axis, {"growth": ("product", "__g")}).select("ts", "component", "growth")


def contributors(panel: DataFrame, start=None, axis: Axis = DAILY) -> DataFrame:
    """Basis points earned by each symbol, smallest first."""
    names = panel.agg(F.count_distinct("symbol").alias("n")).scalar()

    def build(df, w):
        return df.withColumns({"__c": F.lead("close").over(w), "__ts": F.lead("ts_init").over(w)})

    rows = over_rows(panel, axis, build, after=1)
    if start is not None:
        rows = rows.where(F.col("__ts") >= start)
    earned = F.coalesce("target", F.lit(0.0)) / names * (F.try_divide(F.col("__c"), F.col("close")) - 1)
    return rows.groupBy("symbol").agg((F.coalesce(F.sum(earned), F.lit(0.0)) * 1e4).alias("contribution_bp")).orderBy(
        "contribution_bp"
    )


def _horizon_rows(panel: DataFrame, horizon: int, first: int, axis: Axis) -> DataFrame:
    def build(df, w):
        ahead = F.lead("close", horizon).over(w)
        return df.withColumn("fwd", F.log(ahead) - F.log("close"))

    rows = over_rows(panel, axis, build, after=horizon)
    last = panel.agg(F.max("t").alias("m")).scalar()
    due = (F.col("t") >= first) & (F.col("t") < last + 1 - horizon) & ((F.col("t") - first) % horizon == 0)
    return rows.where(due & (F.col("target") != 0) & F.col("fwd").isNotNull())


def signal_quality(panel: DataFrame, horizon: int = 21, first: int = 1, axis: Axis = DAILY, min_names: int = 11) -> DataFrame:
    """Hit rates and rank information coefficient on non-overlapping horizons.

    *first* is the calendar position of the first signal row.
    """
    rows = _horizon_rows(panel, horizon, first, axis)
    up, s = F.col("fwd") > 0, F.signum("target")
    rate = lambda cond, where=None: F.avg((F.when(where, cond) if where is not None else cond).cast("double"))
    hits = rows.agg(
        rate(F.signum("fwd") == s).alias("hit_rate"), rate(up).alias("base_rate"),
        rate(up, s > 0).alias("long_hit_rate"), rate(F.col("fwd") < 0, s < 0).alias("short_hit_rate"),
        rate(s > 0).alias("share_long"), F.count(F.lit(1)).alias("positions"),
    )
    w = Window.partitionBy("t")
    tie = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("t", c)) - 1) / 2
    ranked = rows.withColumns({"__n": F.count(F.lit(1)).over(w), "__a": tie("target"), "__b": tie("fwd")})
    ics = ranked.where(F.col("__n") >= min_names).groupBy("t").agg(F.corr("__a", "__b").alias("ic")).where(
        "ic IS NOT NULL AND NOT isnan(ic)"
    )
    t_stat = F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("ic"))
    ic = ics.agg(
        F.struct(
            F.avg("ic").alias("rank_ic"),
            F.when((F.count("ic") > 2) & (F.stddev_samp("ic") > 0), t_stat).alias("rank_ic_t"),
            F.count("ic").alias("ic_dates"),
        ).alias("ic")
    ).scalar()
    return hits.withColumn("ic", ic).select(*hits.columns, "ic.*")
