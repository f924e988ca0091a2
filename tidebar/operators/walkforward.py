"""Folds, parameter grids and sweeps.

A sweep is one plan with trial and fold as keys: targets of all trials form one table,
each (trial, fold) is a book, and books are accounted for side by side by the same
ledger that a single backtest uses.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TRADING_DAYS
from ..session import store_once
from .ordered import DAILY, Axis, over_rows
from .ledger import ledger_exact
from .panel import calendar
from .portfolio import Costs, calendar_fill, ledger, trades, weighted_targets
from .volatility import _rolling, drawdown, pct_change

ANNUAL = TRADING_DAYS**0.5


def make_folds(closes: DataFrame, n_splits: int = 5, test_size: float | int = 0.2, min_train: int = TRADING_DAYS,
               axis: Axis = DAILY) -> DataFrame:
    """Contiguous test windows of equal length at the end of the calendar."""
    if n_splits < 1:
        raise ValueError(f"{n_splits} folds: nothing to test on")
    # Stored because the length and the first close are read besides the closes.
    days = store_once(calendar(closes, axis).withColumnRenamed(axis.order, "ts"))
    total = days.agg(F.count(F.lit(1)).alias("n")).scalar()
    asked = F.greatest(F.lit(1), F.floor(total * F.lit(test_size))) if isinstance(test_size, float) else F.lit(test_size)
    length = F.least(asked, F.floor((total - min_train) / n_splits)).cast("long")
    checked = F.when(length >= 1, length).otherwise(
        F.raise_error(F.lit("too few bars for these folds after the warm-up")).cast("long")
    )
    line = replace(axis, keys=(), order="ts", ties=())
    days = over_rows(days, line, lambda df, w: df.withColumn("__prev", F.lag("ts").over(w)), before=1)
    days = days.withColumns({"__len": checked, "__n": total})
    fold = F.floor((F.col("t") - (F.col("__n") - n_splits * F.col("__len"))) / F.col("__len")).cast("int")
    start = days.agg(F.min("ts").alias("s")).scalar()
    return (
        days.withColumn("fold", fold)
        .where("fold >= 0")
        .groupBy("fold")
        .agg(
            F.min_by(F.coalesce("__prev", "ts"), "t").alias("train_end"),
            F.min("ts").alias("test_start"),
            F.max("ts").alias("test_end"),
        )
        .withColumn("train_start", start)
        .select("fold", "train_start", "train_end", "test_start", "test_end")
    )


def fold_table(folds: DataFrame) -> DataFrame:
    return folds.withColumn("test_days", F.datediff("test_end", "test_start"))


def fold_windows(rows: DataFrame, folds: DataFrame, order: str = "ts_init") -> DataFrame:
    """Rows inside each fold's test window (folds do not overlap, so at most one each).

    There are as many folds as splits, so their bounds become a case expression on the row instead of a join.
    """
    fold = F.lit(None).cast("int")
    for f in folds.select("fold", "test_start", "test_end").collect():
        fold = F.when(F.col(order).between(F.lit(f["test_start"]), F.lit(f["test_end"])), F.lit(f["fold"])).otherwise(fold)
    return rows.withColumn("fold", fold).where("fold IS NOT NULL")


def param_grid(spark: SparkSession, space: dict) -> DataFrame:
    """Every combination of a space of lists and scalars: ``trial, params, params_json``."""
    if any(isinstance(v, dict) for v in space.values()):
        raise ValueError("a grid takes lists and single values; draw ranges with random_params")
    names = sorted(space)
    choices = [v if isinstance(v, list) else [v] for v in (space[n] for n in names)]
    rows = []
    for trial, combo in enumerate(itertools.product(*choices)):
        params = {n: float(v) for n, v in zip(names, combo)}
        rows.append((trial, params, json.dumps(params, sort_keys=True)))
    return spark.createDataFrame(rows, "trial long, params map<string,double>, params_json string")


def random_params(spark: SparkSession, space: dict, n: int, seed: int) -> DataFrame:
    """*n* seeded draws from lists (choice), ``{low, high, step?, log?}`` ranges and scalars."""

    def draw(name: str, spec) -> Column:
        # A hash of (seed, name, trial) instead of rand(): the same draw on any partitioning, and in any engine.
        word = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col("trial").cast("string")).cast("binary")), 1, 13), 16, 10)
        u = word.cast("double") / F.lit(float(1 << 52))
        if isinstance(spec, list):
            return F.element_at(F.array(*[F.lit(float(v)) for v in spec]), (F.floor(u * len(spec)) + 1).cast("int"))
        if not isinstance(spec, dict):
            return F.lit(float(spec))
        low, high = spec["low"], spec["high"]
        whole = isinstance(low, int) and isinstance(high, int)
        step = spec.get("step", 1 if whole else None)
        if spec.get("log"):
            value = F.exp(F.log(F.lit(float(low))) + u * (F.log(F.lit(float(high))) - F.log(F.lit(float(low)))))
            return F.rint(value) if whole else value
        if step:
            slots = int((high - low) / step + 1e-9) + 1
            return F.lit(float(low)) + F.floor(u * slots) * float(step)
        return F.lit(float(low)) + u * float(high - low)

    pairs = [x for name in sorted(space) for x in (F.lit(name), draw(name, space[name]))]
    out = spark.range(n).withColumnRenamed("id", "trial").withColumn("params", F.create_map(*pairs))
    return out.withColumn("params_json", F.to_json("params"))


def fingerprint(params: Column) -> Column:
    """Name of a map of parameters, whatever the order of its entries, that survives renumbering of trials."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params)))), 256)


def pending_trials(trials: DataFrame, done: DataFrame) -> DataFrame:
    """Trials of a resumed study that are not stored yet."""
    return trials.join(done.select("trial").distinct(), "trial", "left_anti")


def _indicators(bars: DataFrame, grid: list[dict], axis: Axis) -> DataFrame:
    """Every (indicator, window) the grid needs, once per bar, as window-keyed maps."""
    spans = sorted({p["fast"] for p in grid} | {p["slow"] for p in grid})
    vols = sorted({p["vol_lookback"] for p in grid})

    def build(df, w):
        df = df.withColumn("__r", pct_change("close", w))
        ma = {f"ma{n}": _rolling(F.avg, "close", w, n) for n in spans}
        return df.withColumns({**ma, **{f"rv{n}": _rolling(F.stddev_samp, "__r", w, n) * ANNUAL for n in vols}})

    def table(prefix: str, ns: list[int]) -> Column:
        return F.create_map(*[x for n in ns for x in (F.lit(n), F.col(f"{prefix}{n}"))])

    rows = over_rows(bars.select(*axis.keys, axis.order, "close"), axis, build, before=max(max(spans), max(vols) + 1))
    return rows.select(*axis.keys, axis.order, "close", table("ma", spans).alias("ma"), table("rv", vols).alias("rv"))


def trend_targets(bars: DataFrame, grid: list[dict], axis: Axis = DAILY) -> DataFrame:
    """Trend-following targets of every trial: indicators once per bar, trials as an exploded constant array."""
    trials = [
        F.struct(F.lit(i).cast("long").alias("trial"), F.lit(p["fast"]).alias("fast"), F.lit(p["slow"]).alias("slow"),
                 F.lit(float(p["vol_target"])).alias("vt"), F.lit(p["vol_lookback"]).alias("vl"))
        for i, p in enumerate(grid)
    ]
    each = _indicators(bars, grid, axis).withColumn("p", F.explode(F.array(*trials)))
    gap = F.signum(F.element_at("ma", F.col("p.fast")) - F.element_at("ma", F.col("p.slow")))
    vol = F.element_at("rv", F.col("p.vl"))
    size = F.when(vol.isNotNull(), F.least(F.col("p.vt") / F.greatest(vol, F.lit(1e-6)), F.lit(5.0)))
    return each.select(F.col("p.trial").alias("trial"), *axis.keys, axis.order, "close", F.coalesce(gap * size, F.lit(0.0)).alias("target"))


def strategy_targets(bars: DataFrame, strategy: Callable[..., DataFrame], grid: list[dict], axis: Axis = DAILY) -> DataFrame:
    """Targets of any strategy for every trial: one plan per set of parameters, one keyed table.

    *strategy* takes bars and the parameters of a trial, single- or multi-asset alike, and returns bars with ``target``.
    """
    parts = [
        strategy(bars, **params).select(F.lit(i).cast("long").alias("trial"), *axis.keys, axis.order, "target") for i, params in enumerate(grid)
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.join(bars.select(*axis.keys, axis.order, "close"), [*axis.keys, axis.order])


def sweep(bars: DataFrame, targets: DataFrame, folds: DataFrame, costs: Costs = Costs(), axis: Axis = DAILY) -> DataFrame:
    """Calendar-day returns ``trial, fold, ts, ret`` of every trial's *targets* over every fold's test window.

    Each (trial, fold) is a book of its own. It starts in cash at the first close of the window, pays in full for what it
    buys there, earns from the next close on, and is marked on calendar days like a validated book.
    """
    names = bars.agg(F.count_distinct("symbol").alias("n")).scalar()
    inside = fold_windows(targets, folds, axis.order).withColumn("w", F.col("target") / names)
    return calendar_fill(ledger(inside, costs, axis=axis.within("trial", "fold")), 1.0, ("trial", "fold"))


def sweep_trend(bars: DataFrame, folds: DataFrame, grid: list[dict], costs: Costs = Costs(), axis: Axis = DAILY) -> DataFrame:
    """:func:`sweep` of trend following; *grid* holds ``fast, slow, vol_target, vol_lookback`` per trial."""
    return sweep(bars, trend_targets(bars, grid, axis), folds, costs, axis)


def validate_top_k(bars: DataFrame, targets: DataFrame, folds: DataFrame, screened: DataFrame, k: int, costs: Costs,
                   axis: Axis = DAILY) -> DataFrame:
    """Re-score the best *k* screened trials with the unit-holding ledger, per fold.

    Returns ``trial, fold, ts, ret`` on calendar days; deflate them by the whole
    search by passing the screened returns as ``selection`` to ``summarize_study``.
    """
    names = bars.agg(F.count_distinct("symbol").alias("n")).scalar()
    best = screened.orderBy(F.desc("value"), "trial").limit(k).select("trial")
    chosen = targets.join(F.broadcast(best), "trial", "left_semi")  # k rows
    inside = fold_windows(chosen, folds, axis.order)
    books = ledger_exact(inside.withColumn("w", F.col("target") / names), costs, keys=("trial", "fold"))
    return calendar_fill(books, 1.0, ("trial", "fold"))


def full_backtest(targets: DataFrame, min_train: int = TRADING_DAYS, costs: Costs = Costs(), capital: float = 1.0,
                  axis: Axis = DAILY) -> DataFrame:
    """Ledger of one parameter set from the close after the warm-up to the end."""
    start = calendar(targets, axis).where(F.col("t") == min_train).agg(F.min(axis.order).alias("s")).scalar()
    return ledger(weighted_targets(targets).where(F.col(axis.order) >= start), costs, capital, axis)


def run_all(strategies: dict[str, DataFrame], folds: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Out-of-sample Sharpe of every strategy on every symbol, best first.

    *strategies* maps a name to bars with targets; they run as one keyed table.
    """
    parts = [df.select(F.lit(name).alias("strategy"), *axis.keys, axis.order, "close", "target") for name, df in strategies.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    keyed = axis.within("strategy")
    earned = over_rows(
        rows, keyed, lambda df, w: df.withColumn("ret", F.lag("target").over(w) * pct_change("close", w)), before=1
    )
    inside = fold_windows(earned.where("ret IS NOT NULL"), folds, axis.order)
    out = inside.groupBy("strategy", *axis.keys).agg(sharpe(F.col("ret")).alias("sharpe"), F.count("ret").alias("n"))
    return out.orderBy(F.desc("sharpe"))


def run_books(strategies: dict[str, DataFrame], folds: DataFrame, costs: Costs = Costs(), axis: Axis = DAILY) -> DataFrame:
    """Out-of-sample score of every strategy on every universe with costs, best first.

    *strategies* maps a name to bars with ``target`` and ``universe``: the symbol for a single-asset strategy, a venue for one that ranks its
    symbols. Each (strategy, universe, fold) is a book of equal shares that starts in cash; folds are stitched. All run as one table.
    """
    parts = [df.select(F.lit(name).alias("strategy"), "universe", *axis.keys, axis.order, "close", "target") for name, df in strategies.items()]
    rows = reduce(DataFrame.unionByName, parts)
    book = ["strategy", "universe"]
    sizes = rows.groupBy(*book).agg(F.count_distinct("symbol").alias("__n"))
    inside = fold_windows(rows.join(sizes, book).withColumn("w", F.col("target") / F.col("__n")).drop("__n"), folds, axis.order)
    returns = calendar_fill(ledger(inside, costs, axis=axis.within(*book, "fold")), 1.0, (*book, "fold"))
    out = returns.groupBy(*book).agg(sharpe(F.col("ret")).alias("sharpe"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("sharpe"))


def fold_scores(returns: DataFrame) -> DataFrame:
    """Annualised Sharpe ratio per trial and fold."""
    return returns.groupBy("trial", "fold").agg(sharpe(F.col("ret")).alias("sharpe"), F.count(F.lit(1)).alias("n"))


def fold_summary(bars: DataFrame, targets: DataFrame, folds: DataFrame, costs: Costs = Costs(), axis: Axis = DAILY) -> DataFrame:
    """One row per trial and fold: Sharpe ratio, total return, worst drawdown and number of orders."""
    names = bars.agg(F.count_distinct("symbol").alias("n")).scalar()
    inside = store_once(fold_windows(targets, folds, axis.order).withColumn("w", F.col("target") / names))
    books = axis.within("trial", "fold")
    orders = trades(inside, costs, books).groupBy("trial", "fold").agg(F.count(F.lit(1)).alias("orders"))
    returns = calendar_fill(ledger(inside, costs, axis=books), 1.0, ("trial", "fold"))
    grown = drawdown(returns, Axis(keys=("trial", "fold"), order="ts")).groupBy("trial", "fold").agg(
        (F.max_by("equity", "ts") - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown")
    )
    out = fold_scores(returns).withColumnRenamed("n", "days").join(grown, ["trial", "fold"]).join(orders, ["trial", "fold"], "left")
    return out.withColumn("orders", F.coalesce("orders", F.lit(0)))


def sharpe(ret: Column, periods: float = TRADING_DAYS) -> Column:
    dev = F.stddev_samp(ret)
    return F.when((F.count(ret) < 2) | (F.coalesce(dev, F.lit(0.0)) == 0), F.lit(0.0)).otherwise(
        F.avg(ret) / dev * F.sqrt(F.lit(float(periods)))
    )


def trial_scores(fold_rows: DataFrame) -> DataFrame:
    """Mean fold Sharpe (the score) and share of positive folds per trial."""
    return fold_rows.groupBy("trial").agg(
        F.avg("sharpe").alias("value"),
        F.avg((F.col("sharpe") > 0).cast("double")).alias("positive_folds"),
        F.count(F.lit(1)).alias("folds"),
    )


def trials_frame(fold_rows: DataFrame, n_folds: int) -> DataFrame:
    """One row per trial with a column per fold."""
    wide = fold_rows.groupBy("trial").pivot("fold", list(range(n_folds))).agg(F.first("sharpe"))
    return wide.select("trial", *[F.col(f"`{i}`").alias(f"fold_{i}") for i in range(n_folds)])


def fold_comparison(a: DataFrame, b: DataFrame, n_folds: int) -> DataFrame:
    """Two methods' fold columns side by side, one row per trial and fold."""
    names = [f"fold_{i}" for i in range(n_folds)]
    left = a.unpivot(["trial"], names, "fold", "sharpe_a")
    return left.join(b.unpivot(["trial"], names, "fold", "sharpe_b"), ["trial", "fold"])


def engine_comparison(screened: DataFrame, validated: DataFrame) -> DataFrame:
    """Scores of the same parameters under two methods, worst difference first."""
    pick = lambda df, out: df.groupBy("params").agg(F.min_by("value", "trial").alias(out))
    return (
        pick(screened, "screened").join(pick(validated, "validated"), "params")
        .withColumn("diff", F.col("validated") - F.col("screened"))
        .withColumn("ratio", F.try_divide(F.col("validated"), F.col("screened")))
        .orderBy(F.desc(F.abs("diff")), "params")
    )


def agreement(screened: DataFrame, validated: DataFrame) -> DataFrame:
    """Both scores of every validated trial with its rank under each; a top-k report, so ranks come from one small group."""
    both = validated.select("trial", F.col("value").alias("validated")).join(screened.select("trial", F.col("value").alias("screened")), "trial")
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "trial"))
    return both.withColumns({
        "diff": F.col("validated") - F.col("screened"), "screened_rank": rank("screened"), "validated_rank": rank("validated"),
    })


def top_trials(trials: DataFrame, k: int) -> DataFrame:
    """The *k* best trials with distinct parameters."""
    payload = [c for c in trials.columns if c != "params"]
    best = trials.groupBy("params").agg(
        F.max_by(F.struct(*payload), F.struct("value", -F.col("trial"))).alias("b")
    )
    return best.select("params", "b.*").orderBy(F.desc("value"), "trial").limit(k)


def best_trial(trials: DataFrame, keys: list[str]) -> DataFrame:
    return trials.groupBy(*keys).agg(F.max_by("trial", F.struct("value", -F.col("trial"))).alias("trial"), F.max("value").alias("value"))


def best_so_far(trials: DataFrame, axis: Axis) -> DataFrame:
    from .ordered import running

    return running(trials, axis, {"best": ("max", "value")})


def histogram(trials: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in *bins* equal bins between the smallest and largest value."""
    lo = trials.agg(F.min(column).alias("x")).scalar()
    hi = trials.agg(F.max(column).alias("x")).scalar()
    slot = F.when(hi > lo, F.least(F.floor((F.col(column) - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return trials.groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def list_studies(trials: DataFrame) -> DataFrame:
    return trials.groupBy("study").agg(F.count(F.lit(1)).alias("trials"), F.max("value").alias("best"))
