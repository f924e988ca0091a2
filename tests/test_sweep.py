"""Sweeps against validated books, and session rules."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidebar.operators import shared, strategies
from tidebar.operators import walkforward as wf
from tidebar.operators.portfolio import Costs
from tidebar.session import checkpoint_dir, store_once

GRID = [dict(fast=f, slow=30, vol_target=0.1, vol_lookback=20) for f in (3, 8)]


@pytest.fixture(scope="module")
def weekdays(spark):
    """Two symbols that trade on weekdays only."""
    r, rows = random.Random(4), []
    for symbol in ("AA", "BB"):
        price, day = 100.0, dt.datetime(2018, 1, 1)
        while day < dt.datetime(2020, 6, 1):
            if day.weekday() < 5:
                price *= 1 + r.gauss(0.0003, 0.01)
                rows.append((symbol, day, day + dt.timedelta(days=1), price, price, price, price, 1e6))
            day += dt.timedelta(days=1)
    return store_once(spark.createDataFrame(rows, "symbol string, ts_event timestamp, ts_init timestamp, open double, high double, low double, close double, volume double"))


@pytest.fixture(scope="module")
def books(weekdays):
    targets = wf.trend_targets(weekdays, GRID)
    return targets, store_once(wf.make_folds(weekdays, n_splits=3, test_size=0.15))


def scores(returns):
    return {(x.trial, x.fold): (x.sharpe, x.n) for x in wf.fold_scores(returns).collect()}


def test_screened_and_validated_agree_without_costs(weekdays, books):
    targets, folds = books
    screened = scores(wf.sweep(weekdays, targets, folds))
    best = wf.trial_scores(wf.fold_scores(wf.sweep(weekdays, targets, folds)))
    validated = scores(wf.validate_top_k(weekdays, targets, folds, best, 2, Costs()))
    assert screened.keys() == validated.keys() and len(screened) == 6
    for key, (sharpe, n) in screened.items():
        assert validated[key] == (pytest.approx(sharpe, abs=1e-9), n)


def test_a_fold_starts_in_cash_and_pays_for_its_entry(weekdays, books):
    targets, folds = books
    free, paid = (wf.sweep(weekdays, targets, folds, c).where("fold = 0 and trial = 0").orderBy("ts").collect() for c in (Costs(), Costs(rate=0.01)))
    first = folds.where("fold = 0").first()["test_start"]
    held = targets.where((F.col("ts_init") == F.lit(first)) & (F.col("trial") == 0)).agg(F.sum(F.abs("target")) / 2).first()[0]
    assert free[0].ts.date() == first.date() == paid[0].ts.date()
    assert free[0].ret - paid[0].ret >= held * 0.01 * 0.9 > 0
    assert len({x.ts for x in free}) == (free[-1].ts - free[0].ts).days + 1  # every calendar day once


def test_any_strategy_can_be_swept(weekdays, books):
    _, folds = books
    grid = [dict(lookback=40, vol_lookback=20, rebal_freq=f) for f in (1, 5)]
    returns = wf.sweep(weekdays, wf.strategy_targets(weekdays, strategies.ts_momentum, grid), folds, Costs(rate=0.0005))
    assert {k for k in scores(returns)} == {(t, f) for t in (0, 1) for f in (0, 1, 2)}


def test_no_machine_local_folder_on_a_cluster():
    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(session(master))
    checkpoint_dir(session("local[4]"))


def test_declared_rules_are_the_strategies(spark, weekdays):
    """Targets of every trial, whatever its parameters, on a table with gaps and a symbol that stops."""
    third = weekdays.where("symbol = 'AA' and ts_init < TIMESTAMP '2019-09-01'").withColumns({"symbol": F.lit("CC"), "close": F.col("close") * (1.3 + F.sin(F.dayofyear("ts_init") / 9))})
    bars = store_once(weekdays.unionByName(third).where("not (symbol = 'BB' and day(ts_init) % 7 = 3)"))
    ts = [dict(lookback=n, skip_recent=k, vol_lookback=9, rebal_freq=f) for n, k, f in ((20, 0, 1), (30, 4, 5), (20, 4, 3))]
    xs = [dict(lookback=n, skip_recent=3, vol_lookback=v, rebal_freq=f, top_quantile=q) for n, v, f, q in ((20, 9, 4, 0.25), (25, 12, 6, 0.4))]
    run = lambda frame, **p: strategies.compute_targets(frame, strategies.xs_momentum, multi_asset=True, **p)
    for rule, strategy, grid in ((shared.TS_MOMENTUM, strategies.ts_momentum, ts), (shared.XS_MOMENTUM, run, xs)):
        key = lambda df: {(r.trial, r.symbol, r.ts_init): (r.close, r.target) for r in df.collect()}
        got, want = key(shared.rule_targets(bars, rule, grid)), key(wf.strategy_targets(bars, strategy, grid))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
        assert len({v[1] for v in got.values()}) > 3


def test_scans_do_not_grow_with_trials(spark, weekdays):
    bars = store_once(weekdays)
    for rule in (shared.TS_MOMENTUM, shared.XS_MOMENTUM):
        plans = [
            shared.rule_targets(bars, rule, [dict(lookback=10 + i, vol_lookback=5) for i in range(n)])._jdf.queryExecution().executedPlan().toString() for n in (1, 9)
        ]
        assert plans[0].count("Scan") == plans[1].count("Scan") > 0 and plans[0].count("Exchange") == plans[1].count("Exchange")
