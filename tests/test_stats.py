"""Statistics against numpy and the standard library."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions import black76
from tidebar.functions.normal import cdf, cdf_array, pdf, with_ppf
from tidebar.operators import roughness, scoring, stats
from tidebar.operators import walkforward as wf
from tidebar.operators.ordered import Axis
from tidebar.operators.ledger import ledger_exact
from tidebar.operators.portfolio import Costs, ledger, weighted_targets

N = NormalDist()
DAY0 = dt.datetime(2020, 1, 1)


def test_normal_functions(spark):
    xs = [float(x) for x in np.linspace(-9, 9, 181)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", cdf("x").alias("c"), pdf("x").alias("d")).collect()
    for r in rows:
        assert r.c == pytest.approx(N.cdf(r.x), abs=1e-14) and r.d == pytest.approx(N.pdf(r.x), rel=1e-12)
    np.testing.assert_allclose(cdf_array(np.array(xs)), [N.cdf(x) for x in xs], atol=1e-14)
    ps = [1e-6, 0.001, 0.024, 0.025, 0.3, 0.5, 0.9, 0.98, 0.999999]
    got = with_ppf(spark.createDataFrame([(p,) for p in ps], "p double"), "z", "p").collect()
    for r in got:
        assert r.z == pytest.approx(N.inv_cdf(r.p), abs=1e-9)


@pytest.fixture(scope="module")
def trials(spark):
    rng = np.random.default_rng(11)
    matrix = rng.normal(0.0003, 0.01, (203, 6)) + np.linspace(0, 0.001, 6)
    rows = [(t, DAY0 + dt.timedelta(days=i), float(matrix[i, t])) for i in range(203) for t in range(6)]
    rows.append((0, DAY0 - dt.timedelta(days=1), 0.5))  # a date the others lack
    return matrix, spark.createDataFrame(rows, "trial long, ts timestamp, ret double")


def test_pbo_is_the_combinatorial_loop(trials):
    matrix, returns = trials
    blocks = np.array_split(np.arange(len(matrix)), 8)
    sharpe = lambda m: m.mean(0) / m.std(0, ddof=1)
    low = []
    for combo in itertools.combinations(range(8), 4):
        inside = np.concatenate([blocks[b] for b in combo])
        outside = np.concatenate([blocks[b] for b in range(8) if b not in combo])
        best, out = int(np.argmax(sharpe(matrix[inside]))), sharpe(matrix[outside])
        rank = ((out < out[best]).sum() + ((out == out[best]).sum() + 1) / 2) / (len(out) + 1)
        low.append(math.log(rank / (1 - rank)) <= 0)
    row = stats.pbo_cscv(returns).first()
    assert row.splits == 70 and row.pbo == pytest.approx(np.mean(low))


def test_pbo_checks_its_partitions(trials):
    for k in (2, 7):
        with pytest.raises(ValueError):
            stats.pbo_cscv(trials[1], n_partitions=k)
    short = trials[1].where("ts < TIMESTAMP '2020-01-05'")
    assert stats.pbo_cscv(short).first().pbo == 0.0


def test_selection_statistics(spark):
    row = (1.2, 750, -0.3, 4.5, 252.0, 40, 0.5)
    frame = spark.createDataFrame([row], "sharpe double, n long, skew double, kurtosis double, periods double, n_trials long, trial_std double")
    got = stats.min_track_record(stats.deflated_sharpe(stats.probabilistic_sharpe(stats.expected_max_sharpe(frame), F.lit(0.0)))).first()
    s = 1.2 / math.sqrt(252)
    var = 1 + 0.3 * s + 0.25 * 3.5 * s * s
    g = 0.5772156649015329
    best = 0.5 * ((1 - g) * N.inv_cdf(1 - 1 / 40) + g * N.inv_cdf(1 - 1 / (40 * math.e)))
    assert got.expected_max == pytest.approx(best)
    assert got.psr == pytest.approx(N.cdf(s * math.sqrt(749) / math.sqrt(var)))
    assert got.dsr == pytest.approx(N.cdf((s - best / math.sqrt(252)) * math.sqrt(749) / math.sqrt(var)))
    assert got.min_track_record == pytest.approx(1 + var * (N.inv_cdf(0.95) / s) ** 2)
    never = frame.withColumn("sharpe", F.lit(-0.1))
    assert math.isinf(stats.min_track_record(never).first().min_track_record)
    alone = frame.withColumn("n_trials", F.lit(1))
    assert stats.expected_max_sharpe(alone).first().expected_max == 0.0


def test_folds_sit_at_the_end(daily):
    frame = daily({"a": [1.0] * 800})
    rows = wf.make_folds(frame, 5, 0.2, 252).orderBy("fold").collect()
    length = min(160, (800 - 252) // 5)
    first = 800 - 5 * length
    for i, r in enumerate(rows):
        assert r.test_start == DAY0 + dt.timedelta(days=first + i * length + 1)
        assert r.train_end == r.test_start - dt.timedelta(days=1)
    assert rows[-1].test_end == DAY0 + dt.timedelta(days=800)
    with pytest.raises(Exception):
        wf.make_folds(daily({"a": [1.0] * 200})).collect()


def test_random_params_are_reproducible(spark):
    space = {"fast": {"low": 5, "high": 25, "step": 5}, "w": {"low": 0.0, "high": 1.0}, "k": [1, 2, 3], "c": 7, "l": {"low": 1.0, "high": 100.0, "log": True}}
    a = wf.random_params(spark, space, 200, 3).toPandas()
    b = wf.random_params(spark.range(1).sparkSession, space, 200, 3).repartition(7).toPandas().sort_values("trial", ignore_index=True)
    assert a.params_json.tolist() == b.params_json.tolist()
    assert {p["fast"] for p in a.params} == {5.0, 10.0, 15.0, 20.0, 25.0} and {p["k"] for p in a.params} == {1.0, 2.0, 3.0}
    assert all(0 <= p["w"] < 1 and p["c"] == 7 and 1 <= p["l"] <= 100 for p in a.params)
    with pytest.raises(ValueError):
        wf.param_grid(spark, {"a": {"low": 1, "high": 2}})
    assert wf.param_grid(spark, {"a": [1, 2], "b": 3, "c": [4, 5, 6]}).count() == 6


def test_exact_ledger_equals_weight_space_without_costs(daily):
    rng = np.random.default_rng(4)
    frame = daily({s: list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))) for s in "abc"})
    w = weighted_targets(frame.withColumn("target", F.sin(F.dayofyear("ts_init") * 7.0)))
    exact = ledger_exact(w.withColumn("trial", F.lit(0))).orderBy("ts_init").toPandas()
    closed = ledger(w).orderBy("ts_init").toPandas()
    np.testing.assert_allclose(exact.equity, closed.equity, rtol=1e-10)
    cost = Costs(rate=0.001)
    exact = ledger_exact(w.withColumn("trial", F.lit(0)), cost).orderBy("ts_init").toPandas()
    closed = ledger(w, cost).orderBy("ts_init").toPandas()
    np.testing.assert_allclose(exact.equity_post, closed.equity_post, rtol=1e-3)
    assert exact.equity_post.iloc[-1] < closed.equity.iloc[0]
    with pytest.raises(ValueError):
        Costs(rate=0.1, per_contract=1.0)


def test_roughness_recovers_markov_noise(spark):
    """A random walk has H near a half; observation noise is told apart from it."""
    rng = np.random.default_rng(2)
    path = np.cumsum(rng.normal(0, 1, 4000))
    noisy = path + rng.normal(0, 1.0, 4000)
    rows = [(name, DAY0 + dt.timedelta(days=i), float(v)) for name, s in (("clean", path), ("noisy", noisy)) for i, v in enumerate(s)]
    frame = spark.createDataFrame(rows, "symbol string, ts_init timestamp, x double")
    vario = roughness.variogram(frame, Axis())
    lags = sorted(r.lag for r in vario.where("symbol = 'clean'").collect())
    grid = np.unique(np.rint(np.logspace(0, np.log10(64), 20)).astype(int))
    assert lags == grid.tolist()
    m = {(r.symbol, r.lag): r.m for r in vario.collect()}
    for lag in (1, 7, 64):
        assert m["noisy", lag] == pytest.approx(np.mean((noisy[lag:] - noisy[:-lag]) ** 2))
    fit = {r.symbol: r for r in roughness.hurst_with_nugget(vario, ["symbol"]).collect()}
    assert abs(fit["clean"].hurst - 0.5) < 0.08 and fit["clean"].noise_share < 0.2
    assert fit["noisy"].hurst_naive < 0.42 and abs(fit["noisy"].hurst - 0.5) < 0.12
    assert fit["noisy"].noise_std == pytest.approx(1.0, abs=0.25)
    gate = roughness.roughness_gate(frame, None, 5)
    verdicts = {r.symbol: r.verdict for r in gate.collect()}
    assert verdicts["clean"] in ("markovian", "unstable", "intermediate") and verdicts["noisy"] != "rough"
    few = roughness.roughness_gate(frame.where("ts_init < TIMESTAMP '2022-01-01'"), None, 5)
    assert {r.verdict for r in few.collect()} == {"insufficient_data"}


def test_fit_ou_recovers(spark):
    rng = np.random.default_rng(8)
    kappa, theta, sigma, h = 5.0, -3.0, 0.8, 1 / 252
    b = math.exp(-kappa * h)
    x = [theta]
    for _ in range(20000):
        x.append(theta + (x[-1] - theta) * b + sigma * math.sqrt((1 - b * b) / (2 * kappa)) * rng.normal())
    rows = [("s", DAY0 + dt.timedelta(days=i), v) for i, v in enumerate(x)]
    got = roughness.fit_ou(spark.createDataFrame(rows, "symbol string, ts_init timestamp, x double"), h).first()
    assert got.kappa == pytest.approx(kappa, rel=0.25) and got.theta == pytest.approx(theta, abs=0.1) and got.sigma == pytest.approx(sigma, rel=0.03)
    trend = spark.createDataFrame([("s", DAY0 + dt.timedelta(days=i), float(i * i)) for i in range(50)], "symbol string, ts_init timestamp, x double")
    assert roughness.fit_ou(trend, h).first().kappa == 0.0


def test_calibration_of_many_equal_values(spark):
    u = np.round(np.random.default_rng(1).uniform(size=5000), 2)
    got = scoring.calibration_error(spark.createDataFrame([(float(v),) for v in u], "pit double")).first()[0]
    s = np.sort(u)
    i = np.arange(1, len(s) + 1)
    assert got == pytest.approx(max((i / len(s) - s).max(), (s - (i - 1) / len(s)).max()))
    assert scoring.calibration_error(spark.createDataFrame([], "pit double")).first()[0] == 0.0


def test_options_parity_and_greeks(spark):
    rows = [(100.0, k, t, 0.02, v, r) for k in (80.0, 100.0, 125.0) for t in (0.1, 1.0) for v in (0.15, 0.6) for r in "CP"]
    frame = spark.createDataFrame(rows, "forward double, strike double, t double, rate double, sigma double, right string")
    base = black76.price(black76.greeks(frame)).toPandas()
    calls, puts = base[base.right == "C"].reset_index(), base[base.right == "P"].reset_index()
    np.testing.assert_allclose(calls.price - puts.price, np.exp(-0.02 * calls.t) * (100 - calls.strike), atol=1e-10)
    bump = lambda col, e: black76.price(frame.withColumn(col, F.col(col) + e)).toPandas().price
    np.testing.assert_allclose(base.delta, (bump("forward", 1e-4) - bump("forward", -1e-4)) / 2e-4, atol=1e-6)
    np.testing.assert_allclose(base.vega, (bump("sigma", 1e-5) - bump("sigma", -1e-5)) / 2e-5, atol=1e-4)
    np.testing.assert_allclose(base.theta, -(bump("t", 1e-5) - bump("t", -1e-5)) / 2e-5, atol=1e-4)
    np.testing.assert_allclose(base.gamma, (bump("forward", 1e-2) - 2 * base.price + bump("forward", -1e-2)) / 1e-4, atol=1e-4)
