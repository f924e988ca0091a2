"""Strategies against plain loops, and causality on prefixes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import strategies as st
from tidebar.operators.panel import align_union


def walk(seed: int, n: int, sigma: float = 0.015) -> list[float]:
    return list(100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, sigma, n))))


def targets(frame) -> dict[str, np.ndarray]:
    pdf = frame.orderBy("symbol", "ts_init").toPandas()
    return {s: g["target"].to_numpy() for s, g in pdf.groupby("symbol")}


def test_ts_momentum_blocks_hold_first_value(daily):
    closes = walk(1, 150)
    got = targets(st.ts_momentum(daily({"x": closes}), 20, 3, vol_lookback=10, rebal_freq=7))["x"]
    c = pd.Series(closes)
    recent = c.shift(3)
    vol = (c.pct_change().rolling(10).std() * 252**0.5).clip(lower=1e-6)
    raw = (np.sign(recent / recent.shift(20) - 1) * (0.1 / vol).clip(upper=2)).to_numpy()
    for i in range(1, len(raw)):
        if i % 7 and not np.isnan(raw[i - 1]):
            raw[i] = raw[i - 1]
    np.testing.assert_allclose(got, np.nan_to_num(raw), atol=1e-12)


@pytest.mark.parametrize("vol_lookback", [10, 40])
def test_mean_reversion_state(daily, vol_lookback):
    closes = walk(2, 300)
    got = targets(st.mean_reversion(daily({"x": closes}), 20, 1.2, 0.4, vol_lookback=vol_lookback))["x"]
    r = pd.Series(closes).pct_change().fillna(0)
    z = (r - r.rolling(20).mean()) / r.rolling(20).std().clip(lower=1e-9)
    vol = (r.rolling(vol_lookback).std() * 252**0.5).clip(lower=1e-6).fillna(1.0)
    held, want = 0.0, []
    for zi, vi in zip(z, vol):
        if np.isnan(zi):
            held = 0.0
        elif abs(zi) > 1.2:
            held = -np.sign(zi) * min(0.1 / vi, 3.0)
        elif abs(zi) < 0.4:
            held = 0.0
        want.append(held)
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_null_volatility_gives_no_position(daily):
    """A look-back longer than the averages must not size on a missing volatility."""
    got = targets(st.trend_following(daily({"x": walk(3, 80)}), 5, 10, vol_lookback=40))["x"]
    assert (got[:40] == 0).all() and (got[45:] != 0).any()


def test_portfolio_scale_matches_loop(daily):
    series = {f"s{i}": walk(10 + i, 90) for i in range(4)}
    frame = align_union(daily(series)).withColumn("target", F.lit(1.0) + F.col("t") % 3)
    got = st.portfolio_scale(frame, 0.1, 20, 2.0).toPandas().groupby("t")["book_scale"].first().to_numpy()
    cut = st.portfolio_scale(frame, 0.1, 20, 2.0, block_symbols=2, block_closes=20).toPandas().groupby("t")["book_scale"].first().to_numpy()
    np.testing.assert_allclose(cut, got, rtol=1e-12)
    close = np.column_stack([series[s] for s in sorted(series)])
    ret = np.vstack([np.zeros((1, 4)), close[1:] / close[:-1] - 1])
    want = np.ones(90)
    for t in range(20, 90):
        book = np.full(4, (1.0 + t % 3) / 4)
        v = np.std(ret[t - 19 : t + 1] @ book, ddof=1) * 252**0.5
        want[t] = min(0.1 / v, 2.0)
    np.testing.assert_allclose(got, want, rtol=1e-9)


CASES = {
    "trend": (lambda d: st.trend_following(d, 5, 15, vol_lookback=8), False),
    "ts": (lambda d: st.ts_momentum(d, 15, 2, vol_lookback=8, rebal_freq=5), False),
    "reversion": (lambda d: st.mean_reversion(d, 10, 1.0), False),
    "xs": (lambda d: st.xs_momentum(d, 15, 2, vol_lookback=8, rebal_freq=5), True),
    "carry": (lambda d: st.trend_carry(d, 15, 0.3, 12, vol_lookback=8, rebal_freq=4, basis_weight=0.5, basis_lookback=10,
                                       basis_groups=("g",), portfolio_vol_target=0.1, cov_lookback=10), True),
}


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("cut", [41, 67])
def test_signals_do_not_look_ahead(daily, case, cut):
    make, multi = CASES[case]
    series = {f"s{i}": walk(50 + i, 90) for i in range(5)}

    def run(length):
        frame = daily({k: v[:length] for k, v in series.items()})
        frame = frame.withColumns({"carry": F.col("close") % 1, "second_return": (F.col("close") % 2 - 1) / 50, "peer": F.lit("g")})
        return targets(make(align_union(frame) if multi else frame))

    whole, prefix = run(90), run(cut)
    for symbol, values in prefix.items():
        np.testing.assert_allclose(whole[symbol][:cut], values, atol=1e-10)


def test_a_peeking_strategy_is_caught(daily):
    from tidebar.operators.ordered import DAILY

    closes = walk(9, 60)
    peek = lambda d: d.withColumn("target", F.signum(F.lead("close").over(DAILY.window()) - F.col("close")))
    whole, prefix = targets(peek(daily({"x": closes})))["x"], targets(peek(daily({"x": closes[:40]})))["x"]
    assert not np.allclose(np.nan_to_num(whole[:40]), np.nan_to_num(prefix))


def test_delisted_name_is_closed(daily):
    frame = daily({"a": walk(1, 60), "b": walk(2, 40)})
    out = st.compute_targets(frame, lambda d, axis: d.withColumn("target", F.lit(1.0)), multi_asset=True)
    got = targets(out)
    assert got["b"][-1] == 0 and got["b"][:-1].all() and got["a"].all()


def test_pandas_strategy_needs_short_series(daily):
    from tidebar.operators.ordered import Axis

    with pytest.raises(ValueError):
        st.pandas_strategy(daily({"a": [1.0, 2.0]}), lambda f: f["close"], Axis(step=1))
