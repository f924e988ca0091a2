"""Blocked plans for long series give the same values as plain windows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import panel, strategies
from tidebar.operators import volatility as vol
from tidebar.operators.ordered import Axis, asof_backward, over_rows, row_index, running

PLAIN = Axis()
BLOCKED = Axis(max_rows=1, block_rows=16)


@pytest.fixture(scope="module")
def bars(daily):
    rng = np.random.default_rng(7)
    series = {}
    for name, n in (("hot", 400), ("a", 90), ("b", 33), ("c", 1)):
        closes = list(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))))
        series[name] = [None if rng.random() < 0.1 and 0 < i < n - 1 else c for i, c in enumerate(closes)]
    return daily(series)


def both(bars, make, columns):
    out = []
    for axis in (PLAIN, BLOCKED):
        frame = make(bars, axis).select("symbol", "ts_init", *columns).toPandas()
        out.append(frame.sort_values(["symbol", "ts_init"], ignore_index=True))
    assert not BLOCKED.bounded and PLAIN.bounded
    pd.testing.assert_frame_equal(out[0], out[1], rtol=1e-9, atol=1e-12)
    return out[0]


def test_row_index(bars):
    both(bars, row_index, ["row_idx"])


def test_running_kinds(bars):
    x = F.when(F.dayofyear("ts_init") % 5 == 0, F.col("close"))
    frame = bars.withColumns({"x": x, "g": F.col("close") / 100})
    specs = {"s": ("sum", "x"), "p": ("product", "g"), "m": ("max", "x"), "l": ("last", "x"), "f": ("first", "x")}
    both(frame, lambda d, ax: running(d, ax, specs), list(specs))


def test_frames_reach_across_blocks(bars):
    both(bars, lambda d, ax: vol.realised_vol(d, 40, axis=ax), ["realised_vol"])
    both(bars, lambda d, ax: over_rows(d, ax, lambda x, w: x.withColumn("n", F.lead("close", 5).over(w)), after=5), ["n"])


def test_alignment_and_strategies(bars):
    both(bars, panel.align_union, ["close", "real", "t"])
    both(bars, lambda d, ax: strategies.mean_reversion(d, 10, axis=ax), ["target"])
    both(bars, lambda d, ax: strategies.ts_momentum(d, 20, 3, vol_lookback=10, rebal_freq=7, axis=ax), ["target"])
    both(bars, lambda d, ax: panel.exit_delisted(d.withColumn("target", F.lit(1.0)), ax), ["target"])


def test_ewma_matches_pandas(bars):
    frame = both(vol.with_returns(bars), lambda d, ax: vol.ewma_vol(d, 20, 20, axis=ax), ["ret", "ewma_vol"])
    for _, group in frame.groupby("symbol"):
        want = (group["ret"].ewm(com=20, min_periods=20, ignore_na=True).var(bias=True) * 261) ** 0.5
        np.testing.assert_allclose(group["ewma_vol"].to_numpy(float), want.to_numpy(float), rtol=1e-7)


def test_ewma_across_spans(spark):
    rng = np.random.default_rng(3)
    rows = [("x", dt.datetime(1990, 1, 1) + dt.timedelta(hours=i), float(r)) for i, r in enumerate(rng.normal(0, 0.01, 9000))]
    frame = spark.createDataFrame(rows, "symbol string, ts_init timestamp, ret double")
    got = vol.ewma_vol(frame, axis=Axis(step=3600)).orderBy("ts_init").toPandas()
    want = (got["ret"].ewm(com=60, min_periods=60, ignore_na=True).var(bias=True) * 261) ** 0.5
    np.testing.assert_allclose(got["ewma_vol"], want, rtol=1e-7)


@pytest.mark.parametrize("com,span", [(20, 16), (3000, 16), (2, 500)])
def test_ewma_scans_short_spans(spark, com, span):
    """Whatever the decay, however many spans its memory reaches over."""
    rng = np.random.default_rng(5)
    rows = [("x", dt.datetime(1990, 1, 1) + dt.timedelta(minutes=i), None if i % 11 == 3 else float(r)) for i, r in enumerate(rng.normal(0, 0.01, 1500))]
    frame = spark.createDataFrame(rows, "symbol string, ts_init timestamp, ret double")
    got = vol.ewma_vol(frame, com, 60, axis=Axis(step=60, block_rows=64), span=span).orderBy("ts_init").toPandas()
    want = (got["ret"].ewm(com=com, min_periods=60, ignore_na=True).var(bias=True) * 261) ** 0.5
    np.testing.assert_allclose(got["ewma_vol"], want, rtol=1e-7)


def test_blocks_of_crowded_values_are_even(spark):
    """Nearly all values lie in a 1/4096 of the range."""
    from tidebar.operators.ordered import range_blocks
    from tidebar.operators.roughness import exact_quantile
    from tidebar.operators.scoring import calibration_error

    rng = np.random.default_rng(2)
    u = np.concatenate([0.5 + rng.uniform(size=40_000) / 4096, rng.uniform(size=400)])
    frame = spark.createDataFrame(pd.DataFrame({"k": "x", "pit": u}))
    sizes = range_blocks(frame, "pit").groupBy("__block").count().toPandas()["count"]
    assert len(sizes) == 4 and sizes.max() <= 2 * sizes.median()
    s, i = np.sort(u), np.arange(1, len(u) + 1)
    assert calibration_error(frame).first()[0] == pytest.approx(max((i / len(s) - s).max(), (s - (i - 1) / len(s)).max()), rel=1e-12)
    assert exact_quantile(frame, ["k"], "pit", 0.3, "q").first()["q"] == pytest.approx(np.quantile(u, 0.3), rel=1e-15)


@pytest.mark.parametrize("block", [256, 3])
def test_pair_correlations_by_blocks(spark, block):
    from tidebar.operators.replication import avg_pairwise_corr

    rng = np.random.default_rng(4)
    table = pd.DataFrame(rng.normal(5, 1, (60, 11)), columns=[f"s{i}" for i in range(11)])
    table["flat"] = 2.0
    table[table > 6.2] = np.nan
    table.iloc[30:, 3] = np.nan
    long = table.rename_axis("month").melt(ignore_index=False, var_name="symbol", value_name="leg").dropna().reset_index()
    got = avg_pairwise_corr(spark.createDataFrame(long), 25, block_symbols=block).first()
    c, met = table.corr(min_periods=2).to_numpy(), table.notna().astype(int).T.dot(table.notna().astype(int)).to_numpy()
    good = np.triu((met >= 25) & np.isfinite(c), 1)
    assert got.pairs == good.sum() > 20 and got.avg_corr == pytest.approx(c[good].mean(), rel=1e-9)


def test_asof_backward(spark, bars):
    rng = np.random.default_rng(1)
    marks = [("hot", dt.datetime(2020, 1, 1) + dt.timedelta(days=int(d), hours=12), float(d)) for d in sorted(rng.choice(400, 30, False))]
    right = spark.createDataFrame(marks, "symbol string, ts_init timestamp, v double")
    got = both(bars, lambda d, ax: asof_backward(d, right, ax, ["v"]), ["v"])
    left = got[got.symbol == "hot"][["ts_init"]].astype({"ts_init": "datetime64[us]"})
    want = pd.merge_asof(left, right.toPandas().astype({"ts_init": "datetime64[us]"}), on="ts_init")
    np.testing.assert_allclose(got[got.symbol == "hot"]["v"], want["v"])


def test_one_key_in_many_partitions(bars):
    """A hot key's rows must not land in one window group."""
    from tidebar.operators.roughness import exact_quantile

    counts = bars.withColumn("c", BLOCKED.chunk()).groupBy("symbol", "c").count().agg(F.max("count")).first()[0]
    assert counts <= 16
    got = exact_quantile(bars, ["symbol"], "close", 0.1, "q").toPandas().set_index("symbol")["q"]
    want = bars.groupBy("symbol").agg(F.percentile("close", 0.1).alias("q")).toPandas().set_index("symbol")["q"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), rtol=1e-12)
