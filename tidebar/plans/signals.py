"""Queries over strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel, strategies
from ..operators import volatility as vol
from . import inputs as src
from .features import _RET, _roll, ALIGN
from .inputs import BRAND
from .registry import query

T = "symbol:s ts_init:t target:6"


def _vol(n: int, col: str = "ret") -> str:
    return f"({_roll(f'stddev_samp({col})', n, col)} * sqrt(252))"


QUERY_TREND = BRAND + _RET + f""", m AS (SELECT *, {_roll('avg(close)', 20, 'close')} - {_roll('avg(close)', 60, 'close')} AS gap, {_vol(20)} AS rv FROM r)
SELECT symbol, ts_init, coalesce(sign(gap) * CASE WHEN rv IS NOT NULL THEN least(0.1 / greatest(rv, 1e-6), 5) END, 0) AS target FROM m"""


@query(T, QUERY_TREND)
def trend_following(spark, sf):
    return strategies.trend_following(src.brand_bars(spark, sf))


@query("symbol:s n:i sharpe:6", BRAND + _RET + f""", m AS (SELECT *, {_roll('avg(close)', 20, 'close')} - {_roll('avg(close)', 60, 'close')} AS gap, {_vol(20)} AS rv FROM r),
s AS (SELECT symbol, ts_init, ret, coalesce(sign(gap) * CASE WHEN rv IS NOT NULL THEN least(0.1 / greatest(rv, 1e-6), 5) END, 0) AS target FROM m),
e AS (SELECT symbol, ret * lag(target) OVER (PARTITION BY symbol ORDER BY ts_init) AS x FROM s)
SELECT symbol, count(x) AS n, CASE WHEN count(x) < 2 OR coalesce(stddev_samp(x), 0) = 0 THEN 0 ELSE avg(x) / stddev_samp(x) * sqrt(252) END AS sharpe FROM e GROUP BY symbol""")
def trend_following_sharpe(spark, sf):
    """Sharpe ratio per brand of holding the trend target: the first end-to-end query."""
    from ..operators.ordered import DAILY, over_rows
    from ..operators.walkforward import sharpe

    held = strategies.trend_following(src.brand_bars(spark, sf))
    earned = over_rows(
        held, DAILY,
        lambda df, w: df.withColumn("x", F.lag("target").over(w) * (F.col("close") / F.lag("close").over(w) - 1)), before=1,
    )
    return earned.groupBy("symbol").agg(F.count("x").alias("n"), sharpe(F.col("x")).alias("sharpe"))


def tsm_sql(freq: int) -> str:
    base = BRAND + _RET + f""", m AS (SELECT *, lag(close, 5) OVER w / lag(close, 65) OVER w - 1 AS mom, {_vol(20)} AS rv,
 row_number() OVER w - 1 AS i FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts_init)),
 p AS (SELECT *, sign(mom) * CASE WHEN rv IS NOT NULL THEN least(0.1 / greatest(rv, 1e-6), 2) END AS raw FROM m)"""
    if freq == 1:
        return base + " SELECT symbol, ts_init, coalesce(raw, 0) AS target FROM p"
    return base + f""" SELECT symbol, ts_init, coalesce(first_value(raw IGNORE NULLS) OVER (PARTITION BY symbol, i // {freq} ORDER BY ts_init
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS target FROM p"""


QUERY_MOMENTUM = tsm_sql(1)


@query(T, QUERY_MOMENTUM)
def ts_momentum(spark, sf):
    return strategies.ts_momentum(src.brand_bars(spark, sf), 60, 5, vol_lookback=20)


@query(T, tsm_sql(21))
def ts_momentum_rebal(spark, sf):
    return strategies.ts_momentum(src.brand_bars(spark, sf), 60, 5, vol_lookback=20, rebal_freq=21)


QUERY_REVERSION = BRAND + _RET + f""", f AS (SELECT symbol, ts_init, coalesce(ret, 0) AS x FROM r),
z AS (SELECT *, (x - {_roll('avg(x)', 20, 'x')}) / greatest({_roll('stddev_samp(x)', 20, 'x')}, 1e-9) AS z,
 coalesce(CASE WHEN {_vol(20, 'x')} IS NOT NULL THEN greatest({_vol(20, 'x')}, 1e-6) END, 1.0) AS v FROM f),
s AS (SELECT *, CASE WHEN z IS NULL THEN 0.0 WHEN abs(z) > 2 THEN -sign(z) * least(0.1 / v, 3) WHEN abs(z) < 0.5 THEN 0.0 END AS said FROM z)
SELECT symbol, ts_init, coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_init), 0) AS target FROM s"""


@query(T, QUERY_REVERSION)
def mean_reversion(spark, sf):
    return strategies.mean_reversion(src.brand_bars(spark, sf))


_PRET = ALIGN + ", r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS ret FROM panel)"


def xsm_sql(lookback: int) -> str:
    return BRAND + _PRET + f""", m AS (SELECT *, lag(close, 5) OVER w / lag(close, {lookback + 5}) OVER w - 1 AS mom,
 CASE WHEN t < 20 THEN 0.2 ELSE greatest(stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING) * sqrt(252), 1e-6) END AS v
 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY t)),
cuts AS (SELECT t, quantile_cont(mom, 0.75) AS hi, quantile_cont(mom, 0.25) AS lo FROM m WHERE t >= {lookback + 5} AND (t - {lookback + 5}) % 21 = 0 GROUP BY t HAVING count(mom) >= 2),
j AS (SELECT m.*, CASE WHEN cuts.t IS NULL THEN NULL WHEN mom >= hi THEN least(0.1 / v, 2) WHEN mom <= lo THEN -least(0.1 / v, 2) ELSE 0 END AS fresh
 FROM m LEFT JOIN cuts USING (t)),
h AS (SELECT symbol, ts_init, real, coalesce(last_value(fresh IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t), 0) AS x FROM j),
e AS (SELECT *, lead(ts_init) OVER (PARTITION BY symbol ORDER BY ts_init) IS NULL AS gone FROM h WHERE real)
SELECT symbol, ts_init, CASE WHEN gone AND ts_init < (SELECT max(ts_init) FROM e) THEN 0 ELSE x END AS target FROM e"""


@query(T, xsm_sql(60))
def xs_momentum(spark, sf):
    return strategies.compute_targets(
        src.brand_bars(spark, sf), strategies.xs_momentum, multi_asset=True, lookback=60, skip_recent=5, vol_lookback=20
    )


# Features for the carry and basis signals, taken from the bars themselves.
_FEAT = """, fb AS (SELECT symbol, ts_init, high / low - 1 AS carry, open / close - 1 AS second_return FROM bars),
fp AS (SELECT r.*, 'class ' || substr(r.symbol, 7, 1) AS peer, last_value(fb.carry IGNORE NULLS) OVER w AS carry,
 last_value(fb.second_return IGNORE NULLS) OVER w AS second_return
 FROM r LEFT JOIN fb ON fb.symbol = r.symbol AND fb.ts_init = r.ts_init WINDOW w AS (PARTITION BY r.symbol ORDER BY r.t))"""


def featured(spark, sf):
    bars = src.brand_bars(spark, sf).withColumns(
        {"carry": F.col("high") / F.col("low") - 1, "second_return": F.col("open") / F.col("close") - 1}
    )
    return panel.align_union(bars).withColumn("peer", F.concat(F.lit("class "), F.substring("symbol", 7, 1)))


def _nan(col: str, n: int, k: int, alias: str) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY t ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({col}) {w} >= {k} THEN avg({col}) {w} END AS {alias}"


@query("symbol:s ts_init:t carry_signal:1", BRAND + _PRET + _FEAT + f""", s AS (SELECT *, {_nan('carry', 40, 10, 'sm')} FROM fp)
SELECT symbol, ts_init, coalesce(sign(CASE WHEN count(sm) OVER p >= 2 THEN round(sm - avg(sm) OVER p, 12) END), 0) AS carry_signal FROM s WINDOW p AS (PARTITION BY t, peer)""")
def relative_carry(spark, sf):
    return strategies.relative_carry(featured(spark, sf), 40)


_BASIS = f""", l AS (SELECT *, CASE WHEN ret > -1 THEN ln(1 + ret) END AS ln, CASE WHEN second_return > -1 THEN ln(1 + second_return) END AS lf FROM fp),
a AS (SELECT *, {_nan('ln', 40, 32, 'mn')}, {_nan('lf', 40, 32, 'mf')} FROM l),
b AS (SELECT *, CASE WHEN peer IN ('class 1', 'class 2') THEN (exp(mn * 40) - 1) - (exp(mf * 40) - 1) END AS sc FROM a),
c AS (SELECT *, count(sc) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY sc ASC NULLS LAST, symbol) AS up FROM b),
basis AS (SELECT *, CASE WHEN sc IS NULL OR n < 3 THEN 0 WHEN up > n - greatest(1, floor(n / 3.0)) THEN 1 WHEN up <= greatest(1, floor(n / 3.0)) THEN -1 ELSE 0 END AS basis_signal FROM c)"""


@query("symbol:s ts_init:t basis_signal:1", BRAND + _PRET + _FEAT + _BASIS + " SELECT * FROM basis")
def basis_momentum(spark, sf):
    return strategies.basis_momentum(featured(spark, sf), 40, ("class 1", "class 2"))


_TC = f""", tc AS (SELECT *, coalesce(sign(close / lag(close, 60) OVER (PARTITION BY symbol ORDER BY t) - 1), 0) AS trend, {_nan('carry', 40, 10, 'sm')},
 CASE WHEN count(ret) OVER v >= 20 THEN least(0.4 / greatest(stddev_samp(ret) OVER v * sqrt(252), 0.02), 50) END AS lev
 FROM basis WINDOW v AS (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING)),
tr AS (SELECT *, coalesce(sign(CASE WHEN count(sm) OVER p >= 2 THEN sm - avg(sm) OVER p END), 0) AS rel FROM tc WINDOW p AS (PARTITION BY t, peer)),
td AS (SELECT *, coalesce((0.5 * trend + 0.5 * rel + 0.5 * basis_signal) * lev, 0) AS daily FROM tr),
tp AS (SELECT *, avg(daily) OVER (PARTITION BY symbol ORDER BY t ROWS 9 PRECEDING) AS pos FROM td)"""
_TC_ARGS = dict(lookback=60, carry_weight=0.5, carry_smooth=40, vol_target=0.40, vol_lookback=20, rebal_freq=10,
                basis_weight=0.5, basis_lookback=40, basis_groups=("class 1", "class 2"))


@query(T, BRAND + _PRET + _FEAT + _BASIS + _TC + " SELECT symbol, ts_init, pos AS target FROM tp")
def trend_carry(spark, sf):
    return strategies.trend_carry(featured(spark, sf), **_TC_ARGS)


@query(T, BRAND + _PRET + _FEAT + _BASIS + _TC + """, past AS (SELECT p.t, p.symbol, p.pos * coalesce(q.ret, 0) AS x, q.t AS u FROM tp p JOIN tp q
  ON p.symbol = q.symbol AND q.t BETWEEN p.t - 19 AND p.t WHERE p.t >= 20),
slot AS (SELECT t, u, sum(x) AS x FROM past GROUP BY t, u),
dense AS (SELECT c.t, c.t - k AS u FROM (SELECT DISTINCT t FROM tp WHERE t >= 20) c, range(20) g(k)),
vols AS (SELECT d.t, stddev_samp(coalesce(s.x, 0)) / (SELECT count(DISTINCT symbol) FROM bars) * sqrt(252) AS v FROM dense d LEFT JOIN slot s USING (t, u) GROUP BY d.t)
SELECT symbol, ts_init, pos * CASE WHEN v > 0 THEN least(0.1 / v, 2) ELSE 1 END AS target FROM tp LEFT JOIN vols USING (t)""")
def portfolio_scale(spark, sf):
    """Trend, carry and basis-momentum with the book scaled to a volatility target."""
    return strategies.trend_carry(featured(spark, sf), **_TC_ARGS, portfolio_vol_target=0.1, cov_lookback=20)


@query(T, BRAND + _PRET + """ SELECT symbol, ts_init, CASE WHEN peer = 'class 1' THEN greatest(x, 0) ELSE x END AS target FROM
 (SELECT symbol, ts_init, 'class ' || substr(symbol, 7, 1) AS peer, coalesce(sign(close / lag(close, 60) OVER (PARTITION BY symbol ORDER BY t) - 1), 0) AS x FROM panel)""")
def trend_sign_long_only(spark, sf):
    return strategies.trend_sign(featured(spark, sf), 60, long_only=("class 1",), out="target")


@query(T, BRAND + _RET + f" SELECT symbol, ts_init, coalesce(least(0.4 / greatest({_vol(63)}, 0.02), 50) , 0) * ({_vol(63)} IS NOT NULL)::INT AS target FROM r")
def vol_leverage(spark, sf):
    return strategies.vol_leverage(src.brand_bars(spark, sf), 0.4, 63, 0.02, 50.0, out="target")


@query("symbol:s ts_init:t target:11", BRAND + " SELECT symbol, ts_init, CASE WHEN abs(x) > 1e300 OR x IS NULL THEN 0 ELSE x END AS target FROM (SELECT symbol, ts_init, CASE WHEN volume < 20 THEN NULL WHEN volume > 60 THEN 'inf'::DOUBLE ELSE close / 1000 END AS x FROM bars)")
def clean_signal(spark, sf):
    v = F.col("volume")
    raw = F.when(v < 20, F.lit(float("nan"))).when(v > 60, F.lit(float("inf"))).otherwise(F.col("close") / 1000)
    return strategies.clean_signal(src.brand_bars(spark, sf).withColumn("target", raw))


def _buy_strength(frame):
    """A user's own pandas strategy: long above the mean of the closes so far."""
    return (frame["close"] > frame["close"].expanding().mean()).astype(float)


@query(T, BRAND + " SELECT symbol, ts_init, CASE WHEN close > avg(close) OVER (PARTITION BY symbol ORDER BY ts_init) THEN 1 ELSE 0 END AS target FROM bars")
def pandas_strategy(spark, sf):
    return strategies.pandas_strategy(src.brand_bars(spark, sf), _buy_strength)
