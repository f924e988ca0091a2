"""Queries over resampling, cleaning, volatility and panel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, panel, resample
from ..operators import volatility as vol
from ..operators.ordered import Axis, over_rows, row_index
from . import inputs as src
from .inputs import BRAND, REGION, EVENTS, EVENTS_15M, EVENTS_1M, HOURLY, ORDERS
from .registry import query

OHLCV = "symbol:s ts_event:t ts_init:t open:4 high:4 low:4 close:4 volume:2"


@query(OHLCV, EVENTS + " SELECT * FROM bars")
def bars_hourly(spark, sf):
    return src.event_bars(spark, sf)


@query(OHLCV, ORDERS + " SELECT * FROM bars")
def bars_daily(spark, sf):
    return src.order_bars(spark, sf)


@query("symbol:s ts_event:t ts_init:t open:8 high:8 low:8 close:8 volume:2", BRAND + " SELECT * FROM bars")
def bars_universe(spark, sf):
    return src.brand_bars(spark, sf)


def _resampled(hours: int) -> str:
    return f""", x AS (SELECT symbol, time_bucket(INTERVAL {hours} HOUR, ts_event, TIMESTAMP '1970-01-01') AS b, * EXCLUDE (symbol) FROM bars)
SELECT symbol, b AS ts_event, b + INTERVAL {hours} HOUR AS ts_init, arg_min(open, ts_event) AS open, max(high) AS high,
 min(low) AS low, arg_max(close, ts_event) AS close, sum(volume) AS volume FROM x GROUP BY symbol, b"""


@query(OHLCV, EVENTS_15M + _resampled(1))
def resample_15m_1h(spark, sf):
    return resample.resample_bars(src.event_bars(spark, sf, 900), 3600)


@query(OHLCV, EVENTS + _resampled(24))
def resample_1h_1d(spark, sf):
    return resample.resample_bars(src.event_bars(spark, sf), 86_400)


# Errors planted by position so that both engines agree on them.
_PLANT = """, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_init) - 1 AS i FROM bars),
planted AS (SELECT symbol, ts_event, ts_init,
  CASE WHEN i % 11 = 3 THEN -open ELSE open END AS open, CASE WHEN i % 13 = 5 THEN high / 4 ELSE high END AS high,
  CASE WHEN i % 17 = 7 THEN 0 ELSE low END AS low, CASE WHEN i % 19 = 9 THEN -close ELSE close END AS close, volume FROM x)"""


def _planted(bars):
    i = F.col("i")
    x = row_index(bars, Axis(), "i")
    return x.withColumns(
        {
            "open": F.when(i % 11 == 3, -F.col("open")).otherwise(F.col("open")),
            "high": F.when(i % 13 == 5, F.col("high") / 4).otherwise(F.col("high")),
            "low": F.when(i % 17 == 7, F.lit(0.0)).otherwise(F.col("low")),
            "close": F.when(i % 19 == 9, -F.col("close")).otherwise(F.col("close")),
        }
    ).drop("i")


@query(OHLCV, ORDERS + _PLANT + """, o AS (SELECT * REPLACE (CASE WHEN open <= 0 THEN close ELSE open END AS open) FROM planted WHERE close > 0)
SELECT * REPLACE (greatest(high, open, close) AS high, CASE WHEN low <= 0 THEN least(open, close) ELSE low END AS low) FROM o""")
def repair_prices(spark, sf):
    return clean.repair_prices(_planted(src.order_bars(spark, sf)))


@query(OHLCV, ORDERS + """, x AS (SELECT *, lag(close) OVER w AS p, lead(close) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_init))
SELECT * EXCLUDE (p, n) FROM x WHERE NOT coalesce((close > p * 3 AND close > n * 3) OR (close < p / 3 AND close < n / 3), false)""")
def drop_scale_glitches(spark, sf):
    return clean.drop_scale_glitches(src.order_bars(spark, sf))


@query(OHLCV, ORDERS + " SELECT * FROM bars WHERE isodow(ts_event) <= 5")
def weekday_filter(spark, sf):
    return clean.weekday_filter(src.order_bars(spark, sf))


@query("symbol:s ts_event:t ts_init:t close:4 volume:2", EVENTS + """ SELECT symbol, CAST(date_trunc('day', ts_event) AS TIMESTAMP) AS ts_event,
 CAST(date_trunc('day', ts_event) AS TIMESTAMP) + INTERVAL 1 DAY AS ts_init, close, volume FROM bars WHERE volume > 1""")
def midnight_sessions(spark, sf):
    bars = src.event_bars(spark, sf)
    return clean.midnight_sessions(clean.drop_untraded(bars.withColumn("volume", F.col("volume") - 1)).withColumn("volume", F.col("volume") + 1))


def _roll(expr: str, n: int, col: str) -> str:
    return f"CASE WHEN count({col}) OVER (PARTITION BY symbol ORDER BY ts_init ROWS {n - 1} PRECEDING) >= {n} THEN {expr} OVER (PARTITION BY symbol ORDER BY ts_init ROWS {n - 1} PRECEDING) END"


def _root(v: str) -> str:
    return f"sqrt(CASE WHEN ({v}) < 0 THEN 0 ELSE ({v}) END * 252)"


_RET = ", r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_init) - 1 AS ret FROM bars)"
_LOGS = """, g AS (SELECT *, pow(ln(high / low), 2) AS hl, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS gk,
 ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(close / open) AS oc,
 ln(open / lag(close) OVER (PARTITION BY symbol ORDER BY ts_init)) AS onr FROM bars)"""


@query("symbol:s ts_init:t realised_vol:6", BRAND + _RET + f" SELECT symbol, ts_init, {_roll('stddev_samp(ret)', 20, 'ret')} * sqrt(252) AS realised_vol FROM r")
def realised_vol(spark, sf):
    return vol.realised_vol(src.brand_bars(spark, sf), 20)


@query("symbol:s ts_init:t z:6", BRAND + _RET + f", f AS (SELECT *, coalesce(ret, 0) AS x FROM r) SELECT symbol, ts_init, (x - {_roll('avg(x)', 60, 'x')}) / greatest({_roll('stddev_samp(x)', 60, 'x')}, 1e-9) AS z FROM f")
def zscore(spark, sf):
    bars = vol.with_returns(src.brand_bars(spark, sf)).fillna(0.0, ["ret"])
    return vol.zscore(bars, "ret", 60)


@query("symbol:s ts_init:t parkinson_vol:6", EVENTS + _LOGS + f" SELECT symbol, ts_init, {_root(_roll('avg(hl)', 20, 'hl') + ' / (4 * ln(2))')} AS parkinson_vol FROM g")
def parkinson(spark, sf):
    return vol.parkinson_vol(src.event_bars(spark, sf), 20, axis=HOURLY)


@query("symbol:s ts_init:t garman_klass_vol:6", EVENTS + _LOGS + f" SELECT symbol, ts_init, {_root(_roll('avg(gk)', 20, 'gk'))} AS garman_klass_vol FROM g")
def garman_klass(spark, sf):
    return vol.garman_klass_vol(src.event_bars(spark, sf), 20, axis=HOURLY)


@query("symbol:s ts_init:t rogers_satchell_vol:6", EVENTS + _LOGS + f" SELECT symbol, ts_init, {_root(_roll('avg(rs)', 20, 'rs'))} AS rogers_satchell_vol FROM g")
def rogers_satchell(spark, sf):
    return vol.rogers_satchell_vol(src.event_bars(spark, sf), 20, axis=HOURLY)


_YZ = 0.34 / (1.34 + 21 / 19)


@query("symbol:s ts_init:t yang_zhang_vol:6", EVENTS + _LOGS + f" SELECT symbol, ts_init, {_root(_roll('var_samp(onr)', 20, 'onr') + f" + {_YZ!r} * " + _roll('var_samp(oc)', 20, 'oc') + f" + {1 - _YZ!r} * " + _roll('avg(rs)', 20, 'rs'))} AS yang_zhang_vol FROM g")
def yang_zhang(spark, sf):
    return vol.yang_zhang_vol(src.event_bars(spark, sf), 20, axis=HOURLY)


@query("symbol:s ts_init:t momentum:6", BRAND + " SELECT symbol, ts_init, lag(close, 5) OVER w / lag(close, 65) OVER w - 1 AS momentum FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_init)")
def momentum_return(spark, sf):
    return vol.momentum_return(src.brand_bars(spark, sf), 60, 5)


@query("symbol:s ts_init:t smooth:6", BRAND + _RET + """ SELECT symbol, ts_init, CASE WHEN count(x) OVER w >= 5 THEN avg(x) OVER w END AS smooth
 FROM (SELECT *, CASE WHEN abs(ret) < 0.5 THEN ret END AS x FROM r) WINDOW w AS (PARTITION BY symbol ORDER BY ts_init ROWS 19 PRECEDING)""")
def rolling_nanmean(spark, sf):
    bars = vol.with_returns(src.brand_bars(spark, sf)).withColumn("x", F.when(F.abs("ret") < 0.5, F.col("ret")))
    return vol.rolling_nanmean(bars, {"smooth": "x"}, 20, 5)


@query("symbol:s ts:t ret:6", BRAND + _RET + " SELECT symbol, date_trunc('day', ts_init) - INTERVAL 1 DAY AS ts, ret FROM r WHERE ret IS NOT NULL")
def bar_returns(spark, sf):
    return vol.bar_returns(src.brand_bars(spark, sf))


_TINY = ", s AS (SELECT symbol, ts_init AS ts, ret / 10000 AS ret FROM r WHERE ret IS NOT NULL)"


@query("symbol:s ts:t equity:6 drawdown:6", BRAND + _RET + _TINY + """, e AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS equity FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, equity, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS drawdown FROM e""")
def drawdown(spark, sf):
    bars = vol.with_returns(src.brand_bars(spark, sf)).where("ret IS NOT NULL")
    return vol.drawdown(bars.select("symbol", F.col("ts_init").alias("ts"), (F.col("ret") / 10000).alias("ret")), Axis(order="ts"))


_EW = ", ".join(f"{a} OVER (PARTITION BY symbol ORDER BY ts_init) AS {b}" for a, b in (("sum(w)", "sw"), ("sum(w * ret)", "sx"), ("sum(w * ret * ret)", "sxx"), ("count(ret)", "n")))


@query("symbol:s ts_init:t ewma_vol:6", ORDERS + _RET + f""", k AS (SELECT *, count(ret) OVER (PARTITION BY symbol ORDER BY ts_init) AS i FROM r),
v AS (SELECT *, CASE WHEN ret IS NOT NULL THEN pow(61.0 / 60.0, i) END AS w FROM k), c AS (SELECT symbol, ts_init, {_EW} FROM v)
SELECT symbol, ts_init, CASE WHEN n >= 60 THEN sqrt(greatest(sxx / sw - pow(sx / sw, 2), 0) * 261) END AS ewma_vol FROM c""")
def ewma_vol(spark, sf):
    return vol.ewma_vol(vol.with_returns(src.order_bars(spark, sf)))


@query("symbol:s ts_init:t carry:6", ORDERS + """ SELECT symbol, ts_init, ((high - close) / greatest(close, 1e-9)) / greatest((1 + dayofyear(ts_event) % 90) / 365.0, 1e-3) AS carry FROM bars""")
def futures_carry_simple(spark, sf):
    bars = src.order_bars(spark, sf).withColumns(
        {"front": F.col("close"), "back": F.col("high"), "days": 1 + F.dayofyear("ts_event") % 90}
    )
    return vol.futures_carry_simple(bars)


# -- panel ---------------------------------------------------------------------

ALIGN = """, cal AS (SELECT ts_init, row_number() OVER (ORDER BY ts_init) - 1 AS t FROM (SELECT DISTINCT ts_init FROM bars)),
life AS (SELECT symbol, min(ts_init) AS f, max(ts_init) AS l FROM bars GROUP BY symbol),
panel AS (SELECT c.t, c.ts_init, life.symbol, b.close IS NOT NULL AS real,
  last_value(b.close IGNORE NULLS) OVER (PARTITION BY life.symbol ORDER BY c.t) AS close, coalesce(b.volume, 0) AS volume
  FROM life JOIN cal c ON c.ts_init BETWEEN life.f AND life.l LEFT JOIN bars b ON b.symbol = life.symbol AND b.ts_init = c.ts_init)"""


@query("symbol:s ts_init:t t:i real:b close:8 volume:2", BRAND + ALIGN + " SELECT * FROM panel")
def align_union(spark, sf):
    return panel.align_union(src.brand_bars(spark, sf))


@query("symbol:s ts_init:t real:b close:4", EVENTS_1M + ALIGN + " SELECT * FROM panel")
def align_union_minutes(spark, sf):
    """Minute bars: the axis is long, so ordering runs in blocks."""
    return panel.align_union(src.event_bars(spark, sf, 60), Axis(step=60, block_rows=1024))


@query("symbol:s ts_init:t realised_vol:6", EVENTS_1M + _RET + f" SELECT symbol, ts_init, {_roll('stddev_samp(ret)', 20, 'ret')} * sqrt(252) AS realised_vol FROM r")
def realised_vol_minutes(spark, sf):
    return vol.realised_vol(src.event_bars(spark, sf, 60), 20, axis=Axis(step=60, block_rows=1024))


@query("symbol:s ts_init:t row_idx:i", EVENTS_1M + " SELECT symbol, ts_init, row_number() OVER (PARTITION BY symbol ORDER BY ts_init) - 1 AS row_idx FROM bars")
def row_index_minutes(spark, sf):
    return row_index(src.event_bars(spark, sf, 60), Axis(step=60, block_rows=1024))


@query("symbol:s ts_init:t target:8", BRAND + """, e AS (SELECT symbol, ts_init, close AS target, lead(ts_init) OVER (PARTITION BY symbol ORDER BY ts_init) IS NULL AS lastbar FROM bars)
SELECT symbol, ts_init, CASE WHEN lastbar AND ts_init < (SELECT max(ts_init) FROM bars) AND (SELECT count(DISTINCT symbol) FROM bars) >= 2 THEN 0 ELSE target END AS target FROM e""")
def exit_delisted(spark, sf):
    return panel.exit_delisted(src.brand_bars(spark, sf).withColumn("target", F.col("close")))


@query("ts_init:t n_symbols:i", REGION + " SELECT ts_init, count(DISTINCT symbol) AS n_symbols FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)")
def common_calendar(spark, sf):
    return panel.common_calendar(src.region_bars(spark, sf))


@query("ts_init:t n_bars:i", BRAND + " SELECT ts_init, count(*) AS n_bars FROM bars GROUP BY 1")
def universe_size(spark, sf):
    return panel.universe_size(src.brand_bars(spark, sf))


@query("symbol:s first:t last:t bars:i zero_volume:i", BRAND + " SELECT symbol, min(ts_init) AS first, max(ts_init) AS last, count(*) AS bars, count_if(volume <= 40) AS zero_volume FROM bars GROUP BY 1")
def data_summary(spark, sf):
    return panel.data_summary(src.brand_bars(spark, sf).withColumn("volume", F.col("volume") - 40))


_MERGED = BRAND + ", o AS (SELECT o_orderpriority AS symbol, o_orderdate + INTERVAL 1 DAY AS ts_init, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2), m AS (SELECT symbol, ts_init, close FROM bars UNION ALL SELECT * FROM o)"


@query("symbol:s ts_init:t close:8", _MERGED + " SELECT * FROM m WHERE symbol <> 'Brand#1' AND ts_init >= TIMESTAMP '1997-01-01' AND ts_init <= TIMESTAMP '1998-12-31'")
def merge_select_window(spark, sf):
    brands, orders = src.brand_bars(spark, sf), src.order_bars(spark, sf)
    both = panel.merge_disjoint(brands, orders)
    wanted = both.select("symbol").distinct().where("symbol <> 'Brand#1'")
    picked = panel.select_symbols(both, wanted)
    seen = panel.signal_window(picked, F.to_timestamp(F.lit("1998-12-31")))
    return panel.replay_window(seen, F.to_timestamp(F.lit("1997-01-01")), F.to_timestamp(F.lit("1998-12-31")))


@query("symbol:s", BRAND + " SELECT DISTINCT p_type AS symbol FROM part UNION SELECT DISTINCT p_brand FROM part EXCEPT SELECT DISTINCT symbol FROM bars")
def missing_symbols(spark, sf):
    part = src.table(spark, sf, "part")
    configured = part.select(F.col("p_type").alias("symbol")).union(part.select("p_brand"))
    return panel.missing_symbols(configured, src.brand_bars(spark, sf))
