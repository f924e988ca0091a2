"""Queries over roughness, scoring, monthly studies, options and membership."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import black76
from ..functions.normal import cdf_sql, pdf_sql
from ..operators import options, replication, roughness, scoring, universe
from ..operators import volatility as vol
from ..operators.ordered import Axis
from ..session import checkpoint_dir
from ..sources import bars as store
from . import inputs as src
from .features import _LOGS, _RET
from .inputs import BRAND, EVENTS, HOURLY
from .registry import query

# -- roughness ---------------------------------------------------------------------

_RV = _LOGS + """, fq AS (SELECT symbol, greatest(quantile_cont(rs, 0.01) FILTER (rs > 0), 1e-12) AS f FROM g GROUP BY symbol),
lv AS (SELECT g.symbol, g.ts_init, ln(greatest(coalesce(rs, 0), f)) AS log_rv FROM g JOIN fq USING (symbol))"""


def log_rv(spark, sf):
    return roughness.log_variance_proxy(src.event_bars(spark, sf), axis=HOURLY)


@query("symbol:s ts_init:t log_rv:6", EVENTS + _RV + " SELECT * FROM lv")
def log_variance_proxy(spark, sf):
    return log_rv(spark, sf)


@query("symbol:s ts_init:t log_rv:6", EVENTS + _RV + " SELECT * FROM lv")
def log_variance_proxy_long_axis(spark, sf):
    """The same with the plan used for long series (quantile by counted bins)."""
    return roughness.log_variance_proxy(src.event_bars(spark, sf), axis=Axis(step=3600, max_rows=1, block_rows=256))


_JUMP = _RET + """, rr AS (SELECT * FROM r WHERE ret IS NOT NULL), jp AS (SELECT *, abs(ret) * abs(lag(ret) OVER (PARTITION BY symbol ORDER BY ts_init)) AS p FROM rr),
jr AS (SELECT symbol, sum(ret * ret) AS rv, coalesce(sum(p), 0) * pi() / 2 AS bv FROM jp GROUP BY symbol),
jz AS (SELECT *, CASE WHEN rv > 0 THEN greatest(0, 1 - bv / rv) ELSE 0 END AS jump_ratio FROM jr)"""


@query("symbol:s rv:2 bv:2 jump_ratio:6", BRAND + _JUMP + " SELECT * FROM jz")
def jump_ratio(spark, sf):
    return roughness.jump_ratio(vol.with_returns(src.brand_bars(spark, sf)))


def _vario(rows: str, keys: str) -> str:
    """Variogram CTEs ``lg`` (wanted lags) and ``vg`` over rows (keys, i, x)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f""", nl AS (SELECT {keys}, count(*) AS n FROM {rows} GROUP BY {keys}),
lg AS (SELECT DISTINCT {keys}, CAST(round_even(pow(10, k * (log10(least(n // 4, 64)) / 19)), 0) AS BIGINT) AS lag FROM nl, range(20) r(k)),
vg AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, l.lag, avg(pow(abs(a.x - b.x), 2)) AS m FROM {rows} a JOIN {rows} b ON {on} AND a.i > b.i AND a.i - b.i <= 64
  JOIN lg l ON {' AND '.join(f'l.{k.strip()} = a.{k.strip()}' for k in keys.split(','))} AND l.lag = a.i - b.i GROUP BY ALL)"""


_SER = _RV + ", se AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts_init) - 1 AS i, log_rv AS x FROM lv)"


@query("symbol:s lag:i m:6", EVENTS + _SER + _vario("se", "symbol") + " SELECT * FROM vg")
def variogram(spark, sf):
    return roughness.variogram(log_rv(spark, sf), HOURLY, value="log_rv")


@query("symbol:s hurst:6", EVENTS + _SER + _vario("se", "symbol") + " SELECT symbol, CASE WHEN count_if(m > 0) < 2 THEN 0.5 ELSE regr_slope(ln(m), ln(lag)) FILTER (m > 0) / 2 END AS hurst FROM vg GROUP BY symbol")
def hurst(spark, sf):
    return roughness.hurst_exponent(roughness.variogram(log_rv(spark, sf), HOURLY, value="log_rv"), ["symbol"])


def _fit_sql(keys: str, tail: str) -> str:
    """Grid fit of c (lag^2H + rho) in logs, the same search as the operator's."""
    on = " AND ".join(f"b.{k.strip()} = vg.{k.strip()}" for k in keys.split(","))
    ks = ", ".join("vg." + k.strip() for k in keys.split(","))
    parts, prev = [], None
    dh, fr = 0.998 / 24, (1e10) ** (1 / 24)
    for stage in range(4):
        if prev is None:
            h0, h1, r0, r1, join = "0.001", "0.999", "1e-6", "1e4", ""
        else:
            h0, h1 = f"greatest(0.001, b.h - {dh!r})", f"least(0.999, b.h + {dh!r})"
            r0, r1, join = f"(b.rho / {fr!r})", f"greatest(b.rho * {fr!r}, 2e-6)", f" JOIN {prev} b ON {on}"
            dh, fr = dh / 8, fr ** (1 / 8)
        parts.append(f""", c{stage} AS (SELECT {ks}, least(0.999, greatest(0.001, {h0} + ({h1} - {h0}) * i / 24)) AS h,
 CASE WHEN {r0} <= 1e-6 AND j = 0 THEN 0.0::DOUBLE ELSE exp(ln(greatest({r0}, 1e-6)) + (ln({r1}) - ln(greatest({r0}, 1e-6))) * j / 24) END AS rho, vg.lag, vg.m FROM vg{join}, range(25) a(i), range(25) d(j) WHERE vg.m > 0),
e{stage} AS (SELECT {keys}, h, rho, var_pop(ln(m) - ln(pow(lag, 2 * h) + rho)) * count(*) AS sse, avg(ln(m) - ln(pow(lag, 2 * h) + rho)) AS log_c FROM c{stage} GROUP BY {keys}, h, rho),
b{stage} AS (SELECT {keys}, arg_min(h, row(round(sse, 12), h, rho)) AS h, arg_min(rho, row(round(sse, 12), h, rho)) AS rho, arg_min(log_c, row(round(sse, 12), h, rho)) AS log_c FROM e{stage} GROUP BY {keys})""")
        prev = f"b{stage}"
    return "".join(parts) + f""", nv AS (SELECT {keys}, count_if(m > 0) AS points, min(lag) FILTER (m > 0) AS lag0, CASE WHEN count_if(m > 0) < 2 THEN 0.5 ELSE regr_slope(ln(m), ln(lag)) FILTER (m > 0) / 2 END AS naive FROM vg GROUP BY {keys}),
fit AS (SELECT nv.*, naive AS hurst_naive, CASE WHEN points >= 4 THEN h ELSE naive END AS hurst, CASE WHEN points >= 4 THEN rho / (pow(lag0, 2 * h) + rho) ELSE 0 END AS noise_share,
 CASE WHEN points >= 4 THEN sqrt(rho * exp(log_c) / 2) ELSE 0 END AS noise_std, points >= 4 AS converged FROM nv LEFT JOIN {prev} USING ({keys})){tail}"""


@query("symbol:s hurst_naive:6 hurst:2 noise_share:2 noise_std:2 converged:b", EVENTS + _SER + _vario("se", "symbol") + _fit_sql("symbol", " SELECT * FROM fit"))
def hurst_nugget(spark, sf):
    return roughness.hurst_with_nugget(roughness.variogram(log_rv(spark, sf), HOURLY, value="log_rv"), ["symbol"])


_FOLDED = _SER + """, sn AS (SELECT symbol, count(*) AS n FROM se GROUP BY symbol), sd AS (SELECT symbol, ntile(2) OVER (PARTITION BY symbol ORDER BY i) - 1 AS fold, i, x FROM se)"""


@query("symbol:s n:i mean_hurst:2 mean_noise_share:2 jump_fraction:6 verdict:s", EVENTS + _JUMP + _FOLDED + _vario("sd", "symbol, fold") + _fit_sql("symbol, fold", """, ga AS (SELECT symbol, avg(hurst) AS mean_hurst, stddev_samp(hurst) AS std_hurst, avg(noise_share) AS mean_noise_share FROM fit GROUP BY symbol)
SELECT sn.symbol, sn.n, mean_hurst, mean_noise_share, jump_ratio AS jump_fraction, CASE WHEN sn.n < 500 THEN 'insufficient_data' WHEN jump_ratio > 0.3 THEN 'jump_dominated' WHEN mean_noise_share > 0.5 THEN 'noise_dominated'
 WHEN std_hurst > 0.1 THEN 'unstable' WHEN mean_hurst <= 0.25 THEN 'rough' WHEN mean_hurst >= 0.4 THEN 'markovian' ELSE 'intermediate' END AS verdict FROM sn JOIN ga USING (symbol) JOIN jz USING (symbol)"""))
def roughness_gate(spark, sf):
    series = log_rv(spark, sf).withColumn("x", F.col("log_rv"))
    returns = vol.with_returns(src.event_bars(spark, sf), HOURLY)
    return roughness.roughness_gate(series, returns, 2, HOURLY)


_OU = _RV + """, pv AS (SELECT symbol, log_rv AS y, lag(log_rv) OVER (PARTITION BY symbol ORDER BY ts_init) AS p FROM lv),
om AS (SELECT symbol, covar_pop(p, y) AS cov, var_pop(p) AS vx, var_pop(y) AS vy, avg(p) AS mx, avg(y) AS my, stddev_samp(y - p) AS sd FROM pv WHERE p IS NOT NULL GROUP BY symbol),
oo AS (SELECT *, cov / vx AS b, cov / vx > 0 AND cov / vx < 1 AS ok FROM om),
op AS (SELECT *, CASE WHEN ok THEN -ln(b) * 252 ELSE 0 END AS kappa, CASE WHEN ok THEN (my - b * mx) / (1 - b) ELSE mx END AS theta FROM oo),
oz AS (SELECT *, CASE WHEN ok THEN sqrt(greatest((vy - b * b * vx) * 2 * kappa / (1 - b * b), 0)) ELSE sd * sqrt(252) END AS sigma FROM op)"""


@query("symbol:s kappa:4 theta:6 sigma:5 half_life:6 stationary_std:6", EVENTS + _OU + " SELECT *, CASE WHEN kappa > 0 THEN ln(2) / kappa END AS half_life, CASE WHEN kappa > 0 THEN sigma / sqrt(2 * kappa) END AS stationary_std FROM oz")
def fit_ou(spark, sf):
    series = log_rv(spark, sf).select("symbol", "ts_init", F.col("log_rv").alias("x"))
    return roughness.fit_ou(series, 1 / 252, HOURLY)


# -- scoring --------------------------------------------------------------------------

_Z = "((o - 2.5) / s)"


@query("o_orderkey:i crps:8", f"""SELECT o_orderkey, CASE WHEN s > 0 THEN s * (z * (2 * {cdf_sql('z')} - 1) + 2 * {pdf_sql('z')} - 1 / sqrt(pi())) ELSE abs(o - 2.5) END AS crps
 FROM (SELECT *, CASE WHEN s > 0 THEN {_Z} END AS z FROM (SELECT o_orderkey, o_totalprice / 100000 AS o, (o_orderkey % 7) / 4.0::DOUBLE AS s FROM orders))""")
def crps_gaussian(spark, sf):
    orders = src.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 100000).alias("obs"), F.lit(2.5).alias("mean"), ((F.col("o_orderkey") % 7) / 4.0).alias("std")
    )
    return scoring.crps_gaussian(orders)


_DRAWS = "WITH d AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS obs, CAST(unnest(embedding[2:]) AS DOUBLE) AS draw FROM embeddings)"


def draws(spark, sf):
    e = F.col("embedding")
    return src.table(spark, sf, "embeddings").select(
        "vec_id", e[0].cast("double").alias("obs"), F.explode(F.slice(e, F.lit(2), F.size(e) - 1).cast("array<double>")).alias("draw")
    )


@query("vec_id:i crps:8", _DRAWS + " SELECT vec_id, a - b AS crps FROM (SELECT vec_id, avg(abs(draw - obs)) AS a FROM d GROUP BY vec_id) JOIN (SELECT x.vec_id, avg(abs(x.draw - y.draw)) / 2 AS b FROM d x JOIN d y USING (vec_id) GROUP BY x.vec_id) USING (vec_id)")
def crps_ensemble(spark, sf):
    return scoring.crps_ensemble(draws(spark, sf), ["vec_id"])


_PIT = _DRAWS + ", p AS (SELECT vec_id, avg((draw <= obs)::INT) AS pit FROM d GROUP BY vec_id)"


@query("vec_id:i pit:8", _PIT + " SELECT * FROM p")
def pit_values(spark, sf):
    return scoring.pit_values(draws(spark, sf), ["vec_id"])


_KS = " SELECT max(greatest(i / n - u, u - (i - 1) / n)) AS calibration_error FROM (SELECT u, row_number() OVER (ORDER BY u)::DOUBLE AS i, count(*) OVER () AS n FROM {}) "


@query("calibration_error:8", _PIT + ", q AS (SELECT pit AS u FROM p)" + _KS.format("q"))
def calibration_error(spark, sf):
    return scoring.calibration_error(scoring.pit_values(draws(spark, sf), ["vec_id"]))


@query("calibration_error:8", "WITH q AS (SELECT l_discount * 10 * l_quantity / 51 AS u FROM lineitem)" + _KS.format("q"))
def calibration_error_lines(spark, sf):
    line = src.table(spark, sf, "lineitem").select((F.col("l_discount") * 10 * F.col("l_quantity") / 51).alias("pit"))
    return scoring.calibration_error(line)


@query("coverage:8", "SELECT avg((l_quantity BETWEEN l_discount * 100 AND 60 - l_tax * 500)::INT) AS coverage FROM lineitem")
def interval_coverage(spark, sf):
    line = src.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("obs"), (F.col("l_discount") * 100).alias("lower"), (60 - F.col("l_tax") * 500).alias("upper")
    )
    return scoring.coverage(line)


# -- monthly study ------------------------------------------------------------------------

_EW = """, ek AS (SELECT symbol, ts_event AS ts, ret, count(ret) OVER (PARTITION BY symbol ORDER BY ts_event) AS i FROM r),
ev AS (SELECT *, CASE WHEN ret IS NOT NULL THEN pow(61.0 / 60.0, i) END AS w FROM ek),
es AS (SELECT symbol, ts, ret, sum(w) OVER o AS sw, sum(w * ret) OVER o AS sx, sum(w * ret * ret) OVER o AS sxx, i FROM ev WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
dv AS (SELECT symbol, ts, ret, CASE WHEN i >= 60 THEN sqrt(greatest(sxx / sw - pow(sx / sw, 2), 0) * 261) END AS vol FROM es)"""
_MONTHLY = BRAND + _RET + _EW + """, mo AS (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS month, product(1 + coalesce(ret, 0)) - 1 AS ret, arg_max(vol, ts) FILTER (vol IS NOT NULL) AS vol, count(ret) AS days FROM dv GROUP BY 1, 2 HAVING count(ret) > 5),
mc AS (SELECT l.symbol, unnest(generate_series(l.a, l.b, INTERVAL 1 MONTH)) AS month FROM (SELECT symbol, min(month) AS a, max(month) AS b FROM mo GROUP BY symbol) l),
mf AS (SELECT mc.symbol, mc.month, mo.ret, mo.vol FROM mc LEFT JOIN mo ON mo.symbol = mc.symbol AND mo.month = mc.month)"""


def daily_vol(spark, sf):
    bars = vol.with_returns(src.brand_bars(spark, sf))
    return vol.ewma_vol(bars).select("symbol", F.col("ts_event").alias("ts"), "ret", F.col("ewma_vol").alias("vol"))


def monthly(spark, sf):
    return replication.monthly_resample(daily_vol(spark, sf))


@query("symbol:s month:t ret:6 vol:6 days:i", _MONTHLY + " SELECT * FROM mo")
def monthly_resample(spark, sf):
    return monthly(spark, sf)


def _pos(k: int, scale: bool = True) -> str:
    size = "0.4 / vol" if scale else "1.0"
    return f"CASE WHEN count(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY month ROWS {k - 1} PRECEDING) = {k} AND vol IS NOT NULL THEN sign(exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY month ROWS {k - 1} PRECEDING)) - 1) * {size} END"


def _legs(k: int, h: int, scale: bool = True, name: str = "lg") -> str:
    total = " + ".join(f"lag(pos, {j}) OVER (PARTITION BY symbol ORDER BY month) * ret" for j in range(1, h + 1))
    return f", {name}p AS (SELECT *, {_pos(k, scale)} AS pos FROM mf), {name}a AS (SELECT symbol, month, ({total}) / {h} AS leg FROM {name}p), {name} AS (SELECT * FROM {name}a WHERE leg IS NOT NULL)"


@query("month:t ret:6 names:i", _MONTHLY + _legs(12, 1) + " SELECT month, avg(leg) AS ret, count(leg) AS names FROM lg GROUP BY month")
def tsmom_paper(spark, sf):
    return replication.diversified(replication.tsmom_legs(monthly(spark, sf), 12, 1))


@query("month:t ret:6 names:i", _MONTHLY + _legs(6, 3, False) + " SELECT month, avg(leg) AS ret, count(leg) AS names FROM lg GROUP BY month")
def tsmom_unscaled(spark, sf):
    return replication.diversified(replication.tsmom_legs(monthly(spark, sf), 6, 3, scale=False))


@query("month:t ret:6 names:i", _MONTHLY + ", pl AS (SELECT symbol, month, 0.4 / lag(vol) OVER (PARTITION BY symbol ORDER BY month) * ret AS leg FROM mf) SELECT month, avg(leg) AS ret, count(leg) AS names FROM pl WHERE leg IS NOT NULL GROUP BY month")
def passive_vol_scaled(spark, sf):
    return replication.diversified(replication.passive_legs(monthly(spark, sf)))


_CELLS = [(k, h) for k in (1, 3, 6) for h in (1, 3)]


@query("k:i h:i month:t ret:6 names:i", _MONTHLY + "".join(_legs(k, h, name=f"g{k}{h}") for k, h in _CELLS) + " " + " UNION ALL ".join(
    f"SELECT {k} AS k, {h} AS h, month, avg(leg) AS ret, count(leg) AS names FROM g{k}{h} GROUP BY month" for k, h in _CELLS))
def tsmom_grid(spark, sf):
    return replication.tsmom_grid(monthly(spark, sf), [1, 3, 6], [1, 3])


@query("h:i b:6 t_stat:5", _MONTHLY + """, yy AS (SELECT *, ret / lag(vol) OVER (PARTITION BY symbol ORDER BY month) AS y FROM mf),
pp AS (SELECT a.month, h, a.y, sign(b.ret) AS x FROM yy a, range(1, 13) g(h), mf b WHERE b.symbol = a.symbol AND b.month = a.month - h::INT * INTERVAL 1 MONTH AND b.ret IS NOT NULL AND a.y IS NOT NULL),
co AS (SELECT h, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM pp GROUP BY h),
cl AS (SELECT pp.h, pp.month, sum(y - a - b * x) AS u, sum(x * (y - a - b * x)) AS v FROM pp JOIN co USING (h) GROUP BY ALL),
me AS (SELECT h, sum(pow((co.n * v - co.sx * u) / (co.n * co.sxx - co.sx * co.sx), 2)) AS q, count(*) AS g FROM cl JOIN co USING (h) GROUP BY h)
SELECT h, b, b / sqrt(q * g / (g - 1)) AS t_stat FROM co JOIN me USING (h)""")
def pooled_sign_tstats(spark, sf):
    return replication.pooled_sign_regression(monthly(spark, sf), 12)


@query("avg_corr:6 pairs:i", _MONTHLY + _legs(12, 1) + ", cr AS (SELECT a.symbol, b.symbol AS other, corr(a.leg, b.leg) AS c FROM lg a JOIN lg b ON a.month = b.month AND a.symbol < b.symbol GROUP BY ALL HAVING count(*) >= 36) SELECT avg(c) AS avg_corr, count(c) AS pairs FROM cr")
def avg_pairwise_corr(spark, sf):
    return replication.avg_pairwise_corr(replication.tsmom_legs(monthly(spark, sf), 12, 1))


@query("peer:s symbol:s mean_leg:6 n:i", _MONTHLY + _legs(12, 1) + ", lc AS (SELECT *, substr(symbol, 1, 7) AS peer FROM lg) SELECT peer, symbol, avg(leg) AS mean_leg, count(leg) AS n FROM lc GROUP BY ROLLUP (peer, symbol)")
def class_rollup(spark, sf):
    legs = replication.tsmom_legs(monthly(spark, sf), 12, 1).withColumn("peer", F.substring("symbol", 1, 7))
    return replication.class_rollup(legs)


@query("peer:s start:t end:t months:i ann_return:6 ann_vol:6 sharpe:6 t_stat:6 max_dd:6", _MONTHLY + _legs(12, 1) + """, pm AS (SELECT substr(symbol, 1, 7) AS peer, month, avg(leg) / 50 AS ret FROM lg GROUP BY ALL),
pe AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY peer ORDER BY month)) AS eq FROM pm), pd AS (SELECT *, eq / max(eq) OVER (PARTITION BY peer ORDER BY month) - 1 AS dr FROM pe)
SELECT peer, min(month) AS start, max(month) AS "end", count(*) AS months, avg(ret) * 12 AS ann_return, stddev_samp(ret) * sqrt(12) AS ann_vol, avg(ret) / stddev_samp(ret) * sqrt(12) AS sharpe,
 avg(ret) / stddev_samp(ret) * sqrt(count(*)) AS t_stat, min(dr) AS max_dd FROM pd GROUP BY peer""")
def series_stats(spark, sf):
    legs = replication.tsmom_legs(monthly(spark, sf), 12, 1).withColumn("peer", F.substring("symbol", 1, 7))
    series = replication.diversified(legs, ["peer"]).withColumn("ret", F.col("ret") / 50)
    return replication.series_stats(series, ["peer"])


# -- options --------------------------------------------------------------------------------

_CHAIN = """WITH c AS (SELECT l_orderkey, l_linenumber, l_shipdate - INTERVAL 30 DAY AS ts_event, l_extendedprice / 1000 AS close, l_quantity AS volume,
 CAST(floor(l_extendedprice / 50) * 50 AS BIGINT) AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'P' END AS cp,
 'ES' || substr('HMUZ', quarter(l_shipdate)::INT, 1) || (year(l_shipdate) % 10) AS u, date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS m0 FROM lineitem WHERE l_orderkey % 17 <> 0 AND l_partkey % 13 <> 0),
e AS (SELECT *, CAST(ts_event AS DATE) AS d, CAST(m0 + ((5 - isodow(m0) + 7) % 7 + 14)::INT * INTERVAL 1 DAY AS DATE) AS x FROM c),
e10 AS (SELECT *, CAST(m0 + INTERVAL 10 YEAR + ((5 - isodow(m0 + INTERVAL 10 YEAR) + 7) % 7 + 14)::INT * INTERVAL 1 DAY AS DATE) AS x10 FROM e)"""


def chain(spark, sf):
    line = src.table(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("timestamp")
    letter = F.element_at(F.array(*[F.lit(c) for c in "HMUZ"]), F.quarter(day))
    under = F.concat(F.lit("ES"), letter, (F.year(day) % 10).cast("string"))
    strike = (F.floor(F.col("l_extendedprice") / 50) * 50).cast("long").cast("string")
    right = F.when(F.col("l_linenumber") % 2 == 0, F.lit("C")).otherwise(F.lit("P"))
    name = F.concat(under, F.lit(" "), right, strike)
    spread = F.concat(under, F.lit("-"), under)
    close = F.when(F.col("l_partkey") % 13 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice") / 1000)
    raw = line.select(
        (day - F.expr("INTERVAL 30 DAYS")).alias("ts_event"),
        F.when(F.col("l_orderkey") % 17 == 0, spread).otherwise(name).alias("symbol"),
        *[close.alias(c) for c in ("open", "high", "low", "close")], F.col("l_quantity").alias("volume"),
    )
    return options.tidy_options(raw)


@query("date:d underlying:s right:s strike:0 expiry:d days_to_expiry:i close:8 volume:0", _CHAIN + """ SELECT d AS date, u AS underlying, cp AS "right", k AS strike, CASE WHEN x < d THEN x10 ELSE x END AS expiry,
 datediff('day', d, CASE WHEN x < d THEN x10 ELSE x END) AS days_to_expiry, close, volume FROM e10""")
def option_chain_tidy(spark, sf):
    return chain(spark, sf)


@query("o_orderkey:i third_friday:d", "SELECT o_orderkey, date_trunc('month', o_orderdate) + ((5 - isodow(date_trunc('month', o_orderdate)) + 7) % 7 + 14)::INT * INTERVAL 1 DAY AS third_friday FROM orders")
def third_friday(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return src.table(spark, sf, "orders").select("o_orderkey", options.third_friday(F.year(day), F.month(day)).alias("third_friday"))


_OPT = """WITH b AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice AS forward, l_extendedprice * (0.88 + 0.04 * l_linenumber) AS strike, 0.2 + (l_partkey % 10) / 10.0::DOUBLE AS t, 0.03 AS rate,
 0.1 + l_discount * 3 AS sigma, CASE WHEN l_suppkey % 2 = 0 THEN 'C' ELSE 'P' END AS cp FROM lineitem),
o AS (SELECT *, (ln(forward / strike) + 0.5 * sigma * sigma * t) / (sigma * sqrt(t)) AS d1, (ln(forward / strike) - 0.5 * sigma * sigma * t) / (sigma * sqrt(t)) AS d2, exp(-rate * t) AS df FROM b)"""
_IDS = "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i"


def option_inputs(spark, sf):
    return src.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("forward"),
        (F.col("l_extendedprice") * (0.88 + 0.04 * F.col("l_linenumber"))).alias("strike"),
        (0.2 + (F.col("l_partkey") % 10) / 10.0).alias("t"), F.lit(0.03).alias("rate"),
        (0.1 + F.col("l_discount") * 3).alias("sigma"),
        F.when(F.col("l_suppkey") % 2 == 0, F.lit("C")).otherwise(F.lit("P")).alias("right"),
    )


_P1, _P2, _M1, _M2 = cdf_sql("d1"), cdf_sql("d2"), cdf_sql("(-d1)"), cdf_sql("(-d2)")


@query(_IDS + " price:4", _OPT + f" SELECT *, CASE WHEN cp = 'C' THEN df * (forward * {_P1} - strike * {_P2}) ELSE df * (strike * {_M2} - forward * {_M1}) END AS price FROM o")
def black76_price(spark, sf):
    return black76.price(option_inputs(spark, sf))


@query(_IDS + " delta:8 gamma:10 vega:3 theta:3", _OPT + f""" SELECT *, CASE WHEN cp = 'C' THEN df * {_P1} ELSE -df * {_M1} END AS delta, df * {pdf_sql('d1')} / (forward * sigma * sqrt(t)) AS gamma, df * forward * {pdf_sql('d1')} * sqrt(t) AS vega,
 rate * (CASE WHEN cp = 'C' THEN df * (forward * {_P1} - strike * {_P2}) ELSE df * (strike * {_M2} - forward * {_M1}) END) - df * forward * {pdf_sql('d1')} * sigma / (2 * sqrt(t)) AS theta FROM o""")
def black76_greeks(spark, sf):
    return black76.greeks(option_inputs(spark, sf))


@query(_IDS + " implied_vol:5", _OPT + " SELECT *, CASE WHEN l_partkey % 50 <> 0 THEN sigma END AS implied_vol FROM b")
def implied_vol(spark, sf):
    """Volatility back from the price; a premium above the forward has none."""
    priced = black76.price(option_inputs(spark, sf), "premium")
    priced = priced.withColumn("premium", F.when(F.col("l_partkey") % 50 == 0, F.col("forward") * 9).otherwise(F.col("premium")))
    return black76.implied_vol(priced)


# -- membership -------------------------------------------------------------------------------


@query("symbol:s", """WITH c AS (SELECT o_orderdate AS d, 'A' || (o_custkey % 400) AS added, CASE WHEN o_orderkey % 5 > 0 THEN 'R' || (o_custkey % 300) END AS removed FROM orders),
w AS (SELECT * FROM c WHERE d >= TIMESTAMP '1996-01-01' AND d <= TIMESTAMP '1996-06-30')
SELECT n_name AS symbol FROM nation UNION SELECT added FROM w UNION SELECT removed FROM w WHERE removed IS NOT NULL""")
def membership_ever(spark, sf):
    changes = src.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("effective_date"), F.concat(F.lit("A"), F.col("o_custkey") % 400).alias("added"),
        F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("R"), F.col("o_custkey") % 300)).alias("removed"),
    )
    current = src.table(spark, sf, "nation").select(F.col("n_name").alias("symbol"))
    return universe.ever_members(current, changes, "1996-01-01", "1996-06-30")


def change_pages(spark, sf):
    """One page per customer: its orders as rows of a changes table, with flaws."""
    orders = src.table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    date = F.when(F.col("o_orderkey") % 11 == 0, F.lit("sometime")).otherwise(F.date_format("d", "MMMM d, yyyy"))
    added = F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("T"), F.col("o_orderkey")))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    six = F.concat(cell(date), cell(F.concat(F.lit('<a href="#">'), added, F.lit("</a>"))), cell(F.lit("x")), cell(F.col("o_orderstatus")), cell(F.lit("y")), cell(F.concat(F.lit("S&amp;P "), "o_orderpriority")))
    row = F.concat(F.lit("<tr>"), F.when(F.col("o_orderkey") % 7 == 0, cell(date)).otherwise(six), F.lit("</tr>\n"))
    head = "<table>\n<tr><th>Date</th><th>Added</th></tr>\n"
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("r"))))
    body = F.array_join(F.transform(rows, lambda x: x["r"]), "")
    return orders.groupBy("o_custkey").agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("html"))


@query("o_custkey:i effective_date:d added:s removed:s reason:s", """SELECT o_custkey, o_orderdate AS effective_date, CASE WHEN o_orderkey % 5 > 0 THEN 'T' || o_orderkey END AS added, o_orderstatus AS removed,
 'S&P ' || o_orderpriority AS reason FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def html_table_rows(spark, sf):
    rows = universe.html_table_rows(change_pages(spark, sf), ["o_custkey"])
    return universe.parse_changes(rows, ["o_custkey"])


def constituent_pages(spark, sf):
    """One page per nation: its customers as rows of a constituents table, with header, short and marked-up rows."""
    customers = src.table(spark, sf, "customer")
    cell = lambda c: F.concat(F.lit("<TD class='x'>"), c, F.lit("</TD>"))
    symbol = F.concat(F.lit('<a href="#">C'), "c_custkey", F.lit("</a>"))
    two = F.concat(cell(symbol), cell(F.concat(F.lit("  "), "c_name", F.lit(" &amp; <b>Co</b>\n"))), cell(F.lit("more")))
    row = F.concat(F.lit("<tr>"), F.when(F.col("c_custkey") % 9 == 0, cell(symbol)).otherwise(two), F.lit("</tr>\n"))
    rows = F.array_join(F.sort_array(F.collect_list(row)), "")
    return customers.groupBy("c_nationkey").agg(F.concat(F.lit("<table><tr><th>Symbol</th></tr>"), rows, F.lit("</table>")).alias("html"))


@query("c_nationkey:i symbol:s name:s", "SELECT c_nationkey, 'C' || c_custkey AS symbol, c_name || ' & Co' AS name FROM customer WHERE c_custkey % 9 <> 0")
def constituents(spark, sf):
    rows = universe.html_table_rows(constituent_pages(spark, sf), ["c_nationkey"])
    return universe.parse_constituents(rows, ["c_nationkey"])


@query("underlying:s date:d strike:2 right:s premium:2", """SELECT 'ES' || substr('HMUZ', quarter(o_orderdate)::INT, 1) || (year(o_orderdate) % 10) AS underlying, CAST(o_orderdate AS DATE) AS date,
 o_custkey * 5 AS strike, CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS right, o_totalprice AS premium FROM orders WHERE year(o_orderdate) = 1996""")
def stored_option_bars(spark, sf):
    """Monthly parts of option chains combined into one sorted store, and one year of a root read back."""
    day = F.col("o_orderdate").cast("timestamp")
    chain = src.table(spark, sf, "orders").select(
        F.concat(F.lit("ES"), F.element_at(F.array(*[F.lit(c) for c in "HMUZ"]), F.quarter(day)), (F.year(day) % 10).cast("string")).alias("underlying"),
        day.cast("date").alias("date"), F.last_day(day).alias("expiry"), (F.col("o_custkey") * 5.0).alias("strike"),
        F.when(F.col("o_orderkey") % 2 == 0, "C").otherwise("P").alias("right"), F.col("o_totalprice").cast("double").alias("premium"),
    )
    root = f"{checkpoint_dir(spark).rstrip('/')}/options-{uuid.uuid4().hex}"
    chain.withColumn("month", F.date_format("date", "yyyy-MM")).write.partitionBy("month").parquet(f"{root}/parts")
    store.write_option_bars(spark.read.parquet(f"{root}/parts").drop("month"), f"{root}/chain")
    return store.read_option_bars(spark, f"{root}/chain").where("root = 'ES' AND year = 1996")
