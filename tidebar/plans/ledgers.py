"""Queries over books of whole units: bands, lots, rolls, and validation of screened trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio
from ..operators import walkforward as wf
from ..operators.ledger import ledger_exact
from ..session import store_once
from . import inputs as src
from .evaluation import _PARAMS, COSTS, GRID, SWEEP, TGT, folds_of, targets, weighted, with_params
from .registry import query


def recursive_book(rows: str, costs: portfolio.Costs, capital: float, band: float, size: float = 1.0, tick: float = 0.01, lot: float | None = None) -> str:
    """CTEs up to ``walk``: books of *rows* (book, symbol, ts_init, close, w), a close a step, a list element a symbol."""
    goal = "w[j] * before / (c[j] * {0})" if lot is None else "round_even(w[j] * before / (c[j] * {0}) / {1}, 0) * {1}"
    fee = f"({costs.rate} * c[j] * {size} + {costs.per_contract} + {costs.slippage_prob} * {tick} * {size})"
    each = lambda body: f"list_transform(ks, lambda j: {body})"
    return f""", sy AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS j FROM (SELECT DISTINCT symbol FROM {rows})),
 cl AS (SELECT book, ts_init, row_number() OVER (PARTITION BY book ORDER BY ts_init) AS i FROM (SELECT DISTINCT book, ts_init FROM {rows})),
 cells AS (SELECT cl.book, cl.i, cl.ts_init, list(r.close ORDER BY sy.j) AS c, list(r.w ORDER BY sy.j) AS w FROM cl CROSS JOIN sy
  LEFT JOIN {rows} r ON r.book = cl.book AND r.ts_init = cl.ts_init AND r.symbol = sy.symbol GROUP BY ALL),
 walk AS (SELECT DISTINCT book, 0::BIGINT AS i, NULL::TIMESTAMP AS ts_init, {capital}::DOUBLE AS before, {capital}::DOUBLE AS post, 0::BIGINT AS orders,
   list_transform(range(len(c)), lambda k: 0.0::DOUBLE) AS u, list_transform(range(len(c)), lambda k: NULL::DOUBLE) AS l FROM cells
 UNION ALL
 SELECT book, i, CAST(ts_init AS TIMESTAMP), before, before - coalesce(list_sum({each(f"CASE WHEN go[j] THEN abs(goal[j] - u[j]) * {fee} ELSE 0 END")}), 0),
   len(list_filter(go, lambda x: x)), {each("CASE WHEN go[j] THEN goal[j] ELSE u[j] END")}, l
 FROM (SELECT *, {each(f"coalesce(before > 0 AND goal[j] <> u[j] AND abs(goal[j] - u[j]) * c[j] * {size} >= {band} * before, false)")} AS go
  FROM (SELECT *, {each(goal.format(size, lot))} AS goal
   FROM (SELECT n.book, n.i, n.ts_init, n.c, n.w, k.u, range(1, len(n.c) + 1) AS ks,
     k.post + coalesce(list_sum(list_transform(range(1, len(n.c) + 1), lambda j: CASE WHEN k.u[j] <> 0 AND n.c[j] IS NOT NULL THEN k.u[j] * {size} * (n.c[j] - k.l[j]) ELSE 0 END)), 0) AS before,
     list_transform(range(1, len(n.c) + 1), lambda j: coalesce(n.c[j], k.l[j])) AS l
    FROM walk k JOIN cells n ON n.book = k.book AND n.i = k.i + 1) a) b) c)"""


@query("trial:s ts_init:t equity:8 equity_post:8 orders:i", TGT + """, n AS (SELECT symbol, ts_init, close, target AS w, row_number() OVER (PARTITION BY symbol ORDER BY ts_init) AS i FROM tgt),
walk AS (SELECT symbol, ts_init, i, close, 1.0::DOUBLE AS before, CASE WHEN w <> 0 AND abs(w) >= 0.002 THEN 1 ELSE 0 END AS orders,
  CASE WHEN w <> 0 AND abs(w) >= 0.002 THEN w / close ELSE 0.0 END AS units, CASE WHEN w <> 0 AND abs(w) >= 0.002 THEN 1 - abs(w) * 0.0005 ELSE 1.0 END AS post FROM n WHERE i = 1
 UNION ALL
 SELECT symbol, ts_init, i, close, before, CASE WHEN go THEN 1 ELSE 0 END, CASE WHEN go THEN u + d ELSE u END, CASE WHEN go THEN before - abs(d) * close * 0.0005 ELSE before END
 FROM (SELECT *, before > 0 AND d <> 0 AND abs(d) * close >= 0.002 * before AS go FROM (SELECT n.symbol, n.ts_init, n.i, n.close, k.units AS u,
   k.post + k.units * (n.close - k.close) AS before, n.w * (k.post + k.units * (n.close - k.close)) / n.close - k.units AS d
   FROM walk k JOIN n ON n.symbol = k.symbol AND n.i = k.i + 1) a) b)
SELECT symbol AS trial, ts_init, before AS equity, post AS equity_post, orders FROM walk""")
def ledger_exact_band(spark, sf):
    """One book per brand with a no-trade band: the path-dependent ledger."""
    books = targets(spark, sf).withColumns({"trial": F.col("symbol"), "w": F.col("target")})
    return ledger_exact(books, COSTS, band=0.002)


LOT_COSTS = portfolio.Costs(per_contract=2.5, slippage_prob=0.5)
_LOTS = recursive_book("bk", LOT_COSTS, 1e6, 0.001, 5.0, 0.25, 10.0)


@query("ts_init:t equity:4 equity_post:4 orders:i", TGT + ", bk AS (SELECT 0 AS book, symbol, ts_init, close, w FROM wt)" + _LOTS + " SELECT ts_init, before AS equity, post AS equity_post, orders FROM walk WHERE i > 0")
def ledger_exact_lots(spark, sf):
    """One book of all brands in lots of ten contracts, with fees a contract, slippage and a band."""
    book = weighted(spark, sf).withColumns({"trial": F.lit(0), "multiplier": F.lit(5.0), "tick": F.lit(0.25), "increment": F.lit(10.0)})
    return ledger_exact(book, LOT_COSTS, capital=1e6, band=0.001, whole_lots=True)


def contracts_of(spark, sf):
    """Each brand as a chain of quarterly contracts at prices of their own: the quarter's is active, the one before is still quoted."""
    rows = targets(spark, sf)
    quarter, price = F.quarter("ts_init"), lambda q: F.col("close") * (1 + q / 100)
    before = F.when(quarter == 1, 4).otherwise(quarter - 1)
    one = lambda q, active: F.struct(
        F.concat(F.lit("Q"), q).alias("instrument_id"), price(q).alias("close"), F.when(F.lit(active), F.col("target")).alias("w"), F.lit(active).alias("active")
    )
    return rows.select(F.col("symbol").alias("trial"), "symbol", "ts_init", F.explode(F.array(one(quarter, True), one(before, False))).alias("c")).select(
        "trial", "symbol", "ts_init", "c.*", F.lit(5.0).alias("multiplier"), F.lit(0.25).alias("tick"), F.lit(1.0).alias("increment")
    )


_FEE = "(0.0005 * {0} * 5 + 0.5 * 0.25 * 5)"
_ROLLS = TGT + f""", n AS (SELECT symbol, ts_init, quarter(ts_init) AS a, target AS w, row_number() OVER (PARTITION BY symbol ORDER BY ts_init) AS i,
  [CASE WHEN k IN (quarter(ts_init), quarter(ts_init - INTERVAL 3 MONTH)) THEN close * (1 + k / 100.0::DOUBLE) END for k in [1, 2, 3, 4]] AS c FROM tgt),
walk AS (SELECT DISTINCT symbol, 0::BIGINT AS i, NULL::TIMESTAMP AS ts_init, 1e6::DOUBLE AS before, 1e6::DOUBLE AS post, 0::BIGINT AS orders, 0::BIGINT AS rolls,
  [0.0::DOUBLE, 0, 0, 0] AS u, [NULL::DOUBLE, NULL, NULL, NULL] AS l, NULL::BIGINT AS h FROM n
 UNION ALL
 SELECT symbol, i, CAST(ts_init AS TIMESTAMP), before, before - out_fee - CASE WHEN go THEN abs(goal - u[a]) * {_FEE.format("c[a]")} ELSE 0 END,
  (CASE WHEN go THEN 1 ELSE 0 END + CASE WHEN out_qty <> 0 THEN 1 ELSE 0 END)::BIGINT, rolled::BIGINT,
  [CASE WHEN k = a AND go THEN goal WHEN k = h AND rolled THEN 0 ELSE u[k] END for k in [1, 2, 3, 4]], l, CASE WHEN go THEN a WHEN rolled THEN NULL ELSE h END
 FROM (SELECT *, coalesce(before > 0 AND goal <> u[a] AND (rolled OR abs(goal - u[a]) * c[a] * 5 >= 0.01 * before), false) AS go,
   out_qty * {_FEE.format("coalesce(l[h], 0)")} AS out_fee
  FROM (SELECT *, round_even(w * before / (c[a] * 5), 0) AS goal, coalesce(h <> a, false) AS rolled, CASE WHEN coalesce(h <> a, false) THEN abs(u[h]) ELSE 0 END AS out_qty
   FROM (SELECT n.symbol, n.i, n.ts_init, n.a, n.w, n.c, k.u, k.h,
     k.post + coalesce(list_sum([CASE WHEN k.u[j] <> 0 AND n.c[j] IS NOT NULL THEN k.u[j] * 5 * (n.c[j] - k.l[j]) ELSE 0 END for j in [1, 2, 3, 4]]), 0) AS before,
     [coalesce(n.c[j], k.l[j]) for j in [1, 2, 3, 4]] AS l FROM walk k JOIN n ON n.symbol = k.symbol AND n.i = k.i + 1) x) y) z)
SELECT symbol AS trial, ts_init, before AS equity, post AS equity_post, orders, rolls FROM walk WHERE i > 0"""


@query("trial:s ts_init:t equity:4 equity_post:4 orders:i rolls:i", _ROLLS)
def ledger_exact_rolls(spark, sf):
    """One book per brand that follows the active contract: the old one is closed, the order into the new one ignores the band."""
    costs = portfolio.Costs(rate=0.0005, slippage_prob=0.5)
    return ledger_exact(contracts_of(spark, sf), costs, capital=1e6, band=0.01, whole_lots=True, rolls=True)


_TOP = SWEEP + """, best AS (SELECT trial FROM sc ORDER BY value DESC, trial LIMIT 3),
 bk AS (SELECT trial * 100 + fold AS book, symbol, ts_init, close, w FROM wi SEMI JOIN best USING (trial))""" + recursive_book("bk", COSTS, 1.0, 0.0) + """,
 ve AS (SELECT book, CAST(ts_init AS DATE) AS d, post AS e FROM walk WHERE i > 0),
 vs AS (SELECT book, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM ve GROUP BY book),
 vf AS (SELECT book, d, CASE WHEN row_number() OVER q = 1 THEN 1.0 ELSE last_value(e IGNORE NULLS) OVER q END AS e FROM vs LEFT JOIN ve USING (book, d) WINDOW q AS (PARTITION BY book ORDER BY d)),
 vr AS (SELECT * FROM (SELECT book // 100 AS trial, book % 100 AS fold, d AS ts, lead(e) OVER (PARTITION BY book ORDER BY d) / e - 1 AS ret FROM vf) WHERE ret IS NOT NULL),
 vsc AS (SELECT trial, fold, CASE WHEN count(*) < 2 OR stddev_samp(ret) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe, count(*) AS days FROM vr GROUP BY ALL)"""


def validated(spark, sf):
    """Screened scores, and the daily returns of the three best trials in the ledger of units."""
    bars = src.brand_bars(spark, sf)
    windows, rows = folds_of(bars), wf.trend_targets(bars, GRID)
    screened = store_once(wf.trial_scores(wf.fold_scores(wf.sweep(bars, rows, windows))))
    return screened, wf.validate_top_k(bars, rows, windows, screened, 3, COSTS)


@query("trial:i fold:i days:i sharpe:6", _TOP + " SELECT * FROM vsc")
def validate_top_k(spark, sf):
    """The three best trials re-scored with the unit-holding ledger on calendar days."""
    return wf.fold_scores(validated(spark, sf)[1]).withColumnRenamed("n", "days")


@query("trial:i screened:6 validated:6 diff:6 screened_rank:i validated_rank:i", _TOP + """, va AS (SELECT trial, avg(sharpe) AS validated FROM vsc GROUP BY trial)
 SELECT trial, value AS screened, validated, validated - value AS diff, row_number() OVER (ORDER BY value DESC, trial) AS screened_rank, row_number() OVER (ORDER BY validated DESC, trial) AS validated_rank
 FROM va JOIN sc USING (trial)""")
def screening_agreement(spark, sf):
    """Screened against validated scores of the trials that were validated, with both ranks."""
    screened, returns = validated(spark, sf)
    return wf.agreement(screened, wf.trial_scores(wf.fold_scores(returns)))


@query("params:s screened:6 validated:6 diff:6 ratio:4", _TOP + _PARAMS + """, va AS (SELECT trial, avg(sharpe) AS validated FROM vsc GROUP BY trial)
 SELECT params, value AS screened, validated, validated - value AS diff, validated / value AS ratio FROM va JOIN sc USING (trial) JOIN pm USING (trial)""")
def screened_against_validated(spark, sf):
    """Scores of the same parameters by screening without costs and by the ledger of units with them."""
    screened, returns = validated(spark, sf)
    return wf.engine_comparison(with_params(spark, screened), with_params(spark, wf.trial_scores(wf.fold_scores(returns))))
