"""Queries over portfolio accounting, walk-forward sweeps, statistics and attribution."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from ..functions.normal import cdf_sql, pdf_sql, ppf_sql
from ..operators import attribution as att
from ..operators import panel, portfolio, shared, stats, strategies
from ..operators import walkforward as wf
from ..operators.ordered import DAILY, Axis
from ..session import checkpoint_dir, store_once
from ..sources import bars as store
from . import inputs as src
from .features import _RET, ALIGN, _roll
from .inputs import BRAND
from .registry import query
from .signals import QUERY_MOMENTUM, QUERY_REVERSION, QUERY_TREND, _vol, tsm_sql, xsm_sql

COSTS = portfolio.Costs(rate=0.0005)

TGT = BRAND + _RET + f""", gm AS (SELECT *, {_roll('avg(close)', 20, 'close')} - {_roll('avg(close)', 60, 'close')} AS gap, {_vol(20)} AS rv FROM r),
tgt AS (SELECT symbol, ts_init, close, coalesce(ret, 0) AS r, coalesce(sign(gap) * CASE WHEN rv IS NOT NULL THEN least(0.1 / greatest(rv, 1e-6), 5) END, 0) AS target FROM gm),
wt AS (SELECT *, target / (SELECT count(DISTINCT symbol) FROM tgt) AS w FROM tgt),
pr AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts_init), 0) AS wp FROM wt)"""


def targets(spark, sf):
    return strategies.trend_following(src.brand_bars(spark, sf))


def weighted(spark, sf):
    return portfolio.weighted_targets(targets(spark, sf))


@query("symbol:s ts_init:t w:8", TGT + " SELECT * FROM wt")
def weighted_targets(spark, sf):
    return weighted(spark, sf)


@query("symbol:s ts_init:t w:8", TGT + ", x(symbol, weight) AS (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS DOUBLE) / 100 FROM part) SELECT symbol, ts_init, target * weight AS w FROM tgt JOIN x USING (symbol)")
def weighted_targets_map(spark, sf):
    weights = src.table(spark, sf, "part").select(
        F.col("p_brand").alias("symbol"), (F.substring("p_brand", 7, 2).cast("double") / 100).alias("weight")
    ).distinct()
    return portfolio.weighted_targets(targets(spark, sf), weights)


_PORT = ", port AS (SELECT ts_init, sum(wp * r) AS total, sum(CASE WHEN wp > 0 THEN wp * r ELSE 0 END) AS long_leg, sum(CASE WHEN wp < 0 THEN wp * r ELSE 0 END) AS short_leg FROM pr GROUP BY ts_init)"


@query("ts_init:t total:8 long_leg:8 short_leg:8", TGT + _PORT + " SELECT * FROM port")
def portfolio_returns(spark, sf):
    return portfolio.portfolio_returns(weighted(spark, sf))


_COST = """, bk AS (SELECT *, sum(wp * r) OVER (PARTITION BY ts_init) AS rr FROM pr),
tc AS (SELECT *, w - wp * (1 + r) / (1 + rr) AS traded, abs(w - wp * (1 + r) / (1 + rr)) * 0.0005 AS cost FROM bk)"""


@query("symbol:s ts_init:t traded:8 cost:8", TGT + _COST + " SELECT * FROM tc")
def trading_costs(spark, sf):
    return portfolio.trading_costs(weighted(spark, sf), COSTS)


@query("symbol:s ts_init:t cost:10", TGT + _COST + " SELECT symbol, ts_init, abs(traded) * (2.5 / (close * 5) + 0.5 * 0.25 / close) AS cost FROM tc")
def trading_costs_contract(spark, sf):
    """Fees per contract and expected slippage of half a tick, on contracts with a multiplier."""
    book = weighted(spark, sf).withColumns({"multiplier": F.lit(5.0), "tick": F.lit(0.25)})
    return portfolio.trading_costs(book, portfolio.Costs(per_contract=2.5, slippage_prob=0.5))


_LED = _COST + """, lc AS (SELECT ts_init, sum(wp * r) AS ret, sum(cost) AS fee, sum(abs(traded)) AS turnover FROM tc GROUP BY ts_init),
lg AS (SELECT *, 1 + ret - coalesce(lag(fee) OVER (ORDER BY ts_init), 0) AS g FROM lc),
led AS (SELECT *, exp(sum(ln(g)) OVER (ORDER BY ts_init)) AS equity FROM lg)"""


@query("ts_init:t ret:8 fee:8 turnover:6 equity:6 equity_post:6", TGT + _LED + " SELECT *, equity * (1 - fee) AS equity_post FROM led")
def rebalance_ledger(spark, sf):
    return portfolio.ledger(weighted(spark, sf), COSTS)


@query("symbol:s ts_init:t side:s size:8 price:8 cost:8", TGT + _COST + " SELECT symbol, ts_init, CASE WHEN traded > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(traded) AS size, close AS price, cost FROM tc WHERE abs(traded) > 1e-12")
def trades(spark, sf):
    return portfolio.trades(weighted(spark, sf), COSTS)


@query("symbol:s turnover:6", TGT + _COST + " SELECT symbol, sum(abs(traded)) / ((SELECT datediff('day', min(ts_init), max(ts_init)) + 1 FROM tc) / 365.25) AS turnover FROM tc WHERE abs(traded) > 1e-12 GROUP BY symbol")
def turnover(spark, sf):
    book = weighted(spark, sf)
    years = book.agg((F.datediff(F.max("ts_init"), F.min("ts_init")) + 1) / 365.25).scalar()
    return portfolio.turnover(portfolio.trades(book, COSTS), ["symbol"], years)


@query("symbol:s ts_init:t lots:i", TGT + _LED + " SELECT symbol, ts_init, round_even(w * equity * 1e9 / (close * 5) / 10, 0) * 10 AS lots FROM wt JOIN led USING (ts_init)")
def lots(spark, sf):
    w = weighted(spark, sf)
    book = portfolio.ledger(w, COSTS, capital=1e9).select("ts_init", "equity")
    return portfolio.lots(w.join(book, "ts_init").withColumn("multiplier", F.lit(5.0)), increment=10.0)


@query("symbol:s ts:t old:s new:s", TGT + """, q AS (SELECT symbol, ts_init, w, lag(w) OVER s AS h, 'Q' || quarter(ts_init) AS n, lag('Q' || quarter(ts_init)) OVER s AS o
 FROM wt WINDOW s AS (PARTITION BY symbol ORDER BY ts_init)) SELECT symbol, ts_init AS ts, o AS old, n AS new FROM q WHERE o <> n AND h <> 0""")
def roll_events(spark, sf):
    held = weighted(spark, sf).withColumn("instrument_id", F.concat(F.lit("Q"), F.quarter("ts_init")))
    return portfolio.roll_events(held)


@query("ts:t ret:8", TGT + _LED + """, dl AS (SELECT CAST(ts_init AS DATE) AS d, equity * (1 - fee) AS e FROM led),
days AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM dl), (SELECT max(d) FROM dl), INTERVAL 1 DAY)) AS DATE) AS d),
f AS (SELECT days.d, CASE WHEN row_number() OVER (ORDER BY days.d) = 1 THEN 1.0 ELSE last_value(e IGNORE NULLS) OVER (ORDER BY days.d) END AS e FROM days LEFT JOIN dl ON dl.d = days.d),
g AS (SELECT d AS ts, lead(e) OVER (ORDER BY d) / e - 1 AS ret FROM f) SELECT * FROM g WHERE ret IS NOT NULL""")
def calendar_fill_returns(spark, sf):
    return portfolio.calendar_fill(portfolio.ledger(weighted(spark, sf), COSTS), 1.0)


_EARN = TGT + ", sr AS (SELECT symbol, 'class ' || substr(symbol, 7, 1) AS trial, ts_init AS ts, wp * r * 5 AS ret FROM pr)"


def symbol_returns(spark, sf):
    rows = portfolio.position_returns(weighted(spark, sf))
    return rows.select(
        "symbol", F.concat(F.lit("class "), F.substring("symbol", 7, 1)).alias("trial"),
        F.col("ts_init").alias("ts"), (F.col("earned") * 5).alias("ret"),
    )


@query("trial:s ts:t ret:8", _EARN + " SELECT trial, ts, product(1 + ret) - 1 AS ret FROM sr GROUP BY ALL")
def stitch_returns(spark, sf):
    return stats.stitch_returns(symbol_returns(spark, sf), ["trial"])


@query("symbol:s year:i ret:8", _EARN + " SELECT symbol, year(ts) AS year, product(1 + ret) - 1 AS ret FROM sr GROUP BY ALL")
def calendar_year_returns(spark, sf):
    return stats.calendar_year_returns(symbol_returns(spark, sf), ["symbol"])


_M = "avg(ret)"


def _central(k: int) -> str:
    # Central moments from a mean joined in beforehand (column ``mu``).
    return f"avg(pow(ret - mu, {k}))"


_MU = ", mu AS (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu FROM sr)"
_STATS = _EARN + _MU + f""", dd AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY ts)) AS eq FROM mu),
de AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS dr, quantile_cont(ret, 0.05) OVER (PARTITION BY symbol) AS q5 FROM dd),
ag AS (SELECT symbol, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(ret) FILTER (ret > 0) AS avg_win, avg(ret) FILTER (ret < 0) AS avg_loss,
 max(ret) AS max_win, min(ret) AS max_loss, avg((ret > 0)::INT) AS win_rate, {_central(3)} / pow({_central(2)}, 1.5) AS skew, {_central(4)} / pow({_central(2)}, 2) AS kurtosis,
 product(1 + ret) AS grown, min(dr) AS max_drawdown, sqrt(avg(dr * dr)) AS ulcer, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) AS gain, sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END) AS loss,
 avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) AS down, quantile_cont(ret, 0.95) AS q95, max(q5) AS var_95, avg(ret) FILTER (ret <= q5) AS es_95 FROM de GROUP BY symbol)
SELECT *, mean / sd * sqrt(252) AS sharpe, sd * sqrt(252) AS volatility, grown - 1 AS total_return, pow(grown, 252.0 / n) - 1 AS cagr, mean * sqrt(252) / sqrt(down) AS sortino,
 gain / loss AS profit_factor, gain / loss AS omega, abs(q95) / abs(var_95) AS tail_ratio, (pow(grown, 252.0 / n) - 1) / abs(max_drawdown) AS calmar FROM ag"""


@query("symbol:s n:i mean:8 sharpe:6 volatility:6 avg_win:8 avg_loss:8 max_win:8 max_loss:8 win_rate:6 skew:6 kurtosis:6 total_return:8 max_drawdown:8 "
       "ulcer:8 cagr:8 sortino:6 profit_factor:6 omega:6 tail_ratio:6 calmar:6 var_95:8 es_95:8", _STATS)
def return_stats(spark, sf):
    return stats.return_statistics(symbol_returns(spark, sf).drop("trial"), ["symbol"])


# -- walk forward ----------------------------------------------------------------

GRID = [
    dict(fast=f, slow=s, vol_target=0.1, vol_lookback=v) for f, s, v in itertools.product((5, 10, 20), (40, 60), (20, 63))
]

FOLDS = """, fc AS (SELECT ts_init AS ts, row_number() OVER (ORDER BY ts_init) - 1 AS t, count(*) OVER () AS n, lag(ts_init) OVER (ORDER BY ts_init) AS before FROM (SELECT DISTINCT ts_init FROM bars)),
fl AS (SELECT *, least(greatest(1, floor(n * 0.2)), floor((n - 252) / 5))::BIGINT AS len FROM fc),
fs AS (SELECT *, CAST(floor((t - (n - 5 * len)) / len) AS INT) AS fold FROM fl WHERE t >= n - 5 * len),
folds AS (SELECT fold, (SELECT min(ts) FROM fc) AS train_start, arg_min(coalesce(before, ts), t) AS train_end, min(ts) AS test_start, max(ts) AS test_end FROM fs GROUP BY fold)"""


def folds_of(bars):
    return store_once(wf.make_folds(bars))


@query("fold:i train_start:t train_end:t test_start:t test_end:t test_days:i", BRAND + FOLDS + " SELECT *, datediff('day', test_start, test_end) AS test_days FROM folds")
def folds(spark, sf):
    return wf.fold_table(folds_of(src.brand_bars(spark, sf)))


@query("symbol:s ts_init:t fold:i", BRAND + FOLDS + " SELECT symbol, ts_init, fold FROM bars JOIN folds ON ts_init BETWEEN test_start AND test_end")
def fold_windows(spark, sf):
    bars = src.brand_bars(spark, sf)
    return wf.fold_windows(bars, folds_of(bars))


def _book_sql(targets: str, cost: float) -> str:
    """Fold books of a table of targets (trial, symbol, ts_init, close, target): daily returns, fold scores, trial scores."""
    book = "PARTITION BY trial, fold"
    return f""", wi AS (SELECT trial, fold, symbol, ts_init, close, target / (SELECT count(DISTINCT symbol) FROM bars) AS w FROM {targets} JOIN folds ON ts_init BETWEEN test_start AND test_end),
 bp AS (SELECT *, coalesce(close / lag(close) OVER s - 1, 0) AS r, coalesce(lag(w) OVER s, 0) AS wp FROM wi WINDOW s AS ({book}, symbol ORDER BY ts_init)),
 bb AS (SELECT *, sum(wp * r) OVER ({book}, ts_init) AS rr FROM bp),
 bl AS (SELECT trial, fold, ts_init, sum(wp * r) AS ret, sum(abs(w - wp * (1 + r) / (1 + rr)) * {cost}) AS fee FROM bb GROUP BY ALL),
 bg AS (SELECT *, 1 + ret - coalesce(lag(fee) OVER ({book} ORDER BY ts_init), 0) AS g FROM bl),
 be AS (SELECT trial, fold, CAST(ts_init AS DATE) AS d, exp(sum(ln(g)) OVER ({book} ORDER BY ts_init)) * (1 - fee) AS e FROM bg),
 bs AS (SELECT trial, fold, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM be GROUP BY trial, fold),
 bf AS (SELECT trial, fold, d, CASE WHEN row_number() OVER q = 1 THEN 1.0 ELSE last_value(e IGNORE NULLS) OVER q END AS e FROM bs LEFT JOIN be USING (trial, fold, d) WINDOW q AS ({book} ORDER BY d)),
 fr AS (SELECT * FROM (SELECT trial, fold, CAST(d AS TIMESTAMP) AS ts, lead(e) OVER ({book} ORDER BY d) / e - 1 AS ret FROM bf) WHERE ret IS NOT NULL),
 fsc AS (SELECT trial, fold, CASE WHEN count(*) < 2 OR stddev_samp(ret) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe, count(*) AS n FROM fr GROUP BY ALL),
 sc AS (SELECT trial, avg(sharpe) AS value, avg((sharpe > 0)::INT) AS positive_folds, count(*) AS folds FROM fsc GROUP BY trial)"""


def _sweep_sql(cost: float) -> str:
    ma = {n: _roll("avg(close)", n, "close") for n in (5, 10, 20, 40, 60)}
    rv = {n: f"({_roll('stddev_samp(ret)', n, 'ret')} * sqrt(252))" for n in (20, 63)}
    cols = ", ".join([f"{e} AS ma{n}" for n, e in ma.items()] + [f"{e} AS rv{n}" for n, e in rv.items()])
    grid = ", ".join(f"({i}, {p['fast']}, {p['slow']}, {p['vol_lookback']})" for i, p in enumerate(GRID))
    pick = lambda key, names: "CASE " + " ".join(f"WHEN {key} = {n} THEN {c}{n}" for c, n in names) + " END"
    vol = pick("vl", [("rv", 20), ("rv", 63)])
    gap = f"{pick('fast', [('ma', 5), ('ma', 10), ('ma', 20)])} - {pick('slow', [('ma', 40), ('ma', 60)])}"
    target = f"coalesce(sign({gap}) * CASE WHEN {vol} IS NOT NULL THEN least(0.1 / greatest({vol}, 1e-6), 5) END, 0)"
    return BRAND + _RET + FOLDS + f""", ind AS (SELECT symbol, ts_init, close, {cols} FROM r), grid(trial, fast, slow, vl) AS (VALUES {grid}),
 tg AS (SELECT trial, symbol, ts_init, close, {target} AS target FROM ind CROSS JOIN grid)""" + _book_sql("tg", cost)


def _sweep_of(trials: list[str], cost: float = 0.0005) -> str:
    """The same books for targets that strategy queries give, one query a trial."""
    parts = " UNION ALL ".join(f"SELECT {i} AS trial, symbol, ts_init, target FROM ({q})" for i, q in enumerate(trials))
    return f"{BRAND}{FOLDS}, tq AS ({parts}), tg AS (SELECT tq.*, close FROM tq JOIN bars USING (symbol, ts_init)){_book_sql('tg', cost)}"


SWEEP = _sweep_sql(0.0)
SWEEP_COST = _sweep_sql(0.0005)


def sweep(spark, sf, costs=portfolio.Costs(), stored=False):
    """Sweep returns; *stored* writes them once for statistics that read them repeatedly."""
    bars = src.brand_bars(spark, sf)
    returns = wf.sweep_trend(bars, folds_of(bars), GRID, costs)
    return store_once(returns) if stored else returns


def scored(spark, sf, costs=portfolio.Costs()):
    return wf.trial_scores(wf.fold_scores(sweep(spark, sf, costs)))


def with_params(spark, trials):
    rows = [(i, f"{p['fast']}/{p['slow']}/{p['vol_lookback']}") for i, p in enumerate(GRID)]
    return trials.join(F.broadcast(spark.createDataFrame(rows, "trial long, params string")), "trial")  # one row per trial


_LABELS = ", ".join(f"({i}, '{p['fast']}/{p['slow']}/{p['vol_lookback']}')" for i, p in enumerate(GRID))
_PARAMS = f", pm(trial, params) AS (VALUES {_LABELS})"


@query("trial:i fold:i ts:t ret:9", SWEEP + " SELECT * FROM fr")
def sweep_returns(spark, sf):
    return sweep(spark, sf)


@query("trial:i fold:i ts:t ret:9", SWEEP_COST + " SELECT * FROM fr")
def sweep_returns_costs(spark, sf):
    return sweep(spark, sf, COSTS)


@query("trial:i value:6 positive_folds:6 folds:i", SWEEP + " SELECT * FROM sc")
def sweep_mean_fold_sharpe(spark, sf):
    return scored(spark, sf)


_FOLD_SUM = SWEEP_COST + """, fo AS (SELECT trial, fold, count_if(abs(w - wp * (1 + r) / (1 + rr)) > 1e-12) AS orders FROM bb GROUP BY ALL),
fq AS (SELECT trial, fold, ts, exp(sum(ln(1 + ret)) OVER (PARTITION BY trial, fold ORDER BY ts)) AS eq FROM fr),
fd AS (SELECT *, eq / max(eq) OVER (PARTITION BY trial, fold ORDER BY ts) - 1 AS dr FROM fq),
fg AS (SELECT trial, fold, arg_max(eq, ts) - 1 AS total_return, min(dr) AS max_drawdown FROM fd GROUP BY ALL)"""


@query("trial:i fold:i sharpe:6 days:i total_return:8 max_drawdown:8 orders:i params:s", f"""{_FOLD_SUM}{_PARAMS}
 SELECT *, n AS days FROM fsc JOIN fg USING (trial, fold) JOIN fo USING (trial, fold) JOIN pm USING (trial)""")
def fold_summary(spark, sf):
    """Every fold of every trial with its parameters."""
    bars = src.brand_bars(spark, sf)
    return with_params(spark, wf.fold_summary(bars, wf.trend_targets(bars, GRID), folds_of(bars), COSTS))


@query("study:s trial:i fold:i ts:t ret:9", SWEEP + " SELECT 'trend' AS study, * FROM fr WHERE trial = 3")
def stored_returns(spark, sf):
    """Sweep returns written to a study store and one trial read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/returns-{uuid.uuid4().hex}"
    store.write_returns(sweep(spark, sf).withColumn("study", F.lit("trend")), path)
    return store.read_returns(spark, path).where("study = 'trend' AND trial = 3")


def _scores_of(spark, sf, strategy, grid):
    bars = store_once(src.brand_bars(spark, sf))
    returns = wf.sweep(bars, wf.strategy_targets(bars, strategy, grid), folds_of(bars), COSTS)
    return wf.fold_scores(returns)


def _scores_of_rule(spark, sf, rule, grid):
    bars = store_once(src.brand_bars(spark, sf))
    return wf.fold_scores(wf.sweep(bars, shared.rule_targets(bars, rule, grid), folds_of(bars), COSTS))


_SCORES = "trial:i fold:i sharpe:6 n:i"


@query(_SCORES, _sweep_of([tsm_sql(1), tsm_sql(21)]) + " SELECT * FROM fsc")
def sweep_ts_momentum(spark, sf):
    """Both trials from one scan: the strategy is declared."""
    return _scores_of_rule(spark, sf, shared.TS_MOMENTUM, [dict(lookback=60, skip_recent=5, vol_lookback=20, rebal_freq=f) for f in (1, 21)])


@query(_SCORES, _sweep_of([QUERY_REVERSION]) + " SELECT * FROM fsc")
def sweep_mean_reversion(spark, sf):
    return _scores_of(spark, sf, strategies.mean_reversion, [{}])


@query(_SCORES, _sweep_of([xsm_sql(60), xsm_sql(20)]) + " SELECT * FROM fsc")
def sweep_xs_momentum(spark, sf):
    """A cross-sectional strategy under the same folds, costs and calendar."""
    return _scores_of_rule(spark, sf, shared.XS_MOMENTUM, [dict(lookback=n, skip_recent=5, vol_lookback=20) for n in (60, 20)])


@query("trial:i fold_0:6 fold_1:6 fold_2:6 fold_3:6 fold_4:6", SWEEP + " SELECT trial, " + ", ".join(f"max(sharpe) FILTER (fold = {i}) AS fold_{i}" for i in range(5)) + " FROM fsc GROUP BY trial")
def trials_frame(spark, sf):
    return wf.trials_frame(wf.fold_scores(sweep(spark, sf)), 5)


@query("trial:i fold:s sharpe_a:6 sharpe_b:6", f"""SELECT a.trial, 'fold_' || a.fold AS fold, a.sharpe AS sharpe_a, b.sharpe AS sharpe_b
 FROM ({SWEEP} SELECT * FROM fsc) a JOIN ({SWEEP_COST} SELECT * FROM fsc) b USING (trial, fold)""")
def fold_comparison(spark, sf):
    a = wf.trials_frame(wf.fold_scores(sweep(spark, sf)), 5)
    b = wf.trials_frame(wf.fold_scores(sweep(spark, sf, COSTS)), 5)
    return wf.fold_comparison(a, b, 5)


@query("params:s value:6 trial:i", SWEEP + _PARAMS + " SELECT params, value, trial FROM sc JOIN pm USING (trial) ORDER BY value DESC, trial LIMIT 5")
def top_trials(spark, sf):
    return wf.top_trials(with_params(spark, scored(spark, sf)), 5)


@query("params:s screened:6 validated:6 diff:6", f"""SELECT params, a.value AS screened, b.value AS validated, b.value - a.value AS diff
 FROM ({SWEEP}{_PARAMS} SELECT * FROM sc JOIN pm USING (trial)) a JOIN ({SWEEP_COST} SELECT * FROM sc) b USING (trial)""")
def engine_comparison(spark, sf):
    """The same trials without and with costs, matched on their parameters."""
    return wf.engine_comparison(with_params(spark, scored(spark, sf)), with_params(spark, scored(spark, sf, COSTS)))


@query("study:s trial:i value:6", SWEEP + " SELECT 'vl ' || (trial % 2) AS study, arg_max(trial, value) AS trial, max(value) AS value FROM sc GROUP BY 1")
def best_trial(spark, sf):
    trials = scored(spark, sf).withColumn("study", F.concat(F.lit("vl "), F.col("trial") % 2))
    return wf.best_trial(trials, ["study"])


@query("study:s trials:i best:6", SWEEP + " SELECT 'vl ' || (trial % 2) AS study, count(*) AS trials, max(value) AS best FROM sc GROUP BY 1")
def list_studies(spark, sf):
    return wf.list_studies(scored(spark, sf).withColumn("study", F.concat(F.lit("vl "), F.col("trial") % 2)))


@query("trial:i value:6 best:6", SWEEP + " SELECT trial, value, max(value) OVER (ORDER BY trial) AS best FROM sc")
def best_so_far(spark, sf):
    trials = scored(spark, sf).withColumn("study", F.lit("s"))
    return wf.best_so_far(trials, Axis(keys=("study",), order="trial"))


@query("bin:i n:i", SWEEP + ", e AS (SELECT min(value) AS lo, max(value) AS hi FROM sc) SELECT least(floor((value - lo) / (hi - lo) * 4), 3) AS bin, count(*) AS n FROM sc, e GROUP BY 1")
def trial_histogram(spark, sf):
    return wf.histogram(store_once(scored(spark, sf)), "value", 4)


def _draw(name: str) -> str:
    return f"(CAST(('0x' || substr(md5('11:{name}:' || trial), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query("trial:i fast:i slow:i vol_target:8 vol_lookback:i cap:2", f"""SELECT trial, [5, 10, 20][CAST(floor({_draw('fast')} * 3) AS INT) + 1] AS fast, 40 + floor({_draw('slow')} * 9) * 20 AS slow,
 exp(ln(0.05) + {_draw('vol_target')} * (ln(0.4) - ln(0.05))) AS vol_target, 20 + floor({_draw('vol_lookback')} * 101) AS vol_lookback, 2.0 AS cap
 FROM (SELECT row_number() OVER () - 1 AS trial FROM customer) WHERE trial NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def random_params(spark, sf):
    """As many draws as there are customers, without those already scored (here: the keys of some customers)."""
    customers = src.table(spark, sf, "customer")
    space = {"fast": [5, 10, 20], "slow": {"low": 40, "high": 200, "step": 20}, "vol_target": {"low": 0.05, "high": 0.4, "log": True}, "vol_lookback": {"low": 20, "high": 120}, "cap": 2.0}
    drawn = wf.random_params(spark, space, customers.count(), 11)
    left = wf.pending_trials(drawn, customers.where("c_nationkey < 5").select(F.col("c_custkey").cast("long").alias("trial")))
    return left.select("trial", *[F.col("params")[n].alias(n) for n in space])


@query("trial:i fast:i slow:i vol_lookback:i fingerprint:s", "SELECT *, sha256('{\"fast\":' || fast || '.0,\"slow\":' || slow || '.0,\"vol_lookback\":' || vol_lookback || '.0}') AS fingerprint FROM (SELECT row_number() OVER (ORDER BY f, s, v) - 1 AS trial, f AS fast, s AS slow, v AS vol_lookback "
       "FROM (SELECT unnest([5, 10, 20]) AS f), (SELECT unnest([40, 60]) AS s), (SELECT unnest([20, 63]) AS v)) WHERE trial NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def param_grid(spark, sf):
    """What is left of the grid in a resumed study; the nations of region 1 stand for the trials already scored."""
    grid = wf.param_grid(spark, {"fast": [5, 10, 20], "slow": [40, 60], "vol_lookback": [20, 63]})
    done = src.table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("trial"))
    return wf.pending_trials(grid, done).select(
        "trial", *[F.col("params")[n].alias(n) for n in ("fast", "slow", "vol_lookback")], wf.fingerprint(F.col("params")).alias("fingerprint")
    )


@query("ts_init:t ret:8 fee:8 equity:6", TGT.replace("(PARTITION BY symbol ORDER BY ts_init), 0) AS wp FROM wt)", "(PARTITION BY symbol ORDER BY ts_init), 0) AS wp FROM wt WHERE ts_init >= (SELECT ts_init FROM (SELECT DISTINCT ts_init FROM bars) ORDER BY 1 LIMIT 1 OFFSET 252))") + _LED + " SELECT * FROM led")
def full_backtest(spark, sf):
    return wf.full_backtest(targets(spark, sf), 252, COSTS)


_ALL = f"""WITH tg AS (SELECT 'trend' AS strategy, * FROM ({QUERY_TREND}) UNION ALL SELECT 'momentum', * FROM ({QUERY_MOMENTUM}) UNION ALL SELECT 'reversion', * FROM ({QUERY_REVERSION})),
b AS ({BRAND} SELECT * FROM bars), fo AS ({BRAND}{FOLDS} SELECT * FROM folds),
e AS (SELECT strategy, symbol, ts_init, lag(target) OVER w * (close / lag(close) OVER w - 1) AS ret FROM tg JOIN b USING (symbol, ts_init) WINDOW w AS (PARTITION BY strategy, symbol ORDER BY ts_init))
SELECT strategy, symbol, count(*) AS n, CASE WHEN count(*) < 2 OR stddev_samp(ret) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe FROM e JOIN fo ON ts_init BETWEEN test_start AND test_end WHERE ret IS NOT NULL GROUP BY 1, 2"""


@query("strategy:s symbol:s n:i sharpe:6", _ALL)
def run_all(spark, sf):
    bars = src.brand_bars(spark, sf)
    return wf.run_all(
        {
            "trend": strategies.trend_following(bars),
            "momentum": strategies.ts_momentum(bars, 60, 5, vol_lookback=20),
            "reversion": strategies.mean_reversion(bars),
        },
        folds_of(bars),
    )


_BY_CLASS = (
    xsm_sql(60).replace("cuts AS (SELECT t, quantile", "cuts AS (SELECT t, substr(symbol, 7, 1) AS u, quantile").replace("GROUP BY t HAVING", "GROUP BY t, u HAVING")
    .replace("FROM m LEFT JOIN cuts USING (t))", "FROM m LEFT JOIN cuts ON cuts.t = m.t AND cuts.u = substr(m.symbol, 7, 1))")
)
_BOOKS = f"""{BRAND}{FOLDS}, tg AS (SELECT q.*, close FROM (SELECT 'trend/' || symbol AS trial, symbol, ts_init, target FROM ({QUERY_TREND})
 UNION ALL SELECT 'reversion/' || symbol, symbol, ts_init, target FROM ({QUERY_REVERSION}) UNION ALL SELECT 'ranks/class ' || substr(symbol, 7, 1), symbol, ts_init, target FROM ({_BY_CLASS})) q JOIN bars USING (symbol, ts_init))
{_book_sql("tg", 0.0005).replace("(SELECT count(DISTINCT symbol) FROM bars)", "(SELECT count(DISTINCT z.symbol) FROM tg z WHERE z.trial = tg.trial)").replace("exp(sum(ln(g)) OVER (PARTITION BY trial, fold ORDER BY ts_init))", "product(g) OVER (PARTITION BY trial, fold ORDER BY ts_init)")}
SELECT split_part(trial, '/', 1) AS strategy, split_part(trial, '/', 2) AS universe, CASE WHEN count(*) < 2 OR stddev_samp(ret) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe,
 product(1 + ret) - 1 AS total_return, count(*) AS n FROM fr GROUP BY trial"""


@query("strategy:s universe:s sharpe:6 total_return:6 n:i", _BOOKS)
def run_books(spark, sf):
    """Single-asset strategies on every brand and a ranking one on every class of brands, with costs, by stitched folds."""
    bars = src.brand_bars(spark, sf)
    alone = lambda df: df.withColumn("universe", F.col("symbol"))
    classes = panel.align_union(bars).withColumn("universe", F.concat(F.lit("class "), F.substring("symbol", 7, 1)))
    ranks = strategies.clean_signal(strategies.xs_momentum(classes, 60, 5, vol_lookback=20, axis=DAILY.within("universe"))).where("real")
    every = {"trend": alone(strategies.trend_following(bars)), "reversion": alone(strategies.mean_reversion(bars)), "ranks": panel.exit_delisted(ranks)}
    return wf.run_books(every, folds_of(bars), COSTS)


# -- selection bias ----------------------------------------------------------------


def _observed(rows: str, keys: str) -> str:
    return f"""(SELECT {keys}, count(*) AS n, count(*) / ((datediff('day', min(ts), max(ts)) + 1) / 365.25) AS periods,
  CASE WHEN count(*) < 2 OR stddev_samp(ret) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(count(*) / ((datediff('day', min(ts), max(ts)) + 1) / 365.25)) END AS sharpe,
  avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) AS skew, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) AS kurtosis
  FROM (SELECT *, avg(ret) OVER (PARTITION BY {keys}) AS mu FROM {rows}) GROUP BY {keys})"""


_OBS = _EARN + f", ob AS {_observed('sr', 'symbol')}, tv AS (SELECT count(*) AS n_trials, stddev_samp(sharpe) AS trial_std FROM ob)"


@query("symbol:s n:i periods:6 sharpe:6 skew:6 kurtosis:6", _OBS + " SELECT * FROM ob")
def observed_sharpe(spark, sf):
    return stats.observed_sharpe(symbol_returns(spark, sf), ["symbol"])


def deflation_inputs(spark, sf):
    own = store_once(stats.observed_sharpe(symbol_returns(spark, sf), ["symbol"]))
    spread = own.agg(F.struct(F.count(F.lit(1)).alias("n_trials"), F.stddev_samp("sharpe").alias("trial_std")).alias("s"))
    return own.withColumn("s", spread.scalar()).select(*own.columns, "s.*")


def _ppf(p: str) -> str:
    """One Newton step on the rational quantile, as a scalar subquery-free expression."""
    return f"(SELECT x0 - ({cdf_sql('x0')} - p) / {pdf_sql('x0')} FROM (SELECT {p} AS p, {ppf_sql(p)} AS x0))"


_EMS = f"""(SELECT CASE WHEN n_trials <= 1 THEN 0 ELSE trial_std * ((1 - 0.5772156649015329) * z1 + 0.5772156649015329 * z2) END FROM
 (SELECT n_trials, trial_std, {_ppf('(1 - 1.0 / n_trials)')} AS z1, {_ppf('(1 - 1.0 / (n_trials * 2.718281828459045))')} AS z2 FROM tv))"""


@query("n_trials:i expected_max:6", _OBS + f" SELECT n_trials, {_EMS} AS expected_max FROM tv")
def expected_max_sharpe(spark, sf):
    spread = deflation_inputs(spark, sf).select("n_trials", "trial_std").distinct()
    return stats.expected_max_sharpe(spread)


def _psr(bench: str) -> str:
    z = (f"((sharpe - {bench}) / sqrt(periods) * sqrt(n - 1) / sqrt(1 - skew * sharpe / sqrt(periods) + 0.25 * (kurtosis - 1) * pow(sharpe / sqrt(periods), 2)))")
    return f"(SELECT {cdf_sql('zz')} FROM (SELECT {z} AS zz))"


@query("symbol:s psr:6", _OBS + f" SELECT symbol, {_psr('0')} AS psr FROM ob")
def probabilistic_sharpe(spark, sf):
    return stats.probabilistic_sharpe(deflation_inputs(spark, sf), F.lit(0.0))


@query("symbol:s dsr:6", _OBS + f", ems AS (SELECT {_EMS} AS b) SELECT symbol, {_psr('b')} AS dsr FROM ob, ems")
def deflated_sharpe(spark, sf):
    return stats.deflated_sharpe(deflation_inputs(spark, sf))


_MTR = f"""CASE WHEN sharpe <= 0 THEN 'inf'::DOUBLE ELSE 1 + (1 - skew * sharpe / sqrt(periods) + 0.25 * (kurtosis - 1) * pow(sharpe / sqrt(periods), 2)) * pow({_ppf('0.95')} / (sharpe / sqrt(periods)), 2) END"""


@query("symbol:s min_track_record:3", _OBS + f" SELECT symbol, {_MTR} AS min_track_record FROM ob")
def min_track_record(spark, sf):
    return stats.min_track_record(deflation_inputs(spark, sf))


def _pbo(rows: str) -> str:
    return f"""(WITH sh AS (SELECT x.*, dense_rank() OVER (ORDER BY ts) AS dr FROM {rows} x WHERE ts IN (SELECT ts FROM {rows} GROUP BY ts HAVING count(DISTINCT trial) = (SELECT count(DISTINCT trial) FROM {rows}))),
 nt AS (SELECT max(dr) AS tt FROM sh), bl AS (SELECT trial, ret, CASE WHEN dr <= (tt % 8) * (tt // 8 + 1) THEN (dr - 1) // (tt // 8 + 1) ELSE (tt % 8) + (dr - 1 - (tt % 8) * (tt // 8 + 1)) // (tt // 8) END AS block FROM sh, nt),
 sp AS (SELECT range AS split FROM range(256) WHERE bit_count(range::BIGINT) = 4),
 sr2 AS (SELECT split, trial, (split >> block::BIGINT) & 1 AS inside, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) ELSE 0 END AS s FROM bl, sp GROUP BY ALL),
 io AS (SELECT split, trial, max(s) FILTER (inside = 1) AS i, max(s) FILTER (inside = 0) AS o FROM sr2 GROUP BY ALL),
 wn AS (SELECT split, arg_max(o, row(i, -trial)) AS won FROM io GROUP BY split),
 rk AS (SELECT split, (count_if(o < won) + (count_if(o = won) + 1) / 2.0) / (count(*) + 1) AS rank FROM io JOIN wn USING (split) GROUP BY split)
 SELECT avg((ln(rank / (1 - rank)) <= 0)::INT) AS pbo, count(*) AS splits FROM rk)"""


_ST = ", st AS (SELECT trial, ts, product(1 + ret) - 1 AS ret FROM fr GROUP BY ALL)"


@query("pbo:6 splits:i", SWEEP + _ST + f" SELECT * FROM {_pbo('st')}")
def pbo_cscv(spark, sf):
    return stats.pbo_cscv(stats.stitch_returns(sweep(spark, sf, stored=True), ["trial"]))


_SUM = SWEEP + _ST + f""", ba AS (SELECT arg_max(trial, row(value, -trial)) AS trial FROM sc), bo AS (SELECT ob.*, sc.value, sc.positive_folds FROM {_observed('st', 'trial')} ob JOIN ba USING (trial) JOIN sc USING (trial)),
tv AS (SELECT count(*) AS n_trials, stddev_samp(sharpe) AS trial_std FROM {_observed('st', 'trial')}),
bq AS (SELECT ts, exp(sum(ln(1 + ret)) OVER (ORDER BY ts)) AS eq FROM st JOIN ba USING (trial)),
bd AS (SELECT ts, eq, eq / max(eq) OVER (ORDER BY ts) - 1 AS dr FROM bq),
ems AS (SELECT {_EMS} AS b),
summary AS (SELECT 'trend' AS study, bo.*, n_trials, trial_std, (SELECT arg_max(eq, ts) - 1 FROM bd) AS total_return, (SELECT min(dr) FROM bd) AS max_drawdown,
 {_psr('0')} AS psr, {_psr('b')} AS dsr, {_MTR} / periods AS min_track_record_years, (SELECT pbo FROM {_pbo('st')}) AS pbo FROM bo, tv, ems)"""


def study(spark, sf):
    folds_returns = sweep(spark, sf, stored=True).withColumn("study", F.lit("trend"))
    rows = wf.fold_scores(folds_returns).withColumn("study", F.lit("trend"))
    return stats.summarize_study(stats.stitch_returns(folds_returns, ["study", "trial"]), rows)


@query("study:s trial:i value:6 positive_folds:6 n:i sharpe:6 n_trials:i trial_std:6 total_return:6 max_drawdown:6 psr:6 dsr:6 min_track_record_years:4 pbo:6", _SUM + " SELECT * FROM summary")
def summarize_study(spark, sf):
    return study(spark, sf)


@query("study:s trial:i value:6 n_trials:i trial_std:6 dsr:6 pbo:6", _SUM + " SELECT * FROM summary")
def summarize_selected(spark, sf):
    """The best three trials, judged by the whole search that they were chosen from."""
    everything = sweep(spark, sf, stored=True).withColumn("study", F.lit("trend"))
    best = wf.trial_scores(wf.fold_scores(everything)).orderBy(F.desc("value"), "trial").limit(3).select("trial")
    chosen = everything.join(F.broadcast(best), "trial", "left_semi")  # three rows
    rows = wf.fold_scores(chosen).withColumn("study", F.lit("trend"))
    keys = ["study", "trial"]
    return stats.summarize_study(stats.stitch_returns(chosen, keys), rows, stats.stitch_returns(everything, keys))


_DIFF = f"""(SELECT max(abs(b.value - a.value)) FROM ({SWEEP} SELECT * FROM sc) a JOIN ({SWEEP_COST} SELECT * FROM sc) b USING (trial))"""


@query("study:s check:s value:4 passed:b", _SUM + f""" SELECT study, 'beats_benchmark' AS "check", sharpe AS value, sharpe > (SELECT avg(value) FROM sc) AS passed FROM summary
 UNION ALL SELECT study, 'methods_agree_within_5pct_sharpe', {_DIFF}, {_DIFF} <= 0.05 FROM summary""")
def checks_against(spark, sf):
    """The study against the mean trial, and its scores against those of another method (here: with costs)."""
    free = store_once(with_params(spark, scored(spark, sf)))
    worst = wf.engine_comparison(free, with_params(spark, scored(spark, sf, COSTS))).agg(F.max(F.abs("diff"))).scalar()
    found = stats.checks(study(spark, sf), free.agg(F.avg("value")).scalar(), worst)
    return found.where("check IN ('beats_benchmark', 'methods_agree_within_5pct_sharpe')")


@query("study:s check:s value:4 passed:b", _SUM + """ SELECT study, 'deflated_sharpe_at_least_95' AS "check", dsr AS value, dsr >= 0.95 AS passed FROM summary
 UNION ALL SELECT study, 'overfitting_probability_below_half', pbo, pbo < 0.5 FROM summary
 UNION ALL SELECT study, 'folds_positive_at_least_60pct', positive_folds, positive_folds >= 0.6 FROM summary
 UNION ALL SELECT study, 'track_record_long_enough', min_track_record_years, min_track_record_years <= n / periods FROM summary""")
def checks(spark, sf):
    return stats.checks(study(spark, sf))


# -- attribution ----------------------------------------------------------------------

_ATT = TGT + ALIGN + """, pt AS (SELECT p.*, last_value(g.target IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.t) AS target FROM panel p LEFT JOIN tgt g ON g.symbol = p.symbol AND g.ts_init = p.ts_init),
pp AS (SELECT *, target / (SELECT count(DISTINCT symbol) FROM bars) AS p, coalesce(lead(close) OVER s / close - 1, 0) AS r, coalesce(close / lag(close) OVER s - 1, 0) AS back FROM pt WINDOW s AS (PARTITION BY symbol ORDER BY t)),
bc AS (SELECT t, max(ts_init) AS ts_init, sum(p * r) AS total, sum(greatest(p, 0) * r) AS long_leg, sum(least(p, 0) * r) AS short_leg, avg(p) * sum(r) AS market_timing, sum(p) AS net, sum(abs(p)) AS gross, avg(back) AS uni FROM pp GROUP BY t),
se AS (SELECT lead(ts_init) OVER (ORDER BY t) AS ts, total, long_leg, short_leg, market_timing, total - market_timing AS selection, net, gross, lead(uni) OVER (ORDER BY t) AS bench FROM bc),
sz AS (SELECT * FROM se WHERE ts >= TIMESTAMP '1996-06-01'), bt AS (SELECT covar_samp(total, bench) / var_samp(bench) AS beta FROM sz),
sh AS (SELECT sz.*, beta, total - beta * bench AS beta_hedged FROM sz, bt)"""

_START = "1996-06-01"


def attributed(spark, sf):
    frame = panel.align_union(targets(spark, sf))
    return att.attribution_series(frame, F.to_timestamp(F.lit(_START)))


@query("ts:t total:8 long_leg:8 short_leg:8 market_timing:8 selection:8 net:6 gross:6 bench:6", _ATT + " SELECT * FROM sz")
def attribution_series(spark, sf):
    return attributed(spark, sf)


@query("ts_init:t bench:8", BRAND + """, d AS (SELECT DISTINCT ts_init FROM bars), o AS (SELECT o_orderdate + INTERVAL 1 DAY AS ts_init, arg_max(o_totalprice, o_orderkey) AS close FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1),
a AS (SELECT d.ts_init, o.close FROM d ASOF LEFT JOIN o ON d.ts_init >= o.ts_init) SELECT ts_init, coalesce(close / lag(close) OVER (ORDER BY ts_init) - 1, 0) AS bench FROM a""")
def benchmark_align(spark, sf):
    return att.benchmark_align(src.brand_bars(spark, sf), src.order_bars(spark, sf).where("symbol = '2-HIGH'"))


@query("trial:s ts:t ret:8", _EARN + ", ix AS (SELECT DISTINCT o_orderdate AS ts FROM orders WHERE o_orderpriority = '2-HIGH') SELECT trial, ts, product(1 + ret) - 1 AS ret FROM sr WHERE ts IN (SELECT ts FROM ix) GROUP BY ALL")
def within_reference_days(spark, sf):
    days = src.table(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderdate").cast("timestamp").alias("ts"))
    return stats.within(stats.stitch_returns(symbol_returns(spark, sf), ["trial"]), days)


@query("component:s ann_return:6 ann_vol:6 sharpe:6", _ATT + "".join(
    (" UNION ALL" if i else "") + f" SELECT '{c}' AS component, avg({c}) * 252 AS ann_return, stddev_samp({c}) * sqrt(252) AS ann_vol, avg({c}) / stddev_samp({c}) * sqrt(252) AS sharpe FROM sh"
    for i, c in enumerate(att.COMPONENTS)))
def attribution_components(spark, sf):
    return att.components(attributed(spark, sf))


@query("mean_net:6 mean_gross:6 beta:6 correlation:6", _ATT + " SELECT avg(net) AS mean_net, avg(gross) AS mean_gross, max(beta) AS beta, corr(total, bench) AS correlation FROM sh")
def attribution_exposure(spark, sf):
    return att.exposure(attributed(spark, sf))


@query("ts:t component:s growth:6", _ATT + "".join(
    (" UNION ALL" if i else "") + f" SELECT ts, '{c}' AS component, exp(sum(ln(1 + {c})) OVER (ORDER BY ts)) AS growth FROM sh" for i, c in enumerate(att.COMPONENTS)))
def cumulative_components(spark, sf):
    return att.cumulative_components(attributed(spark, sf))


@query("symbol:s contribution_bp:4", _ATT + """, cb AS (SELECT symbol, p * (lead(close) OVER s / close - 1) AS e, lead(ts_init) OVER s AS nts FROM pp WINDOW s AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, coalesce(sum(e), 0) * 1e4 AS contribution_bp FROM cb WHERE nts >= TIMESTAMP '1996-06-01' GROUP BY symbol""")
def contributors(spark, sf):
    return att.contributors(panel.align_union(targets(spark, sf)), F.to_timestamp(F.lit(_START)))


@query("hit_rate:6 base_rate:6 long_hit_rate:6 short_hit_rate:6 share_long:6 positions:i rank_ic:6 rank_ic_t:6 ic_dates:i", _ATT + """, fw AS (SELECT *, ln(lead(close, 21) OVER s) - ln(close) AS fwd FROM pp WINDOW s AS (PARTITION BY symbol ORDER BY t)),
ho AS (SELECT * FROM fw WHERE t >= 101 AND t < (SELECT max(t) FROM panel) + 1 - 21 AND (t - 101) % 21 = 0 AND target <> 0 AND fwd IS NOT NULL),
hr AS (SELECT avg((sign(fwd) = sign(target))::INT) AS hit_rate, avg((fwd > 0)::INT) AS base_rate, avg((fwd > 0)::INT) FILTER (target > 0) AS long_hit_rate, avg((fwd < 0)::INT) FILTER (target < 0) AS short_hit_rate,
 avg((target > 0)::INT) AS share_long, count(*) AS positions FROM ho),
rk AS (SELECT t, count(*) OVER (PARTITION BY t) AS n, rank() OVER (PARTITION BY t ORDER BY target) + (count(*) OVER (PARTITION BY t, target) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY t ORDER BY fwd) + (count(*) OVER (PARTITION BY t, fwd) - 1) / 2.0 AS b FROM ho),
ic AS (SELECT t, corr(a, b) AS ic FROM rk WHERE n >= 11 GROUP BY t)
SELECT hr.*, avg(ic) AS rank_ic, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS rank_ic_t, count(ic) AS ic_dates FROM hr, ic WHERE NOT isnan(ic) GROUP BY ALL""")
def signal_quality(spark, sf):
    return att.signal_quality(panel.align_union(targets(spark, sf)), 21, 101)
