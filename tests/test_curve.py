"""Roll rules, splicing and contract names."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidebar.functions import symbols as sym
from tidebar.operators import curve
from tidebar.operators.clean import drop_scale_glitches, repair_prices

DAY0 = dt.datetime(2024, 1, 1)


def day(i: int) -> dt.datetime:
    return DAY0 + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def market(spark):
    """Nine quarterly contracts whose volume peaks 8 to 97 days before expiry."""
    rng = np.random.default_rng(5)
    spot = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 700)))
    bars, contracts = [], []
    for q in range(9):
        expiry = 75 + 91 * q
        name = f"C{q}"
        contracts.append(("ES.FUT", name, day(expiry), "HMUZ"[q % 4]))
        for i in range(max(0, expiry - 200), min(expiry + 1, 700)):
            left = expiry - i
            volume = 2e5 if left > 97 else 1e6 if left > 7 else 1e5
            bars.append(("ES.FUT", name, day(i), day(i + 1), float(spot[i] * np.exp(0.0002 * left)), volume))
    frame = spark.createDataFrame(bars, "symbol string, instrument_id string, ts_event timestamp, ts_init timestamp, close double, volume double")
    frame = frame.withColumns({c: F.col("close") for c in ("open", "high", "low")})
    return frame, spark.createDataFrame(contracts, "symbol string, instrument_id string, expiry timestamp, month string")


def loop_schedule(bars, contracts, method, days_before):
    """The rule as a plain walk over closes."""
    rank = {r.instrument_id: (i, r.expiry) for i, r in enumerate(sorted(contracts.collect(), key=lambda r: r.expiry))}
    table = {}
    for r in bars.collect():
        table.setdefault(r.ts_init, {})[r.instrument_id] = r.volume
    stop = {name: max(t for t, v in table.items() if name in v) for name in rank}
    active, out = None, []
    for ts in sorted(table):
        offers = table[ts]
        if active is None:
            active = max(offers, key=lambda n: (offers[n], -rank[n][0]))
            out.append((active, None))
            continue
        later = sorted((n for n in offers if rank[n][0] > rank[active][0]), key=lambda n: rank[n][0])
        if not later:
            continue
        if method == "volume":
            best = max(later, key=lambda n: (offers[n], -rank[n][0]))
            due = offers[best] > offers.get(active, -1.0)
        else:
            best, due = later[0], ts >= rank[active][1] - dt.timedelta(days=days_before)
        if due and (active in offers or ts > stop[active]):
            active = best
            out.append((active, ts))
    return out


@pytest.mark.parametrize("method", ["volume", "calendar"])
@pytest.mark.parametrize("gappy", [False, True])
def test_roll_schedule_is_the_walk(market, method, gappy):
    bars, contracts = market
    if gappy:  # an active contract without a bar on the due day must wait, unless it stopped
        bars = bars.where("NOT (instrument_id IN ('C1', 'C3') AND day(ts_init) % 4 = 1) AND NOT (instrument_id = 'C4' AND ts_init > TIMESTAMP '2025-02-20')")
    got = curve.roll_schedule(bars, contracts, method, 8).orderBy("seq").collect()
    assert [(r.instrument_id, r.start_ts) for r in got] == loop_schedule(bars, contracts, method, 8)
    assert all(a.end_ts == b.start_ts for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("method", ["volume", "calendar"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_roll_schedule_of_ragged_markets(spark, method, seed):
    """Contracts that stop early, closes that only have earlier ones, ties in volume, and two roots in one plan."""
    rng = np.random.default_rng(seed)
    bars, contracts = [], []
    for root in ("A.FUT", "B.FUT"):
        for q in range(7):
            name, expiry = f"{root[0]}{q}", 20 + 15 * q
            contracts.append((root, name, day(expiry), "H"))
            last = expiry - int(rng.integers(-3, 12))
            for i in range(max(0, expiry - 45), last + 1):
                if rng.random() < 0.6 and not (40 <= i < 47 and q > 2):
                    bars.append((root, name, day(i + 1), float(rng.integers(0, 4))))
    frame = spark.createDataFrame(bars, "symbol string, instrument_id string, ts_init timestamp, volume double").repartition(3)
    listed = spark.createDataFrame(contracts, "symbol string, instrument_id string, expiry timestamp, month string")
    got = curve.roll_schedule(frame, listed, method, 4).collect()
    for root in ("A.FUT", "B.FUT"):
        mine = sorted((r.seq, r.instrument_id, r.start_ts) for r in got if r.symbol == root)
        names = {b[1] for b in bars if b[0] == root}
        own = listed.where(F.col("symbol") == root).where(F.col("instrument_id").isin(*names))
        assert [x[1:] for x in mine] == loop_schedule(frame.where(F.col("symbol") == root), own, method, 4)


def test_months_limit_the_contracts(market):
    bars, contracts = market
    got = curve.roll_schedule(bars, contracts, "volume", months="MZ").collect()
    assert {r.instrument_id for r in got} <= {"C1", "C3", "C5", "C7"}


def test_back_adjusted_returns_are_held_returns(market):
    bars, contracts = market
    schedule = curve.roll_schedule(bars, contracts, "volume")
    adjusted = curve.back_adjust(bars, schedule).orderBy("ts_init").toPandas()
    closes = {(r.instrument_id, r.ts_init): r.close for r in bars.collect()}
    for (_, a), (_, b) in zip(adjusted.iloc[:-1].iterrows(), adjusted.iloc[1:].iterrows()):
        held = b.instrument_id if (b.instrument_id, a.ts_init) in closes else a.instrument_id
        assert b.close / a.close == pytest.approx(
            closes[b.instrument_id, b.ts_init] / closes[held, a.ts_init] if held == b.instrument_id else b.close / a.close, rel=0.05
        )
    last = adjusted[adjusted.instrument_id == adjusted.instrument_id.iloc[-1]]
    assert last.close.iloc[-1] == pytest.approx(closes[last.instrument_id.iloc[-1], last.ts_init.iloc[-1]])
    assert len(adjusted) == adjusted.ts_init.nunique()


def test_later_rolls_scale_history_by_one_constant(market):
    bars, contracts = market
    cut = bars.where("ts_init <= TIMESTAMP '2025-03-01'")
    early = curve.back_adjust(cut, curve.roll_schedule(cut, contracts)).toPandas().set_index("ts_init").close
    late = curve.back_adjust(bars, curve.roll_schedule(bars, contracts)).toPandas().set_index("ts_init").close
    ratio = (late.reindex(early.index) / early).to_numpy()
    assert ratio == pytest.approx(np.full(len(ratio), ratio[0]), rel=1e-9)


@pytest.mark.parametrize("near,far,months", [
    ("ESH6", "ESM6", 3), ("ESZ9", "ESH0", 3), ("ESZ6", "ESU6", None), ("BRN FMG0019!", "BRN FMH0019!", 1), ("FGBL SI 20260908 PS", "FGBL SI 20261208 PS", 3),
    ("ESH6", "BRN FMG0019!", None), ("junk", "ESH6", None), ("CLF27", "CLG28", 13),
])
def test_months_between(spark, near, far, months):
    frame = spark.createDataFrame([(near, far)], "a string, b string")
    m = sym.months_between(sym.contract_month(F.col("a")), sym.contract_month(F.col("b")))
    assert frame.select(m).first()[0] == months


def test_forward_only_matches_the_loop(spark):
    rng = np.random.default_rng(0)
    names = [f"ES{c}{y}_{2020 + y}" for y in range(4) for c in "HMUZ"]
    rows, want = [], {}
    for case in range(60):
        base, seq = 0, []
        while len(seq) < 40:
            base = min(base + int(rng.integers(0, 2)), len(names) - 3)
            seq += [names[base + int(rng.integers(0, 3))]] * int(rng.integers(1, 5))
        key, held, run, cand, out = f"k{case}", seq[0], 0, None, []
        for n in seq:
            if n != held and names.index(n) > names.index(held):
                run, cand = (run + 1 if n == cand else 1), n
                if run >= 3:
                    held, cand, run = n, None, 0
            else:
                cand, run = None, 0
            out.append(held)
        want[key] = out
        rows += [(key, day(i), n) for i, n in enumerate(seq)]
    frame = spark.createDataFrame(rows, "symbol string, ts_init timestamp, contract string")
    got = curve.forward_only(frame, 3).orderBy("symbol", "ts_init").toPandas().groupby("symbol")["held"].apply(list)
    assert got.to_dict() == want


def test_repair_and_glitches(spark, daily):
    frame = spark.createDataFrame([("a", 0.0, 9.0, -1.0, 10.0), ("a", 5.0, 6.0, 4.0, 0.0), ("a", 8.0, 9.0, 7.0, 8.5)], "symbol string, open double, high double, low double, close double")
    assert [tuple(r)[1:] for r in repair_prices(frame).collect()] == [(10.0, 10.0, 10.0, 10.0), (8.0, 9.0, 7.0, 8.5)]
    closes = [100, 101, 1010, 102, 103, 9, 104, 320]
    kept = drop_scale_glitches(daily({"x": closes})).orderBy("ts_init").toPandas().close.tolist()
    assert kept == [100, 101, 102, 103, 104, 320]


def fx(spark, rows):
    return spark.createDataFrame([(d.date(), r) for d, r in rows], "date date, rate double")


def test_to_usd(spark, daily):
    bars = daily({"x": [100.0, 110.0, 105.0]}, DAY0)
    got = curve.to_usd(bars, fx(spark, [(day(-2), 1.0), (day(0), 1.2), (day(2), 1.5)])).orderBy("ts_init").toPandas()
    assert got.close.tolist() == pytest.approx([120.0, 132.0, 124.5])
    with pytest.raises(PySparkException):
        curve.to_usd(bars, fx(spark, [(day(1), 1.0)])).collect()
    with pytest.raises(PySparkException):
        curve.to_usd(daily({"x": [100.0, 10.0]}, DAY0), fx(spark, [(day(0), 1.0), (day(1), 2.0)])).collect()


def test_calendar_roll_reports_a_hole(spark, daily):
    """Contracts that never share a close make the schedule unusable."""
    front = daily({"x": [10.0] * 90}, DAY0)
    second = daily({"x": [10.0] * 28 + [None] * 62}, DAY0)
    span = lambda rows: spark.createDataFrame([("x", day(a).date(), day(b).date(), n) for a, b, n in rows], "symbol string, d0 date, d1 date, raw_symbol string")
    near = span([(0, 30, "XXF4"), (30, 60, "XXG4"), (60, 90, "XXH4")])
    far = span([(0, 30, "XXG4"), (30, 60, "XXH4"), (60, 90, "XXJ4")])
    _, schedule = curve.calendar_roll(front, second, near, far)
    assert schedule.select("status").distinct().collect()[0][0] == "contracts share no close before the roll"
    with pytest.raises(PySparkException):
        curve.require_ok(schedule).collect()
    _, good = curve.calendar_roll(front, daily({"x": [10.0] * 90}, DAY0), near, far)
    rolls = good.orderBy("seq").collect()
    assert [r.instrument_id for r in rolls] == ["XXF4_2024", "XXG4_2024", "XXH4_2024"]
    assert [r.start_ts for r in rolls] == [None, day(26), day(56)]


def test_outright_bars_aggregate_ticks_once(spark):
    """Schedules and splices read stored bars, not the ticks again at every step."""
    from tidebar.plans import curves

    for frame in curves.parent(spark, "/root/testdata/sf0.001"):
        assert "lineitem" not in frame._jdf.queryExecution().toString() and frame.count() > 0
