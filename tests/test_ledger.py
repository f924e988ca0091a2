"""The ledger of units, solved over spans of time, against one long walk in plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tidebar.operators import ledger as module
from tidebar.operators.ledger import ledger_exact
from tidebar.operators.portfolio import Costs

DAY0 = dt.datetime(2020, 1, 1)


def walk(rows, costs, capital, band, whole, rolls):
    """Equity before and after, orders and rolls of each (book, day)."""
    out = {}
    for book in sorted({r[0] for r in rows}):
        pos, last, size, tick, held, equity = {}, {}, {}, {}, {}, capital
        for day in sorted({r[1] for r in rows if r[0] == book}):
            here = sorted((r for r in rows if r[:2] == (book, day)), key=lambda r: (r[2], r[3]))
            for _, _, _, name, close, *_ in here:
                if close is not None and close > 0:
                    if pos.get(name):
                        equity += pos[name] * size[name] * (close - last[name])
                    last[name], size[name], tick[name] = close, 2.0, 0.5
            before, orders, turned = equity, 0, 0
            fee = lambda q, c: abs(q) * (costs.rate * c * 2.0 + costs.per_contract + costs.slippage_prob * 0.5 * 2.0)
            for _, _, symbol, name, close, w, active in here:
                if not active:
                    continue
                rolled = rolls and symbol in held and held[symbol] != name
                if rolled:
                    turned += 1
                    old = held.pop(symbol)
                    if pos.get(old):
                        equity -= fee(pos[old], last[old])
                        pos[old] = 0.0
                        orders += 1
                if w is None or close is None or not close > 0 or before <= 0:
                    continue
                goal = w * before / (close * 2.0)
                if whole:
                    goal = round(goal / 3.0) * 3.0
                q = goal - pos.get(name, 0.0)
                if q == 0 or not rolled and abs(q) * close * 2.0 < band * before:
                    continue
                equity -= fee(q, close)
                pos[name] = goal
                held[symbol] = name
                orders += 1
            out[book, day] = (before, equity, orders, turned)
    return out


def market(seed, rolls, wild):
    r, rows = random.Random(seed), []
    for book in range(3):
        for symbol in "abc":
            price, w = 100.0, 0.0
            for day in range(60 if book else 7):
                price *= 1 + r.gauss(0, 0.6 if wild else 0.02)
                price = max(price, 0.01)
                if r.random() < 0.2:
                    w = r.uniform(-2, 2) if wild else r.uniform(-0.5, 0.5)
                if r.random() < 0.1:
                    continue
                close = r.choice([None, -1.0]) if r.random() < 0.03 else price
                target = None if r.random() < 0.05 else w
                if not rolls:
                    rows.append((book, day, symbol, symbol, close, target, True))
                    continue
                now = day // 13
                rows.append((book, day, symbol, f"{symbol}{now}", close, target, True))
                if now and r.random() < 0.8:
                    rows.append((book, day, symbol, f"{symbol}{now - 1}", price * 1.01, None, False))
    return rows


@pytest.mark.parametrize("whole,rolls,wild,band", [(False, False, False, 0.0), (False, False, False, 0.05), (True, False, False, 0.02), (True, True, False, 0.05), (False, True, False, 0.0),
                                                    (True, True, True, 0.1), (False, False, True, 0.05)])
def test_spans_give_the_long_walk(spark, whole, rolls, wild, band):
    rows, costs = market(int(10 * band) + wild, rolls, wild), Costs(rate=0.001, slippage_prob=0.25)
    frame = spark.createDataFrame(
        [(f"b{b}", DAY0 + dt.timedelta(days=d), s, i, c, w, a, 2.0, 0.5, 3.0) for b, d, s, i, c, w, a in rows],
        "book string, ts_init timestamp, symbol string, instrument_id string, close double, w double, active boolean, multiplier double, tick double, increment double",
    )
    got = ledger_exact(frame, costs, 1e4, band, ("book",), whole, rolls, span_closes=8).collect()
    want = walk([(f"b{r[0]}", *r[1:]) for r in rows], costs, 1e4, band, whole, rolls)
    mine = {(x.book, (x.ts_init - DAY0).days): (x.equity, x.equity_post, x.orders, x.rolls) for x in got}
    assert mine.keys() == want.keys()
    for k, v in want.items():
        assert mine[k] == pytest.approx(v, rel=1e-8, abs=1e-6), k
    assert not rolls or any(v[3] for v in want.values())


def test_fees_per_contract_use_lots(spark):
    rows = [("b", DAY0 + dt.timedelta(days=d), "a", c, 0.5, 10.0, 0.25, 1.0) for d, c in enumerate((10.0, 11.0))]
    frame = spark.createDataFrame(rows, "trial string, ts_init timestamp, symbol string, close double, w double, multiplier double, tick double, increment double")
    got = ledger_exact(frame, Costs(per_contract=2.0, slippage_prob=1.0), 1000.0, whole_lots=True).orderBy("ts_init").collect()
    # 500 / (10 * 10) = 5 contracts at 2 + 0.25 * 10 each; then 1027.5 / 2 / 110 = 4.67, which is 5 again.
    assert [(x.equity, x.equity_post, x.orders) for x in got] == [(1000.0, 977.5, 1), (1027.5, 1027.5, 0)]


def test_only_changed_spans_are_walked_again(spark, monkeypatch):
    """A book that trades everything at every close settles in three walks, however many spans it has."""
    calls, real = [], module._walked
    monkeypatch.setattr(module, "_walked", lambda rows, *a: calls.append(1) or real(rows, *a))
    r = random.Random(1)
    rows = [("b", DAY0 + dt.timedelta(days=d), s, 100 + r.random() * 10, r.uniform(-1, 1)) for d in range(200) for s in "ab"]
    frame = spark.createDataFrame(rows, "trial string, ts_init timestamp, symbol string, close double, w double")
    assert ledger_exact(frame, Costs(rate=0.001), span_closes=10).count() == 200 and len(calls) <= 4


def test_no_rows(spark):
    frame = spark.createDataFrame([], "trial string, ts_init timestamp, symbol string, close double, w double")
    assert ledger_exact(frame).count() == 0
