"""Books that hold whole units, with lots, a no-trade band and rolls: a recursion in time, solved for all spans of time at once.

What a book holds at a close depends on what it held before. Time is cut into spans of a bounded number of closes, and every (book, span) is
walked by its own task from an assumed start. A span's end is the next one's start; where that differs from the start it was
walked from, it is walked again. The first span starts in cash, so each round settles at least one more span, and the result is
that of one long walk. It takes few rounds: a span that trades a symbol forgets how much of it the span began with, and equity is
corrected for all spans in one pass, by factors where units are divisible (a book scales with its equity) and by gains where they are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store_once
from .ordered import DAILY, Axis
from .portfolio import Costs

NEVER = -(1 << 63)  # stands before all closes: rows of a span's start
TOLERANCE = 1e-12  # relative; starts that differ by rounding only are the same
INPUT = ("symbol", "instrument", "close", "w", "multiplier", "tick", "increment", "active")
RESULT = "symbol string, instrument string, equity double, equity_post double, orders long, rolls long, pos double, last double, held boolean"


class _Span:
    """Holdings of one book while its closes go by."""

    def __init__(self, costs: Costs, band: float, whole: bool, rolls: bool):
        self.costs, self.band, self.whole, self.rolls = costs, band, whole, rolls
        self.slots: dict[str, int] = {}
        self.symbols: list[str] = []
        self.pos = self.last = self.size = self.tick = np.zeros(0)
        self.held: dict[str, int] = {}
        self.equity = 0.0

    def slots_of(self, instruments: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        for name, symbol in zip(instruments, symbols):
            if name not in self.slots:
                self.slots[name] = len(self.symbols)
                self.symbols.append(symbol)
        more = len(self.symbols) - len(self.pos)
        if more:
            self.pos, self.last, self.size, self.tick = (np.concatenate([x, np.full(more, fill)]) for x, fill in ((self.pos, 0.0), (self.last, np.nan), (self.size, 1.0), (self.tick, 0.0)))
        return np.array([self.slots[x] for x in instruments], np.int64)

    def start(self, rows: dict[str, np.ndarray]) -> None:
        """Rows of the start: the equity, and what is held."""
        head = np.array([x is None for x in rows["instrument"]])
        self.equity = float(rows["close"][head][0])
        rows = {c: v[~head] for c, v in rows.items()}
        at = self.slots_of(rows["instrument"], rows["symbol"])
        self.last[at], self.pos[at], self.size[at], self.tick[at] = rows["close"], rows["w"], rows["multiplier"], rows["tick"]
        self.held = {s: k for s, k, h in zip(rows["symbol"], at, rows["active"]) if h}

    def fees(self, quantity: np.ndarray, price: np.ndarray, size: np.ndarray, tick: np.ndarray) -> np.ndarray:
        c, amount = self.costs, np.abs(quantity)
        return amount * (c.rate * price * size + c.per_contract + c.slippage_prob * tick * size)

    def close(self, rows: dict[str, np.ndarray]) -> tuple[float, float, int, int]:
        """Mark everything that has a price, roll, then trade what is due. Equity before and after, orders and rolls."""
        at, price, size, tick = self.slots_of(rows["instrument"], rows["symbol"]), rows["close"], rows["multiplier"], rows["tick"]
        priced = np.isfinite(price) & (price > 0)
        k = at[priced]
        gain = self.pos[k] * size[priced] * (price[priced] - self.last[k])
        self.equity += float(gain[self.pos[k] != 0].sum())
        self.last[k], self.size[k], self.tick[k] = price[priced], size[priced], tick[priced]
        before, orders, rolls = self.equity, 0, 0

        on = np.flatnonzero(rows["active"])
        rolled = np.zeros(len(on), bool)
        if self.rolls:
            was = np.array([self.held.get(s, -1) for s in rows["symbol"][on]], np.int64)
            rolled = (was >= 0) & (was != at[on])
            rolls = int(rolled.sum())
            for symbol in rows["symbol"][on[rolled]]:
                del self.held[symbol]
            out = was[rolled]
            out = out[self.pos[out] != 0]
            self.equity -= float(self.fees(self.pos[out], self.last[out], self.size[out], self.tick[out]).sum())
            self.pos[out] = 0.0
            orders += len(out)

        if before > 0:
            k, c, m, w = at[on], price[on], size[on], rows["w"][on]
            with np.errstate(divide="ignore", invalid="ignore"):
                goal = w * before / (c * m)
                if self.whole:
                    step = rows["increment"][on]
                    goal = np.round(goal / step) * step
            quantity = goal - self.pos[k]
            due = np.isfinite(w) & priced[on] & (quantity != 0)
            due &= rolled | (np.abs(quantity) * c * m >= self.band * before)
            self.equity -= float(self.fees(quantity[due], c[due], m[due], tick[on][due]).sum())
            self.pos[k[due]] = goal[due]
            if self.rolls:
                self.held.update(zip(rows["symbol"][on[due]], k[due].tolist()))
            orders += int(due.sum())
        return before, self.equity, orders, rolls

    def end(self) -> list[tuple]:
        held = set(self.held.values())
        names = list(self.slots)
        return [
            (self.symbols[k], names[k], self.pos[k], self.last[k], k in held, self.size[k], self.tick[k])
            for k in sorted({*np.flatnonzero(self.pos != 0).tolist(), *held})
        ]


def _closes(frames: Iterator[pd.DataFrame], marks: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """The rows of each close in turn; rows come sorted by ``marks``, and no more than one close waits for its last rows."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        new = np.zeros(len(frame), bool)
        new[0] = True
        for m in marks:
            v = frame[m].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(new)
        whole = {c: frame[c].to_numpy() for c in frame.columns}
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield tuple(whole[m][a] for m in marks), {c: whole[c][a:b] for c in INPUT}
        rest = frame.iloc[cuts[-1]:]
    if rest is not None and len(rest):
        whole = {c: rest[c].to_numpy() for c in rest.columns}
        yield tuple(whole[m][0] for m in marks), {c: whole[c] for c in INPUT}


def _walked(rows: DataFrame, keys: tuple[str, ...], costs: Costs, band: float, whole: bool, rolls: bool) -> DataFrame:
    """Closes and ends of the spans whose starts and rows are given."""
    marks = [*keys, "span", "ts"]
    names = [*marks, "symbol", "instrument", "equity", "equity_post", "orders", "rolls", "pos", "last", "held", "multiplier", "tick"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*marks).schema.fields)

    def run(frames):
        span, of, out = None, None, []
        close = lambda: out.extend((*of, NEVER, s, i, None, None, None, None, p, q, h, m, t) for s, i, p, q, h, m, t in span.end())
        table = lambda: pd.DataFrame(out, columns=names).astype({"orders": "Int64", "rolls": "Int64", "held": "boolean"})
        for (*book, ts), given in _closes(frames, marks):
            if tuple(book) != of:
                if span:
                    close()
                span, of = _Span(costs, band, whole, rolls), tuple(book)
            if ts == NEVER:
                span.start(given)
                continue
            out.append((*of, ts, None, None, *span.close(given), None, None, None, None, None))
            if len(out) > 20_000:
                yield table()
                out = []
        if span:
            close()
        if out:
            yield table()

    return rows.repartition(*keys, "span").sortWithinPartitions(*marks, "symbol", "instrument").mapInPandas(run, f"{types}, {RESULT}, multiplier double, tick double")


def _changed(used: DataFrame, wanted: DataFrame, at: list[str]) -> DataFrame:
    """Spans whose start differs from the one that they were walked from by more than rounding."""
    each = used.withColumn("side", F.lit(-1)).unionByName(wanted.withColumn("side", F.lit(1)))
    same = lambda c: F.abs(F.sum(F.col(c) * F.col("side"))) <= TOLERANCE * F.max(F.abs(c))
    compared = each.groupBy(*at, "symbol", "instrument").agg(
        (F.count("*") == 2).alias("both"), same("close").alias("price"), same("w").alias("units"), (F.min("active") == F.max("active")).alias("held")
    )
    return compared.where("not (both and price and units and held)").select(*at).distinct()


def ledger_exact(weighted: DataFrame, costs: Costs = Costs(), capital: float = 1.0, band: float = 0.0, keys: tuple[str, ...] = ("trial",),
                 whole_lots: bool = False, rolls: bool = False, axis: Axis = DAILY, span_closes: int = 256) -> DataFrame:
    """Equity before and after trading, orders and rolls of every book (``keys``) at each of its closes.

    Rows hold ``symbol, ts_init, close, w`` (target weight; null: no order) and may hold ``multiplier`` (1), ``tick`` (0.01), with
    *whole_lots* ``increment`` (1), and with *rolls* ``instrument_id`` and ``active``: a row that is not active only marks
    its contract. Everything is marked first. A symbol whose active contract is not the one it last ordered closes that one at its last
    price, and the order that follows ignores the band. Orders bring a symbol to its weight of the equity before all orders, to the nearest lot
    (half to even), unless they are smaller than *band* of it; without equity nothing is bought. Books and spans of *span_closes* bars run in parallel.
    """
    given = set(weighted.columns)
    of = lambda c, other: F.col(c).cast("double") if c in given else F.lit(other)
    span = F.floor(F.unix_seconds(axis.order) / F.lit(max(axis.step, 1) * span_closes))
    at = [*keys, "span"]
    rows = store_once(weighted.select(
        *keys, span.alias("span"), F.unix_micros(axis.order).alias("ts"), "symbol",
        (F.col("instrument_id") if rolls else F.col("symbol")).cast("string").alias("instrument"), F.col("close").cast("double").alias("close"),
        F.col("w").cast("double").alias("w"), of("multiplier", 1.0).alias("multiplier"), of("tick", 0.01).alias("tick"),
        of("increment", 1.0).alias("increment"), (F.coalesce("active", F.lit(False)) if rolls and "active" in given else F.lit(True)).alias("active"),
    ))
    order = Window.partitionBy(*keys).orderBy("span")  # spans of a book: its closes over span_closes
    spans = store_once(rows.select(*at).distinct().withColumns({"previous": F.lag("span").over(order)}))

    def head(df: DataFrame, equity) -> DataFrame:
        null = F.lit(None).cast("string")
        return df.select(
            *at, F.lit(NEVER).alias("ts"), null.alias("symbol"), null.alias("instrument"), equity.cast("double").alias("close"), F.lit(0.0).alias("w"),
            F.lit(1.0).alias("multiplier"), F.lit(0.0).alias("tick"), F.lit(1.0).alias("increment"), F.lit(False).alias("active"),
        )

    used = store_once(head(spans, F.lit(capital)))
    walk = lambda some: _walked(some, keys, costs, band, whole_lots, rolls)
    found = store_once(walk(rows.unionByName(used)))
    first = True
    while True:
        began = used.where("instrument is null").select(*at, F.col("close").alias("began"))
        ended = found.where(F.col("ts") != NEVER).groupBy(*at).agg(F.max_by("equity_post", "ts").alias("ended"))
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        if whole_lots and not first:
            corrected = capital + F.coalesce(F.sum(F.col("ended") - F.col("began")).over(earlier), F.lit(0.0))
        else:
            corrected = capital * F.coalesce(F.product(F.coalesce(F.try_divide("ended", "began"), F.lit(0.0))).over(earlier), F.lit(1.0))
        chain = store_once(began.join(ended, at).join(spans, at).withColumn("start", corrected))
        # What a span ends with is where the next one begins.
        scale = F.lit(1.0) if whole_lots else F.coalesce(F.try_divide("start", "began"), F.lit(1.0))
        after = spans.where("previous is not null").select(*keys, F.col("previous").alias("span"), F.col("span").alias("next"))
        held = found.where(F.col("ts") == NEVER).join(chain.select(*at, scale.alias("scale")), at).join(after, at).select(
            *keys, F.col("next").alias("span"), F.lit(NEVER).alias("ts"), "symbol", "instrument", F.col("last").alias("close"),
            (F.col("pos") * F.col("scale")).alias("w"), "multiplier", "tick", F.lit(1.0).alias("increment"), F.col("held").alias("active"),
        )
        wanted = store_once(head(chain, F.col("start")).unionByName(held))
        again = store_once(_changed(used, wanted, at))
        if again.isEmpty():
            break
        pick = lambda df, how: df.join(again, at, how)
        used = store_once(pick(used, "left_anti").unionByName(pick(wanted, "left_semi")))
        fresh = walk(pick(rows.unionByName(wanted), "left_semi"))
        found, first = store_once(pick(found, "left_anti").unionByName(fresh)), False
    return found.where(F.col("ts") != NEVER).select(
        *keys, F.timestamp_micros("ts").alias(axis.order), "equity", "equity_post", "orders", "rolls"
    )
