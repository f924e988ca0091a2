"""Closes as batches of bars, and cross-sectional targets that follow them, by keyed state and event-time timers.

A close is settled as soon as the expected number of its bars is in, or else when a bar of a later close has moved the watermark past it.
Cross-sectional strategies chain two stateful operators: one keeps a bounded tail for every symbol and scores each new bar,
the next keeps the scores of each open close and ranks them once it is settled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ANNUAL = 252**0.5


class _Closes(StatefulProcessor):
    """Rows of one close wait until it is settled; ``settled`` says what comes of them.

    State: the waiting rows, and whether the close was settled. Both go when the watermark has passed the close, so
    only open closes have any. A symbol counts once; of its rows the first one stays.
    """

    waiting = "symbol string"

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.waiting)
        self.done = handle.getValueState("done", "expected long, done boolean")

    def settled(self, close: pd.Timestamp, rows: pd.DataFrame, complete: bool) -> pd.DataFrame:
        raise NotImplementedError

    def _names(self) -> list[str]:
        return [x.split()[0] for x in self.waiting.split(", ")]

    def _held(self) -> pd.DataFrame:
        rows = pd.DataFrame([tuple(x) for x in self.rows.get()] if self.rows.exists() else [], columns=self._names())
        return rows.drop_duplicates("symbol").sort_values("symbol", ignore_index=True)

    def handleInputRows(self, key, rows, timerValues):
        expected, done = self.done.get() if self.done.exists() else (None, False)
        if expected is None:
            self.handle.registerTimer(int(key[0].timestamp() * 1000))
        for frame in rows:  # a batch of a close: at most its symbols
            if done or not len(frame):
                continue
            expected = max(expected or 0, int(frame["expected"].max()))
            frame = frame[self._names()].astype(object).where(frame[self._names()].notna(), None)
            self.rows.appendList([tuple(x) for x in frame.itertuples(index=False)])
        if not done and expected is not None:
            held = self._held()
            done = len(held) >= expected
            if done:
                self.rows.clear()
                yield self.settled(key[0], held, True)
        self.done.update((expected or 0, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.done.get()[1]:
            yield self.settled(key[0], self._held(), False)
        self.rows.clear()
        self.done.clear()

    def close(self) -> None:
        pass


class CountedCloses(_Closes):
    """One row a close: bars that were in, and whether that was all."""

    def settled(self, close, rows, complete):
        return pd.DataFrame({"ts_init": [close], "n_bars": [len(rows)], "complete": [complete]})


def settled_closes(bars: DataFrame, late: str = "1 second") -> DataFrame:
    """``ts_init, n_bars, complete``, one row for every close that is settled.

    *bars* (``symbol, ts_init, expected``) say how many bars their close is to have. Bars that come after their close was
    settled are left out; *late* has to be positive, as the watermark closes its own instant.
    """
    keyed = bars.select("symbol", "ts_init", F.col("expected").cast("long").alias("expected")).withWatermark("ts_init", late).groupBy("ts_init")
    return keyed.transformWithStateInPandas(
        statefulProcessor=CountedCloses(), outputStructType="ts_init timestamp, n_bars long, complete boolean", outputMode="Append", timeMode="EventTime"
    )


class MomentumScores(StatefulProcessor):
    """Past return and volatility of each new bar of a symbol, from its latest closes."""

    def __init__(self, lookback: int, skip_recent: int, vol_lookback: int):
        self.lookback, self.skip, self.vol = lookback, skip_recent, vol_lookback
        self.keep = max(lookback + skip_recent, vol_lookback) + 1

    def init(self, handle) -> None:
        self.state = handle.getValueState("tail", "closes array<double>, last long")

    def handleInputRows(self, key, rows, timerValues):
        tail, last = self.state.get() if self.state.exists() else ([], None)
        tail = [float(x) for x in tail or []]
        for frame in rows:  # sorted by the query within a batch
            out = []
            for ts, t, expected, close in frame.sort_values("ts_init")[["ts_init", "t", "expected", "close"]].itertuples(index=False):
                if last is not None and ts.value <= last:
                    continue  # known already
                tail, last = [*tail, float(close)][-self.keep:], ts.value
                past = tail[-1 - self.skip - self.lookback] if len(tail) > self.skip + self.lookback else None
                score = tail[-1 - self.skip] / past - 1 if past else None
                out.append((key[0], ts, t, expected, score, self._volatility(tail, t)))
            if out:
                yield pd.DataFrame(out, columns=["symbol", "ts_init", "t", "expected", "score", "vol"]).astype({"score": "Float64", "vol": "Float64"})
        self.state.update((tail, last))

    def _volatility(self, tail: list[float], t: int) -> float | None:
        if t < self.vol:
            return 0.20
        closes = np.array(tail[-self.vol - 1:])
        return float((closes[1:] / closes[:-1] - 1).std() * ANNUAL) if len(closes) > 1 else None

    def close(self) -> None:
        pass


class RankedCloses(_Closes):
    """Targets of a settled close: long the symbols at or over the upper quantile of scores, short those at or under the lower one."""

    waiting = "symbol string, t long, score double, vol double"

    def __init__(self, warmup: int, every: int, top: float, bottom: float, vol_target: float, most: float):
        self.warmup, self.every, self.top, self.bottom, self.vol_target, self.most = warmup, every, top, bottom, vol_target, most

    def settled(self, close, rows, complete):
        none = pd.DataFrame({"symbol": pd.Series(dtype=str), "ts_init": pd.Series(dtype="datetime64[ns]"), "target": pd.Series(dtype=float)})
        since = int(rows["t"].iloc[0]) - self.warmup if len(rows) else -1
        score = rows["score"].astype(float)
        if since < 0 or since % self.every or score.count() < 2:
            return none
        high, low = np.nanquantile(score, [1 - self.top, self.bottom])
        size = np.minimum(self.vol_target / np.maximum(rows["vol"].astype(float), 1e-6), self.most)
        target = np.where(score >= high, size, np.where(score <= low, -size, 0.0))
        return pd.DataFrame({"symbol": rows["symbol"], "ts_init": close, "target": np.nan_to_num(target)})


def live_xs_momentum(bars: DataFrame, lookback: int = 252, skip_recent: int = 21, top_quantile: float = 0.25, bottom_quantile: float = 0.25,
                     vol_target: float = 0.10, vol_lookback: int = 63, max_leverage: float = 2.0, rebal_freq: int = 21, late: str = "1 second") -> DataFrame:
    """``symbol, ts_init, target`` at every rebalance of a bar stream, as soon as its close is settled; in between targets stand.

    *bars* are ``symbol, ts_init, close, t, expected``: the position of the close in the exchange calendar and its number of bars, which
    a join with a calendar table gives. Ranked are the symbols with a bar at the close; their returns reach over their own bars.
    """
    scores = bars.select("symbol", "ts_init", F.col("t").cast("long").alias("t"), F.col("expected").cast("long").alias("expected"), "close").withWatermark(
        "ts_init", late
    ).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=MomentumScores(lookback, skip_recent, vol_lookback),
        outputStructType="symbol string, ts_init timestamp, t long, expected long, score double, vol double",
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts_init",
    )
    ranker = RankedCloses(lookback + skip_recent, rebal_freq, top_quantile, bottom_quantile, vol_target, max_leverage)
    return scores.groupBy("ts_init").transformWithStateInPandas(
        statefulProcessor=ranker, outputStructType="symbol string, ts_init timestamp, target double", outputMode="Append", timeMode="EventTime"
    )
