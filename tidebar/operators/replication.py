"""Monthly time-series-momentum study over many instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Axis, over_rows
from .volatility import past_return

TARGET_VOL = 0.40
MONTHS = Axis(keys=("symbol",), order="month", step=28 * 86_400)


def monthly_resample(daily: DataFrame) -> DataFrame:
    """Month return and month-end volatility of symbols traded on more than five days.

    Needs ``symbol, ts, ret, vol``. Months are consecutive calendar numbers (``m``).
    """
    month = F.date_trunc("month", "ts")
    out = daily.groupBy("symbol", month.alias("month")).agg(
        (F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"),
        F.max_by("vol", F.when(F.col("vol").isNotNull(), F.col("ts"))).alias("vol"),
        F.count("ret").alias("days"),
    )
    return out.where("days > 5").withColumn("m", F.year("month") * 12 + F.month("month"))


def fill_months(monthly: DataFrame) -> DataFrame:
    """Insert empty months inside each symbol's life, so that lags count calendar months."""
    placed = over_rows(monthly, MONTHS, lambda df, w: df.withColumn("__next", F.lead("m").over(w)), after=1)
    gaps = placed.withColumn("__m", F.explode(F.sequence("m", F.coalesce(F.col("__next") - 1, "m"))))
    real = F.col("__m") == F.col("m")
    shift = F.add_months(F.to_date("month"), F.col("__m") - F.col("m")).cast("timestamp")
    return gaps.select(
        "symbol", shift.alias("month"), F.when(real, F.col("ret")).alias("ret"),
        F.when(real, F.col("vol")).alias("vol"), F.col("__m").alias("m"),
    )


def tsmom_legs(monthly: DataFrame, k: int, h: int = 1, scale: bool = True) -> DataFrame:
    """Per-instrument returns of the k-month rule held for *h* overlapping months."""
    months = past_return(fill_months(monthly), k, MONTHS)
    lever = F.try_divide(F.lit(TARGET_VOL), F.col("vol")) if scale else F.lit(1.0)
    pos = F.when(F.col("past").isNotNull() & F.col("vol").isNotNull(), F.signum("past") * lever)

    def build(df, w):
        df = df.withColumn("__pos", pos)
        legs: list[Column] = [F.lag("__pos", j).over(w) * F.col("ret") for j in range(1, h + 1)]
        total = legs[0]
        for leg in legs[1:]:
            total = total + leg
        return df.withColumn("leg", total / h)

    return over_rows(months, MONTHS, build, before=h).where("leg IS NOT NULL").select("symbol", "month", "m", "leg")


def passive_legs(monthly: DataFrame) -> DataFrame:
    """Always-long legs at the same ex-ante risk."""
    months = fill_months(monthly)
    w = MONTHS.window()
    leg = F.try_divide(F.lit(TARGET_VOL), F.lag("vol").over(w)) * F.col("ret")
    return months.withColumn("leg", leg).where("leg IS NOT NULL").select("symbol", "month", "m", "leg")


def diversified(legs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Equal weight over the instruments available in a month."""
    return legs.groupBy(*(keys or []), "month").agg(F.avg("leg").alias("ret"), F.count("leg").alias("names"))


def tsmom_grid(monthly: DataFrame, ks: list[int], hs: list[int]) -> DataFrame:
    """Diversified returns of every (k, h) pair, keyed by ``k, h``, in one plan.

    Each look-back's position is computed once and carried as an array of its last
    max(h) values; holding periods are then slices of that array.
    """
    months = fill_months(monthly).withColumn("__lr", F.log1p("ret"))
    top = max(hs)

    def signs(df, w):
        cols = {}
        for k in ks:
            frame = w.rowsBetween(-(k - 1), 0)
            known = (F.count("__lr").over(frame) == k) & F.col("vol").isNotNull()
            cols[f"__p{k}"] = F.when(known, F.signum(F.exp(F.sum("__lr").over(frame)) - 1) * F.try_divide(F.lit(TARGET_VOL), F.col("vol")))
        return df.withColumns(cols)

    def history(df, w):
        return df.withColumns(
            {f"__h{k}": F.array(*[F.lag(f"__p{k}", j).over(w) for j in range(1, top + 1)]) for k in ks}
        )

    rows = over_rows(over_rows(months, MONTHS, signs, before=max(ks)), MONTHS, history, before=top)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(h).alias("h"), F.col(f"__h{k}").alias("p")) for k in ks for h in hs])
    each = rows.select("symbol", "month", "ret", F.explode(cells).alias("c"))
    held = F.slice("c.p", F.lit(1), F.col("c.h"))
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)  # null if any cohort is missing
    each = each.select("month", F.col("c.k").alias("k"), F.col("c.h").alias("h"), (total * F.col("ret") / F.col("c.h")).alias("leg"))
    return diversified(each.where("leg IS NOT NULL"), ["k", "h"])


def pooled_sign_regression(monthly: DataFrame, lags: int = 24) -> DataFrame:
    """Pooled regression of risk-scaled returns on the sign h months ago, month-clustered.

    The sandwich needs only sums per (h, month), so rows are reduced before any
    further exchange.
    """
    months = fill_months(monthly)

    def build(df, w):
        ys = F.try_divide(F.col("ret"), F.lag("vol").over(w))
        past = F.array(*[F.signum(F.lag("ret", h).over(w)) for h in range(1, lags + 1)])
        return df.withColumns({"y": ys, "__past": past})

    rows = over_rows(months, MONTHS, build, before=lags)
    pairs = rows.select("m", "y", F.posexplode("__past").alias("i", "x")).withColumn("h", F.col("i") + 1)
    pairs = pairs.where("x IS NOT NULL AND y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    per = pairs.groupBy("h", "m").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"),
    )
    tot = per.groupBy("h").agg(
        *[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")], F.count(F.lit(1)).alias("g")
    )
    det = F.col("t_n") * F.col("t_sxx") - F.col("t_sx") * F.col("t_sx")
    b = F.try_divide(F.col("t_n") * F.col("t_sxy") - F.col("t_sx") * F.col("t_sy"), det)
    tot = tot.withColumns({"det": det, "b": b}).withColumn("a", (F.col("t_sy") - F.col("b") * F.col("t_sx")) / F.col("t_n"))
    scored = per.join(tot, "h")
    u = F.col("sy") - F.col("a") * F.col("n") - F.col("b") * F.col("sx")
    v = F.col("sxy") - F.col("a") * F.col("sx") - F.col("b") * F.col("sxx")
    # Second row of the inverse moment matrix times the cluster score.
    z = F.try_divide(F.col("t_n") * v - F.col("t_sx") * u, F.col("det"))
    return scored.withColumn("z", z).groupBy("h").agg(
        F.max("b").alias("b"),
        F.try_divide(F.max("b"), F.sqrt(F.try_divide(F.sum(F.col("z") * F.col("z")) * F.max("g"), F.max("g") - 1))).alias("t_stat"),
    )


def _pair_sums(frame, block: tuple[int, int], min_obs: int) -> tuple[float, int]:
    """Sum and number of the correlations of the pairs between two blocks of instruments (or within one)."""
    import numpy as np

    months, at = np.unique(frame["month"].to_numpy(), return_inverse=True)

    def table(b: int):
        mine = frame["block"].to_numpy() == b
        names, row = np.unique(frame["symbol"].to_numpy()[mine].astype(str), return_inverse=True)
        x = np.full((len(names), len(months)), np.nan)
        there = np.zeros(x.shape)
        x[row, at[mine]] = frame["x"].to_numpy(float)[mine]
        there[row, at[mine]] = 1.0
        known = np.isfinite(x)
        n = np.maximum(known.sum(axis=1, keepdims=True), 1)
        x = np.where(known, x, 0.0)
        x = np.where(known, x - x.sum(axis=1, keepdims=True) / n, 0.0)  # keeps the sums of squares small
        return names, x, known.astype(float), there

    first, x, kx, tx = table(block[0])
    second, y, ky, ty = table(block[1])
    n, met = kx @ ky.T, tx @ ty.T
    with np.errstate(divide="ignore", invalid="ignore"):
        sx, sy = x @ ky.T, kx @ y.T
        xx, yy = (x * x) @ ky.T, kx @ (y * y).T
        vx, vy = xx - sx * sx / n, yy - sy * sy / n
        c = (x @ y.T - sx * sy / n) / np.sqrt(vx * vy)
    good = (met >= min_obs) & (vx > 1e-14 * xx) & (vy > 1e-14 * yy) & np.isfinite(c)
    good &= first[:, None] < second[None, :] if block[0] == block[1] else True
    return float(c[good].sum()), int(good.sum())


def avg_pairwise_corr(legs: DataFrame, min_obs: int = 36, value: str = "leg", block_symbols: int = 256) -> DataFrame:
    """Mean correlation of instrument pairs with enough shared months.

    Instruments are dealt to blocks by hash; each pair of blocks is a task with two tables of instruments by months, whose matrix
    products give all sums that the correlations of their pairs need. Only the sum and the number of correlations leave it.
    """
    names = legs.select("symbol").distinct().count()
    blocks = max(1, -(-names // block_symbols))
    rows = legs.select("month", "symbol", F.col(value).cast("double").alias("x"), F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = rows.withColumn("other", other).select("month", "symbol", "x", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(key, frame):
        import pandas as pd

        total, count = _pair_sums(frame, key, min_obs)
        return pd.DataFrame({"total": [total], "pairs": [count]})

    sums = met.groupBy("i", "j").applyInPandas(run, "total double, pairs long")
    pairs = F.coalesce(F.sum("pairs"), F.lit(0))
    return sums.agg(F.try_divide(F.sum("total"), pairs).alias("avg_corr"), pairs.alias("pairs"))


def series_stats(series: DataFrame, keys: list[str]) -> DataFrame:
    """Annualised return, volatility, Sharpe, t-statistic and drawdown of monthly series."""
    from .volatility import drawdown

    axis = Axis(keys=tuple(keys), order="month", step=28 * 86_400)
    dd = drawdown(series, axis)
    dev = F.stddev_samp("ret")
    ratio = F.avg("ret") / dev
    n = F.count("ret")
    return dd.groupBy(*keys).agg(
        F.min("month").alias("start"), F.max("month").alias("end"), n.alias("months"),
        (F.avg("ret") * 12).alias("ann_return"), (dev * F.sqrt(F.lit(12.0))).alias("ann_vol"),
        F.when((n > 2) & (dev > 0), ratio * F.sqrt(F.lit(12.0))).alias("sharpe"),
        F.when(dev > 0, ratio * F.sqrt(n)).alias("t_stat"), F.min("drawdown").alias("max_dd"),
    )


def class_rollup(legs: DataFrame) -> DataFrame:
    """Mean monthly leg by instrument, class and overall (``symbol, peer, leg``)."""
    return legs.rollup("peer", "symbol").agg(F.avg("leg").alias("mean_leg"), F.count("leg").alias("n"))
