"""Futures option prices, sensitivities and implied volatility as columns."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normal import cdf, cdf_array, pdf


def _staged(df: DataFrame) -> DataFrame:
    """Add the sign of the payoff, d1, the two probabilities and the discount factor.

    From ``forward, strike, t, rate, sigma, right``. Each is its own projection, so
    that what is used several times is computed once.
    """
    root = F.col("sigma") * F.sqrt("t")
    moneyness = F.log(F.try_divide(F.col("forward"), F.col("strike")))
    d1 = F.try_divide(moneyness + 0.5 * F.col("sigma") * F.col("sigma") * F.col("t"), root)
    sign = F.when(F.col("right") == "C", F.lit(1.0)).otherwise(F.lit(-1.0))
    df = df.withColumns({"__d1": d1, "__s": sign, "__df": F.exp(-F.col("rate") * F.col("t"))})
    df = df.withColumns({"__x1": F.col("__s") * F.col("__d1"), "__x2": F.col("__s") * (F.col("__d1") - root)})
    return df.withColumns({"__n1": cdf("__x1"), "__n2": cdf("__x2")})


_TEMPS = ("__d1", "__s", "__df", "__x1", "__x2", "__n1", "__n2")
_VALUE = "__s * __df * (forward * __n1 - strike * __n2)"


def price(df: DataFrame, out: str = "price") -> DataFrame:
    """Call (``right = 'C'``) or put price."""
    return _staged(df).withColumn(out, F.expr(_VALUE)).drop(*_TEMPS)


def greeks(df: DataFrame) -> DataFrame:
    """Delta, gamma, vega per 1.00 of volatility and theta per year, in closed form."""
    df = _staged(df).withColumn("__pdf", pdf("__d1"))
    out = {
        "delta": "__s * __df * __n1",
        "gamma": "try_divide(__df * __pdf, forward * sigma * sqrt(t))",
        "vega": "__df * forward * __pdf * sqrt(t)",
        "theta": f"rate * {_VALUE} - try_divide(__df * forward * __pdf * sigma, 2e0 * sqrt(t))",
    }
    return df.withColumns({k: F.expr(v) for k, v in out.items()}).drop(*_TEMPS, "__pdf")


def implied_vol(df: DataFrame, premium: str = "premium", low: float = 1e-4, high: float = 5.0, steps: int = 60) -> DataFrame:
    """Volatility that reproduces *premium*, by bisection; null if no volatility does.

    Sixty dependent steps are too much code for one generated method and slow as an
    interpreted fold, so whole Arrow batches are bisected at once.
    """
    @F.pandas_udf("double")
    def solve(given: pd.Series, forward: pd.Series, strike: pd.Series, t: pd.Series, rate: pd.Series, right: pd.Series) -> pd.Series:
        p, f, k, tt = (s.to_numpy(float) for s in (given, forward, strike, t))
        sign = np.where(right.to_numpy() == "C", 1.0, -1.0)
        discount, root, ratio = np.exp(-rate.to_numpy(float) * tt), np.sqrt(tt), np.log(f / k)

        def value(sigma):
            d1 = ratio / (sigma * root) + 0.5 * sigma * root
            return sign * discount * (f * cdf_array(sign * d1) - k * cdf_array(sign * (d1 - sigma * root)))

        lo, hi = np.full(len(p), low), np.full(len(p), high)
        reachable = (p >= value(lo)) & (p <= value(hi))
        for _ in range(steps):
            mid = 0.5 * (lo + hi)
            below = value(mid) < p
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        out = pd.Series(0.5 * (lo + hi))
        return out.where(reachable)

    return df.withColumn("implied_vol", solve(premium, "forward", "strike", "t", "rate", "right"))
