"""Normal density, distribution and quantile as SQL expressions.

Spark has no error function, so the distribution uses Hart's rational
approximation and the quantile Acklam's with one Newton step. Written as SQL text
so that they stay inside generated code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's coefficients, highest power first.
_HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
             112.079291497871, 221.213596169931, 220.206867912376)
_HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
                296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

# Acklam's coefficients, highest power first.
_MID_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_MID_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
               6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
                3.754408661907416e00, 1.0)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = f"{coefficients[0]:.17e}"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c:.17e})"
    return text


def pdf_sql(x: str) -> str:
    return f"(exp(-0.5e0 * ({x}) * ({x})) / 2.5066282746310002e0)"


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-0.5e0 * ({x}) * ({x}))"
    near = f"({e} * {_horner(_HART_TOP, a)} / {_horner(_HART_BOTTOM, a)})"
    tail = f"({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0)))))"
    low = (
        f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {near} "
        f"ELSE {e} / ({tail} * 2.506628274631e0) END)"
    )
    # One copy of the tail, flipped by sign, keeps the generated code small.
    return f"(CASE WHEN ({x}) > 0e0 THEN 1e0 ELSE 0e0 END + CASE WHEN ({x}) > 0e0 THEN -1e0 ELSE 1e0 END * {low})"


def ppf_sql(p: str) -> str:
    q = f"(({p}) - 0.5e0)"
    r = f"({q} * {q})"
    low = f"sqrt(-2e0 * ln({p}))"
    high = f"sqrt(-2e0 * ln(1e0 - ({p})))"
    mid = f"({_horner(_MID_TOP, r)} * {q} / {_horner(_MID_BOTTOM, r)})"
    tail_low = f"({_horner(_TAIL_TOP, low)} / {_horner(_TAIL_BOTTOM, low)})"
    tail_high = f"(-({_horner(_TAIL_TOP, high)} / {_horner(_TAIL_BOTTOM, high)}))"
    return (
        f"(CASE WHEN ({p}) <= 0e0 OR ({p}) >= 1e0 THEN NULL WHEN ({p}) < 0.02425e0 THEN {tail_low} "
        f"WHEN ({p}) > 0.97575e0 THEN {tail_high} ELSE {mid} END)"
    )


def cdf_array(x: np.ndarray) -> np.ndarray:
    """The same distribution function over an array, for batch functions."""
    a = np.abs(x)
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        e = np.exp(-0.5 * a * a)
        near = e * np.polyval(_HART_TOP, a) / np.polyval(_HART_BOTTOM, a)
        far = e / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * 2.506628274631)
    low = np.where(a > 37, 0.0, np.where(a < 7.07106781186547, near, far))
    return np.where(x > 0, 1.0 - low, low)


def pdf(x: str) -> Column:
    """Standard normal density of the column named *x*."""
    return F.expr(pdf_sql(x))


def cdf(x: str) -> Column:
    """Standard normal distribution function of the column named *x*."""
    return F.expr(cdf_sql(x))


def ppf(p: str, x0: str = "__ppf") -> tuple[Column, Column]:
    """Start value and refined quantile; add the first as column *x0* before the second."""
    return F.expr(ppf_sql(p)), F.expr(f"{x0} - ({cdf_sql(x0)} - ({p})) / {pdf_sql(x0)}")


def with_ppf(df, out: str, p: str):
    """Add the standard normal quantile of column *p*."""
    start, refined = ppf(p)
    return df.withColumn("__ppf", start).withColumn(out, refined).drop("__ppf")
