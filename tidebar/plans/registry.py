"""Registered queries, each with its column spec and (where SQL can say it) an oracle.

A spec such as ``"symbol:s ts_init:t target:6 n:i"`` names the output columns and how
both engines present them: ``s`` text, ``t`` timestamp text, ``d`` date text, ``i``
whole number, ``b`` truth value, a digit: double rounded to that many decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def present(df: DataFrame, spec: str) -> DataFrame:
    def show(name: str, kind: str):
        c = F.col(name)
        if kind == "s":
            return c.cast("string").alias(name)
        if kind == "t":
            return F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias(name)
        if kind == "d":
            return F.date_format(c, "yyyy-MM-dd").alias(name)
        if kind == "i":
            return c.cast("bigint").alias(name)
        if kind == "b":
            return c.cast("boolean").alias(name)
        value = F.round(c.cast("double"), int(kind))
        return F.when(value == 0, F.lit(0.0)).otherwise(value).alias(name)

    return df.select(*[show(n, k) for n, k in _columns(spec)])


def wrap_sql(sql: str, spec: str) -> str:
    def show(name: str, kind: str) -> str:
        q = f'"{name}"'
        text = {
            "s": f"CAST({q} AS VARCHAR)",
            "t": f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')",
            "d": f"strftime(CAST({q} AS DATE), '%Y-%m-%d')",
            "i": f"CAST({q} AS BIGINT)",
            "b": f"CAST({q} AS BOOLEAN)",
        }.get(kind)
        if text is None:
            value = f"round(CAST({q} AS DOUBLE), {kind})"
            text = f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END"
        return f"{text} AS {q}"

    return f"SELECT {', '.join(show(n, k) for n, k in _columns(spec))} FROM ({sql}) AS answer"


def query(spec: str, sql: str | None = None, name: str | None = None):
    """Register a query function ``(spark, sf_dir) -> DataFrame``."""

    def register(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(utc(spark), sf_dir), spec)

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = wrap_sql(sql, spec)
        return fn

    return register
