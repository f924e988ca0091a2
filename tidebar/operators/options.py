"""Option chains from raw option bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import MONTH_CODES

PATTERN = rf"^([A-Z0-9]+[{MONTH_CODES}]\d{{1,2}}) ([CP])(\d+)$"


def parse_option_symbol(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Add ``underlying, right, strike``; rows that are not a single option are dropped."""
    part = lambda i: F.regexp_extract(column, PATTERN, i)
    return df.where(F.col(column).rlike(PATTERN)).withColumns(
        {"underlying": part(1), "right": part(2), "strike": part(3).cast("double")}
    )


def third_friday(year: Column, month: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), "FR"), 14)


def option_expiry(underlying: Column, on: Column) -> Column:
    """First third Friday on or after *on* in a year ending in the symbol's digits."""
    letter = F.regexp_extract(underlying, rf"([{MONTH_CODES}])\d{{1,2}}$", 1)
    digits = F.regexp_extract(underlying, r"(\d{1,2})$", 1)
    modulus = F.when(F.length(digits) == 1, F.lit(10)).otherwise(F.lit(100))
    month = F.instr(F.lit(MONTH_CODES), letter).cast("int")
    number = digits.cast("int")
    year = F.year(on) - F.pmod(F.year(on) - number, modulus)
    # The latest such year up to the date's own; move one cycle on if it has passed.
    passed = third_friday(year, month) < on
    return third_friday(F.when(passed, year + modulus).otherwise(year).cast("int"), month)


def tidy_options(raw: DataFrame) -> DataFrame:
    """Option rows with expiry and days to it, in a fixed column order."""
    out = parse_option_symbol(raw).where(F.col("close") > 0).withColumn("date", F.to_date("ts_event"))
    out = out.withColumn("expiry", option_expiry(F.col("underlying"), F.col("date")))
    out = out.withColumn("days_to_expiry", F.datediff("expiry", "date"))
    columns = ["date", "symbol", "underlying", "right", "strike", "expiry", "days_to_expiry", "open", "high", "low", "close", "volume"]
    return out.select(*columns)
