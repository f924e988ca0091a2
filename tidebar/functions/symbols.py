"""Symbol and contract-name columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month letters January to December.
MONTH_CODES = "FGHJKMNQUVXZ"

# Futures roots by asset class.
CLASS_ROOTS = {
    "equity": ("ES", "NQ", "YM", "RTY", "NKD", "EMD", "Z", "MME", "MFS", "FESX", "FDAX"),
    "bond": ("ZT", "ZF", "ZN", "ZB", "UB", "TN", "R", "FGBS", "FGBM", "FGBL", "FGBX"),
    "fx": ("6A", "6B", "6C", "6E", "6J", "6S", "6N", "6M"),
    "energy": ("CL", "HO", "RB", "NG", "BRN", "G"),
    "metal": ("GC", "SI", "HG", "PL", "PA"),
    "agriculture": ("ZC", "ZS", "ZW", "KE", "ZL", "ZM", "LE", "HE", "GF", "C", "RC", "W", "SB", "KC", "CC", "CT"),
    "volatility": ("VX",),
}

# Frequency aliases of the bar schemas, and the tick schemas.
FREQUENCIES = {
    "ohlcv-1s": ("1s", "s"),
    "ohlcv-1m": ("1m", "1min", "min"),
    "ohlcv-1h": ("1h", "h", "hourly"),
    "ohlcv-1d": ("1d", "d", "daily"),
}
TICK_SCHEMAS = ("trades", "tbbo", "mbp-1", "bbo-1s", "bbo-1m", "mbo", "mbp-10")


def root_of(symbol: Column) -> Column:
    return F.split(symbol, r"\.")[0]


def asset_class(symbol: Column, groups: dict[str, str] | None = None) -> Column:
    """Peer group of a symbol: *groups*, else the class of its root, else the root."""
    root = root_of(symbol)
    known = {r: c for c, roots in CLASS_ROOTS.items() for r in roots}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    fallback = F.coalesce(F.try_element_at(table, root), root)
    if not groups:
        return fallback
    own = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return F.coalesce(F.try_element_at(own, symbol), fallback)


def is_futures(symbol: Column) -> Column:
    return symbol.rlike(r"\.(ROLL|FUT|c\.\d+|v\.\d+)$")


def asset_group(df, keys: list[str]):
    """``futures`` where more than half of a report's symbols are, else ``equities``."""
    share = F.avg(is_futures(F.col("symbol")).cast("int"))
    return df.groupBy(*keys).agg(F.when(share > 0.5, F.lit("futures")).otherwise(F.lit("equities")).alias("asset_group"))


def symbol_kind(symbol: Column) -> Column:
    return (
        F.when(symbol.rlike(r"\.(ROLL|VROLL)$"), F.lit("rolled"))
        .when(symbol.rlike(r"\.(FUT|OPT)$"), F.lit("parent"))
        .when(symbol.rlike(r"\.[cnv]\.\d+$"), F.lit("continuous"))
        .otherwise(F.lit("raw_symbol"))
    )


def rolled_rule(symbol: Column) -> Column:
    """Continuous rule behind a rolled name: ``v`` for ``.VROLL``, ``c`` for ``.ROLL``."""
    return F.when(symbol.endswith(".VROLL"), F.lit("v")).when(symbol.endswith(".ROLL"), F.lit("c"))


def rolled_venue(symbol: Column) -> Column:
    """Venue part of ``ROOT.VENUE.ROLL``; null for ``ROOT.ROLL``."""
    parts = F.split(symbol, r"\.")
    return F.when(F.size(parts) == 3, parts[1])


def resolve_schema(value: Column) -> Column:
    """Bar or tick schema for a user-facing frequency; null if unknown."""
    text = F.lower(F.trim(value))
    out = F.when(text.isin(*TICK_SCHEMAS, *FREQUENCIES), text)
    for schema, aliases in FREQUENCIES.items():
        out = out.when(text.isin(*aliases), F.lit(schema))
    return out


def default_venue(dataset: Column) -> Column:
    return F.split(dataset, r"\.")[0]


def month_code(raw: Column, root: Column) -> Column:
    letter = F.substr(raw, F.length(root) + 1, F.lit(1))
    return F.when(raw.startswith(root) & (F.length(letter) == 1) & (F.instr(F.lit(MONTH_CODES), letter) > 0), letter)


def _grab(raw: Column, pattern: str, group: int) -> Column:
    hit = F.regexp_extract(raw, pattern, group)
    return F.when(hit != "", hit)


def contract_month(raw: Column) -> Column:
    """Delivery ``struct(month, year, modulus)`` of a raw contract name, or null.

    Three spellings, tried in turn: ``... FMG0019!``, ``... 20260908 ...``, ``ESZ6``.
    """
    ice, eurex, cme = rf"FM([{MONTH_CODES}])00(\d\d)!$", r"\s(20\d{2})(0[1-9]|1[0-2])\d{2}\s", rf"([{MONTH_CODES}])(\d{{1,2}})$"

    def letter(code: Column) -> Column:
        return F.instr(F.lit(MONTH_CODES), code).cast("int")

    def made(month: Column, year: Column, modulus: Column) -> Column:
        return F.struct(month.cast("int").alias("month"), year.cast("int").alias("year"), modulus.cast("int").alias("modulus"))

    digits = _grab(raw, cme, 2)
    return (
        F.when(_grab(raw, ice, 1).isNotNull(), made(letter(_grab(raw, ice, 1)), _grab(raw, ice, 2), F.lit(100)))
        .when(_grab(raw, eurex, 1).isNotNull(), made(_grab(raw, eurex, 2), _grab(raw, eurex, 1), F.lit(10000)))
        .when(digits.isNotNull(), made(letter(_grab(raw, cme, 1)), digits, F.pow(F.lit(10), F.length(digits))))
    )


def months_between(near: Column, far: Column) -> Column:
    """Whole months from delivery *near* to *far* (structs of ``contract_month``)."""
    gap = F.pmod(far["year"] - near["year"], near["modulus"]) * 12 + far["month"] - near["month"]
    return F.when((near["modulus"] == far["modulus"]) & (gap > 0) & (gap <= 60), gap)


def delivery_ordinal(name: Column) -> Column:
    """Sortable delivery month of ``<raw>_<listing year>``."""
    listed = F.regexp_extract(name, r"_(\d{4})$", 1).try_cast("int")
    month = contract_month(F.regexp_replace(name, r"_\d{4}$", ""))
    decade = F.floor(listed / 10) * 10 + month["year"]
    year = F.when(month["modulus"] == 10, decade + F.when(decade < listed, F.lit(10)).otherwise(F.lit(0))).otherwise(month["year"])
    return (year * 12 + month["month"]).cast("int")


def rehomed(raw: Column, source: str, target: str) -> Column:
    """Instrument id of a contract moved from one venue to another."""
    safe = F.regexp_replace(F.regexp_replace(raw, r"[\W_]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit(f"{source}_"), safe, F.lit(f".{target}"))
