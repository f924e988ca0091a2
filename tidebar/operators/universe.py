"""Index membership from change events and from HTML tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ever_members(current: DataFrame, changes: DataFrame, start=None, end=None) -> DataFrame:
    """Symbols in the index now or touched by a change between *start* and *end*."""
    dated = changes
    if start is not None:
        dated = dated.where(F.col("effective_date") >= F.lit(start))
    if end is not None:
        dated = dated.where(F.col("effective_date") <= F.lit(end))
    touched = dated.select(F.explode(F.array_compact(F.array("added", "removed"))).alias("symbol"))
    return current.select("symbol").unionByName(touched).where("symbol <> ''").distinct()


def html_table_rows(pages: DataFrame, keys: list[str], column: str = "html") -> DataFrame:
    """Cells of every table row with data cells: ``keys, row_no, cells`` (text only)."""
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(column, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row_no", "__row"))
    cells = F.regexp_extract_all("__row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)
    return rows.withColumn("cells", F.transform(cells, _text)).where(F.size("cells") > 0).drop("__row")


def _text(cell):
    plain = F.regexp_replace(cell, r"(?s)<[^>]+>", "")
    for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def parse_constituents(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First cell is the symbol, second the name."""
    return rows.where(F.size("cells") >= 2).select(*(keys or []), F.get("cells", F.lit(0)).alias("symbol"), F.get("cells", F.lit(1)).alias("name"))


def parse_changes(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Membership changes; short rows and rows without a readable date are skipped."""
    out = rows.where(F.size("cells") >= 6).select(
        *(keys or []),
        F.try_to_timestamp(F.get("cells", F.lit(0)), F.lit("MMMM d, yyyy")).cast("date").alias("effective_date"),
        F.nullif(F.get("cells", F.lit(1)), F.lit("")).alias("added"),
        F.nullif(F.get("cells", F.lit(3)), F.lit("")).alias("removed"),
        F.get("cells", F.lit(5)).alias("reason"),
    )
    return out.where("effective_date IS NOT NULL")
