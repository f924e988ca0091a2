"""URL rules by a sort-merge range join.

A canonical key is a host with its labels reversed, a slash and a path, so all paths that start with a rule's path lie in one
interval of keys: from the rule's key to the same key followed by a byte that no text has. A url is looked up under its host
and under each parent of it that is not longer than the longest rule host. Keys and interval ends are sorted together and swept:
an interval that begins goes on a stack, one that ends comes off it. The number of intervals that are open is the height of the
stack, and the rule at a height is the last one that was put there, so both are running values of window functions.
The order is cut into blocks; a block begins with the rules that are open at its border. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import in_blocks
from .common import ascii_lower, bitmap, in_bitmap, stored

OPEN, POINT, CLOSE = 0, 1, 2
BITMAP_WORDS = 1 << 13  # 64 KB: hosts of rules, only to leave out lookups that cannot meet one
ADDED = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as they stand in a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("/"), path).cast("binary")


def _reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (host, path, action) once each with ``key``, number of ``labels`` and ``name``.

    Hosts are lower-cased, a null path is empty, of contrary rules block holds. Rules with a null or empty host, a host with
    ``/``, ``?`` or ``#``, or an action other than allow and block fit nothing and are left out.
    """
    usable = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    usable = usable.where((F.col("host") != "") & ~F.col("host").rlike("[/?#]") & F.col("action").isin("allow", "block"))
    once = usable.groupBy("host", "path").agg(F.max("action").alias("action"))
    labels = _reversed_labels(F.col("host"))
    return once.select(
        "host", "path", "action", F.concat("host", "path").alias("name"), F.size(labels).alias("labels"), _key(labels, F.col("path")).alias("key")
    )


def _events(points: DataFrame, rules: DataFrame) -> DataFrame:
    rule = F.struct("key", "host", "name", "action").alias("rule")
    none = rules.schema["host"].dataType
    ends = rules.select(
        F.explode(F.array(
            F.struct(F.col("key").alias("key"), F.lit(OPEN).alias("kind"), F.lit(1).alias("step")),
            F.struct(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(CLOSE).alias("kind"), F.lit(-1).alias("step")),
        )).alias("e"), rule,
    ).select("e.*", "rule", F.lit(None).cast(none).alias("host"), F.lit(None).cast(none).alias("path"))
    return points.select("key", F.lit(POINT).alias("kind"), F.lit(0).alias("step"), "host", "path").unionByName(ends, allowMissingColumns=True)


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path`` and innermost ``rule`` of every point (``key``, ``host``, ``path``) that lies in the interval of one."""
    placed = in_blocks(stored(_events(points, rules), "events"), "key", "kind")
    ends = placed.where(F.col("step") != 0).groupBy(F.col("rule.key").alias("key")).agg(
        F.min("block").alias("first"), F.max("block").alias("last"), F.any_value("rule").alias("rule")
    )
    carried = ends.where("last > first").select(
        F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("block"), "key", "rule", F.lit(OPEN).alias("kind"), F.lit(1).alias("step")
    )
    order = ["key", "kind"]
    height = F.sum("step").over(Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    top = F.last(F.when(F.col("step") == 1, F.col("rule")), ignorenulls=True).over(
        Window.partitionBy("block", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    swept = placed.unionByName(carried, allowMissingColumns=True).withColumn("height", height).withColumn("rule", top)
    return swept.where((F.col("kind") == POINT) & (F.col("height") > 0)).select("host", "path", "rule")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``, one row for each row.

    A rule (host, path, action) fits its host and all subdomains if the path of the url starts with the rule's. Of several the longest
    holds (host and path together, then the longer host); where none fits, ``rule`` is null and ``verdict`` is ``default``. A null or
    empty url, or one without ``://``, has an empty host, which no rule fits. Repeated rows are judged alike; columns of the four names
    are replaced; an empty table stays empty; without rules the default holds. Rules may be as many as urls: none is sent to all tasks.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(F.lit(0).alias("__row"), *[c for c in pages.columns if c not in ADDED]).alias("row"), host.alias("host"), path.alias("path"))
    known = stored(canonical_rules(rules), "rules")
    deepest = known.agg(F.max("labels")).first()[0] or 0
    labels = F.slice(_reversed_labels(F.col("host")), 1, deepest)  # longer parents are no rule's host
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.slice(labels, 1, i))
    points = rows.select("host", "path").where("host != ''").distinct().select("host", "path", F.explode(parents).alias("labels"))
    likely = bitmap(known.select(F.xxhash64(_reversed_labels(F.col("host"))).alias("h")), "h", BITMAP_WORDS).scalar()
    points = points.where(in_bitmap(likely, F.xxhash64("labels"), BITMAP_WORDS)).select("host", "path", _key(F.col("labels"), F.col("path")).alias("key"))
    longest = F.struct(F.length("rule.name"), F.length("rule.host"))
    found = sweep(points if deepest else points.limit(0), known).groupBy("host", "path").agg(F.max_by("rule", longest).alias("found"))
    return rows.join(found, ["host", "path"], "left").select(
        "row.*", "host", "path", F.col("found.name").alias("rule"), F.coalesce("found.action", F.lit(default)).alias("verdict")
    ).drop("__row")
