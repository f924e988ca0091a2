"""Merkle manifest of a dataset by slot pivots.

Leaves are numbered within their tree; ``at mod fanout`` is the slot of a node, ``at div fanout`` its parent. Grouping by parent with one
conditional aggregate a slot spreads the children into ``fanout`` columns: all columns joined are hashed to the parent, and
all but the own slot's are a child's siblings. Several levels are pivoted on one shuffle by their common ancestor, whose row keeps
the siblings of its at most ``MEMBERS`` descendants. On the way down each such row meets the path of its ancestor once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import numbered
from .common import partitions, stored

MEMBERS = 32
ADDED = ("leaf", "subroot", "root", "proof")
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts in a row; null parts add nothing."""
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as number of UTF-8 bytes, colon and text, or ``-`` if it is null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(*[one(c.cast("string")) for c in fields])


def fold(own: Column, proof: Column) -> Column:
    """Root that follows from a leaf and the siblings of its proof."""
    return F.aggregate(proof, own, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of nodes (``tree``, ``top``, ``at``, ``total``, ``digest``, ``members``). A node that is alone in its tree stays as it is."""
    slot, of = F.col("at") % fanout, lambda j: F.coalesce(f"c{j}", F.lit(""))
    spread = [F.first(F.when(slot == j, F.col(c)), ignorenulls=True).alias(f"{c[0]}{j}") for j in range(fanout) for c in ("cell", "members")]
    parents = nodes.withColumnRenamed("digest", "cell").groupBy("tree", "top", F.expr(f"at div {fanout}").alias("at")).agg(*spread, F.first("total").alias("n"))
    several = F.col("n") > 1

    def grown(j: int) -> Column:
        join = lambda some: F.concat(F.lit(""), *map(of, some))
        step = F.when(several, F.array(F.struct(join(range(j)).alias("left"), join(range(j + 1, fanout)).alias("right")))).otherwise(F.array().cast(_PATH))
        return F.transform(F.coalesce(f"m{j}", F.array()), lambda m: F.struct(m["item"].alias("item"), F.concat(m["path"], step).alias("path")))

    return parents.select(
        "tree", "top", "at", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("total"),
        F.when(several, F.sha2(F.concat(*map(of, range(fanout))), 256)).otherwise(F.col("c0")).alias("digest"),
        F.concat(*map(grown, range(fanout))).alias("members"),
    )


def _climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Stored layers from the leaves (``tree``, ``at``, ``total``, ``digest``, ``item``) up; the last has one row a tree."""
    levels = 1
    while fanout ** (levels + 1) <= MEMBERS:
        levels += 1
    span, layers = fanout ** levels, []
    while True:
        # Aggregates run on the columns that the rows are dealt by, so none of the levels shuffles again.
        width = partitions(nodes.sparkSession, nodes.count(), 1 << 16)
        own = F.array(F.struct("item", F.array().cast(_PATH).alias("path"))).alias("members")
        layer = nodes.select("tree", F.expr(f"at div {span}").alias("top"), "at", "total", "digest", own).repartition(width, "tree", "top")
        for _ in range(levels):
            layer = _pivot(layer, fanout)
        layers.append(stored(layer.drop("top"), "merkle-layer"))
        if (layers[-1].agg(F.max("total")).first()[0] or 1) == 1:
            return layers
        nodes = layers[-1].select("tree", "at", "total", "digest", F.col("at").alias("item"))


def _descend(layers: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree``, ``item``, ``path`` and the columns of ``above`` for every leaf; ``above`` has ``tree``, ``at`` 0 and ``path`` of each top."""
    carried = [c for c in above.columns if c not in ("tree", "at", "path")]
    for layer in reversed(layers):
        above = layer.select("tree", "at", "members").join(above, ["tree", "at"]).select("tree", F.explode("members").alias("m"), "path", *carried)
        above = above.select("tree", F.col("m.item").alias("at"), F.concat("m.path", "path").alias("path"), *carried)
    return above.withColumnRenamed("at", "item")


def manifest(docs: DataFrame, own: Column, group: str = "source", order: str = "doc_id", fanout: int = 3, drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """Columns of ``docs`` without those in ``drop``, with ``leaf``, ``subroot``, ``root`` and ``proof``, one row for each row.

    ``own`` is the leaf of a row. The leaves of a ``group`` (null is a group of its own) ascend by ``order``, nulls first, then by leaf;
    while there are several, each ``fanout`` in a row become their digest, the last run with what is left. The subroots ascend by
    group, null first, then bytewise, and give the root in the same way. ``proof`` has a struct (left, right) of the joined siblings
    a level. Repeated rows are leaves of their own; an empty text is a value; columns of the four names are replaced; an empty
    table gives an empty table. Groups may have any size and number: nothing but the height of the tree reaches the driver.
    """
    kept = [F.col(c) for c in docs.columns if c not in {*drop, *ADDED}]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # keeps the order of groups
    leaves = docs.select(tree.alias("tree"), F.col(order).alias("order"), own.alias("digest"), F.struct(F.lit(0).alias("__row"), *kept).alias("row"))
    placed = stored(numbered(stored(leaves, "leaves"), "tree", "order", "digest"), "numbered")
    layers = _climb(placed.select("tree", "at", "total", "digest", F.struct("digest", "row").alias("item")), fanout)

    tops = stored(layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "subroots")
    heads = stored(numbered(tops, "tree", "of"), "numbered")
    upper = _climb(heads.select("tree", "at", "total", "digest", F.struct("of", "digest").alias("item")), fanout)
    root = upper[-1].select("tree", "at", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    roots = _descend(upper, root).select(F.col("item.of").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("item.digest").alias("subroot"), "root")
    return _descend(layers, roots).select("item.row.*", F.col("item.digest").alias("leaf"), "subroot", "root", F.col("path").alias("proof")).drop("__row")
