"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each level groups only the rows that the level before left in company. Lengths and prefix hashes come
from one scan and shuffle two numbers a row. Only rows whose (length, prefix hash) is shared have their
full content hashed: a bitmap of bounded size, built from the shared pairs, tells most of the others
apart inside the scan, so no text is ever shuffled; what the bitmap lets through by mistake ends as a
group of one row at the last level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bitmap, in_bitmap, stored

PREFIX_CHARS = 64
BITMAP_WORDS = 1 << 15  # 2^21 bits, 256 KB: the bound of what every task gets


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix_chars: int = PREFIX_CHARS,
                     bitmap_words: int = BITMAP_WORDS) -> DataFrame:
    """Mark every row with the row of its group that stays.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest ``doc_id`` stays.
    Adds ``keep_id``, ``group_size`` and ``kept`` to the columns other than ``text``; existing columns of these
    names are replaced. A null text counts as empty, and empty texts form one group. Rows without a
    ``doc_id`` count in the size of their group but stay only when no row of it has one (then ``keep_id``
    is null and all of them stay). Rows that repeat a ``doc_id`` are separate rows; if both hold the kept
    id, both are marked kept. An empty table gives an empty result.
    """
    carried = [c for c in docs.columns if c not in {text, "keep_id", "group_size", "kept"}]
    whole = F.coalesce(ascii_lower(F.col(text)), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(c) for c in carried]).alias("row"), F.col(doc_id).alias("id"), whole.alias("whole"),
    ).withColumns({"size": F.octet_length("whole"), "prefix": F.xxhash64(F.substring("whole", 1, prefix_chars))})

    # Levels one and two need two numbers a row.
    sizes = rows.groupBy("size", "prefix").agg(F.count("*").alias("n"))
    same = sizes.groupBy("size").agg(F.sum("n").alias("same_size")).where("same_size > 1")
    pairs = stored(
        sizes.join(same, "size", "left_semi").where("n > 1").select("size", "prefix", F.xxhash64("size", "prefix").alias("pair")),
        "exact-pairs",
    )

    # Level three: the full hash, only where the pair may be shared.
    pair = F.xxhash64("size", "prefix")
    shared = in_bitmap(bitmap(pairs, "pair", bitmap_words).scalar(), pair, bitmap_words)
    hashed = stored(rows.select("row", "id", "size", "prefix", F.when(shared, F.sha2("whole", 256)).alias("full")), "exact-rows")
    groups = hashed.where("full is not null").groupBy("size", "prefix", "full").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
    groups = groups.where("group_size > 1").select(F.col("full").alias("group_full"), "group_size", "keep_id")
    # Rows without a full hash stay out of the join: null keys would all meet in one partition.
    alone = hashed.where("full is null").withColumns({"group_size": F.lit(None).cast("long"), "keep_id": F.col("id")})
    met = hashed.where("full is not null").join(groups, F.col("full") == F.col("group_full"), "left")
    out = met.select(*alone.columns).unionByName(alone)
    lone = F.col("group_size").isNull()
    return out.select(
        "row.*", F.when(lone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (lone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
    )
