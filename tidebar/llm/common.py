"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

NAME = ("__name1", "__name2")  # no names that a user's columns have
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but by columns and compressed, so that later steps read
    only what they need. A lost executor costs at most the tasks that read the files again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: list[dict] = []


def sole_caches(found: Iterator, *own: dict) -> Iterator:
    """What ``found`` yields. Python workers outlive their tasks: what other operators' tasks have cached in this one goes first."""
    for cache in _HELD:
        if not any(cache is x for x in own):
            cache.clear()
    _HELD[:] = own
    yield from found


def share_of_hash(hashed: Column, share: float) -> Column:
    """True for about this share of all 64-bit hashes, however small it is."""
    return F.lit(True) if share >= 1 else hashed < F.lit(int(share * 2.0 ** 64) - (1 << 63))


def partitions(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions for an explicit ``repartition`` so that each holds about ``per_partition`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def bitmap(hashes: DataFrame, column: str, words: int) -> DataFrame:
    """One row: an array of ``words`` longs (a power of two) with the bits of all hashes set, a filter of bounded size."""
    slot = F.shiftrightunsigned(column, 6).bitwiseAND(words - 1)
    bits = hashes.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits"))
    full = hashes.sparkSession.range(words).join(bits, F.col("id") == F.col("slot"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bitmap"))


def in_bitmap(bits: Column, hashed: Column, words: int) -> Column:
    """False for a hash that is not in the bitmap; seldom true for one that is not."""
    word = F.element_at(bits, (F.shiftrightunsigned(hashed, 6).bitwiseAND(words - 1) + 1).cast("int"))
    return F.getbit(word, hashed.bitwiseAND(63).cast("int")) == 1


def beside(df: DataFrame, one: DataFrame, always: Column) -> DataFrame:
    """Add the array column of a one-row table of bounded size to every row: a broadcast hash join on a key that is 0 everywhere.

    Lambdas may not hold subqueries, so what they look up has to be a column. ``always`` is any non-negative column of ``df``.
    """
    keyed = one.withColumn("_one", F.least(F.size(one.columns[0]), F.lit(0)))  # no literal: that would be folded to a cross join
    return df.withColumn("_zero", F.least(always, F.lit(0))).join(F.broadcast(keyed), F.col("_zero") == F.col("_one")).drop("_zero", "_one")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once: the optimizer does not copy it into the lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def named(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add two columns (``NAME``), 128 bits of hash that tell documents apart by id and text."""
    return df.withColumns({NAME[0]: F.xxhash64(doc_id, text), NAME[1]: F.xxhash64(F.lit("second"), text, doc_id)})


def without(docs: DataFrame, gone: DataFrame, words: int = 1 << 15) -> DataFrame:
    """Rows of ``docs`` whose name (``NAME``) is not in ``gone``; texts that a bitmap of bounded size clears are not shuffled."""
    gone = stored(gone.select(F.col(NAME[0]).alias("__g1"), F.col(NAME[1]).alias("__g2")).distinct(), "gone")
    rows = named(docs)
    hit = in_bitmap(bitmap(gone, "__g1", words).scalar(), F.col(NAME[0]), words)
    kept = rows.where(hit).join(gone, (F.col(NAME[0]) == F.col("__g1")) & (F.col(NAME[1]) == F.col("__g2")), "left_anti")
    return rows.where(~hit).unionByName(kept).select(*docs.columns)
