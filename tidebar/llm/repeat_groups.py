"""Maximal repeats with all their occurrences, from the common-prefix interval tree of anchored suffixes.

A node of the tree holds all suffixes that share ``depth`` bytes after their anchor and not one more. Its members are in the order of what
comes before them; a second stack scan over how far neighbours agree there gives every run that shares ``left`` bytes
before the anchor and not all of it one more: its left extensions are diverse. A run that no deeper node holds whole is
a maximal repeat of ``left + depth`` bytes, and its members are all its occurrences.

A string is followed as far as the strings of ``span`` bytes with its anchor reach, so a repeat of many anchors comes as one group
for each, overlapping the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, partitions, stored
from .repeats import CHUNK_ROWS, GRAM, SPAN, _context_batches, _hash_batches, _Least, _padded, _sorted, intervals, repeat_nodes

BITMAP_WORDS = 1 << 19
OCCURRENCES = "left int, depth int, string binary, k1 long, k2 long, start long"


def maximal_runs(right, right_len, left, left_len, span: int, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Bytes before and after the anchor, and members, of every maximal repeat of at least ``span`` bytes."""
    order, lcp = _sorted(right, right_len)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    least = _Least(lcp)
    for node, member, depth, agree in repeat_nodes(right, right_len, left, left_len, k):
        runs = intervals(agree, 0)  # the -1 between nodes and at the end closes every run
        if not len(runs):
            continue
        first, last, before = runs.T
        long = before + depth[first] >= span
        first, last, before = first[long], last[long], before[long]
        for a, b, e in zip(first, last, before):
            at = place[member[a:b + 1]]
            if least.of(np.array([at.min() + 1]), np.array([at.max()]))[0] == depth[a]:  # else a child holds them all
                yield int(e), int(depth[a]), member[a:b + 1]


def _groups(table: pa.Table, span: int, k: int) -> Iterator[pa.RecordBatch]:
    anchor = table["anchor"].to_numpy()
    table = table.combine_chunks()
    around, at, before = table["around"].chunk(0), table["at"].to_numpy(), table["before"].to_numpy().astype(np.int64)
    offsets = np.frombuffer(around.buffers()[1], np.int32, len(around) + 1 + around.offset)[around.offset:].astype(np.int64)
    flat = np.frombuffer(around.buffers()[2], np.uint8)
    keys = [table[c].to_numpy() for c in ("k1", "k2")]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])), len(anchor))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi - lo < 2:
            continue
        start, own, after = offsets[lo:hi] + before[lo:hi], before[lo:hi], np.diff(offsets)[lo:hi] - before[lo:hi]
        rows = ([], [], [], [], [], [])
        runs = maximal_runs(_padded(flat, start, after, span), after, _padded(flat, start, own, span - k, backwards=True), own, span, k)
        for e, depth, members in runs:
            text = flat[start[members[0]] - e:start[members[0]] + depth].tobytes()
            for column, values in zip(rows, ([e] * len(members), [depth] * len(members), [text] * len(members), keys[0][lo:hi][members], keys[1][lo:hi][members], at[lo:hi][members] - e)):
                column.extend(values)
        if rows[0]:
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, kinds)], names=["left", "depth", "string", "k1", "k2", "start"])


def _whole_anchors(batches: Iterator[pa.RecordBatch], span: int, k: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Groups of each anchor; rows come sorted by anchor and are taken in chunks of whole anchors."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            anchor = table["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield from _groups(table.slice(0, cut), span, k)
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield from _groups(pa.Table.from_batches(held), span, k)


def repeat_groups(docs: DataFrame, text: str = "text", span: int = SPAN, k: int = GRAM, chunk_rows: int = CHUNK_ROWS,
                  bitmap_words: int = BITMAP_WORDS) -> DataFrame:
    """``group``, ``length``, ``left``, ``depth``, the columns of ``docs`` but ``text``, and ``start``: one row an occurrence of each maximal repeat.

    ``group`` is the SHA-256 of the repeated bytes, ``start`` the byte where an occurrence begins. Texts are UTF-8; a null text is empty; shorter texts
    than ``span`` are in no group; rows with equal texts are occurrences of their own; columns of the five names are
    replaced; an empty table gives an empty result. The rows of one anchor meet in one task.
    """
    spark, added = docs.sparkSession, {"group", "length", "left", "depth", "start"}
    carried = [c for c in docs.columns if c not in {text} | added]
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(F.lit(0).alias("__row"), *carried).alias("row"), whole.alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})
    keyed = rows.select("k1", "k2", "text").where(F.octet_length("text") >= span)
    counts = keyed.select("text").mapInArrow(lambda it: _hash_batches(it, span, k), "anchor long, n long")
    again = stored(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    bits = np.array(bitmap(again, "anchor", bitmap_words).first()[0], np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    contexts = keyed.mapInArrow(
        lambda it: _context_batches(it, shared.value, np.empty(0, np.int64), span, k), "anchor long, k1 long, k2 long, at long, before int, around binary"
    )
    n_again = again.agg(F.sum("n")).first()[0] or 0
    dealt = contexts.repartition(partitions(spark, n_again, 4 * chunk_rows), "anchor").sortWithinPartitions("anchor", "k1", "k2", "at")
    found = dealt.mapInArrow(lambda it: _whole_anchors(it, span, k, chunk_rows), OCCURRENCES)
    found = found.select(F.sha2("string", 256).alias("group"), F.octet_length("string").alias("length"), "left", "depth", "k1", "k2", "start").distinct()
    named = rows.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "row")
    met = found.join(named, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")))
    return met.select("group", "length", "left", "depth", "row.*", "start").drop("__row")
