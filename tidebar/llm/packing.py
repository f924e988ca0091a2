"""Best-fit packing of documents into training sequences, with large items matched first.

What a sequence can hold depends only on piece lengths, and there are at most ``capacity`` of them. So the packing
is worked out on the histogram of lengths, for whole classes of equal bins at a time, and gives the same
bins as packing one document after another in descending length: first the pieces over a third of the
capacity, of which a bin takes two at most, matched greedily (the largest with the largest that still fits, which
leaves the fewest bins); then the smaller ones, each into the fullest bin with room. The plan has a few thousand rows
whatever the number of documents. Every piece then finds its bin from its length and its rank among
the pieces of that length; ranks are counted in blocks, so no length is ordered by one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sole_caches, stored
from .tokens import default_tokenizer, word_ids

CAPACITY = 2048
RANK_BLOCK = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    cache, end = word_ids(tokenizer), end_id.to_bytes(4, "little")
    for batch in batches:
        row, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(cache.encode_all(t.as_py() for t in batch.column("text"))):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        doc_id = batch.column("doc_id").take(pa.array(row, pa.int64()))
        yield pa.record_batch(
            [doc_id, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(docs: DataFrame, end_id: int = 0, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Token counts and checksums of each document's pieces; only documents over ``capacity`` have several."""
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: sole_caches(_pieces(it, tokenizer, end_id, capacity), word_ids(tokenizer)), PIECES)


def bin_classes(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Pack ``counts`` (length to number of pieces); returns classes of equal bins: (bins, [(length, times), ...])."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    least = capacity // 3 + 1  # the shortest large piece
    by_gap: dict[int, list[list]] = {}
    gaps: list[int] = []

    def add(bins: int, gap: int, held: list[tuple[int, int]]) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append([bins, held])

    for a in range(capacity, least - 1, -1):
        while left[a]:
            b = min(a, capacity - a)
            while b >= least and left[b] < (2 if b == a else 1):
                b -= 1
            if b < least:
                add(int(left[a]), capacity - a, [(a, 1)])
                left[a] = 0
            else:
                n = int(left[a] // 2 if a == b else min(left[a], left[b]))
                left[a] -= n
                left[b] -= n
                add(n, capacity - a - b, [(a, 2)] if a == b else [(a, 1), (b, 1)])

    for a in range(min(least - 1, capacity), 0, -1):
        n = int(left[a])
        for gap in gaps[bisect_left(gaps, a):]:
            if not n:
                break
            times, waiting = gap // a, by_gap[gap]
            while waiting and n:
                bins, held = waiting.pop()
                full = min(bins, n // times)
                rest = bins - full
                n -= full * times
                if full:
                    add(full, gap - a * times, [*held, (a, times)])
                if rest and n:  # fewer than one bin takes
                    add(1, gap - a * n, [*held, (a, n)])
                    n, rest = 0, rest - 1
                if rest:
                    waiting.append([rest, held])
                    break
        gaps = [g for g in gaps if by_gap[g]]
        by_gap = {g: by_gap[g] for g in gaps}
        times = capacity // a
        if n // times:
            add(n // times, capacity - a * times, [(a, times)])
        if n % times:
            add(1, capacity - a * (n % times), [(a, n % times)])
    return [(bins, held) for group in by_gap.values() for bins, held in group if bins]


def slots(classes: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Columns length, first rank, first bin, offset, times; sorted by length and first rank."""
    out, ranks, base = [], {}, 0
    for bins, held in classes:
        offset = 0
        for length, times in held:
            rank = ranks.get(length, 0)
            out.append((length, rank, base, offset, times))
            ranks[length] = rank + bins * times
            offset += length * times
        base += bins
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _placed(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    key = (table[:, 0] << 48) + table[:, 1]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
        nth = rank - at[:, 1]
        sequence, offset = at[:, 2] + nth // at[:, 4], at[:, 3] + nth % at[:, 4] * length
        kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(found: DataFrame, capacity: int = CAPACITY, rank_block: int = RANK_BLOCK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces."""
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # ``capacity`` rows at most
    table = slots(bin_classes(counts, capacity))
    spark = found.sparkSession

    # Ranks within a length: blocks of rows by hash, numbered inside, placed after the blocks before.
    sizes = spark.createDataFrame([(k, -(-v // rank_block)) for k, v in counts.items()], "length long, blocks long")
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "blocks")
    rows = found.join(F.broadcast(sizes), "length").withColumn("block", block)  # ``capacity`` rows at most
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "block").count().select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("base"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("nth", F.row_number().over(inside)).join(bases, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))
    shared = spark.sparkContext.broadcast(table)
    return ranked.mapInArrow(lambda it: _placed(it, shared.value), PIECES + ", sequence_id long, offset long")


def best_fit(docs: DataFrame, end_id: int = 0, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; one over ``capacity`` is cut into full pieces and a rest. A null text is
    empty and packs as its end id; rows with a null or repeated ``doc_id`` are documents of their own; an empty table
    gives an empty result. Equal lengths are interchangeable, so ties do not change the number of sequences.
    """
    return pack(stored(pieces(docs, end_id, capacity, tokenizer), "pieces"), capacity)
