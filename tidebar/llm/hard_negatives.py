"""Hard negatives from exact scores by Kronecker-packed products.

Components are whole numbers. Shifted by their least value they are not negative, so the components of several candidates fit side by
side into the fields of one wide integer, each field as wide as the largest possible sum. One multiplication with an
anchor's component multiplies all of them, and the sum over components holds all scores, which are cut out of their fields again and
shifted back. Integers of up to 53 bits are held in doubles, where a matrix product adds them without rounding; components too
large for two fields of that size are packed a block at a time into Python's integers of any width.

Anchors are compared with all rows in blocks of bounded size, one block of anchors at a time: first the best rows with the anchor's label,
then, between the bounds that these set, the best rows with another one. Tasks return their best rows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import numbered
from .common import stored

ANCHORS, AT_ONCE, CANDIDATES = 1 << 13, 1 << 9, 1 << 12
LARGEST = 1 << 62
MANTISSA = 53
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, anchors by candidates, which have to fit 64 bits themselves."""
    (n, d), few = candidates.shape, len(anchors)
    if not (n and d and few):
        return np.zeros((few, n), np.int64)
    low, least = int(anchors.min()), int(candidates.min())
    up, shifted = anchors.astype("<u8") - np.uint64(low % (1 << 64)), candidates.astype("<u8") - np.uint64(least % (1 << 64))
    bits = max(1, (d * int(up.max()) * int(shifted.max())).bit_length())
    fields = MANTISSA // bits
    if fields > 1:
        wide = np.zeros((d, -(-n // fields)))
        for j in range(fields):
            some = shifted[j::fields].T
            wide[:, :some.shape[1]] += some.astype(np.float64) * float(1 << j * bits)
        sums = (up.astype(np.float64) @ wide).astype(np.int64)
        found = np.stack([(sums >> j * bits) & ((1 << bits) - 1) for j in range(fields)], axis=2).reshape(few, -1)[:, :n]
    else:
        size = -(-bits // 64)  # words a field
        columns = np.zeros((d, n, size), "<u8")
        columns[:, :, 0] = shifted.T
        wide = [int.from_bytes(c.tobytes(), "little") for c in columns]
        totals = [sum(int(x) * w for x, w in zip(a, wide)) for a in up]
        found = np.stack([np.frombuffer(t.to_bytes(8 * n * size, "little"), "<u8")[::size] for t in totals])
    with np.errstate(over="ignore"):  # modulo 2^64, as the scores fit
        back = (up.sum(axis=1, dtype=np.uint64) * np.uint64(least % (1 << 64)))[:, None] + candidates.astype(np.uint64).sum(axis=1, dtype=np.uint64) * np.uint64(low % (1 << 64))
        return (found.astype(np.uint64) + back).view(np.int64)


def _best(scores: np.ndarray, fit: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores in each row among those that fit, -1 for want of more; of equal scores the first."""
    n = scores.shape[1]
    if not n:
        return np.full((len(scores), k), -1)
    top = min(k, n)
    if -(1 << 48) < scores.min() and scores.max() < 1 << 48:
        key = np.where(fit, scores * n + np.arange(n - 1, -1, -1), LEAST)
        at = np.argpartition(key, n - top, axis=1)[:, n - top:]
    else:
        at = np.lexsort((~scores, ~fit), axis=1)[:, :top]  # ~score falls as score rises, without overflow
    at = np.where(np.take_along_axis(fit, at, 1), at, -1)
    return np.pad(at, ((0, 0), (0, k - top)), constant_values=-1)


class Best:
    """The best ``k`` rows seen so far for each slot."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((slots, k), LEAST), np.full((slots, k), NO_ID), np.full((slots, k), -1)

    def add(self, slots: np.ndarray, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        none = at < 0
        score = np.where(none, LEAST, np.take_along_axis(scores, np.maximum(at, 0), 1))
        score = np.concatenate([self.score[slots], score], 1)
        ident = np.concatenate([self.id[slots], np.where(none, NO_ID, ids[at])], 1)
        row = np.concatenate([self.row[slots], np.where(none, -1, rows[at])], 1)
        order = np.lexsort((ident, ~score, row < 0), axis=1)[:, :self.k]
        self.score[slots], self.id[slots], self.row[slots] = (np.take_along_axis(x, order, 1) for x in (score, ident, row))

    def table(self, anchors: np.ndarray, ordinals: np.ndarray) -> pa.RecordBatch:
        slot, place = np.nonzero(self.row >= 0)
        ids = self.id[slot, place]
        return pa.RecordBatch.from_arrays(
            [pa.array(anchors[slot]), pa.array(ordinals[slot]), pa.array(self.score[slot, place]), pa.array(ids, mask=ids == NO_ID), pa.array(self.row[slot, place])],
            names=["anchor", "ordinal", "score", "id", "row"],
        )


FOUND = "anchor long, ordinal long, score long, id long, row long"


def _matrix(batch: pa.RecordBatch) -> list[tuple[np.ndarray, ...]]:
    """Rows, ids, labels and components of a batch, for each length of vectors, by id."""
    q = batch.column("q")
    flat, lengths = q.flatten().to_numpy(zero_copy_only=False), q.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    ids, rows, labels = batch.column("id").fill_null(NO_ID).to_numpy(), batch.column("row").to_numpy(), batch.column("label").to_numpy()
    out = []
    for d in np.unique(lengths):
        which = np.flatnonzero(lengths == d)
        which = which[np.argsort(ids[which], kind="stable")]
        out.append((rows[which], ids[which], labels[which], flat[starts[which][:, None] + np.arange(d)].astype(np.int64)))
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "ordinal").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(rows: DataFrame, block, bounds, k: int) -> DataFrame:
    """Best rows for each anchor of a block (``bounds`` null: with its label) or for each of its bounds (with another label, within them)."""
    shared = rows.sparkSession.sparkContext.broadcast((block, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, limits = shared.value
        sets = []
        for own, _, labels, q in anchors:
            for lo in range(0, len(own), AT_ONCE):
                some = slice(lo, lo + AT_ONCE)
                wanted = [(i, 0, 0, 0) for i in range(len(own[some]))] if limits is None else [
                    (i, o, low, high) for i, a in enumerate(own[some]) for o, low, high in limits.get(int(a), ())
                ]
                if wanted:
                    slot, ordinal, low, high = (np.array(x, np.int64) for x in zip(*wanted))
                    sets.append((own[some], labels[some], q[some], slot, ordinal, low, high, Best(len(slot), k)))
        for batch in batches:
            for row, ident, label, q in _matrix(batch):
                for lo in range(0, len(row), CANDIDATES):
                    some = slice(lo, lo + CANDIDATES)
                    for own, labels, mine, slot, _, low, high, best in sets:
                        if mine.shape[1] != q.shape[1]:
                            continue
                        scores, same = packed_scores(mine, q[some]), labels[:, None] == label[some]
                        for at in range(0, len(slot), AT_ONCE):
                            part = np.arange(at, min(at + AT_ONCE, len(slot)))
                            s, alike = scores[slot[part]], same[slot[part]]
                            fit = alike & (own[slot[part]][:, None] != row[some]) if limits is None else ~alike & (s >= low[part, None]) & (s <= high[part, None])
                            best.add(part, _best(s, fit, k), s, ident[some], row[some])
        for own, _, _, slot, ordinal, _, _, best in sets:
            yield best.table(own[slot], ordinal)

    return rows.select("row", "id", "label", "q").mapInArrow(run, FOUND)


def _least_over(share: tuple[int, int], score: int) -> int:
    """Least whole number that is at least ``share`` of ``score``."""
    return -(-share[0] * score // share[1])


def mine(vectors: DataFrame, is_anchor, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
         positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``: hard negatives of every anchor and positive.

    Components become floor(scale * x); a score is a whole inner product and has to fit 64 bits. Positives of an anchor (a row for which the
    column ``is_anchor`` holds) are its best other rows of the same label, negatives the best rows of another label that score at most as much
    as the positive and at least ``share`` of it; higher scores come first, then smaller ids, null ids last. Rows with a null label, a null
    vector or a null or non-finite component take no part; vectors of unlike lengths have no score; rows that repeat an id are rows of
    their own; other columns are ignored; an empty table or one without anchors gives an empty table. A component of 2^62 or more after
    scaling is an error.
    """
    spark = vectors.sparkSession
    value = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    large = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= float(LARGEST))
    usable = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    usable = usable.select(
        F.lit("").alias("all"), F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.when(large, F.raise_error(F.lit("a component is too large"))).otherwise(value).alias("q"),
    )
    rows = stored(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")  # row numbers are fixed once they are stored
    order = rows.where("anchor").select("all", "row")
    place = stored(numbered(order, "all", "row").select("row", F.expr(f"at div {ANCHORS}").alias("block")), "anchors")
    anchors = stored(rows.join(place, "row").select("row", "id", "label", "q", "block"), "anchors")
    count, parts, chosen = anchors.agg(F.max("block")).first()[0], [], []
    for b in range(0 if count is None else count + 1):
        block = [x for y in anchors.where(F.col("block") == b).select("row", "id", "label", "q").toArrow().to_batches() for x in _matrix(y)]  # at most ANCHORS
        own = _ranked(_search(rows, block, None, positives), positives)
        chosen.append(stored(own.select("anchor", F.col("rank").cast("long").alias("ordinal"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives"))
        bounds: dict[int, list[tuple[int, int, int]]] = {}
        for p in chosen[-1].collect():  # at most ``positives`` an anchor of the block
            bounds.setdefault(p["anchor"], []).append((p["ordinal"], _least_over(share, p["positive_score"]), p["positive_score"]))
        parts.append(stored(_ranked(_search(rows, block, bounds, negatives), negatives).drop("row"), "negatives"))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return reduce(DataFrame.unionByName, parts).join(reduce(DataFrame.unionByName, chosen), ["anchor", "ordinal"]).join(named, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
