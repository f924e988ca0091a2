"""Removal of repeated passages by a sparse enhanced suffix array.

Two equal strings of ``span`` bytes have their anchor, the gram of least hash, at the same place. So only suffixes that
start at anchors are sorted, and only anchors that occur again are sent: each with the bytes around it that the strings
it stands for can reach. All rows of an anchor meet in one task, which sorts what follows the anchors (the sparse suffix
array with its common prefixes), scans it with a stack for common-prefix intervals, the nodes of the suffix tree, and
orders the members of each node by what comes before them. Two members that agree for ``e`` bytes before and
``depth`` bytes after the anchor have a repeat of ``e + depth`` bytes; where they stop agreeing on the left it is maximal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, partitions, stored

SPAN, GRAM = 200, 32
CHUNK_ROWS = 20_000  # anchors that one suffix array holds
HOT_ROWS = 1 << 18  # an anchor with more rows than this is not gathered in a task
BITMAP_WORDS = 1 << 19  # 2^25 bits, 4 MB: the bound of what every task gets
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """64-bit hashes of all ``k``-byte grams (``k`` a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    width = 1
    while width < k:
        h ^= h >> np.uint64(29)
        h = h[:-width] * np.uint64(0xBF58476D1CE4E5B9 + 2 * width) + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, span: int = SPAN, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of every ``span``-byte string: the leftmost gram of least hash in it.

    Returns the hash and place of each anchor and the first and last start of the strings that have it.
    """
    if len(data) < span:
        return np.empty(0, np.int64), *(np.empty(0, np.int64),) * 3
    h = gram_hashes(data, k)
    least = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # by hash, then by place
    width, window = 1, span - k + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[:-(window - width)], least[window - width:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]].view(np.int64), at[first], first, last


def intervals(lcp: np.ndarray, floor: int) -> np.ndarray:
    """Common-prefix intervals (first, last, depth) of at least ``floor``, by one scan with a stack.

    ``lcp[i]`` is the common prefix of suffixes ``i - 1`` and ``i`` in sorted order. Every interval is a node of the suffix tree:
    all suffixes in it share ``depth`` bytes, and not all of them one more.
    """
    out, stack = [], []  # open intervals: (depth, first)
    for i, depth in enumerate([*lcp[1:].tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((first, i - 1, d))
        if depth >= floor and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return np.array(out, np.int64).reshape(-1, 3)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of zero-padded rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _sorted(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of zero-padded byte rows, and the common prefix of each with the one before."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    lcp = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 14):
        here = order[lo:lo + (1 << 14)]
        before = order[lo - 1:lo - 1 + len(here)]
        lcp[lo:lo + len(here)] = np.minimum(_common(rows[before], rows[here]), np.minimum(length[before], length[here]))
    return order, lcp


class _Least:
    """Least value of any stretch of an array."""

    def __init__(self, values: np.ndarray):
        self.table = [values.astype(np.int16)]
        while 2 * (1 << (len(self.table) - 1)) <= len(values):
            width = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of ``first..last``, ends included and none empty."""
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for j in np.unique(level):
            at = level == j
            out[at] = np.minimum(self.table[j][first[at]], self.table[j][last[at] - (1 << j) + 1])
        return out


def repeat_nodes(right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray, floor: int):
    """Walk the interval tree of the suffixes that start at anchors.

    ``right`` and ``left`` hold what follows an anchor and, read backwards, what comes before it. Yields, for blocks of
    intervals: interval number, member, depth, and how far the member and its neighbours to the left agree: members are
    put in the order of what comes before them, and where two neighbours stop agreeing the repeat is diverse and ends.
    """
    order, lcp = _sorted(right, right_len)
    by_left, left_lcp = _sorted(left, left_len)
    rank = np.empty(len(order), np.int64)
    rank[by_left] = np.arange(len(order))
    least, found = _Least(left_lcp), intervals(lcp, floor)
    size = found[:, 1] - found[:, 0] + 1
    ends = np.cumsum(size)
    lo = 0
    while lo < len(found):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
        n = size[lo:hi]
        node = np.repeat(np.arange(lo, hi), n)
        member = order[np.repeat(found[lo:hi, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        by = np.lexsort((rank[member], node))
        node, member = node[by], member[by]
        ranks = rank[member]
        agree = np.full(len(node) + 1, -1, np.int64)  # with the one before; none across intervals
        inside = np.flatnonzero(node[1:] == node[:-1]) + 1
        agree[inside] = least.of(ranks[inside - 1] + 1, ranks[inside])
        yield node, member, found[node, 2], agree
        lo = hi


def repeated(right, right_len, left, left_len, span: int = SPAN, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """How far before and after its anchor each row lies in strings of ``span`` or more bytes that other rows have too (0, 0: in none)."""
    before, after = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
    for _, member, depth, agree in repeat_nodes(right, right_len, left, left_len, k):
        most = np.maximum(agree[:-1], agree[1:])
        long = (most >= 0) & (most + depth >= span)
        np.maximum.at(before, member[long], most[long])
        np.maximum.at(after, member[long], depth[long])
    return before, after


def _padded(flat: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
    """Rows of bytes plus one, padded with zeros: ``length`` bytes from ``start`` on, or the ones before it read backwards."""
    at = np.arange(width)
    inside = at < length[:, None]
    place = start[:, None] - 1 - at if backwards else start[:, None] + at
    return np.where(inside, flat[np.where(inside, place, 0)] + np.uint8(1), np.uint8(0))


# Distributed part.


def _chunks(data: np.ndarray, span: int, step: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a long text that overlap so that each string of ``span`` bytes starts in exactly one."""
    for lo in range(0, max(len(data) - span + 1, 0), step):
        yield lo, data[lo:lo + step + span - 1]


def _hash_batches(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.empty(0, np.int64)]
        for text in batch.column("text"):
            for _, piece in _chunks(np.frombuffer(text.as_buffer(), np.uint8), span):
                found.append(anchors(piece, span, k)[0])
        hashes, count = np.unique(np.concatenate(found), return_counts=True)
        yield pa.record_batch([pa.array(hashes), pa.array(count)], names=["anchor", "n"])


def _context_batches(batches: Iterator[pa.RecordBatch], bits: np.ndarray, hot: np.ndarray, span: int, k: int) -> Iterator[pa.RecordBatch]:
    """What surrounds the anchors that may be repeated."""
    for batch in batches:
        rows, size = [], 0
        keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
        for i, text in enumerate(batch.column("text")):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for lo, piece in _chunks(data, span):
                anchor, at, first, last = anchors(piece, span, k)
                kept = np.flatnonzero(_in(bits, anchor) & ~np.isin(anchor, hot))
                if not len(kept):
                    continue
                start, length = first[kept], last[kept] - first[kept] + span
                ends = np.cumsum(length)
                flat = piece[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]
                rows.append((anchor[kept], np.full(len(kept), keys[0][i]), np.full(len(kept), keys[1][i]), at[kept] + lo, (at - first)[kept], length, flat))
                size += len(flat)
                if size > 1 << 24:
                    yield _contexts(rows)
                    rows, size = [], 0
        if rows:
            yield _contexts(rows)


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    anchor, k1, k2, at, before, length, flat = (np.concatenate(x) for x in zip(*rows))
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    around = pa.Array.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    return pa.record_batch(
        [pa.array(anchor), pa.array(k1), pa.array(k2), pa.array(at), pa.array(before.astype(np.int32)), around],
        names=["anchor", "k1", "k2", "at", "before", "around"],
    )


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64)
    return (bits[(h >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def _span_batches(batches: Iterator[pa.RecordBatch], span: int, k: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Repeated stretches around anchors; rows come sorted by anchor and are taken in chunks of whole anchors."""
    held: list[pa.RecordBatch] = []
    n = 0
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
                yield from _spans(table.slice(0, cut), span, k)
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield from _spans(pa.Table.from_batches(held), span, k)


def _spans(table: pa.Table, span: int, k: int) -> Iterator[pa.RecordBatch]:
    anchor = table["anchor"].to_numpy()
    same = anchor[1:] == anchor[:-1]
    table = table.filter(pa.array(np.concatenate([same, [False]]) | np.concatenate([[False], same])))  # anchors met once
    if not table.num_rows:
        return
    table = table.combine_chunks()
    around, at, before = table["around"].chunk(0), table["at"].to_numpy(), table["before"].to_numpy().astype(np.int64)
    offsets = np.frombuffer(around.buffers()[1], np.int32, len(around) + 1 + around.offset)[around.offset:].astype(np.int64)
    flat = np.frombuffer(around.buffers()[2], np.uint8)
    place, after = offsets[:-1] + before, np.diff(offsets) - before
    left, right = repeated(
        _padded(flat, place, after, span), after, _padded(flat, place, before, span - k, backwards=True), before, span, k
    )
    hit = right > 0
    if hit.any():
        keys = table.filter(pa.array(hit))
        yield pa.record_batch(
            [keys["k1"].combine_chunks(), keys["k2"].combine_chunks(), pa.array((at - left)[hit]), pa.array((at + right)[hit])], names=["k1", "k2", "lo", "hi"]
        )


def _string_batches(batches: Iterator[pa.RecordBatch], hot: np.ndarray, span: int, k: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the strings of ``span`` bytes whose anchor is hot."""
    half = 1 << (span.bit_length() - 1)
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
        for i, text in enumerate(batch.column("text")):
            for lo, piece in _chunks(np.frombuffer(text.as_buffer(), np.uint8), span):
                anchor, _, first, last = anchors(piece, span, k)
                kept = np.isin(anchor, hot)
                if kept.any():
                    n = (last - first + 1)[kept]
                    start = np.repeat(first[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    h = gram_hashes(piece, half).view(np.int64)  # two overlapping halves make the string
                    yield pa.record_batch(
                        [pa.array(h[start]), pa.array(h[start + span - half]), *(pa.array(np.full(len(start), k[i])) for k in keys), pa.array(start + lo)],
                        names=["w1", "w2", "k1", "k2", "lo"],
                    )


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each text's spans and take them out."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data, kept, end, starts, ends = text.as_buffer().to_pybytes(), [], 0, [], []
            for s in spans.as_py() or []:
                if ends and s["lo"] <= ends[-1]:
                    ends[-1] = max(ends[-1], s["hi"])
                else:
                    starts.append(s["lo"])
                    ends.append(s["hi"])
            for a, b in zip(starts, ends):
                kept.append(data[end:a])
                end = b
            kept.append(data[end:])
            whole = b"".join(kept)
            for column, value in zip(out, (len(data), len(data) - len(whole), len(starts), whole, list(map(list, zip(starts, ends))))):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))
        names = ["n_bytes", "n_removed", "n_spans", "kept", "removed"]
        yield pa.record_batch([batch.column("row"), *(pa.array(x, t) for x, t in zip(out, kinds))], names=["row", *names])


def remove_repeats(docs: DataFrame, text: str = "text", span: int = SPAN, k: int = GRAM, chunk_rows: int = CHUNK_ROWS, hot_rows: int = HOT_ROWS,
                   bitmap_words: int = BITMAP_WORDS) -> DataFrame:
    """Take out every byte that a ``span``-byte string covers which also starts anywhere else, in this text or another.

    Returns the columns of ``docs`` but ``text``, with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes; cuts can
    fall inside a character) and ``removed`` (start and end of each maximal removed run). Texts are UTF-8; a null text is
    empty; shorter texts than ``span`` lose nothing; equal texts repeat each other whole; rows with null or repeated ids are
    separate texts; existing columns of the five names are replaced; an empty table gives an empty result.
    """
    spark, added = docs.sparkSession, {"n_bytes", "n_removed", "n_spans", "kept", "removed"}
    carried = [c for c in docs.columns if c not in {text} | added]
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(F.lit(0).alias("__row"), *carried).alias("row"), whole.alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})  # a text's name: 128 bits of hash
    keyed = rows.select("k1", "k2", "text").where(F.octet_length("text") >= span)

    # Anchors that occur again, as exact counts and as a bitmap that keeps most others from being sent.
    counts = keyed.select("text").mapInArrow(lambda it: _hash_batches(it, span, k), "anchor long, n long")
    again = stored(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    hot = np.sort(np.array([r["anchor"] for r in again.where(F.col("n") > hot_rows).select("anchor").collect()], np.int64))  # one in hot_rows at most
    slot = F.shiftrightunsigned("anchor", 6).bitwiseAND(bitmap_words - 1)
    filled = again.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(anchor & 63 as int))")).alias("bits")).toArrow()  # bitmap_words rows
    bits = np.zeros(bitmap_words, np.uint64)
    bits[filled["slot"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast((bits, hot))

    contexts = keyed.mapInArrow(
        lambda it: _context_batches(it, *shared.value, span, k), "anchor long, k1 long, k2 long, at long, before int, around binary"
    )
    n_again = again.agg(F.sum("n")).first()[0] or 0
    dealt = contexts.repartition(partitions(spark, n_again, 4 * chunk_rows), "anchor").sortWithinPartitions("anchor")
    spans = dealt.mapInArrow(lambda it: _span_batches(it, span, k, chunk_rows), "k1 long, k2 long, lo long, hi long")
    if len(hot):
        # Anchors with too many rows for one task: their strings are counted by hash, which combines before it shuffles.
        strings = keyed.mapInArrow(lambda it: _string_batches(it, shared.value[1], span, k), "w1 long, w2 long, k1 long, k2 long, lo long")
        often = strings.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        spans = spans.unionByName(strings.join(often, ["w1", "w2"]).select("k1", "k2", "lo", (F.col("lo") + span).alias("hi")))
    merged = stored(spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "repeated-spans")

    # Texts that surely have no repeat keep every byte and are not shuffled to meet their spans.
    named = merged.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "spans")
    cut = in_bitmap(bitmap(merged, "k1", 1 << 15).scalar(), F.col("k1"), 1 << 15)
    met = rows.where(cut).join(named, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").select("row", "text", "spans")
    met = met.unionByName(rows.where(~cut).select("row", "text", F.lit(None).cast(merged.schema["spans"].dataType).alias("spans")))
    row = rows.schema["row"].dataType.simpleString()
    out = met.mapInArrow(_cut_batches, f"row {row}, n_bytes long, n_removed long, n_spans long, kept binary, removed array<array<long>>")
    return out.select("row.*", *["n_bytes", "n_removed", "n_spans", "kept", "removed"]).drop("__row")
