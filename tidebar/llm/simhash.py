"""SimHash near-duplicates through vantage points.

Fingerprints are placed in a tree by Hamming distance to vantage points. Each level looks at its own block of the 64
bits and has its own vantage point; a branch is a distance. By the triangle inequality two
fingerprints at distance d differ by at most d in their distances to a vantage point, and as the levels' blocks do not
overlap, the differences on all levels add up to at most d. So a fingerprint is compared with its own leaf and asked of just
those leaves whose distances differ by ``radius`` in total: the leaves that its ball overlaps. Leaves are
the shards; deeper trees, chosen by the number of fingerprints, keep them small. All links are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .components import components

SEED, RADIUS, WORDS = 42, 3, 3
LEAF_ROWS = 4096  # fingerprints of a leaf that one group holds; fuller leaves are split
QUERY_ROWS = 1 << 18  # about the rows of a matching task
#: Bits of the vantage points.
VANTAGE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash over word shingles, repeats included; zero without a word."""
    from xxhash import xxh64_intdigest

    found = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not found:
        return 0
    joined, at, cuts = b" ".join(found), 0, []
    for w in found:
        cuts.append(at)
        at += len(w) + 1
    cuts.append(at)
    n = max(1, len(found) - words + 1)
    size = min(words, len(found))
    hashes = np.array([xxh64_intdigest(joined[cuts[i]:cuts[i + size] - 1], SEED) for i in range(n)], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[lo:lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column("row"), pa.array(found)], names=["row", "fingerprint"])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """All columns but ``text``, and ``fingerprint`` (signed 64-bit)."""
    others = [c for c in docs.columns if c not in {text, "fingerprint"}]
    rows = docs.select(F.struct(F.lit(0).alias("__row"), *others).alias("row"), F.col(text).cast("string").alias("text"))
    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _fingerprints(it, words), f"row {row}, fingerprint long").select("row.*", "fingerprint").drop("__row")


def levels_for(rows: int) -> int:
    """Levels of the tree: two, and one more for every sixteenfold over 2^16 fingerprints."""
    return min(8, 2 + max(0, (max(rows, 1).bit_length() - 13) // 4))


def _blocks(levels: int) -> list[int]:
    cuts = [64 * i // levels for i in range(levels + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _leaf(fingerprint, levels: int):
    """The leaf as one number, eight bits a level: distance to its vantage point, plus a bias that keeps neighbours positive."""
    away = fingerprint.bitwiseXOR(F.lit(_signed(VANTAGE)))
    parts = [F.shiftleft((F.bit_count(away.bitwiseAND(F.lit(_signed(m)))) + 8).cast("long"), 8 * i) for i, m in enumerate(_blocks(levels))]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _overlapped(levels: int, radius: int) -> list[int]:
    """Steps to the leaves that a ball may overlap, half of them: of two leaves only one asks the other."""
    steps = (d for d in product(range(-radius, radius + 1), repeat=levels) if 0 < sum(map(abs, d)) <= radius)
    return [sum(x << (8 * i) for i, x in enumerate(d)) for d in steps if d > (0,) * levels]


class _Group:
    """Fingerprints of one leaf (or a part of it), and what is linked among them."""

    def __init__(self, key: tuple[int, int], radius: int):
        self.key, self.radius, self.parts, self.own = key, radius, [], None

    def close(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """No more own rows: link them with each other."""
        self.own = np.unique(np.concatenate(self.parts)) if self.parts else np.empty(0, np.uint64)
        self.label = np.arange(len(self.own))
        return self.ask(self.own, inside=True)

    def ask(self, queries: np.ndarray, inside: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links that unite all that is within ``radius``: one for each query with a match, and a forest of own rows."""
        out, own = [], self.own
        if not len(own):
            return out
        step = max(1, (1 << 18) // len(own))
        for lo in range(0, len(queries), step):
            some = queries[lo:lo + step]
            row, col = np.nonzero(np.bitwise_count(some[:, None] ^ own[None, :]) <= self.radius)
            if not len(row) or inside and len(row) == len(some):
                continue
            first = np.concatenate([[True], row[1:] != row[:-1]])
            if not inside:
                out.append((some[row[first]], own[col[first]]))
            near = np.unique(col[:-1][~first[1:]] * len(own) + col[1:][~first[1:]])
            a, b = near // len(own), near % len(own)
            apart = self.label[a] != self.label[b]
            joined = [(x, y) for x, y in zip(a[apart].tolist(), b[apart].tolist()) if self._unite(x, y)]
            if joined:
                x, y = np.array(joined).T
                out.append((own[x], own[y]))
                while (up := self.label[self.label] != self.label).any():
                    self.label = np.where(up, self.label[self.label], self.label)
        return out

    def _unite(self, x: int, y: int) -> bool:
        while self.label[x] != x:
            x = self.label[x]
        while self.label[y] != y:
            y = self.label[y]
        self.label[max(x, y)] = min(x, y)
        return x != y


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within each (leaf, part), whose own rows come before the queries; rows are sorted so."""
    group = None
    for batch in batches:
        leaf, part, asks = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("leaf", "part", "asks"))
        value = batch.column("fingerprint").to_numpy().view(np.uint64)
        new = (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])
        cuts, found = [0, *(np.flatnonzero(new) + 1), len(leaf)] if len(leaf) else [], []
        for lo, hi in zip(cuts, cuts[1:]):
            key = (int(leaf[lo]), int(part[lo]))
            if group is None or group.key != key:
                found += group.close() if group and group.own is None else []
                group = _Group(key, radius)
            if not asks[lo]:
                group.parts.append(value[lo:hi])
                continue
            found += group.close() if group.own is None else []
            found += group.ask(value[lo:hi])
        if found:
            yield _edges(found)
    if group and group.own is None and (found := group.close()):
        yield _edges(found)


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
    return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, levels: int | None = None, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints within ``radius`` of each other; ``distinct`` has no repeats."""
    spark, rows = distinct.sparkSession, distinct.count()
    levels = levels or levels_for(rows)
    own = distinct.select("fingerprint", _leaf(F.col("fingerprint"), levels).alias("leaf"))
    steps = _overlapped(levels, radius)
    asked = own.select("fingerprint", F.explode(F.array(*[F.lit(0), *map(F.lit, steps)]).cast("array<long>")).alias("step"), "leaf")
    both = asked.select("fingerprint", (F.col("leaf") + F.col("step")).alias("leaf"), (F.col("step") != 0).alias("asks"))

    # Fuller leaves are dealt to several groups: own rows by hash, queries to each of them.
    full = stored(own.groupBy("leaf").count().where(F.col("count") > leaf_rows).select("leaf", F.ceil(F.col("count") / leaf_rows).cast("int").alias("parts")), "full-leaves")
    n_full = full.count()
    if n_full:
        both = both.join(F.broadcast(full) if n_full <= 1 << 16 else full, "leaf", "left")
        spread = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1))
        # Own rows of a split leaf ask the parts after theirs.
        mine = F.pmod(F.xxhash64("fingerprint"), "parts").cast("int")
        kept = both.withColumn("part", F.explode(F.coalesce(spread, F.array(mine)))).select("fingerprint", "leaf", "asks", "part")
        after = both.where(~F.col("asks") & F.col("parts").isNotNull()).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = kept.unionByName(after.where(F.col("part") > mine).select("fingerprint", "leaf", F.lit(True).alias("asks"), "part"))
    else:
        both = both.withColumn("part", F.lit(0))
    n = partitions(spark, rows * (1 + len(steps)), QUERY_ROWS)
    dealt = both.repartition(n, "leaf", "part").sortWithinPartitions("leaf", "part", "asks")
    return dealt.mapInArrow(lambda it: _links(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """All columns but ``text``, with ``fingerprint`` (signed 64-bit), ``group`` and ``component_id``, one row for each row.

    Fingerprints at ``radius`` or fewer differing bits are linked; ``group`` is the least fingerprint that links reach and
    ``component_id`` the least ``doc_id``, the row's own included. Texts without a word (null, empty, white space) have
    fingerprint zero and are linked like any other. Rows without a ``doc_id`` are linked but never name a component (its id is
    null if none of its rows has one); rows that repeat a ``doc_id`` are separate rows, of one component if their texts are
    near; existing columns of the three names are replaced; an empty table gives an empty result.
    """
    carried = [c for c in docs.columns if c not in {text, "fingerprint", "group", "component_id"}]
    rows = docs.select(F.struct(F.lit(0).alias("__row"), *carried).alias("doc"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = stored(fingerprints(rows, "text", words), "fingerprints")
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found = components(links(distinct.select("fingerprint"), radius))
    rooted = distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fingerprint").alias("shared"), F.col("root").alias("group"), "component_id")
    return rows.join(named, F.col("fingerprint") == F.col("shared")).select("doc.*", "fingerprint", "group", "component_id").drop("__row")
