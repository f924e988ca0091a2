"""Near-duplicate lines by MinHash: signatures, banding, exact verification, distributed union-find.

Lines are compared by the Jaccard similarity of their character shingles. A signature has one hash a bin (one permutation,
empty bins borrowed from others), and bands of it make lines meet: at the threshold a pair is missed about
six times in ten thousand. Lines of a band are first compared with one of them only, the band's hub; once
components are known, bands that still hold several are compared all with all inside tasks, in parts of bounded size, by
matrix products. So a large group of copies costs one comparison a line and band, no pairs are written out, and no link
between components is lost. Every candidate is verified on the texts. Of each component one line stays: the first, by document id and place.

Lines are known by a 64-bit hash of their normalised text. Only the texts of candidates leave their documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, partitions, stored
from .components import components

SHINGLE, THRESHOLD = 8, 0.8
BANDS, ROWS = 14, 4
BITMAP_WORDS = 1 << 17  # 2^23 bits, 1 MB: the bound of what every task gets
BATCH_CHARS = 1 << 21
GROUP_ROWS = 512  # lines of one part of a band; a task compares two parts at most at a time
GROUP_TASK_ROWS = 20_000
SHARED_ROWS = 1 << 20  # band rows that are looked at together
PACKED_ROWS, SLOTS = 128, 16  # band rows that are shuffled as one row at most, and groups of bands for each partition
KNOWN_CHARS = 1 << 20  # of texts whose shingles a task keeps while it compares a group
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACES = "".join(filter(str.isspace, map(chr, range(0x3001))))  # all that Python splits at; the last is U+3000


def normalised(line: str) -> str:
    """Lower case, white space as single spaces; empty for a blank line."""
    return " ".join(line.lower().split())


def blank(text: Column) -> Column:
    """Whether all lines of a text are blank to ``normalised``, whatever Unicode spaces they hold; true for null."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{_SPACES}]")


def shingles(line: str, k: int = SHINGLE) -> set[str]:
    """Character shingles of a normalised line; a shorter line is one shingle."""
    return {line[i:i + k] for i in range(max(1, len(line) - k + 1))}


def shingle_codes(line: str, k: int = SHINGLE) -> set[int | str]:
    """The shingles in a form that is quicker to compare: eight characters of one byte each are a whole number, others stay text."""
    if k != 8 or len(line) < k:
        return shingles(line, k)
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return {x if max(x) > "\xff" else int.from_bytes(x.encode("latin-1"), "little") for x in shingles(line, k)}
    return set(np.ndarray((len(raw) - k + 1,), "<u8", raw, 0, (1,)).tolist())


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def line_keys(lines: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64)


def _shingle_hashes(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Line number and hash of every shingle of normalised, non-blank lines, repeats included."""
    length = np.array([len(x) for x in lines])
    # A line shorter than a shingle is padded to one.
    codes = np.frombuffer("".join([x if len(x) >= k else x.ljust(k, "\0") for x in lines]).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.maximum(length, k)
    h, width, odd = codes.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    while 2 * width <= k:
        h = h[:-width] * odd + h[width:]
        odd, width = odd * odd, 2 * width
    if width < k:
        h = h[:-(k - width)] * odd + h[k - width:]
    inside = np.ones(len(h), bool)
    ends = np.cumsum(length)[:-1]
    for i in range(1, k):
        inside[ends - i] = False  # shingles that would reach into the next line
    return np.repeat(np.arange(len(lines)), length - k + 1), _mixed(h[inside])


def signatures(lines: list[str], bins: int, k: int = SHINGLE) -> np.ndarray:
    """One row of ``bins`` least hashes for each normalised, non-blank line."""
    line, h = _shingle_hashes(lines, k)
    out = np.full(len(lines) * bins, _NONE)
    np.minimum.at(out, line * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64), h)
    out = out.reshape(len(lines), bins)
    empty_row, empty_bin = np.nonzero(out == _NONE)
    full, attempt = out.copy(), 0
    while len(empty_row):
        attempt += 1
        other = (_mixed(empty_bin.astype(np.uint64) * np.uint64(1009) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        found = full[empty_row, other]
        hit = found != _NONE
        out[empty_row[hit], empty_bin[hit]] = found[hit]
        empty_row, empty_bin = empty_row[~hit], empty_bin[~hit]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each signature."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _MIX, (len(signature), 1))
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        key = _mixed(key ^ parts[:, :, r]) + _MIX
    return key


def _by_chars(texts, chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Stretches of texts of about ``chars`` characters, each with the number of its first text."""
    some, first, size = [], 0, 0
    for i, text in enumerate(texts):
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= chars:
            yield first, some
            some, first, size = [], i + 1, 0
    if some:
        yield first, some


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that is not blank: its document, place, key and normalised text."""
    for batch in batches:
        for first, texts in _by_chars(batch.column("text")):
            row, place, lines = [], [], []
            for i, text in enumerate(texts, first):
                for p, raw in enumerate(text.split("\n")):
                    if line := normalised(raw):
                        row.append(i)
                        place.append(p)
                        lines.append(line)
            at = pa.array(row, pa.int64())
            yield pa.record_batch(
                [
                    *(batch.column(c).take(at) for c in ("doc_id", "d1", "d2")), pa.array(place, pa.int32()),
                    pa.array(line_keys(lines).view(np.int64), pa.int64()), pa.array(lines, pa.string()),
                ],
                names=["doc_id", "d1", "d2", "place", "line", "content"],
            )


def _band_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int, k: int) -> Iterator[pa.RecordBatch]:
    """Band keys of each line, once for each stretch of rows."""
    for batch in batches:
        key = batch.column("line").to_numpy()
        for first, texts in _by_chars(batch.column("content")):
            line, at = np.unique(key[first:first + len(texts)], return_index=True)
            band = band_keys(signatures([texts[i] for i in at.tolist()], bands * rows, k), bands, rows)
            yield pa.record_batch([pa.array(band.ravel().view(np.int64)), pa.array(np.repeat(line, bands))], names=["band", "line"])


def _packed(batches: Iterator[pa.RecordBatch], slots: int, rows: int = PACKED_ROWS) -> Iterator[pa.RecordBatch]:
    """Band rows of one slot together, as bytes: a shuffle of them has a row for many. All rows of a band have the same slot."""
    for batch in batches:
        band, line = (batch.column(c).to_numpy() for c in ("band", "line"))
        if not len(band):
            continue
        slot = (_mixed(band.view(np.uint64)) % np.uint64(slots)).astype(np.uint16 if slots <= 1 << 16 else np.uint32)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        size = np.diff(np.append(first, len(slot)))
        parts = -(-size // rows)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(first, parts) + nth * rows
        ends = pa.py_buffer((np.append(at, len(slot)) * 8).astype(np.int32))
        found = [pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(x[order])]) for x in (band, line)]
        yield pa.record_batch([pa.array(slot[at].astype(np.int32)), *found], names=["slot", "bands", "lines"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("bands", "lines"))
            yield pa.record_batch([pa.array(x) for x in found], names=["band", "line"])


class _Bands:
    """Bands met so far in a task: one line of each, and whether that line has been given out. One entry a band, however many lines it has."""

    def __init__(self):
        self.band, self.line, self.out = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def shared(self, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of bands that by now hold more than one line, with the lines that were alone in them before."""
        order = np.argsort(b, kind="stable")
        b, x = b[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        size = np.diff(np.append(first, len(b)))
        own, low, high = b[first], np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        at = np.searchsorted(self.band, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.band)
        known[inside] = self.band[at[inside]] == own[inside]
        k = at[known]
        several = low != high
        several[known] |= self.out[k] | (low[known] != self.line[k]) | (high[known] != self.line[k])
        late = k[several[known] & ~self.out[k]]
        take = np.repeat(several, size)
        rows = np.unique(np.stack([np.concatenate([b[take], self.band[late]]), np.concatenate([x[take], self.line[late]])]), axis=1)
        self.out[k] |= several[known]
        new = ~known
        if new.any():
            place = at[new]
            self.band, self.line, self.out = (np.insert(old, place, more) for old, more in ((self.band, own[new]), (self.line, low[new]), (self.out, several[new])))
        return rows[0], rows[1]


def _shared_bands(batches: Iterator[pa.RecordBatch], rows: int = SHARED_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows whose band holds more than one line; all rows of a band are in one task, in any order. A row can come more than once."""
    met, held, n = _Bands(), [], 0

    def give() -> Iterator[pa.RecordBatch]:
        b, x = met.shared(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("band", "line")))
        if len(b):
            yield pa.record_batch([pa.array(b), pa.array(x)], names=["band", "line"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield from give()
            held, n = [], 0
    if held:
        yield from give()


def _one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each line; rows come sorted by line."""
    last = None
    for batch in batches:
        line = batch.column("line").to_numpy()
        if len(line):
            yield batch.filter(pa.array(np.concatenate([[line[0] != last], line[1:] != line[:-1]])))
            last = line[-1]


def _verified(batches: Iterator[pa.RecordBatch], threshold: float, sets: Callable) -> Iterator[pa.RecordBatch]:
    """Pairs whose texts are similar enough; pairs come sorted by ``a``."""
    last, own = None, set()
    for batch in batches:
        good = []
        for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y")):
            if a != last:
                last, own = a, sets(x.as_py())
            good.append(jaccard(own, sets(y.as_py())) >= threshold)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _pairs_verified(pairs: DataFrame, texts: DataFrame, threshold: float, sets: Callable) -> DataFrame:
    left = texts.select(F.col("line").alias("a"), F.col("content").alias("x"))
    right = texts.select(F.col("line").alias("b"), F.col("content").alias("y"))
    both = pairs.distinct().join(right, "b").join(left, "a").select("a", "b", "x", "y").sortWithinPartitions("a")
    return both.mapInArrow(lambda it: _verified(it, threshold, sets), "a long, b long")


def _similar(lines: list[str], hashes: Callable, threshold: float, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one of ``some`` lines and any line whose shingles are similar enough, by a product of their shingle tables."""
    line, h = hashes(lines)
    order = np.lexsort((h, line))
    line, h = line[order], h[order]
    once = np.concatenate([[True], (line[1:] != line[:-1]) | (h[1:] != h[:-1])])
    line, h = line[once], h[once]
    size = np.bincount(line, minlength=len(lines)).astype(np.float32)
    place = np.full(len(lines), -1)
    place[some] = np.arange(len(some))
    wanted = np.unique(h[place[line] >= 0])
    column = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    known = wanted[column] == h
    line, column = line[known], column[known]
    met = np.bincount(column, minlength=len(wanted)) > 1  # others are in no intersection
    keep = met[column]
    line, column = line[keep], (np.cumsum(met) - 1)[column[keep]]
    both, width = np.zeros((len(some), len(lines)), np.float32), 2048
    by = np.argsort(column, kind="stable")
    line, column = line[by], column[by]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(lines), width), np.float32)
        part[line[a:b], column[a:b] - lo] = 1
        both += part[some] @ part.T
    near = both >= np.float32(threshold) * (size[some][:, None] + size[None, :] - both) - np.float32(1e-3)
    i, j = np.nonzero(near)
    return some[i], j


def _crossed(group: list[tuple[int, int, str]], sets: Callable, hashes: Callable, threshold: float) -> list[tuple[int, int]]:
    """One link for each pair of components that lines of a group unite; candidates are verified on their texts."""
    out, seen, known, held = [], set(), {}, 0
    if len(group) <= 12:
        pairs = combinations(range(len(group)), 2)
    else:
        # Lines of one component need no link: those outside the largest one are compared with all.
        at = np.unique([x[1] for x in group], return_inverse=True)[1]
        apart = np.flatnonzero(at != np.bincount(at).argmax())
        pairs = zip(*(x.tolist() for x in _similar([x[2] for x in group], hashes, threshold, apart)))
    for i, j in pairs:
        (a, ra, x), (b, rb, y) = group[i], group[j]
        pair = (min(ra, rb), max(ra, rb))
        if ra == rb or pair in seen:
            continue
        if held > KNOWN_CHARS:
            known, held = {}, 0
        for n, content in ((i, x), (j, y)):
            if n not in known:
                known[n] = sets(content)
                held += len(content)
        if jaccard(known[i], known[j]) >= threshold:
            seen.add(pair)
            out.append((a, b))
    return out


def _crossed_batches(batches: Iterator[pa.RecordBatch], sets: Callable, hashes: Callable, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between components within each (band, i, j); rows come sorted by these."""
    key, group = None, []

    def close() -> list[tuple[int, int]]:
        return _crossed(group, sets, hashes, threshold) if len({x[1] for x in group}) > 1 else []

    for batch in batches:
        out = []
        for band, i, j, line, root, content in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "line", "root", "content"))):
            if (band, i, j) != key:
                out += close()
                key, group = (band, i, j), []
            group.append((line, root, content))
        if out:
            yield _link_batch(out)
    if out := close():
        yield _link_batch(out)


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])


def similar_lines(lines: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
                  bitmap_words: int = BITMAP_WORDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``node`` and ``root`` of every distinct line that is linked to another one; *lines* is a stored table of ``line`` and ``content``."""
    return linked(lines, lambda it: _band_batches(it, bands, rows, k), partial(shingle_codes, k=k), partial(_shingle_hashes, k=k), threshold, bitmap_words, group_rows)


def linked(lines: DataFrame, made: Callable, sets: Callable, hashes: Callable, threshold: float, bitmap_words: int = BITMAP_WORDS,
           group_rows: int = GROUP_ROWS, sift: Callable | None = None) -> DataFrame:
    """``node`` and ``root`` of the lines that bands bring together and whose shingles are similar enough.

    ``made`` turns batches of ``line`` and ``content`` into batches of ``band`` and ``line``, ``sets`` gives the shingles of a text, ``hashes`` the text number and hash of every shingle of a list of texts; ``sift`` can
    leave out rows of shared bands.
    """
    spark, lines = lines.sparkSession, lines.select("line", "content")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.rdd.getNumPartitions())
    packed = lines.mapInArrow(lambda it: _packed(made(it), n * SLOTS), "slot int, bands binary, lines binary")
    dealt = packed.repartition(n, "slot")
    shared = stored(dealt.mapInArrow(lambda it: _shared_bands(_unpacked(it)), "band long, line long"), "shared-bands")
    shared = stored(sift(shared), "sifted-bands") if sift else shared

    # Texts of the lines that share a band: most others are told apart by a bitmap before anything is shuffled.
    wanted = stored(shared.select("line").distinct(), "candidates")
    likely = lines.where(in_bitmap(bitmap(wanted, "line", bitmap_words).scalar(), F.col("line"), bitmap_words))
    likely = likely.repartition(n, "line").sortWithinPartitions("line").mapInArrow(_one_each, "line long, content string")
    texts = stored(likely.join(wanted, "line", "left_semi"), "candidate-lines")

    # First every line with the hub of its bands: the least line in an order that is the same in all bands.
    mixed = F.struct(F.xxhash64("line").alias("o"), "line")
    hubs = shared.groupBy("band").agg(F.min(mixed)["line"].alias("b"))
    pairs = shared.join(hubs, "band").where("line != b").select(F.least("line", "b").alias("a"), F.greatest("line", "b").alias("b"))
    links = stored(_pairs_verified(pairs, texts, threshold, sets), "line-links")
    found = components(links)

    # Then bands that still hold several components: their lines meet in a task, in parts of bounded size if there are many,
    # and are compared all with all there. Only links leave the task.
    rooted = stored(shared.join(found, F.col("line") == F.col("node"), "left").select("band", "line", F.coalesce("root", "line").alias("root")), "rooted-bands")
    split = rooted.groupBy("band").agg(
        F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.bit_xor(F.xxhash64("line")).alias("h1"),
        F.sum(F.shiftright(F.xxhash64(F.lit("second"), "line"), 24)).alias("h2"),
    ).where("r0 != r1")
    # Of two lines one is the hub: they have been compared. Of bands that hold the same lines one is enough.
    split = split.where("n > 2").groupBy("n", "h1", "h2").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / group_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("line"), "parts").cast("int")
    met = rooted.join(split, "band").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = stored(met.select("band", F.least(part, "other").alias("i"), F.greatest(part, "other").alias("j"), "line", "root"), "split-bands")
    n = partitions(spark, met.count(), GROUP_TASK_ROWS)
    dealt = met.join(texts, "line").repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = stored(dealt.mapInArrow(lambda it: _crossed_batches(it, sets, hashes, threshold), "a long, b long"), "line-links")
    if more.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, count = [], [], []
        for text, drop in zip(batch.column("text"), batch.column("drop")):
            lines, gone = (text.as_py() or "").split("\n"), set(drop.as_py() or ())
            count.append(len(lines))
            removed.append(len(gone))
            kept.append("\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else text.as_py())
        yield pa.record_batch(
            [batch.column("row"), pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64())], names=["row", "kept_text", "n_lines", "n_removed"]
        )


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """All columns of ``docs`` with repeated lines taken out of ``text``, and ``n_lines`` and ``n_removed``.

    Lines end at line feeds. Lines are linked when the shingles of their normalised texts have a Jaccard similarity of at least
    the threshold, and of each component the line of the least ``doc_id`` and place stays (a null id comes last). Blank lines
    always stay and count in ``n_lines``. A null or empty text is one blank line and stays as it is. Rows with the same id and the
    same text are one document and lose the same lines; other rows are separate whatever their ids; existing columns
    ``n_lines`` and ``n_removed`` are replaced; an empty table gives an empty result.
    """
    carried = [c for c in docs.columns if c not in {text, "n_lines", "n_removed"}]
    row = F.struct(F.lit(0).alias("__row"), *carried)
    rows = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"))
    rows = rows.withColumns({"d1": F.xxhash64("doc_id", "text"), "d2": F.xxhash64(F.lit("second"), "text", "doc_id")})  # a document's name: 128 bits of hash
    id_type = rows.schema["doc_id"].dataType.simpleString()
    lines = rows.select("doc_id", "text", "d1", "d2").mapInArrow(_line_batches, f"doc_id {id_type}, d1 long, d2 long, place int, line long, content string")
    lines = stored(lines.dropDuplicates(["d1", "d2", "place"]) if docs.select(doc_id).distinct().count() < docs.count() else lines, "lines")

    found = similar_lines(lines, **how)
    lines = lines.drop("content")
    # Only lines that are not alone are put in order: those met more than once, and those with a link.
    twice = lines.groupBy("line").count().where("count > 1").select("line", F.lit(None).cast("long").alias("root"))
    grouped = twice.unionByName(found.select(F.col("node").alias("line"), "root")).groupBy("line").agg(F.coalesce(F.max("root"), "line").alias("root"))
    grouped = stored(lines.join(grouped, "line").drop("line"), "grouped-lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "d1", "d2", "place")
    stays = grouped.groupBy("root").agg(F.min(place).alias("s")).select("root", F.col("s.d1").alias("s1"), F.col("s.d2").alias("s2"), F.col("s.place").alias("sp"))
    gone = grouped.join(stays, "root").where("not (d1 = s1 and d2 = s2 and place = sp)")
    drop = stored(gone.groupBy("d1", "d2").agg(F.collect_list("place").alias("drop")), "dropped-lines")

    # Documents that surely lose no line are not shuffled to meet what they lose.
    hit = in_bitmap(bitmap(drop, "d1", 1 << 15).scalar(), F.col("d1"), 1 << 15)
    named = drop.select(F.col("d1").alias("x1"), F.col("d2").alias("x2"), "drop")
    met = rows.where(hit).join(named, (F.col("d1") == F.col("x1")) & (F.col("d2") == F.col("x2")), "left").select("row", "text", "drop")
    kind = rows.schema["row"].dataType.simpleString()
    out = met.mapInArrow(_cut, f"row {kind}, kept_text string, n_lines long, n_removed long")
    whole = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    out = out.unionByName(rows.where(~hit).select("row", F.col("text").alias("kept_text"), whole.alias("n_lines"), F.lit(0).cast("long").alias("n_removed")))
    back = [F.col("kept_text").alias(text) if c == text else F.col(f"row.{c}") for c in docs.columns if c not in {"n_lines", "n_removed"}]
    return out.select(*back, "n_lines", "n_removed")
