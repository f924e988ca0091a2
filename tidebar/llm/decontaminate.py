"""Benchmark decontamination by winnowing.

Documents and benchmark items are words; a fingerprint is the hash of ``k`` words in a row, and of each ``window - k + 1``
neighbouring ones only the least is kept. Every span of ``window`` words that a document shares with an item
then has a kept fingerprint at the same place on both sides. Fingerprints are joined, and each hit is extended to both sides,
word by word, to what is really shared. All steps are DataFrame functions.

Document fingerprints that no item can have are dropped where they are made, by a bitmap of bounded size, so only
likely hits with the few words around them are stored and joined, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, beside, bitmap, in_bitmap, let, stored

WINDOW, GRAM = 10, 5
BITMAP_WORDS = 1 << 14  # 2^20 bits, 128 KB: the bound of what every task gets
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none if it is null."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), GAP), lambda w: w != "")


def _grams(hashes: Column, count: Column, k: int) -> Column:
    at = F.when(count >= k, F.sequence(F.lit(1), count - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(hashes, i, k)))


def _kept(grams: Column, i: Column, window: int, k: int) -> Column:
    """Whether gram ``i`` is the least in one of the stretches of ``window - k + 1`` grams that hold it."""
    width = window - k + 1
    first, last = F.greatest(i - width + 1, F.lit(1)), F.least(i, F.size(grams) - width + 1)
    return F.exists(F.sequence(first, last), lambda j: F.array_min(F.slice(grams, j, width)) == F.element_at(grams, i))


def _fingerprints(words: Column, hashes: Column, window: int, k: int, possible) -> Column:
    """Kept fingerprints as structs: place, hash, the words that a shared window can reach, and how many are before it."""
    reach = window - k

    def found(grams: Column) -> Column:
        at = F.when(F.size(hashes) >= window, F.sequence(F.lit(1), F.size(grams))).otherwise(F.array().cast("array<int>"))
        kept = F.filter(F.filter(at, lambda i: possible(F.element_at(grams, i))), lambda i: _kept(grams, i, window, k))
        return F.transform(
            kept,
            lambda i: F.struct(
                i.alias("at"), F.element_at(grams, i).alias("gram"),
                F.slice(words, F.greatest(i - reach, F.lit(1)), F.least(i - 1, F.lit(reach)) + k + reach).alias("around"),
                F.least(i - 1, F.lit(reach)).alias("before"),
            ),
        )

    return let(_grams(hashes, F.size(hashes), k), found)


def _whole(words: Column, hashes: Column, lengths: list[int], first: Column, whole: Column, bits: int) -> Column:
    """Places where a short item of one of ``lengths`` words may stand: place, length, hash and words."""
    none = F.array().cast("array<int>")

    def of(n: int) -> Column:
        at = F.when(F.size(hashes) >= n, F.sequence(F.lit(1), F.size(hashes) - n + 1)).otherwise(none)
        likely = F.filter(F.filter(at, lambda i: in_bitmap(first, F.element_at(hashes, i), bits)), lambda i: in_bitmap(whole, F.xxhash64(F.slice(hashes, i, n)), bits))
        return F.transform(likely, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.xxhash64(F.slice(hashes, i, n)).alias("whole"), F.slice(words, i, n).alias("around")))

    return F.concat(*map(of, lengths))


def _same(a: Column, a_from: Column, b: Column, b_from: Column, n: Column) -> Column:
    return F.slice(a, a_from, n) == F.slice(b, b_from, n)


def _extended(hits: DataFrame, window: int, k: int) -> DataFrame:
    """Hits that reach ``window`` shared words, with the first and last of them."""
    a, b, x, y = F.col("around"), F.col("item_around"), F.col("before"), F.col("item_before")
    left = F.size(F.filter(F.sequence(F.lit(0), F.least(x, y)), lambda e: _same(a, x - e + 1, b, y - e + 1, e + k))) - 1
    after = F.least(F.size(a) - x, F.size(b) - y) - k
    right = F.size(F.filter(F.sequence(F.lit(0), after), lambda e: _same(a, x + 1, b, y + 1, e + k))) - 1
    spans = hits.withColumns({"left": left, "right": right}).where((F.col("left") >= 0) & (F.col("left") + F.col("right") + k >= window))
    return spans.select("row_id", (F.col("at") - F.col("left")).alias("lo"), (F.col("at") + k - 1 + F.col("right")).alias("hi"), "items")


def _covered(spans: Column) -> Column:
    """Number of words that sorted spans cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["hi"]).alias("end"),
        (s["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(s["end"], x["lo"] - 1))).alias("n"),
    )
    return F.aggregate(spans, start, step, lambda s: s["n"])


def shared_windows(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, k: int = GRAM, bitmap_words: int = BITMAP_WORDS) -> DataFrame:
    """Columns of ``docs`` but ``text``, with ``n_words``, ``n_hit``, ``items`` and ``contaminated``, one row for each row.

    ``n_hit`` counts words inside any shared window of ``window`` words (a shorter item is one window), and ``items`` holds
    the ids of the items with such windows as sorted text. A null or empty text has no words and no hits; an item
    without words has no windows; items that repeat an id count once; one without an id hits words like any other and is not listed; rows with null or repeated document ids are
    judged one by one; existing columns of the four names are replaced; without items nothing is hit.
    """
    spark, added = docs.sparkSession, {"n_words", "n_hit", "items", "contaminated"}
    item = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words"))
    item = item.where(F.size("words") > 0).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    item = stored(item, "benchmark-words")
    prints = item.where(F.size("words") >= window).select("item", F.explode(_fingerprints(F.col("words"), F.col("hashes"), window, k, lambda g: F.lit(True))).alias("p"))
    prints = stored(
        prints.groupBy("p.gram", F.col("p.around").alias("item_around"), F.col("p.before").alias("item_before")).agg(F.collect_set("item").alias("items")), "benchmark-prints"
    )
    short = item.where(F.size("words") < window).groupBy(F.size("words").alias("n"), F.xxhash64("hashes").alias("whole"), F.col("words").alias("item_around")).agg(
        F.collect_set("item").alias("items")
    )
    short = stored(short.withColumn("first", F.xxhash64(F.element_at("item_around", 1))), "benchmark-short")
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # under ``window``

    carried = [c for c in docs.columns if c not in {text} | added]
    rows = docs.select(F.struct(F.lit(0).alias("__row"), *carried).alias("row"), F.monotonically_increasing_id().alias("row_id"), words_of(F.col(text)).alias("words"))
    rows = beside(rows, bitmap(prints.select("gram"), "gram", bitmap_words).withColumnRenamed("bitmap", "likely"), F.size("words"))
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    columns = {
        "hits": let(hashed, lambda hashes: _fingerprints(F.col("words"), hashes, window, k, lambda g: in_bitmap(F.col("likely"), g, bitmap_words)))
    }
    if lengths:
        for c in ("first", "whole"):
            rows = beside(rows, bitmap(short.select(c), c, bitmap_words).withColumnRenamed("bitmap", c), F.size("words"))
        columns["short_hits"] = let(hashed, lambda hashes: _whole(F.col("words"), hashes, lengths, F.col("first"), F.col("whole"), bitmap_words))
    # The row numbers are fixed once they are stored.
    found = stored(rows.select("row", "row_id", F.size("words").cast("long").alias("n_words"), *[c.alias(n) for n, c in columns.items()]), "winnowed")

    hits = found.where(F.size("hits") > 0).select("row_id", F.explode("hits").alias("h")).select("row_id", "h.*")
    spans = _extended(hits.join(prints, "gram"), window, k)
    if lengths:
        some = found.where(F.size("short_hits") > 0).select("row_id", F.explode("short_hits").alias("h")).select("row_id", "h.*")
        met = some.join(short.drop("first"), ["n", "whole"]).where(F.col("around") == F.col("item_around"))
        spans = spans.unionByName(met.select("row_id", F.col("at").alias("lo"), (F.col("at") + F.col("n") - 1).alias("hi"), "items"))
    judged = spans.groupBy("row_id").agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    ).select("row_id", _covered(F.col("spans")).alias("n_hit"), "items")
    return found.join(judged, "row_id", "left").select(
        "row.*", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    ).drop("__row")
