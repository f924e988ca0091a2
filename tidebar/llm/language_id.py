"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of texts in it. A text is compressed with every
dictionary, block by block so that the dictionary and not the text's own past decides, and the language whose
dictionary gives the fewest bytes wins. Where the runner-up comes too close, the text is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sole_caches

UNDETERMINED = "und"
SAMPLE_ROWS = 256  # labelled texts a language that dictionaries are made of: the bound of what the driver gets
SAMPLE_CHARS = 2000  # of each of them
DICTIONARY_BYTES = 1 << 15  # of a dictionary, shared evenly among its texts
MAX_LANGUAGES = 512
BLOCK_BYTES = 2048
MARGIN = 0.005  # of the best size
LETTER = r"\p{L}"


def dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """A dictionary for each non-null language, from ``sample_rows`` distinct texts with a letter, chosen by hash.

    Languages come in the order of how many labelled rows they have. The sample is a fixed number of texts a language, so it has the
    same size for any corpus. Texts are shortened only here, as learning material: each to an even share of ``DICTIONARY_BYTES``
    (and to ``SAMPLE_CHARS`` on its way to the driver). More than ``MAX_LANGUAGES`` different languages are refused: labels are then no languages.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("order", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("order")
    # Narrow rows first: the limit on the rank is taken in every task before anything is shuffled.
    texts_of = rows.groupBy("lang", "order").count()
    picked = texts_of.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_rows)
    cut = picked.groupBy("lang").agg(F.max("order").alias("last")).limit(MAX_LANGUAGES + 1).collect()
    common = {r["lang"]: r["n"] for r in texts_of.groupBy("lang").agg(F.sum("count").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(cut) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not cut:
        return {}
    last = F.create_map(*[F.lit(v) for r in cut for v in (r["lang"], r["last"])])
    sample = rows.where(F.col("order") <= last[F.col("lang")]).groupBy("lang", "order").agg(F.substring(F.min("text"), 1, SAMPLE_CHARS).alias("text"))
    texts: dict[str, list[tuple[int, str]]] = {k: [] for k in sorted(common, key=lambda k: (-common[k], k))}
    for r in sample.collect():  # sample_rows texts a language
        texts[r["lang"]].append((r["order"], r["text"]))
    return {k: excerpts([t for _, t in sorted(v)], DICTIONARY_BYTES) for k, v in texts.items()}


def excerpts(texts: list[str], size: int) -> bytes:
    """The beginnings of all texts, each with the same share of ``size`` bytes; what short texts leave goes to longer ones."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    taken, left = dict.fromkeys(range(len(raw)), 0), max(0, size - len(raw))  # a line feed after each
    for n, i in enumerate(sorted(taken, key=lambda i: len(raw[i]))):
        taken[i] = min(len(raw[i]), left // (len(raw) - n))
        left -= taken[i]
    return b"\n".join(raw[i][:n] for i, n in taken.items())


class Compressors:
    """One compressor a language."""

    def __init__(self, content: tuple[tuple[str, bytes], ...], level: int = 3):
        import zstandard as z

        self.langs = [k for k, _ in content]
        self.each = []
        for _, data in content:
            given = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            how = z.ZstdCompressionParameters.from_level(
                level, dict_size=len(data), source_size=BLOCK_BYTES, min_match=3, strategy=z.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0
            )
            given.precompute_compress(compression_params=how)
            self.each.append(z.ZstdCompressor(dict_data=given, compression_params=how))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text under each dictionary."""
        raw = text.lower().encode("utf-8", "surrogatepass")
        blocks = [raw[i:i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.each]

    def classify(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        if not self.langs or not text or not any(ch.isalpha() for ch in text):
            return UNDETERMINED, 0.0, True
        size = self.sizes(text)
        best = size.index(min(size))
        rest = sorted(s for i, s in enumerate(size) if i != best)
        score = 1 / (1 + sum(math.exp(min(0, size[best] - s)) for s in rest))
        return self.langs[best], score, bool(rest) and rest[0] - size[best] < margin * size[best]


@lru_cache(maxsize=2)
def _compressors(content: tuple[tuple[str, bytes], ...]) -> Compressors:
    return Compressors(content)


def _predict(batches: Iterator[pa.RecordBatch], content, margin: float) -> Iterator[pa.RecordBatch]:
    model = _compressors(content)
    for batch in batches:
        found = [model.classify(t.as_py(), margin) for t in batch.column("text")]
        lang, score, rejected = zip(*found) if found else ((), (), ())
        yield pa.record_batch(
            [batch.column("row"), batch.column("text"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["row", "text", "lang_pred", "score", "rejected"],
        )


def identify(docs: DataFrame, known: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to every row; only ``text`` is looked at.

    ``score`` is the weight of the winner when each language counts e to the minus its bytes. A null text, one without a
    letter, and every text where nothing was learned get ``und``, score 0 and are rejected. Equal sizes go to the language
    with more labelled texts and are rejected. Rows are independent; existing columns of the three names are replaced.
    """
    added = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c not in added]
    others = [c for c in kept if c != text]  # a text goes to Python and back once, beside the row
    rows = docs.select(F.struct(F.lit(0).alias("__row"), *others).alias("row"), F.col(text).cast("string").alias("text"))
    row, content = rows.schema["row"].dataType.simpleString(), tuple(known.items())
    shared = docs.sparkSession.sparkContext.broadcast(content)  # MAX_LANGUAGES dictionaries at most
    out = rows.mapInArrow(lambda it: sole_caches(_predict(it, shared.value, margin)), f"row {row}, text string, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept], *added)
