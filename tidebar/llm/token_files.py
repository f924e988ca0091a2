"""Token-id files: flat unsigned ids with 64-bit document offsets, memory-mapped on reading.

A data set is a folder of shards in ascending document order. A shard has three flat little-endian files:
``<name>.ids`` (unsigned 16-bit ids if the vocabulary fits, else 32-bit), ``<name>.off`` (one unsigned 64-bit
offset a document, and the end) and ``<name>.doc`` (document ids as signed 64-bit). Each task writes one shard under a
name of its own attempt; only the shards in the returned manifest count, so a task that is lost or
runs twice does no harm. The place of a shard in the whole sequence is the prefix sum of the ids before it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, sole_caches, stored
from .tokens import default_tokenizer, word_ids

MANIFEST = "shard int, name string, n_docs long, n_ids long, width int"
NO_ID = -(1 << 63)  # stands for a null document id


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(rows: Iterator[pd.DataFrame], folder: str, tokenizer: str, end_id: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    cache, shard = word_ids(tokenizer), TaskContext.get().partitionId()
    kind = "<u2" if max(cache.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    end, name = np.array([end_id], "<u4").tobytes(), f"{shard:06d}-{uuid.uuid4().hex}"
    system, root = _files(folder)
    system.create_dir(root, recursive=True)
    n_docs = n_ids = 0
    with (
        system.open_output_stream(f"{root}/{name}.ids") as ids_out, system.open_output_stream(f"{root}/{name}.off") as off_out,
        system.open_output_stream(f"{root}/{name}.doc") as doc_out,
    ):
        for frame in rows:
            offsets = np.empty(len(frame), "<u8")
            for i, found in enumerate(cache.encode_all(frame["text"])):
                ids = np.frombuffer(found + end, "<u4")
                offsets[i] = n_ids
                n_ids += len(ids)
                ids_out.write(ids.astype(kind).tobytes())
            off_out.write(offsets.tobytes())
            doc_out.write(frame["doc_id"].to_numpy("<i8").tobytes())
            n_docs += len(frame)
        off_out.write(np.array([n_ids], "<u8").tobytes())
    yield pd.DataFrame({"shard": [shard], "name": [name], "n_docs": [n_docs], "n_ids": [n_ids], "width": [np.dtype(kind).itemsize]})


def write_token_files(docs: DataFrame, folder: str, end_id: int, tokenizer: str | None = None, shards: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write shards in ascending ``doc_id`` order and return the manifest.

    A null text is empty and holds the end id alone. Rows with a null ``doc_id`` come first; rows that repeat a
    ``doc_id`` are documents of their own, in the order of their texts. An empty table gives a manifest without documents.
    The manifest has ``base``, the ids of all shards before, by prefix sums over one row a shard.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = stored(ordered.mapInPandas(lambda it: sole_caches(_write(it, folder, tokenizer, end_id), word_ids(tokenizer)), MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))  # one row a shard


def _flat(system, path: str, kind: str, local: bool) -> np.ndarray:
    """A flat file as an array: memory-mapped on a mounted folder, through the store's reader elsewhere."""
    if system.get_file_info(path).size == 0:
        return np.empty(0, kind)
    if local:
        return np.memmap(path, kind, "r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def _read(rows: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    system, root = _files(folder)
    local = isinstance(system, fs.LocalFileSystem)
    for frame in rows:
        for shard in frame.itertuples(index=False):
            ids = _flat(system, f"{root}/{shard.name}.ids", f"<u{shard.width}", local)
            off = _flat(system, f"{root}/{shard.name}.off", "<u8", local)
            doc = _flat(system, f"{root}/{shard.name}.doc", "<i8", local)
            for lo in range(0, len(doc), 10_000):
                hi = min(lo + 10_000, len(doc))
                crc = [zlib.crc32(ids[off[i]:off[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                yield pd.DataFrame(
                    {"doc_id": doc[lo:hi], "start": off[lo:hi].astype("i8") + shard.base, "n_tokens": np.diff(off[lo:hi + 1]).astype("i8"), "ids_crc32": crc}
                )


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Place, length and checksum of every document, read back from the files, one task a shard."""
    shards = manifest.repartition(max(1, manifest.count()), "shard")
    out = shards.mapInPandas(lambda it: _read(it, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def token_files(docs: DataFrame, end_id: int, tokenizer: str | None = None) -> tuple[DataFrame, str]:
    """Write to a new folder of the shared store; returns the manifest and the folder."""
    folder = scratch(docs.sparkSession, "token-files")
    return write_token_files(docs, folder, end_id, tokenizer), folder
