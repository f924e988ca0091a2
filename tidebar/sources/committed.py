"""A bar store with a log: data folders become visible by one atomic rename, and coverage is read from the log alone.

    data/commit=<name>/schema=<s>/venue=<v>/part-*.parquet     bars, in the layout of :func:`bars.write_bars`
    log/<version>/part-*.parquet                               one row for each series of a commit: span, rows, decimals, batch

A commit is written to a folder that no reader knows, then its log rows are written aside and renamed to the next version. A writer that stops
in between leaves a folder that nothing refers to; the next try writes another one, so nothing is lost and nothing comes twice. A
batch that carries a name is looked up in the log first, so a replayed one adds nothing. Two writers cannot take the same version: the
second one's rename fails. Readers pick data folders by the spans in the log; one row a commit reaches the driver, and :func:`compact` makes one
commit of many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BARS
from . import bars as store
from .bars import OHLC, SERIES

LOG = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("commit", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("whole", T.BooleanType()),
    *[T.StructField(c, T.StringType()) for c in SERIES], T.StructField("first", T.TimestampType()), T.StructField("last", T.TimestampType()),
    T.StructField("bars", T.LongType()), T.StructField("precision", T.IntegerType()),
])


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def _publish(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, or fail if the target is there."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(a), context.makeQualified(b), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all commits that count: those since the last compaction."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], LOG)
    log = spark.read.schema(LOG).parquet(*[f"{path}/log/{v:020d}" for v in versions])
    since = log.agg(F.coalesce(F.max(F.when(F.col("whole"), F.col("version"))), F.lit(-1))).scalar()
    return log.where(F.col("version") >= since)


def coverage(log: DataFrame) -> DataFrame:
    """First and last close, number of bars and decimals of every stored series, from the log."""
    return log.groupBy(*SERIES).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("bars").alias("bars"), F.max_by("precision", "version").alias("precision")
    )


def coverage_gaps(wanted: DataFrame, log: DataFrame, head_days: int = 5) -> DataFrame:
    """:func:`bars.coverage_gaps` without a look at the bars."""
    ends = coverage(log).select(*SERIES, F.explode(F.array("first", "last")).alias("ts_init"))
    return store.coverage_gaps(wanted, ends, head_days=head_days)


def known_batches(log_of_all: DataFrame, batch: str) -> bool:
    return not log_of_all.where(F.col("batch") == batch).isEmpty()


def _conformed(new: DataFrame, known: DataFrame) -> DataFrame:
    """Bars with the decimals of their series: those stored, else the fewest that represent them. A lossy change fails the job."""
    fitting = store.infer_price_precision(new, SERIES).withColumnRenamed("precision", "__new")
    decided = fitting.join(known.select(*SERIES, "precision"), SERIES, "left")
    return store.conform_precision(new, decided.select(*SERIES, F.coalesce("precision", "__new").alias("precision")))


def _write(bars: DataFrame, path: str) -> str:
    """Write a data folder that no reader knows of yet; its name."""
    commit = uuid.uuid4().hex
    store.write_bars(bars, f"{path}/data/commit={commit}")
    return commit


def _commit(spark: SparkSession, path: str, commit: str, batch: str | None, version: int, whole: bool = False) -> None:
    """Log a data folder. The spans are those of the files as written."""
    written = spark.read.schema(BARS).parquet(f"{path}/data/commit={commit}")
    rows = written.groupBy(*SERIES).agg(F.min("ts_init").alias("first"), F.max("ts_init").alias("last"), F.count("*").alias("bars"))
    rows = rows.join(store.infer_price_precision(written, SERIES), SERIES)
    marks = {"version": F.lit(version).cast("long"), "commit": F.lit(commit), "batch": F.lit(batch).cast("string"), "whole": F.lit(whole)}
    # A batch without new bars is logged too, by a row without a series.
    empty = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    rows = rows.unionByName(empty.where(F.lit(rows.isEmpty())))
    aside = f"{path}/aside/{uuid.uuid4().hex}"
    rows.withColumns(marks).select(*LOG.fieldNames()).write.parquet(aside)
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log"))
    _publish(spark, aside, f"{path}/log/{version:020d}")


def append(new: DataFrame, path: str, batch: str | None = None) -> bool:
    """Commit what *new* adds to either end of each series, at the series' decimals; false if *batch* was committed before.

    No stored bar is read. Bars between the first and last of a series are taken as known.
    """
    spark = new.sparkSession
    versions = _versions(spark, path)
    log = read_log(spark, path).where(F.col("symbol").isNotNull())
    if batch is not None and versions and known_batches(spark.read.schema(LOG).parquet(*[f"{path}/log/{v:020d}" for v in versions]), batch):
        return False
    known = coverage(log)
    ends = known.select(*SERIES, F.explode(F.array("first", "last")).alias("ts_init"))
    fresh = _conformed(store.outside_coverage(new, ends), known)
    _commit(spark, path, _write(fresh, path), batch, versions[-1] + 1 if versions else 0)
    return True


def read(spark: SparkSession, path: str, symbol: str | None = None, schema: str | None = None, venue: str | None = None, start=None, end=None) -> DataFrame:
    """Committed bars with double prices; bounds are inclusive and on the close. Commits outside them are not listed."""
    log = read_log(spark, path).where(F.col("symbol").isNotNull())
    for column, value in (("schema", schema), ("venue", venue), ("symbol", symbol)):
        if value is not None:
            log = log.where(F.col(column) == value)
    if start is not None:
        log = log.where(F.col("last") >= F.lit(start))
    if end is not None:
        log = log.where(F.col("first") <= F.lit(end))
    commits = [r["commit"] for r in log.select("commit").distinct().collect()]  # compact() bounds them
    if not commits:
        return spark.createDataFrame([], BARS).withColumns({c: F.col(c).cast("double") for c in [*OHLC, "volume"]})
    parts = spark.read.schema(BARS).option("basePath", f"{path}/data").parquet(*[f"{path}/data/commit={c}" for c in sorted(commits)])
    for column, value in (("schema", schema), ("venue", venue), ("symbol", symbol)):
        if value is not None:
            parts = parts.where(F.col(column) == value)
    if start is not None:
        parts = parts.where(F.col("ts_init") >= F.lit(start))
    if end is not None:
        parts = parts.where(F.col("ts_init") <= F.lit(end))
    return parts.select(*[F.col(c).cast("double") if c in (*OHLC, "volume") else F.col(c) for c in BARS.fieldNames()])


def compact(spark: SparkSession, path: str) -> None:
    """Make one commit of all. Readers see the old ones or the new one; the old folders stay until :func:`vacuum`."""
    versions = _versions(spark, path)
    log = read_log(spark, path).where(F.col("symbol").isNotNull())
    commits = [r["commit"] for r in log.select("commit").distinct().collect()]
    if not commits:
        return
    whole = spark.read.schema(BARS).option("basePath", f"{path}/data").parquet(*[f"{path}/data/commit={c}" for c in commits])
    _commit(spark, path, _write(whole, path), None, versions[-1] + 1, whole=True)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete data folders that no counting commit names, and rows set aside; only while nothing is written. Names what went."""
    used = {r["commit"] for r in read_log(spark, path).select("commit").distinct().collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in system.listStatus(folder)] if system.exists(folder) else []
    gone = [p for p in found if p.getName().removeprefix("commit=") not in used]
    for p in [*gone, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/aside")]:
        system.delete(p, True)
    return sorted(p.getName() for p in gone)
