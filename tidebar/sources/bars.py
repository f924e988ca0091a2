"""Reading, normalising, appending and reconciling stored bar series.

Bars are stored as Parquet under ``schema=/venue=`` directories, sorted by symbol
and close inside files: pruning by directory, skipping by row group, and no
per-symbol directories (thousands of tiny files).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import keep_latest
from ..schema import BARS, PRICE, STEP_SECONDS

SERIES = ["symbol", "venue", "schema"]
OHLC = ["open", "high", "low", "close"]


# -- scans --------------------------------------------------------------------


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, schema: str | None = None,
              venue: str | None = None, start=None, end=None) -> DataFrame:
    """Stored bars with double prices; bounds are inclusive and on the close."""
    bars = spark.read.schema(BARS).parquet(path)
    for column, value in (("schema", schema), ("venue", venue), ("symbol", symbol)):
        if value is not None:
            bars = bars.where(F.col(column) == value)
    if start is not None:
        bars = bars.where(F.col("ts_init") >= F.lit(start))
    if end is not None:
        bars = bars.where(F.col("ts_init") <= F.lit(end))
    return bars.withColumns({c: F.col(c).cast("double") for c in [*OHLC, "volume"]})


def list_series(bars: DataFrame, schema: str) -> DataFrame:
    return bars.where(F.col("schema") == schema).select("symbol", "venue").distinct().orderBy("symbol", "venue")


def resolve_venues(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """Venue of every wanted symbol with a status: ``ok``, ``not_found`` or ``ambiguous``."""
    stored = bars.select("symbol", "venue").distinct().groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("venue").alias("venue")
    )
    status = F.when(F.col("n").isNull(), F.lit("not_found")).when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit("ok"))
    joined = wanted.select("symbol").distinct().join(stored, "symbol", "left").withColumn("status", status)
    return joined.select("symbol", F.when(F.col("status") == "ok", F.col("venue")).alias("venue"), "status")


def resolve_venue(bars: DataFrame, symbol: str) -> str:
    """The one venue a symbol is stored at."""
    found = [r["venue"] for r in bars.where(F.col("symbol") == symbol).select("venue").distinct().limit(2).collect()]
    if not found:
        raise LookupError(f"no bars for {symbol}")
    if len(found) > 1:
        raise LookupError(f"{symbol} is stored at several venues, name one")
    return found[0]


def coverage_report(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*SERIES).agg(
        F.min("ts_init").alias("first"), F.max("ts_init").alias("last"), F.count(F.lit(1)).alias("bars")
    )


# -- precision and normalisation ------------------------------------------------


def infer_price_precision(bars: DataFrame, keys: list[str], columns: list[str] = OHLC, highest: int = 9) -> DataFrame:
    """Fewest decimals (at most *highest*) that represent every price, per key."""
    def gap(p: int) -> Column:
        scaled = [F.abs(F.col(c) * 10.0**p - F.rint(F.col(c) * 10.0**p)) for c in columns]
        return F.max(F.greatest(*scaled) if len(scaled) > 1 else scaled[0])

    gaps = bars.groupBy(*keys).agg(*[gap(p).alias(f"g{p}") for p in range(highest + 1)])
    found = F.coalesce(*[F.when(F.col(f"g{p}") < 1e-6, F.lit(p)) for p in range(highest + 1)], F.lit(highest))
    return gaps.select(*keys, found.alias("precision"))


def exact_decimal(x: Column, precision: Column) -> Column:
    """Half-even rounding to *precision* decimals, held exactly."""
    units = F.rint(x * F.pow(F.lit(10.0), precision)).cast("long").cast("decimal(38,16)")
    table = F.element_at(F.array(*[F.lit(10**p).cast("decimal(11,0)") for p in range(10)]), precision.cast("int") + 1)
    return (units / table).cast(PRICE)


def normalize_bars(raw: DataFrame, schema: str, precision: Column) -> DataFrame:
    """Provider rows stamped at the open become bars stamped at the close."""
    step = STEP_SECONDS[schema]
    out = raw.withColumn("schema", F.lit(schema)).withColumn("ts_init", F.col("ts_event") + F.expr(f"INTERVAL {step} SECONDS"))
    out = out.withColumns({c: exact_decimal(F.col(c), precision) for c in OHLC})
    return out.withColumn("volume", F.col("volume").cast(PRICE))


def rekey_bars(raw: DataFrame, instrument_id: str, seconds: int) -> DataFrame:
    """One instrument's bars with defined prices; opens derived from closes where needed."""
    whole = F.lit(True)
    for c in OHLC:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    late = F.col("ts_event") >= F.col("ts_init")
    opened = F.when(late, F.col("ts_init") - F.expr(f"INTERVAL {seconds} SECONDS")).otherwise(F.col("ts_event"))
    return raw.where(whole & (F.col("instrument_id") == instrument_id)).withColumn("ts_event", opened)


def conform_precision(bars: DataFrame, precision: DataFrame) -> DataFrame:
    """Re-express prices at their series' precision; a lossy change fails the job."""
    keys = [c for c in precision.columns if c != "precision"]
    joined = bars.join(precision, keys)
    q = {c: exact_decimal(F.col(c), F.col("precision")) for c in OHLC}
    lossless = F.lit(True)
    for c in OHLC:
        lossless = lossless & (q[c] == F.col(c).cast(PRICE))
    checked = F.when(lossless, F.lit(True)).otherwise(
        F.raise_error(F.lit("bars cannot be expressed at the stored precision")).cast("boolean")
    )
    return joined.where(checked).withColumns(q).drop("precision")


def lossy_rows(bars: DataFrame, precision: DataFrame) -> DataFrame:
    """Rows whose close needs more decimals than their series has."""
    keys = [c for c in precision.columns if c != "precision"]
    scaled = F.col("close") * F.pow(F.lit(10.0), F.col("precision"))
    return bars.join(precision, keys).where(F.abs(scaled - F.rint(scaled)) >= 1e-6).drop("precision")


def stored_precision(meta: DataFrame) -> DataFrame:
    """Precision of the newest file of each series."""
    return meta.groupBy(*SERIES).agg(
        F.max_by("price_precision", "ts_init").alias("price_precision"), F.max_by("size_precision", "ts_init").alias("size_precision")
    )


# -- coverage and append --------------------------------------------------------


def outside_coverage(new: DataFrame, stored: DataFrame, keys: list[str] = SERIES, order: str = "ts_init") -> DataFrame:
    """What a store lacks at either end of each series; rows between its first and last are taken as known."""
    cover = stored.groupBy(*keys).agg(F.min(order).alias("__f"), F.max(order).alias("__l"))
    fresh = F.col("__f").isNull() | (F.col(order) < F.col("__f")) | (F.col(order) > F.col("__l"))
    return new.join(cover, keys, "left").where(fresh).drop("__f", "__l")


def append_bars(new: DataFrame, path: str) -> None:
    """Append the uncovered part of *new* to the store at *path*.

    Only the partitions that the new rows fall into are read for coverage; there are few schemas and venues.
    """
    if exists(new.sparkSession, path):
        parts = new.select("schema", "venue").distinct().collect()
        inside = F.lit(False)
        for p in parts:
            inside |= F.col("schema").eqNullSafe(p["schema"]) & F.col("venue").eqNullSafe(p["venue"])
        new = outside_coverage(new, new.sparkSession.read.schema(BARS).parquet(path).where(inside))
    write_bars(new, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store's folder is there, asked of the file system it lives on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    laid_out = bars.select(*BARS.fieldNames()).repartitionByRange("schema", "venue", "symbol", "ts_init")
    (
        laid_out.sortWithinPartitions("schema", "venue", "symbol", "ts_init")
        .write.mode(mode).partitionBy("schema", "venue").parquet(path)
    )


def coverage_gaps(wanted: DataFrame, stored: DataFrame, keys: list[str] = SERIES, head_days: int = 5, order: str = "ts_init",
                  tail_micros: int = 0) -> DataFrame:
    """Missing ranges of ``keys, start, end`` requests: before the first and after the last row.

    A head gap of at most *head_days* is ignored. Bars resume at the last close; ticks
    one microsecond later (*tail_micros* = 1).
    """
    cover = stored.groupBy(*keys).agg(F.min(order).alias("f"), F.max(order).alias("l"))
    joined = wanted.join(cover, keys, "left")
    gap = lambda a, b, kind: F.struct(a.alias("gap_start"), b.alias("gap_end"), F.lit(kind).alias("kind"))
    tail = F.timestamp_micros(F.unix_micros("l") + tail_micros)
    late_head = F.col("f") - F.expr(f"INTERVAL {head_days} DAYS") > F.col("start")
    parts = F.array(
        F.when(F.col("f").isNull(), gap(F.col("start"), F.col("end"), "all")),
        F.when(late_head, gap(F.col("start"), F.least("f", "end"), "head")),
        F.when(tail < F.col("end"), gap(F.greatest(tail, F.col("start")), F.col("end"), "tail")),
    )
    out = joined.withColumn("g", F.explode(F.array_compact(parts))).select(*keys, "g.*")
    return out.where("gap_start < gap_end")


def parent_coverage(bars: DataFrame, instruments: DataFrame) -> DataFrame:
    """First and last close over all outrights of a root."""
    known = instruments.select(F.col("raw_symbol").alias("symbol"), "underlying")
    return bars.join(known, "symbol").groupBy("underlying").agg(F.min("ts_init").alias("first"), F.max("ts_init").alias("last"))


def split_parent_bars(bars: DataFrame, outrights: DataFrame) -> DataFrame:
    """A parent request's bars of known outrights only."""
    return bars.join(outrights.select("instrument_id").distinct(), "instrument_id", "left_semi")


def dropped_parent_bars(bars: DataFrame, outrights: DataFrame) -> DataFrame:
    """How many bars of spreads and unknown contracts a parent request held."""
    unknown = bars.join(outrights.select("instrument_id").distinct(), "instrument_id", "left_anti")
    return unknown.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("dropped"))


def append_ticks(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New ticks outside the stored coverage of their symbol and schema."""
    return outside_coverage(new, stored, ["symbol", "schema"], "ts_ns")


def prune_empty_ranges(ranges: DataFrame, counts: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Drop ranges of stored series known to hold no records; an unknown count keeps them."""
    seen = stored.select(*keys).distinct().withColumn("__seen", F.lit(True))
    joined = ranges.join(counts.select(*keys, "gap_start", "records"), [*keys, "gap_start"], "left").join(seen, keys, "left")
    keep = F.col("__seen").isNull() | (F.coalesce("records", F.lit(1)) != 0)
    return joined.where(keep).drop("records", "__seen")


def compact_bars(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite a store with few, sorted files."""
    write_bars(spark.read.schema(BARS).parquet(source), target, mode="overwrite")


# -- definitions, manifests ------------------------------------------------------


def latest_definitions(definitions: DataFrame, key: str = "instrument_id") -> DataFrame:
    return keep_latest(definitions, [key], [F.col("ts_init")])


def continuous_definitions(continuous: DataFrame, definitions: DataFrame) -> DataFrame:
    """Definition of each continuous symbol: the newest outright of its root, without expiry."""
    newest = keep_latest(definitions, ["underlying"], [F.col("ts_init"), F.col("instrument_id")]).drop("expiry", "instrument_id")
    rooted = continuous.withColumn("underlying", F.split("symbol", r"\.")[0])
    return rooted.join(newest, "underlying", "left").withColumn("expiry", F.lit(None).cast("timestamp"))


def equity_instruments(bars: DataFrame) -> DataFrame:
    """Equity definitions from their bars: price precision and the matching increment."""
    out = infer_price_precision(bars, ["symbol", "venue"])
    return out.withColumn("increment", F.pow(F.lit(10.0), -F.col("precision")))


def append_instruments(new: DataFrame, stored: DataFrame) -> DataFrame:
    return new.join(stored.select("instrument_id"), "instrument_id", "left_anti")


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by symbol: a new outcome replaces the old one, other rows stay."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, ["symbol"], [F.col("__v")]).drop("__v")


def retry_list(manifest: DataFrame) -> DataFrame:
    return manifest.where("status <> 'ok'").select("symbol")


# -- adjustment drift, reconciliation, migration ---------------------------------


def check_adjustment_drift(stored: DataFrame, fresh: DataFrame, tolerance: float = 1.5e-4) -> DataFrame:
    """Compare stored and fresh closes at each symbol's last stored bar."""
    seam = stored.groupBy("symbol").agg(F.max("ts_init").alias("ts_init"), F.max_by("close", "ts_init").alias("stored_close"))
    joined = seam.join(fresh.select("symbol", "ts_init", F.col("close").alias("fresh_close")), ["symbol", "ts_init"], "left")
    status = (
        F.when(F.col("fresh_close").isNull(), F.lit("unchecked"))
        .when(F.abs(F.col("stored_close") - F.col("fresh_close")) > tolerance, F.lit("drifted"))
        .otherwise(F.lit("ok"))
    )
    return joined.withColumn("status", status)


def quarantine(fresh: DataFrame, drift: DataFrame) -> DataFrame:
    return fresh.join(drift.where("status = 'drifted'").select("symbol"), "symbol", "left_anti")


def rebuildable(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh bars of series whose stored range they cover."""
    have = stored.groupBy("symbol").agg(F.min("ts_init").alias("f"), F.max("ts_init").alias("l"))
    got = fresh.groupBy("symbol").agg(F.min("ts_init").alias("gf"), F.max("ts_init").alias("gl"))
    full = have.join(got, "symbol").where("gf <= f AND gl >= l").select("symbol")
    return fresh.join(full, "symbol", "left_semi")


def rebuild_series(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with every rebuildable series replaced whole."""
    ready = rebuildable(fresh, stored)
    rest = stored.join(ready.select("symbol").distinct(), "symbol", "left_anti")
    return rest.unionByName(ready.select(*rest.columns))


def weekday_sessions(windows: DataFrame) -> DataFrame:
    """Monday-to-Friday days of each ``keys.., start, end`` window."""
    days = windows.withColumn("session", F.explode(F.expr("sequence(CAST(start AS date), CAST(end AS date), INTERVAL 1 DAY)")))
    return days.where(F.weekday("session") < 5)


def session_window(windows: DataFrame, keys: list[str], last_complete) -> DataFrame:
    """First and last completed session inside each window."""
    clamped = windows.withColumn("end", F.least(F.col("end").cast("date"), F.lit(last_complete).cast("date")))
    inside = weekday_sessions(clamped.where(F.col("start").cast("date") <= F.col("end")))
    return inside.groupBy(*keys).agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"))


def reconcile_bars(a: DataFrame, b: DataFrame, keys: list[str], precision: int = 2) -> DataFrame:
    """Row counts and scaled close sums of two stores, series by series."""
    def sums(df: DataFrame, tag: str) -> DataFrame:
        units = F.rint(F.col("close") * 10.0**precision).cast("long").cast("decimal(38,0)")
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"rows_{tag}"), F.sum(units).cast("decimal(38,0)").alias(f"sum_{tag}"))

    joined = sums(a, "a").join(sums(b, "b"), keys, "full")
    same = F.col("rows_a").eqNullSafe(F.col("rows_b")) & F.col("sum_a").eqNullSafe(F.col("sum_b"))
    return joined.withColumn("ok", same)


def migrate_bars(spark: SparkSession, root: str) -> DataFrame:
    """Legacy ``<type>/<symbol>/<schema>.parquet`` files as one deduplicated table.

    Of rows with the same time the one furthest down its file stays. Files that stamp ``ts_event`` in nanoseconds are read as
    whole numbers and cut to microseconds.
    """
    key = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")  # the schema is settled here; reading follows it
    raw = spark.read.option("recursiveFileLookup", "true").parquet(root)
    schema = raw.schema
    spark.conf.set(key, before)
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root)
    if dict(raw.dtypes)["ts_event"] == "bigint":
        raw = raw.withColumn("ts_event", F.timestamp_micros(F.expr("ts_event div 1000")))
    pattern = r"([^/]+)/([^/]+)/([^/]+)\.parquet$"
    path = F.col("_metadata.file_path")
    raw = raw.select(
        "*", F.regexp_extract(path, pattern, 1).alias("type"), F.regexp_extract(path, pattern, 2).alias("symbol"),
        F.regexp_extract(path, pattern, 3).alias("schema"), F.col("_metadata.row_index").alias("__row"),
    )
    return dedup_keep_last(raw, ["type", "symbol", "schema", "ts_event"], ["__row"]).drop("__row")


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_latest(df, keys, [F.col(c) for c in order])


def migrate_ticks(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Tick rows later than the last stored one of their instrument."""
    last = stored.groupBy("symbol").agg(F.max("ts").alias("__l"))
    return new.join(last, "symbol", "left").where("__l IS NULL OR ts > __l").drop("__l")


def missing_tick_days(expected: DataFrame, archived: DataFrame) -> DataFrame:
    """Instrument days that should exist but have no archive."""
    return expected.select("symbol", "day").distinct().exceptAll(archived.select("symbol", "day").distinct())


# -- other tables -------------------------------------------------------------------


def write_spans(spans: DataFrame, path: str) -> None:
    spans.write.mode("overwrite").json(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    from ..schema import SPANS

    return spark.read.schema(SPANS).json(path)


def read_option_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_option_bars(parts: DataFrame, path: str) -> None:
    """Combine monthly parts once; an existing chain is never overwritten."""
    laid_out = parts.withColumns({"root": F.regexp_extract("underlying", r"^(.*)[A-Z]\d{1,2}$", 1), "year": F.year("date")})
    laid_out = laid_out.repartitionByRange("root", "year", "date", "strike").sortWithinPartitions("root", "year", "date", "expiry", "strike", "right")
    laid_out.write.mode("errorifexists").partitionBy("root", "year").parquet(path)


def write_returns(returns: DataFrame, path: str) -> None:
    """Append trial returns by study; trials share files, sorted for row-group skipping."""
    laid_out = returns.repartitionByRange("study", "trial").sortWithinPartitions("study", "trial", "ts")
    laid_out.write.mode("append").partitionBy("study").parquet(path)


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
