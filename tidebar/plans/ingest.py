"""Queries over stored series: coverage, precision, appends, manifests, migration."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir, store_once
from ..sources import bars as store
from ..sources import committed
from . import inputs as src
from .inputs import BRAND, ORDERS
from .registry import query

# The order bars as a store with a venue that depends on the symbol.
_STORE = ORDERS + ", sb AS (SELECT *, CASE WHEN symbol < '3' THEN 'XA' ELSE 'XB' END AS venue, 'ohlcv-1d' AS schema FROM bars)"
_CUT1, _CUT2 = "1996-03-01", "1998-06-01"
_OLD = f", old AS (SELECT * FROM sb WHERE ts_init >= TIMESTAMP '{_CUT1}' AND ts_init < TIMESTAMP '{_CUT2}' AND symbol <> '5-LOW')"
_OHLCV = "symbol:s venue:s schema:s ts_init:t open:2 high:2 low:2 close:2"


def stored(spark, sf):
    venue = F.when(F.col("symbol") < "3", F.lit("XA")).otherwise(F.lit("XB"))
    return src.order_bars(spark, sf).withColumns({"venue": venue, "schema": F.lit("ohlcv-1d")})


def old_part(spark, sf):
    bars = stored(spark, sf)
    return bars.where((F.col("ts_init") >= F.lit(_CUT1).cast("timestamp")) & (F.col("ts_init") < F.lit(_CUT2).cast("timestamp")) & (F.col("symbol") != "5-LOW"))


@query(_OHLCV, _STORE + _OLD + ", c AS (SELECT symbol, min(ts_init) AS f, max(ts_init) AS l FROM old GROUP BY symbol) SELECT sb.* FROM sb LEFT JOIN c USING (symbol) WHERE f IS NULL OR ts_init < f OR ts_init > l")
def append_bars_outside_coverage(spark, sf):
    return store.outside_coverage(stored(spark, sf), old_part(spark, sf))


def committed_store(spark, sf):
    """A store of the older bars, then all bars in two named batches; a writer stops before its commit, and a batch is replayed."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/committed-{uuid.uuid4().hex}"
    price = {c: F.col(c).cast(store.PRICE) for c in [*store.OHLC, "volume"]}
    whole = store_once(stored(spark, sf).withColumns(price))
    committed.append(old_part(spark, sf).withColumns(price), path, "old")
    late = F.col("ts_init") >= F.lit(_CUT2).cast("timestamp")
    committed._write(whole.where(late), path)  # bars that were written and never committed
    for batch, rows in (("late", whole.where(late)), ("late", whole.where(late)), ("rest", whole)):
        committed.append(rows, path, batch)
    return path


_APPENDED = _STORE + _OLD + """, c AS (SELECT symbol, min(ts_init) AS f, max(ts_init) AS l FROM old GROUP BY symbol),
ap AS (SELECT symbol, venue, schema, ts_init, close FROM old UNION ALL SELECT sb.symbol, sb.venue, sb.schema, sb.ts_init, sb.close FROM sb LEFT JOIN c USING (symbol) WHERE f IS NULL OR ts_init < f OR ts_init > l)"""
# A series that only the late batch brings is known from then on, so what is before it is added, and what is inside is not.


@query("symbol:s venue:s ts_init:t close:2", _APPENDED + " SELECT * FROM ap")
def append_committed(spark, sf):
    """Bars of a committed store after appends that were interrupted and replayed."""
    return committed.read(spark, committed_store(spark, sf), schema="ohlcv-1d")


@query("symbol:s venue:s ts_init:t close:2", _APPENDED + f" SELECT * FROM ap WHERE venue = 'XA' AND ts_init BETWEEN TIMESTAMP '{_CUT1}' AND TIMESTAMP '{_CUT2}'")
def compact_committed(spark, sf):
    """A range of one venue after compaction and removal of what no commit names."""
    path = committed_store(spark, sf)
    committed.compact(spark, path)
    committed.vacuum(spark, path)
    return committed.read(spark, path, venue="XA", start=_CUT1, end=_CUT2)


@query("symbol:s venue:s first:t last:t bars:i", _APPENDED + " SELECT symbol, venue, min(ts_init) AS first, max(ts_init) AS last, count(*) AS bars FROM ap GROUP BY ALL")
def committed_coverage(spark, sf):
    """Coverage of every series from the log alone."""
    return committed.coverage(committed.read_log(spark, committed_store(spark, sf)))


@query("symbol:s venue:s schema:s first:t last:t bars:i", _STORE + " SELECT symbol, venue, schema, min(ts_init) AS first, max(ts_init) AS last, count(*) AS bars FROM sb GROUP BY ALL")
def coverage_report(spark, sf):
    return store.coverage_report(stored(spark, sf))


@query("symbol:s venue:s", _STORE + " SELECT DISTINCT symbol, venue FROM sb WHERE schema = 'ohlcv-1d'")
def list_series(spark, sf):
    return store.list_series(stored(spark, sf), "ohlcv-1d")


_VEN = "SELECT p_brand AS symbol, p_type AS venue FROM part WHERE p_partkey % 5 > 0 UNION SELECT 'only ' || p_brand, 'XA' FROM part"


@query("symbol:s venue:s status:s", f"WITH v AS ({_VEN}), w AS (SELECT DISTINCT symbol FROM v UNION SELECT r_name FROM region), n AS (SELECT symbol, count(*) AS n, min(venue) AS venue FROM v GROUP BY symbol) SELECT w.symbol, CASE WHEN n = 1 THEN venue END AS venue, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM w LEFT JOIN n USING (symbol)")
def resolve_venues(spark, sf):
    part = src.table(spark, sf, "part")
    rows = part.where("p_partkey % 5 > 0").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("venue")).unionByName(
        part.select(F.concat(F.lit("only "), "p_brand").alias("symbol"), F.lit("XA").alias("venue"))
    )
    wanted = rows.select("symbol").unionByName(src.table(spark, sf, "region").select(F.col("r_name").alias("symbol")))
    return store.resolve_venues(rows, wanted)


@query("symbol:s kind:s gap_start:t gap_end:t", _STORE + _OLD + """, c AS (SELECT symbol, min(ts_init) AS f, max(ts_init) AS l FROM old GROUP BY symbol),
w AS (SELECT DISTINCT symbol, TIMESTAMP '1996-01-01' AS s, TIMESTAMP '1999-01-01' AS e FROM sb), j AS (SELECT * FROM w LEFT JOIN c USING (symbol))
SELECT symbol, 'all' AS kind, s AS gap_start, e AS gap_end FROM j WHERE f IS NULL UNION ALL SELECT symbol, 'head', s, least(f, e) FROM j WHERE f - INTERVAL 5 DAY > s UNION ALL SELECT symbol, 'tail', greatest(l, s), e FROM j WHERE l < e""")
def coverage_gaps(spark, sf):
    wanted = stored(spark, sf).select(*store.SERIES).distinct().withColumns(
        {"start": F.lit("1996-01-01").cast("timestamp"), "end": F.lit("1999-01-01").cast("timestamp")}
    )
    return store.coverage_gaps(wanted, old_part(spark, sf))


@query("underlying:s first:t last:t", BRAND + ", i AS (SELECT DISTINCT p_brand, substr(p_brand, 1, 7) AS underlying FROM part) SELECT underlying, min(ts_init) AS first, max(ts_init) AS last FROM bars JOIN i ON symbol = p_brand GROUP BY 1")
def parent_coverage(spark, sf):
    known = src.table(spark, sf, "part").select(F.col("p_brand").alias("raw_symbol"), F.substring("p_brand", 1, 7).alias("underlying")).distinct()
    return store.parent_coverage(src.brand_bars(spark, sf), known)


@query("instrument_id:s kept:i dropped:i", BRAND + " SELECT symbol AS instrument_id, CASE WHEN symbol < 'Brand#2' THEN count(*) ELSE 0 END AS kept, CASE WHEN symbol < 'Brand#2' THEN 0 ELSE count(*) END AS dropped FROM bars GROUP BY symbol")
def split_parent_bars(spark, sf):
    bars = src.brand_bars(spark, sf).withColumnRenamed("symbol", "instrument_id")
    known = src.table(spark, sf, "part").where("p_brand < 'Brand#2'").select(F.col("p_brand").alias("instrument_id"))
    kept = store.split_parent_bars(bars, known).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("kept"))
    both = kept.join(store.dropped_parent_bars(bars, known), "instrument_id", "full")
    return both.fillna(0, ["kept", "dropped"])


@query("event_id:i symbol:s", """WITH o AS (SELECT event_type, min(ts) AS f, max(ts) AS l FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20' AND event_type <> 'view' GROUP BY 1)
SELECT event_id, e.event_type AS symbol FROM events e LEFT JOIN o USING (event_type) WHERE f IS NULL OR ts < f OR ts > l""")
def append_ticks(spark, sf):
    ticks = src.event_ticks(spark, sf).withColumns({"schema": F.lit("trades"), "ts_ns": F.unix_micros("ts") * 1000})
    old = ticks.where("ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20' AND symbol <> 'view'")
    return store.append_ticks(ticks, old)


@query("symbol:s gap_start:t", """WITH r AS (SELECT DISTINCT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS gap_start FROM events WHERE event_id % 3 > 0),
n AS (SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS gap_start, sum(CASE WHEN value > 300 THEN 1 ELSE 0 END) AS records FROM events WHERE event_id % 4 > 0 GROUP BY ALL),
s AS (SELECT DISTINCT event_type AS symbol FROM events WHERE event_type < 'p')
SELECT r.* FROM r LEFT JOIN n USING (symbol, gap_start) LEFT JOIN s ON s.symbol = r.symbol WHERE s.symbol IS NULL OR coalesce(records, 1) <> 0""")
def prune_empty_ranges(spark, sf):
    events = src.table(spark, sf, "events").withColumns(
        {"symbol": F.col("event_type"), "gap_start": F.date_trunc("day", F.col("ts").cast("timestamp"))}
    )
    ranges = events.where("event_id % 3 > 0").select("symbol", "gap_start").distinct()
    counts = events.where("event_id % 4 > 0").groupBy("symbol", "gap_start").agg(F.count_if(F.col("value") > 300).alias("records"))
    return store.prune_empty_ranges(ranges, counts, events.where("event_type < 'p'"), ["symbol"])


@query("symbol:s precision:i", """WITH v AS (SELECT o_orderpriority AS symbol, CASE o_orderpriority WHEN '1-URGENT' THEN floor(o_totalprice) WHEN '2-HIGH' THEN floor(o_totalprice) / 8 WHEN '5-LOW' THEN o_totalprice / 10000 ELSE o_totalprice END AS x FROM orders),
g AS (SELECT symbol, p, max(abs(x * pow(10, p) - round_even(x * pow(10, p), 0))) AS gap FROM v, range(10) r(p) GROUP BY ALL) SELECT symbol, coalesce(min(p) FILTER (gap < 1e-6), 9) AS precision FROM g GROUP BY symbol""")
def infer_precision(spark, sf):
    price, key = F.col("o_totalprice"), F.col("o_orderpriority")
    x = F.when(key == "1-URGENT", F.floor(price)).when(key == "2-HIGH", F.floor(price) / 8).when(key == "5-LOW", price / 10000).otherwise(price)
    return store.infer_price_precision(src.table(spark, sf, "orders").select(key.alias("symbol"), x.cast("double").alias("x")), ["symbol"], ["x"])


@query("symbol:s venue:s precision:i increment:6", _STORE + ", g AS (SELECT symbol, venue, p, max(greatest(abs(open * pow(10, p) - round_even(open * pow(10, p), 0)), abs(high * pow(10, p) - round_even(high * pow(10, p), 0)), abs(low * pow(10, p) - round_even(low * pow(10, p), 0)), abs(close * pow(10, p) - round_even(close * pow(10, p), 0)))) AS gap FROM sb, range(10) r(p) GROUP BY ALL) SELECT symbol, venue, coalesce(min(p) FILTER (gap < 1e-6), 9) AS precision, pow(10.0, -coalesce(min(p) FILTER (gap < 1e-6), 9)) AS increment FROM g GROUP BY symbol, venue")
def equity_instruments(spark, sf):
    return store.equity_instruments(stored(spark, sf))


@query("o_orderkey:i ts_init:t open:s close:s", """SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR AS ts_init, CAST(CAST(round_even(o_totalprice / 3 * 100, 0) / 100 AS DECIMAL(20, 2)) AS DECIMAL(38, 16))::VARCHAR AS open,
 CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS DECIMAL(38, 16))::VARCHAR AS close FROM orders""")
def normalize_bars(spark, sf):
    price = F.col("o_totalprice")
    raw = src.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts_event"), (price / 3).alias("open"), price.alias("high"),
        (price / 3).alias("low"), price.alias("close"), F.lit(1.0).alias("volume"),
    )
    return store.normalize_bars(raw, "ohlcv-1h", F.lit(2))


@query("event_id:i ts_event:t", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 60 SECOND ELSE ts - INTERVAL 61 SECOND END AS ts_event FROM events WHERE event_type = 'click' AND event_id % 10 > 0""")
def rekey_bars(spark, sf):
    v = F.when(F.col("event_id") % 20 == 0, F.lit(float("nan"))).when(F.col("event_id") % 20 != 10, F.col("value"))
    ts = F.col("ts").cast("timestamp")
    opened = F.when(F.col("event_id") % 3 == 0, ts).otherwise(ts - F.expr("INTERVAL 61 SECONDS"))
    raw = src.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("instrument_id"), ts.alias("ts_init"), opened.alias("ts_event"),
        *[v.alias(c) for c in store.OHLC],
    )
    return store.rekey_bars(raw, "click", 60)


@query("symbol:s ts_init:t close:8", BRAND + " SELECT symbol, ts_init, close FROM bars WHERE abs(close * 100 - round_even(close * 100, 0)) >= 1e-6")
def lossy_rows(spark, sf):
    precision = src.table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.lit(2).alias("precision")).distinct()
    return store.lossy_rows(src.brand_bars(spark, sf), precision)


@query("symbol:s close:s n:i", ORDERS + " SELECT symbol, CAST(CAST(max(close) AS DECIMAL(20, 2)) AS DECIMAL(38, 16))::VARCHAR AS close, count(*) AS n FROM bars GROUP BY symbol")
def conform_precision(spark, sf):
    precision = src.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.lit(2).alias("precision")).distinct()
    bars = store.conform_precision(src.order_bars(spark, sf), precision)
    return bars.groupBy("symbol").agg(F.max("close").alias("close"), F.count(F.lit(1)).alias("n"))


_META = "SELECT 's' || (o_custkey % 50) AS symbol, o_orderstatus AS venue, 'ohlcv-1d' AS schema, o_orderkey, o_custkey % 7 AS price_precision, o_custkey % 3 AS size_precision FROM orders"


@query("symbol:s venue:s price_precision:i size_precision:i", f"WITH m AS ({_META}) SELECT symbol, venue, arg_max(price_precision, o_orderkey) AS price_precision, arg_max(size_precision, o_orderkey) AS size_precision FROM m GROUP BY symbol, venue")
def stored_precision(spark, sf):
    meta = src.table(spark, sf, "orders").select(
        F.concat(F.lit("s"), F.col("o_custkey") % 50).alias("symbol"), F.col("o_orderstatus").alias("venue"), F.lit("ohlcv-1d").alias("schema"),
        F.col("o_orderkey").alias("ts_init"), (F.col("o_custkey") % 7).alias("price_precision"), (F.col("o_custkey") % 3).alias("size_precision"),
    )
    return store.stored_precision(meta)


_DEFS = """WITH defs AS (SELECT 'I' || (o_custkey % 400) AS instrument_id, 'U' || (o_custkey % 40) AS underlying, o_orderkey AS ts_init, o_totalprice AS tick, o_orderdate AS expiry FROM orders)"""


def definitions(spark, sf):
    return src.table(spark, sf, "orders").select(
        F.concat(F.lit("I"), F.col("o_custkey") % 400).alias("instrument_id"), F.concat(F.lit("U"), F.col("o_custkey") % 40).alias("underlying"),
        F.col("o_orderkey").alias("ts_init"), F.col("o_totalprice").alias("tick"), F.col("o_orderdate").cast("timestamp").alias("expiry"),
    )


@query("instrument_id:s underlying:s tick:2 expiry:t", _DEFS + " SELECT instrument_id, arg_max(underlying, ts_init) AS underlying, arg_max(tick, ts_init) AS tick, arg_max(expiry, ts_init) AS expiry FROM defs GROUP BY 1")
def latest_definitions(spark, sf):
    return store.latest_definitions(definitions(spark, sf))


@query("symbol:s tick:2 expiry:t", _DEFS + ", n AS (SELECT underlying, arg_max(tick, row(ts_init, instrument_id)) AS tick FROM defs GROUP BY 1), c AS (SELECT DISTINCT 'U' || (o_custkey % 60) || '.c.0' AS symbol FROM orders) SELECT c.symbol, tick, NULL::TIMESTAMP AS expiry FROM c LEFT JOIN n ON split_part(c.symbol, '.', 1) = n.underlying")
def continuous_definitions(spark, sf):
    wanted = src.table(spark, sf, "orders").select(F.concat(F.lit("U"), F.col("o_custkey") % 60, F.lit(".c.0")).alias("symbol")).distinct()
    return store.continuous_definitions(wanted, definitions(spark, sf))


@query("instrument_id:s underlying:s", _DEFS + ", s AS (SELECT DISTINCT instrument_id FROM defs WHERE ts_init % 40 = 0) SELECT DISTINCT instrument_id, underlying FROM defs WHERE instrument_id NOT IN (SELECT instrument_id FROM s)")
def append_instruments(spark, sf):
    defs = definitions(spark, sf)
    return store.append_instruments(defs.select("instrument_id", "underlying").distinct(), defs.where("ts_init % 40 = 0"))


@query("symbol:s status:s bars:i", """WITH a AS (SELECT c_custkey::VARCHAR AS symbol, 'failed' AS status, c_nationkey AS bars FROM customer), b AS (SELECT o_custkey::VARCHAR AS symbol, CASE WHEN count(*) % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS bars FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1)
SELECT coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.status, a.status) AS status, coalesce(b.bars, a.bars) AS bars FROM a FULL JOIN b USING (symbol)""")
def merge_manifest(spark, sf):
    old = src.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("symbol"), F.lit("failed").alias("status"), F.col("c_nationkey").cast("long").alias("bars")
    )
    n = F.count(F.lit(1))
    new = src.table(spark, sf, "orders").where("o_orderkey % 9 = 0").groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(
        F.when(n % 4 == 0, F.lit("failed")).otherwise(F.lit("ok")).alias("status"), n.alias("bars")
    )
    return store.merge_manifest(old, new)


@query("symbol:s", """WITH b AS (SELECT o_custkey::VARCHAR AS symbol, count(*) AS n FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1) SELECT symbol FROM b WHERE n % 4 = 0
 UNION ALL SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT symbol FROM b)""")
def retry_list(spark, sf):
    """What a manifest says to fetch again."""
    return store.retry_list(merge_manifest(spark, sf))


@query(_OHLCV, _STORE + " SELECT * FROM sb")
def compact_bars(spark, sf):
    """A store written in many small appends, rewritten with few files; the bars are the same."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    price = {c: F.col(c).cast(store.PRICE) for c in [*store.OHLC, "volume"]}
    bars = store_once(stored(spark, sf).withColumns(price))
    for part in range(3):
        store.write_bars(bars.where(F.pmod(F.hash("symbol", "ts_init"), F.lit(3)) == part), f"{root}/small")
    store.compact_bars(spark, f"{root}/small", f"{root}/few")
    return store.read_bars(spark, f"{root}/few", schema="ohlcv-1d")


@query("symbol:s d0:d d1:d raw_symbol:s", "SELECT p_brand AS symbol, min(l_shipdate)::DATE AS d0, max(l_shipdate)::DATE AS d1, p_type AS raw_symbol FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type")
def spans_round_trip(spark, sf):
    """Contract spans of every series, written and read back."""
    line, part = src.table(spark, sf, "lineitem"), src.table(spark, sf, "part")
    spans = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("symbol"), F.col("p_type").alias("raw_symbol")).agg(
        F.min("l_shipdate").cast("date").alias("d0"), F.max("l_shipdate").cast("date").alias("d1")
    )
    path = f"{checkpoint_dir(spark).rstrip('/')}/spans-{uuid.uuid4().hex}"
    store.write_spans(spans, path)
    return store.read_spans(spark, path)


_FRESH = ORDERS + ", fresh AS (SELECT symbol, ts_event, ts_init, CASE WHEN symbol = '2-HIGH' THEN close * 1.5 ELSE close END AS close FROM bars WHERE symbol <> '3-MEDIUM' OR ts_init < TIMESTAMP '1997-01-01')"


def fresh_bars(spark, sf):
    bars = src.order_bars(spark, sf).where("symbol <> '3-MEDIUM' OR ts_init < TIMESTAMP '1997-01-01'")
    return bars.withColumn("close", F.when(F.col("symbol") == "2-HIGH", F.col("close") * 1.5).otherwise(F.col("close")))


@query("symbol:s status:s ts_init:t", _FRESH + """, seam AS (SELECT symbol, max(ts_init) AS ts_init, arg_max(close, ts_init) AS c FROM bars WHERE ts_init < TIMESTAMP '1998-01-01' GROUP BY symbol)
SELECT seam.symbol, seam.ts_init, CASE WHEN f.close IS NULL THEN 'unchecked' WHEN abs(f.close - c) > 1.5e-4 THEN 'drifted' ELSE 'ok' END AS status FROM seam LEFT JOIN fresh f ON f.symbol = seam.symbol AND f.ts_init = seam.ts_init""")
def check_adjustment_drift(spark, sf):
    old = src.order_bars(spark, sf).where("ts_init < TIMESTAMP '1998-01-01'")
    return store.check_adjustment_drift(old, fresh_bars(spark, sf))


@query("symbol:s ts_init:t close:2", _FRESH + " SELECT symbol, ts_init, close FROM fresh WHERE symbol <> '2-HIGH'")
def quarantine_drifted(spark, sf):
    old, fresh = src.order_bars(spark, sf).where("ts_init < TIMESTAMP '1998-01-01'"), fresh_bars(spark, sf)
    return store.quarantine(fresh, store.check_adjustment_drift(old, fresh))


@query("symbol:s ts_init:t close:4", _FRESH + ", o AS (SELECT symbol, ts_init, close FROM bars WHERE ts_init < TIMESTAMP '1998-01-01') SELECT symbol, ts_init, close FROM o WHERE symbol = '3-MEDIUM' UNION ALL SELECT symbol, ts_init, close FROM fresh WHERE symbol <> '3-MEDIUM'")
def rebuild_series(spark, sf):
    old = src.order_bars(spark, sf).where("ts_init < TIMESTAMP '1998-01-01'")
    return store.rebuild_series(old.select("symbol", "ts_init", "close"), fresh_bars(spark, sf).select("symbol", "ts_init", "close"))


@query("o_orderkey:i first_session:d last_session:d", """WITH w AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, least(CAST(o_orderdate AS DATE) + (o_custkey % 9)::INT, DATE '1998-06-30') AS e FROM orders),
x AS (SELECT o_orderkey, unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS d FROM w WHERE s <= e) SELECT o_orderkey, min(d) AS first_session, max(d) AS last_session FROM x WHERE isodow(d) <= 5 GROUP BY 1""")
def session_window(spark, sf):
    day = F.col("o_orderdate").cast("date")
    windows = src.table(spark, sf, "orders").select("o_orderkey", day.alias("start"), F.date_add(day, (F.col("o_custkey") % 9).cast("int")).alias("end"))
    return store.session_window(windows, ["o_orderkey"], "1998-06-30")


@query("symbol:s rows_a:i rows_b:i ok:b", ORDERS + """, b2 AS (SELECT symbol, ts_init, CASE WHEN symbol = '1-URGENT' AND dayofyear(ts_init) = 100 THEN close + 0.01 ELSE close END AS close FROM bars WHERE symbol <> '4-NOT SPECIFIED' OR dayofyear(ts_init) <> 200),
a AS (SELECT symbol, count(*) AS rows_a, sum(CAST(round_even(close * 100, 0) AS HUGEINT)) AS sa FROM bars GROUP BY 1), b AS (SELECT symbol, count(*) AS rows_b, sum(CAST(round_even(close * 100, 0) AS HUGEINT)) AS s2 FROM b2 GROUP BY 1)
SELECT symbol, rows_a, rows_b, rows_a = rows_b AND sa = s2 AS ok FROM a JOIN b USING (symbol)""")
def reconcile_bars(spark, sf):
    a = src.order_bars(spark, sf)
    moved = (F.col("symbol") == "1-URGENT") & (F.dayofyear("ts_init") == 100)
    b = a.where((F.col("symbol") != "4-NOT SPECIFIED") | (F.dayofyear("ts_init") != 200)).withColumn(
        "close", F.when(moved, F.col("close") + 0.01).otherwise(F.col("close"))
    )
    return store.reconcile_bars(a, b, ["symbol"])


@query("o_custkey:i day:d price:2", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL")
def migrate_dedup(spark, sf):
    rows = src.table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return store.dedup_keep_last(rows, ["o_custkey", "day"], ["o_orderkey"])


@query("event_id:i", "WITH o AS (SELECT event_type, max(ts) AS l FROM events WHERE event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-15' AND event_type <> 'error' GROUP BY 1) SELECT event_id FROM events LEFT JOIN o USING (event_type) WHERE l IS NULL OR ts > l")
def migrate_ticks(spark, sf):
    ticks = src.event_ticks(spark, sf)
    return store.migrate_ticks(ticks, ticks.where("event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-15' AND symbol <> 'error'"))


@query("symbol:s day:d", "SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS day FROM events EXCEPT SELECT event_type, CAST(ts AS DATE) FROM events WHERE value > (SELECT quantile_cont(value, 0.98) FROM events)")
def missing_tick_days(spark, sf):
    ticks = src.event_ticks(spark, sf).withColumn("day", F.to_date("ts"))
    high = ticks.agg(F.percentile("price", 0.98)).scalar()
    return store.missing_tick_days(ticks, ticks.where(F.col("price") > high))
