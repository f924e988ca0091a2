"""Queries over futures curves and rolls."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import symbols as sym
from ..operators import curve
from ..operators.resample import tick_to_bar
from ..session import store_once
from . import inputs as src
from .inputs import REGION, _K, _sql_bars
from .registry import query

# Front and second-month series: line items of the two line statuses, per region.
_TICKS = ("SELECT r_name AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size, " + _K +
          " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey "
          "JOIN region ON n_regionkey = r_regionkey WHERE l_linestatus = '{}'")
_CODE = "substr('HMUZ', quarter({0})::INT, 1) || (year({0}) % {1})"


def _spans_sql(modulus: int = 10) -> str:
    raw = lambda d: f"substr(symbol, 1, 2) || {_CODE.format(d, modulus)}"
    return f""", quarters AS (SELECT DISTINCT symbol, CAST(date_trunc('quarter', ts_event) AS DATE) AS d0 FROM (SELECT * FROM front UNION ALL SELECT * FROM second)),
fspans AS (SELECT symbol, d0, CAST(d0 + INTERVAL 3 MONTH AS DATE) AS d1, {raw('d0')} AS raw_symbol FROM quarters),
sspans AS (SELECT symbol, d0, CAST(d0 + INTERVAL 3 MONTH AS DATE) AS d1, {raw("(d0 + INTERVAL 3 MONTH)")} AS raw_symbol FROM quarters)"""


PAIR = "WITH RECURSIVE " + _sql_bars(_TICKS.format("F"), "1 DAY", _K, "front") + ", " + _sql_bars(_TICKS.format("O"), "1 DAY", _K, "second")
CURVE = PAIR + _spans_sql()


def pair(spark, sf):
    ticks = src.region_ticks(spark, sf)
    return (
        tick_to_bar(ticks.where("l_linestatus = 'F'"), src.DAY, src._LINE),
        tick_to_bar(ticks.where("l_linestatus = 'O'"), src.DAY, src._LINE),
    )


def raw_name(symbol, day, modulus: int = 10):
    letter = F.element_at(F.array(*[F.lit(c) for c in "HMUZ"]), F.quarter(day))
    return F.concat(F.substring(symbol, 1, 2), letter, (F.year(day) % modulus).cast("string"))


def spans(front, second, modulus: int = 10):
    quarters = front.select("symbol", "ts_event").unionByName(second.select("symbol", "ts_event")).select(
        "symbol", F.trunc("ts_event", "quarter").alias("d0")
    ).distinct()
    base = store_once(quarters.withColumn("d1", F.add_months("d0", 3)))  # the stored contract mapping
    return (
        base.withColumn("raw_symbol", raw_name(F.col("symbol"), F.col("d0"), modulus)),
        base.withColumn("raw_symbol", raw_name(F.col("symbol"), F.col("d1"), modulus)),
    )


def market(spark, sf):
    front, second = pair(spark, sf)
    return (front, second, *spans(front, second))


_TAG = "SELECT b.*, s.raw_symbol AS contract FROM {0} b ASOF JOIN {1} s ON b.symbol = s.symbol AND CAST(b.ts_event AS DATE) >= s.d0 WHERE CAST(b.ts_event AS DATE) < s.d1"


@query("symbol:s ts_init:t close:8 contract:s", CURVE + " " + _TAG.format("front", "fspans"))
def tag_contracts(spark, sf):
    front, _, near, _ = market(spark, sf)
    return curve.tag_contracts(front, near)


def _month(c: str) -> str:
    return f"instr('FGHJKMNQUVXZ', substr({c}, 3, 1))"


_CARRY = f""", fo AS (SELECT * FROM front WHERE volume > 0), so AS (SELECT * FROM second WHERE volume > 0),
ft AS ({_TAG.format('fo', 'fspans')}), st AS ({_TAG.format('so', 'sspans')}),
cj AS (SELECT ft.symbol, ft.ts_init, ft.close, st.close AS far, ((substr(st.contract, 4)::INT - substr(ft.contract, 4)::INT + 10) % 10) * 12
 + {_month('st.contract')} - {_month('ft.contract')} AS months FROM ft JOIN st ON ft.symbol = st.symbol AND ft.ts_init = st.ts_init),
carry AS (SELECT symbol, ts_init, (close / far - 1) * 12 / months AS carry FROM cj WHERE months > 0 AND months <= 60 AND far > 0 AND close > 0)"""


@query("symbol:s ts_init:t carry:6", CURVE + _CARRY + " SELECT * FROM carry")
def roll_yield(spark, sf):
    return curve.roll_yield(*market(spark, sf))


def _unique_sql(f: str = "fspans", s: str = "sspans") -> str:
    return f""", us AS (SELECT *, 0 AS series FROM {f} UNION ALL SELECT *, 1 FROM {s}),
ue AS (SELECT *, max(d1) OVER (PARTITION BY symbol, raw_symbol ORDER BY d0, d1, series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM us),
un AS (SELECT *, sum(CASE WHEN ended IS NULL OR d0 - ended > 1095 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, raw_symbol ORDER BY d0, d1, series ROWS UNBOUNDED PRECEDING) AS listing FROM ue),
uc AS (SELECT symbol, d0, d1, series, raw_symbol, raw_symbol || '_' || year(min(d0) OVER (PARTITION BY symbol, raw_symbol, listing)) AS contract FROM un)"""


@query("symbol:s d0:d d1:d series:i raw_symbol:s contract:s", PAIR + _spans_sql(4) + _unique_sql() + " SELECT * FROM uc")
def unique_contracts(spark, sf):
    """Raw names that repeat every four years, so that reuse occurs."""
    front, second = pair(spark, sf)
    near, far = spans(front, second, 4)
    return curve.unique_contracts(near.withColumn("series", F.lit(0)).unionByName(far.withColumn("series", F.lit(1))))


_TAGU = "SELECT b.*, s.contract FROM {0} b ASOF JOIN (SELECT * FROM uc WHERE series = {1}) s ON b.symbol = s.symbol AND CAST(b.ts_event AS DATE) >= s.d0 WHERE CAST(b.ts_event AS DATE) < s.d1"


def _tagged(front: str = "front", second: str = "second") -> str:
    return _unique_sql() + f", nt AS ({_TAGU.format(front, 0)}), rt AS ({_TAGU.format(second, 1)})"


_SECOND = """, pz AS (SELECT symbol, ts_init, contract, arg_min(close, p) AS now FROM (SELECT symbol, ts_init, contract, close, 0 AS p FROM rt UNION ALL SELECT symbol, ts_init, contract, close, 1 FROM nt) WHERE close > 0 GROUP BY ALL),
hd AS (SELECT symbol, ts_init, lag(contract) OVER w AS contract, lag(close) OVER w AS before FROM rt WINDOW w AS (PARTITION BY symbol ORDER BY ts_init)),
snr AS (SELECT symbol, ts_init, now / before - 1 AS second_return FROM hd JOIN pz USING (symbol, ts_init, contract) WHERE before > 0)"""


@query("symbol:s ts_init:t second_return:6", CURVE + _tagged() + _SECOND + " SELECT * FROM snr")
def second_nearby_return(spark, sf):
    return curve.second_nearby_return(*market(spark, sf))


@query("symbol:s ts_init:t carry:6 second_return:6", CURVE + _tagged() + _SECOND + _CARRY + " SELECT * FROM carry FULL JOIN snr USING (symbol, ts_init)")
def curve_features(spark, sf):
    everything = market(spark, sf)
    return curve.curve_features(curve.roll_yield(*everything), curve.second_nearby_return(*everything))


_SCHED = """, cb AS (SELECT symbol, contract, ts_init, arg_min(ts_event, p) AS ts_event, arg_min(open, p) AS open, arg_min(high, p) AS high, arg_min(low, p) AS low, arg_min(close, p) AS close, arg_min(volume, p) AS volume
  FROM (SELECT * EXCLUDE (p), p FROM (SELECT *, 0 AS p FROM nt UNION ALL SELECT *, 1 AS p FROM rt)) GROUP BY symbol, contract, ts_init),
od AS (SELECT symbol, contract, min(ts_init) AS switch FROM nt GROUP BY ALL),
oc AS (SELECT *, row_number() OVER w AS pos, lag(contract) OVER w AS old FROM od WINDOW w AS (PARTITION BY symbol ORDER BY switch)),
shc AS (SELECT o.symbol, o.pos, list(a.ts_init ORDER BY a.ts_init) AS l FROM oc o JOIN cb a ON a.symbol = o.symbol AND a.contract = o.contract AND a.volume > 0
  JOIN cb b ON b.symbol = o.symbol AND b.contract = o.old AND b.ts_init = a.ts_init AND b.volume > 0 WHERE a.ts_init < o.switch GROUP BY ALL),
ch AS (SELECT oc.symbol, oc.pos, oc.contract, coalesce(l, []) AS l FROM oc LEFT JOIN shc ON shc.symbol = oc.symbol AND shc.pos = oc.pos),
wk AS (SELECT symbol, pos, contract, 0 AS seq, CAST(NULL AS TIMESTAMP) AS start_ts, false AS broken, true AS fresh FROM ch WHERE pos = 1
 UNION ALL SELECT symbol, pos, contract, CASE WHEN len(c) > 0 THEN seq + 1 ELSE seq END, CASE WHEN len(c) > 0 THEN c[greatest(len(c) - 5, 0) + 1] ELSE start_ts END,
  broken OR (len(c) = 0 AND seq > 0), len(c) = 0 AND seq = 0
 FROM (SELECT ch.symbol, ch.pos, ch.contract, wk.seq, wk.start_ts, wk.broken, list_filter(ch.l, lambda x: wk.start_ts IS NULL OR x > wk.start_ts) AS c FROM wk JOIN ch ON ch.symbol = wk.symbol AND ch.pos = wk.pos + 1) s),
sched AS (SELECT symbol, seq, contract AS instrument_id, start_ts, lead(start_ts) OVER (PARTITION BY symbol ORDER BY seq) AS end_ts FROM wk
 WHERE pos >= (SELECT max(pos) FROM wk k WHERE k.symbol = wk.symbol AND k.fresh))"""


@query("symbol:s seq:i instrument_id:s start_ts:t end_ts:t", CURVE + _tagged() + _SCHED + " SELECT * FROM sched")
def calendar_roll(spark, sf):
    return curve.require_ok(curve.calendar_roll(*market(spark, sf))[1])


@query("symbol:s ts:t old:s new:s", CURVE + _tagged() + _SCHED + " SELECT symbol, start_ts AS ts, old, instrument_id AS new FROM (SELECT *, lag(instrument_id) OVER (PARTITION BY symbol ORDER BY seq) AS old FROM sched) WHERE old IS NOT NULL")
def roll_list(spark, sf):
    return curve.roll_list(curve.calendar_roll(*market(spark, sf))[1])


@query("symbol:s ts_init:t instrument_id:s seq:i close:8", CURVE + _tagged() + _SCHED + """ SELECT cb.symbol, ts_init, instrument_id, seq, close FROM cb JOIN sched s ON s.symbol = cb.symbol AND s.instrument_id = cb.contract
 WHERE (start_ts IS NULL OR ts_init >= start_ts) AND (end_ts IS NULL OR ts_init <= end_ts)""")
def active_bars(spark, sf):
    bars, schedule = curve.calendar_roll(*market(spark, sf))
    return curve.active_bars(bars.withColumnRenamed("contract", "instrument_id"), schedule, keep_roll_out=True)


_ADJ = """, rl AS (SELECT symbol, seq, start_ts, instrument_id, lag(instrument_id) OVER (PARTITION BY symbol ORDER BY seq) AS old FROM sched),
ra AS (SELECT rl.symbol, rl.seq, (SELECT arg_max(close, ts_init) FROM cb WHERE cb.symbol = rl.symbol AND cb.contract = rl.instrument_id AND ts_init <= start_ts)
  / (SELECT arg_max(close, ts_init) FROM cb WHERE cb.symbol = rl.symbol AND cb.contract = rl.old AND ts_init <= start_ts) AS ratio FROM rl WHERE old IS NOT NULL),
sl AS (SELECT s.*, coalesce(exp(sum(ln(ratio)) OVER (PARTITION BY s.symbol ORDER BY s.seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS scale FROM sched s LEFT JOIN ra USING (symbol, seq)),
adj AS (SELECT cb.symbol, cb.ts_event, cb.ts_init, s.instrument_id, open * scale AS open, high * scale AS high, low * scale AS low, close * scale AS close, volume
 FROM cb JOIN sl s ON s.symbol = cb.symbol AND s.instrument_id = cb.contract WHERE (start_ts IS NULL OR ts_init >= start_ts) AND (end_ts IS NULL OR ts_init < end_ts))"""


def adjusted(spark, sf):
    bars, schedule = curve.calendar_roll(*market(spark, sf))
    return curve.back_adjust(bars.withColumnRenamed("contract", "instrument_id"), store_once(schedule))


@query("symbol:s ts_init:t instrument_id:s log_open:8 log_close:8 volume:2", CURVE + _tagged() + _SCHED + _ADJ + " SELECT *, ln(open) AS log_open, ln(close) AS log_close FROM adj")
def back_adjust(spark, sf):
    return adjusted(spark, sf).withColumns({"log_open": F.log("open"), "log_close": F.log("close")})


@query("symbol:s ts_init:t ret:6", CURVE + _tagged() + _SCHED + _ADJ + ", hr AS (SELECT symbol, ts_init, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_init) - 1 AS ret FROM adj) SELECT * FROM hr WHERE ret IS NOT NULL")
def held_returns(spark, sf):
    return curve.held_returns(adjusted(spark, sf))


def _clean_sql(t: str) -> str:
    return f""", {t}_a AS (SELECT * REPLACE (CASE WHEN open <= 0 THEN close ELSE open END AS open) FROM {t} WHERE isodow(ts_event) <= 5 AND close > 0),
{t}_b AS (SELECT * REPLACE (greatest(high, open, close) AS high, CASE WHEN low <= 0 THEN least(open, close) ELSE low END AS low) FROM {t}_a),
{t}_n AS (SELECT *, lag(close) OVER w AS p, lead(close) OVER w AS n FROM {t}_b WINDOW w AS (PARTITION BY symbol ORDER BY ts_init)),
{t}_c AS (SELECT * EXCLUDE (p, n) FROM {t}_n WHERE NOT coalesce((close > p * 3 AND close > n * 3) OR (close < p / 3 AND close < n / 3), false))"""


_LOAD = (CURVE + _clean_sql("front") + _clean_sql("second") + _tagged("front_c", "second_c") + _SECOND + _SCHED + _ADJ
         + _CARRY.replace("FROM front WHERE", "FROM front_c WHERE").replace("FROM second WHERE", "FROM second_c WHERE"))


@query("symbol:s ts_init:t instrument_id:s log_close:8 carry:6 second_return:6", _LOAD + " SELECT adj.*, ln(close) AS log_close, carry, second_return FROM adj LEFT JOIN carry USING (symbol, ts_init) LEFT JOIN snr USING (symbol, ts_init)")
def load_rolled(spark, sf):
    """Clean, roll, splice and attach curve features, for every root in one plan."""
    return curve.load_rolled(*market(spark, sf)).withColumn("log_close", F.log("close"))


# -- outrights ---------------------------------------------------------------------------

_OUT = REGION + """, ct AS (SELECT symbol, date_trunc('quarter', ts) + (l_orderkey % 3)::INT * INTERVAL 3 MONTH AS q, date_trunc('day', ts) + INTERVAL 1 DAY AS ts_init, arg_max(price, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close, sum(size) AS volume
  FROM bars_ticks GROUP BY ALL),
ob AS (SELECT symbol, substr(symbol, 1, 2) || substr('HMUZ', quarter(q)::INT, 1) || (year(q) % 100) AS instrument_id, q + INTERVAL 2 MONTH + INTERVAL 14 DAY AS expiry, ts_init, close, volume FROM ct),
od AS (SELECT symbol, instrument_id, expiry, max(ts_init) AS stop, row_number() OVER (PARTITION BY symbol ORDER BY expiry, instrument_id) AS rank FROM ob GROUP BY symbol, instrument_id, expiry),
orr AS (SELECT ob.*, od.rank FROM ob JOIN od USING (symbol, instrument_id)),
due AS (SELECT c.symbol, c.rank AS a, x.ts_init, {pick} AS best, max(x.volume) AS bv, any_value(c.expiry) AS expiry, any_value(c.stop) AS stop
  FROM od c JOIN orr x ON x.symbol = c.symbol AND x.rank > c.rank GROUP BY c.symbol, c.rank, x.ts_init),
dn AS (SELECT due.* FROM due LEFT JOIN orr h ON h.symbol = due.symbol AND h.rank = due.a AND h.ts_init = due.ts_init
  WHERE {cond} AND (h.rank IS NOT NULL OR due.ts_init > due.stop)),
f0 AS (SELECT symbol, min(ts_init) AS ts FROM orr GROUP BY symbol),
wk AS (SELECT symbol, 0 AS seq, arg_max(rank, row(volume, -rank)) AS rank, CAST(NULL AS TIMESTAMP) AS start_ts, any_value(f0.ts) AS at FROM orr JOIN f0 USING (symbol) WHERE ts_init = f0.ts GROUP BY symbol
  UNION ALL SELECT w.symbol, w.seq + 1, arg_min(d.best, d.ts_init), min(d.ts_init), min(d.ts_init) FROM wk w JOIN dn d ON d.symbol = w.symbol AND d.a = w.rank AND d.ts_init > w.at GROUP BY w.symbol, w.seq)
SELECT wk.symbol, seq, instrument_id, start_ts, lead(start_ts) OVER (PARTITION BY wk.symbol ORDER BY seq) AS end_ts FROM wk JOIN od ON od.symbol = wk.symbol AND od.rank = wk.rank"""
_OUT_VOLUME = _OUT.format(pick="arg_max(x.rank, row(x.volume, -x.rank))", cond="bv > coalesce(h.volume, -1)")
_OUT_CALENDAR = _OUT.format(pick="min(x.rank)", cond="due.ts_init >= due.expiry - INTERVAL 8 DAY")


def outright_bars(spark, sf):
    ticks = src.region_ticks(spark, sf)
    quarter = F.add_months(F.trunc("ts", "quarter"), ((F.col("l_orderkey") % 3) * 3).cast("int"))
    letter = F.element_at(F.array(*[F.lit(c) for c in "HMUZ"]), F.quarter("q"))
    named = ticks.withColumn("q", quarter).withColumn(
        "instrument_id", F.concat(F.substring("symbol", 1, 2), letter, (F.year("q") % 100).cast("string"))
    )
    moment = F.struct(*src._LINE)
    bars = named.groupBy("symbol", "instrument_id", "q", F.date_trunc("day", "ts").alias("ts_event")).agg(
        F.max_by("price", moment).alias("close"), F.sum("size").alias("volume")
    ).withColumn("ts_init", F.col("ts_event") + F.expr("INTERVAL 1 DAY"))
    bars = store_once(bars)  # read by every step of a schedule and a splice: ticks are aggregated once
    expiry = (F.date_add(F.add_months("q", 2), 14)).cast("timestamp")
    contracts = bars.select("symbol", "instrument_id", expiry.alias("expiry"), F.substring("instrument_id", 3, 1).alias("month")).distinct()
    return bars.drop("q"), contracts


@query("symbol:s seq:i instrument_id:s start_ts:t end_ts:t", _OUT_VOLUME)
def roll_schedule_volume(spark, sf):
    return curve.roll_schedule(*outright_bars(spark, sf), method="volume")


@query("symbol:s seq:i instrument_id:s start_ts:t end_ts:t", _OUT_CALENDAR)
def roll_schedule_calendar(spark, sf):
    return curve.roll_schedule(*outright_bars(spark, sf), method="calendar", days_before=8)


@query("symbol:s seq:i instrument_id:s start_ts:t end_ts:t", _OUT_VOLUME.replace("FROM ct),\n", "FROM ct WHERE quarter(q) IN (1, 3)),\n", 1))
def roll_schedule_months(spark, sf):
    """Only contracts of two delivery months."""
    return curve.roll_schedule(*outright_bars(spark, sf), method="volume", months="HU")


def parent(spark, sf):
    bars, contracts = outright_bars(spark, sf)
    instruments = contracts.select(
        F.substring("instrument_id", 1, 2).alias("underlying"), F.col("instrument_id").alias("raw_symbol"),
        "instrument_id", F.lit("XR").alias("venue"), "expiry",
    )
    whole = bars.withColumns({c: F.col("close") for c in ("open", "high", "low")}).drop("symbol")
    return whole, instruments


@query("symbol:s ts_init:t instrument_id:s log_close:8", _OUT_VOLUME.replace("SELECT wk.symbol, seq, instrument_id", ", sched AS (SELECT wk.symbol, seq, instrument_id") + """),
cb AS (SELECT symbol, instrument_id AS contract, ts_init, ts_init AS ts_event, close AS open, close AS high, close AS low, close, volume FROM ob)""" + _ADJ
       + " SELECT substr(symbol, 1, 2) || '.FUT' AS symbol, ts_init, instrument_id, ln(close) AS log_close FROM adj")
def load_parent(spark, sf):
    return curve.load_parent(*parent(spark, sf)).withColumn("log_close", F.log("close"))


@query("underlying:s instrument_id:s expiry:t expiry_rank:i", _OUT_VOLUME.split("orr AS")[0].rstrip().rstrip(",") + " SELECT substr(symbol, 1, 2) AS underlying, instrument_id, expiry, rank AS expiry_rank FROM od")
def outrights(spark, sf):
    _, instruments = parent(spark, sf)
    spreads = instruments.withColumns({
        "raw_symbol": F.concat("raw_symbol", F.lit("-"), "raw_symbol"), "instrument_id": F.concat("instrument_id", F.lit("-S")), "expiry": F.lit(None).cast("timestamp"),
    })
    return curve.outrights(instruments.unionByName(spreads))


@query("tradable:s pos:i", "SELECT s.tradable, min(pos) AS pos FROM (SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN substr(p_brand, 1, 1) || '.FUT' ELSE p_brand END AS tradable FROM part) s GROUP BY 1")
def tradable_symbols(spark, sf):
    part = src.table(spark, sf, "part").withColumn("even", F.col("p_partkey") % 2 == 0)
    name = F.when(F.col("even"), F.concat("p_brand", F.lit("H5"))).otherwise(F.col("p_brand"))
    series = part.select(name.alias("symbol"), F.col("p_partkey").alias("pos"))
    instruments = part.where("even").select(name.alias("raw_symbol"), F.substring("p_brand", 1, 1).alias("underlying")).distinct()
    return curve.tradable_symbols(series, instruments)


@query("symbol:s", """WITH b AS (SELECT DISTINCT replace(p_brand, '#', '') AS root, p_size % 3 AS rank, substr(p_type, 1, 2) AS venue FROM part), k AS (SELECT a.root, a.venue FROM b a JOIN b c USING (root, venue) WHERE a.rank = 0 AND c.rank = 1)
SELECT root || '.ROLL' AS symbol FROM k UNION SELECT root || '.' || venue || '.ROLL' FROM k""")
def available_rolled(spark, sf):
    part = src.table(spark, sf, "part")
    name = F.concat(F.translate("p_brand", "#", ""), F.lit(".c."), (F.col("p_size") % 3).cast("string"))
    return curve.available_rolled(part.select(name.alias("symbol"), F.substring("p_type", 1, 2).alias("venue")).distinct())


@query("symbol:s contract:s activation:t expiry:t multiplier:2 tick:4 currency:s", CURVE + f", ft AS ({_TAG.format('front', 'fspans')})" + """ SELECT symbol, contract, min(ts_event) - INTERVAL 1 DAY AS activation, max(ts_init) + INTERVAL 1 DAY AS expiry,
 10 AS multiplier, CASE WHEN symbol = 'ASIA' THEN 0.25 ELSE 0.01 END AS tick, 'USD' AS currency FROM ft GROUP BY symbol, contract""")
def synthetic_outright(spark, sf):
    front, _, near, _ = market(spark, sf)
    terms = src.table(spark, sf, "region").select(
        F.col("r_name").alias("underlying"), F.lit(10.0).alias("multiplier"), F.lit(0.25).alias("tick"),
        F.when(F.col("r_name") == "ASIA", F.lit("USD")).otherwise(F.lit("GBP")).alias("currency"),
    )
    return curve.synthetic_outright(curve.tag_contracts(front, near), terms, "USD")


# The front contract flickers: every seventh bar shows the second month instead.
_FLICKER = CURVE + _unique_sql() + f""", fk AS (SELECT n.symbol, n.ts_init, CASE WHEN n.i % 7 = 0 THEN s.contract ELSE n.contract END AS contract, row_number() OVER (PARTITION BY n.symbol ORDER BY n.ts_init) AS k
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_init) - 1 AS i FROM ({_TAGU.format('front', 0)}) z) n ASOF JOIN (SELECT * FROM uc WHERE series = 1) s ON s.symbol = n.symbol AND CAST(n.ts_event AS DATE) >= s.d0),
fo AS (SELECT *, (CASE WHEN year_of < listed THEN year_of + 10 ELSE year_of END) * 12 + instr('FGHJKMNQUVXZ', substr(contract, 3, 1)) AS o FROM
 (SELECT *, CAST(split_part(contract, '_', 2) AS INT) AS listed, CAST(split_part(contract, '_', 2) AS INT) // 10 * 10 + CAST(substr(split_part(contract, '_', 1), 4) AS INT) AS year_of FROM fk) y),
hl AS (SELECT symbol, ts_init, k, contract AS held, o AS ho, 0 AS run, NULL::VARCHAR AS cand FROM fo WHERE k = 1
 UNION ALL SELECT symbol, ts_init, k, CASE WHEN nr >= 3 THEN contract ELSE held END, CASE WHEN nr >= 3 THEN o ELSE ho END, CASE WHEN nr >= 3 THEN 0 ELSE nr END, CASE WHEN nr >= 3 OR nr = 0 THEN NULL ELSE contract END
 FROM (SELECT fo.symbol, fo.ts_init, fo.k, fo.contract, fo.o, hl.held, hl.ho, CASE WHEN fo.contract <> hl.held AND fo.o > hl.ho THEN CASE WHEN fo.contract = hl.cand THEN hl.run + 1 ELSE 1 END ELSE 0 END AS nr
  FROM hl JOIN fo ON fo.symbol = hl.symbol AND fo.k = hl.k + 1) q)"""


@query("symbol:s ts_init:t held:s", _FLICKER + " SELECT symbol, ts_init, held FROM hl")
def forward_only(spark, sf):
    from ..operators.ordered import DAILY, row_index

    front, _, near, far = market(spark, sf)
    named = curve.unique_contracts(near.withColumn("series", F.lit(0)).unionByName(far.withColumn("series", F.lit(1))))
    tagged = row_index(curve.tag_contracts(front, named.where("series = 0"), name="contract"), DAILY, "i")
    other = curve.tag_contracts(front, named.where("series = 1"), name="contract").select("symbol", "ts_init", F.col("contract").alias("other"))
    shown = tagged.join(other, ["symbol", "ts_init"]).withColumn("contract", F.when(F.col("i") % 7 == 0, F.col("other")).otherwise(F.col("contract")))
    return curve.forward_only(shown.select("symbol", "ts_init", "contract"), 3)


# -- names ----------------------------------------------------------------------------------

_VARIANTS = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ES' || substr('HMUZ', quarter(o_orderdate)::INT, 1) || (year(o_orderdate) % 10)
 WHEN 1 THEN 'BRN FM' || substr('FGHJKMNQUVXZ', month(o_orderdate)::INT, 1) || '00' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') || '!'
 WHEN 2 THEN 'FGBL SI ' || strftime(o_orderdate + INTERVAL 10 YEAR, '%Y%m%d') || ' PS' ELSE o_orderstatus || ' none' END AS raw FROM orders"""


def variants(spark, sf):
    orders = src.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    key = F.col("o_orderkey") % 4
    pick = lambda text, i: F.element_at(F.array(*[F.lit(c) for c in text]), i)
    raw = (
        F.when(key == 0, F.concat(F.lit("ES"), pick("HMUZ", F.quarter(day)), (F.year(day) % 10).cast("string")))
        .when(key == 1, F.concat(F.lit("BRN FM"), pick(sym.MONTH_CODES, F.month(day)), F.lit("00"), F.lpad((F.year(day) % 100).cast("string"), 2, "0"), F.lit("!")))
        .when(key == 2, F.concat(F.lit("FGBL SI "), F.date_format(day + F.expr("INTERVAL 10 YEARS"), "yyyyMMdd"), F.lit(" PS")))
        .otherwise(F.concat("o_orderstatus", F.lit(" none")))
    )
    return orders.select("o_orderkey", day.alias("day"), raw.alias("raw"))


@query("o_orderkey:i raw:s month:s year:s modulus:s", f"WITH v AS ({_VARIANTS}), d AS (SELECT o_orderkey, o_orderdate, o_orderdate + INTERVAL 10 YEAR AS later FROM orders)" + """
SELECT v.o_orderkey, raw, CASE v.o_orderkey % 4 WHEN 0 THEN quarter(o_orderdate) * 3 WHEN 1 THEN month(o_orderdate) WHEN 2 THEN CASE WHEN year(later) >= 2000 THEN month(later) END END AS month,
 CASE v.o_orderkey % 4 WHEN 0 THEN year(o_orderdate) % 10 WHEN 1 THEN year(o_orderdate) % 100 WHEN 2 THEN CASE WHEN year(later) >= 2000 THEN year(later) END END AS year,
 CASE v.o_orderkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN CASE WHEN year(later) >= 2000 THEN 10000 END END AS modulus FROM v JOIN d USING (o_orderkey)""")
def contract_month(spark, sf):
    return variants(spark, sf).withColumn("m", sym.contract_month(F.col("raw"))).select("o_orderkey", "raw", "m.*")


@query("o_orderkey:i months:s", """SELECT o_orderkey, CASE WHEN m > 0 AND m <= 60 THEN m END AS months FROM (SELECT o_orderkey,
 ((year(far) % 10 - year(o_orderdate) % 10 + 10) % 10) * 12 + quarter(far) * 3 - quarter(o_orderdate) * 3 AS m FROM (SELECT *, o_orderdate + (o_custkey % 80)::INT * INTERVAL 1 MONTH AS far FROM orders))""")
def months_between(spark, sf):
    orders = src.table(spark, sf, "orders").withColumn("near", F.col("o_orderdate").cast("date"))
    orders = orders.withColumn("far", F.add_months("near", (F.col("o_custkey") % 80).cast("int")))
    name = lambda c: raw_name(F.lit("ES"), F.col(c))
    return orders.select("o_orderkey", sym.months_between(sym.contract_month(name("near")), sym.contract_month(name("far"))).alias("months"))


@query("o_orderkey:i ordinal:i", "SELECT o_orderkey, (CASE WHEN y < l THEN y + 10 ELSE y END) * 12 + quarter(o_orderdate) * 3 AS ordinal FROM (SELECT *, year(o_orderdate) - o_custkey % 2 AS l, (year(o_orderdate) - o_custkey % 2) // 10 * 10 + year(o_orderdate) % 10 AS y FROM orders)")
def delivery_ordinal(spark, sf):
    orders = src.table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    listed = (F.year("d") - F.col("o_custkey") % 2).cast("string")
    return orders.select("o_orderkey", sym.delivery_ordinal(F.concat_ws("_", raw_name(F.lit("ES"), F.col("d")), listed)).alias("ordinal"))


_NAMED = """SELECT p_partkey, replace(p_brand, '#', '') || CASE p_partkey % 7 WHEN 0 THEN '.ROLL' WHEN 1 THEN '.XR.VROLL' WHEN 2 THEN '.FUT' WHEN 3 THEN '.c.0' WHEN 4 THEN '.v.1' WHEN 5 THEN '.OPT' ELSE '' END AS symbol FROM part"""


def named_parts(spark, sf):
    tails = F.array(*[F.lit(t) for t in (".ROLL", ".XR.VROLL", ".FUT", ".c.0", ".v.1", ".OPT", "")])
    return src.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.translate("p_brand", "#", ""), F.element_at(tails, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("symbol")
    )


@query("p_partkey:i kind:s rule:s venue:s root:s asset_class:s", f"""WITH n AS ({_NAMED}) SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1) THEN 'rolled' WHEN p_partkey % 7 IN (2, 5) THEN 'parent' WHEN p_partkey % 7 IN (3, 4) THEN 'continuous' ELSE 'raw_symbol' END AS kind,
 CASE p_partkey % 7 WHEN 0 THEN 'c' WHEN 1 THEN 'v' END AS rule, CASE p_partkey % 7 WHEN 1 THEN 'XR' END AS venue, split_part(symbol, '.', 1) AS root, split_part(symbol, '.', 1) AS asset_class FROM n""")
def symbol_kind(spark, sf):
    s = F.col("symbol")
    rolled = sym.symbol_kind(s) == "rolled"
    return named_parts(spark, sf).select(
        "p_partkey", sym.symbol_kind(s).alias("kind"), sym.rolled_rule(s).alias("rule"),
        F.when(rolled, sym.rolled_venue(s)).alias("venue"), sym.root_of(s).alias("root"), sym.asset_class(s).alias("asset_class"),
    )


@query("report:s asset_group:s", f"WITH n AS ({_NAMED}) SELECT 'r' || (p_partkey % 5) AS report, CASE WHEN avg((p_partkey % 7 IN (0, 2, 3, 4))::INT) > 0.5 THEN 'futures' ELSE 'equities' END AS asset_group FROM n GROUP BY 1")
def asset_group(spark, sf):
    parts = named_parts(spark, sf).withColumn("symbol", F.regexp_replace("symbol", r"\.VROLL$", ".OPT"))
    return sym.asset_group(parts.withColumn("report", F.concat(F.lit("r"), F.col("p_partkey") % 5)), ["report"])


_ROOTS = ", ".join(f"('{r}', '{c}')" for c, rs in sym.CLASS_ROOTS.items() for r in rs)


@query("o_orderkey:i asset_class:s", f"WITH k(root, cls) AS (VALUES {_ROOTS}), o AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN chr((65 + o_orderkey % 26)::INT) ELSE 'Z' || chr((65 + o_orderkey % 26)::INT) END AS root FROM orders) SELECT o_orderkey, coalesce(cls, o.root) AS asset_class FROM o LEFT JOIN k USING (root)")
def asset_class(spark, sf):
    letter = F.char(65 + F.col("o_orderkey") % 26)
    root = F.when(F.col("o_custkey") % 3 == 0, letter).otherwise(F.concat(F.lit("Z"), letter))
    return src.table(spark, sf, "orders").select("o_orderkey", sym.asset_class(F.concat(root, F.lit(".ROLL"))).alias("asset_class"))


@query("o_orderkey:i schema:s", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'ohlcv-1d' WHEN 1 THEN 'ohlcv-1h' WHEN 2 THEN 'ohlcv-1m' WHEN 3 THEN 'trades' WHEN 4 THEN 'ohlcv-1s' END AS schema FROM orders""")
def resolve_schema(spark, sf):
    given = F.array(*[F.lit(x) for x in ("Daily", " 1h", "min", "TRADES", "ohlcv-1s", "fortnight")])
    return src.table(spark, sf, "orders").select("o_orderkey", sym.resolve_schema(F.element_at(given, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("schema"))


@query("o_orderkey:i instrument_id:s code:s", f"WITH v AS ({_VARIANTS}) SELECT o_orderkey, 'XEUR_' || trim(regexp_replace(raw, '[^A-Za-z0-9_]+', '_', 'g'), '_') || '.SIM' AS instrument_id, CASE WHEN o_orderkey % 4 = 0 THEN substr(raw, 3, 1) END AS code FROM v")
def rehome(spark, sf):
    return variants(spark, sf).select(
        "o_orderkey", sym.rehomed(F.col("raw"), "XEUR", "SIM").alias("instrument_id"), sym.month_code(F.col("raw"), F.lit("ES")).alias("code")
    )


@query("o_orderkey:i venue:s", "SELECT o_orderkey, 'X' || substr(o_orderpriority, 3) AS venue FROM orders")
def default_venue(spark, sf):
    """Venue that a vendor's dataset name begins with."""
    dataset = F.concat(F.lit("X"), F.expr("substring(o_orderpriority, 3)"), F.lit(".A.B"))
    return src.table(spark, sf, "orders").select("o_orderkey", sym.default_venue(dataset).alias("venue"))


@query("symbol:s instrument_id:s ts:t at:5", REGION + """, x AS (SELECT symbol, symbol || (year(ts_init) % 2) AS instrument_id, ts_init, close FROM bars),
m AS (SELECT DISTINCT symbol, instrument_id, ts_init + INTERVAL 36 HOUR AS ts FROM x WHERE day(ts_init) % 9 = 0) SELECT m.*, x.close AS at FROM m ASOF JOIN x ON m.symbol = x.symbol AND m.instrument_id = x.instrument_id AND m.ts >= x.ts_init""")
def close_at(spark, sf):
    """Last close of a contract at or before a moment between two bars."""
    bars = src.region_bars(spark, sf).withColumn("instrument_id", F.concat("symbol", (F.year("ts_init") % 2).cast("string")))
    moments = bars.where(F.day("ts_init") % 9 == 0).select("symbol", "instrument_id", (F.col("ts_init") + F.expr("INTERVAL 36 HOURS")).alias("ts"))
    return curve.close_at(bars, moments.distinct(), "at")


# -- currency ------------------------------------------------------------------------------------

_FX = """, fx AS (SELECT CAST(o_orderdate AS DATE) - 20 AS d, 1.1 + (avg(o_totalprice) / 250000 - 1) / 100000 AS rate FROM orders WHERE day(o_orderdate) % 3 <> 0 GROUP BY 1)"""


@query("symbol:s ts_init:t open:5 high:5 low:5 close:5", REGION + _FX + """, fb AS (SELECT b.*, fx.rate AS x FROM bars b ASOF JOIN fx ON CAST(b.ts_event AS DATE) >= fx.d),
fp AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts_init) AS p FROM fb),
fu AS (SELECT *, sum(coalesce((close - p) * x, close * x)) OVER (PARTITION BY symbol ORDER BY ts_init) AS usd FROM fp),
fw AS (SELECT *, lag(usd) OVER (PARTITION BY symbol ORDER BY ts_init) AS was FROM fu)
SELECT symbol, ts_init, coalesce(was + (open - p) * x, open * x) AS open, coalesce(was + (high - p) * x, high * x) AS high, coalesce(was + (low - p) * x, low * x) AS low, usd AS close FROM fw""")
def asof_fx_to_usd(spark, sf):
    return curve.to_usd(src.region_bars(spark, sf), daily_rates(spark, sf))


def daily_rates(spark, sf):
    orders = src.table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return orders.where(F.day("d") % 3 != 0).groupBy(F.date_sub("d", 20).alias("date")).agg(
        (1.1 + (F.avg("o_totalprice") / 250000 - 1) / 100000).alias("rate")
    )


@query("symbol:s d0:d d1:d raw_symbol:s", CURVE + """, ids AS (SELECT symbol, hash(raw_symbol) AS i, d0 + 15 AS d0, d1 + 20 AS d1 FROM fspans), raws AS (SELECT hash(raw_symbol) AS i, raw_symbol, d0, d1 + 60 AS d1 FROM sspans)
SELECT symbol, greatest(ids.d0, raws.d0) AS d0, least(ids.d1, raws.d1) AS d1, raw_symbol FROM ids JOIN raws USING (i) WHERE greatest(ids.d0, raws.d0) < least(ids.d1, raws.d1)""")
def resolve_spans(spark, sf):
    _, _, near, far = market(spark, sf)
    ids = near.select("symbol", F.col("raw_symbol").alias("instrument_id"), F.date_add("d0", 15).alias("d0"), F.date_add("d1", 20).alias("d1"))
    return curve.resolve_spans(ids, far.select(F.col("raw_symbol").alias("instrument_id"), "raw_symbol", "d0", F.date_add("d1", 60).alias("d1")))


# -- composed loads ---------------------------------------------------------------------------

_FORWARD = ", fk AS (SELECT symbol, ts_init, contract, row_number() OVER (PARTITION BY symbol ORDER BY ts_init) AS k FROM nt),\nfz AS" + _FLICKER.split("\nfo AS", 1)[1].replace("FROM fo ", "FROM fz ").replace("fo.", "fz.").replace("JOIN fo ", "JOIN fz ")
_LOAD_VOLUME = (
    CURVE + _clean_sql("front") + _clean_sql("second") + _tagged("front_c", "second_c") + _FORWARD
    + _SCHED.replace("SELECT symbol, contract, min(ts_init) AS switch FROM nt", "SELECT symbol, held AS contract, min(ts_init) AS switch FROM hl") + _ADJ
    + _CARRY.replace("FROM front WHERE", "FROM front_c WHERE").replace("FROM second WHERE", "FROM second_c WHERE")
)


@query("symbol:s ts_init:t instrument_id:s log_close:8 carry:6", _LOAD_VOLUME + " SELECT adj.*, ln(close) AS log_close, carry FROM adj LEFT JOIN carry USING (symbol, ts_init)")
def load_rolled_volume(spark, sf):
    """Rolls where the front series has moved on for good, with carry only."""
    return curve.load_rolled(*market(spark, sf), only_forward=True).withColumn("log_close", F.log("close"))


_QUOTED = """, fb AS (SELECT c.*, fx.rate AS x FROM cb c ASOF JOIN fx ON CAST(c.ts_event AS DATE) >= fx.d),
fp AS (SELECT *, lag(close) OVER (PARTITION BY symbol, contract ORDER BY ts_init) AS p FROM fb),
fu AS (SELECT *, sum(coalesce((close - p) * x, close * x)) OVER (PARTITION BY symbol, contract ORDER BY ts_init) AS usd FROM fp),
fw AS (SELECT *, lag(usd) OVER (PARTITION BY symbol, contract ORDER BY ts_init) AS was FROM fu),
ub AS (SELECT symbol, contract, ts_event, ts_init, coalesce(was + (open - p) * x, open * x) AS open, coalesce(was + (high - p) * x, high * x) AS high, coalesce(was + (low - p) * x, low * x) AS low, usd AS close, volume FROM fw)"""
_LOAD_USD = (
    CURVE + _clean_sql("front") + _clean_sql("second") + _tagged("front_c", "second_c") + _SECOND + _SCHED + _FX + _QUOTED + re.sub(r"\bcb\b", "ub", _ADJ)
    + _CARRY.replace("FROM front WHERE", "FROM front_c WHERE").replace("FROM second WHERE", "FROM second_c WHERE")
)


@query("symbol:s ts_init:t instrument_id:s log_close:6 carry:6 second_return:6", _LOAD_USD + """ SELECT adj.* EXCLUDE (instrument_id), 'XS_' || regexp_replace(instrument_id, '\\W', '_', 'g') || '.XT' AS instrument_id, ln(close) AS log_close, carry, second_return
 FROM adj LEFT JOIN carry USING (symbol, ts_init) LEFT JOIN snr USING (symbol, ts_init)""")
def load_rolled_usd(spark, sf):
    """Contracts re-quoted at daily rates before the splice, at another venue's names, all bars a day long."""
    loaded = curve.load_rolled(*market(spark, sf), fx=daily_rates(spark, sf), home=("XS", "XT"), seconds=86_400)
    return loaded.withColumn("log_close", F.log("close"))
