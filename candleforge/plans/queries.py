"""Registered queries over the synthetic tables, each with the DuckDB SQL it must equal."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.functions import labels, timez
from candleforge.operators import export, health, inventory, normalize, report, sessions
from candleforge.operators.profile import FULL, FULL_DAY, GREEN, ORANGE, REG_ONLY, YELLOW
from candleforge.operators.reconcile import cap_rows, keep_last, merge_sessions, upsert, with_fallback
from candleforge.operators.schemas import empty_candles
from candleforge.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str]] = {}

#: The synthetic ticks are sparse (about two per user and day), so sessions and heat are graded on their scale.
SPARSE = FULL.scaled(
    {"PRE": 15, "REG": 15, "POST": 10},
    {"Total": ((72, GREEN), (60, YELLOW), (55, ORANGE)), "PRE": ((18, GREEN), (12, YELLOW)), "REG": ((20, GREEN), (15, YELLOW)), "POST": ((12, GREEN), (8, YELLOW))},
)
START, END = dt.date(2024, 1, 3), dt.date(2024, 1, 8)
NOW = dt.datetime(1998, 3, 15, 12, 0)

_ET = "timezone('US/Eastern', timezone('UTC', {0}))"
_TAG = """CASE WHEN m >= 240 AND m < 570 THEN 'PRE' WHEN m >= 570 AND m < 960 THEN 'REG' WHEN m >= 960 AND m < 1200 THEN 'POST' END"""
_BARS = f"""bars0 AS (SELECT date_trunc('minute', ts) AS "timestamp", 'SYM' || user_id AS symbol, event_type, ts, value, event_id,
    CASE WHEN event_type IN ('click', 'view') AND user_id % 8 <> 5 THEN 'primary' ELSE 'fallback' END AS source,
    hour({_ET.format("ts")}) * 60 + minute({_ET.format("ts")}) AS m FROM events),
  bars AS (SELECT *, {_TAG} AS session FROM bars0)"""
_MAP = """symbol_map AS (SELECT 'SYM' || c_custkey AS user_ticker, 'EPIC' || c_custkey AS capital_epic,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'CAPITAL_ONLY' ELSE 'HYBRID' END AS source_strategy FROM customer WHERE c_custkey % 10 <> 0)"""


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _QUERIES.items()}


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.table(spark, sf, "events")


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """Raw bars with the event type as symbol: five dense series."""
    return fixtures.raw_bars(_events(spark, sf), F.col("event_type"))


def _map(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.symbol_map(fixtures.table(spark, sf, "customer"))


_HEALTH = """SELECT event_type AS symbol, CAST(ts AS DATE) AS trade_day, count(*) AS candle_count FROM events
WHERE event_type IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09' GROUP BY ALL"""


@register("health_long", _HEALTH)
def health_long(spark: SparkSession, sf: str) -> DataFrame:
    bars = _events(spark, sf).select(F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"))
    return health.health_long(bars, ["click", "purchase"], START, END).withColumnRenamed("day", "trade_day")


@register("health_all_symbols", "SELECT event_type AS symbol, CAST(ts AS DATE) AS trade_day, count(*) AS candle_count FROM events GROUP BY ALL ORDER BY 1, 2")
def health_all(spark: SparkSession, sf: str) -> DataFrame:
    bars = _events(spark, sf).select(F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"))
    return health.health_long(bars, None).withColumnRenamed("day", "trade_day").orderBy("symbol", "trade_day")


def _by_session(session: str) -> None:
    sql = f"""WITH {_BARS} SELECT event_type AS symbol, CAST("timestamp" AS DATE) AS trade_day, count(*) AS candle_count
FROM bars WHERE session = '{session}' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09' GROUP BY ALL"""

    @register(f"health_session_{session.lower()}", sql)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return health.health_long(_typed(spark, sf), None, START, END, session).withColumnRenamed("day", "trade_day")


for _s in ("PRE", "REG", "POST"):
    _by_session(_s)

_DAYS = health.days_between(START, END)
_COLUMNS = ", ".join(f"""nullif(count(*) FILTER (CAST(ts AS DATE) = DATE '{d}'), 0) AS "{d}\"""" for d in _DAYS)


@register("health_matrix", f"SELECT 'SYM' || user_id AS symbol, {_COLUMNS} FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09' GROUP BY ALL")
def health_matrix(spark: SparkSession, sf: str) -> DataFrame:
    long = health.health_long(fixtures.raw_bars(_events(spark, sf)), None, START, END)
    return health.health_matrix(long, _DAYS)


@register("health_unpivot", "SELECT 'SYM' || user_id AS symbol, CAST(ts AS DATE) AS trade_day, count(*) AS candle_count FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09' GROUP BY ALL")
def health_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return health.unpivot_matrix(health_matrix(spark, sf)).withColumnRenamed("day", "trade_day")


def _heat(filter_: str) -> None:
    steps = " ".join(f"WHEN candle_count > {n} THEN '{c}'" for n, c in SPARSE.heat[filter_])
    where = "" if filter_ == "Total" else f"WHERE session = '{filter_}'"
    sql = f"""WITH {_BARS}, long AS (SELECT event_type AS symbol, CAST("timestamp" AS DATE) AS trade_day, count(*) AS candle_count FROM bars {where} GROUP BY ALL)
SELECT *, CASE {steps} ELSE '#5E2828' END AS colour, CAST(candle_count AS VARCHAR) AS "text" FROM long"""

    @register(f"heat_{filter_.lower()}", sql)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        long = health.health_long(_typed(spark, sf), None, session_filter=filter_)
        return health.graded(long, filter_, SPARSE).withColumnRenamed("day", "trade_day")


for _f in ("Total", "PRE", "REG", "POST"):
    _heat(_f)

_CANDLES = f"""WITH {_BARS} SELECT "timestamp", symbol, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (ts, event_id)) AS close, round(sum(value), 2) AS volume, session FROM bars GROUP BY "timestamp", symbol, session"""


@register("minute_candles", _CANDLES)
def minute_candles(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.candles(_events(spark, sf))


@register("rth_filter", f"SELECT event_id, ts, value FROM events WHERE CAST({_ET.format('ts')} AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00'")
def rth_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).where(timez.in_regular_hours("ts")).select("event_id", "ts", "value")


@register("rth_filter_one_day", "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-04 14:30:00' AND TIMESTAMP '2024-01-04 21:00:00'")
def rth_one_day(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.within(_events(spark, sf), dt.date(2024, 1, 4), FULL.sessions[1], "ts").select("event_id", "ts", "value")


@register("session_tag", f"WITH {_BARS} SELECT event_id, symbol, session FROM bars")
def session_tag(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.raw_bars(_events(spark, sf)).select("event_id", "symbol", "session")


@register("session_windows", """SELECT * FROM (VALUES ('PRE', TIMESTAMP '2024-07-05 08:00:00', TIMESTAMP '2024-07-05 13:30:00', 330, 0),
 ('REG', TIMESTAMP '2024-07-05 13:30:00', TIMESTAMP '2024-07-05 20:00:00', 390, 1), ('POST', TIMESTAMP '2024-07-05 20:00:00', TIMESTAMP '2024-07-06 00:00:00', 240, 2)) t(session, start_utc, end_utc, expected, priority)""")  # fmt: skip
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.window_relation(spark, dt.date(2024, 7, 5), FULL_DAY)


@register("session_counts", f"""WITH {_BARS} SELECT symbol, count(*) FILTER (session = 'PRE') AS pre, count(*) FILTER (session = 'REG') AS reg,
 count(*) FILTER (session = 'POST') AS post, count(DISTINCT "timestamp") AS total FROM bars GROUP BY symbol""")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.session_counts(fixtures.raw_bars(_events(spark, sf)))


def _report(mode: str) -> tuple[str, str]:
    active = {s.name: s for s in SPARSE.active(mode)}
    gaps = ", ".join(f"""CASE WHEN "{s.label}" < {s.expected} * 0.9 THEN '{s.label}' END""" for s in active.values())
    wanted = ", ".join(f"'{s}'" for s in active)
    sql = f"""WITH {_BARS}, {_MAP}, parts AS (SELECT * FROM bars WHERE session IN ({wanted})),
chosen AS (SELECT user_ticker, source_strategy FROM symbol_map),
counts AS (SELECT symbol, count(*) FILTER (session = 'PRE') AS "Pre", count(*) FILTER (session = 'REG') AS "Reg", count(*) FILTER (session = 'POST') AS "Post",
 count(DISTINCT "timestamp") AS "Total", count(*) FILTER (session = 'REG' AND source = 'primary') AS p, count(*) FILTER (session = 'REG' AND source = 'fallback') AS f FROM parts GROUP BY symbol),
j AS (SELECT user_ticker AS "Ticker", CASE WHEN source_strategy = 'CAPITAL_ONLY' THEN source_strategy WHEN p > 0 THEN 'HYBRID (Yahoo)' WHEN f > 0 THEN 'HYBRID (Fallback)' ELSE source_strategy END AS "Mode",
 coalesce("Pre", 0) AS "Pre", coalesce("Reg", 0) AS "Reg", coalesce("Post", 0) AS "Post", coalesce("Total", 0) AS "Total" FROM chosen LEFT JOIN counts ON symbol = user_ticker),
g AS (SELECT *, concat_ws(', ', {gaps}) AS gaps FROM j)
SELECT "Ticker", "Mode", "Pre", "Reg", "Post", "Total", CASE WHEN "Total" = 0 THEN '❌ Failed' WHEN gaps <> '' THEN '⚠️ Gappy (' || gaps || ')' WHEN "Mode" LIKE '%Fallback%' THEN '✅ (Fallback)' ELSE '✅ Complete' END AS "Status" FROM g"""
    return sql, mode


def _card(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    """The whole inventory: tickers without bars have failed."""
    bars = fixtures.raw_bars(_events(spark, sf))
    symbols = _map(spark, sf)
    chosen = inventory.known(symbols.select(F.col("user_ticker").alias("symbol")), symbols)
    wanted = [s.name for s in SPARSE.active(mode)]
    return report.report_card(chosen, bars.where(F.col("session").isin(wanted)), mode, SPARSE)


@register("report_card", _report(FULL_DAY)[0])
def report_card(spark: SparkSession, sf: str) -> DataFrame:
    return _card(spark, sf, FULL_DAY)


@register("report_card_regular", _report(REG_ONLY)[0])
def report_card_regular(spark: SparkSession, sf: str) -> DataFrame:
    return _card(spark, sf, REG_ONLY)


@register("report_failed", f"""SELECT * FROM ({_report(FULL_DAY)[0]}) WHERE "Status" LIKE '%Failed%'""")
def report_failed(spark: SparkSession, sf: str) -> DataFrame:
    return report.failed(_card(spark, sf, FULL_DAY))


@register("report_fallback", f"""SELECT * FROM ({_report(REG_ONLY)[0]}) WHERE "Mode" LIKE '%Fallback%'""")
def report_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return report.via_fallback(_card(spark, sf, REG_ONLY))


@register("report_alerts", f"""SELECT count(*) FILTER ("Status" LIKE '%Failed%') AS failures, count(*) FILTER ("Mode" LIKE '%Fallback%') AS fallbacks,
 coalesce(string_agg("Ticker", ', ' ORDER BY "Ticker") FILTER ("Mode" LIKE '%Fallback%'), '') AS fallback_tickers FROM ({_report(REG_ONLY)[0]})""")
def report_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return report.alerts(_card(spark, sf, REG_ONLY))


@register("merge_dedup", f"""WITH {_BARS}, parts AS (SELECT "timestamp", event_type AS symbol, value AS open, value AS high, value AS low, value AS close, CAST(event_id AS DOUBLE) AS volume,
 coalesce(session, 'PRE') AS session FROM bars)
SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY symbol, "timestamp" ORDER BY CASE session WHEN 'POST' THEN 2 WHEN 'REG' THEN 1 ELSE 0 END DESC, open DESC, volume DESC) = 1""")
def merge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    parts = _typed(spark, sf).select(
        "timestamp", "symbol", v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"),
        F.col("event_id").cast("double").alias("volume"), F.coalesce("session", F.lit("PRE")).alias("session"),
    )
    return merge_sessions(parts)


_LINE = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity"


@register("lww_upsert", f"SELECT {_LINE} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1")
def lww_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.table(spark, sf, "lineitem").select(*_LINE.split(", "))
    return keep_last(rows, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")])


@register("commit_upsert", f"""WITH inc AS (SELECT {_LINE} FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1)
SELECT {_LINE} FROM lineitem l WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM inc WHERE inc.l_orderkey = l.l_orderkey AND inc.l_linenumber = l.l_linenumber) UNION ALL SELECT * FROM inc""")
def commit_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.table(spark, sf, "lineitem")
    cols = _LINE.split(", ")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]
    return upsert(rows.where("l_returnflag <> 'R'").select(*cols), rows.where("l_returnflag = 'R'").select(*cols), ["l_orderkey", "l_linenumber"], order)


_FALLBACK = f"""WITH {_BARS}, pri AS (SELECT symbol, event_id, value FROM bars WHERE source = 'primary'), fb AS (SELECT symbol, event_id, value FROM bars WHERE source = 'fallback')
SELECT * FROM pri UNION ALL SELECT * FROM fb WHERE NOT EXISTS (SELECT 1 FROM pri WHERE pri.symbol = fb.symbol)"""


@register("fallback_union", _FALLBACK)
def fallback_union(spark: SparkSession, sf: str) -> DataFrame:
    bars = fixtures.raw_bars(_events(spark, sf))
    return with_fallback(bars.where("source = 'primary'").select("symbol", "event_id", "value"), bars.where("source = 'fallback'").select("symbol", "event_id", "value"))


_SEL = "SELECT DISTINCT 'SYM' || user_id AS user_ticker FROM events"


@register("inventory_join", f"WITH {_MAP} SELECT user_ticker, capital_epic, source_strategy FROM symbol_map JOIN ({_SEL}) USING (user_ticker)")
def inventory_join(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.known(fixtures.raw_bars(_events(spark, sf)), _map(spark, sf))


@register("unknown_tickers", f"WITH {_MAP} SELECT user_ticker FROM ({_SEL}) s WHERE NOT EXISTS (SELECT 1 FROM symbol_map m WHERE m.user_ticker = s.user_ticker)")
def unknown_tickers(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.unknown(fixtures.raw_bars(_events(spark, sf)), _map(spark, sf))


@register("any_capital_only", f"WITH {_MAP} SELECT coalesce(bool_or(source_strategy = 'CAPITAL_ONLY'), false) AS any_capital_only FROM symbol_map JOIN ({_SEL}) USING (user_ticker)")
def any_capital_only(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.any_single_source(fixtures.raw_bars(_events(spark, sf)), _map(spark, sf))


@register("inventory_list", f"WITH {_MAP} SELECT * FROM symbol_map ORDER BY user_ticker")
def inventory_list(spark: SparkSession, sf: str) -> DataFrame:
    return _map(spark, sf).orderBy("user_ticker")


@register("inventory_seed", """SELECT t AS user_ticker, t AS capital_epic, 'HYBRID' AS source_strategy FROM (VALUES ('AMD'), ('AMZN'), ('AAPL'), ('AVGO'), ('BABA'),
 ('GOOGL'), ('LRCX'), ('META'), ('MSFT'), ('MU'), ('NVDA'), ('ORCL'), ('PANW'), ('QCOM'), ('SHOP'), ('TSLA'), ('TSM'), ('SPY'), ('QQQ'), ('IWM'), ('DIA')) v(t)""")
def inventory_seed(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.seed(spark)


@register("inventory_upsert", f"WITH {_MAP} SELECT * FROM symbol_map WHERE user_ticker NOT IN ('SYM1', 'NEW9') UNION ALL SELECT * FROM (VALUES ('SYM1', 'GOLD', 'CAPITAL_ONLY'), ('NEW9', 'NEW9', 'HYBRID'))")
def inventory_upsert(spark: SparkSession, sf: str) -> DataFrame:
    new = inventory.entry_row(spark, "sym1", "gold", "CAPITAL_ONLY").unionByName(inventory.entry_row(spark, "new9"))
    return inventory.upsert_entries(_map(spark, sf), new)


@register("inventory_delete", f"WITH {_MAP} SELECT * FROM symbol_map WHERE user_ticker <> 'SYM7'")
def inventory_delete(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.delete_entry(_map(spark, sf), "SYM7")


@register("inventory_rename", f"WITH {_MAP} SELECT * FROM symbol_map WHERE user_ticker NOT IN ('SYM3', 'SYMX') UNION ALL SELECT * FROM (VALUES ('SYMX', 'OIL', 'HYBRID'))")
def inventory_rename(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.rename_entry(_map(spark, sf), "SYM3", inventory.entry_row(spark, "symx", "oil", "HYBRID (both)"))


@register("inventory_display", f"""WITH {_MAP} SELECT user_ticker AS "Ticker", capital_epic AS "Epic", source_strategy AS "Strategy" FROM symbol_map ORDER BY 1""")
def inventory_display(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.display(_map(spark, sf))


@register("strategy_choices", f"""WITH {_MAP} SELECT user_ticker, CASE WHEN source_strategy LIKE '%HYBRID%' THEN 'HYBRID (Stock/ETF)' ELSE 'CAPITAL_ONLY (Index/CFD)' END AS choice FROM symbol_map""")
def strategy_choices(spark: SparkSession, sf: str) -> DataFrame:
    return _map(spark, sf).select("user_ticker", labels.strategy_choice(F.col("source_strategy")).alias("choice"))


@register("month_numbers", "SELECT o_orderkey, monthname(o_orderdate) AS month_name, CAST(month(o_orderdate) AS INTEGER) AS month_number FROM orders")
def month_numbers(spark: SparkSession, sf: str) -> DataFrame:
    name = timez.month_name(F.to_date("o_orderdate"))
    return fixtures.table(spark, sf, "orders").select("o_orderkey", name.alias("month_name"), timez.month_number(name).alias("month_number"))


@register("empty_inputs", "SELECT CAST(0 AS BIGINT) AS candles, true AS inventory_empty, (SELECT count(*) FROM events) AS events")
def empty_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Typed empty frames go through the merge as any others."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    counted = lambda df, **own: df.select(*[own.get(c, zero).alias(c) for c in ("candles", "entries", "events")])
    every = counted(merge_sessions(empty_candles(spark)), candles=one).unionByName(counted(_map(spark, sf).where("false"), entries=one)).unionByName(counted(_events(spark, sf), events=one))
    return every.agg(F.sum("candles").alias("candles"), (F.sum("entries") == 0).alias("inventory_empty"), F.sum("events").alias("events"))


@register("session_union", f"""WITH {_BARS} SELECT "timestamp", 'SYM' || user_id AS symbol, value AS close, session FROM (SELECT e.user_id, b.* FROM bars b JOIN events e USING (event_id)) WHERE session IN ('PRE', 'REG', 'POST')""")
def session_union(spark: SparkSession, sf: str) -> DataFrame:
    """The frames of the sessions, harvested apart, as one."""
    bars = fixtures.raw_bars(_events(spark, sf)).select("timestamp", "symbol", F.col("value").alias("close"), "session")
    return reduce(DataFrame.unionByName, [bars.where(F.col("session") == s.name) for s in FULL.sessions])


@register("strategy_codes", """SELECT c_custkey, upper(lower(c_name)) AS ticker, CASE WHEN c_mktsegment LIKE '%MACH%' THEN 'CAPITAL_ONLY' ELSE 'HYBRID' END AS code,
 CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE 'E' || c_custkey END AS epic FROM customer""")
def strategy_codes(spark: SparkSession, sf: str) -> DataFrame:
    c = fixtures.table(spark, sf, "customer")
    choice = F.when(F.col("c_mktsegment").contains("MACH"), "CAPITAL only").otherwise("both")
    epic = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("e"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", labels.clean_ticker(F.lower("c_name")).alias("ticker"), labels.strategy_code(choice).alias("code"), labels.epic_or_ticker(epic, F.col("c_name")).alias("epic"))


@register("preview_series", f"""SELECT "timestamp", close, session FROM ({_CANDLES}) WHERE symbol = 'SYM7' ORDER BY 1""")
def preview_series(spark: SparkSession, sf: str) -> DataFrame:
    return export.preview_series(minute_candles(spark, sf), "SYM7")


@register("distinct_symbols", "SELECT DISTINCT 'SYM' || user_id AS symbol FROM events")
def distinct_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return export.distinct_symbols(fixtures.raw_bars(_events(spark, sf)))


@register("default_selection", f"WITH {_MAP} SELECT user_ticker FROM symbol_map ORDER BY 1 LIMIT 2")
def default_selection(spark: SparkSession, sf: str) -> DataFrame:
    return export.default_selection(_map(spark, sf))


@register("total_rows", f"SELECT count(*) AS candles, CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches FROM ({_CANDLES})")
def total_rows(spark: SparkSession, sf: str) -> DataFrame:
    return minute_candles(spark, sf).agg(F.count("*").alias("candles")).select("candles", labels.batch_count(F.col("candles")).alias("batches"))


@register("request_cap", "SELECT event_type AS symbol, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) <= 10")
def request_cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select(F.col("event_type").alias("symbol"), "event_id", "ts", F.to_date("ts").alias("_d"))
    return cap_rows(rows, ["symbol", "_d"], [F.col("ts"), F.col("event_id")], 10).drop("_d")


@register("clamp_window", """WITH w AS (SELECT o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 20 HOUR AS e, TIMESTAMP '1998-03-15 12:00:00' AS now FROM orders),
c AS (SELECT o_orderkey, CASE WHEN s < now - INTERVAL 16 HOUR THEN now - INTERVAL 16 HOUR + INTERVAL 1 MINUTE ELSE s END AS start_utc, least(e, now) AS end_utc FROM w)
SELECT * FROM c WHERE start_utc < end_utc""")
def clamp_window(spark: SparkSession, sf: str) -> DataFrame:
    o = fixtures.table(spark, sf, "orders")
    w = o.select("o_orderkey", F.col("o_orderdate").alias("start_utc"), (F.col("o_orderdate") + F.expr("INTERVAL 20 HOURS")).alias("end_utc"))
    return sessions.request_windows(w, F.lit(NOW).cast("timestamp_ntz"))


@register("smart_date", """WITH t AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) AS et FROM orders)
SELECT o_orderkey, CASE WHEN hour(et) * 60 + minute(et) < 570 THEN CAST(et AS DATE) - CASE isodow(et) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END ELSE CAST(et AS DATE) END AS target_date,
 date_trunc('day', et) + INTERVAL 570 MINUTE AS market_open FROM t""")
def smart_date(spark: SparkSession, sf: str) -> DataFrame:
    et = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    t = fixtures.table(spark, sf, "orders").select("o_orderkey", et.alias("et"))
    return t.select("o_orderkey", timez.trading_date("et").alias("target_date"), timez.market_open("et").alias("market_open"))


@register("month_bounds", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, last_day(o_orderdate) AS last_day, monthname(o_orderdate) AS month_name FROM orders")
def month_bounds(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return fixtures.table(spark, sf, "orders").select("o_orderkey", timez.month_start(d).alias("first_day"), timez.month_end(d).alias("last_day"), timez.month_name(d).alias("month_name"))


@register("json_prices", f"""SELECT 'SYM' || user_id AS symbol, timezone('UTC', timezone('Asia/Bahrain', date_trunc('second', ts))) AS "timestamp",
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS open, value + 1 AS high, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value - 1 END AS low, value AS close, CAST(event_id AS DOUBLE) AS volume, 'PRE' AS session FROM events""")
def json_prices(spark: SparkSession, sf: str) -> DataFrame:
    def quote(c: F.Column) -> F.Column:
        return F.struct(c.alias("bid"), (c + 2).alias("ask"))

    v, eid = F.col("value"), F.col("event_id")
    bar = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("snapshotTime"),
        F.when(eid % 5 != 0, quote(v)).alias("openPrice"), quote(v + 1).alias("highPrice"),
        quote(F.when(eid % 7 != 0, v - 1)).alias("lowPrice"), quote(v).alias("closePrice"), eid.cast("double").alias("lastTradedVolume"),
    )
    body = F.to_json(F.struct(F.array(bar).alias("prices")))
    payloads = _events(spark, sf).select(F.concat(F.lit("SYM"), F.col("user_id").cast("string")).alias("symbol"), body.alias("payload"))
    return normalize.from_snapshots(normalize.extract_prices(payloads), "PRE")


@register("normalize_bars", """SELECT 'SYM' || user_id AS symbol, timezone('UTC', timezone('US/Eastern', ts)) AS "timestamp", value AS open, value AS high, value AS low, value AS close, CAST(event_id AS DOUBLE) AS volume, 'REG' AS session FROM events""")
def normalize_bars(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    raw = _events(spark, sf).select(
        F.col("ts").alias("Datetime|x"), v.alias("Open|x"), v.alias("High|x"), v.alias("Low|x"), v.alias("Close|x"), v.alias("Adj Close|x"),
        F.col("event_id").alias("Volume|x"), F.concat(F.lit("SYM"), F.col("user_id").cast("string")).alias("symbol"),
    )
    return normalize.from_bars(normalize.flatten_names(raw))


@register("iso_export", """SELECT strftime("timestamp", '%Y-%m-%dT%H:%M:%S+00:00') AS "timestamp", symbol, open, high, low, close, volume, session FROM (""" + _CANDLES + ")")
def iso_export(spark: SparkSession, sf: str) -> DataFrame:
    return export.iso_rows(minute_candles(spark, sf))


@register("csv_export", """SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S+00:00') AS "timestamp", symbol, open, high, low, close, volume, session FROM (""" + _CANDLES + ")")
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    return export.for_csv(minute_candles(spark, sf))


@register("utc_day_of_text", """SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 5 HOUR END AS DATE) AS utc_day FROM events""")
def utc_day_of_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, "NaT").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")))
    return _events(spark, sf).select("event_id", timez.utc_day_of_text(text).alias("utc_day"))


@register("count_display", "SELECT event_type AS symbol, format('{:,}', count(*)) AS shown FROM events GROUP BY ALL")
def count_display(spark: SparkSession, sf: str) -> DataFrame:
    n = _events(spark, sf).groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))
    return n.select("symbol", labels.thousands(F.col("n")).alias("shown"))
