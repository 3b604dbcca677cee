"""Operators on hand-made rows: edges, thresholds, daylight saving, nulls, idempotence."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from candleforge.functions import labels, timez
from candleforge.operators import export, health, inventory, normalize, report, sessions
from candleforge.operators.profile import EMPTY, FULL, FULL_DAY, GREEN, LEGACY, ORANGE, POST_ONLY, PRE_ONLY, RED, REG_ONLY, YELLOW
from candleforge.operators.reconcile import cap_rows, merge_sessions, upsert, with_fallback
from candleforge.operators.schemas import CANDLE, CANDLE_COLS, as_candles, empty_candles
from candleforge.operators.store import CandleStore, InventoryStore
from candleforge.plans import worker
from candleforge.plans.harvest import harvest
from candleforge.sources import http, landed
from candleforge.streaming import ingest

D = dt.datetime
RAW = "symbol string, SnapshotTime string, Open double, High double, Low double, Close double, Volume double"


def candle(ts, symbol="A", price=1.0, session="REG", volume=1.0):
    return (ts, symbol, price, price, price, price, volume, session)


def candles(spark, rows):
    return spark.createDataFrame(rows, CANDLE)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ntz(text):
    return F.lit(D.fromisoformat(text)).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("date", "open_utc"),
    [("2024-03-08", "2024-03-08 14:30"), ("2024-03-11", "2024-03-11 13:30"), ("2024-11-01", "2024-11-01 13:30"), ("2024-11-04", "2024-11-04 14:30")],
)
def test_session_open_follows_daylight_saving(spark, date, open_utc):
    rel = sessions.window_relation(spark, dt.date.fromisoformat(date), REG_ONLY).first()
    assert rel.start_utc == D.fromisoformat(open_utc)
    assert rel.end_utc - rel.start_utc == dt.timedelta(hours=6, minutes=30)
    assert one(spark, timez.wall_to_utc(dt.date.fromisoformat(date), 570)) == D.fromisoformat(open_utc)


def test_regular_hours_include_both_edges(spark):
    minutes = spark.range(0, 24 * 60).select((ntz("2024-07-05 04:00") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"))
    assert minutes.where(timez.in_regular_hours("ts")).count() == 391


def test_session_tag_is_half_open(spark):
    rows = [("2024-07-05 07:59", None), ("2024-07-05 08:00", "PRE"), ("2024-07-05 13:30", "REG"), ("2024-07-05 20:00", "POST"), ("2024-07-06 00:00", None)]
    for text, want in rows:
        assert one(spark, sessions.session_of(ntz(text))) == want
    assert one(spark, sessions.session_of(ntz("2024-07-05 20:00"), LEGACY)) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-05T12:00:00", D(2024, 1, 5, 9)), ("2024-01-05T12:00:00+00:00", D(2024, 1, 5, 12)), ("2024-01-05T12:00:00Z", D(2024, 1, 5, 12)),
        ("2024-01-31T23:59:00-05:00", D(2024, 2, 1, 4, 59)), ("NaT", None), ("", None), (None, None),
    ],
)
def test_parse_instant(spark, text, want):
    assert one(spark, timez.parse_instant(F.lit(text).cast("string"))) == want


def test_utc_day_of_text_honours_offset(spark):
    assert one(spark, timez.utc_day_of_text(F.lit("2024-01-31T23:59:00-05:00"))) == dt.date(2024, 2, 1)
    assert one(spark, timez.iso_utc(ntz("2024-01-31 23:59"))) == "2024-01-31T23:59:00+00:00"


@pytest.mark.parametrize(
    ("now", "want"),
    [("2024-07-08 09:29", "2024-07-05"), ("2024-07-08 09:30", "2024-07-08"), ("2024-07-07 08:00", "2024-07-05"), ("2024-07-06 08:00", "2024-07-05"), ("2024-07-06 10:00", "2024-07-06"), ("2024-07-10 00:00", "2024-07-09")],
)
def test_trading_date(spark, now, want):
    assert one(spark, timez.trading_date(ntz(now))) == dt.date.fromisoformat(want)


def test_request_windows_clamp(spark):
    now = ntz("2024-07-05 18:00")
    rows = [(1, D(2024, 7, 4), D(2024, 7, 5, 10)), (2, D(2024, 7, 5, 12), D(2024, 7, 5, 20)), (3, D(2024, 7, 6), D(2024, 7, 7)), (4, D(2024, 7, 1), D(2024, 7, 2))]
    df = spark.createDataFrame(rows, "k int, start_utc timestamp_ntz, end_utc timestamp_ntz")
    got = {r.k: (r.start_utc, r.end_utc) for r in sessions.request_windows(df, now).collect()}
    assert got == {1: (D(2024, 7, 5, 2, 1), D(2024, 7, 5, 10)), 2: (D(2024, 7, 5, 12), D(2024, 7, 5, 18))}
    for k, s, e in rows:
        assert http.clamp(s, e, D(2024, 7, 5, 18)) == got.get(k)


@pytest.mark.parametrize(
    ("pre", "reg", "post", "total", "mode", "want"),
    [
        (297, 351, 216, 800, "HYBRID (Yahoo)", "✅ Complete"), (296, 351, 216, 800, "HYBRID (Yahoo)", "⚠️ Gappy (Pre)"),
        (297, 350, 215, 800, "HYBRID (Fallback)", "⚠️ Gappy (Reg, Post)"), (0, 0, 0, 0, "HYBRID", "❌ Failed"),
        (297, 351, 216, 800, "HYBRID (Fallback)", "✅ (Fallback)"), (0, 0, 0, 5, "HYBRID", "⚠️ Gappy (Pre, Reg, Post)"),
    ],
)
def test_status(spark, pre, reg, post, total, mode, want):
    counts = {"PRE": F.lit(pre), "REG": F.lit(reg), "POST": F.lit(post)}
    assert one(spark, labels.status_label(F.lit(total), counts, F.lit(mode), FULL_DAY)) == want
    if pre >= 297 and total:
        assert one(spark, labels.status_label(F.lit(total), counts, F.lit("x"), PRE_ONLY)) == "✅ Complete"


@pytest.mark.parametrize(
    ("strategy", "p", "f", "reg", "profile", "want"),
    [
        ("CAPITAL_ONLY", 0, 5, True, FULL, "CAPITAL_ONLY"), ("HYBRID", 3, 0, True, FULL, "HYBRID (Yahoo)"), ("HYBRID", 0, 1, True, FULL, "HYBRID (Fallback)"),
        ("HYBRID", 0, 0, True, FULL, "HYBRID"), ("HYBRID", 0, 0, True, LEGACY, "HYBRID (Failed)"), (None, 0, 0, True, FULL, "HYBRID"), ("OTHER", 3, 0, False, FULL, "OTHER"),
    ],
)
def test_mode_label(spark, strategy, p, f, reg, profile, want):
    assert one(spark, labels.mode_label(F.lit(strategy).cast("string"), F.lit(p), F.lit(f), reg, profile)) == want


@pytest.mark.parametrize(
    ("n", "kind", "profile", "want"),
    [
        (901, "Total", FULL, GREEN), (900, "Total", FULL, YELLOW), (700, "Total", FULL, ORANGE), (600, "Total", FULL, RED), (None, "Total", FULL, EMPTY),
        (701, "Total", LEGACY, GREEN), (331, "Total", LEGACY, YELLOW), (301, "Total", LEGACY, ORANGE), (300, "Total", LEGACY, RED),
        (301, "PRE", FULL, GREEN), (300, "PRE", FULL, YELLOW), (100, "PRE", FULL, RED), (351, "REG", FULL, GREEN), (101, "REG", FULL, YELLOW), (217, "POST", FULL, GREEN),
    ],
)
def test_heat(spark, n, kind, profile, want):
    assert one(spark, labels.heat_colour(F.lit(n).cast("long"), kind, profile)) == want


def test_prices_json_nulls_and_missing_objects(spark):
    body = {
        "prices": [
            {"snapshotTime": "2024-01-05T12:00:00", "openPrice": {"bid": 1.5, "ask": 2}, "highPrice": None, "closePrice": {"bid": float("nan")}, "lastTradedVolume": 7},
            {"snapshotTime": None, "openPrice": {"bid": 9}},
            {"snapshotTime": "2024-01-05T12:01:00+00:00"},
        ]
    }
    df = spark.createDataFrame([("A", json.dumps(body)), ("B", "{}"), ("C", "oops"), ("D", None)], "symbol string, payload string")
    got = sorted(tuple(r) for r in normalize.from_snapshots(normalize.extract_prices(df), "PRE").collect())
    assert got == [(D(2024, 1, 5, 9), "A", 1.5, None, None, None, 7.0, "PRE"), (D(2024, 1, 5, 12, 1), "A", None, None, None, None, None, "PRE")]


def test_candle_projection(spark):
    df = candles(spark, [candle(D(2024, 1, 5))]).withColumn("extra", F.lit(1))
    assert as_candles(df).columns == CANDLE_COLS
    with pytest.raises(Exception, match="volume"):
        as_candles(df.drop("volume"))
    assert empty_candles(spark).count() == 0
    assert normalize.lower_names(df.toDF(*[c.upper() for c in df.columns])).columns == df.columns


def test_merge_prefers_later_session_whatever_the_order(spark):
    rows = [candle(D(2024, 1, 5, 14, 30), price=p, session=s) for p, s in ((1.0, "PRE"), (2.0, "REG"), (9.0, "PRE"))] + [candle(D(2024, 1, 5, 21), price=5.0, session=s) for s in ("REG", "POST")]
    for order in (rows, rows[::-1]):
        got = {r.timestamp: (r.open, r.session) for r in merge_sessions(candles(spark, order)).collect()}
        assert got == {D(2024, 1, 5, 14, 30): (2.0, "REG"), D(2024, 1, 5, 21): (5.0, "POST")}
    assert merge_sessions(empty_candles(spark)).count() == 0


def test_fallback_serves_only_missing_symbols(spark):
    p = candles(spark, [candle(D(2024, 1, 5), "A")])
    f = candles(spark, [candle(D(2024, 1, 5, 1), "A"), candle(D(2024, 1, 5, 1), "B")])
    assert sorted(r.symbol for r in with_fallback(p, f).collect()) == ["A", "B"]


def test_upsert_replaces_whole_rows(spark):
    old = candles(spark, [candle(D(2024, 1, 5), "A"), candle(D(2024, 1, 6), "A")])
    new = candles(spark, [(D(2024, 1, 5), "A", None, None, None, 3.0, None, "PRE")])
    got = {r.timestamp: r.open for r in upsert(old, new, ["symbol", "timestamp"]).collect()}
    assert got == {D(2024, 1, 5): None, D(2024, 1, 6): 1.0}


def test_cap_rows(spark):
    df = spark.range(25).withColumn("k", F.col("id") % 2)
    assert cap_rows(df, ["k"], [F.col("id")], 5).count() == 10


def _day(date, symbol, start, n):
    base = D.fromisoformat(f"{date} {start}")
    return [(symbol, (base + dt.timedelta(minutes=i)).strftime("%Y-%m-%dT%H:%M:%S+00:00"), 1.0, 2.0, 0.5, float(i), 10.0) for i in range(n)]


@pytest.fixture(scope="module")
def sources(spark):
    """Four tickers: A complete through source B, B through the fallback, C single-source, Z without bars."""
    date = "2024-07-05"
    prices = []
    for epic in ("EA", "EB", "EC"):
        prices += _day(date, epic, "08:00", 961)
    price_df = spark.createDataFrame(prices, RAW.replace("symbol", "epic"))
    bars = [("A", D(2024, 7, 5, 13, 30, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(391)]
    bars += [("C", D(2024, 7, 5, 14, 0, tzinfo=dt.timezone.utc), 5.0, 5.0, 5.0, 5.0, 1.0), ("A", D(2024, 7, 5, 22, 0, tzinfo=dt.timezone.utc), 5.0, 5.0, 5.0, 5.0, 1.0)]
    bar_df = spark.createDataFrame(bars, landed.BAR_SCHEMA)
    smap = spark.createDataFrame([("A", "EA", "HYBRID"), ("B", "EB", None), ("C", "EC", "CAPITAL_ONLY"), ("Z", "EZ", "HYBRID")], "user_ticker string, capital_epic string, source_strategy string")
    return price_df, bar_df, smap


def test_harvest_full_day(spark, sources):
    prices, bars, smap = sources
    sel = spark.createDataFrame([("A",), ("B",), ("C",), ("Z",), ("A",), ("NOPE",)], "symbol string")
    out = harvest(sel, smap, prices, bars, dt.date(2024, 7, 5))
    got = {r.Ticker: tuple(r)[1:] for r in out.report.collect()}
    assert got == {
        "A": ("HYBRID (Yahoo)", 331, 391, 241, 961, "✅ Complete"), "B": ("HYBRID (Fallback)", 331, 391, 241, 961, "✅ (Fallback)"),
        "C": ("CAPITAL_ONLY", 331, 391, 241, 961, "✅ Complete"), "Z": ("HYBRID", 0, 0, 0, 0, "❌ Failed"),
    }
    assert [r.user_ticker for r in out.skipped.collect()] == ["NOPE"]
    assert out.candles.count() == 3 * 961 == out.candles.select("symbol", "timestamp").distinct().count()
    edge = {r.symbol: r.session for r in out.candles.where(F.col("timestamp") == ntz("2024-07-05 13:30")).collect()}
    assert edge == {"A": "REG", "B": "REG", "C": "REG"}
    facts = report.alerts(out.report).first()
    assert tuple(facts) == (1, 1, "B")


@pytest.mark.parametrize(("mode", "rows"), [(PRE_ONLY, 331), (REG_ONLY, 391), (POST_ONLY, 241)])
def test_harvest_modes(spark, sources, mode, rows):
    prices, bars, smap = sources
    out = harvest(spark.createDataFrame([("B",)], "symbol string"), smap, prices, bars, dt.date(2024, 7, 5), mode)
    card = out.report.first()
    assert (card.Total, out.candles.count()) == (rows, rows)
    assert card.Mode == ("HYBRID (Fallback)" if mode == REG_ONLY else "HYBRID")
    with pytest.raises(ValueError, match="mode"):
        FULL.active("later")


def test_harvest_reads_a_source_once_and_pushes_its_bounds(spark, sources, tmp_path):
    prices, bars, smap = sources
    store = CandleStore(spark, str(tmp_path / "store"))
    prices, bars = store.landed(prices, "prices"), store.landed(bars, "bars")
    out = harvest(spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string"), smap, prices, bars, dt.date(2024, 7, 5))
    plan = out.candles._jdf.queryExecution().optimizedPlan().toString()
    full = out.candles._jdf.queryExecution().explainString(out.candles.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("SnapshotTime#") and full.count("_landed/prices") == 1
    assert "GreaterThanOrEqual(Datetime,2024-07-05" in full and "LessThanOrEqual(Datetime,2024-07-05" in full


def test_worker_asks_its_sources_once(spark, sources, tmp_path):
    prices, bars, smap = sources
    asked = spark.sparkContext.accumulator(0)

    def counted(batches):
        asked.add(1)
        yield from batches

    def fetch(symbols, date):
        return tuple(x.coalesce(1).mapInArrow(counted, x.schema) for x in (prices, bars))

    store, inv = CandleStore(spark, str(tmp_path / "s")), InventoryStore(spark, str(tmp_path / "i"))
    inv.upsert("A", "EA")
    out = worker.run(spark, store, inv, fetch, D(2024, 7, 5, 21))
    assert out.report.count() == 1 and store.read().count() == 961
    assert asked.value == 2


def test_harvest_of_empty_sources(spark, sources):
    prices, bars, smap = sources
    out = harvest(spark.createDataFrame([("A",)], "symbol string"), smap, prices.limit(0), bars.limit(0), dt.date(2024, 7, 5), profile=LEGACY)
    assert out.candles.count() == 0
    assert tuple(out.report.first()) == ("A", "HYBRID (Failed)", 0, 0, 0, "❌ Failed")


def test_store_commit_is_idempotent(spark, tmp_path):
    store = CandleStore(spark, str(tmp_path / "store"))
    store.create()
    assert store.read().count() == 0
    first = candles(spark, [candle(D(2024, 1, d, h), s) for d in (5, 6, 7) for h in (14, 15) for s in "AB"])
    assert store.commit(first) == 3
    before = sorted(map(tuple, store.read().collect()))
    assert store.commit(first) == 3
    assert sorted(map(tuple, store.read().collect())) == before
    late = candles(spark, [candle(D(2024, 1, 6, 14), "A", 9.0, "PRE"), candle(D(2024, 1, 6, 14), "A", 8.0, "REG")])
    assert store.commit(late) == 1
    after = {(r.symbol, r.timestamp): r.open for r in store.read().collect()}
    assert len(after) == 12
    assert after["A", D(2024, 1, 6, 14)] == 9.0
    assert store.commit(empty_candles(spark)) == 0
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_stage")]


@pytest.mark.parametrize("step", ["_publish", "write", "_tidy"])
def test_a_commit_that_fails_half_way_loses_nothing(spark, tmp_path, monkeypatch, step):
    store = CandleStore(spark, str(tmp_path / "store"))
    day = lambda h, v, sym="A": (D.fromisoformat(f"2024-07-05 {h}:30"), sym, v, v, v, v, v, "REG")
    frame = lambda rows: spark.createDataFrame(rows, empty_candles(spark).schema)
    store.commit(frame([day(14, 1.0), day(15, 1.0, "B"), (D(2024, 7, 6, 14), "A", 2.0, 2.0, 2.0, 2.0, 2.0, "REG")]))
    before = sorted(map(tuple, store.read().collect()))

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if step == "write":  # the data are written, and the driver is gone before it publishes
            m.setattr(store, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        else:
            m.setattr(store, step, broken)
        with pytest.raises((OSError, KeyboardInterrupt)):
            store.commit(frame([day(14, 9.0), day(16, 9.0)]))
    seen = sorted(map(tuple, CandleStore(spark, str(tmp_path / "store")).read().collect()))
    assert seen == before if step != "_tidy" else len(seen) == 4
    assert store.commit(frame([day(14, 9.0), day(16, 9.0)])) == 1
    assert sorted((r.symbol, str(r.timestamp), r.open) for r in store.read().collect()) == [
        ("A", "2024-07-05 14:30:00", 9.0), ("A", "2024-07-05 16:30:00", 9.0), ("A", "2024-07-06 14:00:00", 2.0), ("B", "2024-07-05 15:30:00", 1.0),
    ]


def test_two_commits_of_one_version_do_not_lose_rows(spark, tmp_path, monkeypatch):
    store, other = (CandleStore(spark, str(tmp_path / "store")) for _ in range(2))
    frame = lambda sym: spark.createDataFrame([(D(2024, 7, 5, 14, 30), sym, 1.0, 1.0, 1.0, 1.0, 1.0, "REG")], empty_candles(spark).schema)
    store.commit(frame("A"))
    publish = store._publish

    def late(*args):
        other.commit(frame("B"))
        publish(*args)

    monkeypatch.setattr(store, "_publish", late)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store.commit(frame("C"))
    monkeypatch.setattr(store, "_publish", publish)
    store.commit(frame("C"))
    assert {r.symbol for r in store.read().collect()} == {"A", "B", "C"}


def test_read_prunes_days(spark, tmp_path):
    store = CandleStore(spark, str(tmp_path / "store"))
    rows = [(D(2024, 7, d, 14, 30), "A", 1.0, 1.0, 1.0, 1.0, 1.0, "REG") for d in range(1, 9)]
    store.commit(spark.createDataFrame(rows, empty_candles(spark).schema))
    one = store.read().where("day = date'2024-07-03'")
    assert one.count() == 1 and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()


def test_inventory_store(spark, tmp_path):
    inv = InventoryStore(spark, str(tmp_path / "inv"))
    assert inv.read().count() == 0
    inv.create()
    inv.create()
    assert inv.read().count() == 21
    inv.upsert("gold", "", "CAPITAL_ONLY (x)")
    inv.upsert("amd", "amd.us")
    inv.delete("DIA")
    inv.delete("NOPE")
    inv.rename("SPY", "spx", "us500")
    got = inventory.as_lookup(inv.read())
    assert len(got) == 21
    assert got["GOLD"] == {"epic": "GOLD", "strategy": "CAPITAL_ONLY"}
    assert got["AMD"]["epic"] == "AMD.US"
    assert got["SPX"]["epic"] == "US500"
    assert "SPY" not in got and "DIA" not in got
    assert [r.user_ticker for r in inv.listing().limit(2).collect()] == ["AAPL", "AMD"]


def test_health_pushes_predicates_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "c")
    candles(spark, [candle(D(2024, 1, 5, 14, m), s) for m in range(5) for s in "AB"] + [candle(D(2024, 1, 6), "A")]).write.parquet(path)
    long = health.health_long(landed.candle_files(spark, path), ["A"], dt.date(2024, 1, 5), dt.date(2024, 1, 5), "REG")
    plan = spark._jvm.PythonSQLUtils.explainString(long._jdf.queryExecution(), "formatted")
    pushed = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed and "(symbol" in pushed
    assert "ReadSchema: struct<timestamp:timestamp_ntz,symbol:string,session:string>" in plan
    assert [tuple(r) for r in long.collect()] == [("A", dt.date(2024, 1, 5), 5)]
    days = health.days_between(dt.date(2024, 1, 4), dt.date(2024, 1, 6))
    wide = health.health_matrix(health.health_long(landed.candle_files(spark, path), None, days[0], days[-1]), days)
    assert {r.symbol: tuple(r)[1:] for r in wide.collect()} == {"A": (None, 5, 1), "B": (None, 5, None)}
    assert health.unpivot_matrix(wide).count() == 3


def test_csv_export_and_reading_back(spark, tmp_path):
    path = str(tmp_path / "csv")
    export.write_csv(candles(spark, [candle(D(2024, 1, 5, 14, 30))]), path, single_file=True)
    assert spark.read.option("header", True).csv(path).first().timestamp == "2024-01-05 14:30:00+00:00"
    assert export.csv_name(dt.date(2024, 1, 5)) == "backup_20240105.csv"


class _Server(BaseHTTPRequestHandler):
    calls: dict = {}

    def do_POST(self):
        self.send_response(200)
        self.send_header("CST", "c1")
        self.send_header("X-SECURITY-TOKEN", "t1")
        self.end_headers()

    def do_GET(self):
        n = self.calls[self.path] = self.calls.get(self.path, 0) + 1
        if "FLAKY" in self.path and n < 3:
            self.send_error(502)
        elif "GONE" in self.path:
            self.send_error(404)
        else:
            prices = {"prices": [{"snapshotTime": "2024-07-05T16:30:00", "openPrice": {"bid": 1}}]}
            chart = {"timestamp": [1720186200], "open": [1.0], "high": [1.0], "low": [1.0], "close": [1.0], "volume": [None]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(prices if "/prices/" in self.path else chart).encode())

    def log_message(self, *_):
        pass


def test_http_sources(spark):
    server = HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert http.open_session(base, "k", "i", "p") == ("c1", "t1")
        with pytest.raises(ValueError, match="credentials"):
            http.open_session(base, "", "i", "p")
        spark.dataSource.register(http.PriceApi)
        spark.dataSource.register(http.ChartApi)
        requests = [{"symbol": s, "epic": s, "start": "2024-07-05T13:30:00", "end": "2024-07-05T20:00:00"} for s in ("OK", "FLAKY", "GONE")]
        requests.append({"symbol": "OLD", "start": "2024-07-01T13:30:00", "end": "2024-07-01T20:00:00"})
        options = {"base_url": base, "requests": json.dumps(requests), "now": "2024-07-05T21:00:00", "history_hours": "16", "pause": "0", "backoff": "0.01", "token": "t1", "cst": "c1"}
        good, bad = http.split_errors(spark.read.format("price_api").options(**options).load())
        bars = normalize.from_snapshots(normalize.extract_prices(good), "REG")
        assert sorted((r.symbol, r.timestamp) for r in bars.collect()) == [("FLAKY", D(2024, 7, 5, 13, 30)), ("OK", D(2024, 7, 5, 13, 30))]
        assert [r.symbol for r in bad.collect()] == ["GONE"]
        chart = http.chart_bars(spark.read.format("chart_api").options(**options).load().where("symbol = 'OK'"))
        row = normalize.from_bars(chart).first()
        assert (row.timestamp, row.symbol, row.volume) == (D(2024, 7, 5, 13, 30), "OK", None)
    finally:
        server.shutdown()


def test_worker_run(spark, sources, tmp_path):
    prices, bars, _ = sources
    store, inv = CandleStore(spark, str(tmp_path / "s")), InventoryStore(spark, str(tmp_path / "i"))
    fetch = lambda *_: (prices, bars)
    with pytest.raises(RuntimeError, match="empty"):
        worker.run(spark, store, inv, fetch, D(2024, 7, 5, 21))
    inv.upsert("a", "ea")
    worker.run(spark, store, inv, fetch, D(2024, 7, 5, 21))
    assert store.read().count() == 961
    assert worker.target_date(spark, D(2024, 7, 8, 13, 0)) == dt.date(2024, 7, 5)
    assert worker.missing_settings(["X", "Y"], {"X": "1"}) == ["Y"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    candles(spark, [candle(D(2024, 1, 5, 14, m), "A") for m in range(5)]).write.parquet(src)
    store = CandleStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(CANDLE).parquet(src)
    for _ in range(2):
        ingest.upsert_stream(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.read().count() == 5
    ticks = str(tmp_path / "ticks")
    rows = [(D(2024, 1, 5, 14, 30, s, tzinfo=dt.timezone.utc), "A", float(s), s) for s in (5, 1, 59)] + [(D(2024, 1, 5, 15, 0, tzinfo=dt.timezone.utc), "A", 7.0, 99)]
    schema = "ts timestamp, symbol string, value double, event_id long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(ticks)
    built = ingest.build_candles(spark.readStream.schema(schema).parquet(ticks))
    q = built.writeStream.format("memory").queryName("built").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("built").collect()] == [(D(2024, 1, 5, 14, 30), "A", 1.0, 59.0, 1.0, 59.0, 65.0, "REG")]
