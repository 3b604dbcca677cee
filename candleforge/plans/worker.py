"""The scheduled run: smart date, harvest of the whole inventory, alerts, commit."""

from __future__ import annotations

import datetime as dt
import logging
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.functions.timez import trading_date, utc_to_zone
from candleforge.operators import report
from candleforge.operators.profile import FULL, FULL_DAY, Profile
from candleforge.operators.store import CandleStore, InventoryStore
from candleforge.plans.harvest import Harvest, harvest

log = logging.getLogger(__name__)

#: fetch(epics and symbols to harvest, date) -> (source A bars, source B bars)
Fetch = Callable[[DataFrame, dt.date], tuple[DataFrame, DataFrame]]


def missing_settings(required: list[str], env: Mapping[str, str] | None = None) -> list[str]:
    found = os.environ if env is None else env
    return [name for name in required if not found.get(name)]


def target_date(spark: SparkSession, now_utc: dt.datetime) -> dt.date:
    one = spark.range(1).select(trading_date(utc_to_zone(F.lit(now_utc).cast("timestamp_ntz"), "US/Eastern")).alias("d"))
    return one.first().d


def run(spark: SparkSession, candles: CandleStore, symbols: InventoryStore, fetch: Fetch, now_utc: dt.datetime, mode: str = FULL_DAY, profile: Profile = FULL) -> Harvest:
    """Harvest and commit. An empty inventory is an error; a harvest without bars only a warning.

    Both sources are landed in the store's file system first, so each request is made once and the report, the alerts
    and the candles come from the same answers.
    """
    date = target_date(spark, now_utc)
    symbol_map = symbols.read()
    if symbol_map.isEmpty():
        raise RuntimeError("the inventory is empty")
    prices, bars = (candles.landed(x, name) for x, name in zip(fetch(symbol_map, date), ("prices", "bars")))
    out = harvest(symbol_map.select(F.col("user_ticker").alias("symbol")), symbol_map, prices, bars, date, mode, profile)
    facts = report.alerts(out.report).first()
    if facts.failures:
        log.warning("%d symbols failed completely", facts.failures)
    if facts.fallbacks:
        log.warning("%d symbols used the fallback source: %s", facts.fallbacks, facts.fallback_tickers)
    days = candles.commit(out.candles)
    log.log(logging.INFO if days else logging.WARNING, "committed %d days for %s", days, date)
    return out
