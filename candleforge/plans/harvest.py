"""The harvest: selection and sources to merged candles and a report card, as one plan over all tickers."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.functions.labels import CAPITAL_ONLY, HYBRID
from candleforge.operators import inventory, normalize, report, sessions
from candleforge.operators.profile import FULL, FULL_DAY, Profile
from candleforge.operators.reconcile import merge_sessions
from candleforge.operators.schemas import as_candles
from candleforge.sources.landed import bars_of_day


@dataclass
class Harvest:
    candles: DataFrame
    report: DataFrame
    skipped: DataFrame
    parts: DataFrame


def harvest(selection: DataFrame, symbol_map: DataFrame, prices: DataFrame, bars: DataFrame, date: dt.date, mode: str = FULL_DAY, profile: Profile = FULL) -> Harvest:
    """Candles and report of a trading date.

    selection: (symbol). prices: source A bars (epic, SnapshotTime, Open..Volume). bars: source B bars
    (symbol, Datetime, Open..Volume). PRE and POST come from source A; REG of a single-source ticker too, of a
    hybrid one from source B, or from source A if B has none. Source A is one branch of the plan: a bar is tagged with
    every window that it lies in, as neighbours share an edge, and the fallback is a join with the few tickers B
    serves. Candles and report are two results of the plan, so live sources are landed first (`worker.run`). Tickers
    outside the inventory are in `skipped`, a selection's repeats count once, a NULL strategy is hybrid. Empty sources
    give failed rows in the report and no candles.
    """
    chosen = inventory.known(selection, symbol_map)
    rules = chosen.select("user_ticker", F.col("capital_epic").alias("epic"), F.coalesce("source_strategy", F.lit(HYBRID)).alias("strategy"))
    active = profile.active(mode)
    raw = prices.join(rules.withColumn("single", F.col("strategy") == CAPITAL_ONLY), "epic")
    bars_a = normalize.from_snapshots(raw, F.when(F.col("single"), "single").otherwise("hybrid"), "user_ticker")
    tagged = sessions.tagged(bars_a.withColumnRenamed("session", "kind"), date, active)
    primary, regular = F.col("session") != "REG", F.col("kind") == "single"
    if any(s.name == "REG" for s in active):
        own = rules.where(F.col("strategy") != CAPITAL_ONLY).select(F.col("user_ticker").alias("symbol"))
        from_b = normalize.from_bars(bars_of_day(bars, date).join(own, "symbol")).withColumn("source", F.lit("primary"))
        served = from_b.select("symbol").distinct().withColumn("served", F.lit(True))
        tagged = tagged.join(served, "symbol", "left").where(primary | regular | F.col("served").isNull()).drop("served")
    from_a = tagged.withColumn("source", F.when(primary | regular, "primary").otherwise("fallback")).drop("kind")
    every = from_a.unionByName(from_b) if any(s.name == "REG" for s in active) else from_a
    card = report.report_card(chosen.select("user_ticker", "source_strategy"), every, mode, profile)
    return Harvest(as_candles(merge_sessions(every.drop("source"))), card, inventory.unknown(selection, symbol_map), every)
