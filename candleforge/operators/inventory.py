"""Symbol inventory: the ticker dimension and its edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.functions.labels import CAPITAL_ONLY, HYBRID, clean_ticker, epic_or_ticker, strategy_code
from candleforge.operators.profile import SEED_TICKERS
from candleforge.operators.schemas import SYMBOL_MAP


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, t, HYBRID) for t in SEED_TICKERS], SYMBOL_MAP)


def entry_row(spark: SparkSession, ticker: str, epic: str = "", choice: str = HYBRID) -> DataFrame:
    """A form entry, cleaned."""
    raw = spark.createDataFrame([(ticker, epic, choice)], "t string, e string, c string")
    return raw.select(clean_ticker(F.col("t")).alias("user_ticker"), epic_or_ticker(F.col("e"), F.col("t")).alias("capital_epic"), strategy_code(F.col("c")).alias("source_strategy"))


def upsert_entries(symbol_map: DataFrame, entries: DataFrame) -> DataFrame:
    return symbol_map.join(entries.select("user_ticker"), "user_ticker", "left_anti").unionByName(entries)


def delete_entry(symbol_map: DataFrame, ticker: str) -> DataFrame:
    """No-op for an unknown ticker."""
    return symbol_map.where(F.col("user_ticker") != ticker)


def rename_entry(symbol_map: DataFrame, old: str, entry: DataFrame) -> DataFrame:
    """Old key out, new row in, as one rewrite."""
    return upsert_entries(delete_entry(symbol_map, old), entry)


def known(selection: DataFrame, symbol_map: DataFrame, key: str = "symbol") -> DataFrame:
    """Selected tickers with their rules; duplicates in the selection count once."""
    sel = selection.select(F.col(key).alias("user_ticker")).distinct()
    return sel.join(symbol_map, "user_ticker", "inner")


def unknown(selection: DataFrame, symbol_map: DataFrame, key: str = "symbol") -> DataFrame:
    """Selected tickers that the inventory lacks."""
    sel = selection.select(F.col(key).alias("user_ticker")).distinct()
    return sel.join(symbol_map, "user_ticker", "left_anti")


def any_single_source(selection: DataFrame, symbol_map: DataFrame, key: str = "symbol") -> DataFrame:
    """One row: does any selected ticker depend on the credentialed source alone."""
    hit = known(selection, symbol_map, key).agg(F.max((F.col("source_strategy") == CAPITAL_ONLY).cast("int")).alias("m"))
    return hit.select((F.coalesce(F.col("m"), F.lit(0)) == 1).alias("any_capital_only"))


def display(symbol_map: DataFrame) -> DataFrame:
    """The inventory as it is shown: Ticker, Epic, Strategy, in ticker order."""
    return symbol_map.select(F.col("user_ticker").alias("Ticker"), F.col("capital_epic").alias("Epic"), F.col("source_strategy").alias("Strategy")).orderBy("Ticker")


def as_lookup(symbol_map: DataFrame) -> dict[str, dict[str, str]]:
    """Python mapping for callers outside Spark; the inventory is a hand-kept dimension."""
    return {r.user_ticker: {"epic": r.capital_epic, "strategy": r.source_strategy} for r in symbol_map.orderBy("user_ticker").collect()}
