"""Export and preview."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.functions.timez import iso_utc


def csv_name(date: dt.date) -> str:
    return f"backup_{date:%Y%m%d}.csv"


def for_csv(candles: DataFrame) -> DataFrame:
    return candles.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ssxxx"))


def write_csv(candles: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. A single file puts the write on one task: for previews of one day only."""
    out = for_csv(candles)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).csv(path)


def iso_rows(candles: DataFrame) -> DataFrame:
    return candles.withColumn("timestamp", iso_utc("timestamp"))


def preview_series(candles: DataFrame, symbol: str) -> DataFrame:
    """Line series of one symbol in time order."""
    return candles.where(F.col("symbol") == symbol).select("timestamp", "close", "session").orderBy("timestamp")


def distinct_symbols(candles: DataFrame) -> DataFrame:
    return candles.select("symbol").distinct()


def default_selection(symbol_map: DataFrame, n: int = 2) -> DataFrame:
    return symbol_map.select("user_ticker").orderBy("user_ticker").limit(n)
