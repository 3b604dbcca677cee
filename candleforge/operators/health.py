"""Health matrix: candle counts per symbol and UTC day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.functions.labels import count_text, heat_colour
from candleforge.operators.profile import FULL, Profile


def health_long(candles: DataFrame, symbols: Sequence[str] | None, start: dt.date | None = None, end: dt.date | None = None, session_filter: str = "Total") -> DataFrame:
    """(symbol, day, candle_count) for days in [start, end]; without a bound that side is open.

    Predicates stay on the bare columns, so they reach the Parquet scan; the end bound is the next
    midnight, which for minute bars equals a text bound of 23:59:59.
    """
    midnight = lambda d: F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz")
    rows = candles
    if start is not None:
        rows = rows.where(F.col("timestamp") >= midnight(start))
    if end is not None:
        rows = rows.where(F.col("timestamp") < midnight(end + dt.timedelta(days=1)))
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(list(symbols)))
    if session_filter != "Total":
        rows = rows.where(F.col("session") == session_filter)
    return rows.groupBy("symbol", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("candle_count"))


def days_between(start: dt.date, end: dt.date) -> list[dt.date]:
    return [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]


def health_matrix(long: DataFrame, days: Sequence[dt.date]) -> DataFrame:
    """symbol x day in symbol order, NULL where there is no data. The day list is given, so the pivot needs no extra job and its columns are stable."""
    wide = long.groupBy("symbol").pivot("day", list(days)).agg(F.first("candle_count"))
    return wide.toDF("symbol", *[d.isoformat() for d in days]).orderBy("symbol")


def unpivot_matrix(matrix: DataFrame) -> DataFrame:
    """Back to (symbol, day, candle_count) rows that have data."""
    long = matrix.unpivot("symbol", [c for c in matrix.columns if c != "symbol"], "day", "candle_count")
    return long.where(F.col("candle_count").isNotNull()).withColumn("day", F.to_date("day"))


def graded(long: DataFrame, session_filter: str = "Total", profile: Profile = FULL) -> DataFrame:
    """Counts with their colour and display text."""
    return long.select("symbol", "day", "candle_count", heat_colour(F.col("candle_count"), session_filter, profile).alias("colour"), count_text(F.col("candle_count")).alias("text"))
