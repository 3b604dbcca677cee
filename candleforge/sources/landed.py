"""Landed inputs: recorded payloads and bar files, with declared schemas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.functions.timez import wall_to_utc
from candleforge.operators.schemas import CANDLE

BAR_SCHEMA = "symbol string, Datetime timestamp, Open double, High double, Low double, Close double, Volume double"


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {symbol, payload}; unreadable lines are dropped into a `_bad` column."""
    return spark.read.schema("symbol string, payload string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def bar_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(BAR_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def bars_of_day(bars: DataFrame, date: dt.date) -> DataFrame:
    """Bars of [date, date + 1) Eastern within regular hours, edges included. The bounds are literals beside the bare
    column, a TIMESTAMP instant or a TIMESTAMP_NTZ of Eastern wall-clock, so they reach the scan."""
    wall = [dt.datetime.combine(date, dt.time(9, 30)), dt.datetime.combine(date, dt.time(16))]
    if dict(bars.dtypes)["Datetime"] == "timestamp":
        ends = [wall_to_utc(date, t.hour * 60 + t.minute).cast("timestamp") for t in wall]
    else:
        ends = [F.lit(t).cast("timestamp_ntz") for t in wall]
    return bars.where((F.col("Datetime") >= ends[0]) & (F.col("Datetime") <= ends[1]))


def candle_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDLE).parquet(path)
