"""Candles, sources and an inventory derived from the synthetic tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.functions.timez import minute_of
from candleforge.operators.sessions import session_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bars(events: DataFrame, symbol: Column | None = None) -> DataFrame:
    """Every event as a one-tick bar: (timestamp, symbol, session, source, value, event_id); repeated minutes stay. One
    symbol in eight is unknown to the primary source."""
    sym = symbol if symbol is not None else F.concat(F.lit("SYM"), F.col("user_id").cast("string"))
    return events.select(
        minute_of("ts").alias("timestamp"), sym.alias("symbol"), session_of("ts").alias("session"),
        F.when(F.col("event_type").isin("click", "view") & (F.col("user_id") % 8 != 5), "primary").otherwise("fallback").alias("source"), "ts", "value", "event_id",
    )


def candles(events: DataFrame, symbol: Column | None = None) -> DataFrame:
    """One-minute candles per symbol."""
    sym = symbol if symbol is not None else F.concat(F.lit("SYM"), F.col("user_id").cast("string"))
    order = F.struct("ts", "event_id")
    return (
        events.groupBy(minute_of("ts").alias("timestamp"), sym.alias("symbol"))
        .agg(
            F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", order).alias("close"), F.round(F.sum("value"), 2).alias("volume"),
        )
        .withColumn("session", session_of("timestamp"))
    )


def symbol_map(customer: DataFrame) -> DataFrame:
    """Every ticker but each tenth, so that some selected ones are unknown."""
    key = F.col("c_custkey").cast("string")
    return customer.where(F.col("c_custkey") % 10 != 0).select(
        F.concat(F.lit("SYM"), key).alias("user_ticker"), F.concat(F.lit("EPIC"), key).alias("capital_epic"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "CAPITAL_ONLY").otherwise("HYBRID").alias("source_strategy"),
    )
