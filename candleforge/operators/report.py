"""Report card: completeness per ticker, and the alerts drawn from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.functions.labels import mode_label, status_label
from candleforge.operators.profile import FULL, FULL_DAY, Profile


def session_counts(parts: DataFrame) -> DataFrame:
    """(symbol, pre, reg, post) before de-duplication and total after it, in one aggregate."""
    return parts.groupBy("symbol").agg(
        F.count_if(F.col("session") == "PRE").alias("pre"),
        F.count_if(F.col("session") == "REG").alias("reg"),
        F.count_if(F.col("session") == "POST").alias("post"),
        F.countDistinct("timestamp").alias("total"),
    )


def report_card(selected: DataFrame, parts: DataFrame, harvest_mode: str = FULL_DAY, profile: Profile = FULL) -> DataFrame:
    """One row per selected ticker of the inventory.

    selected: user_ticker, source_strategy. parts: candles before merging with a `source` of
    'primary' or 'fallback'. Tickers without bars are reported as failed.
    """
    regular = F.col("session") == "REG"
    counts = parts.groupBy("symbol").agg(
        *[F.count_if(F.col("session") == s.name).alias(s.label) for s in profile.sessions],
        F.countDistinct("timestamp").alias("Total"),
        F.count_if(regular & (F.col("source") == "primary")).alias("_primary"),
        F.count_if(regular & (F.col("source") == "fallback")).alias("_fallback"),
    )
    joined = selected.join(counts, selected["user_ticker"] == counts["symbol"], "left").na.fill(0, ["Total", "_primary", "_fallback", *[s.label for s in profile.sessions]])
    reg_runs = any(s.name == "REG" for s in profile.active(harvest_mode))
    graded = joined.withColumn("Mode", mode_label(F.col("source_strategy"), F.col("_primary"), F.col("_fallback"), reg_runs, profile))
    status = status_label(F.col("Total"), {s.name: F.col(s.label) for s in profile.sessions}, F.col("Mode"), harvest_mode, profile)
    return graded.select(F.col("user_ticker").alias("Ticker"), "Mode", *[s.label for s in profile.sessions], "Total", status.alias("Status"))


def failed(report: DataFrame) -> DataFrame:
    return report.where(F.col("Status").contains("Failed"))


def via_fallback(report: DataFrame) -> DataFrame:
    return report.where(F.col("Mode").contains("Fallback"))


def alerts(report: DataFrame) -> DataFrame:
    """One row: failures, fallbacks and the names of the latter."""
    fell_back = F.col("Mode").contains("Fallback")
    return report.agg(
        F.count_if(F.col("Status").contains("Failed")).alias("failures"),
        F.count_if(fell_back).alias("fallbacks"),
        F.array_join(F.array_sort(F.collect_list(F.when(fell_back, F.col("Ticker")))), ", ").alias("fallback_tickers"),
    )
