"""Streaming ingestion: watermarked candle building and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candleforge.operators.schemas import CANDLE_COLS
from candleforge.operators.sessions import session_of
from candleforge.operators.store import CandleStore


def build_candles(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(ts timestamp, symbol, value, event_id) ticks to closed one-minute candles; ticks later than the watermark are dropped."""
    order = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "symbol").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume")
    )
    return bars.withColumn("timestamp", F.col("window.start").cast("timestamp_ntz")).withColumn("session", session_of("timestamp")).select(*CANDLE_COLS)


def upsert_stream(candles: DataFrame, store: CandleStore, checkpoint: str) -> StreamingQuery:
    """Commit each micro-batch; a batch replayed after a failure changes nothing, as upserts are idempotent."""

    def commit(batch: DataFrame, _: int) -> None:
        store.commit(batch)

    return candles.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
