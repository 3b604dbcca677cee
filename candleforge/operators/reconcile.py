"""Source fallback, caps and deterministic last-wins merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "symbol") -> DataFrame:
    """Every primary row, and fallback rows of keys that the primary lacks altogether."""
    served = primary.select(key).distinct()
    return primary.unionByName(fallback.join(served, key, "left_anti"))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last in a total order.

    max_by over a struct combines map-side, so a key repeated across files shrinks before the shuffle;
    rows whose keys are NULL form one group, as GROUP BY does.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def merge_sessions(parts: DataFrame, tie_break: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """One bar per (symbol, timestamp); the later session wins a shared edge bar, then the larger values."""
    rank = F.when(F.col("session") == "POST", 2).when(F.col("session") == "REG", 1).otherwise(0)
    return keep_last(parts, ("symbol", "timestamp"), [rank, *[F.col(c) for c in tie_break]])


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], incoming_order: Sequence[Column] = ()) -> DataFrame:
    """Whole-row last-write-wins: incoming rows replace existing ones of the same key, NULLs included.

    Of incoming rows that share a key, the last in incoming_order stays, by default the greatest row.
    """
    latest = keep_last(incoming, keys, incoming_order or [F.col(c) for c in incoming.columns if c not in keys])
    return existing.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest)


def cap_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = 1000) -> DataFrame:
    """First rows per request, as the source caps them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
