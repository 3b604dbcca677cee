"""Raw source frames to candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candleforge.functions import timez
from candleforge.operators.schemas import PRICES_JSON, as_candles

_PRICES = ("open", "high", "low", "close", "volume")


def _number(c: Column) -> Column:
    """NaN means no value in the store."""
    v = c.cast("double")
    return F.when(~F.isnan(v), v)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def flatten_names(df: DataFrame, separator: str = "|") -> DataFrame:
    """Two-level headers arrive as 'Level0|Level1'; level 0 is the name."""
    return df.toDF(*[c.split(separator)[0] for c in df.columns])


def extract_prices(payloads: DataFrame, body: str = "payload") -> DataFrame:
    """JSON bodies to one row per bar, bid side. A missing or null price object gives NULL prices and keeps the row."""
    others = [F.col(c) for c in payloads.columns if c != body]
    parsed = payloads.select(*others, F.from_json(F.col(body), PRICES_JSON).alias("_p"))
    bars = parsed.select(*[c for c in parsed.columns if c != "_p"], F.explode("_p.prices").alias("_b"))
    names = {"open": "Open", "high": "High", "low": "Low", "close": "Close"}
    return bars.select(
        *[c for c in bars.columns if c != "_b"],
        F.col("_b.snapshotTime").alias("SnapshotTime"),
        *[F.col(f"_b.{k}Price.bid").alias(v) for k, v in names.items()],
        F.col("_b.lastTradedVolume").alias("Volume"),
    )


def from_snapshots(bars: DataFrame, session: Column | str, symbol: Column | str = "symbol") -> DataFrame:
    """Source A bars: SnapshotTime text (naive text is the source's local time), capitalised prices."""
    label = F.lit(session) if isinstance(session, str) else session
    ts = timez.parse_instant("SnapshotTime") if dict(bars.dtypes)["SnapshotTime"] == "string" else F.col("SnapshotTime")
    out = bars.select(
        ts.alias("timestamp"), (F.col(symbol) if isinstance(symbol, str) else symbol).alias("symbol"),
        *[_number(F.col(c.capitalize())).alias(c) for c in _PRICES], label.alias("session"),
    )
    return as_candles(out.where(F.col("timestamp").isNotNull()))


def from_bars(bars: DataFrame, symbol: Column | str = "symbol", naive_zone: str = timez.EASTERN) -> DataFrame:
    """Source B bars: a Datetime column (TIMESTAMP is an instant, TIMESTAMP_NTZ is wall-clock of naive_zone), session REG."""
    kind = dict(bars.dtypes)["Datetime"]
    ts = F.col("Datetime").cast("timestamp_ntz") if kind == "timestamp" else timez.zone_to_utc(F.col("Datetime").cast("timestamp_ntz"), naive_zone)
    out = bars.select(
        ts.alias("timestamp"), (F.col(symbol) if isinstance(symbol, str) else symbol).alias("symbol"),
        *[_number(F.col(c.capitalize())).alias(c) for c in _PRICES], F.lit("REG").alias("session"),
    )
    return as_candles(out.where(F.col("timestamp").isNotNull()))
