"""Fixed schemas; nothing here is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDLE = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType(), False), T.StructField("symbol", T.StringType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
    + [T.StructField("session", T.StringType())]
)
CANDLE_COLS = CANDLE.names
KEY = ("symbol", "timestamp")

SYMBOL_MAP = T.StructType([T.StructField("user_ticker", T.StringType(), False), T.StructField("capital_epic", T.StringType(), False), T.StructField("source_strategy", T.StringType())])

_QUOTE = T.StructType([T.StructField("bid", T.DoubleType())])
PRICES_JSON = T.StructType(
    [
        T.StructField(
            "prices",
            T.ArrayType(
                T.StructType(
                    [T.StructField("snapshotTime", T.StringType())]
                    + [T.StructField(f"{side}Price", _QUOTE) for side in ("open", "high", "low", "close")]
                    + [T.StructField("lastTradedVolume", T.DoubleType())]
                )
            ),
        )
    ]
)


def empty_candles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CANDLE)


def as_candles(df: DataFrame) -> DataFrame:
    """Exactly the candle columns, in order and type; extra columns go, a missing one is an error."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CANDLE])
