"""Session factory with the settings every plan here assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps NTZ candles, DuckDB TIMESTAMPs and ISO export in one frame; AQE re-plans skew and partition counts.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(app: str = "candleforge", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session; master is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (REQUIRED | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
