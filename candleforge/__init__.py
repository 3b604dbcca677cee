"""Candle ingestion, reconciliation and completeness auditing on Spark."""

from candleforge.operators.profile import FULL, LEGACY, Profile
from candleforge.session import get_spark

__all__ = ["FULL", "LEGACY", "Profile", "get_spark"]
