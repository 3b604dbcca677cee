"""Session windows: tagging unlabelled bars and cutting requests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.functions import timez
from candleforge.operators.profile import FULL, Profile, Session


def session_of(ts_utc: Column | str, profile: Profile = FULL) -> Column:
    """Half-open session of an instant, NULL outside all."""
    minute = timez.eastern_minute(ts_utc)
    out = F.lit(None).cast("string")
    for s in profile.sessions:
        out = F.when((minute >= s.start_minute) & (minute < s.end_minute), F.lit(s.name)).otherwise(out)
    return out


def within(df: DataFrame, date: dt.date, session: Session, ts: str = "timestamp") -> DataFrame:
    """Bars of one request window, both ends included: neighbouring sessions share their edge bar."""
    return df.where(F.col(ts).between(timez.wall_to_utc(date, session.start_minute), timez.wall_to_utc(date, session.end_minute)))


def tagged(df: DataFrame, date: dt.date, windows: Sequence[Session], ts: str = "timestamp") -> DataFrame:
    """Bars with the session of every request window that they lie in, a bar on a shared edge once for each; others go.
    Windows are literal UTC bounds, and those around all of them are a filter on the bare column."""
    ends = [(timez.wall_to_utc(date, s.start_minute), timez.wall_to_utc(date, s.end_minute), s.name) for s in sorted(windows, key=lambda s: s.start_minute)]
    around = df.where(F.col(ts).between(ends[0][0], ends[-1][1]))
    names = F.array(*[F.when(F.col(ts).between(lo, hi), F.lit(name)) for lo, hi, name in ends])
    return around.withColumn("session", F.explode(F.array_compact(names)))


def window_relation(spark: SparkSession, date: dt.date, mode: str, profile: Profile = FULL) -> DataFrame:
    """(session, start_utc, end_utc, expected, priority) of a harvest; a few literal rows."""
    rows = [(s.name, s.expected, s.priority, date, s.start_minute, s.end_minute) for s in profile.active(mode)]
    base = spark.createDataFrame(rows, "session string, expected int, priority int, d date, a int, b int")

    def at(c: str) -> Column:
        wall = F.col("d").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col(c))
        return timez.zone_to_utc(wall, timez.EASTERN)

    return base.select("session", at("a").alias("start_utc"), at("b").alias("end_utc"), "expected", "priority")


def request_windows(requests: DataFrame, now: Column, hours: int = 16) -> DataFrame:
    """Clamp (start_utc, end_utc) to the source's history and to now; windows left empty go."""
    start, end = timez.clamp_start("start_utc", now, hours), timez.clamp_end("end_utc", now)
    return requests.withColumns({"start_utc": start, "end_utc": end}).where(F.col("start_utc") < F.col("end_utc"))
