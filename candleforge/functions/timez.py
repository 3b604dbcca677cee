"""Time-zone and calendar expressions. Every instant is a TIMESTAMP_NTZ holding UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "US/Eastern"
SOURCE_A_ZONE = "Asia/Bahrain"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_to_zone(ts: Column | str, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts))


def zone_to_utc(ts: Column | str, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _col(ts))


def minute_of(ts: Column | str) -> Column:
    """Bar start: the instant truncated to its minute, still NTZ."""
    return F.date_trunc("MINUTE", _col(ts)).cast("timestamp_ntz")


def eastern_minute(ts_utc: Column | str) -> Column:
    """Minutes since Eastern midnight."""
    et = utc_to_zone(ts_utc, EASTERN)
    return F.hour(et) * 60 + F.minute(et)


def wall_to_utc(date: dt.date, minute: int) -> Column:
    """An Eastern wall-clock minute of a known date as a UTC literal: it folds, so the scan gets it as a pushed bound."""
    local = dt.datetime.combine(date, dt.time()) + dt.timedelta(minutes=minute)
    return zone_to_utc(F.lit(local).cast("timestamp_ntz"), EASTERN)


def in_regular_hours(ts_utc: Column | str) -> Column:
    """09:30 to 16:00 Eastern, both ends included (391 bars), for any date."""
    et = utc_to_zone(ts_utc, EASTERN)
    since_midnight = et - F.date_trunc("DAY", et).cast("timestamp_ntz")
    return since_midnight.between(F.expr("INTERVAL '09:30' HOUR TO MINUTE"), F.expr("INTERVAL '16:00' HOUR TO MINUTE"))


def parse_instant(text: Column | str, naive_zone: str = SOURCE_A_ZONE) -> Column:
    """ISO text to UTC: with an offset it is honoured, without one the text is wall-clock of naive_zone; bad text is NULL."""
    c = _col(text)
    aware = c.try_cast("timestamp").cast("timestamp_ntz")
    naive = zone_to_utc(c.try_cast("timestamp_ntz"), naive_zone)
    return F.when(c.rlike(_OFFSET), aware).otherwise(naive)


def iso_utc(ts: Column | str) -> Column:
    """ISO-8601 text ending in +00:00."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ssxxx")


def utc_day(ts: Column | str) -> Column:
    """UTC calendar day; ISO text is read with its offset, bad text is NULL."""
    return F.to_date(_col(ts))


def utc_day_of_text(text: Column | str) -> Column:
    return F.to_date(parse_instant(text, "UTC"))


def trading_date(now_et: Column | str) -> Column:
    """Date to harvest at an Eastern instant: before 09:30 the previous market day (no holiday calendar), else today."""
    et = _col(now_et)
    today, weekday = F.to_date(et), F.weekday(et)
    early = F.hour(et) * 60 + F.minute(et) < 9 * 60 + 30
    back = F.when(weekday == 0, 3).when(weekday == 6, 2).otherwise(1)
    return F.when(early, F.date_sub(today, back)).otherwise(today)


def market_open(ts_et: Column | str) -> Column:
    """09:30 on the day of an Eastern instant."""
    return F.date_trunc("DAY", _col(ts_et)).cast("timestamp_ntz") + F.expr("INTERVAL '09:30' HOUR TO MINUTE")


def month_start(d: Column | str) -> Column:
    return F.trunc(_col(d), "MONTH")


def month_end(d: Column | str) -> Column:
    return F.last_day(_col(d))


def month_name(d: Column | str) -> Column:
    return F.date_format(_col(d), "MMMM")


def month_number(name: Column | str) -> Column:
    """Number of an English month name; another text is NULL."""
    return F.month(F.try_to_timestamp(F.concat(F.lit("2000 "), _col(name)), F.lit("yyyy MMMM")))


def clamp_start(start: Column | str, now: Column | str, hours: int = 16) -> Column:
    """Requests older than the source's history start one minute inside it."""
    s, n = _col(start), _col(now)
    oldest = n - F.expr(f"INTERVAL {hours} HOURS")
    return F.when(s < oldest, oldest + F.expr("INTERVAL 1 MINUTE")).otherwise(s)


def clamp_end(end: Column | str, now: Column | str) -> Column:
    return F.least(_col(end), _col(now))
