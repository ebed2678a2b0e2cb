"""Feed times: wall clock in Israel to UTC, ages, open ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Jerusalem"
START, END = "2000-01-01 00:00:00", "2099-12-31 23:59:59"
STALE_DAYS, TERMS_DAYS = 30, 90


def il_time(date: Column, hour: Column | None = None) -> Column:
    """A wall clock time in one of the feeds' formats as an instant; null if it is none."""
    d = F.trim(date)
    day = (
        F.when(d.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}"), F.replace(F.left(d, F.lit(10)), F.lit("/"), F.lit("-")))
        .when(d.rlike(r"^\d{2}/\d{2}/\d{4}"), F.concat(F.substring(d, 7, 4), F.lit("-"), F.substring(d, 4, 2), F.lit("-"), F.left(d, F.lit(2))))
    )
    own = F.regexp_extract(d, r"[ T](\d{2}:\d{2}(?::\d{2})?)", 1)
    given = F.lit("") if hour is None else F.trim(F.coalesce(hour, F.lit("")))
    clock = F.when(given != "", given).when(own != "", own).otherwise("00:00:00")
    clock = F.when(F.char_length(clock) == 5, F.concat(clock, F.lit(":00"))).when(F.char_length(clock) == 2, F.concat(clock, F.lit(":00:00"))).otherwise(clock)
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm:ss")), ZONE)


def promo_window(start: Column, end: Column) -> tuple[Column, Column]:
    """Start and end with open ends filled in; an end before its start is open."""
    first = F.coalesce(start, F.to_utc_timestamp(F.lit(START).cast("timestamp"), ZONE))
    last = F.coalesce(end, F.to_utc_timestamp(F.lit(END).cast("timestamp"), ZONE))
    return first, F.when(last < first, F.to_utc_timestamp(F.lit(END).cast("timestamp"), ZONE)).otherwise(last)


def age_days(since: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(since)) / 86_400_000_000)


def active(start: Column, end: Column, now: Column) -> Column:
    return (start <= now) & (end >= now)
