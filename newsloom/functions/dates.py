"""Times: daily schedules and the date formats found in feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.basics import as_col


def moment(now) -> Column:
    """``now`` as a zone-less timestamp: a Column, a datetime or an ISO text."""
    if isinstance(now, Column):
        return now
    if isinstance(now, dt.datetime):
        now = now.replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(now).cast("timestamp_ntz")


def valid_time(value) -> Column:
    value = as_col(value)
    return F.when(value.rlike(fixed.TIME_PATTERN), value).otherwise(fixed.DEFAULT_TIME)


def today_at(now, time) -> Column:
    """The day of ``now`` at "HH:MM"."""
    day = F.date_format(moment(now), "yyyy-MM-dd")
    return F.concat(day, F.lit(" "), valid_time(time), F.lit(":00")).cast("timestamp_ntz")


def next_daily_run(now, time) -> Column:
    at = today_at(now, time)
    return F.when(at > moment(now), at).otherwise(at + F.expr("INTERVAL 1 DAY"))


def ran_today(last_run, now) -> Column:
    """False for an empty or unreadable value: those count as never run."""
    parsed = F.try_to_timestamp(as_col(last_run)).cast("date")
    return F.coalesce(parsed == moment(now).cast("date"), F.lit(False))


def feed_date(value) -> Column:
    """RFC 822 dates (day name allowed but not read) and ISO dates, as UTC; else null."""
    text = F.trim(as_col(value))
    rfc = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    rfc = F.regexp_replace(rfc, r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-"), text)),
    )
