"""Column functions over times: two zones, month arithmetic, periods, durations, freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
#: Zone of times that are written without one.
LOCAL_OFFSET = "+08:00"
# Periods before a reference; a fortnight is 15 days here, and months are clamped to the month's last day.
PERIODS = {"week": ("days", 7), "fortnight": ("days", 15), "month": ("months", 1), "quarter": ("months", 3), "half": ("months", 6), "year": ("months", 12)}
# Durations in days, lower bound exclusive, upper inclusive; the first four overlap.
DURATIONS = {"week": (None, 7), "fortnight": (None, 14), "month": (None, 30), "two_months": (None, 60), "half_year": (60, 180), "year": (180, 365), "over_year": (365, None)}


def parse_time(value: Column, offset: str = LOCAL_OFFSET) -> Column:
    """ISO time with its zone, or a time without one at the local offset; null if it is no time."""
    raw = F.trim(value)
    naive = raw.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$")
    return F.when(naive, F.try_to_timestamp(F.concat(F.replace(raw, F.lit("T"), F.lit(" ")), F.lit(offset)))).otherwise(F.try_to_timestamp(raw))


def parse_zoned_time(value: Column) -> Column:
    """Only times that name their zone; null for the rest."""
    return F.when(F.trim(value).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.trim(value)))


def months_before(reference: Column, months: int, zone: str | None = LOCAL_OFFSET) -> Column:
    """The same wall-clock time so many months earlier, the day clamped; zone None: UTC."""
    local = reference if zone is None else F.from_utc_timestamp(reference, zone)
    day = F.add_months(F.to_date(local), -months)
    moved = day.cast("timestamp") + (local - F.date_trunc("day", local))
    return moved if zone is None else F.to_utc_timestamp(moved, zone)


def in_period(time: Column, reference: Column, period: str, zone: str | None = LOCAL_OFFSET) -> Column:
    """Whether time lies in the period before reference; future and missing times don't."""
    unit, n = PERIODS[period]
    start = reference - F.make_dt_interval(days=F.lit(n)) if unit == "days" else months_before(reference, n, zone)
    return F.coalesce((time >= start) & (time <= reference), F.lit(False))


def in_duration(seconds: Column, name: str) -> Column:
    low, high = DURATIONS[name]
    test = F.lit(True)
    if low is not None:
        test = test & (seconds > low * DAY)
    if high is not None:
        test = test & (seconds <= high * DAY)
    return test


def running_seconds(elapsed: Column, checked_at: Column, now: Column) -> Column:
    """Seconds a process has run: what was measured and what has passed since, neither below 0."""
    passed = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(checked_at), F.lit(0))
    return F.greatest(F.coalesce(elapsed, F.lit(0)), F.lit(0)) + F.coalesce(passed, F.lit(0))


def fresh(time: Column, now: Column, ahead_s: int = 300, behind_s: int = 7200) -> Column:
    """Whether a report is at most behind_s old and at most ahead_s in the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp(time)
    return F.coalesce(age.between(-ahead_s, behind_s), F.lit(False))


def local_text(time: Column, style: str = "minute", offset: str = LOCAL_OFFSET) -> Column:
    """A time in the local zone as text: style date, minute or second."""
    pattern = {"date": "yyyy-MM-dd", "minute": "yyyy-MM-dd HH:mm", "second": "yyyy-MM-dd HH:mm:ss"}[style]
    return F.date_format(F.from_utc_timestamp(time, offset), pattern)


def bounded_clock(sent: Column, received: Column, remote_start: Column, remote_end: Column, remote_now: Column) -> Column:
    """(earliest, latest) of a remote observation on the own clock, when the remote clock was read between sent and received."""
    return F.struct((sent + (remote_start - remote_now)).alias("earliest"), (received + (remote_end - remote_now)).alias("latest"))
