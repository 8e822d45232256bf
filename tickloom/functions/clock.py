"""Market session and trading-day functions. Local market time is a fixed +09:00."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Opening and closing time of the regular session, hours ahead of UTC, and
# the days before the end of the holiday list when a warning starts.
OPEN_TIME, CLOSE_TIME, UTC_OFFSET_HOURS, EXPIRY_WARNING_DAYS = "09:00:00.000000", "15:30:00.000000", 9, 60


def local_time(utc: str | Column) -> Column:
    c = F.col(utc) if isinstance(utc, str) else utc
    return c + F.make_dt_interval(hours=F.lit(UTC_OFFSET_HOURS))


def is_trading_day(day: Column, holidays: Iterable[date] = ()) -> Column:
    """Monday to Friday outside ``holidays``, decided for any date on its own."""
    closed = sorted(set(holidays))
    open_day = F.weekday(day) < 5
    return open_day & ~day.isin(*closed) if closed else open_day


def next_trading_day(day: Column, holidays: Iterable[date] = ()) -> Column:
    """First trading day after ``day``. At most all holidays and a weekend on either side can lie between."""
    closed = sorted(set(holidays))
    days = F.sequence(F.date_add(day, 1), F.date_add(day, _longest_closure(closed) + 1))
    return F.element_at(F.filter(days, lambda d: is_trading_day(d, closed)), 1)


def _longest_closure(closed: list[date]) -> int:
    """Days of the longest run of weekends and holidays."""
    shut = set(closed)
    longest = 2
    for start in closed:
        first, last = start - timedelta(days=1), start
        while first.weekday() > 4 or first in shut:
            first -= timedelta(days=1)
        while last.weekday() > 4 or last in shut:
            last += timedelta(days=1)
        longest = max(longest, (last - first).days - 1)
    return longest


def add_session(df: DataFrame, holidays: Iterable[date] = (), utc: str = "signal_at") -> DataFrame:
    """Session of a time stamp and the day it can be traded on."""
    local = local_time(utc)
    closed = sorted(set(holidays))
    out = df.withColumns({"day": local.cast("date"), "_time": F.date_format(local, "HH:mm:ss.SSSSSS")})
    session = (
        F.when(~is_trading_day(F.col("day"), closed), "holiday")
        .when(F.col("_time").isNull(), F.lit(None))
        .when(F.col("_time") < OPEN_TIME, "pre_market")
        .when(F.col("_time") <= CLOSE_TIME, "regular")
        .otherwise("after_market")
    )
    out = out.withColumn("market_session", session)
    shifted = F.col("market_session").isin("after_market", "holiday")
    return out.withColumn(
        "effective_trading_day", F.when(shifted, next_trading_day(F.col("day"), closed)).otherwise(F.col("day"))
    ).drop("_time")


def calendar_coverage(day: Column, coverage_end: date) -> Column:
    left = F.datediff(F.lit(coverage_end), day)
    return (
        F.when(day.isNull(), "unknown")
        .when(left < 0, "expired")
        .when(left <= EXPIRY_WARNING_DAYS, "near_expiry")
        .otherwise("ok")
    )


def context_policy(input_day: Column, context_day: Column, max_gap: int = 3) -> Column:
    """Struct (allowed, gap_days, reason) of the distance between data and context."""
    gap = F.abs(F.datediff(context_day, input_day))
    reason = F.when(gap.isNull(), "missing_context_date").when(gap > max_gap, "context_date_gap_exceeded")
    return F.struct(reason.isNull().alias("allowed"), gap.alias("gap_days"), reason.alias("reason"))


def is_stale(day: Column, today: Column, max_age: int = 30) -> Column:
    return F.coalesce(F.datediff(today, day) > max_age, F.lit(False))
