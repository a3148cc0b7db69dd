"""Dates and deadlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_until(deadline: Column, now: Column) -> Column:
    """Days, with fractions, from now; null without a deadline."""
    return F.timestamp_diff("MICROSECOND", now, deadline) / 86_400_000_000.0


def urgency(deadline: Column, now: Column) -> Column:
    """Bands of the days left, rounded up."""
    days = F.ceil(days_until(deadline, now))
    return F.when(deadline.isNull(), "none").when(days <= 0, "expired").when(days <= 3, "days3").when(days <= 7, "days7").when(days <= 14, "days14").otherwise("later")


def fiscal_start(now: Column, month: int = 10) -> Column:
    """The first day of the fiscal year that now is in."""
    year = F.year(now) - F.when(F.month(now) < month, 1).otherwise(0)
    return F.make_date(year, F.lit(month), F.lit(1))


def award_window(now: Column) -> Column:
    """The later of the fiscal year's start and six months ago."""
    return F.greatest(fiscal_start(now), F.add_months(now.cast("date"), -6))


def reminder_due(deadline: Column, now: Column) -> Column:
    """A day before the deadline, but not before now."""
    return F.greatest(now, deadline - F.expr("interval 24 hours"))


def is_friday(now: Column, zone: str = "America/Chicago") -> Column:
    return F.dayofweek(F.from_utc_timestamp(now, zone)) == 6


def us_date(day: Column) -> Column:
    """MM/dd/yyyy; null stays null."""
    return F.date_format(day, "MM/dd/yyyy")
