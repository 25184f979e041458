"""Lead times, ages and schedule resolution."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from duelmark.functions._col import col
from duelmark.functions.names import clean_text


def _micros(c) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def hours_between(earlier, later) -> Column:
    return (_micros(later) - _micros(earlier)) / 3.6e9


def lead_hours(snapshot, start) -> Column:
    """Hours from the snapshot to the start; positive before the start."""
    return hours_between(snapshot, start)


def lead_minutes(snapshot, start) -> Column:
    return (_micros(start) - _micros(snapshot)) / 6.0e7


def quote_age_minutes(quoted_at, now) -> Column:
    return F.greatest(F.lit(0.0), lead_minutes(quoted_at, now))


def age_years(born, at) -> Column:
    return F.datediff(col(at), col(born)) / 365.25


def _exact(candidates) -> Column:
    return F.coalesce(*[F.try_to_timestamp(clean_text(c)) for c in candidates])


def scheduled_start(date, *candidates) -> Column:
    """First non-blank exact timestamp, else the date at 00:00 UTC."""
    return F.coalesce(_exact(candidates), col(date).cast("date").cast("timestamp"))


def start_precision(date, *candidates) -> Column:
    return (F.when(_exact(candidates).isNotNull(), "exact")
            .when(col(date).isNotNull(), "date_only"))
