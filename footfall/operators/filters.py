"""Predicates that several jobs share."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.text import present
from footfall.period import Period

PAGEVIEW = "pageview"


def instant(value: datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def prune_dates(events: DataFrame, since: datetime | None, until: datetime | None) -> DataFrame:
    """Restrict the date partitions, where the table has them."""
    if "event_date" not in events.columns:
        return events
    if since is not None:
        events = events.where(F.col("event_date") >= F.lit(since.date()))
    if until is not None:
        events = events.where(F.col("event_date") <= F.lit(until.date()))
    return events


def in_current(period: Period) -> Column:
    """Closed current period."""
    return F.col("timestamp").between(instant(period.since), instant(period.until))


def in_previous(period: Period) -> Column:
    """Half-open previous period."""
    at = F.col("timestamp")
    return (at >= instant(period.prev_since)) & (at < instant(period.prev_until))


def filter_period(events: DataFrame, period: Period) -> DataFrame:
    return prune_dates(events, period.since, period.until).where(in_current(period))


def filter_prev_period(events: DataFrame, period: Period) -> DataFrame:
    return prune_dates(events, period.prev_since, period.prev_until).where(in_previous(period))


def flag_periods(events: DataFrame, period: Period) -> DataFrame:
    """Both periods in one scan; ``is_current`` tells them apart."""
    spanned = prune_dates(events, period.prev_since, period.until).where(
        F.col("timestamp").between(instant(period.prev_since), instant(period.until))
    )
    return spanned.withColumn("is_current", F.col("timestamp") >= instant(period.since))


def is_pageview() -> Column:
    return F.col("event_type") == PAGEVIEW


def is_other_event() -> Column:
    return F.col("event_type") != PAGEVIEW


def has_session() -> Column:
    return present(F.col("session_id"))


def literal_contains(text: Column, part: str, ignore_case: bool = False) -> Column:
    """Literal substring test; the wildcard characters of LIKE mean themselves."""
    if ignore_case:
        return F.lower(text).contains(part.lower())
    return text.contains(part)
