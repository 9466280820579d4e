"""Daily rollup of old events and pruning of what is past its keep time."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.text import iso_date
from footfall.model import METRICS
from footfall.operators.filters import instant, is_pageview, prune_dates
from footfall.period import ArgumentError, parse_instant


@dataclass(frozen=True)
class Retention:
    keep_raw_days: float = 30
    keep_rollup_days: float = 365
    auto_rollup: bool = True

    def __post_init__(self):
        for name in ("keep_raw_days", "keep_rollup_days"):
            days = getattr(self, name)
            number = isinstance(days, (int, float)) and not isinstance(days, bool)
            if not number or not math.isfinite(days) or days < 0:
                raise ArgumentError(f"{name} must be a non-negative number", "INVALID_RETENTION")

    def cutoff(self, as_of) -> datetime:
        return parse_instant(as_of) - timedelta(days=self.keep_raw_days)

    def rollup_cutoff(self, as_of) -> datetime:
        return parse_instant(as_of) - timedelta(days=self.keep_rollup_days)


def expired_events(events: DataFrame, cutoff: datetime) -> DataFrame:
    return prune_dates(events, None, cutoff).where(F.col("timestamp") < instant(cutoff))


def _not_before(column: str, cutoff: datetime) -> Column:
    """Pruning removes what is older; a row without a time is not."""
    return F.coalesce(F.col(column) >= instant(cutoff), F.lit(True))


def prune_events(events: DataFrame, cutoff: datetime) -> DataFrame:
    """Drop events older than ``cutoff``; those without a time stay."""
    if "event_date" in events.columns:
        events = events.where(F.col("event_date").isNull() | (F.col("event_date") >= F.lit(cutoff.date())))
    return events.where(_not_before("timestamp", cutoff))


def daily_counts(events: DataFrame, metric: Column) -> DataFrame:
    return events.groupBy(
        iso_date(F.col("timestamp")).alias("date"),
        metric.alias("metric"),
        F.lit("").alias("dimension"),
    ).agg(F.count("*").alias("value"))


def rollup_pageviews(events: DataFrame, cutoff: datetime) -> DataFrame:
    return daily_counts(expired_events(events, cutoff).where(is_pageview()), F.lit("pageviews"))


def rollup_events(events: DataFrame, cutoff: datetime) -> DataFrame:
    return daily_counts(expired_events(events, cutoff).where(~is_pageview()), F.col("event_type"))


def merge_metrics(metrics: DataFrame, added: DataFrame) -> DataFrame:
    """Add counts per (date, metric, dimension); a NULL dimension is the empty one."""
    both = metrics.select(*METRICS.names).unionByName(added.select(*METRICS.names))
    return both.groupBy(
        "date", "metric", F.coalesce("dimension", F.lit("")).alias("dimension")
    ).agg(F.sum("value").alias("value"))


def rollup_metrics(events: DataFrame, metrics: DataFrame, cutoff: datetime) -> DataFrame:
    """Stored metrics plus the daily counts of events older than ``cutoff``.

    Page views go to 'pageviews', any other type to its own name, in one scan. A custom
    event that is itself called 'pageviews' lands on the same key.
    """
    metric = F.when(is_pageview(), "pageviews").otherwise(F.col("event_type"))
    return merge_metrics(metrics, daily_counts(expired_events(events, cutoff), metric))


def prune_metrics(metrics: DataFrame, cutoff: datetime) -> DataFrame:
    """Drop days up to and including the cutoff's own."""
    return metrics.where(F.col("date") > cutoff.date().isoformat())


def prune_sessions(sessions: DataFrame, cutoff: datetime) -> DataFrame:
    return sessions.where(_not_before("last_seen_at", cutoff))


def prune_users(users: DataFrame, retained: DataFrame, cutoff: datetime) -> DataFrame:
    """Drop users last seen before ``cutoff`` that have no event in ``retained``.

    Only stale users meet the events, each event user once.
    """
    stale = ~_not_before("last_seen", cutoff)
    active = retained.select(F.col("user_id").alias("id")).where("id IS NOT NULL").distinct()
    kept = users.where(stale).join(active, "id", "left_semi").select(*users.columns)
    return users.where(~stale).unionByName(kept)


def anti_join_users(users: DataFrame, events: DataFrame) -> DataFrame:
    """Users without any event."""
    active = events.select(F.col("user_id").alias("id")).where("id IS NOT NULL").distinct()
    return users.join(active, "id", "left_anti").select(*users.columns)


def retention_rollup(
    events: DataFrame,
    sessions: DataFrame,
    users: DataFrame,
    metrics: DataFrame,
    *,
    as_of,
    retention: Retention = Retention(),
) -> dict[str, DataFrame]:
    """The four tables after a rollup at ``as_of``, as lazy frames.

    Running it again on its own result changes nothing, since rolled-up events are gone.
    `store.roll_up` does it on stored tables, without rewriting what stays.
    """
    if not retention.auto_rollup:
        return {"events": events, "sessions": sessions, "users": users, "metrics": metrics}
    cutoff = retention.cutoff(as_of)
    retained = prune_events(events, cutoff)
    return {
        "events": retained,
        "sessions": prune_sessions(sessions, cutoff),
        "users": prune_users(users, retained, cutoff),
        "metrics": prune_metrics(
            rollup_metrics(events, metrics, cutoff), retention.rollup_cutoff(as_of)
        ),
    }
