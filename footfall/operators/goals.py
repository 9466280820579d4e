"""Goal conversions and event statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.text import iso_date, percent, round_half_up
from footfall.operators.filters import filter_period, flag_periods, is_other_event
from footfall.period import ArgumentError, Period

GOAL_MAX = 256


def check_goal(goal: str) -> str:
    if not isinstance(goal, str) or not goal or len(goal) > GOAL_MAX:
        raise ArgumentError(f"a goal has 1 to {GOAL_MAX} characters", "INVALID_GOAL")
    return goal


def _session_totals(flagged: DataFrame) -> DataFrame:
    """One row: distinct sessions of all events, now and before."""
    per_session = (
        flagged.where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.bool_or("is_current").alias("now"), F.bool_or(~F.col("is_current")).alias("before")
        )
    )
    return per_session.agg(
        F.struct(F.count_if("now").alias("now"), F.count_if("before").alias("before"))
    )


def _counts(flagged: DataFrame, *keys: str) -> DataFrame:
    """Events, distinct users and distinct sessions, now and before, per key.

    Each event becomes one row for its session and one for its user, and rows combine per
    entity before the shuffle; the second aggregate then only counts entities, so no
    distinct set is ever held in one place.
    """
    entity = F.explode(
        F.array(
            F.struct(F.lit("session").alias("kind"), F.col("session_id").alias("key")),
            F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("key")),
        )
    ).alias("entity")
    per_entity = (
        flagged.select(*keys, entity, "is_current")
        .groupBy(*keys, "entity.kind", "entity.key")
        .agg(
            F.count_if(F.col("is_current")).alias("now"),
            F.count_if(~F.col("is_current")).alias("before"),
        )
    )

    def distinct(kind: str, period: str) -> Column:
        return F.count_if((F.col("kind") == kind) & F.col("key").isNotNull() & (F.col(period) > 0))

    def events(period: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == "session", F.col(period))), F.lit(0))

    return per_entity.groupBy(*keys).agg(
        events("now").alias("count"),
        distinct("user", "now").alias("unique_users"),
        distinct("session", "now").alias("unique_sessions"),
        events("before").alias("prev_count"),
        distinct("user", "before").alias("prev_unique_users"),
        distinct("session", "before").alias("prev_unique_sessions"),
    )


def _with_rates(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """Adds the rates; the totals are one row of two numbers, whatever the events' size."""
    rows = rows.withColumn("sessions", _session_totals(flagged).scalar())
    count, prev = F.col("count"), F.col("prev_count")
    change = F.when(prev == 0, F.when(count > 0, 100.0).otherwise(0.0)).otherwise(
        round_half_up((count - prev) / F.greatest(prev, F.lit(1)) * 10000) / F.lit(100.0)
    )
    return rows.select(
        "goal",
        "count",
        "unique_users",
        "unique_sessions",
        percent(F.col("unique_sessions"), F.col("sessions.now")).alias("conversion_rate"),
        "prev_count",
        "prev_unique_users",
        "prev_unique_sessions",
        percent(F.col("prev_unique_sessions"), F.col("sessions.before")).alias(
            "prev_conversion_rate"
        ),
        change.alias("change"),
    )


def goal_conversion(events: DataFrame, period: Period, goal: str) -> DataFrame:
    """One row for ``goal`` (any event type, page views included), zeros when unseen."""
    flagged = flag_periods(events, period)
    counted = _counts(flagged.where(F.col("event_type") == check_goal(goal)))
    return _with_rates(counted.withColumn("goal", F.lit(goal)), flagged)


def all_goal_conversions(events: DataFrame, period: Period) -> DataFrame:
    """One row per non-pageview event type of the current period.

    Two lean scans: session ids of everything, and the other columns of goal events only.
    """
    flagged = flag_periods(events, period)
    counted = _counts(flagged.where(is_other_event()), "event_type")
    listed = counted.where(F.col("count") > 0).withColumnRenamed("event_type", "goal")
    return _with_rates(listed, flagged)


def event_stats(events: DataFrame, period: Period) -> DataFrame:
    """Non-pageview event types of the current period with their previous counts."""
    current = F.col("is_current")
    return (
        flag_periods(events, period)
        .where(is_other_event())
        .groupBy("event_type")
        .agg(
            F.count_if(current).alias("count"),
            F.count_distinct(F.when(current, F.col("user_id"))).alias("unique_users"),
            F.count_if(~current).alias("prev_count"),
        )
        .where(F.col("count") > 0)
        .orderBy(F.desc("count"), "event_type")
    )


def event_trend(events: DataFrame, period: Period) -> DataFrame:
    """Non-pageview events per type and UTC day that has any."""
    return (
        filter_period(events, period)
        .where(is_other_event())
        .groupBy("event_type", iso_date(F.col("timestamp")).alias("date"))
        .agg(F.count("*").alias("count"))
        .orderBy("date", "event_type")
    )
