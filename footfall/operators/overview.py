"""Overview sections of a period."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.text import iso_date, present
from footfall.operators import goals
from footfall.operators.filters import (
    filter_period,
    filter_prev_period,
    flag_periods,
    instant,
    is_other_event,
    is_pageview,
)
from footfall.period import Period

TOP = 10
ACTIVE_MINUTES = 5


def _totals(events: DataFrame, **flags: Column) -> DataFrame:
    """Events, distinct sessions and distinct users per flag, in one row.

    Each event becomes one row per entity it names, and rows combine per entity before the
    shuffle, so a session or user with a large share of all rows costs one row per task.
    """
    entity = F.explode(
        F.array(
            F.struct(F.lit("session").alias("kind"), F.col("session_id").alias("key")),
            F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("key")),
        )
    ).alias("entity")
    flagged = events.select(entity, *[flag.alias(name) for name, flag in flags.items()])
    per_entity = flagged.groupBy("entity.kind", "entity.key").agg(
        *[F.count_if(F.col(name)).alias(name) for name in flags]
    )
    known, rows = F.col("key").isNotNull(), []
    for name in flags:
        seen = known & (F.col(name) > 0)
        rows += [
            F.coalesce(F.sum(F.when(F.col("kind") == "session", F.col(name))), F.lit(0)).alias(
                f"{name}_events"
            ),
            F.count_if(seen & (F.col("kind") == "session")).alias(f"{name}_sessions"),
            F.count_if(seen & (F.col("kind") == "user")).alias(f"{name}_users"),
        ]
    return per_entity.agg(*rows)


def overview_totals(events: DataFrame, period: Period) -> DataFrame:
    """One row: totals of the current and of the previous period."""
    flagged = flag_periods(events, period)
    totals = _totals(flagged, current=F.col("is_current"), previous=~F.col("is_current"))
    return totals.select(
        F.col("current_events").alias("total_events"),
        F.col("current_sessions").alias("unique_sessions"),
        F.col("current_users").alias("unique_users"),
        F.col("previous_events").alias("prev_total_events"),
        F.col("previous_sessions").alias("prev_unique_sessions"),
        F.col("previous_users").alias("prev_unique_users"),
    )


def overview_prev_totals(events: DataFrame, period: Period) -> DataFrame:
    totals = _totals(filter_prev_period(events, period), previous=F.lit(True))
    return totals.select(
        F.col("previous_events").alias("total_events"),
        F.col("previous_sessions").alias("unique_sessions"),
        F.col("previous_users").alias("unique_users"),
    )


def active_now(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Sessions seen in the five minutes before ``as_of``."""
    cutoff = instant(as_of - timedelta(minutes=ACTIVE_MINUTES))
    return sessions.where(F.col("last_seen_at") >= cutoff).agg(F.count("*").alias("active_now"))


def _ranked(rows: DataFrame, key: str, name: str, limit: int | None = None) -> DataFrame:
    """Rows per key, most frequent first; ties in key order."""
    counted = rows.groupBy(key).agg(F.count("*").alias(name))
    ordered = counted.orderBy(F.desc(name), F.asc(key))
    return ordered if limit is None else ordered.limit(limit)


def top_pages(events: DataFrame, period: Period, limit: int = TOP) -> DataFrame:
    views = filter_period(events, period).where(is_pageview() & F.col("url").isNotNull())
    return _ranked(views.select(F.col("url").alias("page")), "page", "views", limit)


def top_referrers(events: DataFrame, period: Period, limit: int = TOP) -> DataFrame:
    rows = filter_period(events, period).where(present(F.col("referrer")))
    return _ranked(rows, "referrer", "count", limit)


def browsers(events: DataFrame, period: Period) -> DataFrame:
    rows = filter_period(events, period).where(F.col("browser").isNotNull())
    return _ranked(rows, "browser", "count")


def devices(events: DataFrame, period: Period) -> DataFrame:
    rows = filter_period(events, period).where(F.col("device_type").isNotNull())
    return _ranked(rows, "device_type", "count")


def countries(events: DataFrame, period: Period, limit: int = TOP) -> DataFrame:
    rows = filter_period(events, period).where(present(F.col("country")))
    return _ranked(rows, "country", "count", limit)


def daily_views(events: DataFrame, period: Period) -> DataFrame:
    """Page views per UTC day that has any."""
    views = filter_period(events, period).where(is_pageview())
    return (
        views.groupBy(iso_date(F.col("timestamp")).alias("date"))
        .agg(F.count("*").alias("views"))
        .orderBy("date")
    )


def available_goals(events: DataFrame, period: Period) -> DataFrame:
    return filter_period(events, period).where(is_other_event()).select("event_type").distinct()


def overview(
    events: DataFrame,
    sessions: DataFrame,
    period: Period,
    *,
    as_of: datetime,
    goal: str | None = None,
) -> dict[str, DataFrame]:
    """Every section as its own lazy frame; each reads only the columns it needs."""
    sections = {
        "totals": overview_totals(events, period),
        "active_now": active_now(sessions, as_of),
        "top_pages": top_pages(events, period),
        "top_referrers": top_referrers(events, period),
        "browsers": browsers(events, period),
        "devices": devices(events, period),
        "countries": countries(events, period),
        "daily_views": daily_views(events, period),
        "available_goals": available_goals(events, period),
    }
    if goal:
        sections["conversion"] = goals.goal_conversion(events, period, goal)
    return sections


# Sections given in full; the others are cut to their top rows.
_WHOLE = ["browsers", "devices", "daily_views", "available_goals"]


def overview_report(
    events: DataFrame,
    sessions: DataFrame,
    period: Period,
    *,
    as_of: datetime,
    goal: str | None = None,
    limit: int = TOP,
) -> DataFrame:
    """The whole overview as [section, key, value] in one job.

    One scan counts all lists: each event contributes one entry per list, and entries
    combine per task before the shuffle. A second, narrower scan counts the totals.
    """
    view = is_pageview()

    def entry(section: str, key: Column, when: Column) -> Column:
        return F.when(
            when, F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"))
        )

    entries = [
        entry("top_pages", F.col("url"), view & F.col("url").isNotNull()),
        entry("top_referrers", F.col("referrer"), present(F.col("referrer"))),
        entry("browsers", F.col("browser"), F.col("browser").isNotNull()),
        entry("devices", F.col("device_type"), F.col("device_type").isNotNull()),
        entry("countries", F.col("country"), present(F.col("country"))),
        entry("daily_views", iso_date(F.col("timestamp")), view),
        entry("available_goals", F.col("event_type"), is_other_event()),
    ]
    counted = (
        filter_period(events, period)
        .select(F.explode(F.array(*entries)).alias("entry"))
        .where(F.col("entry").isNotNull())
        .groupBy("entry.section", "entry.key")
        .agg(F.count("*").alias("value"))
    )

    # Each entry of a whole section is a list of its own, so one rank serves both kinds.
    ranked_list = F.when(
        F.col("section").isin(_WHOLE), F.concat_ws("=", "section", "key")
    ).otherwise(F.col("section"))
    best = Window.partitionBy("list").orderBy(F.desc("value"), F.asc("key"))
    lists = (
        counted.withColumn("list", ranked_list)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= limit)
        .drop("list", "rank")
    )
    totals = overview_totals(events, period)
    totals = totals.unpivot([], totals.columns, "key", "value").select(
        F.lit("totals").alias("section"), "key", "value"
    )
    active = active_now(sessions, as_of).select(
        F.lit("totals").alias("section"),
        F.lit("active_now").alias("key"),
        F.col("active_now").alias("value"),
    )
    report = totals.unionByName(active).unionByName(lists)
    report = report.withColumn("value", F.col("value").cast("double"))
    if goal:
        conversion = goals.goal_conversion(events, period, goal).drop("goal")
        doubles = conversion.select(*[F.col(c).cast("double") for c in conversion.columns])
        report = report.unionByName(
            doubles.unpivot([], doubles.columns, "key", "value").select(
                F.lit("conversion").alias("section"), "key", "value"
            )
        )
    return report
