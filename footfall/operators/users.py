"""User lists, profiles and retention cohorts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.text import epoch_micros
from footfall.operators.selection import newest_first
from footfall.period import ArgumentError

PAGE_DEFAULT, PAGE_MAX = 50, 100
# Up to this offset a page is a top-k; beyond it, it is found by counting.
NEAR_OFFSET = 10_000
PROFILE_EVENTS = 100
COHORT_BASE = 500
COHORT_WEEKS = 8
# A base up to this many users is copied to every executor (some 50 bytes per user).
BROADCAST_USERS = 100_000
_WEEK_MICROS = 7 * 24 * 3600 * 1_000_000


def _leading_int(value, default: int) -> int:
    """An integer at the start of ``value``, else the default."""
    digits = re.match(r"\s*([+-]?\d+)", str(value))
    return default if value is None or not digits else int(digits[1])


def check_page(limit=None, offset=None) -> tuple[int, int]:
    """Clamp paging arguments: limit 1 to 100 (default 50), offset at least 0."""
    rows = min(PAGE_MAX, max(1, _leading_int(limit, PAGE_DEFAULT)))
    return rows, max(0, _leading_int(offset, 0))


def check_user_id(user_id: str) -> str:
    if not isinstance(user_id, str) or not 1 <= len(user_id) <= 256 or re.search(r"[\0\r\n]", user_id):
        raise ArgumentError("not a user id", "INVALID_USER_ID")
    return user_id


_USER_COLUMNS = ["id", "first_seen", "last_seen", "country", "browser", "device_type"]


def users_with_counts(users: DataFrame, events: DataFrame) -> DataFrame:
    """All users with their number of events.

    Events are counted before the join, so the join has one row per user on both sides.
    """
    counts = events.where(F.col("user_id").isNotNull()).groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("event_count")
    )
    return users.join(counts, "id", "left").select(
        *_USER_COLUMNS, F.coalesce("event_count", F.lit(0)).alias("event_count")
    )


def users_total(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("total"))


def _near_page(users: DataFrame, rows: int, skipped: int) -> DataFrame:
    """A page close to the start: each task keeps its best few rows."""
    return users.orderBy(F.desc("last_seen"), F.asc("id")).offset(skipped).limit(rows)


def _far_page(users: DataFrame, rows: int, skipped: int) -> DataFrame:
    """A page far from the start, without sorting or collecting the users before it."""
    before = newest_first(users, "last_seen", skipped)
    return users.limit(0) if before is None else _near_page(users.where(~before), rows, 0)


def users_page(
    users: DataFrame, events: DataFrame, limit=None, offset=None, near_offset: int = NEAR_OFFSET
) -> DataFrame:
    """One page of users, most recently seen first; users without a time come last.

    The page is cut before any event is read; its at most 100 users then go to the events
    as a broadcast, so counting them shuffles next to nothing. Beyond ``near_offset``, the users before the
    page are told by counts, see `newest_first`.
    """
    rows, skipped = check_page(limit, offset)
    cut = _near_page if skipped <= near_offset else _far_page
    page = cut(users.select(*_USER_COLUMNS), rows, skipped)
    wanted = F.broadcast(page.select(F.col("id").alias("user_id")))
    counts = (
        events.select("user_id")
        .join(wanted, "user_id", "left_semi")
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.count("*").alias("event_count"))
    )
    # One row per user of the page, at most 100.
    return (
        page.join(F.broadcast(counts), "id", "left")
        .select(*_USER_COLUMNS, F.coalesce("event_count", F.lit(0)).alias("event_count"))
        .orderBy(F.desc("last_seen"), F.asc("id"))
    )


def user_profile(users: DataFrame, events: DataFrame, user_id: str, *, within_seen: bool = False) -> dict[str, DataFrame]:
    """A user's row and latest events; both empty when the user is unknown.

    Bad property text reads as an empty object. With ``within_seen``, only the dates from the user's first to
    last sight are read of a table partitioned by ``event_date``; the two are looked up before the scan starts.
    That leaves out nothing where events are stamped on arrival; events that came with a time of their own
    may lie outside.
    """
    check_user_id(user_id)
    user = users.where(F.col("id") == user_id)
    known = user.select(F.col("id").alias("user_id"))
    if within_seen and "event_date" in events.columns:
        first, last = (user.agg(pick(F.to_date(column))).scalar() for pick, column in ((F.min, "first_seen"), (F.max, "last_seen")))
        events = events.where((F.col("event_date") >= first) & (F.col("event_date") <= last))
    parsed = F.coalesce(F.try_parse_json("properties"), F.parse_json(F.lit("{}")))
    latest = (
        events.where(F.col("user_id") == user_id)
        .orderBy(F.desc("timestamp"), F.desc("id"))
        .limit(PROFILE_EVENTS)
        .join(F.broadcast(known), "user_id", "left_semi")
        .select("event_type", "url", parsed.alias("properties"), "timestamp", "id")
        .orderBy(F.desc("timestamp"), F.desc("id"))
        .drop("id")
    )
    return {"user": user, "events": latest}


def recent_users_base(users: DataFrame, base: int | None = COHORT_BASE) -> DataFrame:
    """The newest users by first sight; None takes all.

    A small base is a top-n, in which every task keeps its best few rows; a larger one is told by counts.
    """
    newest = users.select("id", "first_seen")
    if base is None:
        return newest
    if base <= NEAR_OFFSET:
        return newest.orderBy(F.desc("first_seen"), F.asc("id")).limit(base)
    chosen = newest_first(newest, "first_seen", base)
    return newest if chosen is None else newest.where(chosen)


def week_label(timestamp: Column, week_system: str = "iso") -> Column:
    """'2024-W05': ISO weeks, or weeks that start on the year's first Monday."""
    day = timestamp.cast("date")
    if week_system == "iso":
        year, week = F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day)
    elif week_system == "monday":
        year = F.year(day)
        week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    else:
        raise ArgumentError("week_system is 'iso' or 'monday'", "INVALID_WEEK_SYSTEM")
    return F.concat(
        year.cast("string"), F.lit("-W"), F.lpad(week.cast("int").cast("string"), 2, "0")
    )


def _micros(timestamp: str) -> Column:
    return epoch_micros(timestamp)


def cohort_retention(
    users: DataFrame,
    sessions: DataFrame,
    base: int | None = COHORT_BASE,
    weeks: int = COHORT_WEEKS,
    week_system: str = "iso",
) -> DataFrame:
    """Users of each cohort week that come back 0 to ``weeks`` weeks later.

    A base of bounded size goes to the sessions as a broadcast, which drops all others
    before any shuffle. For a larger base, sessions are first reduced to the earliest and
    latest start per user and week of the calendar. A user's own weeks change once in seven
    days, so those two starts touch every own week that the sessions between them do:
    nothing is lost, and a user with a large share of all sessions shrinks to two rows per
    calendar week before the join.
    """
    cohort = recent_users_base(users, base).select(
        F.col("id").alias("user_id"),
        _micros("first_seen").alias("first_micros"),
        week_label(F.col("first_seen"), week_system).alias("cohort_week"),
    )
    started = sessions.where(F.col("user_id").isNotNull()).select(
        "user_id", _micros("started_at").alias("micros")
    )
    if base is not None and base <= BROADCAST_USERS:
        matched = started.join(F.broadcast(cohort), "user_id")
    else:
        calendar_week = F.floor(F.col("micros") / _WEEK_MICROS).alias("calendar_week")
        bounds = started.groupBy("user_id", calendar_week).agg(
            F.array(F.min("micros"), F.max("micros")).alias("bounds")
        )
        matched = bounds.join(cohort, "user_id").select(
            "user_id", "cohort_week", "first_micros", F.explode("bounds").alias("micros")
        )
    week_num = F.expr(f"(micros - first_micros) div {_WEEK_MICROS}").cast("int")
    active = matched.select("user_id", "cohort_week", week_num.alias("week_num")).where(
        F.col("week_num").between(0, weeks)
    )
    retained = active.groupBy("cohort_week", "week_num").agg(
        F.count_distinct("user_id").alias("retained")
    )
    sizes = cohort.groupBy("cohort_week").agg(F.count("*").alias("cohort_size"))
    # One row per calendar week on both sides.
    return (
        retained.join(sizes, "cohort_week")
        .select("cohort_week", "cohort_size", "week_num", "retained")
        .orderBy(F.desc("cohort_week"), F.asc("week_num"))
    )
