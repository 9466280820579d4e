"""The registered queries: every job over the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.text import present
from footfall.model import METRICS
from footfall.operators import funnel as funnels
from footfall.operators import filters, goals, overview, retention, state, users
from footfall.operators.selection import newest_first
from footfall.plans import derived
from footfall.plans.settings import (
    AS_OF,
    BUYERS_SINCE,
    FUNNEL_RANGE,
    FUNNELS,
    PERIOD,
    PROFILE_USER,
    RETENTION,
    USERS_CUTOFF,
)
from footfall.session import configure
from footfall.sources.sample import sample_events

Query = Callable[[SparkSession, str], DataFrame]


def _over_events(job: Callable[..., DataFrame], *args, urls: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return job(sample_events(spark, sf_dir, urls), *args)

    return run


def _ids(rows: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda events: rows(events).select("id")


def _on_sessions(job: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda events: job(state.build_sessions(events))


def _on_users(job: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda events: job(state.build_users(events), events)


def _cohorts(base: int | None, week_system: str) -> Callable[[DataFrame], DataFrame]:
    def run(events: DataFrame) -> DataFrame:
        return users.cohort_retention(
            state.build_users(events), state.build_sessions(events), base, week_system=week_system
        )

    return run


def _merged(build: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Build from one half of the period, then merge the other half in."""

    def run(events: DataFrame) -> DataFrame:
        early = F.col("timestamp") < F.lit(PERIOD.since).cast("timestamp_ntz")
        stored = build(events.where(early), arrival=True)
        return build(events.where(~early), stored)

    return run


_CUTOFF = RETENTION.cutoff(AS_OF)


def _both_rollups(events: DataFrame) -> DataFrame:
    return retention.rollup_pageviews(events, _CUTOFF).unionByName(
        retention.rollup_events(events, _CUTOFF)
    )


def _stored_metrics(events: DataFrame) -> DataFrame:
    """Metrics as an earlier rollup would have left them."""
    earlier = retention.Retention(RETENTION.keep_raw_days + 3).cutoff(AS_OF)
    return retention.rollup_pageviews(events, earlier).unionByName(
        retention.rollup_events(events, earlier)
    )


def _retention_rollup(events: DataFrame) -> DataFrame:
    """The rows of all four tables after the rollup: ids, and the metrics with their values."""
    after = retention.retention_rollup(
        events,
        state.build_sessions(events),
        state.build_users(events),
        events.sparkSession.createDataFrame([], METRICS),
        as_of=AS_OF,
        retention=RETENTION,
    )
    rows = [
        frame.select(
            F.lit(name).alias("table_name"),
            (F.concat_ws(" ", "date", "metric") if name == "metrics" else F.col("id").cast("string")).alias("row_key"),
            (F.col("value") if name == "metrics" else F.lit(0)).cast("bigint").alias("value"),
        )
        for name, frame in after.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def _untimed(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose id ends in 3, 4 or 5 without their time."""
    known = ~F.right(F.col("id").cast("string"), F.lit(1)).isin("3", "4", "5")
    return rows.withColumn(column, F.when(known, F.col(column)))


def _page_of_one_second(built: DataFrame, events: DataFrame) -> DataFrame:
    """A far page where all users were last seen at one time, as after an import; refined down to the ids."""
    imported = built.withColumn("last_seen", F.lit(AS_OF).cast("timestamp_ntz"))
    return users.users_page(imported, events, 50, 60, near_offset=0)


def _newest_half(built: DataFrame, _: DataFrame) -> DataFrame:
    """The newer half of all users, selected by counts."""
    newest = built.select("id", "first_seen")
    return newest.where(newest_first(newest, "first_seen", built.count() // 2, near=10))


def _overview_report(events: DataFrame) -> DataFrame:
    return overview.overview_report(
        events, state.build_sessions(events), PERIOD, as_of=AS_OF, goal="purchase"
    )


def queries() -> dict[str, Query]:
    ev = _over_events
    found: dict[str, Query] = {
        "filter_period": ev(_ids(lambda e: filters.filter_period(e, PERIOD))),
        "filter_prev_period": ev(_ids(lambda e: filters.filter_prev_period(e, PERIOD))),
        "filter_funnel_range": ev(_ids(lambda e: funnels.filter_funnel_range(e, *FUNNEL_RANGE))),
        "literal_contains": ev(
            _ids(lambda e: e.where(filters.literal_contains(F.col("url"), "%20"))), urls=True
        ),
        "non_null_non_empty": ev(_ids(lambda e: e.where(present(F.col("referrer"))))),
        "event_type_predicate": ev(_ids(lambda e: e.where(filters.is_other_event()))),
        "overview_totals": ev(overview.overview_totals, PERIOD),
        "overview_prev_totals": ev(overview.overview_prev_totals, PERIOD),
        "active_now": ev(_on_sessions(lambda s: overview.active_now(s, AS_OF))),
        "top_pages": ev(overview.top_pages, PERIOD, urls=True),
        "top_referrers": ev(overview.top_referrers, PERIOD),
        "browsers": ev(overview.browsers, PERIOD),
        "devices": ev(overview.devices, PERIOD),
        "countries": ev(overview.countries, PERIOD),
        "daily_views": ev(overview.daily_views, PERIOD),
        "available_goals": ev(overview.available_goals, PERIOD),
        "overview": ev(_overview_report, urls=True),
        "goal_conversion": ev(goals.goal_conversion, PERIOD, "purchase"),
        "goal_conversion_pageview": ev(goals.goal_conversion, PERIOD, "pageview"),
        "goal_conversion_unseen": ev(goals.goal_conversion, PERIOD, "never"),
        "all_goal_conversions": ev(goals.all_goal_conversions, PERIOD),
        "event_stats": ev(goals.event_stats, PERIOD),
        "event_trend": ev(goals.event_trend, PERIOD),
        "build_sessions": ev(state.build_sessions, urls=True),
        "build_users": ev(state.build_users),
        "upsert_sessions": ev(_merged(state.build_sessions), urls=True),
        "upsert_users": ev(_merged(state.build_users)),
        "users_with_counts": ev(_on_users(users.users_with_counts)),
        "users_total": ev(_on_users(lambda u, _: users.users_total(u))),
        "users_page": ev(_on_users(lambda u, e: users.users_page(u, e, 20, 10))),
        "users_page_far": ev(
            _on_users(lambda u, e: users.users_page(_untimed(u, "last_seen"), e, 100, 30, near_offset=0))
        ),
        "users_page_one_second": ev(_on_users(_page_of_one_second)),
        "user_profile": ev(_on_users(lambda u, e: users.user_profile(u, e, PROFILE_USER)["user"])),
        "user_profile_events": ev(
            _on_users(
                lambda u, e: users.user_profile(u, e, PROFILE_USER)["events"].withColumn(
                    "properties",
                    F.format_string('{"k": %d}', F.try_variant_get("properties", "$.k", "bigint")),
                )
            ),
            urls=True,
        ),
        "recent_users_base": ev(_on_users(lambda u, _: users.recent_users_base(u))),
        "recent_users_half": ev(_on_users(_newest_half)),
        "cohort_retention": ev(_cohorts(500, "iso")),
        "cohort_retention_monday": ev(_cohorts(500, "monday")),
        "cohort_retention_all_users": ev(_cohorts(None, "iso")),
        "first_match_per_session": ev(funnels.first_match_per_session, {"value": "click"}),
        **{
            name: ev(funnels.funnel, *args, urls=any(s.get("type") == "pageview" for s in args[0]))
            for name, args in FUNNELS.items()
        },
        "rollup_pageviews": ev(retention.rollup_pageviews, _CUTOFF),
        "rollup_events": ev(retention.rollup_events, _CUTOFF),
        "rollup_metrics": ev(lambda e: retention.rollup_metrics(e, _stored_metrics(e), _CUTOFF)),
        "merge_metrics": ev(lambda e: retention.merge_metrics(_stored_metrics(e), _both_rollups(e))),
        "prune_metrics": ev(
            lambda e: retention.prune_metrics(_both_rollups(e), RETENTION.rollup_cutoff(AS_OF))
        ),
        "prune_events": ev(
            lambda e: retention.prune_events(e, _CUTOFF).select("id", "event_type", "user_id", "timestamp")
        ),
        "prune_sessions": ev(
            _on_sessions(lambda s: retention.prune_sessions(s, _CUTOFF)), urls=True
        ),
        "prune_users": ev(
            _on_users(
                lambda u, e: retention.prune_users(
                    u, retention.prune_events(e, USERS_CUTOFF), USERS_CUTOFF
                )
            )
        ),
        "prune_events_untimed": ev(
            lambda e: retention.prune_events(_untimed(e, "timestamp"), _CUTOFF).select("id", "event_type", "timestamp")
        ),
        "prune_sessions_untimed": ev(
            _on_sessions(lambda s: retention.prune_sessions(_untimed(s, "last_seen_at"), _CUTOFF)), urls=True
        ),
        "prune_users_untimed": ev(
            _on_users(
                lambda u, e: retention.prune_users(
                    _untimed(u, "last_seen"), retention.prune_events(e, USERS_CUTOFF), USERS_CUTOFF
                )
            )
        ),
        "anti_join_users": ev(
            _on_users(
                lambda u, e: retention.anti_join_users(
                    u, retention.prune_events(e, BUYERS_SINCE).where("event_type = 'purchase'")
                )
            )
        ),
        "retention_rollup": ev(_retention_rollup),
    }
    found.update(derived.queries())
    return found
