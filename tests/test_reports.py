import random
from datetime import date, datetime, timedelta

import pytest

from footfall.operators import goals, overview, users
from footfall.operators.enrich import append_events
from footfall.operators.selection import newest_first
from footfall.operators.state import build_sessions, build_users
from footfall.period import ArgumentError, check_dates, date_range

AS_OF = datetime(2026, 3, 31, 12)
PERIOD = date_range("2026-03-16", "2026-03-30", as_of=AS_OF)


def test_date_range():
    assert PERIOD.since == datetime(2026, 3, 16)
    assert PERIOD.until == datetime(2026, 3, 30, 23, 59, 59, 999000)
    assert PERIOD.prev_until == PERIOD.since
    assert PERIOD.since - PERIOD.prev_since == PERIOD.until - PERIOD.since
    default = date_range(as_of=AS_OF)
    assert (default.since, default.until) == (datetime(2026, 3, 1, 12), AS_OF)
    assert date_range("junk", "junk", as_of=AS_OF) == default
    swapped = date_range("2026-03-30", "2026-03-01T06:00:00.000Z", as_of=AS_OF)
    assert (swapped.since, swapped.until) == (datetime(2026, 1, 30, 6), datetime(2026, 3, 1, 6))
    assert date_range(until=date(2026, 3, 1), as_of=AS_OF).until == datetime(2026, 3, 1, 23, 59, 59, 999000)
    assert date_range("2026-03-01T02:00:00+02:00", as_of=AS_OF).since == datetime(2026, 3, 1)


@pytest.mark.parametrize("since, until, code", [("not-date", None, "INVALID_DATE"), (None, "x", "INVALID_DATE"), ("2026-05-01", "2026-01-01", "INVALID_DATE_RANGE")])
def test_date_checks(since, until, code):
    with pytest.raises(ArgumentError) as error:
        check_dates(since, until)
    assert error.value.code == code


@pytest.fixture(scope="module")
def events(tables):
    def row(kind, time, session, user, **more):
        return {"event_type": kind, "timestamp": time, "session_id": session, "user_id": user, **more}

    us = {"country": "US", "browser": "Chrome", "device_type": "Desktop"}
    return tables.events(
        row("pageview", "2026-03-16 00:00:00", "s1", "u1", url="/a", referrer="", **us),
        row("pageview", "2026-03-30 23:59:59.999", "s2", "u1", url="/a", referrer="r", **us),
        row("pageview", "2026-03-20 10:00:00", "s2", None, url="/b", **us),
        row("pageview", "2026-03-20 11:00:00", None, "", url=None, country=""),
        row("buy", "2026-03-20 12:00:00", "s1", "u1", **us),
        row("buy", "2026-03-20 13:00:00", "s1", "u2", **us),
        row("new", "2026-03-21 00:00:00", "", None),
        row("pageview", "2026-03-31 00:00:00", "s9", "u9", url="/z"),
        # Previous period, half-open at its end.
        row("buy", "2026-03-15 23:59:59.999", "p1", "u1"),
        row("buy", "2026-03-01 00:00:00.001", "p2", "u1"),
        row("buy", "2026-03-10 00:00:00", "p2", "u3"),
        row("gone", "2026-03-10 00:00:00", "p3", "u3"),
        row("buy", "2026-03-01 00:00:00", "early", "u8"),
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_totals(events):
    # The empty text counts as a session and a user, NULL does not.
    assert rows(overview.overview_totals(events, PERIOD)) == [(7, 3, 3, 4, 3, 2)]
    assert rows(overview.overview_prev_totals(events, PERIOD)) == [(4, 3, 2)]


def test_sections(events):
    assert rows(overview.top_pages(events, PERIOD)) == [("/a", 2), ("/b", 1)]
    assert rows(overview.top_pages(events, PERIOD, limit=1)) == [("/a", 2)]
    assert rows(overview.top_referrers(events, PERIOD)) == [("r", 1)]
    assert rows(overview.browsers(events, PERIOD)) == [("Chrome", 5)]
    assert rows(overview.devices(events, PERIOD)) == [("Desktop", 5)]
    assert rows(overview.countries(events, PERIOD)) == [("US", 5)]
    assert rows(overview.daily_views(events, PERIOD)) == [("2026-03-16", 1), ("2026-03-20", 2), ("2026-03-30", 1)]
    assert sorted(rows(overview.available_goals(events, PERIOD))) == [("buy",), ("new",)]


def test_goals(events):
    assert rows(goals.goal_conversion(events, PERIOD, "buy")) == [
        ("buy", 2, 2, 1, 33.33, 3, 2, 2, 66.67, -33.33)
    ]
    assert rows(goals.goal_conversion(events, PERIOD, "never")) == [("never", 0, 0, 0, 0.0, 0, 0, 0, 0.0, 0.0)]
    assert rows(goals.goal_conversion(events.where("false"), PERIOD, "buy")) == [
        ("buy", 0, 0, 0, 0.0, 0, 0, 0, 0.0, 0.0)
    ]
    listed = {r.goal: r for r in goals.all_goal_conversions(events, PERIOD).collect()}
    assert sorted(listed) == ["buy", "new"]
    assert listed["new"].change == 100.0 and listed["new"].unique_sessions == 1
    with pytest.raises(ArgumentError):
        goals.goal_conversion(events, PERIOD, "g" * 257)


def test_event_stats(events):
    assert rows(goals.event_stats(events, PERIOD)) == [("buy", 2, 2, 3), ("new", 1, 0, 0)]
    assert rows(goals.event_trend(events, PERIOD)) == [("buy", "2026-03-20", 2), ("new", "2026-03-21", 1)]


def test_overview_forms_agree(events, tables):
    sessions = tables.sessions(
        {"id": "a", "last_seen_at": "2026-03-31 11:55:00"}, {"id": "b", "last_seen_at": "2026-03-31 11:54:59.999"}
    )
    parts = overview.overview(events, sessions, PERIOD, as_of=AS_OF, goal="buy")
    assert rows(parts["active_now"]) == [(1,)]
    report = {
        (r.section, r.key): r.value
        for r in overview.overview_report(events, sessions, PERIOD, as_of=AS_OF, goal="buy").collect()
    }
    assert report["totals", "active_now"] == 1
    for name, value in parts["totals"].first().asDict().items():
        assert report["totals", name] == value
    for section in ("top_pages", "top_referrers", "browsers", "devices", "countries", "daily_views"):
        assert {k: v for (s, k), v in report.items() if s == section} == dict(rows(parts[section]))
    assert {k for s, k in report if s == "available_goals"} == {"buy", "new"}
    assert report["conversion", "change"] == -33.33


def test_sessions_and_users(tables):
    events = tables.events(
        {"id": 5, "session_id": "s", "user_id": "u", "timestamp": "2026-03-02", "url": "/2", "country": "US"},
        {"id": 1, "session_id": "s", "user_id": None, "timestamp": "2026-03-03", "url": "/1"},
        {"id": 9, "session_id": "s", "user_id": "u", "timestamp": "2026-03-01", "url": "/3"},
        {"id": 2, "session_id": "", "user_id": "", "timestamp": "2026-03-01"},
    )
    [session] = build_sessions(events).collect()
    # First arrival sets everything, NULLs included; last arrival sets the last sight.
    assert (session.user_id, session.landing_page, session.country) == (None, "/1", None)
    assert (session.started_at, session.last_seen_at) == (datetime(2026, 3, 3), datetime(2026, 3, 1))
    [user] = build_users(events).collect()
    assert (user.first_seen, user.last_seen, user.country) == (datetime(2026, 3, 2), datetime(2026, 3, 1), "US")

    stored = tables.sessions(
        {"id": "s", "user_id": "x", "started_at": "2025-01-01", "last_seen_at": "2025-01-01", "is_active": 0},
        {"id": "idle", "started_at": "2025-01-01", "last_seen_at": "2025-01-01", "is_active": 0},
    )
    merged = {r.id: r for r in build_sessions(events, stored).collect()}
    assert (merged["s"].user_id, merged["s"].is_active, merged["s"].last_seen_at) == ("x", 1, datetime(2026, 3, 1))
    assert merged["idle"].is_active == 0


def test_paging(tables):
    made = tables.users(*[{"id": f"user_{n:02d}", "last_seen": f"2026-03-01 12:{n:02d}:00"} for n in range(1, 13)])
    events = tables.events({"user_id": "user_12"}, {"user_id": "user_12"}, {"user_id": "user_01"}, {"user_id": None})

    def page(*args):
        return [(r.id, r.event_count) for r in users.users_page(made, events, *args).collect()]

    assert page(5, 0)[0] == ("user_12", 2) and len(page(5, 0)) == 5
    assert page(5, 10) == [("user_02", 0), ("user_01", 1)]
    assert page(5, 100) == []
    assert len(page("abc", "xyz")) == 12
    assert users.check_page(500, -20) == (100, 0)
    assert users.check_page(-10) == (1, 0)
    assert users.check_page("7rows", "3.9") == (7, 3)
    assert rows(users.users_total(made)) == [(12,)]
    assert users.users_with_counts(made, events).where("event_count > 0").count() == 2


def test_far_pages_equal_near_pages(tables):
    """Pages found by counting, on seen times that repeat and cluster."""
    import random

    rng = random.Random(2)
    made = tables.users(
        *[
            {"id": f"u{n:03d}", "last_seen": f"2026-03-{rng.choice([1, 1, 1, 2, 9]):02d} 10:00:{rng.randrange(4):02d}.{rng.randrange(3)}00"}
            for n in range(200)
        ]
    ).select(*users._USER_COLUMNS)
    for size, skipped in [(5, 0), (100, 50), (1, 117), (20, 190), (5, 200), (50, 99)]:
        near = users._near_page(made, size, skipped).collect()
        far = users._far_page(made, size, skipped).collect()
        assert sorted(near) == sorted(far)


@pytest.mark.parametrize("times, near", [(1, 1), (1, 1000), (7, 4), (400, 1), (400, 1000)])
def test_the_first_rows_by_counts(tables, times, near):
    """Any number of rows, of which many share a time, a second or have none; ids that share long prefixes."""
    rng = random.Random(times)
    start = datetime(2026, 3, 1)
    made = [
        {"id": f"import-{rng.randrange(10**6):07d}-{n}", "last_seen": None if rng.random() < 0.1 else start + timedelta(microseconds=rng.randrange(times) * 400_000)}
        for n in range(150)
    ]
    rows = tables.users(*made).select("id", "last_seen")
    ordered = sorted(made, key=lambda r: (r["last_seen"] is None, -(r["last_seen"] or start).timestamp(), r["id"]))
    for n in (0, 3, 74, 150, 151):
        chosen = newest_first(rows, "last_seen", n, near=near)
        found = {r.id for r in (rows if chosen is None else rows.where(chosen)).collect()}
        assert found == {r["id"] for r in ordered[:n]}


def test_a_profile_reads_the_dates_the_user_was_seen(spark, tables, tmp_path):
    days = [datetime(2026, 3, d, 12) for d in (1, 5, 9, 20)]
    append_events(tables.events(*[{"id": n, "user_id": "u" if 0 < n < 3 else "v", "timestamp": day} for n, day in enumerate(days)]), str(tmp_path))
    made = tables.users({"id": "u", "first_seen": days[1], "last_seen": days[2]})
    found = users.user_profile(made, spark.read.parquet(str(tmp_path)), "u", within_seen=True)["events"]
    assert [r.timestamp for r in found.collect()] == [days[2], days[1]]
    plan = found._jdf.queryExecution().executedPlan()
    filters = plan.toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert filters.count("event_date") >= 2 and "ubquery" in filters
    none = users.user_profile(made, spark.read.parquet(str(tmp_path)), "stranger", within_seen=True)
    assert none["events"].count() == 0


def test_profile(tables):
    made = tables.users({"id": "u", "last_seen": "2026-03-01"})
    events = tables.events(
        *[{"user_id": "u", "timestamp": f"2026-03-01 {n // 60:02d}:{n % 60:02d}:00"} for n in range(120)],
        {"user_id": "u", "timestamp": "2026-03-02", "properties": "{broken", "event_type": "bad"},
        {"user_id": "stranger", "timestamp": "2026-03-02"},
    )
    profile = users.user_profile(made, events, "u")
    found = profile["events"].selectExpr("event_type", "to_json(properties) AS p").collect()
    assert len(found) == 100 and tuple(found[0]) == ("bad", "{}")
    unknown = users.user_profile(made, events, "stranger")
    assert unknown["user"].count() == 0 and unknown["events"].count() == 0
    for bad in ("", "u" * 257, "a\nb", None):
        with pytest.raises(ArgumentError):
            users.user_profile(made, events, bad)


@pytest.mark.parametrize("base", [500, None, 2])
def test_cohorts(tables, base):
    made = tables.users(
        {"id": "a", "first_seen": "2026-03-04 10:00:00"},
        {"id": "b", "first_seen": "2026-03-05 10:00:00"},
        {"id": "quiet", "first_seen": "2026-03-03 10:00:00"},
    )
    starts = {
        # Before first sight but within a week of it: week 0. Just under and at a boundary.
        "a": ["2026-02-26 00:00:00", "2026-03-11 09:59:59", "2026-03-11 10:00:00", "2026-05-06 09:59:59.999"],
        "b": ["2026-03-05 10:00:00", "2026-03-12 10:00:00", "2026-05-14 10:00:00"],
    }
    sessions = tables.sessions(
        *[{"id": f"{u}{n}", "user_id": u, "started_at": t} for u, times in starts.items() for n, t in enumerate(times)],
        {"id": "anonymous", "user_id": None, "started_at": "2026-03-05"},
    )
    size = 2 if base == 2 else 3
    assert rows(users.cohort_retention(made, sessions, base)) == [
        ("2026-W10", size, 0, 2),
        ("2026-W10", size, 1, 2),
        ("2026-W10", size, 8, 1),
    ]
    assert users.cohort_retention(made, sessions, base, week_system="monday").first().cohort_week == "2026-W09"


def test_cohorts_against_brute_force(tables):
    """Reducing sessions to two per calendar week loses no week of any user."""
    import random
    from datetime import timedelta

    rng = random.Random(3)
    start = datetime(2026, 1, 1)
    first = {f"u{n}": start + timedelta(seconds=rng.randrange(40 * 86400)) for n in range(30)}
    seen = [(rng.choice(["u0", rng.choice(list(first))]), start + timedelta(seconds=rng.randrange(90 * 86400))) for _ in range(900)]
    made = tables.users(*[{"id": u, "first_seen": t} for u, t in first.items()])
    sessions = tables.sessions(*[{"id": str(n), "user_id": u, "started_at": t} for n, (u, t) in enumerate(seen)])
    expected = {}
    for user, at in seen:
        week = int((at - first[user]).total_seconds() / (7 * 86400))
        if 0 <= week <= 8:
            label = "{0}-W{1:02d}".format(*first[user].isocalendar())
            expected.setdefault((label, week), set()).add(user)
    for base in (None, 500):
        cohorts = users.cohort_retention(made, sessions, base).collect()
        found = {(r.cohort_week, r.week_num): r.retained for r in cohorts}
        assert found == {key: len(members) for key, members in expected.items()}
