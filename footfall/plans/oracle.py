"""The registered queries as plain SQL over the sample tables, for an independent engine.

Written from the meaning of each query, not from the Spark code: self-joins, window ranks
and scalar subqueries where the jobs use folds, slices and pre-aggregation.
"""

from __future__ import annotations

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
from footfall.sources.sample import EVENT_SQL, URL_SQL


def _ts(value) -> str:
    return f"TIMESTAMP '{value.isoformat(sep=' ')}'"


_BROWSER = """CASE WHEN ua IS NULL OR ua = '' THEN 'Unknown' WHEN contains(ua, 'Edg/') THEN 'Edge'
  WHEN contains(ua, 'OPR/') OR contains(ua, 'Opera') THEN 'Opera' WHEN contains(ua, 'Chrome') THEN 'Chrome'
  WHEN contains(ua, 'Safari') THEN 'Safari' WHEN contains(ua, 'Firefox') THEN 'Firefox' ELSE 'Other' END"""
_DEVICE = """CASE WHEN ua IS NULL OR ua = '' THEN 'Unknown' WHEN ua ILIKE '%ipad%' THEN 'Tablet'
  WHEN ua ILIKE '%mobi%' OR ua ILIKE '%android%' OR ua ILIKE '%iphone%' THEN 'Mobile' ELSE 'Desktop' END"""

_MODEL = ", ".join(f"{sql} AS {name if name != 'timestamp' else 't'}" for name, sql in EVENT_SQL.items())

EV = f"""WITH raw AS (
  SELECT e.*, p.url FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)),
dealt AS (SELECT {_MODEL}, {URL_SQL} AS url FROM raw),
ev AS (SELECT *, {_BROWSER} AS browser, {_DEVICE} AS device_type, strftime(t, '%Y-%m-%d') AS day,
  t BETWEEN {_ts(PERIOD.since)} AND {_ts(PERIOD.until)} AS cur,
  t >= {_ts(PERIOD.prev_since)} AND t < {_ts(PERIOD.prev_until)} AS prev FROM dealt)
"""

SESSIONS = """, ses AS (
  SELECT f.session_id AS id, f.user_id, f.t AS started_at, l.t AS last_seen_at, f.referrer, f.url AS landing_page,
    f.country, f.browser, f.device_type, f.ip, f.ua, 1 AS is_active
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM ev WHERE session_id <> '') f
  JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM ev WHERE session_id <> '') l
    ON f.session_id = l.session_id WHERE f.n = 1 AND l.n = 1)
"""
USERS = """, usr AS (
  SELECT f.user_id AS id, f.t AS first_seen, l.t AS last_seen, f.country, f.browser, f.device_type, '{}' AS properties
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM ev WHERE user_id <> '') f
  JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS n FROM ev WHERE user_id <> '') l
    ON f.user_id = l.user_id WHERE f.n = 1 AND l.n = 1)
"""
EV_S, EV_U, EV_SU = EV + SESSIONS, EV + USERS, EV + SESSIONS + USERS
USER_COLUMNS = "id, first_seen, last_seen, country, browser, device_type"


def _top(key: str, name: str, count: str, where: str, limit: str = "LIMIT 10") -> str:
    return f"""{EV} SELECT {key} AS {name}, count(*) AS {count} FROM ev WHERE cur AND {where}
GROUP BY 1 ORDER BY 2 DESC, 1 {limit}"""


def _goal_row(goal: str) -> str:
    """All ten figures of one goal, each from its own subquery."""

    def sub(what: str, period: str) -> str:
        return f"(SELECT {what} FROM ev WHERE event_type = {goal} AND {period})"

    def sessions(period: str) -> str:
        return f"(SELECT greatest(count(DISTINCT session_id), 1) FROM ev WHERE {period})"

    def rate(period: str) -> str:
        return (
            f"floor({sub('count(DISTINCT session_id)', period)} / CAST({sessions(period)} AS DOUBLE)"
            " * 10000 + 0.5) / 100"
        )

    now, before = sub("count(*)", "cur"), sub("count(*)", "prev")
    return f"""SELECT {goal} AS goal, {now} AS count, {sub('count(DISTINCT user_id)', 'cur')} AS unique_users,
  {sub('count(DISTINCT session_id)', 'cur')} AS unique_sessions, {rate('cur')} AS conversion_rate,
  {before} AS prev_count, {sub('count(DISTINCT user_id)', 'prev')} AS prev_unique_users,
  {sub('count(DISTINCT session_id)', 'prev')} AS prev_unique_sessions, {rate('prev')} AS prev_conversion_rate,
  CASE WHEN {before} = 0 THEN CASE WHEN {now} > 0 THEN 100.0 ELSE 0.0 END
    ELSE floor(({now} - {before}) / CAST({before} AS DOUBLE) * 10000 + 0.5) / 100 END AS change"""


_ALL_GOALS = f"""SELECT g.event_type AS goal, g.n AS count, g.u AS unique_users, g.s AS unique_sessions,
  floor(g.s / CAST(greatest(tot.s, 1) AS DOUBLE) * 10000 + 0.5) / 100 AS conversion_rate, g.pn AS prev_count,
  g.pu AS prev_unique_users, g.ps AS prev_unique_sessions,
  floor(g.ps / CAST(greatest(tot.ps, 1) AS DOUBLE) * 10000 + 0.5) / 100 AS prev_conversion_rate,
  CASE WHEN g.pn = 0 THEN 100.0 ELSE floor((g.n - g.pn) / CAST(g.pn AS DOUBLE) * 10000 + 0.5) / 100 END AS change
FROM (SELECT event_type, count(*) FILTER (cur) n, count(DISTINCT user_id) FILTER (cur) u,
    count(DISTINCT session_id) FILTER (cur) s, count(*) FILTER (prev) pn, count(DISTINCT user_id) FILTER (prev) pu,
    count(DISTINCT session_id) FILTER (prev) ps FROM ev WHERE event_type <> 'pageview' GROUP BY 1) g,
  (SELECT count(DISTINCT session_id) FILTER (cur) s, count(DISTINCT session_id) FILTER (prev) ps FROM ev) tot
WHERE g.n > 0"""

_TOTALS = """SELECT count(*) FILTER (cur) AS total_events, count(DISTINCT session_id) FILTER (cur) AS unique_sessions,
  count(DISTINCT user_id) FILTER (cur) AS unique_users, count(*) FILTER (prev) AS prev_total_events,
  count(DISTINCT session_id) FILTER (prev) AS prev_unique_sessions,
  count(DISTINCT user_id) FILTER (prev) AS prev_unique_users FROM ev"""
_ACTIVE = f"SELECT count(*) AS active_now FROM ses WHERE last_seen_at >= {_ts(AS_OF)} - INTERVAL 5 MINUTE"


def _overview_report(goal: str) -> str:
    def section(name: str, key: str, where: str, tail: str = "") -> str:
        return (
            f"SELECT * FROM (SELECT '{name}' AS section, {key} AS key, CAST(count(*) AS DOUBLE) AS value"
            f" FROM ev WHERE cur AND {where} GROUP BY 2 ORDER BY 3 DESC, 2 {tail})"
        )

    totals = "total_events unique_sessions unique_users prev_total_events prev_unique_sessions prev_unique_users"
    rows = [f"SELECT 'totals', '{k}', CAST({k} AS DOUBLE) FROM tot" for k in totals.split()]
    rows.append("SELECT 'totals', 'active_now', CAST(active_now AS DOUBLE) FROM act")
    conversion = (
        "count unique_users unique_sessions conversion_rate prev_count prev_unique_users "
        "prev_unique_sessions prev_conversion_rate change"
    )
    rows += [f"SELECT 'conversion', '{k}', CAST({k} AS DOUBLE) FROM conv" for k in conversion.split()]
    sections = [
        section("top_pages", "url", "event_type = 'pageview'", "LIMIT 10"),
        section("top_referrers", "referrer", "referrer <> ''", "LIMIT 10"),
        section("browsers", "browser", "browser IS NOT NULL"),
        section("devices", "device_type", "device_type IS NOT NULL"),
        section("countries", "country", "country <> ''", "LIMIT 10"),
        section("daily_views", "day", "event_type = 'pageview'"),
        section("available_goals", "event_type", "event_type <> 'pageview'"),
    ]
    return f"""{EV_S}, tot AS ({_TOTALS}), act AS ({_ACTIVE}), conv AS ({_goal_row(goal)})
{' UNION ALL '.join(sections + rows)}"""


def _funnel(steps: list[dict], since: str | None = None, until: str | None = None) -> str:
    """A walk over each session's events in order that moves on when an event is the step waited for."""
    bounds = "session_id <> ''"
    if since:
        bounds += f" AND t >= TIMESTAMP '{since}'"
    if until:
        bounds += f" AND t {'<' if len(until) == 10 else '<='} TIMESTAMP '{until}'"
    wanted, labels = [], []
    for i, step in enumerate(steps):
        value = step["value"].replace("'", "''")
        meets = f"event_type = '{value}'"
        if step.get("type") == "pageview":
            meets = f"event_type = 'pageview' AND contains(url, '{value}')"
        wanted.append(f"coalesce({meets}, false)")
        labels.append(f"({i}, '{step.get('label', step['value']).replace(chr(39), chr(39) * 2)}')")
    return f"""WITH RECURSIVE {EV.removeprefix("WITH ")}, ordered AS (
  SELECT session_id, [{", ".join(wanted)}] AS fits, row_number() OVER (PARTITION BY session_id ORDER BY t, id) AS place
  FROM ev WHERE {bounds}
), useful AS (
  SELECT session_id, fits, row_number() OVER (PARTITION BY session_id ORDER BY place) AS place
  FROM ordered WHERE list_bool_or(fits)
), walk AS (
  SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS done FROM useful
  UNION ALL
  SELECT w.session_id, u.place, w.done + CASE WHEN coalesce(u.fits[w.done + 1], false) THEN 1 ELSE 0 END
  FROM walk w JOIN useful u ON u.session_id = w.session_id AND u.place = w.place + 1
), reach AS (SELECT session_id, max(done) AS done FROM walk GROUP BY session_id),
named(step_index, step) AS (VALUES {", ".join(labels)}),
totals AS (SELECT step_index, step, (SELECT count(*) FROM reach WHERE done > step_index) AS count FROM named),
paired AS (SELECT *, lag(count, 1, 0) OVER (ORDER BY step_index) AS before FROM totals)
SELECT step_index, step, count,
  CAST(CASE WHEN before = 0 THEN 0 ELSE floor((1 - count / CAST(before AS DOUBLE)) * 100 + 0.5) END AS BIGINT) AS dropoff
FROM paired"""


def _cohorts(label: str, base: int | None) -> str:
    """Retained users by grouping pairs of user and week, joined with the sizes of the cohorts."""
    limit = f"ORDER BY first_seen DESC, id LIMIT {base}" if base is not None else ""
    return f"""{EV_SU}, member AS (SELECT id AS user_id, epoch_us(first_seen) AS joined, {label} AS cohort_week
  FROM (SELECT * FROM usr {limit})),
sizes AS (SELECT cohort_week, count(*) AS cohort_size FROM member GROUP BY 1),
visits AS (SELECT DISTINCT user_id, cohort_week, CAST(trunc((epoch_us(started_at) - joined) / 604800000000.0) AS INTEGER) AS week_num
  FROM ses JOIN member USING (user_id))
SELECT cohort_week, any_value(cohort_size) AS cohort_size, week_num, count(*) AS retained
FROM visits JOIN sizes USING (cohort_week) WHERE week_num >= 0 AND week_num <= 8 GROUP BY cohort_week, week_num"""


_CUT = _ts(RETENTION.cutoff(AS_OF))
_METRICS = f"""SELECT day AS date, CASE WHEN event_type = 'pageview' THEN 'pageviews' ELSE event_type END AS metric,
  '' AS dimension, count(*) AS value FROM ev WHERE t < {_CUT} GROUP BY 1, 2"""


def _kept_users(cut: str, users: str = "usr") -> str:
    return f"""SELECT u.* FROM {users} u WHERE coalesce(u.last_seen >= {cut}, true)
  OR EXISTS (SELECT 1 FROM ev e WHERE e.user_id = u.id AND e.t >= {cut})"""


def _untimed(table: str, column: str) -> str:
    return f"""(SELECT * REPLACE (CASE WHEN right(CAST(id AS VARCHAR), 1) NOT IN ('3', '4', '5') THEN {column} END AS {column})
  FROM {table})"""


_ROLLUP_DAY = RETENTION.rollup_cutoff(AS_OF).date().isoformat()
# The stored metrics that a rollup meets: the same counts of the three days before.
STORED_METRICS = f"""SELECT day AS date, CASE WHEN event_type = 'pageview' THEN 'pageviews' ELSE event_type END AS metric,
  '' AS dimension, count(*) AS value FROM ev WHERE t < {_CUT} - INTERVAL 3 DAY GROUP BY 1, 2"""
_MERGED = f"""SELECT date, metric, dimension, CAST(sum(value) AS BIGINT) AS value
  FROM (SELECT * FROM ({_METRICS}) UNION ALL SELECT * FROM ({STORED_METRICS})) GROUP BY 1, 2, 3"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "filter_period": f"{EV} SELECT id FROM ev WHERE cur",
        "filter_prev_period": f"{EV} SELECT id FROM ev WHERE prev",
        "filter_funnel_range": f"""{EV} SELECT id FROM ev
  WHERE t >= TIMESTAMP '{FUNNEL_RANGE[0]}' AND t < TIMESTAMP '{FUNNEL_RANGE[1]}'""",
        "literal_contains": f"{EV} SELECT id FROM ev WHERE url LIKE '%\\%20%' ESCAPE '\\'",
        "non_null_non_empty": f"{EV} SELECT id FROM ev WHERE referrer IS NOT NULL AND referrer <> ''",
        "event_type_predicate": f"{EV} SELECT id FROM ev WHERE event_type <> 'pageview'",
        "overview_totals": f"{EV} {_TOTALS}",
        "overview_prev_totals": f"""{EV} SELECT count(*) AS total_events, count(DISTINCT session_id) AS unique_sessions,
  count(DISTINCT user_id) AS unique_users FROM ev WHERE prev""",
        "active_now": f"{EV_S} {_ACTIVE}",
        "top_pages": _top("url", "page", "views", "event_type = 'pageview' AND url IS NOT NULL"),
        "top_referrers": _top("referrer", "referrer", "count", "referrer IS NOT NULL AND referrer <> ''"),
        "browsers": _top("browser", "browser", "count", "browser IS NOT NULL", ""),
        "devices": _top("device_type", "device_type", "count", "device_type IS NOT NULL", ""),
        "countries": _top("country", "country", "count", "country IS NOT NULL AND country <> ''"),
        "daily_views": f"""{EV} SELECT day AS date, count(*) AS views FROM ev WHERE cur AND event_type = 'pageview'
GROUP BY day""",
        "available_goals": f"{EV} SELECT DISTINCT event_type FROM ev WHERE cur AND event_type <> 'pageview'",
        "overview": _overview_report("'purchase'"),
        "goal_conversion": f"{EV} {_goal_row(chr(39) + 'purchase' + chr(39))}",
        "goal_conversion_pageview": f"{EV} {_goal_row(chr(39) + 'pageview' + chr(39))}",
        "goal_conversion_unseen": f"{EV} {_goal_row(chr(39) + 'never' + chr(39))}",
        "all_goal_conversions": f"{EV} {_ALL_GOALS}",
        "event_stats": f"""{EV} SELECT c.event_type, c.count, c.unique_users, coalesce(p.n, 0) AS prev_count FROM
  (SELECT event_type, count(*) AS count, count(DISTINCT user_id) AS unique_users FROM ev
   WHERE cur AND event_type <> 'pageview' GROUP BY 1) c
  LEFT JOIN (SELECT event_type, count(*) AS n FROM ev WHERE prev GROUP BY 1) p ON c.event_type = p.event_type""",
        "event_trend": f"""{EV} SELECT event_type, day AS date, count(*) AS count FROM ev
WHERE cur AND event_type <> 'pageview' GROUP BY 1, 2""",
        "build_sessions": f"{EV_S} SELECT * FROM ses",
        "build_users": f"{EV_U} SELECT * FROM usr",
        "upsert_sessions": f"{EV_S} SELECT * FROM ses",
        "upsert_users": f"{EV_U} SELECT * FROM usr",
        "users_with_counts": f"""{EV_U} SELECT u.id, u.first_seen, u.last_seen, u.country, u.browser, u.device_type,
  count(e.id) AS event_count FROM usr u LEFT JOIN ev e ON e.user_id = u.id GROUP BY ALL""",
        "users_total": f"{EV_U} SELECT count(*) AS total FROM usr",
        "users_page": f"""{EV_U} SELECT u.id, u.first_seen, u.last_seen, u.country, u.browser, u.device_type,
  count(e.id) AS event_count FROM usr u LEFT JOIN ev e ON e.user_id = u.id GROUP BY ALL
  ORDER BY u.last_seen DESC, u.id LIMIT 20 OFFSET 10""",
        "users_page_far": f"""{EV_U} SELECT u.id, u.first_seen, u.last_seen, u.country, u.browser, u.device_type,
  count(e.id) AS event_count FROM {_untimed("usr", "last_seen")} u LEFT JOIN ev e ON e.user_id = u.id GROUP BY ALL
  ORDER BY u.last_seen DESC NULLS LAST, u.id LIMIT 100 OFFSET 30""",
        "users_page_one_second": f"""{EV_U} SELECT u.id, u.first_seen, TIMESTAMP '{AS_OF}' AS last_seen, u.country, u.browser, u.device_type,
  count(e.id) AS event_count FROM usr u LEFT JOIN ev e ON e.user_id = u.id GROUP BY ALL ORDER BY u.id LIMIT 50 OFFSET 60""",
        "user_profile": f"{EV_U} SELECT * FROM usr WHERE id = '{PROFILE_USER}'",
        "user_profile_events": f"""{EV} SELECT event_type, url, properties, t AS timestamp FROM ev
WHERE user_id = '{PROFILE_USER}' ORDER BY t DESC, id DESC LIMIT 100""",
        "recent_users_base": f"{EV_U} SELECT id, first_seen FROM usr ORDER BY first_seen DESC, id LIMIT 500",
        "recent_users_half": f"""{EV_U}, ranked AS (SELECT id, first_seen, row_number() OVER (ORDER BY first_seen DESC, id) AS n FROM usr)
SELECT id, first_seen FROM ranked WHERE n <= (SELECT count(*) // 2 FROM usr)""",
        "cohort_retention": _cohorts("strftime(first_seen, '%G-W%V')", 500),
        "cohort_retention_monday": _cohorts("strftime(first_seen, '%Y-W%W')", 500),
        "cohort_retention_all_users": _cohorts("strftime(first_seen, '%G-W%V')", None),
        "first_match_per_session": f"""{EV} SELECT session_id, t AS timestamp, id FROM (SELECT *, row_number() OVER
  (PARTITION BY session_id ORDER BY t, id) AS n FROM ev WHERE session_id <> '' AND event_type = 'click') WHERE n = 1""",
        **{name: _funnel(*args) for name, args in FUNNELS.items()},
        "rollup_pageviews": f"{EV} SELECT * FROM ({_METRICS}) WHERE metric = 'pageviews'",
        "rollup_events": f"{EV} SELECT * FROM ({_METRICS}) WHERE metric <> 'pageviews'",
        "rollup_metrics": f"{EV} {_MERGED}",
        "merge_metrics": f"{EV} {_MERGED}",
        "prune_metrics": f"{EV} SELECT * FROM ({_METRICS}) WHERE date > '{_ROLLUP_DAY}'",
        "prune_events": f"{EV} SELECT id, event_type, user_id, t AS timestamp FROM ev WHERE t >= {_CUT}",
        "prune_sessions": f"{EV_S} SELECT * FROM ses WHERE last_seen_at >= {_CUT}",
        "prune_users": f"{EV_U} {_kept_users(_ts(USERS_CUTOFF))}",
        "prune_events_untimed": f"""{EV} SELECT id, event_type, t AS timestamp FROM {_untimed("ev", "t")}
  WHERE coalesce(t >= {_CUT}, true)""",
        "prune_sessions_untimed": f"""{EV_S} SELECT * FROM {_untimed("ses", "last_seen_at")}
  WHERE coalesce(last_seen_at >= {_CUT}, true)""",
        "prune_users_untimed": f"{EV_U} {_kept_users(_ts(USERS_CUTOFF), _untimed('usr', 'last_seen'))}",
        "anti_join_users": f"""{EV_U} SELECT u.* FROM usr u LEFT JOIN (SELECT user_id, count(*) AS bought FROM ev
  WHERE event_type = 'purchase' AND t >= {_ts(BUYERS_SINCE)} GROUP BY user_id) p ON p.user_id = u.id WHERE p.bought IS NULL""",
        "retention_rollup": f"""{EV_SU} SELECT 'events' AS table_name, CAST(id AS VARCHAR) AS row_key, CAST(0 AS BIGINT) AS value
  FROM ev WHERE t >= {_CUT}
  UNION ALL SELECT 'sessions', id, 0 FROM ses WHERE last_seen_at >= {_CUT}
  UNION ALL SELECT 'users', id, 0 FROM ({_kept_users(_CUT)})
  UNION ALL SELECT 'metrics', date || ' ' || metric, value FROM ({_METRICS}) WHERE date > '{_ROLLUP_DAY}'""",
    }
    sql.update(derived.oracle_sql(EV, EV_S, EV_U))
    return sql
