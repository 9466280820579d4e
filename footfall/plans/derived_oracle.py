"""SQL oracles of the queries over derived inputs.

The derivations come from ``derived``; what is then computed is written independently, from
the rules, often only for the values that the derivations deal out.
"""

from __future__ import annotations

from datetime import timedelta

from footfall.functions.agents import BOT_WORDS
from footfall.functions.links import DOWNLOAD_EXTENSIONS
from footfall.model import IDS_PER_BATCH, OPTIONAL_FIELDS, UTM_FIELDS
from footfall.plans import derived
from footfall.plans.settings import AS_OF
from footfall.sources.sample import ADDRESSES, AGENTS, deal

_RAW = """raw AS (SELECT e.*, p.url FROM events e
  JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))"""


def _utf16(text: str) -> str:
    return rf"(length({text}) + length(regexp_replace({text}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


# ---- payloads ---------------------------------------------------------------------------

_PAYLOADS = f"""WITH {_RAW},
members AS (SELECT {derived.BATCH_SQL} AS batch_id, event_id, ts, {_select(derived.MEMBER_SQL)} FROM raw),
texts AS (SELECT batch_id, event_id, ts, {derived.EVENT_TEXT_SQL} AS text FROM members),
grouped AS (SELECT batch_id, max(ts) AS received_at, string_agg(text, ',' ORDER BY event_id) AS joined,
  arg_min(text, event_id) AS head FROM texts GROUP BY batch_id),
shaped AS (SELECT *, encode(joined) AS joined_bytes FROM grouped),
bodies AS (SELECT batch_id, received_at, coalesce(nullif({derived.BODY_SQL}, ''), '{{}}') AS b FROM shaped),
checked AS (SELECT *, CASE WHEN octet_length(encode(b)) > 65536 THEN 'PAYLOAD_TOO_LARGE'
  WHEN NOT json_valid(b) THEN 'BAD_REQUEST' WHEN json_type(b) = 'OBJECT' THEN NULL
  WHEN json_type(b) <> 'ARRAY' THEN 'INVALID_PAYLOAD' WHEN json_array_length(b) = 0 THEN 'EMPTY_BATCH'
  WHEN json_array_length(b) > 50 THEN 'BATCH_TOO_LARGE' END AS batch_error FROM bodies),
listed AS (SELECT *, CASE WHEN json_type(b) = 'ARRAY' THEN json_extract(b, '$[*]') ELSE [CAST(b AS JSON)] END AS l
  FROM checked WHERE batch_error IS NULL),
parsed AS (SELECT batch_id, received_at, batch_error, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS e FROM listed
  UNION ALL SELECT batch_id, received_at, batch_error, NULL, NULL FROM checked WHERE batch_error IS NOT NULL)
"""

_BLANK = r"'^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$'"
_TYPE = f"regexp_replace(e ->> '$.event_type', {_BLANK}, '', 'g')"


def _optional_check(name: str, longest: int) -> str:
    kind = f"json_type(e, '$.{name}')"
    return (
        f"WHEN {kind} NOT IN ('NULL', 'VARCHAR') THEN 'INVALID_FIELD_TYPE' "
        f"WHEN {kind} = 'VARCHAR' AND {_utf16(f'(e ->> {chr(39)}$.{name}{chr(39)})')} > {longest} THEN 'STRING_TOO_LONG'"
    )


# Keys of the dealt properties hold no dots or brackets, so a path's steps give its depth.
_VALIDATED = f"""{_PAYLOADS}, objects AS (SELECT batch_id, pos, json_extract(e, '$.properties') AS p FROM parsed
  WHERE json_type(e, '$.properties') = 'OBJECT'),
nodes AS (SELECT o.batch_id, o.pos, t.key, t.type, t.fullkey, t.value FROM objects o, json_tree(o.p) t),
facts AS (SELECT batch_id, pos,
    count(*) FILTER (fullkey <> '$' AND NOT ends_with(fullkey, ']')) AS keys,
    max({_utf16('key')}) FILTER (NOT ends_with(fullkey, ']')) AS longest_key,
    max({_utf16("(value ->> '$')")}) FILTER (type = 'VARCHAR') AS longest_text,
    max(len(regexp_extract_all(fullkey, '[.\\[]'))) FILTER (type IN ('OBJECT', 'ARRAY')) AS depth FROM nodes GROUP BY 1, 2),
props AS (SELECT o.batch_id, o.pos, CASE WHEN depth >= 5 THEN 'PROP_DEPTH_EXCEEDED'
    WHEN keys > 50 THEN 'PROP_KEY_COUNT_EXCEEDED' WHEN longest_key > 64 THEN 'PROP_KEY_TOO_LONG'
    WHEN longest_text > 4096 THEN 'PROP_VALUE_TOO_LONG'
    WHEN octet_length(encode(CAST(json(p) AS STRING))) > 16384 THEN 'PROP_SIZE_EXCEEDED' END AS prop_error
  FROM objects o JOIN facts f ON o.batch_id = f.batch_id AND o.pos = f.pos),
validated AS (SELECT v.*, CASE WHEN json_type(e, '$.properties') NOT IN ('NULL', 'OBJECT') THEN 'INVALID_PROPERTIES'
    ELSE prop_error END AS properties_error, CASE
  WHEN batch_error IS NOT NULL THEN batch_error
  WHEN json_type(e) <> 'OBJECT' THEN 'INVALID_EVENT_OBJECT'
  WHEN json_type(e, '$.event_type') IS DISTINCT FROM 'VARCHAR' OR {_TYPE} = '' THEN 'MISSING_EVENT_TYPE'
  WHEN {_utf16(_TYPE)} > 128 THEN 'EVENT_TYPE_TOO_LONG'
  {' '.join(_optional_check(n, m) for n, m in OPTIONAL_FIELDS.items())}
  WHEN json_type(e, '$.properties') NOT IN ('NULL', 'OBJECT') THEN 'INVALID_PROPERTIES'
  ELSE prop_error END AS error_code
  FROM parsed v LEFT JOIN props p ON v.batch_id = p.batch_id AND v.pos = p.pos)
"""
_PARSED_COLUMNS = "batch_id, coalesce(pos, -1) AS pos, e ->> '$.event_type' AS event_type, e ->> '$.user_id' AS user_id, e ->> '$.properties.k' AS k"


def _mask(ip: str) -> str:
    """Masking for the dealt addresses; their IPv6 forms have at most three leading groups."""
    left = f"string_split(split_part(lower(regexp_extract({ip}, '[0-9A-Fa-f:]+')), '::', 1), ':')"

    def group(i: int) -> str:
        return f"coalesce(nullif(ltrim({left}[{i}], '0'), ''), '0')"

    h0, h1, h2 = group(1), group(2), group(3)
    return f"""CASE WHEN {ip} IS NULL OR {ip} = '' THEN NULL
  WHEN regexp_matches({ip}, '\\d+\\.\\d+\\.\\d+\\.\\d+') THEN regexp_extract({ip}, '(\\d+\\.\\d+\\.\\d+)\\.\\d+', 1) || '.0'
  WHEN {h1} = '0' AND {h2} = '0' THEN {h0} || '::' WHEN {h2} = '0' THEN {h0} || ':' || {h1} || '::'
  ELSE {h0} || ':' || {h1} || ':' || {h2} || '::' END"""


def _browser(ua: str) -> str:
    return f"""CASE WHEN coalesce({ua}, '') = '' THEN 'Unknown' WHEN {ua} LIKE '%Edg/%' THEN 'Edge'
  WHEN {ua} LIKE '%OPR/%' OR {ua} LIKE '%Opera%' THEN 'Opera' WHEN {ua} LIKE '%Chrome%' THEN 'Chrome'
  WHEN {ua} LIKE '%Safari%' THEN 'Safari' WHEN {ua} LIKE '%Firefox%' THEN 'Firefox' ELSE 'Other' END"""


def _device(ua: str) -> str:
    return f"""CASE WHEN coalesce({ua}, '') = '' THEN 'Unknown' WHEN lower({ua}) LIKE '%ipad%' THEN 'Tablet'
  WHEN regexp_matches(lower({ua}), 'mobi|android|iphone') THEN 'Mobile' ELSE 'Desktop' END"""


def _utm(url: str, name: str) -> str:
    query = f"split_part(split_part({url}, '#', 1), '?', 2)"
    first = f"list_filter(string_split({query}, '&'), lambda x: starts_with(x, '{name}='))[1]"
    return f"nullif(url_decode(replace(substr({first}, {len(name) + 2}), '+', ' ')), '')"


_REQUESTED = f"""{_VALIDATED}, req AS (SELECT *, {deal(ADDRESSES).replace('event_id', 'batch_id')} AS client_ip,
  coalesce({deal(AGENTS, 'batch_id')}, '') AS agent FROM validated WHERE error_code IS NULL)"""


def _event_columns(ip: str, ua: str, country: str) -> str:
    utm = [
        f"coalesce(nullif(e ->> '$.{n}', ''), {_utm(f'(e ->> {chr(39)}$.url{chr(39)})', n)}) AS {n}" for n in UTM_FIELDS
    ]
    return f"""batch_id * {IDS_PER_BATCH} + pos AS id, {_TYPE} AS event_type, nullif(e ->> '$.session_id', '') AS session_id,
  nullif(e ->> '$.user_id', '') AS user_id, nullif(e ->> '$.url', '') AS url,
  nullif(e ->> '$.referrer', '') AS referrer,
  CASE WHEN json_type(e, '$.properties') = 'OBJECT' THEN CAST(json(json_extract(e, '$.properties')) AS STRING) ELSE '{{}}' END AS properties,
  {_mask(ip)} AS ip, {ua} AS ua,
  coalesce({country}, nullif(e ->> '$.country', '')) AS country, {_browser(ua)} AS browser, {_device(ua)} AS device_type,
  received_at AS timestamp, {', '.join(utm)}"""


_ENRICHED = f"""{_REQUESTED}
SELECT {_event_columns('client_ip', 'agent', "CASE WHEN batch_id % 3 = 0 THEN 'DE' END")} FROM req"""

# ---- requests ---------------------------------------------------------------------------

_REQUESTS = f"WITH req AS (SELECT {_select(derived.REQUEST_SQL)} FROM events)"


def _normal(ip: str) -> str:
    return f"""lower(regexp_replace(CASE WHEN starts_with(trim({ip}), '[') THEN regexp_extract({ip}, '\\[([^\\]]+)\\]', 1)
  WHEN regexp_full_match(trim({ip}), '\\d+\\.\\d+\\.\\d+\\.\\d+:\\d+') THEN split_part(trim({ip}), ':', 1)
  ELSE coalesce(trim({ip}), '') END, '^::ffff:', ''))"""


def _trusted(ip: str) -> str:
    """On the trust list, for normalised dealt addresses."""
    return (
        f"(regexp_full_match({ip}, '10\\.\\d+\\.\\d+\\.\\d+') OR {ip} = '192.168.1.7'"
        f" OR starts_with({ip}, '2001:db8:'))"
    )


def _valid(ip: str) -> str:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return f"(regexp_full_match({ip}, '{octet}(\\.{octet}){{3}}') OR regexp_full_match({ip}, '[0-9a-f:]+::[0-9a-f]+'))"


_HOPS_CTE = f"""hops AS (SELECT *, {_normal('remote_address')} AS peer,
  list_filter(list_transform(string_split(coalesce(x_forwarded_for, ''), ','), lambda x: {_normal('x')}), lambda x: x <> '') AS h
  FROM req)"""
_HOPS = f"{_REQUESTS}, {_HOPS_CTE}"
_HEADER = (
    "trim(coalesce(nullif(cf_ipcountry, ''), nullif(x_country_code, ''), nullif(cloudfront_viewer_country, '')))"
)
_COUNTRY = f"CASE WHEN length({_HEADER}) <= 16 THEN nullif(upper({_HEADER}), '') END"


def _hop(back: int) -> str:
    chosen = f"h[len(h) - {back - 1}]"
    return f"""{_HOPS} SELECT id, CASE WHEN len(h) >= {back} AND {_valid(chosen)} THEN {chosen} ELSE peer END AS client_ip,
  {_COUNTRY} AS country FROM hops"""


_LISTED_CTES = f"""{_HOPS_CTE}, outs AS (SELECT *, list_filter(h, lambda x: NOT {_trusted('x')}) AS o FROM hops),
picks AS (SELECT *, CASE WHEN len(o) > 0 THEN o[len(o)] ELSE h[1] END AS pick FROM outs)"""
_LISTED_COLUMNS = f"""CASE WHEN {_trusted('peer')} AND len(h) > 0 AND {_valid('pick')} THEN pick ELSE peer END AS client_ip,
  CASE WHEN {_trusted('peer')} THEN {_COUNTRY} END AS country"""
_LISTED = f"{_REQUESTS}, {_LISTED_CTES} SELECT id, {_LISTED_COLUMNS} FROM picks"


def _fold(source: str, limit: int, window: timedelta) -> str:
    """CTEs that end in ``fold``: one request of every address per round, with the log of its
    accepted times. ``source`` names a CTE with ip, ts and id."""
    ms = int(window / timedelta(milliseconds=1))
    return f"""numbered AS (SELECT ip, ts, id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms,
  row_number() OVER (PARTITION BY ip ORDER BY CAST(floor(epoch_us(ts) / 1000) AS BIGINT), id) AS n FROM {source}),
fold AS (
  SELECT ip, n, ts, id, [ms] AS log, false AS limited, CAST(0 AS BIGINT) AS retry_after FROM numbered WHERE n = 1
  UNION ALL
  SELECT ip, n, ts, id, CASE WHEN len(kept) >= {limit} THEN kept ELSE list_append(kept, ms) END,
    len(kept) >= {limit}, CASE WHEN len(kept) >= {limit}
      THEN greatest(1, CAST(ceil((kept[1] + {ms} - ms) / 1000.0) AS BIGINT)) ELSE 0 END
  FROM (SELECT r.*, list_filter(f.log, lambda x: x > r.ms - {ms}) AS kept
        FROM fold f JOIN numbered r ON r.ip = f.ip AND r.n = f.n + 1))"""


RATE_LIMIT_SQL = f"""WITH RECURSIVE calls AS (SELECT {derived.CALLER} AS ip, ts, event_id AS id FROM events),
{_fold('calls', *derived.RATE)}
SELECT ip, ts, id, limited, retry_after FROM fold"""

_BOT = "(?i)" + "|".join(BOT_WORDS)

_BATCH_REQUESTS = {k: derived.by_batch(v) for k, v in derived.REQUEST_SQL.items() if k not in ("id", "ts", "client_country")}
# Payloads with resolved clients (``who``) and the verdicts on their rates (``fold``).
_COLLECTED = f"""{_VALIDATED.replace('WITH', 'WITH RECURSIVE', 1)},
req AS (SELECT batch_id, received_at, {_select(_BATCH_REQUESTS)} FROM bodies),
{_LISTED_CTES}, who AS (SELECT batch_id, received_at, user_agent, {_LISTED_COLUMNS} FROM picks),
calls AS (SELECT client_ip AS ip, received_at AS ts, batch_id AS id FROM who),
{_fold('calls', *derived.COLLECT_RATE)}"""

# ---- browser side -----------------------------------------------------------------------

_CLIENT = f"""WITH {_RAW}, cli AS (SELECT event_id AS id, url, {_select({**derived.LONG_SQL, **derived.OPT_OUT})} FROM raw)"""
_NOT_OPTED = "coalesce(dnt NOT IN ('1', 'yes'), true) AND coalesce(gpc, false) = false"
# What is left of each kind of dealt properties, in the order in which they are dealt.
_CUT_PROPERTIES = deal(
    [
        "'{\"text\":\"' || repeat('t', 4096) || '\",\"n\":1}'",
        "'{\"a\":{\"b\":{\"c\":{\"d\":{},\"g\":' || id || '}}}}'",
        "'{\"list\":[' || repeat(id || ',', 49) || id || ']}'",
        "'{\"a\":' || id || ',\"b\":[{},{\"c\":2}]}'",
        "'{\"a\":\"x y\",\"b\":[1,2]}'",
        "'{\"s\":\"' || repeat('😀', 2048) || '\"}'",
        "'{\"' || repeat('k', 64) || '\":' || id || '}'",
        "'{}'",
        *["coalesce(CAST(json(properties) AS STRING), '{}')"] * 4,
    ],
    "id",
)
_CUT = f"""id, left(event_type, 128) AS event_type, coalesce(length(left(referrer, 8192)), 0) AS referrer_length,
  {_CUT_PROPERTIES} AS properties"""


def _host(url: str) -> str:
    return f"lower(regexp_extract({url}, '(?i)^https?://(?:[^/@]*@)?([^:/?#]+)', 1))"


_LINKS = f"""WITH size AS (SELECT count(*) AS n FROM pages), raw AS (
  SELECT e.*, p.url AS page_url, q.url AS target_url FROM events e, size, pages p, pages q
  WHERE p.page_id = e.event_id % n AND q.page_id = (e.event_id * 7 + 3) % n),
clicks AS (SELECT event_id AS id, page_url, {_select(derived.CLICK_SQL)} FROM raw),
usable AS (SELECT *, split_part(split_part(href, '?', 1), '#', 1) AS path FROM clicks
  WHERE href <> '' AND NOT starts_with(href, 'javascript:'))
SELECT id, 'download' AS event_type, nullif(lower(regexp_extract(path, '(?i)\\.([a-z0-9]+)$', 1)), '') AS extension,
  href, nullif(target, '') AS target FROM usable
  WHERE has_download_attr OR regexp_matches(href, '(?i)\\.({'|'.join(DOWNLOAD_EXTENSIONS)})($|\\?|#)')
UNION ALL SELECT id, 'outbound_click', NULL, href, nullif(target, '') FROM usable
  WHERE {_host('href')} <> '' AND {_host('page_url')} <> '' AND {_host('href')} <> {_host('page_url')}"""


_KEPT = f"""{_COLLECTED}, kept AS (SELECT v.batch_id, v.received_at, v.pos, v.e, v.error_code, w.client_ip,
    coalesce(w.user_agent, '') AS agent, w.country AS server FROM validated v JOIN who w ON w.batch_id = v.batch_id
    JOIN fold f ON f.id = v.batch_id AND NOT f.limited
  WHERE NOT coalesce(regexp_matches(w.user_agent, '{_BOT}'), false))"""
_COLLECT_EVENTS = f"{_KEPT} SELECT {_event_columns('client_ip', 'agent', 'server')} FROM kept WHERE error_code IS NULL"


def oracle_sql(ev: str, ev_s: str, ev_u: str) -> dict[str, str]:
    utm = {name: _utm("url", name) for name in UTM_FIELDS}
    merged = {name: f"coalesce(nullif({derived.OWN_UTM}, ''), {sql})" for name, sql in utm.items()}
    return {
        "read_payloads": f"{_PAYLOADS} SELECT batch_id, batch_error FROM checked",
        "parse_payloads": f"{_PAYLOADS} SELECT {_PARSED_COLUMNS}, batch_error FROM parsed",
        "explode_batches": f"{_PAYLOADS} SELECT {_PARSED_COLUMNS} FROM parsed WHERE batch_error IS NULL",
        "validate_events": f"{_VALIDATED} SELECT batch_id, coalesce(pos, -1) AS pos, error_code FROM validated",
        "valid_event_fields": f"""{_VALIDATED} SELECT batch_id, pos, {_TYPE} AS event_type,
  {', '.join(f"nullif(e ->> '$.{n}', '') AS {n}" for n in OPTIONAL_FIELDS)} FROM validated WHERE error_code IS NULL""",
        "validate_properties": f"""{_VALIDATED} SELECT batch_id, pos, properties_error FROM validated
  WHERE batch_error IS NULL""",
        "quarantine_report": f"""{_VALIDATED}, firsts AS (SELECT batch_id, error_code, row_number() OVER
    (PARTITION BY batch_id ORDER BY pos) AS n FROM validated WHERE error_code IS NOT NULL)
SELECT v.batch_id, count(*) FILTER (v.error_code IS NULL) AS stored,
  count(*) FILTER (v.error_code IS NOT NULL AND pos IS NOT NULL) AS dropped, max(f.error_code) AS first_error,
  count(*) FILTER (v.error_code IS NULL) = 0 AS rejected
FROM validated v LEFT JOIN firsts f ON f.batch_id = v.batch_id AND f.n = 1 GROUP BY v.batch_id""",
        "stamp_server_fields": f"""{_REQUESTED}
SELECT batch_id * {IDS_PER_BATCH} + pos AS id, {_TYPE} AS event_type, agent AS ua,
  CASE WHEN batch_id % 3 = 0 THEN 'DE' END AS country, received_at AS timestamp FROM req""",
        "enrich_events": _ENRICHED,
        "stream_ingest": _ENRICHED,
        "stream_rollup": f"""SELECT strftime(timestamp, '%Y-%m-%d') AS date,
  CASE WHEN event_type = 'pageview' THEN 'pageviews' ELSE event_type END AS metric, '' AS dimension, count(*) AS value
FROM ({_ENRICHED}) WHERE timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY GROUP BY 1, 2""",
        "resolve_clients": _LISTED,
        "resolve_clients_one_hop": _hop(1),
        "resolve_clients_two_hops": _hop(2),
        "resolve_clients_untrusted": f"{_HOPS} SELECT id, peer AS client_ip, CAST(NULL AS STRING) AS country FROM hops",
        "normalize_ip": f"{_HOPS} SELECT id, peer AS ip FROM hops",
        "ip_in_cidr_table": """WITH net AS (
  SELECT ((o_orderkey % 223 + 1) * 16777216 + (o_orderkey * 7 % 256) * 65536 + (o_orderkey * 13 % 256) * 256) AS base,
    CAST(pow(2, 20 - o_orderkey % 21) AS BIGINT) AS size FROM orders),
ranges AS (SELECT DISTINCT CAST(floor(base / size) AS BIGINT) * size AS low, CAST(floor(base / size) AS BIGINT) * size + size - 1 AS high FROM net),
seen AS (SELECT event_id AS id, (event_id % 223 + 1) * 16777216 + (event_id * 7 % 256) * 65536
    + (event_id * 11 % 256) * 256 + event_id % 256 AS number FROM events),
hit AS (SELECT DISTINCT s.id FROM seen s JOIN ranges r ON s.number >= r.low AND s.number <= r.high)
SELECT s.id, h.id IS NOT NULL AS trusted FROM seen s LEFT JOIN hit h ON h.id = s.id""",
        "ip_in_cidr": f"{_HOPS} SELECT id, {_trusted('peer')} AS trusted FROM hops",
        "resolve_country": f"{_REQUESTS} SELECT id, coalesce({_COUNTRY}, nullif(client_country, '')) AS country FROM req",
        "filter_bots": f"""{_REQUESTS} SELECT id, user_agent FROM req
  WHERE user_agent IS NULL OR NOT regexp_matches(user_agent, '{_BOT}')""",
        "rate_limit": RATE_LIMIT_SQL,
        "stream_rate_limit": RATE_LIMIT_SQL,
        "collect_limited": f"{_COLLECTED} SELECT id AS batch_id, retry_after FROM fold WHERE limited",
        "collect_events": _COLLECT_EVENTS,
        "stream_collect": _COLLECT_EVENTS,
        "store_collected": f"""{_KEPT}, events AS (SELECT error_code, batch_id, pos, {_event_columns('client_ip', 'agent', 'server')} FROM kept)
SELECT CASE WHEN error_code IS NULL THEN 'event' ELSE 'quarantine' END AS kind, batch_id, coalesce(pos, -1) AS pos, error_code,
  {', '.join(f'CASE WHEN error_code IS NULL THEN {c} END AS {c}' for c in ('id', 'event_type', 'session_id', 'ip', 'country'))} FROM events
UNION ALL SELECT 'limited', id, -1, NULL, NULL, NULL, NULL, NULL, NULL FROM fold WHERE limited""",
        "parse_browser": f"{ev} SELECT id, {_browser('ua')} AS browser FROM ev",
        "parse_device": f"{ev} SELECT id, {_device('ua')} AS device_type FROM ev",
        "mask_ip": f"{ev} SELECT id, {_mask('ip')} AS masked FROM ev",
        "extract_utm": f"{ev} SELECT id, {_select(utm)} FROM ev",
        "merge_utm": f"{ev} SELECT id, {_select(merged)} FROM ev",
        "drop_opted_out": f"{_CLIENT} SELECT id FROM cli WHERE {_NOT_OPTED}",
        "truncate_fields": f"{_CLIENT} SELECT {_CUT} FROM cli",
        "sanitize_events": f"{_CLIENT} SELECT {_CUT} FROM cli WHERE {_NOT_OPTED}",
        "classify_links": _LINKS,
        "append_events": f"{ev} SELECT id, event_type, session_id, url, t AS timestamp FROM ev",
        "track_events": f"""{ev} SELECT id, ' ' || event_type AS event_type, nullif(session_id, '') AS session_id,
  nullif(user_id, '') AS user_id, url, {_mask('ip')} AS ip, nullif(ua, '') AS ua, nullif(country, '') AS country,
  browser, device_type, t AS timestamp, nullif(referrer, '') AS referrer,
  coalesce(properties, '{{}}') AS properties, {_select(utm)} FROM ev""",
        "warehouse_rollup": f"""{ev} SELECT day AS date,
  CASE WHEN event_type = 'pageview' THEN 'pageviews' ELSE event_type END AS metric, '' AS dimension, count(*) AS value
FROM ev WHERE t < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY GROUP BY 1, 2""",
        "warehouse_late_events": f"""{ev}, twice AS (SELECT *, false AS late FROM ev WHERE t < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY
  UNION ALL SELECT *, true FROM ev WHERE t < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AND id % 7 = 0)
SELECT day AS date, CASE WHEN event_type = 'pageview' THEN 'pageviews' ELSE event_type END AS metric, '' AS dimension,
  count(*) AS value FROM twice GROUP BY 1, 2
UNION ALL SELECT '', 'late', '', count(*) FROM twice WHERE late""",
        "merge_sessions": f"{ev_s} SELECT * FROM ses",
        "merge_users": f"{ev_u} SELECT * FROM usr",
        "stream_sessions": f"{ev_s} SELECT * FROM ses",
        "stream_users": f"{ev_u} SELECT * FROM usr",
        "stream_active_now": f"""{ev}, marks AS (SELECT session_id, unnest(range(date_trunc('minute', t) + INTERVAL 1 MINUTE,
    date_trunc('minute', t) + INTERVAL 6 MINUTE, INTERVAL 1 MINUTE)) AS as_of FROM ev WHERE session_id <> '')
SELECT as_of, count(DISTINCT session_id) AS active FROM marks
WHERE as_of <= (SELECT max(t) FROM ev WHERE session_id <> '') - INTERVAL 1 MINUTE
GROUP BY as_of""",
        "stream_daily_views": f"{ev} SELECT day AS date, count(*) AS views FROM ev WHERE event_type = 'pageview' GROUP BY 1",
    }
