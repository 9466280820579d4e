"""Queries over inputs that are derived from the sample: payloads, requests, clicks, streams.

Faults are dealt out over all events and batches, so each query meets every rule on the whole
table. The derivations are SQL text that both engines run; the checks are not shared.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.addresses import ip_in_cidr, mask_ip, normalize_ip
from footfall.functions.agents import parse_browser, parse_device
from footfall.functions.links import extract_utm, merge_utm
from footfall.model import OPTIONAL_FIELDS, UTM_FIELDS
from footfall.operators import browser, clients, enrich, ingest, rates
from footfall.operators.collect import COLLECTED, collect_requests, store_collected
from footfall.operators.retention import Retention
from footfall.plans.settings import AS_OF, PERIOD
from footfall.session import configure, shared_folder
from footfall.sources import entities, store
from footfall.sources.sample import (
    ADDRESSES,
    AGENTS,
    EVENT_SQL,
    SESSION,
    deal,
    model_events,
    read_sample,
    sample_events,
    with_page,
)
from footfall.streaming import ingest as stream_in
from footfall.streaming import live
from footfall.streaming import rates as stream_rates

Query = Callable[[SparkSession, str], DataFrame]

# ---- payloads ---------------------------------------------------------------------------

BATCH_EVENTS = 20
# One event in ten and one body in twenty is of another kind than the first.
ODD_EVENTS, ODD_BODIES = 10, 20


def _odd(by: str, every: int) -> str:
    """SQL that numbers the odd ones from 0 on; NULL for all others."""
    return f"CASE WHEN {by} % {every} = {every - 3} THEN CAST(floor({by} / {every}) AS BIGINT) END"


# One entry per kind of event: SQL for the raw JSON of the members that differ from a plain
# event, or for the whole text.
_MANY_KEYS = "'{" + ",".join(f'"k{i}":{i}' for i in range(51)) + "}'"
_FULL_KEYS = "'{" + ",".join(f'"k{i}":{i}' for i in range(50)) + "}'"
EVENT_KINDS = [
    {},
    {"event_type": "'12345'"},
    {"event_type": "'\"   \"'"},
    {"session": "'{\"a\": 1}'"},
    {"url": "'\"' || repeat('u', 8193) || '\"'"},
    {"properties": "'\"text\"'"},
    {"properties": "'{\"' || repeat('k', 65) || '\": 1}'"},
    {"properties": "'{\"l1\":{\"l2\":{\"l3\":{\"l4\":{\"l5\":{\"l6\":1}}}}}}'"},
    {"properties": "'{\"l1\":{\"l2\":{\"l3\":{\"l4\":{\"l5\":1}}}}}'"},
    {"user": "'\"' || repeat('v', 129) || '\"'"},
    {"event_type": "'\"' || repeat('e', 129) || '\"'"},
    {"properties": _MANY_KEYS},
    {"properties": _FULL_KEYS},
    {"properties": "'{\"s\":\"' || repeat('s', 4097) || '\"}'"},
    {"properties": "'{\"list\":[' || repeat('\"' || repeat('x', 900) || '\",', 19) || '\"end\"]}'"},
    {"whole": "'\"just text\"'"},
    {"whole": "'null'"},
    {"session": "'\"' || repeat('😀', 65) || '\"'"},
    {"session": "'\"' || repeat('😀', 64) || '\"'"},
    {"more": "',\"country\":\"FR\",\"utm_source\":\"own\",\"utm_medium\":\"\"'"},
    {"more": "',\"country\":\"much too long a country\"'"},
    {"more": "',\"ip\":\"1.2.3.4\",\"ua\":\"mine\",\"timestamp\":\"1999-01-01\"'", "properties": "'null'"},
    {"properties": "'[1]'"},
    {"properties": "'{\"a\":[[[[[1]]]]]}'"},
    {"properties": "'{\"a\":[[[[{}]]]]}'"},
    {"more": "',\"utm_term\":7'"},
    {"whole": "'{\"event_type\":\" padded \"}'"},
    {"whole": "'{}'"},
    {"event_type": "'\"' || repeat(' ', 9) || repeat('e', 128) || '\"'"},
    {"properties": "'{\"q\":\"a b[{\",\"' || repeat('é', 64) || '\":\"' || repeat('é', 4096) || '\"}'"},
    {"session": "'null'", "user": "'\"\"'", "url": "'\"\"'"},
]
_PLAIN = {
    "event_type": f"'\"' || {EVENT_SQL['event_type']} || '\"'",
    "session": f"'\"' || {SESSION} || '\"'",
    "user": "'\"' || CAST(user_id AS STRING) || '\"'",
    "url": "'\"' || url || '\"'",
    "more": "''",
    "properties": "props",
    "whole": "CAST(NULL AS STRING)",
}


def _member(name: str) -> str:
    """SQL for one member of the event's text, by the kind of event."""
    cases = [f"WHEN {i} THEN {kind[name]}" for i, kind in enumerate(EVENT_KINDS) if name in kind]
    kind = f"({_odd('event_id', ODD_EVENTS)}) % {len(EVENT_KINDS)}"
    return f"CASE {kind} {' '.join(cases)} ELSE {_PLAIN[name]} END" if cases else _PLAIN[name]


MEMBER_SQL = {f"j_{name}": _member(name) for name in _PLAIN}
EVENT_TEXT_SQL = (
    "coalesce(j_whole, '{\"event_type\": ' || j_event_type || ',\"session_id\":' || j_session || "
    "',\"user_id\":' || j_user || ',\"url\":' || j_url || j_more || ',\"properties\":' || j_properties || '}')"
)
BATCH_SQL = f"CAST(floor(event_id / {BATCH_EVENTS}) AS BIGINT)"
BODIES = [
    "'[' || joined || ']'",
    "'[' || joined",
    "'[]'",
    "'12345'",
    "head",
    "'[' || joined || repeat(' ', 70000) || ']'",
    "'[' || joined || ',' || joined || ',' || joined || ']'",
    "''",
    "'[' || joined || repeat(' ', 65534 - octet_length(joined_bytes)) || ']'",
    "'[' || joined || repeat(' ', 65535 - octet_length(joined_bytes)) || ']'",
    "'[' || joined || '] x'",
    "' [' || joined || ',' || joined || '] '",
]
BODY_SQL = f"coalesce({deal(BODIES, '(' + _odd('batch_id', ODD_BODIES) + ')')}, {BODIES[0]})"


def payloads(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Request bodies of twenty events each; a group has a fixed size."""
    members = with_page(raw, pages, "event_id").select(
        F.expr(BATCH_SQL).alias("batch_id"),
        "event_id",
        "ts",
        *[F.expr(sql).alias(name) for name, sql in MEMBER_SQL.items()],
    )
    texts = members.select("batch_id", "event_id", "ts", F.expr(EVENT_TEXT_SQL).alias("text"))
    listed = texts.groupBy("batch_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("event_id", "text"))), lambda e: e["text"]
        ).alias("texts"),
        F.max("ts").alias("received_at"),
    )
    joined = F.array_join("texts", ",")
    shaped = listed.select(
        "batch_id",
        "received_at",
        joined.alias("joined"),
        joined.alias("joined_bytes"),
        F.get("texts", F.lit(0)).alias("head"),
    )
    return shaped.select("batch_id", "received_at", F.expr(BODY_SQL).alias("body"))


def sample_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return payloads(read_sample(spark, sf_dir, "events"), read_sample(spark, sf_dir, "pages"))


def with_request(rows: DataFrame) -> DataFrame:
    """Request facts of a batch, dealt out by its number."""
    return rows.select(
        "*",
        F.expr(by_batch(deal(ADDRESSES))).alias("client_ip"),
        F.expr(deal(AGENTS, "batch_id")).alias("user_agent"),
        F.expr("CASE WHEN batch_id % 3 = 0 THEN 'DE' END").alias("server_country"),
    )


def _payload_query(job: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(sample_payloads(spark, sf_dir))


def _place():
    """The place in the batch; -1 for a body without events."""
    return F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos")


def _parsed_columns(parsed: DataFrame) -> DataFrame:
    def text(path: str):
        return F.try_variant_get("event", path, "string")

    errors = ["batch_error"] if "batch_error" in parsed.columns else []
    return parsed.select(
        "batch_id",
        _place(),
        text("$.event_type").alias("event_type"),
        text("$.user_id").alias("user_id"),
        text("$.properties.k").alias("k"),
        *errors,
    )


def _verdicts(rows: DataFrame) -> DataFrame:
    """One row per body: accepted, or why not."""
    parsed = ingest.parse_payloads(rows).where("pos IS NULL OR pos = 0")
    return parsed.select("batch_id", "batch_error")


def _validated(rows: DataFrame) -> DataFrame:
    checked = ingest.validate_events(ingest.parse_payloads(rows))
    return checked.withColumn("pos", F.col("pos").cast("bigint")).drop("received_at")


def _validated_columns(rows: DataFrame) -> DataFrame:
    return _validated(rows).select("batch_id", _place(), "error_code")


def _valid_fields(rows: DataFrame) -> DataFrame:
    kept = ingest.valid_events(_validated(rows))
    return kept.select("batch_id", "pos", "event_type", *OPTIONAL_FIELDS)


def _property_errors(rows: DataFrame) -> DataFrame:
    checked = ingest.validate_properties(ingest.explode_batches(rows))
    return checked.select("batch_id", F.col("pos").cast("bigint").alias("pos"), "properties_error")


def _enriched(rows: DataFrame) -> DataFrame:
    checked = ingest.validate_events(ingest.parse_payloads(with_request(rows)))
    return enrich.enrich_events(ingest.valid_events(checked), trust_client_country=True)


def _stamped(rows: DataFrame) -> DataFrame:
    checked = ingest.validate_events(ingest.parse_payloads(with_request(rows)))
    stamped = enrich.stamp_server_fields(ingest.valid_events(checked))
    return stamped.select("id", "event_type", "ua", "country", "timestamp")


_ENRICHED = ["id", "event_type", "session_id", "user_id", "url", "referrer", "properties", "ip", "ua", "country", "browser",
             "device_type", "timestamp", *UTM_FIELDS]

# ---- requests ---------------------------------------------------------------------------

PEERS = ["'10.1.2.3'", "'10.1.2.3:443'", "'192.168.1.7'", "'203.0.113.' || CAST(event_id % 200 AS STRING)",
         "'[2001:db8:1::9]:8080'", "'::ffff:10.9.9.9'", "NULL", "'2001:0DB9::1'"]
FORWARDED = ["NULL", "''", "'198.51.100.' || CAST(event_id % 250 AS STRING)",
             "'203.0.113.50, 198.51.100.1'", "'203.0.113.50,10.0.0.2'", "'not-an-address, 999.1.1.1'",
             "'203.0.113.9:99, 192.168.1.7 , 10.200.0.1'", "'2001:DB9::5, [2001:db8::7]:1'",
             "' , 198.51.100.77 ,'", "'10.0.0.9, 192.168.1.7'", "'198.51.100.5, bad.one'"]
HEADERS = {
    "cf_ipcountry": deal(["NULL", "'fr'", "''", "' de '", "'far too long for a code'"]),
    "x_country_code": deal(["NULL", "'us'", "''"]),
    "cloudfront_viewer_country": deal(["'gb'", "NULL"]),
}
TRUSTED = ["10.0.0.0/8", "192.168.1.7", "2001:db8::/32"]
REQUEST_SQL = {
    "id": "event_id",
    "ts": "ts",
    "remote_address": deal(PEERS),
    "x_forwarded_for": deal(FORWARDED),
    "user_agent": deal(AGENTS),
    "client_country": "CASE WHEN event_id % 7 < 3 THEN 'ES' WHEN event_id % 7 = 3 THEN '' END",
    **HEADERS,
}
# A third of all requests share one address.
CALLER = "CASE WHEN user_id % 3 = 0 THEN '198.51.100.1' ELSE '10.0.0.' || CAST(user_id % 20 AS STRING) END"
RATE = (25, timedelta(hours=6))


def sample_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    raw = read_sample(spark, sf_dir, "events")
    return raw.select(*[F.expr(sql).alias(name) for name, sql in REQUEST_SQL.items()])


def sample_callers(raw: DataFrame) -> DataFrame:
    return raw.select(F.expr(CALLER).alias("ip"), "ts", F.col("event_id").alias("id"))


def _resolve(trust) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        resolved = clients.resolve_clients(sample_requests(spark, sf_dir), trust)
        return resolved.select("id", "client_ip", "country")

    return run


def _request_query(job: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(sample_requests(spark, sf_dir))


def _normalized(requests: DataFrame) -> DataFrame:
    return requests.select("id", normalize_ip(F.col("remote_address")).alias("ip"))


def _in_cidr(requests: DataFrame) -> DataFrame:
    return requests.select("id", ip_in_cidr(F.col("remote_address"), TRUSTED).alias("trusted"))


def _country(requests: DataFrame) -> DataFrame:
    resolved = clients.resolve_clients(requests, 1)
    country = clients.resolve_country(F.col("country"), F.col("client_country"), True)
    return resolved.select("id", country.alias("country"))


LISTED_IP = """CAST(event_id % 223 + 1 AS STRING) || '.' || CAST(event_id * 7 % 256 AS STRING) || '.'
  || CAST(event_id * 11 % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING)"""
NETWORK = """CAST(o_orderkey % 223 + 1 AS STRING) || '.' || CAST(o_orderkey * 7 % 256 AS STRING) || '.'
  || CAST(o_orderkey * 13 % 256 AS STRING) || '.0/' || CAST(12 + o_orderkey % 21 AS STRING)"""


def _in_cidr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses against one network for each order."""
    configure(spark)
    rows = read_sample(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(LISTED_IP).alias("ip"))
    networks = read_sample(spark, sf_dir, "orders").select(F.expr(NETWORK).alias("entry"))
    return clients.mark_listed(rows, networks).select("id", F.col("listed").alias("trusted"))


def _rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return rates.rate_limit(sample_callers(read_sample(spark, sf_dir, "events")), *RATE)


COLLECT_RATE = (2, timedelta(days=1))


def by_batch(sql: str) -> str:
    """Deal by batch instead of by event."""
    return sql.replace("event_id", "batch_id")


def collect_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {k: by_batch(v) for k, v in REQUEST_SQL.items() if k not in ("id", "ts", "client_country")}
    return sample_payloads(spark, sf_dir).select("*", *[F.expr(sql).alias(name) for name, sql in columns.items()])


COLLECT = {"trust": TRUSTED, "trust_client_country": True, "max_requests": COLLECT_RATE[0], "window": COLLECT_RATE[1]}


def _collected(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return collect_requests(collect_inputs(spark, sf_dir), **COLLECT)


def _store_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three kinds, written by one job and read back."""
    folder = shared_folder(spark, "collected")
    store_collected(collect_inputs(spark, sf_dir), folder, **COLLECT)
    return spark.read.schema(COLLECTED).parquet(folder).select(
        "kind", F.coalesce("batch_id", F.lit(-1)).alias("batch_id"), _place(), "error_code", "id", "event_type", "session_id", "ip", "country"
    )


def _stream_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw requests that come in three portions, each after the query has stopped and been started again."""
    source, folder, checkpoint = (shared_folder(spark, f"collect-{what}") for what in ("in", "out", "progress"))
    requests = collect_inputs(spark, sf_dir)
    for portion in range(3):
        # By days, so later portions are later in time.
        of_day = (F.floor(F.dayofmonth("received_at") / 11) == portion)
        requests.where(of_day).write.mode("append").parquet(source)
        stream = spark.readStream.schema(requests.schema).parquet(source)
        writer = stream_rates.stream_collect(stream, folder, **COLLECT).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    return stream_rates.read_streamed(spark, folder, "event").select(*_ENRICHED)


# ---- per-row parts ----------------------------------------------------------------------


def _event_columns(urls: bool = False, **columns) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        rows = sample_events(spark, sf_dir, urls)
        return rows.select("id", *[build().alias(name) for name, build in columns.items()])

    return run


def _utm(build: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        rows = sample_events(spark, sf_dir, urls=True)
        found = extract_utm(F.col("url"))
        return rows.select("id", *[build(name, found[name]).alias(name) for name in UTM_FIELDS])

    return run


OWN_UTM = "CASE WHEN id % 5 = 0 THEN 'own' WHEN id % 5 = 1 THEN '' END"
OPT_OUT = {"dnt": "CASE WHEN event_id % 8 = 0 THEN '1' WHEN event_id % 8 = 1 THEN 'yes' WHEN event_id % 8 = 2 THEN '0' END",
           "gpc": "CASE WHEN event_id % 9 = 0 THEN true WHEN event_id % 9 = 1 THEN false END"}
LONG_SQL = {
    "event_type": "CASE WHEN event_id % 3 = 0 THEN repeat(event_type, 40) ELSE event_type END",
    "referrer": "CASE WHEN event_id % 5 = 0 THEN repeat('é', 9000) END",
    "properties": deal(
        [
            "'{\"text\":\"' || repeat('t', 5000) || '\",\"n\":1}'",
            "'{\"a\":{\"b\":{\"c\":{\"d\":{\"e\":{\"f\":1}},\"g\":' || CAST(event_id AS STRING) || '}}}}'",
            "'{\"list\":[' || repeat(CAST(event_id AS STRING) || ',', 59) || '7]}'",
            "'{\"a\":1,\"a\":' || CAST(event_id AS STRING) || ',\"b\":[[1],{\"c\":2}]}'",
            "' { \"a\" : \"x y\" , \"b\" : [ 1 , 2 ] } '",
            "'{\"s\":\"' || repeat('😀', 2050) || '\"}'",
            "'{\"' || repeat('k', 70) || '\":' || CAST(event_id AS STRING) || '}'",
            "'[1,2]'",
            *["props"] * 4,
        ]
    ),
}


def _client_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    raw = with_page(
        read_sample(spark, sf_dir, "events"), read_sample(spark, sf_dir, "pages"), "event_id"
    )
    return raw.select(
        F.col("event_id").alias("id"),
        "url",
        *[F.expr(sql).alias(name) for name, sql in {**LONG_SQL, **OPT_OUT}.items()],
    )


def _length(text):
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint")


def _cut(rows: DataFrame) -> DataFrame:
    return rows.select("id", "event_type", _length(F.col("referrer")).alias("referrer_length"), "properties")


HREF_SQL = deal(
    ["target_url", "page_url || '#part'", "target_url || '/files/Report.PDF?x=1.html#y'", "'javascript:void(0)'",
     "page_url || '/setup.tar.gz'", "''", "'mailto:someone@example.org'", "'HTTPS://user@Other.Example.COM:8443/a.zip'",
     "target_url || '?file=a.csv'", "NULL"]
)
CLICK_SQL = {
    "href": HREF_SQL,
    "has_download_attr": "event_id % 6 = 0",
    "target": "CASE WHEN event_id % 4 = 0 THEN '_blank' WHEN event_id % 4 = 1 THEN '' END",
}


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    pages = read_sample(spark, sf_dir, "pages")
    raw = with_page(read_sample(spark, sf_dir, "events"), pages, "event_id", "page_url")
    both = with_page(raw, pages, "event_id * 7 + 3", "target_url")
    return both.select(
        F.col("event_id").alias("id"),
        "page_url",
        *[F.expr(sql).alias(name) for name, sql in CLICK_SQL.items()],
    )


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browser.classify_links(_clicks(spark, sf_dir)).select(
        "id",
        "event_type",
        "extension",
        F.get_json_object("properties", "$.href").alias("href"),
        F.get_json_object("properties", "$.target").alias("target"),
    )


# ---- writing ----------------------------------------------------------------------------


def _append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the events in two appends and read the table back."""
    configure(spark)
    folder = shared_folder(spark, "events")
    rows = sample_events(spark, sf_dir, urls=True)
    first = F.col("id") % 2 == 0
    enrich.append_events(rows.where(first), folder)
    enrich.append_events(rows.where(~first), folder)
    stored = spark.read.parquet(folder)
    return stored.select("id", "event_type", "session_id", "url", "timestamp")


def _track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    calls = sample_events(spark, sf_dir, urls=True).select(
        "id",
        F.concat(F.lit(" "), "event_type").alias("name"),
        *["properties", "session_id", "user_id", "url", "referrer", "ip", "ua", "country"],
        F.col("timestamp").alias("called_at"),
    )
    return enrich.track_events(calls).select(*_ENRICHED)


def _warehouse_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append, fold, roll up and roll up again; then the stored metrics."""
    configure(spark)
    root = shared_folder(spark, "store")
    store.append_batch(sample_events(spark, sf_dir), root, "all")
    store.fold_events(store.read_events(spark, root), root)
    store.roll_up(spark, root, AS_OF, Retention(keep_raw_days=20))
    store.roll_up(spark, root, AS_OF, Retention(keep_raw_days=10))
    return store.read_metrics(spark, root)


LATE_CUTOFF = AS_OF - timedelta(days=20)
LATE_IDS = 10_000_000


def _warehouse_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive below the floor, before folds, a repeated micro-batch and the next rollup: all metrics."""
    configure(spark)
    root = shared_folder(spark, "store")
    rows = sample_events(spark, sf_dir)
    store.append_batch(rows, root, "all")
    store.fold_events(store.read_events(spark, root), root)
    store.roll_up(spark, root, AS_OF, Retention(keep_raw_days=20))
    late = rows.where((F.col("id") % 7 == 0) & (F.col("timestamp") < F.lit(LATE_CUTOFF).cast("timestamp_ntz")))
    late = late.withColumn("id", F.col("id") + LATE_IDS)
    for _ in range(2):  # an append that is repeated replaces itself
        store.append_batch(late, root, "late")
    store.fold_events(store.read_events(spark, root), root)
    visible = store.read_events(spark, root).where(F.col("id") >= LATE_IDS).agg(F.count("*").alias("value"))
    seen = visible.select(
        F.lit("").alias("date"), F.lit("late").alias("metric"), F.lit("").alias("dimension"), "value"
    )
    # Counted before the next rollup takes these events.
    seen = spark.createDataFrame(seen.collect(), seen.schema)
    store.roll_up(spark, root, AS_OF, Retention(keep_raw_days=10))
    return store.read_metrics(spark, root).unionByName(seen)


def _merged_in_buckets(name: str) -> Query:
    """The events of the first and of the second half of the period, merged into stored buckets one after the other."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        folder = shared_folder(spark, name)
        events = sample_events(spark, sf_dir, urls=True)
        early = F.col("timestamp") < F.lit(PERIOD.since).cast("timestamp_ntz")
        for part in (early, ~early, ~early):  # what is merged again changes nothing
            entities.merge_entities(events.where(part), folder, name)
        return entities.read_entities(spark, folder, name)

    return run


# ---- streams ----------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    schema = read_sample(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _finish(writer, spark: SparkSession, purpose: str) -> None:
    """Run a stream over what is there now, then stop."""
    checkpoint = shared_folder(spark, f"{purpose}-progress")
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    source, folder = shared_folder(spark, "payloads"), shared_folder(spark, "ingest")
    with_request(sample_payloads(spark, sf_dir)).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    _finish(stream_in.stream_ingest(stream, folder, trust_client_country=True), spark, "ingest")
    return stream_in.read_ingested(spark, folder).select(*_ENRICHED)


def _stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a stream has stored, rolled up where they are."""
    configure(spark)
    source, folder = shared_folder(spark, "payloads"), shared_folder(spark, "ingest")
    with_request(sample_payloads(spark, sf_dir)).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    _finish(stream_in.stream_ingest(stream, folder, trust_client_country=True), spark, "ingest")
    store.roll_up(spark, folder, AS_OF, Retention(keep_raw_days=10))
    return store.read_metrics(spark, folder)


def _stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "sessions")
    events = model_events(_event_stream(spark, sf_dir), read_sample(spark, sf_dir, "pages"))
    _finish(stream_in.stream_sessions(events, folder), spark, "sessions")
    return stream_in.read_sessions(spark, folder)


def _stream_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "users")
    _finish(stream_in.stream_users(model_events(_event_stream(spark, sf_dir)), folder), spark, "users")
    return stream_in.read_users(spark, folder)


def _stream_active_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "active")
    active = live.stream_active_now(model_events(_event_stream(spark, sf_dir)))
    writer = active.writeStream.format("parquet").option("path", folder).outputMode("append")
    _finish(writer, spark, "active")
    return spark.read.parquet(folder)


def _stream_daily_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "views")
    views = live.stream_daily_views(model_events(_event_stream(spark, sf_dir)))
    _finish(live.store_updates(views, folder), spark, "views")
    return live.read_latest(spark, folder, "date", "views")


def _stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "limits")
    _finish(stream_rates.stream_rate_limit(sample_callers(_event_stream(spark, sf_dir)), folder, *RATE), spark, "limits")
    verdicts = stream_rates.read_verdicts(spark, folder)
    # Only a hash of the address is stored.
    callers = sample_callers(read_sample(spark, sf_dir, "events")).select("id", F.col("ip").alias("raw"))
    return verdicts.join(callers, "id").select(F.col("raw").alias("ip"), "ts", "id", "limited", "retry_after")


def queries() -> dict[str, Query]:
    return {
        "read_payloads": _payload_query(_verdicts),
        "parse_payloads": _payload_query(lambda p: _parsed_columns(ingest.parse_payloads(p))),
        "explode_batches": _payload_query(lambda p: _parsed_columns(ingest.explode_batches(p))),
        "validate_events": _payload_query(_validated_columns),
        "valid_event_fields": _payload_query(_valid_fields),
        "validate_properties": _payload_query(_property_errors),
        "quarantine_report": _payload_query(lambda p: ingest.quarantine_report(_validated(p))),
        "stamp_server_fields": _payload_query(_stamped),
        "enrich_events": _payload_query(lambda p: _enriched(p).select(*_ENRICHED)),
        "resolve_clients": _resolve(TRUSTED),
        "resolve_clients_one_hop": _resolve(1),
        "resolve_clients_two_hops": _resolve(2),
        "resolve_clients_untrusted": _resolve(False),
        "normalize_ip": _request_query(_normalized),
        "ip_in_cidr": _request_query(_in_cidr),
        "ip_in_cidr_table": _in_cidr_table,
        "resolve_country": _request_query(_country),
        "filter_bots": _request_query(lambda r: clients.filter_bots(r).select("id", "user_agent")),
        "rate_limit": _rate_limit,
        "collect_events": lambda s, d: _collected(s, d)["events"].select(*_ENRICHED),
        "collect_limited": lambda s, d: _collected(s, d)["limited"],
        "store_collected": _store_collected,
        "parse_browser": _event_columns(browser=lambda: parse_browser(F.col("ua"))),
        "parse_device": _event_columns(device_type=lambda: parse_device(F.col("ua"))),
        "mask_ip": _event_columns(masked=lambda: mask_ip(F.col("ip"))),
        "extract_utm": _utm(lambda _, found: found),
        "merge_utm": _utm(lambda _, found: merge_utm(F.expr(OWN_UTM), found)),
        "drop_opted_out": lambda s, d: browser.drop_opted_out(_client_events(s, d)).select("id"),
        "truncate_fields": lambda s, d: _cut(browser.truncate_fields(_client_events(s, d))),
        "sanitize_events": lambda s, d: _cut(browser.sanitize_events(_client_events(s, d))),
        "classify_links": _links,
        "append_events": _append_events,
        "track_events": _track_events,
        "merge_sessions": _merged_in_buckets("sessions"),
        "merge_users": _merged_in_buckets("users"),
        "warehouse_rollup": _warehouse_rollup,
        "warehouse_late_events": _warehouse_late_events,
        "stream_collect": _stream_collect,
        "stream_ingest": _stream_ingest,
        "stream_rollup": _stream_rollup,
        "stream_sessions": _stream_sessions,
        "stream_users": _stream_users,
        "stream_active_now": _stream_active_now,
        "stream_daily_views": _stream_daily_views,
        "stream_rate_limit": _stream_rate_limit,
    }


def oracle_sql(ev: str, ev_s: str, ev_u: str) -> dict[str, str]:
    from footfall.plans import derived_oracle

    return derived_oracle.oracle_sql(ev, ev_s, ev_u)
