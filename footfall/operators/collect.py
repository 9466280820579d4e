"""The whole way of a request: who sent it, is it allowed, what does it carry."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.addresses import Trust
from footfall.model import EVENTS
from footfall.operators.clients import filter_bots, resolve_clients
from footfall.operators.enrich import stamp_server_fields, write_events
from footfall.operators.ingest import parse_payloads, validate_events
from footfall.operators.rates import RATE_MAX, RATE_WINDOW, decide_moments, refused_requests

EVENT, QUARANTINE, LIMITED = "event", "quarantine", "limited"
# One row for each event stored, event rejected and request refused; only events have event columns and a date.
COLLECTED = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("retry_after", T.LongType()),
        *EVENTS.fields,
        T.StructField("kind", T.StringType()),
        T.StructField("event_date", T.DateType()),
    ]
)


def calls_of(resolved: DataFrame) -> DataFrame:
    """What the rate limit sees of requests."""
    return resolved.select(F.col("client_ip").alias("ip"), F.col("received_at").alias("ts"), F.col("batch_id").alias("id"))


def resolved_requests(requests: DataFrame, trust: Trust) -> DataFrame:
    return resolve_clients(requests, trust).withColumnRenamed("country", "server_country")


def collect_resolved(resolved: DataFrame, refused: DataFrame, trust_client_country: bool = False) -> DataFrame:
    """Resolved requests to rows of `COLLECTED`; ``refused`` has ``batch_id`` and ``retry_after``.

    Bodies are parsed and checked once, in the projection that also enriches the valid events.
    """
    accepted = filter_bots(resolved).join(refused.select("batch_id"), "batch_id", "left_anti")
    carried = ["batch_id", "body", "client_ip", "user_agent", "server_country", "received_at"]
    checked = validate_events(parse_payloads(accepted.select(*carried)))
    tags = ["batch_id", "pos", "error_code"]
    rows = write_events(stamp_server_fields(checked, trust_client_country, tags), tags)
    valid = F.col("error_code").isNull()
    kept = rows.select(
        *tags,
        F.lit(None).cast("long").alias("retry_after"),
        *[F.when(valid, F.col(n)).alias(n) for n in EVENTS.names],
        F.when(valid, EVENT).otherwise(QUARANTINE).alias("kind"),
        F.when(valid, F.col("timestamp").cast("date")).alias("event_date"),
    )
    limited = refused.select(
        *[
            F.col(f.name) if f.name in ("batch_id", "retry_after") else F.lit(LIMITED if f.name == "kind" else None).cast(f.dataType).alias(f.name)
            for f in COLLECTED
        ]
    )
    return kept.unionByName(limited)


def collected_part(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind, with the columns that kind has."""
    columns = {EVENT: EVENTS.names, QUARANTINE: ["batch_id", "pos", "error_code"], LIMITED: ["batch_id", "retry_after"]}
    return rows.where(F.col("kind") == kind).select(*columns[kind])


def collect_tagged(
    requests: DataFrame,
    *,
    trust: Trust = False,
    trust_client_country: bool = False,
    max_requests: int = RATE_MAX,
    window: timedelta = RATE_WINDOW,
) -> DataFrame:
    """Requests to rows of `COLLECTED`, as one lazy frame: written once, all is parsed once.

    ``requests`` has batch_id (unique, in order of arrival), body, received_at, user_agent,
    remote_address, x_forwarded_for and the country headers. Every request counts towards
    its address's rate, bots included; refused and bot requests are then dropped. Rates are
    decided on three narrow columns, so bodies are shuffled only if more requests are
    refused than a broadcast holds.
    """
    resolved = resolved_requests(requests, trust)
    calls = calls_of(resolved)
    refused = refused_requests(calls, decide_moments(calls, max_requests, window))
    return collect_resolved(resolved, refused.select(F.col("id").alias("batch_id"), "retry_after"), trust_client_country)


def collect_requests(requests: DataFrame, **options) -> dict[str, DataFrame]:
    """`collect_tagged` as lazy frames ``events``, ``quarantine`` and ``limited``; using one computes what it needs.

    To store all of them, use `store_collected`, which computes them together.
    """
    rows = collect_tagged(requests, **options)
    return {"events": collected_part(rows, EVENT), "quarantine": collected_part(rows, QUARANTINE), "limited": collected_part(rows, LIMITED)}


def write_collected(rows: DataFrame, folder: str) -> None:
    """One job; events of a date and the other kinds lie in folders of their own."""
    rows.select(*COLLECTED.names).write.mode("overwrite").partitionBy("kind", "event_date").parquet(folder)


def store_collected(requests: DataFrame, folder: str, **options) -> None:
    """Collect requests into ``folder``; running it again replaces what is there."""
    write_collected(collect_tagged(requests, **options), folder)


def read_collected(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """What `store_collected` has left of one kind; the kind and the events' dates prune folders."""
    return collected_part(spark.read.schema(COLLECTED).parquet(folder), kind)
