"""Valid events to stored events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.addresses import mask_ip
from footfall.functions.agents import parse_browser, parse_device
from footfall.functions.links import extract_utm, merge_utm
from footfall.functions.text import none_if_empty, trim_blanks
from footfall.model import EVENTS, IDS_PER_BATCH, UTM_FIELDS
from footfall.operators.clients import resolve_country
from footfall.operators.filters import instant


def stamp_server_fields(valid: DataFrame, trust_client_country: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Server facts replace what a client claims; a batch shares one arrival time.

    ``valid`` carries the request's client_ip, user_agent, server_country and received_at.
    Columns named in ``keep`` are passed through.
    """
    return valid.select(
        *keep,
        (F.col("batch_id") * IDS_PER_BATCH + F.coalesce(F.col("pos"), F.lit(0))).alias("id"),
        "event_type",
        "session_id",
        "user_id",
        "url",
        "referrer",
        "properties",
        F.col("client_ip").alias("ip"),
        F.coalesce(F.col("user_agent"), F.lit("")).alias("ua"),
        resolve_country(F.col("server_country"), F.col("country"), trust_client_country).alias(
            "country"
        ),
        F.col("received_at").cast("timestamp_ntz").alias("timestamp"),
        *UTM_FIELDS,
    )


def write_events(stamped: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Enrich stamped events into table rows: masked address, browser, device, campaign.

    One narrow projection; the raw address does not survive it. Columns named in ``keep`` come first.
    """
    from_url = extract_utm(F.col("url"))
    derived: dict[str, Column] = {
        "properties": F.coalesce(F.col("properties"), F.lit("{}")),
        "ip": mask_ip(F.col("ip")),
        "browser": parse_browser(F.col("ua")),
        "device_type": parse_device(F.col("ua")),
        **{name: merge_utm(F.col(name), from_url[name]) for name in UTM_FIELDS},
    }
    return stamped.select(
        *keep,
        *[derived.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in EVENTS]
    )


def enrich_events(valid: DataFrame, trust_client_country: bool = False) -> DataFrame:
    return write_events(stamp_server_fields(valid, trust_client_country))


def _named() -> Column:
    return F.coalesce(trim_blanks(F.col("name")) != "", F.lit(False))


def refused_calls(calls: DataFrame) -> DataFrame:
    """The tracking calls that `track_events` leaves out: those whose name is NULL or blank."""
    return calls.where(~_named())


def track_events(calls: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Server-side tracking calls to table rows.

    ``calls`` has id (arrival number), name, properties, session_id, user_id, url, referrer,
    ip, ua, country and called_at. Empty context becomes NULL; a call without a time takes
    ``as_of``, by default the time (UTC) at which this is called; calls with a blank name are left out (see `refused_calls`). A name is
    stored as given, and no length limits apply.
    """
    context = ["session_id", "user_id", "url", "referrer", "ip", "ua", "country"]
    now = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    called_at = F.coalesce(F.col("called_at").cast("timestamp_ntz"), instant(now))
    return write_events(
        calls.where(_named()).select(
            "id",
            F.col("name").alias("event_type"),
            *[none_if_empty(F.col(c)).alias(c) for c in context],
            "properties",
            called_at.alias("timestamp"),
            *[F.lit(None).cast("string").alias(c) for c in UTM_FIELDS],
        )
    )


def append_events(events: DataFrame, path: str) -> None:
    """Append to a Parquet table partitioned by UTC date.

    Rows are rebalanced by date, so that a date is written by as few tasks as its size
    allows and a busy date by several; within a file they are sorted by session, which
    tightens the row-group statistics.
    """
    dated = events.withColumn("event_date", F.col("timestamp").cast("date"))
    (
        dated.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "session_id", "timestamp", "id")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )
