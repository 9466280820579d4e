"""Session and user tables as folds over events in arrival order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.text import present
from footfall.model import SESSIONS, USERS


@dataclass(frozen=True)
class _Entity:
    """How a table folds events: its key, what the first event sets, what the last one sets."""

    key: str
    schema: T.StructType
    first: dict[str, str]
    last: str
    constants: dict[str, object]


_SESSION = _Entity(
    key="session_id",
    schema=SESSIONS,
    first={
        "user_id": "user_id",
        "started_at": "timestamp",
        "referrer": "referrer",
        "landing_page": "url",
        "country": "country",
        "browser": "browser",
        "device_type": "device_type",
        "ip": "ip",
        "ua": "ua",
    },
    last="last_seen_at",
    constants={"is_active": 1},
)
_USER = _Entity(
    key="user_id",
    schema=USERS,
    first={
        "first_seen": "timestamp",
        "country": "country",
        "browser": "browser",
        "device_type": "device_type",
    },
    last="last_seen",
    constants={"properties": "{}"},
)
_ARRIVAL = ["first_id", "last_id"]


def _from_events(events: DataFrame, entity: _Entity) -> DataFrame:
    """Each event as the state it would leave behind alone."""
    return events.where(present(F.col(entity.key))).select(
        F.col(entity.key).alias("key"),
        F.struct(*[F.col(source).alias(name) for name, source in entity.first.items()]).alias(
            "first"
        ),
        F.col("id").alias("first_id"),
        F.col("timestamp").alias(entity.last),
        F.col("id").alias("last_id"),
        *[
            F.lit(value).cast(entity.schema[name].dataType).alias(name)
            for name, value in entity.constants.items()
        ],
    )


def _from_stored(existing: DataFrame, entity: _Entity) -> DataFrame:
    """Stored rows as states; without arrival numbers they precede every event."""

    def number(name: str) -> Column:
        known = F.col(name) if name in existing.columns else F.lit(None)
        return F.coalesce(known.cast("bigint"), F.lit(-1)).alias(name)

    return existing.select(
        F.col("id").alias("key"),
        F.struct(*entity.first).alias("first"),
        number("first_id"),
        entity.last,
        number("last_id"),
        *entity.constants,
    )


def _fold(events: DataFrame | None, existing: DataFrame | None, entity: _Entity, arrival: bool):
    """Merge states per key.

    The merge is associative: Spark combines it per task before the shuffle, so one key with
    a large share of all events costs a row per task, and the same code merges events,
    stored tables and the deltas of a stream.
    """
    parts = []
    if events is not None:
        parts.append(_from_events(events, entity))
    if existing is not None:
        parts.append(_from_stored(existing, entity))
    states = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Constants combine by maximum: an event always raises a stored is_active of 0 to 1.
    merged = states.groupBy("key").agg(
        F.min_by("first", "first_id").alias("first"),
        F.max_by(entity.last, "last_id").alias(entity.last),
        F.min("first_id").alias("first_id"),
        F.max("last_id").alias("last_id"),
        *[F.max(name).alias(name) for name in entity.constants],
    )
    columns = {
        "id": F.col("key"),
        **{name: F.col(f"first.{name}") for name in entity.first},
    }
    names = [*entity.schema.names, *(_ARRIVAL if arrival else [])]
    return merged.select(*[columns.get(name, F.col(name)).alias(name) for name in names])


def build_sessions(
    events: DataFrame | None, existing: DataFrame | None = None, *, arrival: bool = False
) -> DataFrame:
    """Sessions from events, merged into ``existing`` sessions where given.

    The first event sets all attributes, even to NULL; the last to arrive sets
    ``last_seen_at``. ``arrival`` keeps the arrival numbers that later merges need.
    """
    return _fold(events, existing, _SESSION, arrival)


def build_users(
    events: DataFrame | None, existing: DataFrame | None = None, *, arrival: bool = False
) -> DataFrame:
    """Users from events, merged into ``existing`` users where given."""
    return _fold(events, existing, _USER, arrival)
