"""Events, sessions, users and metrics under one folder, as plain Parquet jobs.

Layout::

    events/batch_no=<name>/event_date=<day>/   one folder for each append; a repeated append replaces its own
    sessions/bucket=<n>/, users/bucket=<n>/    see `entities`
    metrics/run=<name>/                        the counts that each rollup has added
    counted/run=<name>/                        which appends it has counted, and up to when

A rollup counts the visible events older than its cutoff in the appends that are there when it begins,
and writes ``counted`` last: that one write makes both its counts valid and its events invisible. A rollup that
failed before has changed nothing, and its successor takes its name and replaces what it has left. Events
are not rewritten; those of other appends stay visible whatever their date, until the next rollup counts
them. Pruning sessions and users comes after and may be repeated.

Atomic versions of all tables together, and deleting files that no reader needs, are left to a table format of
the catalog. `rolled_up` lists the folders that hold no visible event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.model import EVENTS, METRICS
from footfall.operators.filters import instant, is_pageview
from footfall.operators.retention import Retention, daily_counts, merge_metrics, prune_metrics, prune_sessions, prune_users
from footfall.sources.entities import merge_entities, prune_entities, read_entities, stored_or_none
from footfall.sources.tables import conform

_EVENTS = T.StructType(
    [*EVENTS.fields, T.StructField("batch_no", T.StringType()), T.StructField("event_date", T.DateType())]
)
_COUNTED = T.StructType(
    [
        T.StructField("batch_no", T.StringType()),
        T.StructField("floor", T.TimestampNTZType()),
        T.StructField("metrics_cutoff", T.TimestampNTZType()),
        T.StructField("run", T.StringType()),
    ]
)
_METRICS = T.StructType([*METRICS.fields, T.StructField("run", T.StringType())])


def _read(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    rows = stored_or_none(spark, schema, path)
    return spark.createDataFrame([], schema) if rows is None else rows


def append_batch(events: DataFrame, root: str, name: str) -> None:
    """Add events under a name; the same name again replaces them, so a failed append can be repeated."""
    rows = conform(events, EVENTS).select(*EVENTS.names, F.col("timestamp").cast("date").alias("event_date"))
    (
        rows.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "session_id", "timestamp", "id")
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(f"{root}/events/batch_no={name}")
    )


def _floors(counted: DataFrame) -> DataFrame:
    """Per append, the time below which its events are counted."""
    return counted.groupBy(F.col("batch_no").alias("_batch")).agg(F.max("floor").alias("_floor"))


def _visible(events: DataFrame, counted: DataFrame) -> DataFrame:
    above = F.col("_floor").isNull() | F.col("timestamp").isNull() | (F.col("timestamp") >= F.col("_floor"))
    return events.join(_floors(counted), F.col("batch_no") == F.col("_batch"), "left").where(above).drop("_batch", "_floor")


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """Visible events; periods prune on ``event_date``."""
    counted = _read(spark, _COUNTED, f"{root}/counted")
    return _visible(_read(spark, _EVENTS, f"{root}/events"), counted).drop("batch_no")


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The counts of all finished rollups, without the days that the last one dropped."""
    counted = _read(spark, _COUNTED, f"{root}/counted")
    runs = counted.groupBy("run").agg(F.max("metrics_cutoff").alias("cutoff"))
    rows = _read(spark, _METRICS, f"{root}/metrics").join(runs.select("run"), "run", "left_semi")
    merged = merge_metrics(spark.createDataFrame([], METRICS), rows)
    newest = runs.agg(F.max("cutoff")).first()[0]
    return merged if newest is None else prune_metrics(merged, newest)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """'sessions' or 'users'."""
    return read_entities(spark, f"{root}/{name}", name)


def fold_events(events: DataFrame, root: str) -> None:
    """Merge events into the session and user tables; events that are in already change nothing."""
    for name in ("sessions", "users"):
        merge_entities(events, f"{root}/{name}", name)


def roll_up(spark: SparkSession, root: str, as_of, retention: Retention = Retention()) -> None:
    """Roll up and prune; see above for what a failure leaves."""
    if not retention.auto_rollup:
        return
    cutoff = retention.cutoff(as_of)
    counted = _read(spark, _COUNTED, f"{root}/counted")
    run = f"{counted.select('run').distinct().count():06d}"
    events = _read(spark, _EVENTS, f"{root}/events")
    # The appends there are, fixed before anything is counted.
    path = f"{root}/started/run={run}"
    events.select("batch_no").distinct().write.mode("overwrite").parquet(path)
    started = spark.read.schema("batch_no string").parquet(path)

    expired = _visible(events, counted).join(F.broadcast(started), "batch_no", "left_semi")  # one row an append
    expired = expired.where((F.col("event_date") <= F.lit(cutoff.date())) & (F.col("timestamp") < instant(cutoff)))
    metric = F.when(is_pageview(), "pageviews").otherwise(F.col("event_type"))
    daily_counts(expired, metric).write.mode("overwrite").parquet(f"{root}/metrics/run={run}")
    _publish(
        started.select(
            "batch_no", instant(cutoff).alias("floor"), instant(retention.rollup_cutoff(as_of)).alias("metrics_cutoff")
        ),
        f"{root}/counted/run={run}",
    )
    prune_entities(spark, f"{root}/sessions", "sessions", lambda rows: prune_sessions(rows, cutoff))
    retained = read_events(spark, root)
    prune_entities(spark, f"{root}/users", "users", lambda rows: prune_users(rows, retained, cutoff))


def _publish(counted: DataFrame, path: str) -> None:
    counted.write.mode("overwrite").parquet(path)


def rolled_up(spark: SparkSession, root: str) -> DataFrame:
    """``batch_no``, ``event_date`` of the event folders without visible events, which nothing reads any more."""
    events, counted = _read(spark, _EVENTS, f"{root}/events"), _read(spark, _COUNTED, f"{root}/counted")
    folders = events.select("batch_no", "event_date").distinct()
    return folders.exceptAll(_visible(events, counted).select("batch_no", "event_date").distinct())
