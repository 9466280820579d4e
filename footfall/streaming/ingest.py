"""Payload streams to stored events, and the session and user tables kept up with them.

Events and quarantine go to a folder for every micro-batch, named by its number, and sessions and users are
merged into the buckets they touch. A micro-batch that is run again after a failure replaces its folder and
skips the buckets that hold it already, so nothing is stored or counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from footfall.model import EVENTS
from footfall.operators.enrich import enrich_events
from footfall.operators.ingest import (
    parse_payloads,
    quarantined_events,
    valid_events,
    validate_events,
)
from footfall.sources.entities import BUCKETS, merge_entities, read_entities


def _write_batch(rows: DataFrame, folder: str, batch_no: int, by_date: bool = False) -> None:
    if by_date:
        rows = rows.hint("rebalance", "event_date")
    writer = rows.write.mode("overwrite")
    if by_date:
        writer = writer.partitionBy("event_date")
    writer.parquet(f"{folder}/batch_no={batch_no}")


def _dealt_out(batch: DataFrame) -> DataFrame:
    """A micro-batch in two partitions for each core at least; the cached events keep these, so small ones are not many."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch.repartition(max(2 * cores, batch.rdd.getNumPartitions()))


def stream_ingest(
    payloads: DataFrame, folder: str, *, trust_client_country: bool = False
) -> DataStreamWriter:
    """Validate and enrich a stream of payloads into ``folder``/events and /quarantine.

    ``payloads`` has batch_id, body, client_ip, user_agent, server_country and received_at. The bodies of a
    micro-batch are dealt out first: one file may be all of it, and would be parsed by one task.
    """

    def store(batch: DataFrame, batch_no: int) -> None:
        checked = validate_events(parse_payloads(_dealt_out(batch))).persist()
        try:
            events = enrich_events(valid_events(checked), trust_client_country)
            dated = events.withColumn("event_date", events["timestamp"].cast("date"))
            _write_batch(dated, f"{folder}/events", batch_no, by_date=True)
            _write_batch(quarantined_events(checked), f"{folder}/quarantine", batch_no)
        finally:
            checked.unpersist()

    return payloads.writeStream.foreachBatch(store)


def read_ingested(spark: SparkSession, folder: str) -> DataFrame:
    """Stored events; periods prune on ``event_date``."""
    schema = T.StructType(
        [*EVENTS.fields, T.StructField("batch_no", T.LongType()), T.StructField("event_date", T.DateType())]
    )
    return spark.read.schema(schema).parquet(f"{folder}/events").drop("batch_no")


def _stream_entities(events: DataFrame, folder: str, name: str, buckets: int) -> DataStreamWriter:
    def store(batch: DataFrame, batch_no: int) -> None:
        merge_entities(batch, folder, name, batch_no, buckets)

    return events.writeStream.foreachBatch(store)


def stream_sessions(events: DataFrame, folder: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Merge each micro-batch into the sessions at ``folder``, of which only touched buckets are rewritten.

    Every bucket knows the last micro-batch it holds, so one that runs again changes nothing.
    """
    return _stream_entities(events, folder, "sessions", buckets)


def read_sessions(spark: SparkSession, folder: str, arrival: bool = False) -> DataFrame:
    return read_entities(spark, folder, "sessions", arrival)


def stream_users(events: DataFrame, folder: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Merge each micro-batch into the users at ``folder``, as `stream_sessions` does."""
    return _stream_entities(events, folder, "users", buckets)


def read_users(spark: SparkSession, folder: str, arrival: bool = False) -> DataFrame:
    return read_entities(spark, folder, "users", arrival)
