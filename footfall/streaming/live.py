"""Live figures over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from footfall.functions.text import iso_date, present
from footfall.operators.filters import is_pageview


def stream_active_now(
    events: DataFrame, *, minutes: int = 5, lateness: str = "1 minute"
) -> DataFrame:
    """Sessions active in the ``minutes`` before each full minute (append mode).

    Exact: a first aggregate keeps one row per minute mark and session, a second counts
    them. Both keep state only until the watermark passes the mark.
    """
    seen = (
        events.where(present(F.col("session_id")))
        .select("session_id", F.col("timestamp").cast("timestamp").alias("at"))
        .withWatermark("at", lateness)
    )
    per_session = seen.groupBy(
        F.window("at", f"{minutes} minutes", "1 minute"), "session_id"
    ).agg(F.count("*").alias("events"))
    return (
        per_session.groupBy("window")
        .agg(F.count("*").alias("active"))
        .select(F.col("window.end").cast("timestamp_ntz").alias("as_of"), "active")
    )


def stream_daily_views(events: DataFrame, *, lateness: str = "1 day") -> DataFrame:
    """Page views per UTC day; in update mode each batch emits the days it changed."""
    views = (
        events.where(is_pageview())
        .select(F.col("timestamp").cast("timestamp").alias("at"))
        .withWatermark("at", lateness)
    )
    return (
        views.groupBy(F.window("at", "1 day"))
        .agg(F.count("*").alias("views"))
        .select(iso_date(F.col("window.start")).alias("date"), "views")
    )


def store_updates(rows: DataFrame, folder: str) -> DataStreamWriter:
    """Sink for update mode: each micro-batch leaves its changed rows in its own folder."""

    def store(batch: DataFrame, batch_no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_no={batch_no}")

    return rows.writeStream.outputMode("update").foreachBatch(store)


def read_latest(spark: SparkSession, folder: str, key: str, value: str) -> DataFrame:
    """The newest value per key that ``store_updates`` has left."""
    rows = spark.read.parquet(folder)
    return rows.groupBy(key).agg(F.max_by(value, "batch_no").alias(value))
