"""Session and user tables that are kept up in proportion to what changes.

A table is Parquet partitioned by a hash of the id. A merge reads and rewrites only the buckets in which
an id of the new rows lies, by a dynamic partition overwrite; the files of all others stay as they are. Reading folds
nothing. Merged rows carry the arrival numbers of their first and last event, so that merging the same events
again changes nothing, and each bucket the number of the last micro-batch it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.model import SESSIONS, USERS
from footfall.operators.state import build_sessions, build_users

# Buckets of a new table; a table keeps its number, and a merge lists at most so many at the driver.
BUCKETS = 64

_ARRIVAL = [T.StructField("first_id", T.LongType()), T.StructField("last_id", T.LongType())]
_SCHEMAS = {"sessions": SESSIONS, "users": USERS}
_BUILD = {"sessions": build_sessions, "users": build_users}
_PLACE = [T.StructField("batch_no", T.LongType()), T.StructField("bucket", T.IntegerType())]


def _stored_schema(name: str) -> T.StructType:
    return T.StructType([*_SCHEMAS[name].fields, *_ARRIVAL, *_PLACE])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")


def stored_or_none(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame | None:
    """The table, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_entities(spark: SparkSession, path: str, name: str, arrival: bool = False) -> DataFrame:
    """The 'sessions' or 'users' at ``path``; a bucket that was emptied holds one row without id."""
    schema = _stored_schema(name)
    rows = stored_or_none(spark, schema, path)
    rows = spark.createDataFrame([], schema) if rows is None else rows
    return rows.where("id IS NOT NULL").select(*_SCHEMAS[name].names, *([f.name for f in _ARRIVAL] if arrival else []))


def _overwrite(rows: DataFrame, path: str) -> None:
    """Replace the buckets that have rows; a large bucket is written by several tasks."""
    writer = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


def merge_entities(events: DataFrame, path: str, name: str, batch_no: int | None = None, buckets: int = BUCKETS) -> None:
    """Merge events into the table 'sessions' or 'users' at ``path``.

    With a ``batch_no``, buckets that already hold this or a later micro-batch are left alone: one that is run
    again after a failure completes what is missing. Without, all buckets the events touch are rewritten.
    """
    spark, build = events.sparkSession, _BUILD[name]
    schema = _stored_schema(name)
    added = build(events, arrival=True).withColumn("bucket", _bucket(buckets)).persist(StorageLevel.DISK_ONLY)
    try:
        touched = {r.bucket for r in added.select("bucket").distinct().collect()}
        stored = stored_or_none(spark, schema, path)
        if stored is not None:
            stored = stored.where(F.col("bucket").isin(sorted(touched)))
            if batch_no is not None:
                held = stored.groupBy("bucket").agg(F.max("batch_no").alias("newest")).where(F.col("newest") >= batch_no)
                touched -= {r.bucket for r in held.collect()}
                stored = stored.where(F.col("bucket").isin(sorted(touched)))
        if not touched:
            return
        rows = added.where(F.col("bucket").isin(sorted(touched))).drop("bucket")
        newest = F.lit(-1 if batch_no is None else batch_no).cast("long")
        if stored is not None:
            rows = rows.unionByName(stored.where("id IS NOT NULL").select(*rows.columns))
        merged = build(None, rows, arrival=True).select("*", newest.alias("batch_no"), _bucket(buckets))
        _overwrite(merged, path)
    finally:
        added.unpersist()


def prune_entities(spark: SparkSession, path: str, name: str, prune: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrite the buckets from which ``prune`` takes rows; doing it again changes nothing."""
    schema = _stored_schema(name)
    stored = stored_or_none(spark, schema, path)
    if stored is None:
        return
    rows = stored.where("id IS NOT NULL")
    gone = rows.join(prune(rows).select("id"), "id", "left_anti").select("bucket").distinct()
    touched = sorted(r.bucket for r in gone.collect())
    if not touched:
        return
    rows = stored.where("id IS NOT NULL").where(F.col("bucket").isin(touched))
    markers = spark.createDataFrame([(bucket,) for bucket in touched], "bucket int")
    empty = markers.select(*[F.col("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    _overwrite(prune(rows).select(*schema.names).unionByName(empty), path)
