"""Rate limiting and collecting of request streams, micro-batch by micro-batch.

Every micro-batch is decided by the same job as a batch of requests, together with a log of accepted requests
that the one before has left. The log is the whole state: counts a millisecond under a hash of the address.
It is written to one of two folders in turn, of which a micro-batch reads the other, and holds what later
requests may still meet: a window and ``lateness`` back from the newest request. Whatever is older is
released, so the state grows with the addresses active just now and not with those ever seen; requests later
than that still get a verdict, by what the log has.

A stateful operator would get all requests of an address in one task and in no order, since streaming plans
cannot sort. Here they are sorted and split as in a batch, and come in order of time within a micro-batch.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from footfall.functions.addresses import Trust
from footfall.operators.collect import COLLECTED, calls_of, collect_resolved, collected_part, resolved_requests, write_collected
from footfall.operators.rates import RATE_MAX, RATE_WINDOW, accepted_log, decide_moments, flag_requests, refused_requests

_LOG = "ip string, ms long, accepted long"
LATENESS = timedelta(minutes=10)


def _hashed(ip: str, salt: str) -> Column:
    """Raw addresses are stored nowhere, also not as state."""
    return F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(ip), F.lit(""))), 256)


def read_log(spark: SparkSession, folder: str, batch_no: int) -> DataFrame | None:
    """What micro-batch ``batch_no`` starts from."""
    return spark.read.schema(_LOG).parquet(f"{folder}/log/{(batch_no - 1) % 2}") if batch_no else None


def stream_rate_limit(
    requests: DataFrame,
    folder: str,
    max_requests: int = RATE_MAX,
    window: timedelta = RATE_WINDOW,
    *,
    lateness: timedelta = LATENESS,
    salt: str = "",
) -> DataStreamWriter:
    """Verdicts on a request stream [ip, ts, id], one for every request, into ``folder``/verdicts.

    They have id, ts, limited and retry_after, and the address as a hash that ``salt`` goes into. A
    micro-batch that runs again replaces what it has left. See `read_verdicts`.
    """

    def store(batch: DataFrame, batch_no: int) -> None:
        log = read_log(batch.sparkSession, folder, batch_no)
        calls = batch.select(_hashed("ip", salt).alias("ip"), "ts", "id")
        verdicts = decide_moments(calls, max_requests, window, log).persist(StorageLevel.DISK_ONLY)
        try:
            flag_requests(calls, verdicts).write.mode("overwrite").parquet(f"{folder}/verdicts/batch_no={batch_no}")
            kept = accepted_log(calls, verdicts, log, window, lateness)
            kept.write.mode("overwrite").parquet(f"{folder}/log/{batch_no % 2}")
        finally:
            verdicts.unpersist()

    return requests.writeStream.foreachBatch(store)


def read_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/verdicts").drop("batch_no")


def stream_collect(
    requests: DataFrame,
    folder: str,
    *,
    trust: Trust = False,
    trust_client_country: bool = False,
    max_requests: int = RATE_MAX,
    window: timedelta = RATE_WINDOW,
    lateness: timedelta = LATENESS,
    salt: str = "",
) -> DataStreamWriter:
    """The whole way of a request as one query: resolve, limit, drop bots, validate, enrich, one tagged output.

    ``requests`` is as for `collect_tagged`. A micro-batch's rows go to ``folder``/collected under its number, in
    one job, so all is parsed once and a micro-batch that runs again replaces what it has left. Bodies never
    meet in a task for their address. See `read_streamed`.
    """

    def store(batch: DataFrame, batch_no: int) -> None:
        log = read_log(batch.sparkSession, folder, batch_no)
        resolved = resolved_requests(batch, trust)
        calls = calls_of(resolved).withColumn("ip", _hashed("ip", salt))
        verdicts = decide_moments(calls, max_requests, window, log).persist(StorageLevel.DISK_ONLY)
        try:
            refused = refused_requests(calls, verdicts).select(F.col("id").alias("batch_id"), "retry_after")
            write_collected(collect_resolved(resolved, refused, trust_client_country), f"{folder}/collected/batch_no={batch_no}")
            kept = accepted_log(calls, verdicts, log, window, lateness)
            kept.write.mode("overwrite").parquet(f"{folder}/log/{batch_no % 2}")
        finally:
            verdicts.unpersist()

    return requests.writeStream.foreachBatch(store)


def read_streamed(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """What `stream_collect` has left of one kind."""
    schema = T.StructType([*COLLECTED.fields, T.StructField("batch_no", T.LongType())])
    return collected_part(spark.read.schema(schema).parquet(f"{folder}/collected"), kind)
