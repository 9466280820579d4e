"""Request rates: a sliding log for each address, decided by built-ins wherever no request can be refused."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.text import epoch_micros

RATE_MAX = 100
RATE_WINDOW = timedelta(seconds=60)

# An address's time is cut into stretches of so many windows, which are looked at apart.
STRETCH = 8

# Arrivals of a stretch come after what leaves the window at the same time, and after what an earlier stretch left in it.
_LEFT_OVER, _LEAVES, _ARRIVES = 0, 1, 2
_FOLDED = pa.schema([("ip", pa.string()), ("ms", pa.int64()), ("taken", pa.int64()), ("wait", pa.int64())])


def window_ms(window: timedelta) -> int:
    return int(window / timedelta(milliseconds=1))


def _timed(requests: DataFrame) -> DataFrame:
    return requests.withColumns(
        {
            "_address": F.coalesce(F.col("ip"), F.lit("")),
            "_ms": F.floor(epoch_micros("CAST(ts AS TIMESTAMP_NTZ)") / 1000),
        }
    )


def _moments(requests: DataFrame, log: DataFrame | None) -> DataFrame:
    """``ip``, ``ms``, ``requests`` to decide on and ``given``, those accepted before; combined before the shuffle."""
    rows = _timed(requests).select(
        F.col("_address").alias("ip"), F.col("_ms").alias("ms"), F.lit(1).cast("long").alias("requests"), F.lit(0).cast("long").alias("given")
    )
    if log is not None:
        rows = rows.unionByName(log.select("ip", "ms", F.lit(0).cast("long").alias("requests"), F.col("accepted").alias("given")))
    return rows.groupBy("ip", "ms").agg(F.sum("requests").alias("requests"), F.sum("given").alias("given"))


def crowded_pieces(moments: DataFrame, limit: int, window: int) -> DataFrame:
    """The moments on whose order anything depends, each with the ``piece`` it has to be folded in.

    A moment is crowded if its window holds more than ``limit`` requests, whether accepted or not; all others
    are accepted. How full a window is follows from a running sum in which every request counts when it
    arrives and is taken off when it leaves. The sum is taken in stretches of ``STRETCH`` windows, so that an
    address with a large share of all requests is spread over its stretches; what an earlier stretch leaves
    in the window is added at the start.

    A stretch without crowded moments needs no fold. One that has some starts a piece of its own unless a
    moment in the last window of the stretch before is crowded: otherwise all requests left over from that
    one were accepted, so the log at the start is known. Chains of stretches without such a point are one
    piece. ``given`` of a piece's left-over moments are those accepted requests.
    """
    width = STRETCH * window
    total = F.col("requests") + F.col("given")
    here, after = (F.floor(x / width) for x in (F.col("ms"), F.col("ms") + window))

    def row(stretch: Column, at: Column, turn: int, change: Column, requests: Column, given: Column) -> Column:
        named = {"stretch": stretch, "at": at, "turn": F.lit(turn), "change": change, "requests": requests, "given": given}
        return F.struct(*[c.alias(n) for n, c in named.items()])

    none = F.lit(0).cast("long")
    tagged = moments.select(
        "ip",
        F.inline(
            F.array_compact(
                F.array(
                    row(here, F.col("ms"), _ARRIVES, total, F.col("requests"), F.col("given")),
                    row(after, F.col("ms") + window, _LEAVES, -total, none, none),
                    F.when(after != here, row(after, F.col("ms"), _LEFT_OVER, total, none, total)),
                )
            )
        ),
    )
    # One exchange and one sort serve the running sum and the two looks at the whole stretch.
    stretch = Window.partitionBy("ip", "stretch")
    in_order = stretch.orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    crowded = (F.col("turn") == _ARRIVES) & (F.col("requests") > 0) & (F.col("level") > limit)
    reaches = F.col("crowded") & (F.col("at") + window >= (F.col("stretch") + 1) * width)
    marked = (
        tagged.withColumn("level", F.sum("change").over(in_order))
        .withColumn("crowded", crowded)
        .withColumns({"any": F.max("crowded").over(stretch), "reaches": F.max(reaches).over(stretch)})
        .where(F.col("any") & (F.col("turn") != _LEAVES))
    )
    spans = marked.groupBy("ip", "stretch").agg(F.max("reaches").alias("reaches"))
    before = Window.partitionBy("ip").orderBy("stretch")
    follows = (F.lag("stretch").over(before) == F.col("stretch") - 1) & F.lag("reaches").over(before)
    pieces = (
        spans.withColumn("starts", ~F.coalesce(follows, F.lit(False)))
        .withColumn("piece", F.max(F.when(F.col("starts"), F.col("stretch"))).over(before))
        .select("ip", "stretch", "piece")
    )
    joined = marked.select("ip", "stretch", "at", "turn", "requests", "given").join(pieces, ["ip", "stretch"])
    return joined.where((F.col("turn") == _ARRIVES) | (F.col("stretch") == F.col("piece"))).select(
        "ip", "piece", F.col("at").alias("ms"), "turn", "requests", "given"
    )


def _fold_pieces(limit: int, window: int):
    """Sliding log over moments sorted by address, piece and time.

    Carries one piece's accepted requests of the last window, so memory is bounded by ``limit`` however many
    rows a piece has. Gives back the moments of which something is refused.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, log, inside = None, deque(), 0
        for batch in batches:
            refused = []
            for ip, piece, now, requests, given in zip(*(batch.column(c).to_pylist() for c in ("ip", "piece", "ms", "requests", "given"))):
                if (ip, piece) != owner:
                    owner, log, inside = (ip, piece), deque(), 0
                while log and log[0][0] <= now - window:
                    inside -= log.popleft()[1]
                taken = min(requests, max(0, limit - inside - given))
                if taken + given:
                    log.append((now, taken + given))
                    inside += taken + given
                if taken < requests:
                    # Refused requests wait until the oldest accepted one leaves the window.
                    wait = -((now - window - log[0][0]) // 1000) if log else 0
                    refused.append((ip, now, taken, max(1, wait)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*refused)) or [[]] * 4, _FOLDED)], schema=_FOLDED)

    return fold


def decide_moments(
    requests: DataFrame, max_requests: int = RATE_MAX, window: timedelta = RATE_WINDOW, log: DataFrame | None = None
) -> DataFrame:
    """``ip``, ``ms`` and how many of its ``requests`` are ``taken``, of the moments of which some are refused; ``wait`` in seconds.

    ``log`` (``ip``, ``ms``, ``accepted``) holds requests that were accepted before and count, wherever in time they lie.
    """
    spark, length = requests.sparkSession, window_ms(window)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        crowded_pieces(_moments(requests, log), max_requests, length)
        .repartition(tasks, "ip", "piece")
        .sortWithinPartitions("ip", "piece", "ms", "turn")
        .mapInArrow(_fold_pieces(max_requests, length), "ip string, ms long, taken long, wait long")
    )


def rate_limit(requests: DataFrame, max_requests: int = RATE_MAX, window: timedelta = RATE_WINDOW) -> DataFrame:
    """Adds ``limited`` and ``retry_after`` (seconds) to requests [ip, ts, id].

    A request passes when fewer than ``max_requests`` accepted ones of its address lie in the window before
    it; refused ones do not count. Requests of one millisecond come in order of their id. The decision depends
    on all earlier ones of the address, but only back to a point at which the log is known: see
    `crowded_pieces`. Addresses that stay within the limit are never folded. Verdicts go back to the requests
    of the moments they are for, spread over (address, millisecond).
    """
    return flag_requests(requests, decide_moments(requests, max_requests, window))


def flag_requests(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All requests, those of ``verdicts`` beyond what was taken ``limited``."""
    found = verdicts.select(F.col("ip").alias("_address"), F.col("ms").alias("_ms"), "taken", "wait")
    in_moment = Window.partitionBy("_address", "_ms").orderBy("id")
    limited = F.coalesce(F.row_number().over(in_moment) > F.col("taken"), F.lit(False))
    return (
        _timed(requests)
        .join(found, ["_address", "_ms"], "left")
        .withColumn("limited", limited)
        .select(*requests.columns, "limited", F.when(F.col("limited"), F.col("wait")).otherwise(F.lit(0)).alias("retry_after"))
    )


def refused_requests(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Only the refused requests, with ``retry_after``; moments of which nothing is refused are not touched."""
    found = verdicts.select(F.col("ip").alias("_address"), F.col("ms").alias("_ms"), "taken", "wait")
    in_moment = Window.partitionBy("_address", "_ms").orderBy("id")
    return (
        _timed(requests)
        .join(found, ["_address", "_ms"])
        .withColumn("_place", F.row_number().over(in_moment))
        .where("_place > taken")
        .select(*requests.columns, F.col("wait").alias("retry_after"))
    )


def accepted_log(requests: DataFrame, verdicts: DataFrame, log: DataFrame | None, window: timedelta, lateness: timedelta) -> DataFrame:
    """The log to carry on: ``ip``, ``ms``, ``accepted`` of all accepted requests that a later one may still meet.

    That is back to a window and ``lateness`` before the newest request; addresses silent since then are forgotten.
    """
    found = verdicts.select("ip", "ms", "taken")
    moments = _moments(requests, log).join(found, ["ip", "ms"], "left")
    accepted = moments.select("ip", "ms", (F.coalesce("taken", "requests") + F.col("given")).alias("accepted")).where("accepted > 0")
    newest = accepted.agg(F.max("ms").alias("newest"))
    kept = accepted.join(F.broadcast(newest), F.col("ms") > F.col("newest") - window_ms(window) - window_ms(lateness))  # one row
    return kept.select("ip", "ms", "accepted")
