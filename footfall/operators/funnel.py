"""Ordered session funnels."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.text import round_half_up
from footfall.operators.filters import (
    has_session,
    instant,
    is_pageview,
    literal_contains,
    prune_dates,
)
from footfall.period import ArgumentError, check_dates, is_date_only, parse_instant

STEP_MAX = 256
RESULT = "step_index int, step string, count bigint, dropoff bigint"


def check_steps(steps) -> list[dict[str, str | None]]:
    """Normalise funnel steps to type, value and label."""
    if not isinstance(steps, (list, tuple)):
        raise ArgumentError("a funnel takes a list of steps", "INVALID_STEPS")
    checked = []
    for step in steps:
        if not isinstance(step, Mapping):
            raise ArgumentError("a funnel step has type and value", "INVALID_STEP")
        texts = {k: v for k, v in step.items() if isinstance(v, str)}
        value = texts.get("value", texts.get("name"))
        if value is None or not value.strip() or len(value) > STEP_MAX:
            raise ArgumentError("a funnel step needs a value", "INVALID_STEP")
        label = texts.get("label") or value
        checked.append({"type": texts.get("type"), "value": value, "label": label})
    return checked


def step_predicate(step: Mapping, ignore_case: bool = False) -> Column:
    if step["type"] == "pageview":
        return is_pageview() & literal_contains(F.col("url"), step["value"], ignore_case)
    return F.col("event_type") == step["value"]


def filter_funnel_range(events: DataFrame, since=None, until=None) -> DataFrame:
    """Optional closed bounds; a bare date is its midnight, exclusive as an upper bound."""
    check_dates(since, until)
    start: datetime | None = parse_instant(since) if since else None
    end: datetime | None = parse_instant(until) if until else None
    ranged = prune_dates(events, start, end)
    if start is not None:
        ranged = ranged.where(F.col("timestamp") >= instant(start))
    if end is not None:
        at = F.col("timestamp")
        ranged = ranged.where(at < instant(end) if is_date_only(until) else at <= instant(end))
    return ranged


def first_match_per_session(events: DataFrame, step: Mapping, ignore_case: bool = False) -> DataFrame:
    """Each session's earliest event for one step, by (timestamp, id)."""
    [checked] = check_steps([step])
    matched = events.where(has_session() & step_predicate(checked, ignore_case))
    return (
        matched.groupBy("session_id")
        .agg(F.min(F.struct("timestamp", "id")).alias("at"))
        .select("session_id", "at.timestamp", "at.id")
    )


# Matching events of a session that one task looks at, and slices whose transitions are put together at a time.
SLICE_ROWS = 100_000
FAN = 256

_MINUTE = (
    "CAST(datediff(timestamp, DATE'1970-01-01') AS BIGINT) * 1440 + hour(timestamp) * 60 + minute(timestamp)"
)
_SECOND = "second(timestamp)"
_MILLISECOND = "CAST(extract(SECOND FROM timestamp) * 1000 AS BIGINT) % 1000"


def sliced(matched: DataFrame, slice_rows: int) -> DataFrame:
    """Adds ``slice``, numbers in order of time, to matching events: 0 but in sessions of more than ``slice_rows``.

    Of these, events are counted by second; running totals over a session's minutes and a minute's seconds give
    each second its slice, and a second with more than a slice's events is divided by milliseconds. Few
    sessions are that large, so what is counted and joined back is small beside the events; without any, it
    falls away at run time.
    """
    large = matched.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") > slice_rows).select("session_id")
    timed = matched.withColumns({"_minute": F.expr(_MINUTE), "_second": F.expr(_SECOND)})
    seconds = timed.select("session_id", "_minute", "_second").join(large, "session_id", "left_semi")
    seconds = seconds.groupBy("session_id", "_minute", "_second").agg(F.count("*").alias("n"))

    def before(*within: str, by: str) -> Column:
        earlier = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(earlier), F.lit(0))

    minutes = seconds.groupBy("session_id", "_minute").agg(F.sum("n").alias("n"))
    minutes = minutes.select(
        F.col("session_id").alias("_session"), F.col("_minute").alias("_of"), before("session_id", by="_minute").alias("_base")
    )
    # An event without a time comes first, as everywhere.
    same_minute = (F.col("session_id") == F.col("_session")) & F.col("_minute").eqNullSafe(F.col("_of"))
    counted = seconds.withColumn("_before", before("session_id", "_minute", by="_second"))
    places = counted.join(minutes, same_minute).select(
        "_session",
        "_of",
        F.col("_second").alias("_of_second"),
        F.floor((F.col("_base") + F.col("_before")) / slice_rows).alias("_first"),
        F.ceil(F.col("n") / slice_rows).alias("_parts"),
    )
    within = F.floor(F.expr(_MILLISECOND) * F.col("_parts") / 1000)
    found = timed.join(places, same_minute & F.col("_second").eqNullSafe(F.col("_of_second")), "left")
    slice_ = F.coalesce(F.col("_first") + F.coalesce(within, F.lit(0)), F.lit(0))
    return found.withColumn("slice", slice_).select(*matched.columns, "slice")


def _composed(ordered: str, count: int) -> Column:
    """Transitions one after the other: for every number of steps done before, how many are done after all of them."""
    return F.aggregate(
        ordered,
        F.array(*[F.lit(i) for i in range(count)]),
        lambda done, one: F.transform(done, lambda d: F.when(d < count, F.get(one["moves"], d)).otherwise(d)),
    )


def funnel(
    events: DataFrame,
    steps: list[Mapping],
    since=None,
    until=None,
    *,
    ignore_case: bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Sessions that reach each step in order, and the drop from the step before.

    Step i takes the earliest matching event strictly after the one taken for step i-1, in
    (timestamp, id) order. Large sessions are cut into slices of about ``slice_rows`` matching events: for
    every number of steps done on entering, a slice says how many are done on leaving. Such transitions
    compose to one of the same kind, first ``FAN`` slices at a time and then those of a session, so a session
    with a large share of all events, even within a minute, spreads over as many tasks as it has slices, and no
    list of its slices is longer than ``FAN`` or its events by ``FAN * slice_rows``. The answer does not
    depend on the cut.
    """
    checked = check_steps(steps)
    ranged = filter_funnel_range(events, since, until)
    if not checked:
        return events.sparkSession.createDataFrame([], RESULT)
    count = len(checked)

    flags = [step_predicate(s, ignore_case) for s in checked]
    wanted_rows = ranged.where(has_session() & reduce(lambda a, b: a | b, flags))
    matched = sliced(wanted_rows, slice_rows).select(
        "session_id",
        "slice",
        F.struct("timestamp", "id").alias("at"),
        *[flag.alias(f"is_{i}") for i, flag in enumerate(flags)],
    )

    # taken_s_k: where step k is taken in this slice when s steps were done on entering.
    within = Window.partitionBy("session_id", "slice")
    chained = matched
    for depth in range(count):
        taken = {}
        for entered in range(count - depth):
            k = entered + depth
            wanted = F.col(f"is_{k}")
            if depth:
                wanted = wanted & (F.col("at") > F.col(f"taken_{entered}_{k - 1}"))
            taken[f"taken_{entered}_{k}"] = F.min(F.when(wanted, F.col("at"))).over(within)
        chained = chained.withColumns(taken)

    def done_on_leaving(entered: int) -> Column:
        done = F.lit(entered)
        for k in range(entered, count):
            done = done + F.when(F.col(f"taken_{entered}_{k}").isNotNull(), 1).otherwise(0)
        return done

    leaving = [done_on_leaving(entered).alias(f"from_{entered}") for entered in range(count)]
    slices = (
        chained.select("session_id", "slice", *leaving)
        .groupBy("session_id", "slice")
        .agg(*[F.max(f"from_{entered}").alias(f"from_{entered}") for entered in range(count)])
    )
    moves = F.array(*[F.col(f"from_{entered}") for entered in range(count)]).alias("moves")
    parts = slices.select("session_id", F.col("slice").alias("part"), moves)
    for together in (F.floor(F.col("part") / FAN), F.lit(0)):
        grouped = parts.groupBy("session_id", together.alias("whole")).agg(F.array_sort(F.collect_list(F.struct("part", "moves"))).alias("ordered"))
        parts = grouped.select("session_id", F.col("whole").alias("part"), _composed("ordered", count).alias("moves"))
    per_session = parts.select(F.get("moves", F.lit(0)).alias("reached"))
    totals = per_session.agg(
        *[F.count_if(F.col("reached") > i).alias(f"c_{i}") for i in range(count)]
    )
    return _with_dropoff(totals, [s["label"] for s in checked])


def _with_dropoff(totals: DataFrame, labels: list[str]) -> DataFrame:
    """One row of step counts to one row per step with its percentage lost."""
    rows = [
        F.struct(
            F.lit(i).alias("step_index"),
            F.lit(label).alias("step"),
            F.col(f"c_{i}").alias("count"),
            (F.col(f"c_{i - 1}") if i else F.lit(0).cast("bigint")).alias("before"),
        )
        for i, label in enumerate(labels)
    ]
    lost = round_half_up((1 - F.col("count") / F.greatest("before", F.lit(1))) * 100)
    return totals.select(F.inline(F.array(*rows))).select(
        "step_index",
        "step",
        "count",
        F.when(F.col("before") > 0, lost).otherwise(F.lit(0)).cast("bigint").alias("dropoff"),
    )
