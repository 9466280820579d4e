import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators import funnel as funnels
from footfall.operators.funnel import funnel
from footfall.period import ArgumentError


def run(tables, events, steps, since=None, until=None, **options):
    """Events are (session, type, time[, url]); plain text steps are event types."""
    made = []
    for number, (session, kind, time, *url) in enumerate(events):
        day = time if " " in time else f"2026-03-01 {time}"
        made.append(
            {"id": number, "session_id": session, "event_type": kind, "timestamp": day, "url": (url or [None])[0]}
        )
    steps = [s if isinstance(s, dict) else {"type": "custom", "value": s} for s in steps]
    result = funnel(tables.events(*made), steps, since, until, **options).orderBy("step_index").collect()
    return [r["count"] for r in result], [r["dropoff"] for r in result]


HOME = "https://example.com/"
VIEW = {"type": "pageview", "value": "/"}


@pytest.mark.parametrize(
    "events, steps, counts",
    [
        ([("s1", "a", "10:00"), ("s1", "b", "10:05"), ("s1", "c", "10:10")], ["a", "b", "c"], [1, 1, 1]),
        ([("s1", "checkout", "09:00"), ("s1", "landing", "10:00")], ["landing", "checkout"], [1, 0]),
        ([("s1", "a", "10:00"), ("s2", "b", "10:05")], ["a", "b"], [1, 0]),
        ([("s1", "a", "10:00"), ("s1", "a", "10:10"), ("s1", "b", "10:15")], ["a", "b"], [1, 1]),
        ([("s1", "pageview", "10:00", HOME), ("s1", "click", "10:00")], [VIEW, "click"], [1, 1]),
        ([("s1", "click", "10:00"), ("s1", "pageview", "10:00", HOME)], [VIEW, "click"], [1, 0]),
        ([("s1", "a", "10:00")], ["a", "a"], [1, 0]),
        ([("s1", "a", "10:00"), ("s1", "a", "23:00")], ["a", "a"], [1, 1]),
        ([(None, "a", "10:00"), ("", "a", "10:00")], ["a"], [0]),
        ([("s1", "a", "23:59"), ("s1", "b", "2026-03-02 00:01")], ["a", "b"], [1, 1]),
    ],
)
def test_cases(tables, events, steps, counts):
    assert run(tables, events, steps)[0] == counts


def test_wildcards_are_literal(tables):
    events = [
        ("s1", "pageview", "10:00", "https://example.com/normal-page"),
        ("s2", "pageview", "10:00", "https://example.com/promo%20special"),
    ]
    for value in ("%20", "%"):
        assert run(tables, events, [{"type": "pageview", "value": value}])[0] == [1]
    assert run(tables, events, [{"type": "pageview", "value": "_"}])[0] == [0]
    assert run(tables, events, [{"type": "pageview", "value": "PROMO"}])[0] == [0]
    assert run(tables, events, [{"type": "pageview", "value": "PROMO"}], ignore_case=True)[0] == [1]


def test_range(tables):
    events = [("s1", "a", "2026-01-10 10:00"), ("s1", "b", "2026-01-10 10:05")]
    assert run(tables, events, ["a", "b"], "2026-02-01T00:00:00.000Z", "2026-02-28T23:59:59.999Z")[0] == [0, 0]
    assert run(tables, events, ["a", "b"], "2026-01-01", "2026-01-31")[0] == [1, 1]
    # A bare date as upper bound is exclusive.
    assert run(tables, events, ["a", "b"], None, "2026-01-10")[0] == [0, 0]


def test_dropoff_and_labels(tables):
    events = [(f"s{i}", "a", "10:00") for i in range(8)] + [("s0", "b", "11:00")]
    assert run(tables, events, ["a", "b", "c"])[1] == [0, 88, 100]
    df = funnel(tables.events(), [{"value": "v", "label": "L"}, {"name": "n"}])
    assert [r.step for r in df.collect()] == ["L", "n"]
    assert funnel(tables.events(), []).count() == 0


@pytest.mark.parametrize(
    "steps, since, until, code",
    [
        (["x"], None, None, "INVALID_STEP"),
        ("invalid", None, None, "INVALID_STEPS"),
        ([{"value": " "}], None, None, "INVALID_STEP"),
        ([{"value": "v" * 257}], None, None, "INVALID_STEP"),
        ([{"value": "v"}], "not-a-valid-date", None, "INVALID_DATE"),
        ([{"value": "v"}], "2026-05-01", "2026-04-01", "INVALID_DATE_RANGE"),
    ],
)
def test_bad_arguments(tables, steps, since, until, code):
    with pytest.raises(ArgumentError) as error:
        funnel(tables.events(), steps, since, until)
    assert error.value.code == code


def brute_force(events, steps):
    """Scan each session in order, taking the next step at its first match."""
    reached = [0] * len(steps)
    ordered = sorted(events, key=lambda e: (e[0], e[2], events.index(e)))
    for _, session in itertools.groupby(ordered, key=lambda e: e[0]):
        done = 0
        for event in session:
            if done < len(steps) and event[1] == steps[done]:
                reached[done] += 1
                done += 1
    return reached


@pytest.mark.parametrize("slice_rows", [1, 7, 60, 100000])
def test_slices_do_not_change_the_answer(tables, monkeypatch, slice_rows):
    """One session holds a third of all events; slices of any size agree with a plain scan."""
    monkeypatch.setattr(funnels, "FAN", 3)
    rng = random.Random(7)
    events = []
    for number in range(600):
        session = "hot" if number % 3 == 0 else f"s{rng.randrange(40)}"
        time = f"2026-03-{rng.randrange(1, 4):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}"
        events.append((session, rng.choice("abcd"), time, f"u{number}"))
    for steps in (["a", "b"], ["a", "b", "a", "c"], ["d", "d", "d"], list("abcdabcd")):
        counts, _ = run(tables, events, steps, slice_rows=slice_rows)
        assert counts == brute_force(events, steps)


def test_a_burst_of_one_session_is_spread(spark, tables):
    """A third of all events are of one session, within a few seconds of one hour."""
    rng = random.Random(9)
    rows = []
    for number in range(900):
        hot = number % 3 == 0
        at = datetime(2026, 3, 1, 10, 0, 58) + timedelta(milliseconds=rng.randrange(4000) if hot else rng.randrange(10**8))
        rows.append({"id": number, "session_id": "hot" if hot else f"s{rng.randrange(200)}", "event_type": rng.choice("abc"), "timestamp": at})
    events = tables.events(*rows)
    slices = funnels.sliced(events, 20).where("session_id = 'hot'")
    sizes = [r["count"] for r in slices.groupBy("slice").count().collect()]
    assert sum(sizes) == 300 and len(sizes) >= 10 and max(sizes) <= 60
    # Later events are never in an earlier slice.
    ordered = [r.slice for r in slices.orderBy("timestamp").collect()]
    assert ordered == sorted(ordered)
    assert funnels.sliced(events, 20).where("session_id <> 'hot'").agg(F.max("slice")).first()[0] == 0
    steps = [{"value": v} for v in "abcab"]
    counts = [[r["count"] for r in funnel(events, steps, slice_rows=size).collect()] for size in (1, 20, 100_000)]
    plain = sorted(((r["session_id"], r["event_type"], r["timestamp"], r["id"]) for r in rows), key=lambda e: (e[0], e[2], e[3]))
    reached = [0] * 5
    for _, session in itertools.groupby(plain, key=lambda e: e[0]):
        done = 0
        for event in session:
            if done < 5 and event[1] == "abcab"[done]:
                reached[done] += 1
                done += 1
    assert counts == [reached] * 3
