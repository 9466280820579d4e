import os
from datetime import datetime, timedelta

import pytest

from footfall.operators.retention import Retention, prune_events, prune_metrics, prune_sessions, prune_users, retention_rollup
from footfall.operators.state import build_users
from footfall.period import ArgumentError
from footfall.sources import entities, store

NOW = datetime(2026, 3, 1, 12)


def ago(days):
    return NOW - timedelta(days=days)


def after(tables, events=(), sessions=(), users=(), metrics=(), **config):
    return retention_rollup(
        tables.events(*events),
        tables.sessions(*sessions),
        tables.users(*users),
        tables.metrics(*metrics),
        as_of=NOW,
        retention=Retention(**config),
    )


def metric_values(df):
    return {(r["date"], r["metric"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("config", [{"keep_raw_days": -1}, {"keep_rollup_days": "one-year"}, {"keep_raw_days": float("nan")}])
def test_bad_config(config):
    with pytest.raises(ArgumentError):
        Retention(**config)


def test_rolls_up_and_prunes(tables):
    events = [
        {"event_type": "pageview", "timestamp": ago(40)},
        {"event_type": "pageview", "timestamp": ago(40)},
        {"event_type": "click", "timestamp": ago(40)},
        {"event_type": "click", "timestamp": ago(2)},
    ]
    stored = [{"date": ago(40).date().isoformat(), "metric": "click", "value": 5}]
    result = after(tables, events, metrics=stored)
    assert result["events"].count() == 1
    day = ago(40).date().isoformat()
    assert metric_values(result["metrics"]) == {(day, "pageviews"): 2, (day, "click"): 6}


def test_switched_off(tables):
    result = after(tables, [{"event_type": "pageview", "timestamp": ago(40)}], auto_rollup=False)
    assert result["events"].count() == 1
    assert result["metrics"].count() == 0


def test_sessions_and_users(tables):
    sessions = [{"id": "old", "last_seen_at": ago(45)}, {"id": "new", "last_seen_at": ago(2)}]
    users = [
        {"id": "gone", "first_seen": ago(90), "last_seen": ago(45)},
        {"id": "recent", "first_seen": ago(90), "last_seen": ago(2)},
        {"id": "kept", "first_seen": ago(90), "last_seen": ago(45)},
    ]
    events = [
        {"user_id": "kept", "timestamp": ago(2)},
        {"user_id": "gone", "timestamp": ago(45)},
        {"user_id": None, "timestamp": ago(2)},
    ]
    result = after(tables, events, sessions, users)
    assert [r.id for r in result["sessions"].collect()] == ["new"]
    assert sorted(r.id for r in result["users"].collect()) == ["kept", "recent"]


def test_metrics_lose_the_cutoff_day_itself(tables):
    metrics = tables.metrics(*[{"date": d, "metric": "m"} for d in ("2025-02-28", "2025-03-01", "2025-03-02")])
    kept = prune_metrics(metrics, datetime(2025, 3, 1, 12))
    assert [r["date"] for r in kept.collect()] == ["2025-03-02"]


@pytest.fixture
def root(tmp_path, tables):
    root = str(tmp_path / "store")
    events = tables.events(
        {"event_type": "pageview", "session_id": "a", "user_id": "u", "timestamp": ago(40)},
        {"event_type": "pageview", "session_id": "a", "user_id": "u", "timestamp": ago(40)},
        {"event_type": "click", "session_id": "a", "user_id": "u", "timestamp": ago(40)},
        {"event_type": "click", "session_id": "b", "user_id": "v", "timestamp": ago(1)},
    )
    store.append_batch(events, root, "first")
    store.fold_events(events, root)
    return root


def ids(spark, root):
    return sorted(r.id for r in store.read_events(spark, root).collect())


def test_stored_rollup_is_idempotent(spark, root):
    expected = {(ago(40).date().isoformat(), "pageviews"): 2, (ago(40).date().isoformat(), "click"): 1}
    for _ in range(2):
        store.roll_up(spark, root, NOW)
        assert metric_values(store.read_metrics(spark, root)) == expected
        assert ids(spark, root) == [3]
        assert [r.id for r in store.read_table(spark, root, "sessions").collect()] == ["b"]
        assert [r.id for r in store.read_table(spark, root, "users").collect()] == ["v"]
    assert [(r.batch_no, r.event_date) for r in store.rolled_up(spark, root).collect()] == [("first", ago(40).date())]


def test_late_events_stay_visible_until_rolled_up(spark, root, tables):
    store.roll_up(spark, root, NOW)
    late = tables.events({"id": 9, "event_type": "click", "session_id": "z", "timestamp": ago(40)})
    for _ in range(2):  # an append that is repeated replaces itself
        store.append_batch(late, root, "late")
        store.fold_events(store.read_events(spark, root), root)
        assert ids(spark, root) == [3, 9]
    store.roll_up(spark, root, NOW)
    assert ids(spark, root) == [3]
    assert metric_values(store.read_metrics(spark, root))[ago(40).date().isoformat(), "click"] == 2


def test_an_append_during_a_rollup_is_neither_lost_nor_counted_twice(spark, root, tables, monkeypatch):
    publish = store._publish

    def append_first(*args):
        store.append_batch(tables.events({"id": 9, "event_type": "click", "timestamp": ago(40)}), root, "late")
        publish(*args)

    monkeypatch.setattr(store, "_publish", append_first)
    store.roll_up(spark, root, NOW)
    monkeypatch.undo()
    day = ago(40).date().isoformat()
    assert metric_values(store.read_metrics(spark, root))[day, "click"] == 1
    assert ids(spark, root) == [3, 9]
    store.roll_up(spark, root, NOW)
    assert metric_values(store.read_metrics(spark, root))[day, "click"] == 2
    assert ids(spark, root) == [3]


def test_events_without_a_time_are_never_pruned(spark, root, tables):
    store.append_batch(tables.events({"id": 8, "event_type": "click", "timestamp": None}), root, "untimed")
    for _ in range(2):
        store.roll_up(spark, root, NOW)
        assert ids(spark, root) == [3, 8]


def test_failed_rollup_changes_nothing(spark, root, monkeypatch):
    def fail(*_):
        raise OSError("disk full")

    monkeypatch.setattr(store, "_publish", fail)
    with pytest.raises(OSError):
        store.roll_up(spark, root, NOW)
    monkeypatch.undo()
    assert ids(spark, root) == [0, 1, 2, 3] and store.read_metrics(spark, root).count() == 0
    assert store.read_table(spark, root, "sessions").count() == 2
    store.roll_up(spark, root, NOW)
    assert ids(spark, root) == [3] and sum(metric_values(store.read_metrics(spark, root)).values()) == 3


def test_old_counts_are_dropped(spark, root):
    store.roll_up(spark, root, NOW, Retention(keep_raw_days=30, keep_rollup_days=35))
    assert store.read_metrics(spark, root).count() == 0 and ids(spark, root) == [3]


def test_streamed_events_are_rolled_up_where_they_are(spark, tmp_path, tables):
    root = str(tmp_path / "stream")
    for number, rows in enumerate([({"id": 1, "timestamp": ago(1)}, {"id": 2, "timestamp": ago(40)}), ({"id": 3, "timestamp": ago(1)},)]):
        dated = tables.events(*rows).selectExpr("*", "CAST(timestamp AS DATE) AS event_date")
        dated.write.partitionBy("event_date").parquet(f"{root}/events/batch_no={number}")
    assert ids(spark, root) == [1, 2, 3]
    store.roll_up(spark, root, NOW)
    assert ids(spark, root) == [1, 3]


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path, tables):
    folder = str(tmp_path / "sessions")
    first = tables.events(*[{"session_id": f"s{n}", "url": "/first", "timestamp": ago(5)} for n in range(200)])
    entities.merge_entities(first, folder, "sessions", buckets=16)
    before = files(folder)
    second = tables.events({"id": 900, "session_id": "s7", "url": "/second", "timestamp": ago(1)}, {"id": 901, "session_id": "new", "timestamp": ago(1)})
    entities.merge_entities(second, folder, "sessions", buckets=16)
    after = files(folder)
    changed = {os.path.basename(os.path.dirname(f)) for f, _ in set(before.items()) ^ set(after.items())}
    keys = spark.createDataFrame([("s7",), ("new",)], "id string").select(entities._bucket(16)).collect()
    assert changed == {f"bucket={r.bucket}" for r in keys}
    found = {r.id: (r.landing_page, r.last_seen_at) for r in entities.read_entities(spark, folder, "sessions").collect()}
    assert len(found) == 201 and found["s7"] == ("/first", ago(1)) and found["s8"] == ("/first", ago(5))
    plan = entities.read_entities(spark, folder, "sessions")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_a_repeated_micro_batch_completes_what_is_missing(spark, tmp_path, tables, monkeypatch):
    folder = str(tmp_path / "users")
    events = [tables.events(*[{"id": 100 * b + n, "user_id": f"u{n}", "timestamp": ago(9 - b)} for n in range(40)]) for b in range(2)]
    entities.merge_entities(events[0], folder, "users", 0, 8)
    # The second micro-batch reaches half of the buckets, then fails.
    overwrite = entities._overwrite
    monkeypatch.setattr(entities, "_overwrite", lambda rows, path: overwrite(rows.where("bucket < 4"), path))
    entities.merge_entities(events[1], folder, "users", 1, 8)
    monkeypatch.undo()
    before = files(folder)
    entities.merge_entities(events[1], folder, "users", 1, 8)
    after = files(folder)
    assert {f for f in before if "bucket=0" in f or "bucket=3" in f} <= set(after)
    expected = build_users(events[0].unionByName(events[1]))
    assert sorted(entities.read_entities(spark, folder, "users").collect()) == sorted(expected.collect())
    entities.merge_entities(events[1], folder, "users", 1, 8)
    assert files(folder) == after  # nothing is written any more


def test_emptied_buckets_stay_empty(spark, tmp_path, tables):
    folder = str(tmp_path / "sessions")
    entities.merge_entities(tables.events({"session_id": "old", "timestamp": ago(40)}), folder, "sessions")
    for _ in range(2):
        entities.prune_entities(spark, folder, "sessions", lambda rows: prune_sessions(rows, ago(30)))
        assert entities.read_entities(spark, folder, "sessions").count() == 0
    entities.merge_entities(tables.events({"id": 5, "session_id": "old", "url": "/again", "timestamp": ago(1)}), folder, "sessions")
    assert [r.landing_page for r in entities.read_entities(spark, folder, "sessions").collect()] == ["/again"]


def test_prunings_keep_rows_without_a_time(tables):
    cut = datetime(2025, 3, 1)
    assert prune_events(tables.events({"timestamp": None}, {"timestamp": ago(9_999)}), cut).count() == 1
    assert prune_sessions(tables.sessions({"id": "a"}, {"id": "b", "last_seen_at": ago(9_999)}), cut).count() == 1
    users = tables.users({"id": "a"}, {"id": "b", "last_seen": ago(9_999)})
    assert [r.id for r in prune_users(users, tables.events(), cut).collect()] == ["a"]
