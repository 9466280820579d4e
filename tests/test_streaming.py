import random
from datetime import datetime, timedelta

import pytest

from footfall.operators import ingest
from footfall.operators.enrich import enrich_events
from footfall.operators.state import build_sessions, build_users
from footfall.sources import entities
from footfall.streaming import ingest as stream_in
from footfall.streaming import live

START = datetime(2026, 3, 1)


def some_events(tables, count=400):
    rng = random.Random(11)
    made = []
    for number in range(count):
        # A third of all events belong to one session and one user.
        hot = number % 3 == 0
        made.append(
            {
                "id": number,
                "event_type": rng.choice(["pageview", "click"]),
                "session_id": "hot" if hot else rng.choice(["", "a", "b", f"s{number}"]),
                "user_id": "hot" if hot else rng.choice([None, "u", "v"]),
                "url": f"/{number % 7}",
                "timestamp": START + timedelta(seconds=number * 37),
            }
        )
    return tables.events(*made)


def as_stream(spark, df, folder, parts=4):
    """The same rows as a file stream of several micro-batches, in order of id."""
    size = df.count() // parts + 1
    for part in range(parts):
        piece = df.where(f"id >= {part * size} AND id < {(part + 1) * size}")
        piece.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(writer, tmp_path):
    writer = writer.option("checkpointLocation", str(tmp_path / "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()


def same(left, right):
    order = left.columns
    return sorted(map(repr, left.collect())) == sorted(map(repr, right.select(*order).collect()))


@pytest.mark.parametrize(
    "stream, read, build",
    [
        (stream_in.stream_sessions, stream_in.read_sessions, build_sessions),
        (stream_in.stream_users, stream_in.read_users, build_users),
    ],
)
def test_entities(spark, tables, tmp_path, stream, read, build):
    events = some_events(tables)
    folder = str(tmp_path / "table")
    finish(stream(as_stream(spark, events, str(tmp_path / "in")), folder), tmp_path)
    assert same(read(spark, folder), build(events))
    # A micro-batch that runs again changes nothing.
    name = "sessions" if build is build_sessions else "users"
    entities.merge_entities(events.where("id < 101"), folder, name, 0)
    assert same(read(spark, folder), build(events))


def test_active_now(spark, tables, tmp_path):
    events = some_events(tables)
    active = live.stream_active_now(as_stream(spark, events, str(tmp_path / "in")))
    sink = str(tmp_path / "out")
    finish(active.writeStream.format("parquet").option("path", sink).outputMode("append"), tmp_path)
    found = {r.as_of: r.active for r in spark.read.parquet(sink).collect()}
    rows = [(r.session_id, r.timestamp) for r in events.collect() if r.session_id]
    last = max(t for _, t in rows) - timedelta(minutes=1)
    expected = {}
    mark = START + timedelta(minutes=1)
    while mark <= last:
        seen = {s for s, t in rows if mark - timedelta(minutes=5) <= t < mark}
        if seen:
            expected[mark] = len(seen)
        mark += timedelta(minutes=1)
    assert found == expected


def test_daily_views(spark, tables, tmp_path):
    events = some_events(tables, 5000)
    views = live.stream_daily_views(as_stream(spark, events, str(tmp_path / "in")))
    folder = str(tmp_path / "out")
    finish(live.store_updates(views, folder), tmp_path)
    expected = {}
    for row in events.where("event_type = 'pageview'").collect():
        day = row.timestamp.date().isoformat()
        expected[day] = expected.get(day, 0) + 1
    assert dict(map(tuple, live.read_latest(spark, folder, "date", "views").collect())) == expected


def test_ingest(spark, tmp_path):
    bodies = ['[{"event_type":"a"},{"event_type":""}]', "{bad", '{"event_type":"b","user_id":"u"}', "[]"]
    schema = (
        "batch_id long, body string, client_ip string, user_agent string, server_country string, "
        "received_at timestamp_ntz, id long"
    )
    payloads = spark.createDataFrame(
        [(n, body, "203.0.113.9", "Firefox", "FR", START, n) for n, body in enumerate(bodies)], schema
    )
    folder = str(tmp_path / "store")
    finish(stream_in.stream_ingest(as_stream(spark, payloads, str(tmp_path / "in")).drop("id"), folder), tmp_path)
    expected = enrich_events(ingest.valid_events(ingest.validate_events(ingest.parse_payloads(payloads.drop("id")))))
    stored = stream_in.read_ingested(spark, folder)
    assert same(expected, stored) and stored.count() == 2
    quarantined = spark.read.parquet(f"{folder}/quarantine").drop("batch_no")
    assert sorted((r.batch_id, r.error_code) for r in quarantined.collect()) == [
        (0, "MISSING_EVENT_TYPE"),
        (1, "BAD_REQUEST"),
        (3, "EMPTY_BATCH"),
    ]
    # Raw addresses are stored nowhere.
    assert [r.ip for r in stored.collect()] == ["203.0.113.0"] * 2


def test_bodies_of_one_file_are_parsed_by_several_tasks(spark, tmp_path, monkeypatch):
    """A micro-batch that is one file, of one row group; its events go to few files a date."""
    rng = random.Random(5)
    schema = (
        "batch_id long, body string, client_ip string, user_agent string, server_country string, "
        "received_at timestamp_ntz"
    )
    rows = [
        (n, f'[{{"event_type":"{rng.randbytes(800).hex()[:100]}","url":"{rng.randbytes(2000).hex()}"}}]', None, None, None, START + timedelta(days=n % 2))
        for n in range(400)
    ]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    holders, parse = [], ingest.parse_payloads

    def spied(batch):
        holders.append(sum(size > 0 for size in batch.rdd.glom().map(len).collect()))
        return parse(batch)

    monkeypatch.setattr(stream_in, "parse_payloads", spied)
    folder = str(tmp_path / "store")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    finish(stream_in.stream_ingest(stream, folder), tmp_path)
    assert len(holders) == 1 and holders[0] > 1
    stored = stream_in.read_ingested(spark, folder)
    assert stored.count() == 400 and len(stored.inputFiles()) <= 4
