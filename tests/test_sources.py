from datetime import datetime

import pytest

from footfall.model import EVENTS
from footfall.operators.enrich import append_events
from footfall.operators.overview import daily_views
from footfall.period import ArgumentError, date_range
from footfall.sources.tables import read_payload_files, read_table


def test_formats(spark, tables, tmp_path):
    events = tables.events({"event_type": "pageview", "timestamp": "2026-03-01 10:00:00.123", "url": "/a"})
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        events.write.format(fmt).save(path)
        [row] = read_table(spark, path, fmt, EVENTS).collect()
        assert (row.event_type, row.timestamp, row.url) == ("pageview", datetime(2026, 3, 1, 10, 0, 0, 123000), "/a")
    with pytest.raises(ArgumentError):
        read_table(spark, "x", "mongodb")


def test_text_timestamps_and_missing_columns(spark):
    spark.createDataFrame([(1, "pageview", "2026-03-01T10:00:00.123Z")], "id long, event_type string, timestamp string").createOrReplaceTempView("legacy")
    [row] = read_table(spark, "legacy", "table", EVENTS).collect()
    assert row.timestamp == datetime(2026, 3, 1, 10, 0, 0, 123000) and row.utm_source is None


def test_payload_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('[{"event_type":\n"a"}]')
    [row] = read_payload_files(spark, str(tmp_path)).collect()
    assert row.body == '[{"event_type":\n"a"}]' and row.path.endswith("one.json")


def test_periods_prune_partitions(spark, tables, tmp_path):
    path = str(tmp_path / "events")
    days = [f"2026-03-{d:02d}" for d in range(1, 11)]
    append_events(tables.events(*[{"event_type": "pageview", "timestamp": d} for d in days]), path)
    stored = read_table(spark, path, "parquet", EVENTS)
    views = daily_views(stored, date_range("2026-03-04", "2026-03-05", as_of=datetime(2026, 4, 1)))
    assert [tuple(r) for r in views.collect()] == [("2026-03-04", 1), ("2026-03-05", 1)]
    plan = views._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in filters and "2026-03-04" in filters
