import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from footfall import get_spark  # noqa: E402
from footfall.model import EVENTS, METRICS, SESSIONS, USERS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "footfall-tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def tables(spark):
    """Builders of model tables from dicts; absent columns are NULL."""

    def build(schema, defaults):
        def make(*rows):
            filled = [{**dict.fromkeys(schema.names), **defaults, **row} for row in rows]
            for number, row in enumerate(filled):
                if "id" in schema.names and row["id"] is None:
                    row["id"] = number
            values = [
                tuple(
                    datetime.fromisoformat(r[n]) if isinstance(r[n], str) and n in times else r[n]
                    for n in schema.names
                )
                for r in filled
            ]
            return spark.createDataFrame(values, schema)

        times = {f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"}
        return make

    class Tables:
        events = staticmethod(build(EVENTS, {"event_type": "test_event", "properties": "{}"}))
        sessions = staticmethod(build(SESSIONS, {"is_active": 1}))
        users = staticmethod(build(USERS, {"properties": "{}"}))
        metrics = staticmethod(build(METRICS, {"dimension": "", "value": 0}))

    return Tables


def rows(df):
    return [tuple(r) for r in df.collect()]
