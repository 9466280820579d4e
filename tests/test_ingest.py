import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from footfall.functions.properties import may_overflow, shallow
from footfall.operators import ingest
from footfall.operators.enrich import enrich_events, refused_calls, track_events


def codes(spark, *bodies):
    """Error codes per body, in event order."""
    payloads = spark.createDataFrame(list(enumerate(bodies)), "batch_id long, body string")
    checked = ingest.validate_events(ingest.parse_payloads(payloads)).collect()
    found = [[] for _ in bodies]
    for row in sorted(checked, key=lambda r: (r.batch_id, r.pos or 0)):
        found[row.batch_id].append(row.error_code)
    return found


def nested(depth):
    value = 1
    for level in range(depth, 0, -1):
        value = {f"l{level}": value}
    return value


def event(**fields):
    return {"event_type": "t", **fields}


CASES = [
    ({"event_type": 12345}, "MISSING_EVENT_TYPE"),
    ({}, "MISSING_EVENT_TYPE"),
    ({"event_type": ""}, "MISSING_EVENT_TYPE"),
    ({"event_type": " \t\n ﻿"}, "MISSING_EVENT_TYPE"),
    ({"event_type": None}, "MISSING_EVENT_TYPE"),
    (event(session_id={"a": 1}), "INVALID_FIELD_TYPE"),
    (event(user_id=0), "INVALID_FIELD_TYPE"),
    (event(url=False), "INVALID_FIELD_TYPE"),
    (event(session_id=None, user_id=""), None),
    (event(properties="text"), "INVALID_PROPERTIES"),
    (event(properties=[1]), "INVALID_PROPERTIES"),
    (event(properties=None), None),
    ({"event_type": "e" * 129}, "EVENT_TYPE_TOO_LONG"),
    ({"event_type": "  " + "e" * 128 + "  "}, None),
    (event(session_id="s" * 129), "STRING_TOO_LONG"),
    (event(session_id="😀" * 65), "STRING_TOO_LONG"),
    (event(session_id="😀" * 64), None),
    (event(session_id="é" * 128), None),
    (event(url="u" * 8193), "STRING_TOO_LONG"),
    (event(country="c" * 17), "STRING_TOO_LONG"),
    (event(utm_term="u" * 257), "STRING_TOO_LONG"),
    (event(properties={"k" * 65: 1}), "PROP_KEY_TOO_LONG"),
    (event(properties={"k" * 64: 1}), None),
    (event(properties={"k": "s" * 4097}), "PROP_VALUE_TOO_LONG"),
    (event(properties={"k": "s" * 4095 + "\n"}), None),
    (event(properties={"k": "\\\"" * 2048}), None),
    (event(properties={"k": "\\\"" * 2049}), "PROP_VALUE_TOO_LONG"),
    (event(properties=nested(6)), "PROP_DEPTH_EXCEEDED"),
    (event(properties=nested(5)), None),
    (event(properties={"a": [[[[[1]]]]]}), "PROP_DEPTH_EXCEEDED"),
    (event(properties={"a": [[[[1]]]]}), None),
    (event(properties={"a": [[[[{}]]]]}), "PROP_DEPTH_EXCEEDED"),
    (event(properties={"user": {"profile": {"preferences": {"theme": "dark"}}}}), None),
    (event(properties={f"k{i}": i for i in range(51)}), "PROP_KEY_COUNT_EXCEEDED"),
    (event(properties={f"k{i}": i for i in range(50)}), None),
    (event(properties={"a": [{f"k{i}": i} for i in range(50)]}), "PROP_KEY_COUNT_EXCEEDED"),
    (event(properties={"k": ["v" * 900] * 20}), "PROP_SIZE_EXCEEDED"),
    (event(properties={"t": "{[\"quoted: {[{[{[{[\":", "u": "}]"}), None),
    # The first broken rule in document order is the one reported.
    (event(properties={"a": "s" * 4097, "k" * 65: 1}), "PROP_VALUE_TOO_LONG"),
    (event(properties={"z" * 65: 1, "a": "s" * 4097}), "PROP_KEY_TOO_LONG"),
    (event(session_id=5, user_id="u" * 200), "INVALID_FIELD_TYPE"),
]


def test_single_events(spark):
    found = codes(spark, *[json.dumps(e, ensure_ascii=False) for e, _ in CASES])
    assert found == [[code] for _, code in CASES]
    # As members of batches the events get the same verdicts.
    batched = [CASES[i : i + 10] for i in range(0, len(CASES), 10)]
    texts = [json.dumps([e for e, _ in batch], indent=1) for batch in batched]
    assert codes(spark, *texts) == [[code for _, code in batch] for batch in batched]


def test_infinite_numbers(spark):
    body = '{"event_type":"t","properties":{"n":%s}}'
    assert codes(spark, body % "1e999", body % "-1e999", body % '"Infinity"', body % "1e300") == [
        ["INVALID_PROPERTY_VALUE"],
        ["INVALID_PROPERTY_VALUE"],
        [None],
        [None],
    ]


def padded(size):
    text = '{"event_type":"t","url":"é"}'
    return text[:-1] + " " * (size - len(text.encode())) + "}"


def test_bodies(spark):
    one = '{"event_type":"t"}'
    assert codes(
        spark,
        padded(65536),
        padded(65537),
        "{bad",
        "[]",
        "12345",
        "null",
        '"text"',
        "",
        " ",
        one + " x",
        one + "," + one,
        "[" + ",".join([one] * 50) + "]",
        "[" + ",".join([one] * 51) + "]",
        ' \n [ {"event_type":"a"} , 7, null, "x", [] ]',
        "['single']",
        '["{quoted", "[1]"]',
        " " * 500 + one,
        '{"event_type":"t","properties":"{}"}',
        '{"event_type":"a","event_type":"b"}',
    ) == [
        [None],
        ["PAYLOAD_TOO_LARGE"],
        ["BAD_REQUEST"],
        ["EMPTY_BATCH"],
        ["INVALID_PAYLOAD"],
        ["INVALID_PAYLOAD"],
        ["INVALID_PAYLOAD"],
        ["MISSING_EVENT_TYPE"],
        ["BAD_REQUEST"],
        ["BAD_REQUEST"],
        ["BAD_REQUEST"],
        [None] * 50,
        ["BATCH_TOO_LARGE"],
        [None] + ["INVALID_EVENT_OBJECT"] * 4,
        ["BAD_REQUEST"],
        ["INVALID_EVENT_OBJECT"] * 2,
        [None],
        ["INVALID_PROPERTIES"],
        [None],
    ]


def test_quarantine_report(spark):
    bodies = [
        '[{"event_type":"a"},{"event_type":""},{"event_type":"b"}]',
        '[{"event_type":""},{"user_id":"x"}]',
        "[]",
        '{"event_type":"a"}',
    ]
    payloads = spark.createDataFrame(list(enumerate(bodies)), "batch_id long, body string")
    checked = ingest.validate_events(ingest.parse_payloads(payloads))
    report = ingest.quarantine_report(checked).orderBy("batch_id").collect()
    assert [tuple(r)[1:] for r in report] == [
        (2, 1, "MISSING_EVENT_TYPE", False),
        (0, 2, "MISSING_EVENT_TYPE", True),
        (0, 0, "EMPTY_BATCH", True),
        (1, 0, None, False),
    ]
    quarantined = ingest.quarantined_events(checked)
    assert quarantined.columns == ["batch_id", "pos", "error_code"]


REQUEST = "batch_id long, body string, client_ip string, user_agent string, server_country string, received_at timestamp_ntz"


def stored(spark, body, ip="203.0.113.195", ua=None, country=None, trust=False):
    payloads = spark.createDataFrame([(7, body, ip, ua, country, datetime(2026, 3, 1))], REQUEST)
    checked = ingest.validate_events(ingest.parse_payloads(payloads))
    return enrich_events(ingest.valid_events(checked), trust).orderBy("id").collect()


def test_server_fields_win(spark):
    body = '{"event_type":" t ","ip":"9.9.9.9","ua":"mine","timestamp":"1999-01-01","country":"US"}'
    [row] = stored(spark, body, ua="Mozilla Firefox/1")
    assert (row.ip, row.ua, row.browser, row.timestamp) == ("203.0.113.0", "Mozilla Firefox/1", "Firefox", datetime(2026, 3, 1))
    assert (row.event_type, row.country, row.properties, row.id) == ("t", None, "{}", 7 * 64)


@pytest.mark.parametrize("server, trust, expected", [("FR", False, "FR"), (None, True, "GB"), (None, False, None), ("FR", True, "FR")])
def test_country(spark, server, trust, expected):
    [row] = stored(spark, '{"event_type":"t","country":"GB"}', country=server, trust=trust)
    assert row.country == expected


def test_campaigns(spark):
    url = "https://x.org/?a=1&utm_source=first+one&utm_source=two&utm_medium=%zz%20&utm_term=#utm_content=no"
    [row] = stored(spark, json.dumps(event(url=url, utm_campaign="own", utm_source="")))
    assert (row.utm_source, row.utm_medium, row.utm_campaign, row.utm_term, row.utm_content) == (
        "first one",
        "%zz ",
        "own",
        None,
        None,
    )


def test_batch_order_gives_ids(spark):
    rows = stored(spark, '[{"event_type":"a"},{"event_type":""},{"event_type":"c"}]', ip="2001:db8:cafe:1234::99")
    assert [(r.id, r.event_type, r.ip) for r in rows] == [(448, "a", "2001:db8:cafe::"), (450, "c", "2001:db8:cafe::")]


def test_track(spark):
    columns = "id long, name string, properties string, session_id string, user_id string, url string, referrer string, ip string, ua string, country string, called_at timestamp_ntz"
    call = (1, " name ", None, "", "u", "", None, "1.2.3.4", "", "", datetime(2026, 3, 1))
    [row] = track_events(spark.createDataFrame([call], columns)).collect()
    assert (row.event_type, row.session_id, row.url, row.ip, row.browser) == (" name ", None, None, "1.2.3.0", "Unknown")
    blank = [(number, name, *call[2:]) for number, name in enumerate([None, "", "  ", "\u00a0\t"])]
    calls = spark.createDataFrame([call, *blank], columns)
    assert track_events(calls).count() == 1
    assert refused_calls(calls).count() == 4


def test_a_call_without_a_time_takes_that_of_the_run(spark):
    columns = "id long, name string, properties string, session_id string, user_id string, url string, referrer string, ip string, ua string, country string, called_at timestamp_ntz"
    calls = spark.createDataFrame([(1, "signup", *[None] * 9)], columns)
    [row] = track_events(calls, datetime(2026, 3, 1, 12)).collect()
    assert row.timestamp == datetime(2026, 3, 1, 12)
    assert track_events(calls).where("timestamp IS NULL").count() == 0


@pytest.mark.parametrize(
    "members, code, stored",
    [
        ('"properties":{"x":1},"properties":{"y":2}', None, '{"y":2}'),
        ('"properties":"text","properties":{"y":2}', None, '{"y":2}'),
        ('"properties":{"y":2},"properties":"text"', "INVALID_PROPERTIES", "text"),
        ('"properties":{"y":2},"properties":null', None, "{}"),
        ('"properties":{"x":1},"properties":{"' + "k" * 65 + '":2}', "PROP_KEY_TOO_LONG", None),
    ],
)
def test_repeated_properties_are_the_last(spark, members, code, stored):
    rows = spark.createDataFrame([(0, '{"event_type":"t",' + members + "}")], "batch_id long, body string")
    [row] = ingest.validate_events(ingest.parse_payloads(rows)).collect()
    assert row.error_code == code
    assert stored is None or row.properties == stored


def test_a_deep_event_does_not_spoil_its_batch(spark):
    deep = '{"event_type":"b","properties":{"x":' + "[" * 1_500 + "]" * 1_500 + "}}"
    keys = '{"event_type":"b","properties":{"x":' + '{"k":1,"n":' * 2_000 + '"e"' + "}" * 2_000 + "}}"
    wide = '{"event_type":"c","properties":{"x":[' + ",".join(['{"[{":"]"}'] * 20) + "]}}"
    body = f'[{{"event_type":"a"}},{deep},{keys},{wide},{{"event_type":"d","extra":{"[" * 700}{"]" * 700}}}]'
    unclosed = '[{"event_type":"a"},' + "[" * 1_500
    assert codes(spark, body, unclosed) == [[None, "PROP_DEPTH_EXCEEDED", "PROP_DEPTH_EXCEEDED", None, None], ["BAD_REQUEST"]]


def test_brackets_of_a_body_are_counted_once(spark):
    """Bodies of up to 399 brackets take about as long to look through as bodies of one; the look once began anew at every bracket."""
    def seconds(body):
        bodies = spark.range(0, 400, 1, 1).select(F.concat(F.lit(body), F.col("id").cast("string")).alias("body"))
        took = []
        for _ in range(3):
            started = time.perf_counter()
            bodies.select(shallow(F.col("body"))).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - started)
        return min(took)

    few, many = "[" + "x" * 20_000, "[" + "[" * 398 + "x" * 20_000
    assert seconds(many) < 6 * seconds(few)


@pytest.mark.parametrize("brackets, cut", [(39, False), (399, False), (400, True), (401, True)])
def test_deep_text_is_cut_from_so_many_brackets_on(spark, brackets, cut):
    text = '{"a\\n":' + "[" * (brackets - 1) + "1" + "]" * (brackets - 1) + "}"
    kept = spark.createDataFrame([(text,)], "body string").select(shallow(F.col("body"))).first()[0]
    assert kept == ('{"a\\n":' + "[" * 39 + "]" * 39 + "}" if cut else text)


@pytest.mark.parametrize("number, found", [("1e999", True), ("1E+400", True), ("1e99", False), ("1" * 309, True), ("1" * 308, False), ("x" + "1" * 320, True)])
def test_numbers_that_may_overflow(spark, number, found):
    assert spark.createDataFrame([(f"[{number}]",)], "body string").select(may_overflow(F.col("body"))).first()[0] is found
