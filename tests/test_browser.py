import json

import pytest
from pyspark.sql import functions as F

from footfall.functions.properties import truncate_properties
from footfall.functions.text import utf16_left
from footfall.operators import browser


def test_opt_out(spark):
    df = spark.createDataFrame(
        [(0, None, None), (1, "1", None), (2, "yes", None), (3, "0", False), (4, None, True), (5, "unspecified", None)],
        "id int, dnt string, gpc boolean",
    )
    assert sorted(r.id for r in browser.drop_opted_out(df).collect()) == [0, 3, 5]


def truncated(spark, properties, **fields):
    row = {"event_type": "t", "url": None, "referrer": None, **fields, "properties": properties}
    df = spark.createDataFrame([row], "event_type string, url string, referrer string, properties string")
    return browser.truncate_fields(df).first()


def test_truncation(spark):
    row = truncated(spark, "{}", event_type="e" * 200, url="u" * 9000, referrer="r" * 8192)
    assert (len(row.event_type), len(row.url), len(row.referrer)) == (128, 8192, 8192)
    assert truncated(spark, None).properties == "{}"
    assert truncated(spark, "[1]").properties == "{}"
    assert truncated(spark, "broken").properties == "{}"
    given = {
        "k" * 70: 1,
        "text": "s" * 5000,
        "list": list(range(60)),
        "mixed": ["s" * 5000, {"a": 1}, [1, 2], None],
        "deep": {"l2": {"l3": {"l4": {"l5": {"l6": 1}, "kept": 1}}}},
        "none": None,
    }
    cut = json.loads(truncated(spark, json.dumps(given)).properties)
    assert cut["k" * 64] == 1
    assert len(cut["text"]) == 4096 and len(cut["list"]) == 50
    assert [len(cut["mixed"][0]), *cut["mixed"][1:]] == [4096, {"a": 1}, {}, None]
    assert cut["deep"] == {"l2": {"l3": {"l4": {"kept": 1}}}} and cut["none"] is None


def test_utf16_cut(spark):
    texts = ["abc", "a😀b", "😀😀", "éééé"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").orderBy("n")
    assert [r[0] for r in df.select(utf16_left(F.col("t"), 3)).collect()] == ["abc", "a😀", "😀", "ééé"]
    assert [r[0] for r in df.select(utf16_left(F.col("t"), 2)).collect()] == ["ab", "a", "😀", "éé"]


def test_links(spark):
    page = "https://site.example/here"
    clicks = [
        (0, "https://site.example/doc.pdf", False, None),
        (1, "https://other.example/Archive.TAR.GZ?x=.html#y", False, "_blank"),
        (2, "https://other.example/", False, ""),
        (3, "https://site.example/plain", True, None),
        (4, "javascript:void(0)", True, None),
        (5, "mailto:a@b.example", False, None),
        (6, "https://SITE.example:8443/x", False, None),
        (7, "", False, None),
        (8, "https://site.example/a.pdfx", False, None),
        (9, "https://site.example/get?file=a.zip", False, None),
        (10, "https://other.example/" + "p" * 5000, False, None),
    ]
    df = spark.createDataFrame(
        [(n, h, page, d, t) for n, h, d, t in clicks],
        "id int, href string, page_url string, has_download_attr boolean, target string",
    )
    found = {(r.id, r.event_type): json.loads(r.properties) for r in browser.classify_links(df).collect()}
    assert sorted(found) == [
        (0, "download"), (1, "download"), (1, "outbound_click"), (2, "outbound_click"), (3, "download"),
        (9, "download"), (10, "outbound_click"),
    ]
    assert found[0, "download"]["extension"] == "pdf"
    assert found[1, "download"]["extension"] == "gz" and found[1, "outbound_click"]["target"] == "_blank"
    assert "target" not in found[2, "outbound_click"] and "extension" not in found[3, "download"]
    assert len(found[10, "outbound_click"]["href"]) == 4096


@pytest.mark.parametrize(
    "text, kept",
    [
        ("{not json}", "{}"),
        ("{not json}" + " " * 80, "{}"),
        ('{"a":1}', '{"a":1}'),
        ('{"a": 1}', '{"a":1}'),
        ('{"a": 1}' + " " * 80, '{"a":1}'),
        ('{"a":1,"a":2}', '{"a":2}'),
        ('{"a":"\\ud83d"}', '{"a":"\\ud83d"}'),
        ('{"a":"\\ud83d' + "x" * 80 + '"}', '{"a":"\\ud83d' + "x" * 80 + '"}'),
        ("[" * 20_000, "{}"),
        ('{"a":' + "[" * 20_000 + "]" * 20_000 + "}", "{}"),
        ("[1]", "{}"),
        ("", "{}"),
        (None, "{}"),
    ],
)
def test_truncation_never_fails_and_does_not_depend_on_size(spark, text, kept):
    rows = spark.createDataFrame([(text,)], "properties string")
    assert rows.select(truncate_properties(F.col("properties")).alias("p")).first().p == kept


@pytest.mark.parametrize("kind, yes, no", [("string", "1", "true"), ("boolean", True, False), ("int", 1, 2)])
def test_signals_compare_by_type(spark, kind, yes, no):
    rows = spark.createDataFrame([(0, yes, None), (1, no, None), (2, None, yes), (3, None, no)], f"id int, dnt {kind}, gpc {kind}")
    assert sorted(r.id for r in browser.drop_opted_out(rows).collect()) == [1, 3]


def cut_properties(spark, *texts):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, properties string").orderBy("n")
    return [r.p for r in rows.select(truncate_properties(F.col("properties")).alias("p")).collect()]


def test_truncated_texts_as_a_whole(spark):
    """Whole texts: nesting in every mixture, blanks, escapes, surrogates, repeated keys, very many tokens."""
    smile = "\U0001f642"
    cases = {
        ' { "a" : [ 1 , { "b" : [ [ 2 ] , "x" ] } , [ ] , null ] , "c" : { } } ': '{"a":[1,{"b":[{},"x"]},{},null],"c":{}}',
        '{"o":{"o":{"o":{"o":{"o":{"o":1},"p":2},"q":3}}},"r":[{"s":{"t":{"u":{"v":[5],"w":6}}}}]}':
            '{"o":{"o":{"o":{"o":{"p":2},"q":3}}},"r":[{"s":{"t":{"u":{"w":6}}}}]}',
        '{"l":[' + ",".join(map(str, range(60))) + ']}': '{"l":[' + ",".join(map(str, range(50))) + "]}",
        '{"l":[' + ",".join(['{"a":[1,{"b":2}]}'] * 51) + '],"m":1}': '{"l":[' + ",".join(['{"a":[1,{"b":2}]}'] * 50) + '],"m":1}',
        '{"l":[' + ",".join(["[1,[2]]"] * 51) + '],"m":1}': '{"l":[' + ",".join(["{}"] * 50) + '],"m":1}',
        json.dumps({"k" * 70: "v" * 5000}): json.dumps({"k" * 64: "v" * 4096}, separators=(",", ":")),
        '{"' + "k" * 64 + 'a":1,"' + "k" * 64 + 'b":2}': '{"' + "k" * 64 + '":2}',
        '{"a":{"x":1,"x":2},"b":{"y":1},"b":{"z":[3]}}': '{"a":{"x":2},"b":{"z":[3]}}',
        '{"s":"' + smile * 2050 + '"}': '{"s":"' + smile * 2048 + '"}',
        '{"s":"x' + smile * 2050 + '"}': '{"s":"x' + smile * 2047 + '"}',
        '{"s":"' + "\\u00e9" * 4097 + '"}': '{"s":"' + "\\u00e9" * 4096 + '"}',
        '{"s":"x' + "\\ud83d\\ude00" * 2050 + '"}': '{"s":"x' + "\\ud83d\\ude00" * 2047 + '"}',
        '{"s":"' + '\\"' * 4097 + '"}': '{"s":"' + '\\"' * 4096 + '"}',
        '{"a":"\\\\ud83d","b":"{\\"not\\": [a, key:]}" }': '{"a":"\\\\ud83d","b":"{\\"not\\": [a, key:]}"}',
        '{"t":true,"f":false,"n":null,"e":-1.5e+10,"z":0 }': '{"t":true,"f":false,"n":null,"e":-1.5e+10,"z":0}',
        '{"a":1} x': "{}",
        '{"a":1},{"b":2}': "{}",
        '{"a":1': "{}",
        "{" + ",".join(f'"k{n}":[{n},{{"x":"{n}"}}]' for n in range(3000)) + " }": "{" + ",".join(f'"k{n}":[{n},{{"x":"{n}"}}]' for n in range(3000)) + "}",
    }
    assert cut_properties(spark, *cases) == list(cases.values())


def test_truncation_stays_in_the_jvm(spark):
    rows = spark.createDataFrame([("{}",)], "properties string").select(truncate_properties(F.col("properties")))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
