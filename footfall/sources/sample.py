"""The event model over the sample tables ``events`` and ``pages``.

The expressions are plain SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.agents import parse_browser, parse_device

# User agents and addresses dealt out over the sample events.
AGENTS = [
    "NULL",
    "''",
    "'Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36'",
    "'Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0'",
    "'Mozilla/5.0 (Macintosh) AppleWebKit/605.1 Version/17.0 Safari/605.1'",
    "'Mozilla/5.0 (X11; Linux) Gecko/20100101 Firefox/121.0'",
    "'Mozilla/5.0 (iPad; CPU OS 17_0) AppleWebKit/605.1 Mobile Safari/604.1'",
    "'Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile Safari/537.36'",
    "'Opera/9.80 (Windows NT 6.1)'",
    "'Mozilla/5.0 (compatible; Googlebot/2.1)'",
    "'curl/8.4.0'",
]
ADDRESSES = [
    "NULL",
    "'192.168.' || CAST(event_id % 50 AS STRING) || '.42'",
    "'10.0.' || CAST(event_id % 20 AS STRING) || '.7:8080'",
    "'::ffff:172.16.' || CAST(event_id % 9 AS STRING) || '.1'",
    "'2001:0DB8:' || CAST(event_id % 90 AS STRING) || '::1'",
    "'[2001:db8::' || CAST(event_id % 9 AS STRING) || ']:443'",
    "'fe80::1ff:fe23:4567:890a'",
]
COUNTRIES = ["NULL", "''", "'US'", "'GB'", "'FR'", "'US'", "'DE'", "'us'", "'ES'", "'US'", "'NL'"]


def deal(values: list[str], by: str = "event_id") -> str:
    """CASE expression that deals values out in turn."""
    cases = " ".join(f"WHEN {i} THEN {value}" for i, value in enumerate(values))
    return f"CASE {by} % {len(values)} {cases} END"


SESSION = "CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING)"

# Column name to SQL, over the sample's events.
EVENT_SQL = {
    "id": "event_id",
    "event_type": "CASE WHEN event_type = 'view' THEN 'pageview' ELSE event_type END",
    "session_id": f"CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN '' ELSE {SESSION} END",
    "user_id": "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 37 = 0 THEN '' "
    "ELSE CAST(user_id AS STRING) END",
    "referrer": "CASE WHEN event_id % 3 = 0 THEN 'https://ref' || CAST(event_id % 17 AS STRING) || "
    "'.example.org/' WHEN event_id % 21 = 1 THEN '' ELSE NULL END",
    "properties": "props",
    "ip": deal(ADDRESSES),
    "ua": deal(AGENTS),
    "country": deal(COUNTRIES),
    "timestamp": "ts",
}

# The URL of an event: that of its page, some with campaign parameters.
URL_SQL = (
    "CASE WHEN event_id % 4 = 1 AND NOT url LIKE '%?%' AND NOT url LIKE '%#%' THEN "
    "url || '?utm_source=news%20letter&utm_medium=e+mail&utm_campaign=c' || "
    "CAST(event_id % 7 AS STRING) || '&utm_source=second&utm_term=#utm_content=no' ELSE url END"
)


def read_sample(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_page(rows: DataFrame, pages: DataFrame, number: str, column: str = "url") -> DataFrame:
    """Adds the URL of the page a number points at, counting pages round and round."""
    size = pages.agg(F.count("*").alias("n")).scalar()
    listed = pages.select(F.col("page_id").alias("page_no"), F.col("url").alias(column))
    return rows.withColumn("page_no", F.expr(number) % size).join(listed, "page_no").drop("page_no")


def model_events(raw: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Sample events in the event model; URLs only where ``pages`` is given."""
    columns = [F.expr(sql).alias(name) for name, sql in EVENT_SQL.items()]
    if pages is not None:
        raw = with_page(raw, pages, "event_id")
        columns.append(F.expr(URL_SQL).alias("url"))
    else:
        columns.append(F.lit(None).cast("string").alias("url"))
    rows = raw.select(*columns)
    return rows.withColumns(
        {"browser": parse_browser(F.col("ua")), "device_type": parse_device(F.col("ua"))}
    )


def sample_events(spark: SparkSession, sf_dir: str, urls: bool = False) -> DataFrame:
    pages = read_sample(spark, sf_dir, "pages") if urls else None
    return model_events(read_sample(spark, sf_dir, "events"), pages)
