"""Table schemas and ingest limits."""

from pyspark.sql import types as T

UTM_FIELDS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]

# Ingest limits. Lengths are UTF-16 code units, sizes are bytes.
EVENT_TYPE_MAX = 128
SESSION_ID_MAX = 128
USER_ID_MAX = 128
URL_MAX = 8192
REFERRER_MAX = 8192
COUNTRY_MAX = 16
UTM_MAX = 256
PROP_KEY_MAX = 64
PROP_STRING_MAX = 4096
PROP_KEYS_MAX = 50
PROP_DEPTH_MAX = 5
PROP_BYTES_MAX = 16384
BATCH_MAX = 50
BODY_BYTES_MAX = 65536

# Optional text fields in the order in which they are checked.
OPTIONAL_FIELDS = {
    "session_id": SESSION_ID_MAX,
    "user_id": USER_ID_MAX,
    "url": URL_MAX,
    "referrer": REFERRER_MAX,
    "country": COUNTRY_MAX,
    **{name: UTM_MAX for name in UTM_FIELDS},
}

# A batch has at most BATCH_MAX events, so arrival number * 64 + position is unique and
# keeps arrival order without any global counter.
IDS_PER_BATCH = 64

EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("referrer", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("ua", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        *[T.StructField(name, T.StringType()) for name in UTM_FIELDS],
    ]
)

SESSIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("last_seen_at", T.TimestampNTZType()),
        T.StructField("referrer", T.StringType()),
        T.StructField("landing_page", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("ua", T.StringType()),
        T.StructField("is_active", T.IntegerType()),
    ]
)

USERS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("first_seen", T.TimestampNTZType()),
        T.StructField("last_seen", T.TimestampNTZType()),
        T.StructField("country", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("properties", T.StringType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("dimension", T.StringType()),
        T.StructField("value", T.LongType()),
    ]
)
