"""Raw payloads to valid events, with every rejected event accounted for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import model
from footfall.functions.properties import may_overflow, properties_error, shallow
from footfall.functions.text import none_if_empty, trim_blanks, utf16_length


# Columns of a parsed payload that its validated events no longer have.
_PARSED = ("event", "event_text", "overflow", "batch_error")


def _kind(variant: Column) -> Column:
    """Type text of a VARIANT: NULL when absent, 'VOID' for JSON null."""
    return F.schema_of_variant(variant)


def _is_object(variant: Column) -> Column:
    """Whether a VARIANT is an object; cheaper than asking for its whole schema."""
    return F.try_variant_get(variant, "$", "map<string,variant>").isNotNull()


def _field(name: str) -> Column:
    return F.try_variant_get(F.col("event"), f"$.{name}", "variant")


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Request bodies to one row per event.

    ``payloads`` has ``batch_id`` (the arrival number of the request) and ``body``; other
    columns are passed through. Adds ``pos``, ``event`` (VARIANT), ``event_text`` (the same
    as compact JSON, members in their sent order), ``overflow`` (the body may hold a number
    beyond the range of a double) and ``batch_error``. A body that is rejected as a whole
    keeps one row, without event; of containers far beyond the allowed depth the content is
    left out first, so one such event does not spoil the others. Sessions of `get_spark` keep the last value of a repeated
    key; where ``spark.sql.variant.allowDuplicateKeys`` is off, such a body is a bad request.
    """
    kept = [c for c in payloads.columns if c != "body"]
    sent = F.coalesce(none_if_empty(F.col("body")), F.lit("{}"))
    too_large = F.octet_length(sent) > model.BODY_BYTES_MAX
    # Inside brackets, text after the JSON value is a syntax error or a second element.
    bracketed = F.when(~F.col("too_large"), F.concat(F.lit("["), F.col("text"), F.lit("]")))
    first = F.regexp_extract("body", r"^[ \t\n\r]*(.)", 1)
    wrapped = F.col("wrapped")
    well_formed = (
        F.try_variant_get(wrapped, "$[0]", "variant").isNotNull()
        & F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    )
    is_list = F.col("shape") == "["
    inner = F.when(is_list, F.try_variant_get(wrapped, "$[0]", "array<variant>")).otherwise(
        F.try_variant_get(wrapped, "$", "array<variant>")
    )
    texts = F.from_json(F.when(is_list, F.col("text")).otherwise(F.col("bracketed")), "array<string>")
    error = (
        F.when(F.col("too_large"), "PAYLOAD_TOO_LARGE")
        .when(~F.coalesce(well_formed, F.lit(False)), "BAD_REQUEST")
        .when(~F.col("shape").isin("[", "{"), "INVALID_PAYLOAD")
        .when(is_list & (F.size("events") == 0), "EMPTY_BATCH")
        .when(is_list & (F.size("events") > model.BATCH_MAX), "BATCH_TOO_LARGE")
    )
    # Columns that are used more than once are projections of their own, so that they are computed once.
    parsed = (
        payloads.select(
            *kept,
            F.when(too_large, sent).otherwise(shallow(sent)).alias("text"),
            too_large.alias("too_large"),
            F.when(F.coalesce(F.col("body"), F.lit("")) == "", "{").otherwise(first).alias("shape"),
        )
        .withColumns({"bracketed": bracketed, "overflow": may_overflow(F.col("text"))})
        .withColumn("wrapped", F.try_parse_json("bracketed"))
        .withColumn("events", inner)
        .withColumn("batch_error", error)
    )
    elements = F.when(
        F.col("batch_error").isNull(),
        F.arrays_zip(F.col("events").alias("event"), texts.alias("event_text")),
    )
    return parsed.select(*kept, "overflow", "batch_error", F.posexplode_outer(elements)).select(
        *kept,
        "pos",
        F.col("col.event").alias("event"),
        F.col("col.event_text").alias("event_text"),
        "overflow",
        "batch_error",
    )


def explode_batches(payloads: DataFrame) -> DataFrame:
    """Accepted batches only: one row per event with its place in the batch."""
    # Filtered on the position: a test of batch_error would be pushed below the explode and
    # parse every body a second time.
    return parse_payloads(payloads).where(F.col("pos").isNotNull()).drop("batch_error")


# Columns in which the members of an event are kept while they are checked.
_TEXT, _KIND = "_text_{}", "_kind_{}"
_PROPERTIES = "properties"


def _event_type_error() -> Column:
    trimmed = F.col(_TEXT.format("event_type"))
    is_text = F.coalesce(F.col(_KIND.format("event_type")) == "STRING", F.lit(False))
    return F.when(~is_text | (trimmed == ""), "MISSING_EVENT_TYPE").when(
        # Bytes bound UTF-16 units from above, so most rows skip the exact count.
        (F.octet_length(trimmed) > model.EVENT_TYPE_MAX) & (utf16_length(trimmed) > model.EVENT_TYPE_MAX),
        "EVENT_TYPE_TOO_LONG",
    )


def _optional_error(name: str, longest: int) -> Column:
    kind, text = F.col(_KIND.format(name)), F.col(_TEXT.format(name))
    return F.when(kind.isNull() | (kind == "VOID"), None).when(kind != "STRING", "INVALID_FIELD_TYPE").when(
        (F.octet_length(text) > longest) & (utf16_length(text) > longest), "STRING_TOO_LONG"
    )


def _properties_text() -> Column:
    """The text of the member that the VARIANT holds: of a repeated one, the last."""
    return F.from_json("event_text", "properties string")["properties"]


def _properties_error() -> Column:
    raw, text = _field(_PROPERTIES), F.col(_TEXT.format(_PROPERTIES))
    return F.when(raw.isNull() | F.is_variant_null(raw), None).when(
        ~_is_object(raw), "INVALID_PROPERTIES"
    ).otherwise(properties_error(text, F.col("overflow")))


def validate_properties(parsed: DataFrame) -> DataFrame:
    """Only the property check: adds ``properties_error``."""
    text = _TEXT.format(_PROPERTIES)
    return parsed.withColumn(text, _properties_text()).withColumn("properties_error", _properties_error()).drop(text)


def _members(parsed: DataFrame, kept: list[str]) -> DataFrame:
    """Every member of an event taken out of it once, as its kind and its text, for all that follows."""
    names = ["event_type", *model.OPTIONAL_FIELDS]
    raw = parsed.select(*kept, *_PARSED, *[_field(n).alias(f"_raw_{n}") for n in names])
    texts = {n: F.try_variant_get(f"_raw_{n}", "$", "string") for n in names}
    texts["event_type"] = trim_blanks(texts["event_type"])
    return raw.select(
        *kept,
        *_PARSED,
        *[_kind(F.col(f"_raw_{n}")).alias(_KIND.format(n)) for n in names],
        *[texts[n].alias(_TEXT.format(n)) for n in names],
        _properties_text().alias(_TEXT.format(_PROPERTIES)),
    )


def validate_events(parsed: DataFrame) -> DataFrame:
    """Typed fields plus ``error_code``, the first failing check (NULL = valid).

    Rows of rejected bodies carry the body's error. No shuffle: narrow projections, in which each member of an
    event is extracted once.
    """
    kept = [c for c in parsed.columns if c not in _PARSED]
    checks = [
        F.col("batch_error"),
        F.when(
            ~_is_object(F.col("event")),
            "INVALID_EVENT_OBJECT",
        ),
        _event_type_error(),
        *[_optional_error(name, longest) for name, longest in model.OPTIONAL_FIELDS.items()],
        _properties_error(),
    ]
    # A CASE stops at the first error, so later checks cost nothing on bad rows.
    error = reduce(lambda later, check: F.coalesce(check, later), reversed(checks[:-1]), checks[-1])
    return _members(parsed, kept).select(
        *kept,
        F.col(_TEXT.format("event_type")).alias("event_type"),
        *[none_if_empty(F.col(_TEXT.format(name))).alias(name) for name in model.OPTIONAL_FIELDS],
        F.coalesce(_TEXT.format(_PROPERTIES), F.lit("{}")).alias("properties"),
        error.alias("error_code"),
    )


def valid_events(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error_code").isNull()).drop("error_code")


def quarantined_events(validated: DataFrame) -> DataFrame:
    """Where and why events were rejected; holds no event content and no address."""
    return validated.where(F.col("error_code").isNotNull()).select("batch_id", "pos", "error_code")


def quarantine_report(validated: DataFrame) -> DataFrame:
    """Stored and dropped events per batch, its first error, and whether all of it failed."""
    valid = F.col("error_code").isNull()
    return validated.groupBy("batch_id").agg(
        F.count_if(valid).alias("stored"),
        F.count_if(~valid & F.col("pos").isNotNull()).alias("dropped"),
        F.min_by(
            "error_code", F.when(~valid, F.coalesce(F.col("pos"), F.lit(-1)))
        ).alias("first_error"),
        (F.count_if(valid) == 0).alias("rejected"),
    )
