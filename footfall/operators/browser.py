"""What a browser does before sending: opt-outs, truncation, link clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.links import file_extension, host_of, is_download
from footfall.functions.properties import truncate_properties
from footfall.functions.text import none_if_empty, utf16_left
from footfall.model import EVENT_TYPE_MAX, PROP_STRING_MAX, REFERRER_MAX, URL_MAX

# Texts that mean "do not track"; the boolean true and the number 1 do as well.
DNT_VALUES = ["1", "yes"]
GPC_VALUES = ["1"]


def drop_opted_out(events: DataFrame, dnt: str = "dnt", gpc: str = "gpc") -> DataFrame:
    """Remove events of visitors with Do Not Track or Global Privacy Control.

    Signals may be text, numbers or booleans and compare by their type: the text 'true' is no opt-out.
    """

    def signalled(column: str, values: list[str]) -> Column:
        kind = events.schema[column].dataType
        if isinstance(kind, T.BooleanType):
            said = F.col(column)
        elif isinstance(kind, T.NumericType):
            said = F.col(column) == 1
        else:
            said = F.col(column).cast("string").isin(values)
        return F.coalesce(said, F.lit(False))

    return events.where(~signalled(dnt, DNT_VALUES) & ~signalled(gpc, GPC_VALUES))


def truncate_fields(events: DataFrame) -> DataFrame:
    """Cut over-long fields instead of refusing the event."""
    return events.withColumns(
        {
            "event_type": utf16_left(F.col("event_type"), EVENT_TYPE_MAX),
            "url": utf16_left(F.col("url"), URL_MAX),
            "referrer": utf16_left(F.col("referrer"), REFERRER_MAX),
            "properties": truncate_properties(F.col("properties")),
        }
    )


def sanitize_events(events: DataFrame) -> DataFrame:
    return truncate_fields(drop_opted_out(events))


def classify_links(clicks: DataFrame) -> DataFrame:
    """Link clicks to ``download`` and ``outbound_click`` events; a click can be both.

    ``clicks`` has href, page_url, has_download_attr and target; other columns pass through.
    """
    href = F.col("href")
    download = F.coalesce(F.col("has_download_attr"), F.lit(False)) | is_download(href)
    host, own_host = host_of(href), host_of(F.col("page_url"))
    outbound = (host != "") & (own_host != "") & (host != own_host)

    cut_href = utf16_left(href, PROP_STRING_MAX)
    extension = F.when(F.col("event_type") == "download", file_extension(href))
    properties = F.to_json(
        F.struct(
            cut_href.alias("url"),
            cut_href.alias("href"),
            extension.alias("extension"),
            none_if_empty(F.col("target")).alias("target"),
        )
    )
    found = F.array_compact(
        F.array(F.when(download, F.lit("download")), F.when(outbound, F.lit("outbound_click")))
    )
    return (
        clicks.where((href != "") & ~href.startswith("javascript:"))
        .withColumn("event_type", F.explode(found))
        .withColumn("extension", extension)
        .withColumn("properties", properties)
    )
