"""URL rules: campaign parameters, hosts and download links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.text import none_if_empty
from footfall.model import UTM_FIELDS

# File extensions that make a link a download.
DOWNLOAD_EXTENSIONS = (
    "pdf zip csv gz tar tgz rar 7z doc docx xls xlsx ppt pptx txt mp3 mp4 avi mov dmg iso exe "
    "apk deb rpm"
).split()
_DOWNLOAD = rf"(?i)\.({'|'.join(DOWNLOAD_EXTENSIONS)})($|\?|#)"
_HOST = r"(?i)^(?:https?|wss?|ftp)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)"


def decode_parameter(text: Column) -> Column:
    """Form-decode a query value; a percent sign that starts no escape stays as it is."""
    safe = F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25")
    return F.try_url_decode(safe)


def query_parameter(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded; NULL when absent or empty."""
    pattern = rf"^[^?#]*\?(?:[^#]*?&)??{name}=([^&#]*)"
    return none_if_empty(decode_parameter(none_if_empty(F.regexp_extract(url, pattern, 1))))


def extract_utm(url: Column) -> dict[str, Column]:
    return {name: query_parameter(url, name) for name in UTM_FIELDS}


def merge_utm(own: Column, from_url: Column) -> Column:
    """A campaign value sent with the event wins over the one in its URL."""
    return F.coalesce(none_if_empty(own), from_url)


def host_of(url: Column) -> Column:
    """Lower-case host name, '' for URLs without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def is_download(href: Column) -> Column:
    return href.rlike(_DOWNLOAD)


def file_extension(href: Column) -> Column:
    path = F.substring_index(F.substring_index(href, "?", 1), "#", 1)
    return none_if_empty(F.lower(F.regexp_extract(path, r"(?i)\.([a-z0-9]+)$", 1)))
