"""Browser, device and bot rules on user-agent text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker text to browser, first match wins.
BROWSER_MARKERS = [
    ("Edg/", "Edge"),
    ("OPR/", "Opera"),
    ("Opera", "Opera"),
    ("Chrome", "Chrome"),
    ("Safari", "Safari"),
    ("Firefox", "Firefox"),
]

# Words that automated clients put in their user agent. This list is our own.
BOT_WORDS = [
    "bot",
    "crawl",
    "spider",
    "slurp",
    "scrape",
    "headless",
    "phantomjs",
    "selenium",
    "puppeteer",
    "lighthouse",
    "pingdom",
    "uptime",
    "monitor",
    "facebookexternalhit",
    "embedly",
    "preview",
    "archiver",
    "^curl/",
    "^wget/",
    "^python",
    "^java/",
    "^go-http-client",
    "^okhttp",
    "^axios/",
    "^node-fetch",
    "^libwww-perl",
    "^apache-httpclient",
    "^postmanruntime",
]
BOT_PATTERN = "(?i)" + "|".join(BOT_WORDS)


def _blank(ua: Column) -> Column:
    return ua.isNull() | (ua == "")


def parse_browser(ua: Column) -> Column:
    start = F.when(_blank(ua), "Unknown")
    chain = reduce(lambda acc, m: acc.when(ua.contains(m[0]), m[1]), BROWSER_MARKERS, start)
    return chain.otherwise("Other")


def parse_device(ua: Column) -> Column:
    return (
        F.when(_blank(ua), "Unknown")
        .when(ua.rlike("(?i)iPad"), "Tablet")
        .when(ua.rlike("(?i)Mobi|Android|iPhone"), "Mobile")
        .otherwise("Desktop")
    )


def is_bot(ua: Column) -> Column:
    """True for known automated clients; a missing user agent is not a bot."""
    return F.coalesce(ua.rlike(BOT_PATTERN), F.lit(False))
