"""Reporting periods: argument rules that run once, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone

DEFAULT_DAYS = 30
_DATE_ONLY = re.compile(r"\d{4}-\d{2}-\d{2}")
_MS = timedelta(milliseconds=1)


class ArgumentError(ValueError):
    """A caller's argument breaks a rule; ``code`` names the rule."""

    def __init__(self, message: str, code: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Period:
    """Closed current period and the half-open period of equal length before it (UTC)."""

    since: datetime
    until: datetime
    prev_since: datetime
    prev_until: datetime


def is_date_only(value) -> bool:
    if isinstance(value, datetime):
        return False
    return isinstance(value, date) or (
        isinstance(value, str) and _DATE_ONLY.fullmatch(value) is not None
    )


def parse_instant(value) -> datetime | None:
    """UTC wall time in whole milliseconds, or None when ``value`` is no date."""
    if isinstance(value, datetime):
        parsed = value
    elif isinstance(value, date):
        parsed = datetime.combine(value, time.min)
    elif isinstance(value, str):
        try:
            parsed = datetime.fromisoformat(value)
        except ValueError:
            return None
    else:
        return None
    if parsed.tzinfo is not None:
        parsed = parsed.astimezone(timezone.utc).replace(tzinfo=None)
    return parsed.replace(microsecond=parsed.microsecond // 1000 * 1000)


def check_dates(since=None, until=None) -> None:
    """Reject dates that do not parse or are in the wrong order."""
    start, end = parse_instant(since), parse_instant(until)
    if since and start is None:
        raise ArgumentError('"since" is not a date', "INVALID_DATE")
    if until and end is None:
        raise ArgumentError('"until" is not a date', "INVALID_DATE")
    if since and until and start > end:
        raise ArgumentError('"since" must not be later than "until"', "INVALID_DATE_RANGE")


def date_range(since=None, until=None, *, as_of) -> Period:
    """Resolve optional bounds against ``as_of``, the caller's notion of now.

    A date-only ``until`` reaches to the end of its day. A missing or unusable ``since``,
    or one not before ``until``, becomes 30 days before ``until``.
    """
    end = parse_instant(until) if until else None
    if end is None:
        end = parse_instant(as_of)
    elif is_date_only(until):
        end = end + timedelta(days=1) - _MS
    start = parse_instant(since) if since else None
    if start is None or start >= end:
        start = end - timedelta(days=DEFAULT_DAYS)
    return Period(start, end, start - (end - start), start)
