"""Arguments with which the sample queries run; the sample covers January 2024."""

from __future__ import annotations

from datetime import datetime

from footfall.operators.retention import Retention
from footfall.period import date_range

AS_OF = datetime(2024, 1, 30, 23, 57)
PERIOD = date_range("2024-01-16", "2024-01-30", as_of=AS_OF)
RETENTION = Retention(keep_raw_days=14.5, keep_rollup_days=26)
# Late cutoffs, so that some users are past them.
USERS_CUTOFF = datetime(2024, 1, 30, 6)
BUYERS_SINCE = datetime(2024, 1, 29)
PROFILE_USER = "8"

# The upper bound, a bare date, is exclusive.
FUNNEL_RANGE = ("2024-01-05", "2024-01-25")

# Name to (steps, since, until).
FUNNELS = {
    "funnel": ([{"value": "signup"}, {"value": "click", "label": "clicked"}, {"value": "purchase"}], None, None),
    "funnel_pages": (
        [
            {"type": "pageview", "value": "/en/"},
            {"type": "custom", "value": "click"},
            {"type": "pageview", "value": "%20"},
        ],
        None,
        None,
    ),
    "funnel_range": (
        [{"value": "click"}, {"value": "click"}, {"type": "pageview", "value": "http"}, {"value": "purchase"}],
        *FUNNEL_RANGE,
    ),
    "funnel_single_step": ([{"value": "error"}], None, "2024-01-20 12:00:00"),
}
