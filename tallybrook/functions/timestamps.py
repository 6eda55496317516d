"""Event-time parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STARTS_WITH_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"


def event_time(text: Column) -> Column:
    """Parse an ISO-like timestamp; NULL when it cannot be parsed.

    `to_timestamp` raises on bad text under ANSI mode, so one bad record would stop the stream;
    the `try_` form gives NULL whatever the session setting. A text without a date ("10:00:00")
    would be read as a time today, so its meaning would change with each run: it gives NULL too.
    """
    return F.when(text.rlike(_STARTS_WITH_DATE), F.try_to_timestamp(text))
