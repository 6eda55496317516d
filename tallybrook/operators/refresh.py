"""Which days of Silver new rows touch, and what these days hold afterwards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.operators import silver


def affected_days(new: DataFrame, current: DataFrame, held: DataFrame | None = None) -> list[date]:
    """Days of new rows, and of the Silver rows whose ids they share.

    `held` are days that may hold an id of the new rows, from an index. Without it two columns of all
    Silver are joined by id in the cluster. Only the days come to the driver.
    """
    if held is None:
        held = current.select("event_id", "event_date").join(new.select("event_id"), "event_id", "left_semi")
    days = new.select("event_date").union(held.select("event_date")).distinct()
    return sorted(row.event_date for row in days.collect())


def refreshed(new: DataFrame, current: DataFrame, days: list[date]) -> DataFrame:
    """The affected days of Silver with the new rows; the order of copies is total, so the outcome is
    that of a full rebuild. Other days are not read.
    """
    return silver.keep_latest(current.filter(F.col("event_date").isin(days)).unionByName(new))
