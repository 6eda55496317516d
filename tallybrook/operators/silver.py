"""Silver: valid events, one row per `event_id`, filed under the day they happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.contract import MONEY_FIELDS, SILVER_SCHEMA
from tallybrook.functions import rules
from tallybrook.functions.timestamps import event_time

# The latest event time wins. Copies can share it, so the remaining columns make the order total and
# the surviving row the same under any partitioning.
_DESCENDING = ["event_ts", "kafka_ingest_ts", "order_amount"]
_ASCENDING = [
    "seller_id",
    "customer_id",
    "order_category",
    "payment_method",
    "platform_fee",
    "seller_payout",
    "event_type",
    "city",
    "order_id",
    "currency",
    "event_timestamp",
    "ingest_date",
]


def clean(bronze: DataFrame, exact_payout: bool = False) -> DataFrame:
    """Parse event time again and keep valid rows, so that any writer's Bronze is accepted.

    Rows without an event time are kept for `from_bronze` to drop.
    """
    return (
        bronze.filter(F.col("event_id").isNotNull())
        .filter(rules.all_of([F.col(name) >= 0 for name in MONEY_FIELDS]))
        .filter(rules.payout_matches(exact_payout))
        .withColumn("event_ts", event_time(F.col("event_timestamp")))
    )


def keep_latest(events: DataFrame) -> DataFrame:
    """One row per `event_id`, the latest.

    With the rank filter directly on the window, Catalyst puts a group limit on both sides of the
    exchange: each map task sends at most one row per id, so an id with very many copies is cheap.
    """
    latest_first = Window.partitionBy("event_id").orderBy(
        *[F.col(name).desc_nulls_last() for name in _DESCENDING],
        *[F.col(name).asc_nulls_first() for name in _ASCENDING],
    )
    return (
        events.withColumn("row_num", F.row_number().over(latest_first))
        .filter(F.col("row_num") == 1)
        .drop("row_num")
    )


def from_bronze(bronze: DataFrame, exact_payout: bool = False) -> DataFrame:
    """Clean, deduplicate and add `event_date`. Extra Bronze columns are left out.

    The event time is checked after the ranking. A row without one ranks behind all copies that have
    one, so the result is the same, while a check before it would be pushed below the parse and make
    each text be parsed twice.
    """
    columns = [name for name in SILVER_SCHEMA.fieldNames() if name != "event_date"]
    latest = keep_latest(clean(bronze, exact_payout).select(*columns))
    return (
        latest.filter(F.col("event_ts").isNotNull())
        .withColumn("event_date", F.to_date("event_ts"))
        .select(*SILVER_SCHEMA.fieldNames())
    )
