"""Synthetic payment events as a projection over ids.

Each field is a hash of the id and the field's own salt, so an id gives the same event under any
partitioning and after any retry, which `rand(seed)` does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.contract import CITIES, EVENT_FIELDS, EVENT_TYPES, ORDER_CATEGORIES, PAYMENT_METHODS

DEFAULT_START = "2026-03-13 00:00:00+00:00"
DEFAULT_SPACING_MICROS = 2_000_000


def _hash(event: Column, salt: str) -> Column:
    return F.xxhash64(event, F.lit(salt))


def _uniform(event: Column, salt: str) -> Column:
    """A double in [0, 1): the upper 53 bits of the hash."""
    return F.shiftrightunsigned(_hash(event, salt), 11) / float(2**53)


def _integer(event: Column, salt: str, low: int, high: int) -> Column:
    return F.floor(_uniform(event, salt) * (high - low + 1)) + low


def _choice(event: Column, salt: str, values: list[str]) -> Column:
    position = _integer(event, salt, 1, len(values)).cast("int")
    return F.element_at(F.array(*[F.lit(value) for value in values]), position)


def _uuid4(event: Column) -> Column:
    high, low = (F.lpad(F.lower(F.hex(_hash(event, f"uuid_{part}"))), 16, "0") for part in "ab")
    variant = _choice(event, "uuid_variant", ["8", "9", "a", "b"])
    return F.concat_ws(
        "-",
        F.substring(high, 1, 8),
        F.substring(high, 9, 4),
        F.concat(F.lit("4"), F.substring(high, 14, 3)),
        F.concat(variant, F.substring(low, 2, 3)),
        F.substring(low, 5, 12),
    )


def events_for(
    ids: DataFrame,
    id_column: str = "id",
    start: str = DEFAULT_START,
    spacing_micros: int = DEFAULT_SPACING_MICROS,
) -> DataFrame:
    """One event per id. Event times start at `start` and follow the ids at a fixed spacing."""
    event = F.col(id_column)
    micros = F.unix_micros(F.lit(start).cast("timestamp")) + event * spacing_micros
    clock = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    # Ranges and id formats of the generated events.
    fields = {
        "event_id": _uuid4(event),
        "order_id": F.format_string("ord_%d", _integer(event, "order_id", 100000, 999999)),
        "customer_id": F.format_string("cust_%d", _integer(event, "customer_id", 1000, 9999)),
        "seller_id": F.format_string("seller_%d", _integer(event, "seller_id", 100, 999)),
        "city": _choice(event, "city", CITIES),
        "order_category": _choice(event, "order_category", ORDER_CATEGORIES),
        "payment_method": _choice(event, "payment_method", PAYMENT_METHODS),
        "event_type": _choice(event, "event_type", EVENT_TYPES),
        "order_amount": F.round(8.0 + _uniform(event, "order_amount") * 242.0, 2),
        "currency": F.lit("USD"),
        "event_timestamp": F.concat(clock, F.lit("+00:00")),
    }
    fee = F.round(F.col("order_amount") * (0.08 + F.col("fee_draw") * 0.10), 2)
    return (
        ids.select(
            *[column.alias(name) for name, column in fields.items()],
            _uniform(event, "platform_fee").alias("fee_draw"),
        )
        .withColumn("platform_fee", fee)
        .withColumn("seller_payout", F.round(F.col("order_amount") - F.col("platform_fee"), 2))
        .select(*EVENT_FIELDS)
    )


def events(spark: SparkSession, count: int, **options) -> DataFrame:
    return events_for(spark.range(count), **options)
