"""Hand-made events."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {
    "event_id": "e1",
    "order_id": "o1",
    "customer_id": "c1",
    "seller_id": "s1",
    "city": "Austin",
    "order_category": "retail",
    "payment_method": "card",
    "event_type": "payment_captured",
    "order_amount": 10.0,
    "platform_fee": 1.0,
    "seller_payout": 9.0,
    "currency": "USD",
    "event_timestamp": "2026-03-13T10:00:00.123456+00:00",
}
ARRIVAL = datetime(2026, 3, 13, 11, 0, 0, tzinfo=timezone.utc)


def event(**changes) -> dict:
    return BASE | changes


def paid(amount: float, fee: float = 1.0, **changes) -> dict:
    return event(order_amount=amount, platform_fee=fee, seller_payout=amount - fee, **changes)


def payload(**changes) -> str:
    return json.dumps(event(**changes))


def records(spark: SparkSession, payloads: list[str | None]) -> DataFrame:
    """Kafka-shaped records."""
    rows = [(None if text is None else text.encode(), ARRIVAL) for text in payloads]
    return spark.createDataFrame(rows, "value binary, timestamp timestamp")


def bronze_table(spark: SparkSession, events: list[dict]) -> DataFrame:
    """Bronze rows without checks; `kafka_ingest_ts` may be given per event."""
    schema = (
        "event_id string, order_id string, customer_id string, seller_id string, city string,"
        " order_category string, payment_method string, event_type string, order_amount double,"
        " platform_fee double, seller_payout double, currency string, event_timestamp string,"
        " kafka_ingest_ts timestamp"
    )
    rows = [{"kafka_ingest_ts": ARRIVAL} | one for one in events]
    return (
        spark.createDataFrame(rows, schema)
        .withColumn("event_ts", F.try_to_timestamp("event_timestamp"))
        .withColumn("ingest_date", F.lit("2026-03-13").cast("date"))
    )


def rows_of(table: DataFrame) -> list[tuple]:
    columns = sorted(table.columns)
    return sorted((tuple(row) for row in table.select(*columns).collect()), key=repr)
