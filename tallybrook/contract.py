"""The payment-event contract: column schemas, enumerations and table grains."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: must equal the published event contract ---
EVENT_COLUMNS = [
    ("event_id", T.StringType()),
    ("order_id", T.StringType()),
    ("customer_id", T.StringType()),
    ("seller_id", T.StringType()),
    ("city", T.StringType()),
    ("order_category", T.StringType()),
    ("payment_method", T.StringType()),
    ("event_type", T.StringType()),
    ("order_amount", T.DoubleType()),
    ("platform_fee", T.DoubleType()),
    ("seller_payout", T.DoubleType()),
    ("currency", T.StringType()),
    ("event_timestamp", T.StringType()),
]

CITIES = ["Phoenix", "New York", "Chicago", "Austin", "Seattle", "San Francisco"]
ORDER_CATEGORIES = ["food_delivery", "groceries", "pharmacy", "retail"]
PAYMENT_METHODS = ["card", "wallet", "upi"]
EVENT_TYPES = [
    "payment_authorized",
    "payment_captured",
    "refund_issued",
    "payout_sent",
    "payment_failed",
]
# --- End of fixed values ---

CAPTURED = "payment_captured"
FAILED = "payment_failed"
PAYOUT_SENT = "payout_sent"

ALLOWED_VALUES = {
    "event_type": EVENT_TYPES,
    "payment_method": PAYMENT_METHODS,
    "order_category": ORDER_CATEGORIES,
}

# `nullable=False` documents the contract only: JSON parsing and Parquet both make every column
# nullable, so the not-null rules are enforced by `functions.rules`.
EVENT_SCHEMA = T.StructType([T.StructField(name, kind, False) for name, kind in EVENT_COLUMNS])
EVENT_FIELDS = EVENT_SCHEMA.fieldNames()
MONEY_FIELDS = [name for name, kind in EVENT_COLUMNS if kind == T.DoubleType()]


def _table(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# --- Fixed values: columns of the tables must equal those of the published pipeline ---
BRONZE_SCHEMA = _table(
    EVENT_COLUMNS
    + [
        ("kafka_ingest_ts", T.TimestampType()),
        ("event_ts", T.TimestampType()),
        ("ingest_date", T.DateType()),
    ]
)

# Two columns more than the parsed event: without the payload and the reasons a rejected record
# cannot be diagnosed or replayed.
QUARANTINE_SCHEMA = _table(
    [(field.name, field.dataType) for field in BRONZE_SCHEMA]
    + [("raw_value", T.StringType()), ("reasons", T.ArrayType(T.StringType()))]
)

SILVER_SCHEMA = _table(
    [(field.name, field.dataType) for field in BRONZE_SCHEMA] + [("event_date", T.DateType())]
)

SELLER_METRICS_SCHEMA = _table(
    [
        ("event_date", T.DateType()),
        ("seller_id", T.StringType()),
        ("transaction_count", T.LongType()),
        ("gross_sales", T.DoubleType()),
        ("platform_fee_revenue", T.DoubleType()),
        ("seller_payout_total", T.DoubleType()),
        ("avg_order_value", T.DoubleType()),
    ]
)

CITY_METRICS_SCHEMA = _table(
    [
        ("event_date", T.DateType()),
        ("city", T.StringType()),
        ("transaction_count", T.LongType()),
        ("gross_sales", T.DoubleType()),
        ("platform_fee_revenue", T.DoubleType()),
        ("avg_order_value", T.DoubleType()),
        ("active_sellers", T.LongType()),
    ]
)

PLATFORM_METRICS_SCHEMA = _table(
    [
        ("event_date", T.DateType()),
        ("transaction_count", T.LongType()),
        ("gross_sales", T.DoubleType()),
        ("platform_fee_revenue", T.DoubleType()),
        ("seller_payout_total", T.DoubleType()),
        ("avg_order_value", T.DoubleType()),
        ("active_sellers", T.LongType()),
        ("active_customers", T.LongType()),
    ]
)

GOLD_SCHEMAS = {
    "seller_metrics": SELLER_METRICS_SCHEMA,
    "city_metrics": CITY_METRICS_SCHEMA,
    "platform_metrics": PLATFORM_METRICS_SCHEMA,
}

# --- End of fixed values ---

GOLD_GRAINS = {
    "seller_metrics": ["event_date", "seller_id"],
    "city_metrics": ["event_date", "city"],
    "platform_metrics": ["event_date"],
}
