"""Payment events derived from the test tables, in two lanes.

Lane P maps `events` and has defective records but no copies. Lane L maps `lineitem` with its order,
customer and nation, and has copies but no defects. Fees use `floor(x + 0.5)` rather than `round`,
which gives the same double in every engine.

Lane C adds later copies, with other amounts and days, to lane P. Lanes F and H are lane L with
amounts of six decimals and of about 10^9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.contract import CITIES, EVENT_FIELDS, EVENT_TYPES, ORDER_CATEGORIES, PAYMENT_METHODS

_AUTHORIZED, _CAPTURED, _REFUND, _PAYOUT, _FAILED = EVENT_TYPES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_remainder(number: Column, values: list[str]) -> Column:
    """values[number % len(values)]"""
    position = (number % len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(value) for value in values]), position)


def _rounded(amount: Column, steps: float = 100.0) -> Column:
    return F.floor(amount * steps + 0.5) / steps


def _fee(amount: Column, steps: float = 100.0) -> Column:
    return F.floor(amount * (0.12 * steps) + 0.5) / steps


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.concat_ws("_", *parts))


def _events(spark: SparkSession, sf_dir: str, spread: bool) -> DataFrame:
    """The table; with `spread` dealt by id over all cores. A scan has as many tasks as the files have
    row groups, and to encode, parse and write a row costs far more than to read and shuffle it.
    """
    events = _table(spark, sf_dir, "events")
    return events.repartition("event_id") if spread else events


def lane_p(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Event columns and `kafka_ingest_ts`."""
    return _from_events(_events(spark, sf_dir, spread))


def later_copies(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Every seventh event of lane P once more: a day later, by one unit dearer."""
    events = _events(spark, sf_dir, spread).where(F.col("event_id") % 7 == 0)
    return _from_events(
        events.withColumns({"value": F.col("value") + 1, "ts": F.col("ts") + F.expr("INTERVAL 1 DAY")})
    )


def lane_c(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return lane_p(spark, sf_dir, spread).unionByName(later_copies(spark, sf_dir, spread))


def _from_events(events: DataFrame) -> DataFrame:
    number, user, value = F.col("event_id"), F.col("user_id"), F.col("value")

    def every(step: int) -> Column:
        return number % step == 0

    type_of = {"click": _AUTHORIZED, "purchase": _CAPTURED, "view": _REFUND, "signup": _PAYOUT}
    event_type = F.lit(_FAILED)
    for source, target in type_of.items():
        event_type = F.when(F.col("event_type") == source, target).otherwise(event_type)
    amount = F.when(every(53), F.lit(None)).when(every(47), -value).otherwise(value)
    clock = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    timestamp = F.when(every(41), "not-a-timestamp").otherwise(F.concat(clock, F.lit("+00:00")))
    columns = {
        "event_id": _id("evt", number),
        "order_id": _id("ord", number),
        "customer_id": _id("cust", user),
        "seller_id": _id("seller", F.get_json_object("props", "$.k")),
        "city": _by_remainder(user, CITIES),
        "order_category": _by_remainder(number, ORDER_CATEGORIES),
        "payment_method": _by_remainder(user, PAYMENT_METHODS),
        "event_type": event_type,
        "order_amount": amount,
        "platform_fee": _fee(value),
        "seller_payout": F.when(every(43), value).otherwise(_rounded(value - _fee(value))),
        "currency": F.lit("USD"),
        "event_timestamp": timestamp,
        "kafka_ingest_ts": F.col("ts").cast("timestamp"),
    }
    return events.select(*[column.alias(name) for name, column in columns.items()])


def lane_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event columns and `kafka_ingest_ts`."""
    return _from_lines(spark, sf_dir, F.col("l_extendedprice"), 100.0)


def lane_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_lines(spark, sf_dir, F.col("l_extendedprice") / 10000.0, 1000000.0)


def lane_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_lines(spark, sf_dir, F.col("l_extendedprice") + 950000000.0, 100.0)


def _from_lines(spark: SparkSession, sf_dir: str, amount: Column, steps: float) -> DataFrame:
    order, line, fee = F.col("l_orderkey"), F.col("l_linenumber"), _fee(amount, steps)
    columns = {
        "event_id": _id("evt", order, line),
        "order_id": _id("ord", order),
        "customer_id": _id("cust", F.col("o_custkey")),
        "seller_id": _id("seller", F.col("l_suppkey")),
        "city": F.col("n_name"),
        "order_category": _by_remainder(F.col("l_partkey"), ORDER_CATEGORIES),
        "payment_method": _by_remainder(F.col("o_custkey"), PAYMENT_METHODS),
        "event_type": _by_remainder(order + line, EVENT_TYPES),
        "order_amount": amount,
        "platform_fee": fee,
        "seller_payout": _rounded(amount - fee, steps),
        "currency": F.lit("USD"),
        "event_timestamp": F.concat(
            F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00.000000+00:00")
        ),
        "kafka_ingest_ts": F.col("o_orderdate").cast("timestamp"),
    }
    orders, customer, nation = (_table(spark, sf_dir, name) for name in ["orders", "customer", "nation"])
    return (
        _table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(*[column.alias(name) for name, column in columns.items()])
    )


def as_records(events: DataFrame) -> DataFrame:
    """Events as they arrive from Kafka: a binary JSON `value` and a `timestamp`."""
    return events.select(
        F.to_json(F.struct(*EVENT_FIELDS)).cast("binary").alias("value"),
        F.col("kafka_ingest_ts").alias("timestamp"),
    )
