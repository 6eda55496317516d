"""Gold: daily seller, city and platform metrics over captured payments.

All sums are exact decimals until the last step, so a coarser grain can be built from a finer one
without changing a cent. Distinct counts are built the same way: first one row per (day, key), which
is combined in the map tasks and spread over all reducers even if one key or day holds most rows,
then a count of those rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.contract import CAPTURED, GOLD_SCHEMAS, MONEY_FIELDS
from tallybrook.functions import money


def captured(silver: DataFrame) -> DataFrame:
    return silver.filter(F.col("event_type") == CAPTURED)


def _first_level(payments: DataFrame, *grain: str) -> DataFrame:
    sums = [column for name in MONEY_FIELDS for column in money.partial_sums(name)]
    return payments.groupBy(*grain).agg(F.count("*").alias("transaction_count"), *sums)


def _coarser(sums: DataFrame, grain: list[str], *extra: Column) -> DataFrame:
    merged = [column for name in MONEY_FIELDS for column in money.merged_sums(name)]
    return sums.groupBy(*grain).agg(
        F.sum("transaction_count").alias("transaction_count"), *merged, *extra
    )


def _finish(sums: DataFrame, table: str) -> DataFrame:
    return sums.withColumns(
        {
            "gross_sales": money.rounded_sum("order_amount"),
            "platform_fee_revenue": money.rounded_sum("platform_fee"),
            "seller_payout_total": money.rounded_sum("seller_payout"),
            "avg_order_value": money.rounded_average("order_amount", F.col("transaction_count")),
        }
    ).select(*GOLD_SCHEMAS[table].fieldNames())


def _per_seller(sums: DataFrame) -> DataFrame:
    return _coarser(sums, ["event_date", "seller_id"])


def _city_from(city_seller_sums: DataFrame) -> DataFrame:
    sellers = F.count("seller_id").alias("active_sellers")
    return _finish(_coarser(city_seller_sums, ["event_date", "city"], sellers), "city_metrics")


def _platform_from(seller_sums: DataFrame, payments: DataFrame) -> DataFrame:
    """Sums and sellers from one branch, customers from the other.

    The branches meet in a union and a last sum over a few rows per day. A join on the day would do,
    but makes one branch wait for the other to prune its days, which are the same.
    """
    return _platform_of(seller_sums, payments.select("event_date", "customer_id").distinct())


def _platform_of(seller_sums: DataFrame, customers: DataFrame) -> DataFrame:
    """customers: one row per day and customer."""
    totals = _coarser(seller_sums, ["event_date"], F.count("seller_id").alias("active_sellers"))
    customers = customers.groupBy("event_date").agg(F.count("customer_id").alias("active_customers"))
    both = totals.unionByName(customers, allowMissingColumns=True)
    keys = ["active_sellers", "active_customers"]
    return _finish(
        _coarser(both, ["event_date"], *[F.sum(key).alias(key) for key in keys]), "platform_metrics"
    )


def seller_metrics(silver: DataFrame) -> DataFrame:
    return _finish(_first_level(captured(silver), "event_date", "seller_id"), "seller_metrics")


def city_metrics(silver: DataFrame) -> DataFrame:
    return _city_from(_first_level(captured(silver), "event_date", "city", "seller_id"))


def platform_metrics(silver: DataFrame) -> DataFrame:
    """Two narrow scans, one per distinct key; two distinct counts in one aggregation would triple
    each row before the shuffle.
    """
    payments = captured(silver)
    return _platform_from(_first_level(payments, "event_date", "seller_id"), payments)


class SharedMetrics:
    """The three tables from one aggregation of Silver, for writing them together.

    The sums per (day, city, seller) are kept between the three writes, in memory or on disk; a lost
    executor's share is computed again from Silver. Use as a context manager to release them.
    """

    def __init__(self, silver: DataFrame):
        self._payments = captured(silver)
        self._sums = _first_level(self._payments, "event_date", "city", "seller_id")

    def __enter__(self) -> SharedMetrics:
        self._sums.persist(StorageLevel.MEMORY_AND_DISK)
        self._sums.count()  # fill it once; three writes that start at once would each compute it
        return self

    def __exit__(self, *_) -> None:
        self._sums.unpersist()

    def tables(self) -> dict[str, DataFrame]:
        sellers = _per_seller(self._sums)
        return {
            "seller_metrics": _finish(sellers, "seller_metrics"),
            "city_metrics": _city_from(self._sums),
            "platform_metrics": _platform_from(sellers, self._payments),
        }


def from_states(sums: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """The three tables from stored states: sums per day, city and seller, and one row per day and customer."""
    sellers = _per_seller(sums)
    return {
        "seller_metrics": _finish(sellers, "seller_metrics"),
        "city_metrics": _city_from(sums),
        "platform_metrics": _platform_of(sellers, customers),
    }
