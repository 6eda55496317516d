"""Extensions: reports that the event model names as goals but that had no table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.contract import CAPTURED, FAILED, PAYOUT_SENT
from tallybrook.functions import money, rules
from tallybrook.functions.timestamps import event_time


def _outcomes(silver: DataFrame, *grain: str) -> DataFrame:
    captured, failed = F.col("captured_count"), F.col("failed_count")
    return (
        silver.groupBy(*grain)
        .agg(
            F.count_if(F.col("event_type") == CAPTURED).alias("captured_count"),
            F.count_if(F.col("event_type") == FAILED).alias("failed_count"),
        )
        .withColumn("success_rate", F.try_divide(captured, captured + failed))
    )


def payment_outcomes(silver: DataFrame) -> DataFrame:
    """Captured and failed payments per day and the share captured, NULL if there were neither."""
    return _outcomes(silver, "event_date")


def city_outcomes(silver: DataFrame) -> DataFrame:
    """`payment_outcomes` per day and city."""
    return _outcomes(silver, "event_date", "city")


def seller_payouts(silver: DataFrame) -> DataFrame:
    """Payouts earned by captures against payouts sent, per day and seller."""
    sums = (
        silver.filter(F.col("event_type").isin(CAPTURED, PAYOUT_SENT))
        .withColumns(
            {
                "payable": F.when(F.col("event_type") == CAPTURED, F.col("seller_payout")).otherwise(0.0),
                "paid": F.when(F.col("event_type") == PAYOUT_SENT, F.col("seller_payout")).otherwise(0.0),
            }
        )
        .groupBy("event_date", "seller_id")
        .agg(
            F.count_if(F.col("event_type") == CAPTURED).alias("captured_count"),
            F.count_if(F.col("event_type") == PAYOUT_SENT).alias("payout_count"),
            *money.partial_sums("payable"),
            *money.partial_sums("paid"),
        )
    )
    return sums.select(
        "event_date",
        "seller_id",
        "captured_count",
        "payout_count",
        money.rounded_sum("payable").alias("payable_total"),
        money.rounded_sum("paid").alias("paid_total"),
    )


def contract_violations(parsed: DataFrame) -> DataFrame:
    """Rows in breach of each contract rule, in one pass; rules that all rows keep are listed too."""
    breaches = rules.contract_violations()
    counts = parsed.withColumn("event_ts", event_time(F.col("event_timestamp"))).agg(
        *[F.count_if(breach).alias(rule) for rule, breach in breaches.items()]
    )
    return counts.unpivot([], list(breaches), "rule", "violations")
