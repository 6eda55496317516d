"""Daily states of the Gold metrics that can be changed by deltas.

A state holds, per (day, city, seller), the number of captured payments and their exact sums, and per
(day, customer) the number of payments. A refresh takes the old copies of its events out and puts the
new ones in, so it reads the states of its days and not their events. As sums are exact decimals, any
order of deltas gives what a rebuild gives. Keys whose count falls to 0 go, so counting keys counts
distinct sellers and customers.

Amounts too large for the exact sums are added as doubles, which cannot be taken out again without a
trace; days where a delta has such an amount must be built anew (`has_beyond`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.contract import MONEY_FIELDS
from tallybrook.functions import money
from tallybrook.operators import gold

_SUMS = [f"{name}_{part}" for name in MONEY_FIELDS for part in ("exact", "beyond")]
KEYS = {"sellers": ["event_date", "city", "seller_id"], "customers": ["event_date", "customer_id"]}
SCHEMAS = {
    "sellers": T.StructType(
        [T.StructField("event_date", T.DateType()), T.StructField("city", T.StringType()), T.StructField("seller_id", T.StringType())]
        + [T.StructField("transaction_count", T.LongType())]
        + [T.StructField(name, T.DecimalType(38, 10) if name.endswith("_exact") else T.DoubleType()) for name in _SUMS]
    ),
    "customers": T.StructType(
        [T.StructField("event_date", T.DateType()), T.StructField("customer_id", T.StringType()), T.StructField("transaction_count", T.LongType())]
    ),
}


def _signed(events: DataFrame) -> dict[str, DataFrame]:
    """States of captured events; `sign` is 1 for events put in and -1 for events taken out."""
    payments = gold.captured(events)
    count = F.sum("sign").cast("bigint").alias("transaction_count")
    sums: list[Column] = []
    for name in MONEY_FIELDS:
        amount = F.col(name)
        exact = F.when(F.col("sign") > 0, money.exact(amount)).otherwise(-money.exact(amount))
        sums.append(F.coalesce(F.sum(exact), F.lit(0)).cast("decimal(38,10)").alias(f"{name}_exact"))
        sums.append(F.sum(F.when(money.is_beyond(amount), amount * F.col("sign")).otherwise(0.0)).alias(f"{name}_beyond"))
    return {
        "sellers": payments.groupBy(*KEYS["sellers"]).agg(count, *sums),
        "customers": payments.groupBy(*KEYS["customers"]).agg(count),
    }


def of(events: DataFrame) -> dict[str, DataFrame]:
    """The states of events of Silver."""
    return _signed(events.withColumn("sign", F.lit(1)))


def delta(out: DataFrame, into: DataFrame) -> dict[str, DataFrame]:
    """What changes if the events `out` go and the events `into` come. One that does both changes nothing."""
    return _signed(out.withColumn("sign", F.lit(-1)).unionByName(into.withColumn("sign", F.lit(1))))


def has_beyond() -> Column:
    """Whether an event has an amount that the exact sums cannot hold."""
    return F.greatest(*[money.is_beyond(F.col(name)) for name in MONEY_FIELDS])


def changed(states: DataFrame, change: DataFrame, name: str) -> DataFrame:
    """States after a change of the same kind."""
    sums = [F.sum(column).cast(field.dataType).alias(column) for column, field in ((f.name, f) for f in SCHEMAS[name]) if column not in KEYS[name]]
    after = states.unionByName(change).groupBy(*KEYS[name]).agg(*sums)
    return after.where("transaction_count > 0").select(*SCHEMAS[name].fieldNames())
