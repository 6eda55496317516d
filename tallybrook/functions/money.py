"""Money aggregation that does not depend on row order or partitioning.

A sum of doubles depends on the order of its terms, so the last cent of `round(sum(x), 2)` changes
with the partitioning. Amounts are therefore added as decimals with ten fraction digits, which holds
every amount below 10^18 and their sums below 10^28, and rounded half-up to cents once, at the end.
Digits below 10^-10 are cut; there, doubles of cents hold nothing but noise. Where the double sum
lands on the other side of a half cent, the result differs from it by one cent, on purpose.

What the type cannot hold (amounts from 10^18 up, where a double has no cents) is added as doubles
beside it, so no row is lost; `checks` counts such rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(28,10)"


def exact(amount: Column) -> Column:
    """The amount as a decimal; NULL if the type cannot hold it."""
    return amount.try_cast(EXACT)


def is_beyond(amount: Column) -> Column:
    return amount.isNotNull() & exact(amount).isNull()


def has_fraction_of_cent(amount: Column) -> Column:
    scaled = amount * 100.0
    return F.abs(scaled - F.rint(scaled)) > 1e-4


def partial_sums(name: str) -> list[Column]:
    """First-level aggregates of one money column."""
    amount = F.col(name)
    return [
        F.coalesce(F.sum(exact(amount)), F.lit(0)).cast("decimal(38,10)").alias(f"{name}_exact"),
        F.sum(F.when(is_beyond(amount), amount).otherwise(0.0)).alias(f"{name}_beyond"),
    ]


def merged_sums(name: str) -> list[Column]:
    """Aggregates that add up the results of `partial_sums` at a coarser grain."""
    return [
        F.sum(f"{name}_exact").alias(f"{name}_exact"),
        F.sum(f"{name}_beyond").alias(f"{name}_beyond"),
    ]


def rounded_sum(name: str) -> Column:
    """`round(sum(x), 2)` from the sums above."""
    total, beyond = F.col(f"{name}_exact"), F.col(f"{name}_beyond")
    return F.when(beyond == 0, F.round(total, 2).cast("double")).otherwise(
        F.round(total.cast("double") + beyond, 2)
    )


def rounded_average(name: str, rows: Column) -> Column:
    """`round(avg(x), 2)` from the sums above and the number of rows in them.

    The quotient has ten digits. Where they were rounded up to a half cent, rounding once more would
    give a cent too much; the product with the number of rows shows it.
    """
    total, beyond = F.col(f"{name}_exact"), F.col(f"{name}_beyond")
    cents = F.round(total / rows.cast("decimal(13,0)"), 2).cast("decimal(28,3)")
    half, cent = F.lit("0.005").cast("decimal(4,3)"), F.lit("0.010").cast("decimal(4,3)")
    # cast to the sum's own type: in a comparison of unlike decimals Spark gives up fraction digits
    least = ((cents - half).cast("decimal(28,3)") * rows.cast("decimal(13,0)")).cast("decimal(38,10)")
    average = F.when(least > total, cents - cent).otherwise(cents)
    return F.when(beyond == 0, average.cast("double")).otherwise(
        F.round((total.cast("double") + beyond) / rows, 2)
    )
