"""Validity rules, defined once and used by Bronze, Silver and the contract report.

Every rule is three-valued. Callers that split rows must go through `holds`, because a row whose rule
is NULL satisfies neither the rule nor its negation and would be lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybrook.contract import ALLOWED_VALUES, EVENT_FIELDS, MONEY_FIELDS
from tallybrook.functions import money

PAYOUT_TOLERANCE = 0.01


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def holds(condition: Column) -> Column:
    """The condition as a plain boolean: NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def amounts_non_negative() -> Column:
    return all_of([F.col(name) >= 0 for name in MONEY_FIELDS])


def payout_matches(exact: bool = False) -> Column:
    """The payout is the amount less the fee, to within a cent.

    The default compares doubles, so a payout off by exactly one cent passes or fails by float noise.
    With `exact` the comparison is made in decimals and such a payout always fails.
    """
    amount, fee, payout = (F.col(name) for name in MONEY_FIELDS)
    on_doubles = F.abs(payout - (amount - fee)) < PAYOUT_TOLERANCE
    if not exact:
        return on_doubles
    gap = F.abs(money.exact(payout) - (money.exact(amount) - money.exact(fee)))
    return F.coalesce(gap < F.lit("0.01").cast(money.EXACT), on_doubles)


def one_of(name: str) -> Column:
    return F.col(name).isin(ALLOWED_VALUES[name])


def rejection_reasons() -> dict[str, Column]:
    """Why a Bronze row is not valid, in reporting order; needs the Bronze flag columns."""
    reasons = {"no_event_fields": F.coalesce(*[F.col(n).cast("string") for n in EVENT_FIELDS]).isNull()}
    reasons["missing_event_id"] = F.col("event_id").isNull()
    for name in MONEY_FIELDS:
        reasons[f"missing_{name}"] = F.col(name).isNull()
    for name in MONEY_FIELDS:
        reasons[f"negative_{name}"] = F.col(name) < 0
    reasons["payout_mismatch"] = ~F.col("payout_matches")
    reasons["bad_event_timestamp"] = F.col("event_ts").isNull()
    return reasons


def contract_violations() -> dict[str, Column]:
    """Every contract rule as a condition that is true for a breach; needs `event_ts`."""
    breaches = {f"{name}_null": F.col(name).isNull() for name in EVENT_FIELDS}
    for name in ALLOWED_VALUES:
        breaches[f"{name}_not_allowed"] = ~one_of(name)
    for name in MONEY_FIELDS:
        breaches[f"{name}_negative"] = F.col(name) < 0
    breaches["payout_mismatch"] = ~payout_matches()
    breaches["event_timestamp_unparseable"] = (
        F.col("event_timestamp").isNotNull() & F.col("event_ts").isNull()
    )
    return breaches
