"""Settlement against a ledger that is worked off payout by payout."""

from __future__ import annotations

from collections import defaultdict, deque
from decimal import Decimal
from random import Random

import pytest
from pyspark.sql import functions as F

from samples import bronze_table, event
from tallybrook.operators import settlement, silver


def paid_out(amount, **changes):
    return event(order_amount=amount, platform_fee=0.0, seller_payout=amount, **changes)


def stored(spark, events):
    return silver.from_bronze(bronze_table(spark, events))


def ledger(rows):
    """rows: dicts of Silver. (seller, capture, payout) -> amount, what stays open per capture, and what was paid ahead."""
    matched, open_, ahead = {}, {}, {}
    by_seller = defaultdict(list)
    for r in rows:
        if r["seller_id"] is not None and r["seller_payout"] > 0 and r["event_type"] in ("payment_captured", "payout_sent"):
            by_seller[r["seller_id"]].append(r)
    for seller, own in by_seller.items():
        own.sort(key=lambda r: (r["event_ts"], r["event_id"]))
        waiting = deque([r["event_id"], Decimal(repr(r["seller_payout"]))] for r in own if r["event_type"] == "payment_captured")
        rest = Decimal(0)
        for payout in (r for r in own if r["event_type"] == "payout_sent"):
            rest = Decimal(repr(payout["seller_payout"]))
            while rest and waiting:
                part = min(rest, waiting[0][1])
                key = (seller, waiting[0][0], payout["event_id"])
                matched[key] = matched.get(key, 0) + part
                rest -= part
                waiting[0][1] -= part
                if not waiting[0][1]:
                    waiting.popleft()
            ahead[seller] = ahead.get(seller, 0) + rest
        open_ |= {capture: amount for capture, amount in waiting}
    return matched, open_, ahead


def random_events(n, seed):
    random = Random(seed)
    return [
        paid_out(
            random.choice([0.0, 0.01, 10.0, 10.0, 33.33, 250.5, 9999.99]),
            event_id=f"e{k:04}",
            seller_id="hot" if random.random() < 0.5 else random.choice(["s1", "s2", "s3", None]),
            event_type=random.choice(["payment_captured", "payment_captured", "payout_sent", "payment_failed"]),
            event_timestamp=f"2026-0{random.randrange(1, 4)}-{random.randrange(1, 28):02}T0{random.randrange(3)}:00:00+00:00",
        )
        for k in range(n)
    ]


@pytest.mark.parametrize("stretch_rows", [3, 50, 4000])
def test_matches_and_open_amounts_equal_a_ledger(spark, monkeypatch, stretch_rows):
    monkeypatch.setattr(settlement, "STRETCH_ROWS", stretch_rows)
    rows = spark.createDataFrame(stored(spark, random_events(300, stretch_rows)).collect())
    matched, open_, ahead = ledger([r.asDict() for r in rows.collect()])
    found = {(r["seller_id"], r["capture_id"], r["payout_id"]): r["amount"] for r in settlement.matches(rows).collect()}
    assert found == matched and len(matched) > 50
    last = max(r["event_date"] for r in rows.collect())
    expected = defaultdict(lambda: [Decimal(0)] * 3)
    for r in rows.collect():
        if r["event_id"] in open_:
            age = (last - r["event_date"]).days
            expected[r["seller_id"]][0 if age <= 7 else 1 if age <= 30 else 2] += open_[r["event_id"]]
    for r in settlement.open_by_age(rows).collect():
        sums = [Decimal(repr(r[c])) for c in ("open_0_to_7", "open_8_to_30", "open_over_30")]
        assert [round(x, 2) for x in sums] == [round(x, 2) for x in expected[r["seller_id"]]]
        assert round(Decimal(repr(r["paid_ahead"])), 2) == round(ahead.get(r["seller_id"], Decimal(0)), 2)


def test_one_payout_for_all_and_payouts_without_captures(spark):
    many = [paid_out(1.0, event_id=f"c{k}", event_timestamp=f"2026-03-0{k + 1}") for k in range(5)]
    rows = stored(spark, [*many, paid_out(7.5, event_id="p", event_type="payout_sent"), paid_out(2.0, event_id="q", event_type="payout_sent", seller_id="s9")])
    assert {r["capture_id"]: (r["payout_id"], r["amount"]) for r in settlement.matches(rows).collect()} == {f"c{k}": ("p", 1) for k in range(5)}
    assert {r["seller_id"]: r["paid_ahead"] for r in settlement.open_by_age(rows).collect()} == {"s1": 2.5, "s9": 2.0}


def test_no_pairs_are_compared(spark):
    rows = stored(spark, random_events(20, 1))
    plan = settlement.matches(rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_events(spark):
    rows = stored(spark, random_events(5, 1)).limit(0)
    assert settlement.matches(rows).count() == 0
    assert settlement.open_by_age(rows.withColumn("event_date", F.col("event_date"))).count() == 0


def test_open_amounts_take_one_pass_over_silver(spark):
    rows = stored(spark, random_events(200, seed=5))
    kept = rows.select("event_id").collect()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = rows.mapInArrow(count, rows.schema)
    assert settlement.open_by_age(counted).collect()
    assert seen.value == len(kept)


def test_the_last_day_may_be_one_that_settles_nothing(spark):
    late = {"event_type": "payment_failed", "event_timestamp": "2026-03-30T00:00:00.000000+00:00"}
    early = {"event_type": "payment_captured", "event_timestamp": "2026-03-01T00:00:00.000000+00:00"}
    rows = stored(spark, [event(event_id="a", **early), event(event_id="b", **late)])
    (row,) = settlement.open_by_age(rows).collect()
    assert row["open_0_to_7"] == 0 and row["open_8_to_30"] > 0 and row["open_over_30"] == 0
