from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from samples import event, payload, records
from tallybrook.contract import BRONZE_SCHEMA, QUARANTINE_SCHEMA
from tallybrook.functions import rules
from tallybrook.functions.timestamps import event_time
from tallybrook.operators import bronze

BAD = '"order_amount": 10.0'

# payload, the three-valued validity flag, the reasons for quarantine
CASES = {
    "base": (payload(), True, None),
    "truncated": (payload()[:40], False, ["no_event_fields"]),
    "empty": ("", False, ["no_event_fields"]),
    "null payload": (None, False, ["no_event_fields"]),
    "json null": ("null", False, ["no_event_fields"]),
    "no fields": ("{}", False, ["no_event_fields"]),
    "array": (f"[{payload()}]", False, ["no_event_fields"]),
    "null amount": (payload(order_amount=None), None, ["missing_order_amount"]),
    "null amount, negative fee": (
        payload(order_amount=None, platform_fee=-1.0),
        False,
        ["missing_order_amount", "negative_platform_fee"],
    ),
    "bad timestamp": (payload(event_timestamp="nope"), False, ["bad_event_timestamp"]),
    "time without date": (payload(event_timestamp="10:00:00"), False, ["bad_event_timestamp"]),
    "amount as text": (payload().replace(BAD, '"order_amount": "10.0"'), None, ["missing_order_amount"]),
    "integers": (payload(order_amount=10, platform_fee=1, seller_payout=9), True, None),
    "not a number": (payload().replace(BAD, '"order_amount": "NaN"'), False, ["payout_mismatch"]),
    "infinite": (
        payload(seller_payout="Infinity").replace(BAD, '"order_amount": "Infinity"'),
        False,
        ["payout_mismatch"],
    ),
    "one cent off": (payload(seller_payout=9.01), True, None),
    "under a cent off": (payload(seller_payout=9.009), True, None),
    "two cents off": (payload(seller_payout=9.02), False, ["payout_mismatch"]),
    "negative payout": (
        payload(order_amount=1.0, platform_fee=2.0, seller_payout=-1.0),
        False,
        ["negative_seller_payout"],
    ),
    "all zero": (payload(order_amount=0.0, platform_fee=0.0, seller_payout=0.0), True, None),
    "extra field": (payload(note="ignored"), True, None),
    "numeric id": (payload(event_id=7), True, None),
    "date only": (payload(event_timestamp="2026-03-13"), True, None),
    "no id": (payload(event_id=None), False, ["missing_event_id"]),
}


@pytest.fixture(scope="module")
def tagged(spark):
    rows = records(spark, [case[0] for case in CASES.values()])
    return bronze.from_records(rows).cache()


@pytest.fixture(scope="module")
def by_payload(tagged):
    flags = {row.raw_value: row.is_valid_record for row in tagged.collect()}
    reasons = {row.raw_value: row.reasons for row in bronze.quarantine_side(tagged).collect()}
    return flags, reasons


@pytest.mark.parametrize("name", CASES)
def test_flag_and_reasons(by_payload, name):
    text, flag, reasons = CASES[name]
    flags, found = by_payload
    assert flags[text] is flag
    assert (text in found) == (flag is not True)
    if reasons is not None:
        assert found[text][: len(reasons)] == reasons


def test_every_record_goes_to_one_side(tagged):
    valid, rejected = bronze.valid_side(tagged), bronze.quarantine_side(tagged)
    assert valid.count() + rejected.count() == len(CASES)
    assert valid.count() == sum(case[1] is True for case in CASES.values())


def test_schemas(tagged):
    assert bronze.valid_side(tagged).columns == BRONZE_SCHEMA.fieldNames()
    rejected = bronze.quarantine_side(tagged)
    kinds = [[field.dataType.simpleString() for field in s] for s in (rejected.schema, QUARANTINE_SCHEMA)]
    assert kinds[0] == kinds[1]


def test_numeric_id_is_text_and_microseconds_stay(spark):
    row = bronze.from_records(records(spark, [payload(event_id=7)])).first()
    assert row.event_id == "7"
    assert row.event_ts.microsecond == 123456


def test_exact_payout_rejects_a_whole_cent(spark):
    rows = records(spark, [payload(seller_payout=9.01), payload(seller_payout=9.009)])
    flags = [row.payout_matches for row in bronze.from_records(rows, exact_payout=True).collect()]
    assert flags == [False, True]


def test_exact_payout_falls_back_for_huge_amounts(spark):
    rows = records(spark, [payload(order_amount=1e300, platform_fee=0.0, seller_payout=1e300)])
    assert bronze.from_records(rows, exact_payout=True).first().is_valid_record is True


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-03-13T10:00:00+05:30", datetime(2026, 3, 13, 4, 30)),
        ("2026-03-13 10:00", datetime(2026, 3, 13, 10, 0)),
        ("2026-3-5", datetime(2026, 3, 5)),
        (" 2026-03-13 ", datetime(2026, 3, 13)),
        ("2026", None),
        ("20260313", None),
        ("T10:00", None),
        ("2026-13-45", None),
        (None, None),
    ],
)
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_event_time(spark, text, expected, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        row = spark.createDataFrame([(text,)], "t string").select(
            F.date_format(event_time(F.col("t")), "yyyy-MM-dd HH:mm").alias("t")
        )
        assert row.first().t == (expected and expected.strftime("%Y-%m-%d %H:%M"))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_dates_are_cut_in_utc(spark):
    rows = bronze.from_records(records(spark, [payload(event_timestamp="2026-03-12T23:30:00-02:00")]))
    assert rows.select(F.to_date("event_ts")).first()[0] == date(2026, 3, 13)


def test_holds_turns_null_into_false(spark):
    row = spark.range(1).select(rules.holds(F.lit(None).cast("boolean")).alias("x")).first()
    assert row.x is False


def test_sample_is_complete():
    assert len(event()) == 13
