from __future__ import annotations

from datetime import date, datetime, timezone

import pytest

from samples import bronze_table, event, paid, rows_of
from tallybrook.contract import SILVER_SCHEMA
from tallybrook.operators import silver
from tallybrook.sources import lanes


def test_rules_are_applied_again(spark):
    kept = [event(event_id="ok"), event(event_id="zero", order_amount=0.0, platform_fee=0.0, seller_payout=0.0)]
    dropped = [
        event(event_id=None),
        event(event_id="ts", event_timestamp="nope"),
        event(event_id="neg", order_amount=-1.0, seller_payout=-2.0),
        event(event_id="null", seller_payout=None),
        event(event_id="off", seller_payout=8.0),
        event(event_id="nan", order_amount=float("nan")),
    ]
    result = silver.from_bronze(bronze_table(spark, kept + dropped))
    assert sorted(row.event_id for row in result.collect()) == ["ok", "zero"]
    assert result.columns == SILVER_SCHEMA.fieldNames()


def test_latest_copy_wins_across_days(spark):
    copies = [
        event(event_timestamp="2026-03-13T10:00:00+00:00", city="Austin"),
        event(event_timestamp="2026-03-15T09:00:00+00:00", city="Seattle"),
        event(event_timestamp="2026-03-14T10:00:00+00:00", city="Phoenix"),
    ]
    row = silver.from_bronze(bronze_table(spark, copies)).collect()
    assert [(r.city, r.event_date) for r in row] == [("Seattle", date(2026, 3, 15))]


def test_an_invalid_later_copy_does_not_win(spark):
    copies = [event(city="Austin"), event(event_timestamp="2026-03-20T00:00:00+00:00", seller_payout=1.0)]
    assert [r.city for r in silver.from_bronze(bronze_table(spark, copies)).collect()] == ["Austin"]


def test_an_unreadable_time_never_wins(spark):
    late = datetime(2027, 1, 1, tzinfo=timezone.utc)
    copies = [
        event(city="Austin"),
        event(event_timestamp="nope", city="Seattle", kafka_ingest_ts=late),
        event(event_timestamp=None, city="Chicago", kafka_ingest_ts=late),
        event(event_id="e2", event_timestamp="nope"),
    ]
    rows = silver.from_bronze(bronze_table(spark, copies)).collect()
    assert [(row.event_id, row.city) for row in rows] == [("e1", "Austin")]


def test_ties_fall_to_arrival_then_amount_then_names(spark):
    early, late = (datetime(2026, 3, 13, hour, tzinfo=timezone.utc) for hour in (11, 12))
    copies = [
        paid(10.0, event_id="arrival", kafka_ingest_ts=early, city="old"),
        paid(5.0, event_id="arrival", kafka_ingest_ts=late, city="new"),
        paid(10.0, event_id="amount", city="small"),
        paid(11.0, event_id="amount", city="large"),
        event(event_id="name", seller_id="b", city="Austin"),
        event(event_id="name", seller_id="a", city="Seattle"),
        event(event_id="city", city="Seattle"),
        event(event_id="city", city="Austin"),
    ]
    result = {row.event_id: row.city for row in silver.from_bronze(bronze_table(spark, copies)).collect()}
    assert result == {"arrival": "new", "amount": "large", "name": "Seattle", "city": "Austin"}


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_result_does_not_depend_on_partitioning(spark, sf_dir, partitions):
    from pyspark.sql import functions as F

    events = lanes.lane_l(spark, sf_dir).withColumn("ingest_date", F.to_date("kafka_ingest_ts"))
    expected = rows_of(silver.from_bronze(events))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows_of(silver.from_bronze(events.repartition(13, "order_category"))) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(expected) == 4599


def test_one_id_with_a_third_of_all_rows(spark):
    from pyspark.sql import functions as F

    many = spark.range(0, 30000, 1, 8)
    template = bronze_table(spark, [event()]).drop("event_id", "city")
    copies = (
        many.crossJoin(F.broadcast(template))
        .withColumn("event_id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), "id")))
        .withColumn("city", F.format_string("city_%05d", 30000 - F.col("id")))
    )
    result = silver.from_bronze(copies)
    assert result.count() == 20001
    assert result.filter("event_id = 'hot'").first().city == "city_00003"
