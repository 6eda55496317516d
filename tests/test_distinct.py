"""Key sets: distinct counts over any range equal count(DISTINCT) on events, however the days came in."""

from __future__ import annotations

from datetime import date
from random import Random

from pyspark.sql import functions as F

from samples import bronze_table, paid, rows_of
from tallybrook.operators import distinct, gold, silver
from tallybrook.sources import tables


def events(spark, n, seed):
    random = Random(seed)
    rows = [
        paid(10.0, event_id=f"e{k}", city=random.choice(["Austin", "Seattle", None]), seller_id=random.choice([None, *(f"s{j}" for j in range(9))]),
             customer_id=f"c{random.randrange(200)}", event_type=random.choice(["payment_captured", "refund_issued"]),
             event_timestamp=f"2026-0{random.randrange(1, 4)}-0{random.randrange(1, 8)}T00:00:00+00:00")
        for k in range(n)
    ]
    return silver.from_bronze(bronze_table(spark, rows))


def exact(rows, *by):
    counts = [F.count_distinct("seller_id").alias("active_sellers"), F.count_distinct("customer_id").alias("active_customers")]
    return rows_of(gold.captured(rows).select(*by, "seller_id", "customer_id").groupBy(*[b for b in _names(rows, by)]).agg(*counts))


def _names(rows, by):
    return rows.select(*by).columns


def test_ranges_equal_counts_on_events(spark, tmp_path):
    rows = spark.createDataFrame(events(spark, 400, 1).collect())
    keys = tables.KeySets(spark, str(tmp_path / "gold"))
    days = sorted(r[0] for r in rows.select("event_date").distinct().collect())
    for part in (days[10:], days[:10]):
        keys.update(rows.where(F.col("event_date").isin(part)), part)
    month = F.date_format("event_date", "yyyy-MM").alias("month")
    for by in ([month], [month, F.col("city")], [F.col("city")], [F.col("event_date")]):
        assert rows_of(distinct.distinct_counts(keys.bitmaps(), *by)) == exact(rows, *by)
    some = rows.where("event_date BETWEEN '2026-01-03' AND '2026-02-04'")
    assert rows_of(distinct.distinct_counts(keys.bitmaps("2026-01-03", "2026-02-04"), F.col("city"))) == exact(some, F.col("city"))


def test_a_day_that_changes_is_replaced_and_numbers_stay(spark, tmp_path):
    rows = spark.createDataFrame(events(spark, 200, 2).collect())
    keys = tables.KeySets(spark, str(tmp_path / "gold"))
    keys.update(rows)
    before = {(r["kind"], r["key"]): r["number"] for r in keys.dictionary().collect()}
    day = date(2026, 1, 3)
    new = rows.where(F.col("event_date") == day).limit(3).withColumn("customer_id", F.concat(F.lit("new"), "event_id")).withColumn("event_type", F.lit("payment_captured"))
    changed = rows.where(F.col("event_date") != day).unionByName(new)
    keys.update(changed.where(F.col("event_date") == day), [day])
    after = {(r["kind"], r["key"]): r["number"] for r in keys.dictionary().collect()}
    assert before.items() <= after.items() and len(after) == len(before) + 3
    assert len({(k, n) for (k, _), n in after.items()}) == len(after)
    assert rows_of(distinct.distinct_counts(keys.bitmaps(), F.col("event_date"))) == exact(changed, F.col("event_date"))


def test_numbers_beyond_one_bitmap(spark):
    dictionary = spark.range(0, 100_000, 1, 3).select(F.concat(F.lit("c"), "id").alias("key"), (F.col("id") * 3 + 32766).alias("number"), F.lit("customer").alias("kind"))
    rows = spark.range(0, 100_000, 7).select(F.lit("payment_captured").alias("event_type"), F.lit("x").alias("city"), F.lit(None).cast("string").alias("seller_id"),
                                             F.concat(F.lit("c"), "id").alias("customer_id"), F.date_add(F.lit("2026-01-01"), (F.col("id") % 3).cast("int")).alias("event_date"))
    stored = distinct.bitmaps(rows.unionByName(rows), dictionary)
    assert rows_of(distinct.distinct_counts(stored, F.col("city"))) == [(len(range(0, 100_000, 7)), 0, "x")]


def test_no_events(spark, tmp_path):
    keys = tables.KeySets(spark, str(tmp_path / "gold"))
    assert distinct.distinct_counts(keys.bitmaps(), F.col("city")).count() == 0
    keys.update(events(spark, 5, 3).limit(0))
    assert keys.dictionary().count() == 0 and distinct.distinct_counts(keys.bitmaps(), F.col("city")).count() == 0
