"""The physical plans that matter at scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import generated as generate
from samples import bronze_table, event
from tallybrook.operators import bronze, gold, silver
from tallybrook.plans.queries import registered
from tallybrook.sources import lanes, tables


def plan_of(table) -> str:
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("silver"))
    tables.write_silver(silver.from_bronze(bronze_table(spark, [event()])), path)
    return tables.read_silver(spark, path)


def test_json_is_parsed_once_and_nothing_is_shuffled(spark, sf_dir):
    tagged = bronze.from_records(lanes.as_records(lanes.lane_p(spark, sf_dir)))
    for side in [bronze.valid_side, bronze.quarantine_side]:
        plan = plan_of(side(tagged))
        assert plan.count("from_json(") == 1
        assert "Exchange" not in plan


def test_dedup_limits_each_id_before_its_only_shuffle(spark):
    plan = plan_of(silver.from_bronze(bronze_table(spark, [event()])))
    assert plan.count("Exchange") == 1
    assert plan.count("WindowGroupLimit") == 2
    assert plan.count("RLIKE") == 1
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_silver_filters_reach_the_scan(spark, tmp_path):
    bronze_table(spark, [event()]).write.partitionBy("ingest_date").parquet(str(tmp_path / "b"))
    plan = plan_of(silver.from_bronze(tables.read_bronze(spark, str(tmp_path / "b"))))
    pushed = plan[plan.index("PushedFilters") :]
    for name in ["event_id", "order_amount", "platform_fee", "seller_payout"]:
        assert name in pushed


@pytest.mark.parametrize(
    "metrics, columns",
    [
        (gold.seller_metrics, {"seller_id", "event_type", "order_amount", "platform_fee", "seller_payout"}),
        (gold.city_metrics, {"seller_id", "city", "event_type", "order_amount", "platform_fee"}),
    ],
)
def test_gold_reads_few_columns(stored, metrics, columns):
    plan = plan_of(metrics(stored))
    schema = plan[plan.index("ReadSchema: struct<") + 19 :]
    found = {field.split(":")[0] for field in schema[: schema.index(">")].split(",")}
    assert found == columns
    assert "EqualTo(event_type,payment_captured)" in plan


def test_platform_metrics_neither_expands_nor_joins(stored):
    plan = plan_of(gold.platform_metrics(stored))
    assert "Expand" not in plan and "Join" not in plan and "dynamicpruning" not in plan


def test_no_query_uses_python_workers_or_cross_joins(spark, sf_dir):
    lazy = {"bronze_ready", "gold_checks", "batch_run", "stream_bronze", "stream_quarantine"}
    for name, query in registered().items():
        if name not in lazy:
            plan = plan_of(query(spark, sf_dir))
            for operator in ["Python", "Cartesian", "NestedLoop"]:
                assert operator not in plan, name


def test_large_day_is_split_over_tasks(spark, tmp_path):
    """With a small target size, a day of some megabytes must not end in one file."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        one_day = generate.events(spark, 60000, spacing_micros=1).withColumns(
            {
                "kafka_ingest_ts": F.lit("2026-03-13").cast("timestamp"),
                "ingest_date": F.lit("2026-03-13").cast("date"),
            }
        )
        tables.write_silver(silver.from_bronze(one_day), str(tmp_path / "s"))
        written = spark.read.parquet(str(tmp_path / "s"))
        assert written.count() == 60000
        assert len(written.inputFiles()) > 2
    finally:
        spark.conf.set(key, before)
