from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

import generated as generate
from samples import bronze_table, event, paid, rows_of
from tallybrook.contract import GOLD_SCHEMAS, SILVER_SCHEMA
from tallybrook.operators import checks, refresh
from tallybrook.plans import jobs, session
from tallybrook.sources import files, kafka, tables, workspace


def put_bronze(spark, path, events):
    bronze_table(spark, events).write.mode("append").partitionBy("ingest_date").parquet(str(path))


def paths(root):
    return [str(root / name) for name in ["bronze", "silver", "gold"]]


EVENTS = [
    paid(10.0, event_id="a"),
    paid(20.0, event_id="b", city="Seattle", seller_id="s2"),
    paid(30.0, event_id="c", event_timestamp="2026-03-14T00:00:00+00:00"),
    event(event_id="d", event_type="payment_failed"),
]


def read_all(spark, root):
    _, silver_path, gold_path = paths(root)
    result = {name: rows_of(tables.read_gold(spark, gold_path, name)) for name in GOLD_SCHEMAS}
    return result | {"silver": rows_of(tables.read_silver(spark, silver_path))}


def test_batch_run_from_foreign_bronze_and_again(spark, tmp_path):
    put_bronze(spark, tmp_path / "bronze", EVENTS)
    jobs.run_batch(spark, *paths(tmp_path))
    first = read_all(spark, tmp_path)
    assert [len(first[name]) for name in [*GOLD_SCHEMAS, "silver"]] == [3, 3, 2, 4]
    jobs.run_batch(spark, *paths(tmp_path))
    assert read_all(spark, tmp_path) == first


def test_full_refresh_drops_days_that_are_gone(spark, tmp_path):
    put_bronze(spark, tmp_path / "bronze", EVENTS)
    jobs.run_batch(spark, *paths(tmp_path))
    # A later copy moves the only event of 14 March to the 16th.
    put_bronze(spark, tmp_path / "bronze", [paid(30.0, event_id="c", event_timestamp="2026-03-16")])
    jobs.run_batch(spark, *paths(tmp_path))
    days = tables.read_gold(spark, paths(tmp_path)[2], "platform_metrics").select("event_date").collect()
    assert sorted(str(row[0]) for row in days) == ["2026-03-13", "2026-03-16"]


def test_silver_schema_and_partition_pruning(spark, tmp_path):
    put_bronze(spark, tmp_path / "bronze", EVENTS)
    jobs.run_silver(spark, *paths(tmp_path)[:2])
    table = tables.read_silver(spark, paths(tmp_path)[1], start="2026-03-14", end="2026-03-14")
    assert table.schema == SILVER_SCHEMA
    assert [row.event_id for row in table.collect()] == ["c"]
    assert len(table.inputFiles()) == 2
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_days_are_not_scattered_over_files(spark, tmp_path):
    many = generate.events(spark, 5000, spacing_micros=60_000_000).repartition(8)
    ready = many.withColumns(
        {
            "kafka_ingest_ts": F.lit("2026-03-13").cast("timestamp"),
            "event_ts": F.try_to_timestamp("event_timestamp"),
            "ingest_date": F.lit("2026-03-13").cast("date"),
        }
    )
    ready.write.partitionBy("ingest_date").parquet(str(tmp_path / "bronze"))
    jobs.run_silver(spark, *paths(tmp_path)[:2])
    written = spark.read.parquet(paths(tmp_path)[1])
    assert written.count() == 5000
    assert len(written.inputFiles()) == written.select("event_date").distinct().count()


@pytest.mark.parametrize("prepare", ["missing", "folder only", "wrong type", "no rows"])
def test_bronze_gate_stops_the_run(spark, tmp_path, prepare):
    bronze_path = tmp_path / "bronze"
    if prepare == "folder only":
        bronze_path.mkdir()
    elif prepare == "wrong type":
        table = bronze_table(spark, EVENTS).withColumn("order_amount", F.lit("ten"))
        table.write.parquet(str(bronze_path))
    elif prepare == "no rows":
        bronze_table(spark, EVENTS).limit(0).write.parquet(str(bronze_path))
    with pytest.raises(checks.CheckFailed, match="bronze_"):
        jobs.run_batch(spark, *paths(tmp_path))
    assert not (tmp_path / "silver").exists()


def gold_values(spark, root):
    silver = tables.read_silver(spark, paths(root)[1])
    report = checks.gold_report(spark, paths(root)[2], silver)
    return {row.check_name: row for row in report.collect()}


def test_gold_report(spark, tmp_path):
    put_bronze(spark, tmp_path / "bronze", EVENTS + [paid(1.005, fee=0.5, event_id="f")])
    jobs.run_batch(spark, *paths(tmp_path))
    report = gold_values(spark, tmp_path)
    assert report["seller_metrics_rows"].value == 3
    assert report["captured_rows_with_fraction_of_cent"].value == 1
    assert report["captured_rows_beyond_exact_sums"].value == 0
    assert all(row.passed for row in report.values() if row.severity == "error")


def test_gold_report_finds_a_changed_table(spark, tmp_path):
    put_bronze(spark, tmp_path / "bronze", EVENTS)
    jobs.run_batch(spark, *paths(tmp_path))
    gold_path = paths(tmp_path)[2]
    sellers = tables.read_gold(spark, gold_path, "seller_metrics").filter("event_date = '2026-03-14'")
    changed = sellers.withColumn("gross_sales", F.col("gross_sales") + 1)
    rows = spark.createDataFrame(changed.collect(), changed.schema)
    rows.write.mode("append").partitionBy("event_date").parquet(f"{gold_path}/seller_metrics")
    report = gold_values(spark, tmp_path)
    failed = {name for name, row in report.items() if not row.passed and row.severity == "error"}
    assert failed == {
        "seller_metrics_repeated_keys",
        "seller_metrics_days_with_other_count",
        "seller_metrics_days_with_other_money",
    }


def test_gold_report_finds_a_missing_table(spark, tmp_path):
    with pytest.raises(checks.CheckFailed, match="city_metrics_readable"):
        checks.require(checks.gold_report(spark, str(tmp_path)))


def test_command_line():
    with pytest.raises(SystemExit) as stopped:
        jobs.parser().parse_args(["bronze"])
    assert stopped.value.code == 2
    options = vars(jobs.parser().parse_args(["bronze", "--bootstrap-servers", "h:1"]))
    assert options == {
        "job": "bronze",
        "bootstrap_servers": "h:1",
        "topic": "marketplace-payments",
        "output_path": "data/bronze",
        "checkpoint_path": "data/checkpoints/bronze_kafka_consumer",
        "starting_offsets": "latest",
        "max_offsets_per_trigger": None,
        "min_partitions": None,
        "available_now": False,
        "processing_time": None,
        "exact_payout": False,
    }
    options = jobs.parser().parse_args(["refresh", "--start", "2026-03-13", "--exact-payout"])
    assert (options.start, options.end, options.exact_payout) == ("2026-03-13", None, True)
    assert jobs.parser().parse_args(["compact", "--ingest-date", "2026-03-12"]).bronze_path == "data/bronze"


def test_only_closed_days_are_compacted(spark, tmp_path):
    with pytest.raises(ValueError, match="not over"):
        jobs.run_compact(spark, "2999-01-01", str(tmp_path))


def test_kafka_options():
    assert kafka.read_options("h:1") == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "marketplace-payments",
        "startingOffsets": "latest",
    }
    more = kafka.read_options("h:1", "t", "earliest", max_offsets_per_trigger=9, min_partitions=4)
    assert (more["startingOffsets"], more["maxOffsetsPerTrigger"], more["minPartitions"]) == ("earliest", "9", "4")
    sink = kafka.write_options("h:1", "t")
    assert (sink["kafka.acks"], sink["kafka.retries"], sink["kafka.linger.ms"]) == ("all", "5", "10")


def test_recorded_payloads_read_back(spark, tmp_path):
    sent = generate.events(spark, 100)
    recorded = kafka.encode(sent).select(
        F.col("value").cast("binary"), F.lit("2026-03-13").cast("timestamp").alias("timestamp")
    )
    recorded.write.parquet(str(tmp_path / "records"))
    from tallybrook.operators import bronze

    decoded = bronze.decode(files.read_records(spark, str(tmp_path / "records")))
    assert rows_of(decoded.select(*sent.columns)) == rows_of(sent)


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    put_bronze(spark, tmp_path / "bronze", EVENTS)
    jobs.run_batch(spark, *paths(tmp_path))
    first = read_all(spark, tmp_path)
    _, silver_path, gold_path = paths(tmp_path)
    for table, write in [
        (tables.read_silver(spark, silver_path), lambda t: tables.write_silver(t, silver_path)),
        (tables.read_gold(spark, gold_path, "city_metrics"), lambda t: tables.write_gold(t, gold_path, "city_metrics")),
    ]:
        late = F.when(F.col("event_date") == "2026-03-14", F.raise_error(F.lit("lost midway"))).otherwise(F.col("city"))
        with pytest.raises(Exception, match="lost midway"):
            write(table.withColumn("city", late.cast("string")))
    assert read_all(spark, tmp_path) == first
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bronze", "gold", "silver"]


LATER = [
    paid(31.0, event_id="c", event_timestamp="2026-03-16T00:00:00+00:00"),
    paid(5.0, event_id="a", event_timestamp="2026-03-01T00:00:00+00:00"),
    paid(7.0, event_id="n", event_timestamp="2026-03-16T01:00:00+00:00"),
]


def test_refresh_equals_a_rebuild_and_touches_only_its_days(spark, tmp_path):
    put_bronze(spark, tmp_path / "one" / "bronze", EVENTS)
    jobs.run_batch(spark, *paths(tmp_path / "one"))
    untouched = sorted((tmp_path / "one").rglob("event_date=2026-03-13/*.parquet"))
    later = bronze_table(spark, LATER).withColumn("ingest_date", F.lit("2027-01-01").cast("date"))
    later.write.mode("append").partitionBy("ingest_date").parquet(str(tmp_path / "one" / "bronze"))
    days = jobs.run_refresh(spark, *paths(tmp_path / "one"), start="2027-01-01")
    assert [str(day) for day in days] == ["2026-03-01", "2026-03-13", "2026-03-14", "2026-03-16"]
    spark.read.parquet(str(tmp_path / "one" / "bronze")).write.partitionBy("ingest_date").parquet(str(tmp_path / "two" / "bronze"))
    jobs.run_batch(spark, *paths(tmp_path / "two"))
    assert read_all(spark, tmp_path / "one") == read_all(spark, tmp_path / "two")
    assert not list((tmp_path / "one").rglob("event_date=2026-03-14"))
    assert untouched and jobs.run_refresh(spark, *paths(tmp_path / "one"), start="2030-01-01") == []


def test_refresh_reads_only_its_days(spark, tmp_path):
    put_bronze(spark, tmp_path / "bronze", EVENTS)
    jobs.run_silver(spark, *paths(tmp_path)[:2])
    current = tables.read_silver(spark, paths(tmp_path)[1])
    plan = refresh.refreshed(current.limit(0), current, [date(2026, 3, 14)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "2026-03-14" in plan


def test_configure_pins_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    session.configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_folders_are_new_and_shared(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    one, two = workspace.new_folder(spark, "x"), workspace.new_folder(spark, "x")
    assert one != two and one.startswith(shared)


def test_bronze_of_a_table_in_one_row_group_is_written_by_many_tasks(spark, sf_dir, monkeypatch):
    from tallybrook.plans import queries
    from tallybrook.sources import lanes

    for job in ("run_batch", "run_refresh"):
        monkeypatch.setattr(queries.jobs, job, lambda *_, **__: None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        silver_path, _ = queries._refreshed(spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = spark.read.parquet(silver_path.removesuffix("/silver") + "/bronze")
    names = written.select("ingest_date", F.input_file_name().alias("file")).distinct().groupBy("ingest_date").count()
    days = {str(r["ingest_date"]): r["count"] for r in names.collect()}
    assert days == {"2026-01-01": 4, "2026-01-02": 4}  # spark.sql.shuffle.partitions of the tests
    plain, dealt = lanes.lane_c(spark, sf_dir), lanes.lane_c(spark, sf_dir, spread=True)
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()
