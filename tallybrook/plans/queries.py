"""Queries over the test tables, one per operator or table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.contract import EVENT_FIELDS
from tallybrook.functions import rules
from tallybrook.operators import bronze, checks, distinct, gold, reports, settlement, silver
from tallybrook.plans import jobs, session
from tallybrook.sources import files, intents, kafka, lanes, tables, workspace
from tallybrook.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.as_records(lanes.lane_p(spark, sf_dir))


def _bronze_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane P through the JSON encoding and back, flagged."""
    return bronze.from_records(_records(spark, sf_dir))


def _silver_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.from_bronze(bronze.valid_side(_bronze_p(spark, sf_dir)))


def _silver_of(lane: DataFrame) -> DataFrame:
    return silver.from_bronze(lane.withColumn("ingest_date", F.to_date("kafka_ingest_ts")))


def _silver_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver_of(lanes.lane_l(spark, sf_dir))


def _as_text(timestamp: str):
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(timestamp)


def _bronze_columns(rows: DataFrame, *extra) -> DataFrame:
    """Bronze without `ingest_date`, which is today, and with zone-free timestamps."""
    return rows.select(*EVENT_FIELDS, _as_text("kafka_ingest_ts"), _as_text("event_ts"), *extra)


def bronze_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ["is_amount_positive", "payout_matches", "is_valid_record"]
    rows = _bronze_p(spark, sf_dir)
    return rows.select("event_id", *[rules.holds(F.col(flag)).alias(flag) for flag in flags])


def bronze_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_columns(bronze.valid_side(_bronze_p(spark, sf_dir)))


def bronze_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = bronze.quarantine_side(_bronze_p(spark, sf_dir))
    payload_id = F.get_json_object("raw_value", "$.event_id").alias("payload_event_id")
    return _bronze_columns(rejected, F.concat_ws(",", "reasons").alias("reasons"), payload_id)


def kafka_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kafka.encode(lanes.lane_p(spark, sf_dir))


def _silver_columns(rows: DataFrame) -> DataFrame:
    return _bronze_columns(rows, "event_date")


def silver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver_columns(_silver_p(spark, sf_dir))


def silver_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver_columns(_silver_l(spark, sf_dir))


def _on_lane_p(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_silver_p(spark, sf_dir))


def _on_lane_l(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_silver_l(spark, sf_dir))


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.contract_violations(bronze.decode(_records(spark, sf_dir)))


def _stream(spark: SparkSession, sf_dir: str) -> str:
    """Run lane P through the stream and give the Bronze path."""
    source = workspace.new_folder(spark, "records")
    _records(spark, sf_dir).write.parquet(source)
    target = f"{workspace.new_folder(spark, 'stream')}/bronze"
    query = ingest.start(
        files.stream_records(spark, source),
        target,
        workspace.new_folder(spark, "checkpoint"),
        available_now=True,
    )
    query.awaitTermination()
    return target


def stream_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_columns(tables.read_bronze(spark, _stream(spark, sf_dir)))


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = tables.read_quarantine(spark, _stream(spark, sf_dir))
    return _bronze_columns(rejected, F.concat_ws(",", "reasons").alias("reasons"))


def _written_bronze(spark: SparkSession, sf_dir: str) -> str:
    path = f"{workspace.new_folder(spark, 'tables')}/bronze"
    tables.write_batch(bronze.valid_side(_bronze_p(spark, sf_dir)), path, "batch", 0, "ingest_date")
    return path


def _put_bronze(events: DataFrame, path: str, ingest_date: str, batch_id: int) -> None:
    rows = bronze.valid_side(bronze.from_records(lanes.as_records(events)))
    rows = rows.withColumn("ingest_date", F.lit(ingest_date).cast("date"))
    tables.write_batch(rows, path, "batch", batch_id, "ingest_date")


def bronze_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.bronze_report(spark, _written_bronze(spark, sf_dir))


def _paths_beside(bronze_path: str) -> tuple[str, str]:
    root = bronze_path.removesuffix("/bronze")
    return f"{root}/silver", f"{root}/gold"


def gold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze_path = _written_bronze(spark, sf_dir)
    silver_path, gold_path = _paths_beside(bronze_path)
    jobs.run_silver(spark, bronze_path, silver_path)
    jobs.run_gold(spark, silver_path, gold_path)
    return checks.gold_report(spark, gold_path, tables.read_silver(spark, silver_path))


def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze_path = _written_bronze(spark, sf_dir)
    silver_path, gold_path = _paths_beside(bronze_path)
    jobs.run_batch(spark, bronze_path, silver_path, gold_path)
    return tables.read_gold(spark, gold_path, "platform_metrics")


def _rebuilt(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Silver and Gold of lane C, built by the batch job."""
    bronze_path = f"{workspace.new_folder(spark, 'tables')}/bronze"
    _put_bronze(lanes.lane_c(spark, sf_dir, spread=True), bronze_path, "2026-01-01", 0)
    jobs.run_batch(spark, bronze_path, *_paths_beside(bronze_path))
    return _paths_beside(bronze_path)


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The same in two parts: lane P by the batch job, then its later copies by a refresh."""
    bronze_path = f"{workspace.new_folder(spark, 'tables')}/bronze"
    _put_bronze(lanes.lane_p(spark, sf_dir, spread=True), bronze_path, "2026-01-01", 0)
    jobs.run_batch(spark, bronze_path, *_paths_beside(bronze_path))
    _put_bronze(lanes.later_copies(spark, sf_dir, spread=True), bronze_path, "2026-01-02", 1)
    jobs.run_refresh(spark, bronze_path, *_paths_beside(bronze_path), start="2026-01-02")
    return _paths_beside(bronze_path)


def _refreshed_after_a_death(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The same, where the first refresh got as far as Silver: its Gold is that of before."""
    bronze_path = f"{workspace.new_folder(spark, 'tables')}/bronze"
    silver_path, gold_path = _paths_beside(bronze_path)
    _put_bronze(lanes.lane_p(spark, sf_dir, spread=True), bronze_path, "2026-01-01", 0)
    jobs.run_batch(spark, bronze_path, silver_path, gold_path)
    _put_bronze(lanes.later_copies(spark, sf_dir, spread=True), bronze_path, "2026-01-02", 1)
    nowhere = f"{workspace.new_folder(spark, 'tables')}/gold"
    days = jobs.run_refresh(spark, bronze_path, silver_path, nowhere, start="2026-01-02")
    intents.store(spark, silver_path, intents.Intent(tuple(map(str, days)), "2026-01-02", None))
    jobs.run_refresh(spark, bronze_path, silver_path, gold_path, start="2030-01-01")
    return silver_path, gold_path


def _changed_by_deltas(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The same, with Gold from states that the refresh changes by what goes and what comes."""
    bronze_path = f"{workspace.new_folder(spark, 'tables')}/bronze"
    silver_path, gold_path = _paths_beside(bronze_path)
    _put_bronze(lanes.lane_p(spark, sf_dir, spread=True), bronze_path, "2026-01-01", 0)
    jobs.run_silver(spark, bronze_path, silver_path)
    jobs.run_gold(spark, silver_path, gold_path, states=True)
    _put_bronze(lanes.later_copies(spark, sf_dir, spread=True), bronze_path, "2026-01-02", 1)
    jobs.run_refresh(spark, bronze_path, silver_path, gold_path, start="2026-01-02")
    return silver_path, gold_path


def _key_sets(spark: SparkSession, sf_dir: str, lane: DataFrame) -> DataFrame:
    """Bitmaps of a lane's Silver, stored in two parts, the later days first."""
    root = workspace.new_folder(spark, "tables")
    valid = bronze.valid_side(bronze.from_records(lanes.as_records(lane)))
    tables.write_silver(silver.from_bronze(valid), f"{root}/silver")
    stored = tables.read_silver(spark, f"{root}/silver")
    days = sorted(row.event_date for row in stored.select("event_date").distinct().collect())
    half = len(days) // 2
    for part in (days[half:], days[:half]):
        jobs.run_keys(spark, f"{root}/silver", f"{root}/gold", part)
    return tables.KeySets(spark, f"{root}/gold").bitmaps()


def distinct_by_month_and_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("event_date", "yyyy-MM").alias("month")
    return distinct.distinct_counts(_key_sets(spark, sf_dir, lanes.lane_p(spark, sf_dir)), month, F.col("city"))


def distinct_over_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_counts(_key_sets(spark, sf_dir, lanes.lane_p(spark, sf_dir)), F.col("city"))


def _matches(rows: DataFrame) -> DataFrame:
    return settlement.matches(rows).withColumn("amount", F.round("amount", 2).cast("double"))


def silver_former_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver of lane P, read as version 1 after a refresh wrote version 2 over it."""
    bronze_path = f"{workspace.new_folder(spark, 'tables')}/bronze"
    silver_path, gold_path = _paths_beside(bronze_path)
    _put_bronze(lanes.lane_p(spark, sf_dir, spread=True), bronze_path, "2026-01-01", 0)
    jobs.run_batch(spark, bronze_path, silver_path, gold_path)
    _put_bronze(lanes.later_copies(spark, sf_dir, spread=True), bronze_path, "2026-01-02", 1)
    jobs.run_refresh(spark, bronze_path, silver_path, gold_path, start="2026-01-02", keep_versions=2)
    return _silver_columns(tables.read_silver(spark, silver_path, version=1))


Build = Callable[[SparkSession, str], tuple[str, str]]


def _stored_silver(build: Build) -> Query:
    return lambda spark, sf_dir: _silver_columns(tables.read_silver(spark, build(spark, sf_dir)[0]))


def _stored_gold(build: Build, table: str) -> Query:
    return lambda spark, sf_dir: tables.read_gold(spark, build(spark, sf_dir)[1], table)


def bronze_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a Bronze table whose amounts are text."""
    path = f"{workspace.new_folder(spark, 'tables')}/bronze"
    rows = bronze.valid_side(_bronze_p(spark, sf_dir))
    rows.withColumn("order_amount", F.col("order_amount").cast("string")).write.parquet(path)
    return checks.bronze_report(spark, path)


def gold_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on Gold with the last day's sellers twice, dearer by one, and no city table."""
    bronze_path = _written_bronze(spark, sf_dir)
    silver_path, gold_path = _paths_beside(bronze_path)
    jobs.run_silver(spark, bronze_path, silver_path)
    jobs.run_gold(spark, silver_path, gold_path)
    damaged = f"{gold_path}_damaged"
    sellers = tables.read_gold(spark, gold_path, "seller_metrics")
    last = sellers.join(sellers.agg(F.max("event_date").alias("event_date")), "event_date", "left_semi")
    copies = last.withColumn("gross_sales", F.col("gross_sales") + 1)
    tables.write_gold(sellers.unionByName(copies), damaged, "seller_metrics")
    platform = tables.read_gold(spark, gold_path, "platform_metrics")
    tables.write_gold(platform, damaged, "platform_metrics")
    return checks.gold_report(spark, damaged, tables.read_silver(spark, silver_path))


_QUERIES: dict[str, Query] = {
    "bronze_flags": bronze_flags,
    "bronze_valid": bronze_valid,
    "bronze_quarantine": bronze_quarantine,
    "kafka_payload": kafka_payload,
    "silver_events": silver_events,
    "silver_dedup": silver_dedup,
    "gold_seller_metrics": _on_lane_p(gold.seller_metrics),
    "gold_city_metrics": _on_lane_p(gold.city_metrics),
    "gold_platform_metrics": _on_lane_p(gold.platform_metrics),
    "gold_seller_metrics_l": _on_lane_l(gold.seller_metrics),
    "gold_city_metrics_l": _on_lane_l(gold.city_metrics),
    "gold_platform_metrics_l": _on_lane_l(gold.platform_metrics),
    "payment_outcomes": _on_lane_p(reports.payment_outcomes),
    "city_outcomes": _on_lane_p(reports.city_outcomes),
    "seller_payouts": _on_lane_p(reports.seller_payouts),
    "seller_payouts_l": _on_lane_l(reports.seller_payouts),
    "contract_violations": contract_violations,
    "stream_bronze": stream_bronze,
    "stream_quarantine": stream_quarantine,
    "bronze_ready": bronze_ready,
    "gold_checks": gold_checks,
    "batch_run": batch_run,
    "gold_seller_metrics_fine": lambda spark, sf_dir: gold.seller_metrics(
        _silver_of(lanes.lane_f(spark, sf_dir))
    ),
    "gold_platform_metrics_huge": lambda spark, sf_dir: gold.platform_metrics(
        _silver_of(lanes.lane_h(spark, sf_dir))
    ),
    "batch_silver": _stored_silver(_rebuilt),
    "batch_seller_metrics": _stored_gold(_rebuilt, "seller_metrics"),
    "batch_city_metrics": _stored_gold(_rebuilt, "city_metrics"),
    "batch_platform_metrics": _stored_gold(_rebuilt, "platform_metrics"),
    "refresh_silver": _stored_silver(_refreshed),
    "refresh_seller_metrics": _stored_gold(_refreshed, "seller_metrics"),
    "refresh_city_metrics": _stored_gold(_refreshed, "city_metrics"),
    "refresh_platform_metrics": _stored_gold(_refreshed, "platform_metrics"),
    "silver_former_version": silver_former_version,
    "resumed_seller_metrics": _stored_gold(_refreshed_after_a_death, "seller_metrics"),
    "resumed_platform_metrics": _stored_gold(_refreshed_after_a_death, "platform_metrics"),
    "states_seller_metrics": _stored_gold(_changed_by_deltas, "seller_metrics"),
    "states_city_metrics": _stored_gold(_changed_by_deltas, "city_metrics"),
    "states_platform_metrics": _stored_gold(_changed_by_deltas, "platform_metrics"),
    "distinct_by_month_and_city": distinct_by_month_and_city,
    "distinct_over_all_days": distinct_over_all_days,
    "settlement_matches": _on_lane_p(_matches),
    "settlement_matches_l": _on_lane_l(_matches),
    "settlement_open": _on_lane_p(settlement.open_by_age),
    "settlement_open_l": _on_lane_l(settlement.open_by_age),
    "bronze_damaged": bronze_damaged,
    "gold_damaged": gold_damaged,
}


def _configured(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(session.configure(spark), sf_dir)

    return run


def registered() -> dict[str, Query]:
    return {name: _configured(query) for name, query in _QUERIES.items()}
