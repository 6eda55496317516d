"""The jobs, and a command line for `spark-submit`.

    spark-submit tallybrook_job.py bronze --bootstrap-servers host:9092
    spark-submit tallybrook_job.py silver
    spark-submit tallybrook_job.py gold
    spark-submit tallybrook_job.py batch
    spark-submit tallybrook_job.py refresh --start 2026-03-13
    spark-submit tallybrook_job.py compact --ingest-date 2026-03-12
"""

from __future__ import annotations

import argparse
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybrook.operators import checks, gold, refresh, silver
from tallybrook.operators import states as gold_states
from tallybrook.plans import session
from tallybrook.sources import intents, kafka, tables
from tallybrook.sources.id_index import IdIndex
from tallybrook.sources.snapshots import Version, VersionedTable
from tallybrook.streaming import ingest

# Default locations.
BRONZE_PATH = "data/bronze"
SILVER_PATH = "data/silver"
GOLD_PATH = "data/gold"
CHECKPOINT_PATH = "data/checkpoints/bronze_kafka_consumer"


def start_bronze(
    spark: SparkSession,
    bootstrap_servers: str,
    topic: str = kafka.DEFAULT_TOPIC,
    output_path: str = BRONZE_PATH,
    checkpoint_path: str = CHECKPOINT_PATH,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
    available_now: bool = False,
    processing_time: str | None = None,
    exact_payout: bool = False,
) -> StreamingQuery:
    """Kafka to Bronze and quarantine. A pause between batches (`processing_time`) makes fewer files."""
    session.configure(spark)
    records = kafka.read_stream(
        spark,
        bootstrap_servers,
        topic=topic,
        starting_offsets=starting_offsets,
        max_offsets_per_trigger=max_offsets_per_trigger,
        min_partitions=min_partitions,
    )
    return ingest.start(
        records,
        output_path,
        checkpoint_path,
        available_now=available_now,
        processing_time=processing_time,
        exact_payout=exact_payout,
    )


def run_silver(
    spark: SparkSession,
    bronze_path: str = BRONZE_PATH,
    silver_path: str = SILVER_PATH,
    exact_payout: bool = False,
) -> None:
    """Rebuild Silver from all of Bronze."""
    session.configure(spark)
    rows = silver.from_bronze(tables.read_bronze(spark, bronze_path), exact_payout)
    tables.write_silver(rows, silver_path)


def run_gold(
    spark: SparkSession, silver_path: str = SILVER_PATH, gold_path: str = GOLD_PATH, states: bool = False
) -> None:
    """Rebuild the three Gold tables from all of Silver; with `states`, those that a refresh changes by
    deltas are built too, and Gold from them.
    """
    session.configure(spark)
    if not states:
        _write_gold(spark, tables.read_silver(spark, silver_path), gold_path, None)
        return
    with VersionedTable(spark, silver_path).pinned() as version:
        rows = tables.read_silver(spark, silver_path, version=version)
        tables.GoldStates(spark, gold_path).write(gold_states.of(rows), version)
    _write_gold_from_states(spark, gold_path, None)


def _write_gold_from_states(spark: SparkSession, gold_path: str, days: list[date] | None, keep_versions: int = 1) -> None:
    stored = tables.GoldStates(spark, gold_path).read(days)
    _write_all(spark, gold.from_states(stored["sellers"], stored["customers"]), gold_path, days, keep_versions)


def _change_states(
    spark: SparkSession, gold_path: str, silver_path: str, base: Version, current: DataFrame, new: DataFrame, changed: list[date]
) -> None:
    """Bring the states from the version `base` of Silver, of which `current` are the rows, to the latest,
    which has the rows `new`; or build them anew if they stand for another version."""
    stored, latest = tables.GoldStates(spark, gold_path), VersionedTable(spark, silver_path).version()
    if not stored.stand_for(base):
        stored.write(gold_states.of(tables.read_silver(spark, silver_path, version=latest)), latest)
        return
    if not changed:
        return
    out = current.filter(F.col("event_date").isin(changed)).join(new.select("event_id"), "event_id", "left_semi")
    into = silver.keep_latest(out.unionByName(new))
    if out.unionByName(into).filter(gold_states.has_beyond()).isEmpty():
        change, before = gold_states.delta(out, into), stored.read(changed)
        after = {name: gold_states.changed(before[name], change[name], name) for name in before}
    else:
        rows = tables.read_silver(spark, silver_path, version=latest)
        after = gold_states.of(rows.filter(F.col("event_date").isin(changed)))
    stored.write(after, latest, changed)


def _write_gold(spark: SparkSession, rows: DataFrame, gold_path: str, days: list[date] | None, keep_versions: int = 1) -> None:
    """The writes do not depend on each other and are submitted together, so that one fills the cores
    that the last tasks of another leave idle.
    """

    with gold.SharedMetrics(rows) as metrics:
        _write_all(spark, metrics.tables(), gold_path, days, keep_versions)


def _write_all(
    spark: SparkSession, gold_tables: dict[str, DataFrame], gold_path: str, days: list[date] | None, keep_versions: int
) -> None:
    def write(item: tuple[str, DataFrame]) -> None:
        tables.write_gold(item[1], gold_path, item[0], days, keep_versions)

    with ThreadPoolExecutor(len(gold_tables)) as writers:
        list(writers.map(inheritable_thread_target(spark)(write), gold_tables.items()))


def run_batch(
    spark: SparkSession,
    bronze_path: str = BRONZE_PATH,
    silver_path: str = SILVER_PATH,
    gold_path: str = GOLD_PATH,
    exact_payout: bool = False,
) -> None:
    """Check Bronze, build Silver, build Gold, check Gold; stops at the first failure."""
    session.configure(spark)
    checks.require(checks.bronze_report(spark, bronze_path))
    run_silver(spark, bronze_path, silver_path, exact_payout)
    run_gold(spark, silver_path, gold_path)
    checks.require(checks.gold_report(spark, gold_path, tables.read_silver(spark, silver_path)))


def run_refresh(
    spark: SparkSession,
    bronze_path: str = BRONZE_PATH,
    silver_path: str = SILVER_PATH,
    gold_path: str = GOLD_PATH,
    start: str | None = None,
    end: str | None = None,
    exact_payout: bool = False,
    keep_versions: int = 1,
) -> list[date]:
    """Bring Silver and Gold up to date with the Bronze days from `start` to `end`; gives the days
    that were written. The outcome is that of a full rebuild, and running it again changes nothing.

    What is about to change is stored first. A refresh that died is taken up by the next one: its Bronze
    days are read again, and Gold is written for its days too.
    """
    session.configure(spark)
    left = intents.pending(spark, silver_path)
    if left:
        start, end = left.widened(start, end)
    new = silver.from_bronze(tables.read_bronze(spark, bronze_path, start, end), exact_payout)
    new = new.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with VersionedTable(spark, silver_path).pinned() as base:
            current, index = tables.read_silver(spark, silver_path, version=base), IdIndex(spark, silver_path)
            held = index.days_of(new) if index.covers(base) else None
            changed = refresh.affected_days(new, current, held)
            days = sorted({*changed, *(date.fromisoformat(day) for day in (left.days if left else ()))})
            if days:
                intents.store(spark, silver_path, intents.Intent(tuple(map(str, days)), start, end))
            if changed:
                rows = refresh.refreshed(new, current, changed)
                tables.write_silver(rows, silver_path, changed, base, new, keep_versions)
            with_states = tables.GoldStates(spark, gold_path).exist()
            if days and with_states:
                _change_states(spark, gold_path, silver_path, base, current, new, changed)
    finally:
        new.unpersist()
    VersionedTable(spark, silver_path).clean(keep_versions)  # the former version is no longer pinned
    if days:
        if with_states:
            _write_gold_from_states(spark, gold_path, days, keep_versions)
        else:
            rows = tables.read_silver(spark, silver_path).filter(F.col("event_date").isin(days))
            _write_gold(spark, rows, gold_path, days, keep_versions)
        intents.clear(spark, silver_path)
    return days


def run_keys(spark: SparkSession, silver_path: str = SILVER_PATH, gold_path: str = GOLD_PATH, days: list[date] | None = None) -> None:
    """Bring the key sets for distinct counts up to date with Silver, or with its given days."""
    session.configure(spark)
    rows = tables.read_silver(spark, silver_path)
    rows = rows if days is None else rows.filter(F.col("event_date").isin(days))
    tables.KeySets(spark, gold_path).update(rows, days)


def run_compact(spark: SparkSession, ingest_date: str, bronze_path: str = BRONZE_PATH) -> int:
    """Gather the files of a closed day of Bronze, and those of the quarantine's closed batches."""
    session.configure(spark)
    if ingest_date >= str(spark.sql("SELECT current_date()").first()[0]):
        raise ValueError(f"{ingest_date} is not over")
    return tables.compact_bronze(spark, bronze_path, ingest_date) + tables.compact_quarantine(spark, bronze_path)


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="tallybrook")
    jobs = root.add_subparsers(dest="job", required=True)
    paths = {"bronze": BRONZE_PATH, "silver": SILVER_PATH, "gold": GOLD_PATH}

    def job(name: str, *tables_used: str) -> argparse.ArgumentParser:
        arguments = jobs.add_parser(name)
        for table in tables_used:
            arguments.add_argument(f"--{table}-path", default=paths[table])
        return arguments

    def with_kafka(arguments: argparse.ArgumentParser) -> argparse.ArgumentParser:
        arguments.add_argument("--bootstrap-servers", required=True)
        arguments.add_argument("--topic", default=kafka.DEFAULT_TOPIC)
        return arguments

    stream = with_kafka(job("bronze"))
    stream.add_argument("--output-path", default=BRONZE_PATH)
    stream.add_argument("--checkpoint-path", default=CHECKPOINT_PATH)
    stream.add_argument("--starting-offsets", default="latest")
    stream.add_argument("--max-offsets-per-trigger", type=int)
    stream.add_argument("--min-partitions", type=int)
    stream.add_argument("--available-now", action="store_true")
    stream.add_argument("--processing-time")
    job("gold", "silver", "gold").add_argument("--states", action="store_true")
    job("keys", "silver", "gold")
    refreshing = job("refresh", "bronze", "silver", "gold")
    refreshing.add_argument("--start")
    refreshing.add_argument("--end")
    refreshing.add_argument("--keep-versions", type=int, default=1)
    for arguments in [stream, job("silver", "bronze", "silver"), job("batch", "bronze", "silver", "gold"), refreshing]:
        arguments.add_argument("--exact-payout", action="store_true")
    job("compact", "bronze").add_argument("--ingest-date", required=True)
    return root


def main(arguments: list[str] | None = None) -> None:
    options = vars(parser().parse_args(arguments))
    name = options.pop("job")
    spark = session.create(f"tallybrook-{name}")
    run = {
        "silver": run_silver,
        "gold": run_gold,
        "batch": run_batch,
        "refresh": run_refresh,
        "keys": run_keys,
        "compact": run_compact,
    }
    if name == "bronze":
        start_bronze(spark, **options).awaitTermination()
    else:
        run[name](spark, **options)
    spark.stop()


if __name__ == "__main__":
    main()
