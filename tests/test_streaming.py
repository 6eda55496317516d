from __future__ import annotations

import json
from datetime import date
from pathlib import Path
from random import Random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from samples import payload, records, rows_of
from tallybrook.operators import bronze, silver
from tallybrook.sources import files, lanes, tables
from tallybrook.streaming import ingest

GOOD = [payload(event_id=f"e{i}") for i in range(50)]
BAD = [payload(event_id=f"b{i}", seller_payout=1.0) for i in range(7)]


def run(spark, source, target, checkpoint, writer=None, **options):
    stream = files.stream_records(spark, str(source), **options)
    query = ingest.start(stream, str(target), str(checkpoint), available_now=True, writer=writer)
    query.awaitTermination()
    return query


def put(spark, source, payloads):
    records(spark, payloads).coalesce(1).write.mode("append").parquet(str(source))


def data_files(path):
    return sorted(Path(path).rglob("*.parquet"))


def ids(table):
    return sorted(row.event_id for row in table.collect())


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    raw = lanes.as_records(lanes.lane_p(spark, sf_dir))
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    run(spark, tmp_path / "in", tmp_path / "bronze", tmp_path / "check", max_files_per_trigger=1)
    expected = bronze.from_records(raw)
    written = tables.read_bronze(spark, str(tmp_path / "bronze"))
    assert rows_of(written) == rows_of(bronze.valid_side(expected))
    rejected = tables.read_quarantine(spark, str(tmp_path / "bronze"))
    assert rows_of(rejected) == rows_of(bronze.quarantine_side(expected))
    batches = spark.read.parquet(str(tmp_path / "bronze")).select("batch_id").distinct()
    assert batches.count() == 3


class FailsAfterWriting(ingest.BatchWriter):
    def write_valid(self, rows, batch_id):
        super().write_valid(rows, batch_id)
        raise RuntimeError("lost after writing")


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    source, target, checkpoint = (tmp_path / name for name in ["in", "bronze", "check"])
    put(spark, source, GOOD + BAD)
    with pytest.raises(StreamingQueryException):
        run(spark, source, target, checkpoint, FailsAfterWriting(str(target)))
    assert tables.read_bronze(spark, str(target)).count() == len(GOOD)
    # The replay happens on a later day than the first attempt.
    log = checkpoint / "offsets" / "0"
    lines = log.read_text().splitlines()
    clock = json.loads(lines[1])
    first_day = date(2026, 1, 5)
    clock["batchTimestampMs"] = 1767607200000
    log.write_text("\n".join([lines[0], json.dumps(clock), *lines[2:]]))
    (checkpoint / "offsets" / ".0.crc").unlink(missing_ok=True)
    for _ in range(2):
        run(spark, source, target, checkpoint)
    days = {row.ingest_date for row in tables.read_quarantine(spark, str(target)).collect()}
    assert days == {first_day}
    on_first_day = tables.read_bronze(spark, str(target), start="2026-01-05", end="2026-01-05")
    assert ids(on_first_day) == sorted(f"e{i}" for i in range(50))
    assert tables.read_quarantine(spark, str(target)).count() == len(BAD)


def test_crash_and_restart_leave_no_copies(spark, tmp_path):
    source, target, checkpoint = (tmp_path / name for name in ["in", "bronze", "check"])
    put(spark, source, GOOD + BAD)
    with pytest.raises(StreamingQueryException):
        run(spark, source, target, checkpoint, FailsAfterWriting(str(target)))
    put(spark, source, [payload(event_id="later")])
    run(spark, source, target, checkpoint)
    assert ids(tables.read_bronze(spark, str(target))) == sorted([f"e{i}" for i in range(50)] + ["later"])
    assert tables.read_quarantine(spark, str(target)).count() == len(BAD)


def test_a_new_checkpoint_does_not_overwrite_older_batches(spark, tmp_path):
    put(spark, tmp_path / "one", [payload(event_id="a")])
    put(spark, tmp_path / "two", [payload(event_id="b")])
    first = run(spark, tmp_path / "one", tmp_path / "bronze", tmp_path / "check1")
    second = run(spark, tmp_path / "two", tmp_path / "bronze", tmp_path / "check2")
    assert first.id != second.id
    assert ids(tables.read_bronze(spark, str(tmp_path / "bronze"))) == ["a", "b"]


@pytest.mark.parametrize("good, bad", [(GOOD, []), ([], BAD)])
def test_an_empty_side_writes_nothing(spark, tmp_path, good, bad):
    put(spark, tmp_path / "in", good + bad)
    run(spark, tmp_path / "in", tmp_path / "bronze", tmp_path / "check")
    assert bool(data_files(tmp_path / "bronze")) == bool(good)
    assert bool(data_files(tmp_path / "bronze_invalid")) == bool(bad)


def test_rejected_rows_are_gathered_by_bytes(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    for name, filler in [("few", ""), ("large", None)]:
        texts = [filler if filler is not None else "".join(Random(i).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)) for i in range(40)]
        wide = records(spark, [payload(event_id=f"b{i}", seller_payout=1.0, city=text) for i, text in enumerate(texts)])
        wide.repartition(8).write.parquet(str(tmp_path / name))
        spark.conf.set(size, "100k")
        try:
            run(spark, tmp_path / name, tmp_path / f"{name}-out", tmp_path / f"{name}-check")
        finally:
            spark.conf.unset(size)
        written = len(data_files(tmp_path / f"{name}-out_invalid"))
        assert written == 1 if name == "few" else written > 1
        assert tables.read_quarantine(spark, str(tmp_path / f"{name}-out")).count() == 40


def test_compaction_keeps_rows_and_replays(spark, tmp_path):
    """Batches of a closed day are gathered, but for the last one, which a replay must replace."""
    source, target, checkpoint = (tmp_path / name for name in ["in", "bronze", "check"])
    for k in range(4):
        put(spark, source, [payload(event_id=f"e{k}")])
        run(spark, source, target, checkpoint)
    written = tables.read_bronze(spark, str(target))
    day, before = str(written.first().ingest_date), rows_of(written)
    assert tables.compact_bronze(spark, str(target), day) == 3
    assert rows_of(tables.read_bronze(spark, str(target))) == before
    assert len(data_files(target)) == 2 and tables.compact_bronze(spark, str(target), day) == 0
    (checkpoint / "commits" / "3").unlink()
    (checkpoint / "commits" / ".3.crc").unlink(missing_ok=True)
    run(spark, source, target, checkpoint)
    assert rows_of(tables.read_bronze(spark, str(target))) == before
    put(spark, source, [payload(event_id="e4")])
    run(spark, source, target, checkpoint)
    assert tables.compact_bronze(spark, str(target), day) == 2
    assert ids(tables.read_bronze(spark, str(target))) == [f"e{k}" for k in range(5)]


def test_empty_input(spark, tmp_path):
    put(spark, tmp_path / "in", [])
    run(spark, tmp_path / "in", tmp_path / "bronze", tmp_path / "check")
    assert not (tmp_path / "bronze").exists()
    assert not (tmp_path / "bronze_invalid").exists()


def test_text_files_and_late_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [payload(event_id="late", event_timestamp="2020-01-02T03:04:05+00:00"), "{broken"]
    (tmp_path / "in" / "part.json").write_text("\n".join(lines))
    stream = files.stream_text(spark, str(tmp_path / "in"))
    ingest.start(stream, str(tmp_path / "bronze"), str(tmp_path / "check"), available_now=True).awaitTermination()
    written = tables.read_bronze(spark, str(tmp_path / "bronze"))
    row = written.withColumn("today", F.current_date()).first()
    assert (row.today - row.ingest_date).days in (0, 1)
    assert silver.from_bronze(written).first().event_date == date(2020, 1, 2)
    rejected = tables.read_quarantine(spark, str(tmp_path / "bronze")).first()
    assert (rejected.raw_value, rejected.reasons[0]) == ("{broken", "no_event_fields")
