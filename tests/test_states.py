"""States of Gold changed by deltas, against rebuilds."""

from __future__ import annotations

from random import Random

import pytest
from pyspark.sql import functions as F

from samples import bronze_table, event, paid, rows_of
from test_jobs import EVENTS, LATER, paths, put_bronze, read_all
from tallybrook.contract import GOLD_SCHEMAS, SILVER_SCHEMA
from tallybrook.operators import gold, silver, states
from tallybrook.plans import jobs
from tallybrook.sources import tables
from tallybrook.sources.snapshots import VersionedTable


def add_bronze(spark, root, events, day):
    later = bronze_table(spark, events).withColumn("ingest_date", F.lit(day).cast("date"))
    later.write.mode("append").partitionBy("ingest_date").parquet(str(root / "bronze"))


def built(spark, root, events):
    put_bronze(spark, root / "bronze", events)
    jobs.run_silver(spark, *paths(root)[:2])
    jobs.run_gold(spark, *paths(root)[1:], states=True)


def rebuilt(spark, root, target):
    target.mkdir()
    spark.read.parquet(str(root / "bronze")).write.partitionBy("ingest_date").parquet(str(target / "bronze"))
    jobs.run_batch(spark, *paths(target))
    return read_all(spark, target)


def test_gold_from_states_equals_gold_from_events(spark, tmp_path):
    odd = [paid(1.005, fee=0.5, event_id="f"), event(event_id="g", seller_id=None, city=None, customer_id=None)]
    built(spark, tmp_path, EVENTS + odd)
    first = read_all(spark, tmp_path)
    jobs.run_gold(spark, *paths(tmp_path)[1:])
    assert read_all(spark, tmp_path) == first


def random_events(random, n):
    """Copies of few ids that move between days, cities, sellers and types, with awkward amounts."""
    return [
        paid(
            random.choice([0.1, 0.2, 0.305, 1.005, 2.675, 33.333333, 1e9 + 0.015]),
            fee=random.choice([0.05, 0.015]),
            event_id=f"e{random.randrange(12)}",
            city=random.choice(["Austin", "Seattle", None]),
            seller_id=random.choice(["s1", "s2", None]),
            customer_id=random.choice(["c1", "c2", "c3"]),
            event_type=random.choice(["payment_captured", "payment_captured", "payment_failed"]),
            event_timestamp=f"2026-03-{random.randrange(10, 15)}T0{random.randrange(9)}:00:00+00:00",
        )
        for _ in range(n)
    ]


def test_any_order_of_deltas_gives_the_rebuild(spark):
    """On rows: batch by batch, states changed by deltas equal those of all rows."""
    random = Random(3)
    batches = [random_events(random, 8) for _ in range(4)]
    rows = [silver.from_bronze(bronze_table(spark, batch)).select(*SILVER_SCHEMA.fieldNames()) for batch in batches]
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        current = spark.createDataFrame([], SILVER_SCHEMA)
        stored = states.of(current)
        for k in order:
            new = rows[k]
            out = current.join(new.select("event_id"), "event_id", "left_semi")
            into = silver.keep_latest(out.unionByName(new))
            change = states.delta(out, into)
            stored = {name: spark.createDataFrame(states.changed(stored[name], change[name], name).collect(), states.SCHEMAS[name]) for name in stored}
            current = spark.createDataFrame(silver.keep_latest(current.unionByName(new)).collect(), SILVER_SCHEMA)
        expected = states.of(current)
        for name in stored:
            assert rows_of(stored[name]) == rows_of(expected[name].select(*states.SCHEMAS[name].fieldNames()))
        tables_of = gold.from_states(stored["sellers"], stored["customers"])
        assert rows_of(tables_of["platform_metrics"]) == rows_of(gold.platform_metrics(current))
        assert rows_of(tables_of["seller_metrics"]) == rows_of(gold.seller_metrics(current))
        assert rows_of(tables_of["city_metrics"]) == rows_of(gold.city_metrics(current))


def test_a_refresh_changes_states_without_reading_whole_days(spark, tmp_path, monkeypatch):
    built(spark, tmp_path / "one", EVENTS)
    add_bronze(spark, tmp_path / "one", LATER, "2027-01-01")
    with monkeypatch.context() as patch:
        patch.setattr(states, "of", None)  # neither a rebuild of days nor of all
        jobs.run_refresh(spark, *paths(tmp_path / "one"), start="2027-01-01")
    assert read_all(spark, tmp_path / "one") == rebuilt(spark, tmp_path / "one", tmp_path / "two")
    stored, version = tables.GoldStates(spark, paths(tmp_path / "one")[2]), VersionedTable(spark, paths(tmp_path / "one")[1]).version()
    assert stored.stand_for(version)


class Died(Exception):
    pass


@pytest.mark.parametrize("step", ["before states", "between states", "after states"])
def test_states_after_a_death(spark, tmp_path, monkeypatch, step):
    built(spark, tmp_path / "one", EVENTS)
    add_bronze(spark, tmp_path / "one", LATER, "2027-01-01")
    write, commit = tables.GoldStates.write, VersionedTable.commit

    def dying_write(self, *arguments):
        if step == "before states":
            raise Died
        write(self, *arguments)
        raise Died

    def dying_commit(self, *arguments):
        found = commit(self, *arguments)
        if self.path.endswith("_states/sellers"):
            raise Died
        return found

    with monkeypatch.context() as patch:
        if step == "between states":
            patch.setattr(VersionedTable, "commit", dying_commit)
        else:
            patch.setattr(tables.GoldStates, "write", dying_write)
        with pytest.raises(Died):
            jobs.run_refresh(spark, *paths(tmp_path / "one"), start="2027-01-01")
    jobs.run_refresh(spark, *paths(tmp_path / "one"), start="2030-01-01")
    assert read_all(spark, tmp_path / "one") == rebuilt(spark, tmp_path / "one", tmp_path / "two")


def test_amounts_beyond_exact_sums_build_their_days_anew(spark, tmp_path):
    built(spark, tmp_path / "one", [*EVENTS, paid(3e18, event_id="big", event_timestamp="2026-03-14T00:00:00+00:00")])
    add_bronze(spark, tmp_path / "one", [paid(5.0, event_id="big", event_timestamp="2026-03-14T01:00:00+00:00")], "2027-01-01")
    jobs.run_refresh(spark, *paths(tmp_path / "one"), start="2027-01-01")
    found = read_all(spark, tmp_path / "one")
    assert found == rebuilt(spark, tmp_path / "one", tmp_path / "two") and set(GOLD_SCHEMAS) < set(found)
