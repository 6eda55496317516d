"""Bronze, Silver and Gold as partitioned Parquet.

Silver and Gold are versioned (`snapshots`): a write becomes visible as a whole, in one commit, and a
write that fails or dies leaves the table as it was. Bronze grows by the micro-batches of streams, each
of which owns its folders.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.contract import (
    BRONZE_SCHEMA,
    GOLD_GRAINS,
    GOLD_SCHEMAS,
    QUARANTINE_SCHEMA,
    SILVER_SCHEMA,
)
from tallybrook.operators import distinct, states
from tallybrook.sources import id_index
from tallybrook.sources.id_index import IdIndex
from tallybrook.sources.snapshots import Folders, Version, VersionedTable


# The run under which the gathered batches of a closed day are kept.
COMPACTED = "compacted"
GATHERED_AT_MOST = 20

# Opening files for a few thousand days keeps no more tasks busy than this, however large the cluster.
MOST_TASKS_FOR_DAYS = 200


def quarantine_path(bronze_path: str) -> str:
    return bronze_path.rstrip("/") + "_invalid"


def _between(table: DataFrame, date_column: str, start: str | None, end: str | None) -> DataFrame:
    """`start` and `end` (both included) bound the table's date column; where the table is partitioned
    by it, other days are not even listed for reading.
    """
    if start is not None:
        table = table.filter(F.col(date_column) >= F.lit(start).cast("date"))
    if end is not None:
        table = table.filter(F.col(date_column) <= F.lit(end).cast("date"))
    return table


def _read(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    date_column: str,
    start: str | None,
    end: str | None,
) -> DataFrame:
    """Read with a fixed schema, which needs no footer and works on an empty table."""
    table = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    return _between(table, date_column, start, end)


def _read_version(
    spark: SparkSession, path: str, schema: T.StructType, start: str | None, end: str | None, version: Version | int | None
) -> DataFrame:
    """The latest version, or the given one, with a fixed schema."""
    table = VersionedTable(spark, path)
    resolved = version if isinstance(version, Version) else table.version(version)
    rows = table.read(schema, resolved).select(*schema.fieldNames())
    return _between(rows, "event_date", start, end)


def read_bronze(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return _read(spark, path, BRONZE_SCHEMA, "ingest_date", start, end)


def read_quarantine(spark: SparkSession, bronze_path: str) -> DataFrame:
    return _read(spark, quarantine_path(bronze_path), QUARANTINE_SCHEMA, "ingest_date", None, None)


def read_silver(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, version: Version | int | None = None
) -> DataFrame:
    return _read_version(spark, path, SILVER_SCHEMA, start, end, version)


def read_gold(
    spark: SparkSession, gold_path: str, table: str, start: str | None = None, end: str | None = None, version: Version | int | None = None
) -> DataFrame:
    return _read_version(spark, f"{gold_path}/{table}", GOLD_SCHEMAS[table], start, end, version)


def read_as_written(spark: SparkSession, path: str) -> DataFrame:
    """The latest version with the columns that its files have."""
    return VersionedTable(spark, path).read()


def _gather_days(table: DataFrame, *order: str) -> DataFrame:
    """Bring the rows of a day together before a write partitioned by `event_date`.

    Otherwise every task would write a file for every day. `rebalance` merges small days and, unlike
    a plain repartition, splits a day that is too large for one task. The sort within a task is the
    one that a partitioned write needs anyway; `order` refines it.
    """
    return table.hint("rebalance", F.col("event_date")).sortWithinPartitions("event_date", *order)


def _beside(path: str, label: str) -> str:
    return f"{path.rstrip('/')}.{label}-{uuid.uuid4().hex}"


def _put(rows: DataFrame, path: str, days: list[date] | None, base: Version | None, keep_versions: int) -> Version:
    """Replace a table, or the given days of it, those without rows included, in one commit.

    `base` is the version that the rows were computed from, if any; a commit since then that changed the
    same days makes this one fail.
    """
    table = VersionedTable(rows.sparkSession, path)
    base = base or table.version()
    values = None if days is None else [str(day) for day in days]
    version = table.commit(table.write(rows), base, values)
    table.clean(keep_versions)
    return version


def write_silver(
    silver: DataFrame,
    path: str,
    days: list[date] | None = None,
    base: Version | None = None,
    new: DataFrame | None = None,
    keep_versions: int = 1,
) -> Version:
    """Replace Silver, or some days of it. Ordered by type within a day, so that Gold can skip row
    groups without captures.

    The index of ids is brought up to date before the commit: from all rows, or for some days from the
    `new` ones among them. Without these it ends, and the next full write starts it again.
    """
    spark = silver.sparkSession
    table, index = VersionedTable(spark, path), IdIndex(spark, path)
    base = base or table.version()
    folders = table.write(_gather_days(silver, "event_type"))
    note = {}
    if days is None:
        note = {id_index.EPOCH: index.rebuild(table.read(SILVER_SCHEMA, Version(1, tuple(folders), tuple(table.plain_folders(Version(0))))))}
    elif new is not None and index.covers(base):
        index.add(new)
        note = {id_index.EPOCH: base.note[id_index.EPOCH]}
    version = table.commit(folders, base, None if days is None else [str(day) for day in days], note)
    table.clean(keep_versions)
    return version


def _spread_days(table: DataFrame) -> DataFrame:
    """Give the cores their share of the days of a table that has few rows per day.

    Such a write spends its time on opening files, one per day, so it must be spread by days and not
    by bytes: by its size, years of days would be merged into one task. The hash keeps Spark from
    taking this shuffle for the one before it, which it may merge.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(min(cores, MOST_TASKS_FOR_DAYS), F.xxhash64("event_date"))


def write_gold(
    table: DataFrame, gold_path: str, name: str, days: list[date] | None = None, keep_versions: int = 1
) -> Version:
    """Replace one Gold table, or some days. A day has one row or one per city, but may have very many
    sellers."""
    arrange = _gather_days if "seller_id" in GOLD_GRAINS[name] else _spread_days
    return _put(arrange(table), f"{gold_path}/{name}", days, None, keep_versions)


def write_batch(rows: DataFrame, path: str, run_id: str, batch_id: int, *partitions: str) -> None:
    """Write one micro-batch so that writing it again replaces it.

    The batch owns its partitions: `batch_id` is the same when a batch is replayed, and `run_id` keeps
    apart streams that started from different checkpoints and so count their batches anew.
    """
    (
        rows.withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("long")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "run_id", "batch_id")
        .parquet(path)
    )


def _gather(spark: SparkSession, path: str, schema: T.StructType, folders: list[str], target: str, drop: list[str]) -> None:
    """Write the rows of some batches' folders to one folder in their place."""
    files, fresh, former = Folders(spark, path), _beside(path, "new"), _beside(path, "old")
    rows = spark.read.schema(schema).option("basePath", path).parquet(*folders)
    rows.drop(*drop).hint("rebalance").write.parquet(fresh)
    for k, folder in enumerate(folders):
        files.move(folder, f"{former}/{k}")
    files.move(fresh, target)
    files.remove(former)


def _last_batches(folders: list[str]) -> dict[str, int]:
    last: dict[str, int] = {}
    for folder in folders:
        run, batch = _run_and_batch(folder)
        last[run] = max(batch, last.get(run, batch))
    return last


def _run_and_batch(folder: str) -> tuple[str, int]:
    run, batch = (part.partition("=")[2] for part in folder.rstrip("/").rsplit("/", 2)[1:])
    return run, int(batch)


def compact_bronze(spark: SparkSession, path: str, ingest_date: str) -> int:
    """Gather the micro-batches of a closed day into few files; gives the number of folders gathered.

    The last batch of each stream stays as it is, for it alone may be replayed, which must replace it.
    Of earlier days only the names are listed, of this day and later ones the names of their batches.
    """
    folders = Folders(spark, path)
    days = [name for name in folders.names(path) if name.startswith("ingest_date=") and name >= f"ingest_date={ingest_date}"]
    batches = {day: folders.matching(f"{path}/{day}/run_id=*/batch_id=*") for day in days}
    last = _last_batches([folder for found in batches.values() for folder in found])
    closed = []
    for folder in batches.get(f"ingest_date={ingest_date}", []):
        run, batch = _run_and_batch(folder)
        if run == COMPACTED or batch < last[run]:
            closed.append(folder)
    if len(closed) < 2:
        return 0
    target = f"{path}/ingest_date={ingest_date}/run_id={COMPACTED}/batch_id=0"
    _gather(spark, path, BRONZE_SCHEMA, closed, target, ["ingest_date"])
    return len(closed)


def compact_quarantine(spark: SparkSession, bronze_path: str) -> int:
    """Gather the closed micro-batches of the quarantine; gives the number of folders gathered.

    Rejected rows are few, so their batches are not kept by day. What was gathered before stays; each
    call leaves one folder more, and gathers these too once there are `GATHERED_AT_MOST`.
    """
    path = quarantine_path(bronze_path)
    folders = Folders(spark, path).matching(f"{path}/run_id=*/batch_id=*")
    last = _last_batches(folders)
    gathered = [folder for folder in folders if _run_and_batch(folder)[0] == COMPACTED]
    closed = [f for f in folders if f not in gathered and _run_and_batch(f)[1] < last[_run_and_batch(f)[0]]]
    if len(closed) < 2:
        return 0
    closed += gathered if len(gathered) >= GATHERED_AT_MOST else []
    number = 1 + max((_run_and_batch(f)[1] for f in gathered), default=-1)
    _gather(spark, path, QUARANTINE_SCHEMA, closed, f"{path}/run_id={COMPACTED}/batch_id={number}", [])
    return len(closed)


class GoldStates:
    """The stored states of Gold (`operators.states`), beside its tables.

    Each state names the version of Silver that it stands for. Where the two do not agree with each
    other and with Silver, they must be built anew.
    """

    def __init__(self, spark: SparkSession, gold_path: str):
        self._tables = {name: VersionedTable(spark, f"{gold_path}/_states/{name}") for name in states.SCHEMAS}

    def exist(self) -> bool:
        return all(table.version().number for table in self._tables.values())

    def stand_for(self, silver: Version) -> bool:
        return all(table.version().note.get("silver") == [silver.number, *silver.folders] for table in self._tables.values())

    def read(self, days: list[date] | None = None) -> dict[str, DataFrame]:
        values = None if days is None else [str(day) for day in days]
        return {name: table.read(states.SCHEMAS[name], table.version(), values) for name, table in self._tables.items()}

    def write(self, rows: dict[str, DataFrame], silver: Version, days: list[date] | None = None) -> None:
        """Replace the states, or those of some days, by those of a version of Silver."""
        values = None if days is None else [str(day) for day in days]
        for name, table in self._tables.items():
            base = table.version()
            table.commit(table.write(_gather_days(rows[name])), base, values, {"silver": [silver.number, *silver.folders]})
            table.clean()


class KeySets:
    """The stored dictionary of keys and the daily bitmaps (`operators.distinct`), beside Gold's tables."""

    def __init__(self, spark: SparkSession, gold_path: str):
        self._dictionary = VersionedTable(spark, f"{gold_path}/_keys/dictionary", "kind")
        self._bitmaps = VersionedTable(spark, f"{gold_path}/_keys/bitmaps")

    def dictionary(self) -> DataFrame:
        return self._stored(self._dictionary, distinct.DICTIONARY_SCHEMA)

    def bitmaps(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return _between(self._stored(self._bitmaps, distinct.BITMAP_SCHEMA), "event_date", start, end)

    def _stored(self, table: VersionedTable, schema: T.StructType) -> DataFrame:
        version = table.version()
        return table.read(schema, version) if version.number else table.empty(schema)

    def update(self, silver: DataFrame, days: list[date] | None = None) -> None:
        """Take in Silver, or its given days. Keys are only ever added, and before a bitmap uses them, so a
        death between the two leaves numbers without use."""
        base = self._dictionary.version()
        added = distinct.new_keys(silver, self.dictionary())
        self._dictionary.commit(self._dictionary.write(added), base, [])
        base = self._bitmaps.version()
        rows = _gather_days(distinct.bitmaps(silver, self.dictionary()))
        self._bitmaps.commit(self._bitmaps.write(rows), base, None if days is None else [str(day) for day in days])
        self._dictionary.clean()
        self._bitmaps.clean()
