"""Which days of Silver may hold an event id, so that a refresh need not read all of Silver to know.

The index lies in `<silver>/_ids`: rows (hash of the id, day) in buckets by that hash, as many as the
number of rows asks for, and sorted by it within a bucket. A refresh of few ids opens their buckets and,
by the files' statistics, few row groups of them.

A refresh adds the days of its new rows before it changes Silver, and takes none away: a day that an id
left, or that shares a hash, is opened in vain and written as it was. A rebuild of Silver starts an
epoch. Silver's version names the epoch that covers it; where that is not the index's, as after a write
by other means, the index is not used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.sources.snapshots import Version, VersionedTable

EPOCH = "ids_epoch"  # in the note of a version of Silver, and of the index
ROWS_PER_BUCKET = 4_000_000
MOST_BUCKETS = 1 << 16
SCHEMA = T.StructType([T.StructField("id_hash", T.LongType()), T.StructField("event_date", T.DateType()), T.StructField("bucket", T.IntegerType())])


def _hash() -> Column:
    return F.xxhash64("event_id").alias("id_hash")


def _bucket(buckets: int) -> Column:
    return F.pmod("id_hash", F.lit(buckets)).cast("int").alias("bucket")


class IdIndex:
    def __init__(self, spark: SparkSession, silver_path: str):
        self._table = VersionedTable(spark, f"{silver_path.rstrip('/')}/_ids", "bucket")

    def covers(self, silver_version: Version) -> bool:
        epoch = silver_version.note.get(EPOCH)
        return epoch is not None and self._table.version().note.get(EPOCH) == epoch

    def _written(self, events: DataFrame, buckets: int) -> list[str]:
        rows = events.select(_hash(), "event_date").select("*", _bucket(buckets))
        rows = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "id_hash")
        return self._table.write(rows)

    def rebuild(self, events: DataFrame) -> str:
        """Replace the index by one of these events; gives its epoch, for the version of Silver that holds them."""
        buckets = min(MOST_BUCKETS, 1 + events.count() // ROWS_PER_BUCKET)
        epoch = uuid.uuid4().hex
        self._table.commit(self._written(events, buckets), self._table.version(), None, {EPOCH: epoch, "buckets": buckets})
        self._table.clean()
        return epoch

    def add(self, events: DataFrame) -> None:
        """Add the days of new events to the epoch at hand."""
        version = self._table.version()
        self._table.commit(self._written(events, version.note["buckets"]), version, [], version.note)
        self._table.clean()

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        return self._table.read(SCHEMA, self._table.version(), None if buckets is None else [str(b) for b in buckets])

    def days_of(self, events: DataFrame) -> DataFrame:
        """Rows (event_date) of the days that may hold an id of `events`; reads their buckets only."""
        hashed = events.select(_hash()).distinct()
        touched = hashed.select(_bucket(self._table.version().note["buckets"])).distinct().collect()
        found = self.rows(sorted(row.bucket for row in touched))
        return found.join(hashed, "id_hash", "left_semi").select("event_date").distinct()
