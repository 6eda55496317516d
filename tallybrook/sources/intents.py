"""What a refresh is about to do, stored before its first change and cleared after its last.

The days that new rows touch follow from Silver as it was before the refresh. Once Silver has changed,
the day that an event left can no longer be found, so a refresh that dies between Silver and Gold would
leave that day stale for good. The next refresh therefore takes up what is stored here first.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from tallybrook.sources.snapshots import Folders


@dataclass(frozen=True)
class Intent:
    """`start` and `end` bound the Bronze days that were read; None is unbounded."""

    days: tuple[str, ...]
    start: str | None
    end: str | None

    def widened(self, start: str | None, end: str | None) -> tuple[str | None, str | None]:
        """Bounds that take in both this intent's Bronze days and the given ones."""
        first = None if start is None or self.start is None else min(start, self.start)
        last = None if end is None or self.end is None else max(end, self.end)
        return first, last


def _file(silver_path: str) -> str:
    return f"{silver_path.rstrip('/')}/_intents/refresh.json"


def pending(spark: SparkSession, silver_path: str) -> Intent | None:
    folders, path = Folders(spark, silver_path), _file(silver_path)
    if not folders.exists(path):
        return None
    found = json.loads(folders.read(path))
    return Intent(tuple(found["days"]), found["start"], found["end"])


def store(spark: SparkSession, silver_path: str, intent: Intent) -> None:
    Folders(spark, silver_path).replace(_file(silver_path), json.dumps(asdict(intent)))


def clear(spark: SparkSession, silver_path: str) -> None:
    Folders(spark, silver_path).remove(_file(silver_path))
