"""Session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Ingest and event dates are cut in the session zone, so it must be the same in every job.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}

# The table layout relies on adaptive execution to split large days and merge small ones. The number
# of shuffle partitions is left to the cluster: set spark.sql.adaptive.coalescePartitions
# .initialPartitionNum high and let Spark merge what is too small.
EXPECTED = {"spark.sql.adaptive.enabled": "true"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in (REQUIRED | EXPECTED).items():
        spark.conf.set(key, value)
    return spark


def create(app_name: str) -> SparkSession:
    """A session for `spark-submit`; master and resources come from its command line."""
    return configure(SparkSession.builder.appName(app_name).getOrCreate())
