"""File sources with the shape of Kafka records: (value, timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = "value binary, timestamp timestamp"


def _file_options(max_files_per_trigger: int | None) -> dict[str, str]:
    return {} if max_files_per_trigger is None else {"maxFilesPerTrigger": str(max_files_per_trigger)}


def stream_text(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """One JSON record per line. The arrival time is that of the file, so a replay gives the same."""
    lines = spark.readStream.options(**_file_options(max_files_per_trigger)).text(path)
    return lines.select("value", F.col("_metadata.file_modification_time").alias("timestamp"))


def stream_records(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Records kept in Parquet, for example a dump of a topic."""
    options = _file_options(max_files_per_trigger)
    return spark.readStream.schema(RECORD_SCHEMA).options(**options).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_SCHEMA).parquet(path)
