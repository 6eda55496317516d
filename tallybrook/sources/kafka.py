"""Kafka source and sink.

The connector is a package of its own and must match the Spark version and Scala 2.13, for example
`--packages org.apache.spark:spark-sql-kafka-0-10_2.13:4.1.2`. The options are built by plain
functions, so they can be tested without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from tallybrook.contract import EVENT_FIELDS

# Fixed value: the topic that producers and consumers share by default.
DEFAULT_TOPIC = "marketplace-payments"


def read_options(
    bootstrap_servers: str,
    topic: str = DEFAULT_TOPIC,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """`starting_offsets` counts on the first start only; later the checkpoint decides.

    `max_offsets_per_trigger` bounds a batch after a long stop, and `min_partitions` splits a hot
    topic partition over several tasks.
    """
    options = {
        "kafka.bootstrap.servers": bootstrap_servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def read_stream(spark: SparkSession, bootstrap_servers: str, **options) -> DataFrame:
    """Stream of (value, timestamp)."""
    reader = spark.readStream.format("kafka").options(**read_options(bootstrap_servers, **options))
    return reader.load().select("value", "timestamp")


def encode(events: DataFrame) -> DataFrame:
    """Events as the JSON `value` column that the sink takes."""
    return events.select(F.to_json(F.struct(*EVENT_FIELDS)).alias("value"))


def write_options(bootstrap_servers: str, topic: str = DEFAULT_TOPIC) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": bootstrap_servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.retries": "5",
        "kafka.linger.ms": "10",
    }


def writer(events: DataFrame, bootstrap_servers: str, topic: str = DEFAULT_TOPIC) -> DataFrameWriter:
    """A batch writer that sends the events once `save()` is called."""
    return encode(events).write.format("kafka").options(**write_options(bootstrap_servers, topic))
