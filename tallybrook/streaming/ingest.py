"""Raw records to the Bronze table and its quarantine, as a stream."""

from __future__ import annotations

import threading

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybrook.operators import bronze
from tallybrook.sources import tables


class BatchWriter:
    """Splits each micro-batch into Bronze and quarantine rows.

    The batch is kept while both sides are written, so the source is read and parsed once. One
    aggregate over it says which sides have rows; an empty side writes nothing. A batch that fails
    after writing is replayed into the same partitions: the stream logs the batch's clock as well, so
    even `ingest_date` comes out the same.
    """

    def __init__(self, bronze_path: str):
        self._bronze_path = bronze_path
        self._quarantine_path = tables.quarantine_path(bronze_path)
        self._run_id = None
        self._started = threading.Event()

    def bind(self, run_id: str) -> None:
        """Give the id under which batches are stored. The first batch waits for it."""
        self._run_id = run_id
        self._started.set()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._started.wait()
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            size = batch.agg(
                F.count("*").alias("row_count"),
                F.count_if("is_valid_record").alias("valid"),
            ).first()
            if size.valid > 0:
                self.write_valid(bronze.valid_side(batch), batch_id)
            if size.row_count > size.valid:
                # Few rows from many tasks would make as many tiny files; many large payloads must
                # not meet in one task. Adaptive execution sizes the tasks by bytes.
                rows = bronze.quarantine_side(batch).hint("rebalance")
                self.write_rejected(rows, batch_id)
        finally:
            batch.unpersist()

    def write_valid(self, rows: DataFrame, batch_id: int) -> None:
        tables.write_batch(rows, self._bronze_path, self._run_id, batch_id, "ingest_date")

    def write_rejected(self, rows: DataFrame, batch_id: int) -> None:
        tables.write_batch(rows, self._quarantine_path, self._run_id, batch_id)


def _without_accepted_payloads(annotated: DataFrame) -> DataFrame:
    """Only a rejected record needs its payload; dropping the others makes the kept batch smaller."""
    return annotated.withColumn(
        "raw_value", F.when(F.col("is_valid_record"), F.lit(None)).otherwise(F.col("raw_value"))
    )


def start(
    raw: DataFrame,
    bronze_path: str,
    checkpoint_path: str,
    available_now: bool = False,
    processing_time: str | None = None,
    exact_payout: bool = False,
    writer: BatchWriter | None = None,
) -> StreamingQuery:
    """Start the stream of (value, timestamp) records into Bronze.

    By default batches follow each other without pause. The query id is the run id: Spark keeps it in
    the checkpoint, so it survives a restart and changes with a new checkpoint.
    """
    writer = writer or BatchWriter(bronze_path)
    annotated = _without_accepted_payloads(bronze.from_records(raw, exact_payout))
    stream = (
        annotated.writeStream.foreachBatch(writer)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
    )
    if available_now:
        stream = stream.trigger(availableNow=True)
    elif processing_time is not None:
        stream = stream.trigger(processingTime=processing_time)
    query = stream.start()
    writer.bind(query.id)
    return query
