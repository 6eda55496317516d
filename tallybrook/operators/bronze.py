"""Bronze: decode, parse, tag and split raw records. Map-only, so it serves batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.contract import BRONZE_SCHEMA, EVENT_FIELDS, EVENT_SCHEMA, QUARANTINE_SCHEMA
from tallybrook.functions import rules
from tallybrook.functions.timestamps import event_time


def decode(raw: DataFrame) -> DataFrame:
    """(value, timestamp) records to the event columns, `kafka_ingest_ts` and `raw_value`.

    `inline` evaluates the JSON parser once per record. Selecting `parsed.*` instead lets the
    optimizer push later filters below the projection, which repeats the parse in each condition.
    """
    text = raw.select(
        F.col("value").cast("string").alias("raw_value"),
        F.col("timestamp").alias("kafka_ingest_ts"),
    )
    events = F.inline(F.array(F.from_json("raw_value", EVENT_SCHEMA)))
    return text.select(events.alias(*EVENT_FIELDS), "kafka_ingest_ts", "raw_value")


def annotate(parsed: DataFrame, exact_payout: bool = False) -> DataFrame:
    """Add `event_ts`, `ingest_date` and the three validity flags to parsed events.

    `ingest_date` is the processing day in the session zone, which the jobs pin to UTC. A record
    without an `event_id` is invalid: Silver keeps one row per id, so all of them would become one.
    """
    derived = parsed.withColumns(
        {
            "event_ts": event_time(F.col("event_timestamp")),
            "ingest_date": F.current_date(),
            "is_amount_positive": rules.amounts_non_negative(),
            "payout_matches": rules.payout_matches(exact_payout),
        }
    )
    valid = rules.all_of(
        [
            F.col("is_amount_positive"),
            F.col("payout_matches"),
            F.col("event_ts").isNotNull(),
            F.col("event_id").isNotNull(),
        ]
    )
    return derived.withColumn("is_valid_record", valid)


def valid_side(annotated: DataFrame) -> DataFrame:
    """Rows for the Bronze table."""
    return annotated.filter(F.col("is_valid_record")).select(*BRONZE_SCHEMA.fieldNames())


def quarantine_side(annotated: DataFrame) -> DataFrame:
    """All other rows, those with a NULL flag included, with their payload and the reasons."""
    reasons = F.array_compact(
        F.array(*[F.when(broken, F.lit(reason)) for reason, broken in rules.rejection_reasons().items()])
    )
    return (
        annotated.filter(~rules.holds(F.col("is_valid_record")))
        .withColumn("reasons", reasons)
        .select(*QUARANTINE_SCHEMA.fieldNames())
    )


def from_records(raw: DataFrame, exact_payout: bool = False) -> DataFrame:
    """Decode and annotate in one step."""
    return annotate(decode(raw), exact_payout)
