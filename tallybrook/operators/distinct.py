"""Exact distinct counts over any days and cities, from daily bitmaps.

Counts per day cannot be added up, as a seller is active on many days. Keys therefore get numbers from
a dictionary, and a day and city holds the set of its keys as bitmaps, one per bucket of 32,768 numbers.
Bitmaps are merged by `or` and counted by their bits, so a month needs no event to be read again.

Numbers need not be without gaps: each part of the dictionary's first write counts within buckets of its
own, and a bucket without keys has no row. Keys that come later are numbered behind all known ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.operators import gold

KINDS = {"seller": "seller_id", "customer": "customer_id"}
BUCKET = 32_768  # bits of one of Spark's bitmaps; fixed value
DICTIONARY_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("number", T.LongType()), T.StructField("kind", T.StringType())])
BITMAP_SCHEMA = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("bitmap", T.BinaryType()),
        T.StructField("event_date", T.DateType()),
    ]
)


def _keys(silver: DataFrame) -> DataFrame:
    """Distinct (event_date, city, kind, key) of captured payments; null keys are none."""
    payments = gold.captured(silver).select("event_date", "city", *KINDS.values()).distinct()
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("key")) for kind, column in KINDS.items()])
    return payments.select("event_date", "city", F.inline(kinds)).where("key IS NOT NULL").distinct()


def new_keys(silver: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary rows for keys that it lacks. Write them before use: a number must stay what it is."""
    last = dictionary.agg(F.max("number")).first()[0]
    first = 0 if last is None else (last // BUCKET + 1) * BUCKET
    keys = _keys(silver).select("kind", "key").distinct().join(dictionary, ["kind", "key"], "left_anti")
    return keys.select("key", (F.monotonically_increasing_id() + first).alias("number"), "kind")


def bitmaps(silver: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per day, city, kind and bucket."""
    numbered = _keys(silver).join(dictionary, ["kind", "key"])
    return (
        numbered.groupBy("event_date", "city", "kind", F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))
        .select(*BITMAP_SCHEMA.fieldNames())
    )


def distinct_counts(stored: DataFrame, *by: Column) -> DataFrame:
    """`active_sellers` and `active_customers` per `by`, any expressions of day and city.

    Bitmaps are merged in the map tasks first, so a group of any size sends one per bucket and task.
    """
    rows = stored.select(*by, "kind", "bucket", "bitmap")
    names = rows.columns[: len(by)]
    merged = rows.groupBy(*names, "kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    counts = [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"active_{kind}s") for kind in KINDS]
    return merged.groupBy(*names).agg(*counts)
