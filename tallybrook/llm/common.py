"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.sources.workspace import new_folder

# The contract's word and white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

BATCH_BYTES = 8 << 20  # of an Arrow batch, as large as the largest slices that operators cut from one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that nothing above it is computed twice
    and a lost executor does not cost more than the tasks it ran."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="run-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))  # from the driver's disk, through Spark, to each executor's
    _shipped.add(context.applicationId)


def release_memory() -> None:
    """Give freed memory back to the system. Spark keeps Python workers for later tasks, and what one
    stage's arrays took would otherwise stay with them while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library other than glibc
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`df.mapInArrow`, with batches bounded by bytes and memory given back after each task. Without the
    bound a batch is 10,000 rows or 64 MB, held by the JVM and the worker at once for every task."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(task, schema)


# Columns that operators add for their tasks and leave out of what these give back.
OWN_COLUMNS = ("__text", "__seed")


def schema_with(df: DataFrame, added: str) -> str:
    """The columns of `df` but the operator's own, and `added`."""
    return ", ".join([*(f"`{n.replace('`', '``')}` {t}" for n, t in df.dtypes if n not in OWN_COLUMNS), added])


def with_plain_names(docs: DataFrame, known: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`run` on `docs`, where the columns not in `known` have names that clash with nothing; the result,
    which has the same columns, gets the names back."""
    if len(set(docs.columns)) < len(docs.columns):
        raise ValueError(f"columns share a name: {docs.columns}")
    renamed = docs.toDF(*(c if c in known else f"extra_{k}_" for k, c in enumerate(docs.columns)))
    return run(renamed).toDF(*docs.columns)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def salted_left_join(rows: DataFrame, verdicts: DataFrame, keys: list[str], salts: int = 16, grows: bool = False) -> DataFrame:
    """Left join of many rows to one row per key. Each key is spread over `salts` join keys, so that
    a key with a third of all rows meets no more than its share in one task.

    Null keys match null keys. `verdicts` is multiplied by `salts` and should have few rows per key.
    Spark's estimate of its size leaves out the salts, so that a table far beyond the limit would be
    broadcast through the driver: with `grows`, for verdicts that grow with the input, it never is.
    """
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t]), F.lit(salts)))
    right = verdicts.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in [*keys, "__salt"]})
    renamed = renamed.hint("merge") if grows else renamed
    match = F.col("__salt") == F.col("____salt")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, match, "left").drop("__salt", "____salt", *[f"__{k}" for k in keys])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by bytes of text, so that a task's memory does not depend on how long texts
    are; one text alone may exceed the limit, as texts stay whole."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
