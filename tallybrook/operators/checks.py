"""Data checks before and after the batch jobs, as reports with one row per check.

Columns: `check_name`, `value`, `severity` ("error" stops a run, "warning" does not) and `passed`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.contract import BRONZE_SCHEMA, GOLD_GRAINS, GOLD_SCHEMAS, MONEY_FIELDS
from tallybrook.functions import money
from tallybrook.operators import gold
from tallybrook.sources.tables import read_as_written

ERROR, WARNING = "error", "warning"


class CheckFailed(RuntimeError):
    """A check of severity "error" did not pass."""


def _check(name: str, value: Column, severity: str, passed: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        value.cast("long").alias("value"),
        F.lit(severity).alias("severity"),
        passed.alias("passed"),
    )


def _zero(name: str, column: str, severity: str = ERROR) -> Column:
    value = F.coalesce(F.col(column), F.lit(0))
    return _check(name, value, severity, value == 0)


def _report(one_row: DataFrame, *checks: Column) -> DataFrame:
    return one_row.select(F.inline(F.array(*checks)))


def _open(spark: SparkSession, path: str, expected: T.StructType) -> tuple[DataFrame | None, DataFrame]:
    """The table, or None if it cannot be used as it is, and the report on that.

    Only file footers are read. An existing folder is not enough: one that holds no data file has no
    schema, and the job after it would fail.
    """
    name, problem = path.rstrip("/").rsplit("/", 1)[-1], None
    try:
        table = read_as_written(spark, path)
    except AnalysisException as error:
        table, problem = None, error.getCondition() or type(error).__name__
    found = {} if table is None else {field.name: field.dataType for field in table.schema}
    wrong = [field.name for field in expected if found.get(field.name) != field.dataType]
    readable = F.lit(0 if table is None else 1)
    reason = f" ({problem})" if problem else ""
    report = _report(
        spark.range(1),
        _check(f"{name}_readable{reason}", readable, ERROR, readable == 1),
        _check(f"{name}_wrong_columns", F.lit(len(wrong)), ERROR, F.lit(not wrong)),
    )
    return (None if wrong else table), report


def bronze_report(spark: SparkSession, path: str) -> DataFrame:
    """Is Bronze ready for Silver: readable, with the right columns, and not empty?"""
    table, report = _open(spark, path, BRONZE_SCHEMA)
    if table is None:
        return report
    name = path.rstrip("/").rsplit("/", 1)[-1]
    rows = F.col("row_count")
    return report.unionByName(
        _report(
            table.agg(F.count("*").alias("row_count")),
            _check(f"{name}_rows", rows, ERROR, rows > 0),
        )
    )


def _grain_report(name: str, table: DataFrame) -> DataFrame:
    grain = GOLD_GRAINS[name]
    has_null = reduce(lambda left, right: left | right, [F.col(key).isNull() for key in grain])
    profile = (
        table.groupBy(*grain)
        .agg(F.count("*").alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
            F.count_if(F.col("copies") > 1).alias("repeated_keys"),
            F.count_if(has_null).alias("null_keys"),
        )
    )
    # No captured payment and a payment without a seller or city are odd, but no fault of the job.
    return _report(
        profile,
        _check(f"{name}_rows", F.col("row_count"), WARNING, F.col("row_count") > 0),
        _zero(f"{name}_repeated_keys", "repeated_keys"),
        _zero(f"{name}_null_keys", "null_keys", WARNING),
    )


def _reconciliation(name: str, table: DataFrame, platform: DataFrame) -> DataFrame:
    """Daily totals of a finer table against the platform table.

    Every rounded row may be half a cent off, which shows only if Silver has fractions of a cent:
    such a day is a warning, a larger difference an error.
    """
    measures = ["gross_sales", "platform_fee_revenue"]
    finer = table.groupBy("event_date").agg(
        F.count("*").alias("parts"),
        F.sum("transaction_count").alias("finer_count"),
        *[F.sum(measure).alias(f"finer_{measure}") for measure in measures],
    )
    days = finer.join(
        platform.select("event_date", F.lit(True).alias("on_platform"), "transaction_count", *measures),
        "event_date",
        "full_outer",
    )
    gaps = [F.abs(F.col(f"finer_{measure}") - F.col(measure)) for measure in measures]
    gap = F.coalesce(F.greatest(*gaps), F.lit(0.0))
    rounding = (F.col("parts") + 1) * 0.005 + F.col("gross_sales") * 1e-12
    summary = days.agg(
        F.count_if(~F.col("finer_count").eqNullSafe(F.col("transaction_count"))).alias("other_count"),
        F.count_if(gap > rounding).alias("off"),
        F.count_if(F.round(gap, 2) > 0).alias("inexact"),
    )
    return _report(
        summary,
        _zero(f"{name}_days_with_other_count", "other_count"),
        _zero(f"{name}_days_with_other_money", "off"),
        _zero(f"{name}_days_with_rounding_gap", "inexact", WARNING),
    )


def fraction_report(silver: DataFrame) -> DataFrame:
    """Captured rows with amounts finer than a cent, and beyond what Gold's exact sums hold."""

    def any_amount(condition: Callable[[Column], Column]) -> Column:
        return F.greatest(*[condition(F.col(name)) for name in MONEY_FIELDS])

    counts = gold.captured(silver).agg(
        F.count_if(any_amount(money.has_fraction_of_cent)).alias("below_cent"),
        F.count_if(any_amount(money.is_beyond)).alias("beyond"),
    )
    return _report(
        counts,
        _zero("captured_rows_with_fraction_of_cent", "below_cent", WARNING),
        _zero("captured_rows_beyond_exact_sums", "beyond", WARNING),
    )


def gold_report(spark: SparkSession, gold_path: str, silver: DataFrame | None = None) -> DataFrame:
    """Are the three tables whole, unique at their grain, and in agreement with each other?"""
    tables, reports = {}, []
    for name, schema in GOLD_SCHEMAS.items():
        tables[name], opened = _open(spark, f"{gold_path}/{name}", schema)
        reports.append(opened)
        if tables[name] is not None:
            reports.append(_grain_report(name, tables[name]))
    platform = tables["platform_metrics"]
    for name in ["seller_metrics", "city_metrics"]:
        if tables[name] is not None and platform is not None:
            reports.append(_reconciliation(name, tables[name], platform))
    if silver is not None:
        reports.append(fraction_report(silver))
    return reduce(DataFrame.unionByName, reports)


def require(report: DataFrame) -> None:
    """Raise if a check of severity "error" failed. A report has a few dozen rows at most."""
    failed = report.filter((F.col("severity") == ERROR) & ~F.col("passed")).collect()
    if failed:
        raise CheckFailed(", ".join(f"{row.check_name} = {row.value}" for row in failed))
