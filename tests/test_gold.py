from __future__ import annotations

from collections import defaultdict
from datetime import date
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from samples import bronze_table, event, paid, rows_of
from tallybrook.contract import GOLD_SCHEMAS
from tallybrook.functions import money
from tallybrook.operators import gold, reports, silver
from tallybrook.sources import lanes

TABLES = {
    "seller_metrics": gold.seller_metrics,
    "city_metrics": gold.city_metrics,
    "platform_metrics": gold.platform_metrics,
}
CENT = Decimal("0.01")


def _cents(value: Decimal) -> float:
    return float(value.quantize(CENT, ROUND_HALF_UP))


def _brute_force(rows, key):
    """Metrics by exact decimal arithmetic in plain Python."""
    groups = defaultdict(list)
    for row in rows:
        if row.event_type == "payment_captured":
            groups[key(row)].append(row)
    result = {}
    for name, members in groups.items():
        sums = [
            sum(Decimal(repr(member[column])) for member in members)
            for column in ["order_amount", "platform_fee", "seller_payout"]
        ]
        result[name] = (
            len(members),
            *[_cents(total) for total in sums],
            _cents(sums[0] / len(members)),
            len({m.seller_id for m in members if m.seller_id is not None}),
            len({m.customer_id for m in members if m.customer_id is not None}),
        )
    return result


@pytest.fixture(scope="module")
def lane_silver(spark):
    events = lanes.lane_l(spark, "/root/testdata/sf0.001")
    events = events.withColumn("ingest_date", F.to_date("kafka_ingest_ts"))
    return silver.from_bronze(events).cache()


MONEY = ["gross_sales", "platform_fee_revenue", "seller_payout_total"]


@pytest.mark.parametrize(
    "table, key, columns",
    [
        (
            "seller_metrics",
            ["event_date", "seller_id"],
            ["transaction_count", *MONEY, "avg_order_value", None, None],
        ),
        (
            "city_metrics",
            ["event_date", "city"],
            ["transaction_count", *MONEY[:2], None, "avg_order_value", "active_sellers", None],
        ),
        (
            "platform_metrics",
            ["event_date"],
            ["transaction_count", *MONEY, "avg_order_value", "active_sellers", "active_customers"],
        ),
    ],
)
def test_against_brute_force(lane_silver, table, key, columns):
    expected = _brute_force(lane_silver.collect(), lambda row: tuple(row[name] for name in key))
    kept = [index for index, column in enumerate(columns) if column]
    expected = {name: tuple(values[i] for i in kept) for name, values in expected.items()}
    result = TABLES[table](lane_silver)
    assert [(f.name, f.dataType) for f in result.schema] == [(f.name, f.dataType) for f in GOLD_SCHEMAS[table]]
    found = {tuple(row[n] for n in key): tuple(row[columns[i]] for i in kept) for row in result.collect()}
    assert found == expected


def test_shared_tables_equal_the_separate_ones(lane_silver):
    with gold.SharedMetrics(lane_silver) as shared:
        for name, table in shared.tables().items():
            assert rows_of(table) == rows_of(TABLES[name](lane_silver))


def test_finer_tables_add_up_to_the_platform(lane_silver):
    day = F.col("event_date")
    platform = gold.platform_metrics(lane_silver).select(day, "transaction_count", F.rint(F.col("gross_sales") * 100))
    for table in [gold.seller_metrics, gold.city_metrics]:
        daily = table(lane_silver).groupBy(day).agg(
            F.sum("transaction_count"), F.sum(F.rint(F.col("gross_sales") * 100))
        )
        assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, platform.collect()))


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_result_does_not_depend_on_partitioning(spark, lane_silver, partitions):
    expected = {name: rows_of(table(lane_silver)) for name, table in TABLES.items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        shuffled = lane_silver.repartition(11, "customer_id")
        assert {name: rows_of(table(shuffled)) for name, table in TABLES.items()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _silver(spark, events):
    numbered = [{"event_id": f"e{i}"} | {k: v for k, v in e.items() if k != "event_id"} for i, e in enumerate(events)]
    return silver.from_bronze(bronze_table(spark, numbered))


def test_only_captures_count_and_null_keys_are_no_seller_or_customer(spark):
    table = _silver(
        spark,
        [
            paid(10.0, seller_id="a", customer_id="x"),
            paid(20.0, seller_id="a", customer_id=None),
            paid(30.0, seller_id=None, customer_id="x"),
            paid(99.0, seller_id="b", customer_id="y", event_type="refund_issued"),
        ],
    )
    row = gold.platform_metrics(table).first()
    assert (row.transaction_count, row.active_sellers, row.active_customers) == (3, 1, 1)
    assert gold.city_metrics(table).first().active_sellers == 1
    assert {r.seller_id: r.gross_sales for r in gold.seller_metrics(table).collect()} == {"a": 30.0, None: 30.0}


def test_a_day_without_any_customer_id_stays(spark):
    row = gold.platform_metrics(_silver(spark, [paid(10.0, customer_id=None)])).first()
    assert (row.transaction_count, row.active_customers) == (1, 0)


def test_half_cents_round_up(spark):
    row = gold.platform_metrics(_silver(spark, [paid(1.00, fee=0.5), paid(1.01, fee=0.5)])).first()
    assert (row.gross_sales, row.avg_order_value) == (2.01, 1.01)


def test_fractions_of_a_cent_add_up(spark):
    events = [event(order_amount=0.004, platform_fee=0.0, seller_payout=0.004) for _ in range(1000)]
    row = gold.platform_metrics(_silver(spark, events)).first()
    assert (row.gross_sales, row.seller_payout_total, row.avg_order_value) == (4.0, 4.0, 0.0)


def test_huge_amounts_neither_fail_nor_vanish(spark):
    huge = event(order_amount=1e300, platform_fee=0.0, seller_payout=1e300)
    table = _silver(spark, [huge, paid(10.0)])
    for metrics in TABLES.values():
        row = metrics(table).first()
        assert (row.transaction_count, row.gross_sales) == (2, 1e300)
        assert row.avg_order_value == pytest.approx(5e299)


def test_no_captures_gives_no_rows(spark):
    table = _silver(spark, [event(event_type="payment_failed")])
    assert all(metrics(table).isEmpty() for metrics in TABLES.values())


def test_fraction_of_cent(spark):
    amounts = spark.createDataFrame([(1.25,), (1.255,), (0.1 + 0.2,), (249.99,)], "x double")
    flags = amounts.select(money.has_fraction_of_cent(F.col("x"))).collect()
    assert [row[0] for row in flags] == [False, True, False, False]


@pytest.mark.parametrize(
    "rows, amount, gross, average",
    [
        (100_000, 0.00004, 4.0, 0.0),
        (1_200_000, 9.0e8, 1.08e15, 9.0e8),
        (600_000, 9.0e8, 5.4e14, 9.0e8),
        (300, 1e17, 3e19, 1e17),
    ],
)
def test_sums_keep_small_and_large_amounts(spark, rows, amount, gross, average):
    table = spark.range(rows).select(
        F.lit("2026-03-13").cast("date").alias("event_date"),
        F.lit("payment_captured").alias("event_type"),
        *[F.lit(name).alias(name) for name in ["seller_id", "customer_id", "city"]],
        *[F.lit(amount).alias(name) for name in ["order_amount", "platform_fee", "seller_payout"]],
    )
    for metrics in TABLES.values():
        row = metrics(table).first()
        assert (row.transaction_count, row.gross_sales, row.avg_order_value) == (rows, gross, average)


def test_an_average_is_rounded_once(spark):
    """3.0149999999 and so on: ten digits of the quotient already show a half cent."""
    table = _silver(spark, [event(order_amount=x, platform_fee=0.0, seller_payout=x) for x in (1.0049999999, 1.005, 1.005)])
    assert gold.platform_metrics(table).first().avg_order_value == 1.0


def test_outcomes(spark):
    types = ["payment_captured", "payment_captured", "payment_failed", "refund_issued"]
    table = _silver(
        spark,
        [event(event_type=kind) for kind in types] + [event(event_type="payout_sent", city="Seattle")],
    )
    row = reports.payment_outcomes(table).first()
    assert (row.captured_count, row.failed_count, row.success_rate) == (2, 1, 2 / 3)
    cities = {r.city: r.success_rate for r in reports.city_outcomes(table).collect()}
    assert cities == {"Austin": 2 / 3, "Seattle": None}


def test_seller_payouts(spark):
    table = _silver(
        spark,
        [paid(10.0), paid(20.0), paid(5.0, event_type="payout_sent"), paid(7.0, event_type="payment_failed")],
    )
    assert [tuple(row) for row in reports.seller_payouts(table).collect()] == [
        (date(2026, 3, 13), "s1", 2, 1, 28.0, 4.0)
    ]


def test_contract_violations(spark):
    table = bronze_table(
        spark,
        [event(), event(city=None, payment_method="cash"), event(event_timestamp="x", seller_payout=-1.0)],
    )
    counts = {row.rule: row.violations for row in reports.contract_violations(table).collect()}
    assert {rule: n for rule, n in counts.items() if n} == {
        "city_null": 1,
        "payment_method_not_allowed": 1,
        "seller_payout_negative": 1,
        "payout_mismatch": 1,
        "event_timestamp_unparseable": 1,
    }
    assert len(counts) == 21
