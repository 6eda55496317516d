"""SQL for DuckDB that gives the same rows as the registered queries, written independently of them."""

from __future__ import annotations

# The fields of an event, in the order of the contract.
_EVENT_FIELDS = [
    "event_id",
    "order_id",
    "customer_id",
    "seller_id",
    "city",
    "order_category",
    "payment_method",
    "event_type",
    "order_amount",
    "platform_fee",
    "seller_payout",
    "currency",
    "event_timestamp",
]

_LANE_P = """
lane AS (
  SELECT
    'evt_' || event_id AS event_id,
    'ord_' || event_id AS order_id,
    'cust_' || user_id AS customer_id,
    'seller_' || json_extract_string(props, '$.k') AS seller_id,
    CASE user_id % 6 WHEN 0 THEN 'Phoenix' WHEN 1 THEN 'New York' WHEN 2 THEN 'Chicago'
      WHEN 3 THEN 'Austin' WHEN 4 THEN 'Seattle' ELSE 'San Francisco' END AS city,
    CASE event_id % 4 WHEN 0 THEN 'food_delivery' WHEN 1 THEN 'groceries' WHEN 2 THEN 'pharmacy'
      ELSE 'retail' END AS order_category,
    CASE user_id % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'wallet' ELSE 'upi' END AS payment_method,
    CASE event_type WHEN 'click' THEN 'payment_authorized' WHEN 'purchase' THEN 'payment_captured'
      WHEN 'view' THEN 'refund_issued' WHEN 'signup' THEN 'payout_sent'
      ELSE 'payment_failed' END AS event_type,
    CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 47 = 0 THEN -value ELSE value END
      AS order_amount,
    floor(value * 12 + 0.5) / 100.0::DOUBLE AS platform_fee,
    CASE WHEN event_id % 43 = 0 THEN value
      ELSE floor((value - floor(value * 12 + 0.5) / 100.0::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE END
      AS seller_payout,
    'USD' AS currency,
    CASE WHEN event_id % 41 = 0 THEN 'not-a-timestamp'
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS event_timestamp,
    ts AS kafka_ingest_ts
  FROM {events}
)"""

_LATER_COPIES = """(SELECT event_id, ts, user_id, event_type, value, props FROM events UNION ALL
    SELECT event_id, ts + INTERVAL 1 DAY, user_id, event_type, value + 1, props FROM events WHERE event_id % 7 = 0)"""

_LANE_L = """
lane AS (
  SELECT
    'evt_' || l_orderkey || '_' || l_linenumber AS event_id,
    'ord_' || l_orderkey AS order_id,
    'cust_' || o_custkey AS customer_id,
    'seller_' || l_suppkey AS seller_id,
    n_name AS city,
    CASE l_partkey % 4 WHEN 0 THEN 'food_delivery' WHEN 1 THEN 'groceries' WHEN 2 THEN 'pharmacy'
      ELSE 'retail' END AS order_category,
    CASE o_custkey % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'wallet' ELSE 'upi' END AS payment_method,
    CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'payment_authorized'
      WHEN 1 THEN 'payment_captured' WHEN 2 THEN 'refund_issued' WHEN 3 THEN 'payout_sent'
      ELSE 'payment_failed' END AS event_type,
    {amount} AS order_amount,
    floor({amount} * {fee_steps} + 0.5) / {steps} AS platform_fee,
    floor(({amount} - floor({amount} * {fee_steps} + 0.5) / {steps}) * {steps} + 0.5)
      / {steps} AS seller_payout,
    'USD' AS currency,
    strftime(l_shipdate, '%Y-%m-%d') || 'T00:00:00.000000+00:00' AS event_timestamp,
    o_orderdate AS kafka_ingest_ts
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)"""

_BRONZE = """
bronze AS (
  SELECT *,
    CAST(try_cast(event_timestamp AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) AS event_ts,
    coalesce(order_amount >= 0 AND platform_fee >= 0 AND seller_payout >= 0, false)
      AS is_amount_positive,
    coalesce(abs(seller_payout - (order_amount - platform_fee)) < 0.01, false) AS payout_matches
  FROM lane
),
flagged AS (
  SELECT *, is_amount_positive AND payout_matches AND event_ts IS NOT NULL AND event_id IS NOT NULL
    AS is_valid_record
  FROM bronze
)"""

_SILVER = """
silver AS (
  SELECT *, CAST(event_ts AS DATE) AS event_date
  FROM flagged
  WHERE is_valid_record
  QUALIFY row_number() OVER (
    PARTITION BY event_id
    ORDER BY event_ts DESC, kafka_ingest_ts DESC, order_amount DESC, seller_id, customer_id,
      order_category, payment_method, platform_fee, seller_payout, event_type, city, order_id,
      currency, event_timestamp) = 1
),
captured AS (SELECT * FROM silver WHERE event_type = 'payment_captured')"""

_EVENT_COLUMNS = """event_id, order_id, customer_id, seller_id, city, order_category, payment_method,
  event_type, order_amount, platform_fee, seller_payout, currency, event_timestamp,
  strftime(kafka_ingest_ts, '%Y-%m-%d %H:%M:%S.%f') AS kafka_ingest_ts,
  strftime(event_ts, '%Y-%m-%d %H:%M:%S.%f') AS event_ts"""

_REASONS = """concat_ws(',',
    CASE WHEN event_id IS NULL THEN 'missing_event_id' END,
    CASE WHEN order_amount IS NULL THEN 'missing_order_amount' END,
    CASE WHEN platform_fee IS NULL THEN 'missing_platform_fee' END,
    CASE WHEN seller_payout IS NULL THEN 'missing_seller_payout' END,
    CASE WHEN order_amount < 0 THEN 'negative_order_amount' END,
    CASE WHEN platform_fee < 0 THEN 'negative_platform_fee' END,
    CASE WHEN seller_payout < 0 THEN 'negative_seller_payout' END,
    CASE WHEN abs(seller_payout - (order_amount - platform_fee)) >= 0.01 THEN 'payout_mismatch' END,
    CASE WHEN event_ts IS NULL THEN 'bad_event_timestamp' END) AS reasons"""


def _exact_sum(amount: str) -> str:
    return f"sum(CAST(CAST({amount} AS VARCHAR) AS DECIMAL(28,10)))"


def _sum(amount: str, name: str) -> str:
    return f"CAST(round({_exact_sum(amount)}, 2) AS DOUBLE) AS {name}"


def _average(amount: str, name: str) -> str:
    """Half-up in whole numbers: twice the sum and the rows, in units of the last decimal place."""
    units = f"CAST(replace(CAST({_exact_sum(amount)} AS VARCHAR), '.', '') AS HUGEINT)"
    return (
        f"CAST((2 * {units} + 100000000::HUGEINT * count(*)) // (200000000::HUGEINT * count(*)) AS DOUBLE)"
        f" / 100.0::DOUBLE AS {name}"
    )


_COUNT = "count(*) AS transaction_count"
_GROSS = _sum("order_amount", "gross_sales")
_FEES = _sum("platform_fee", "platform_fee_revenue")
_PAYOUTS = _sum("seller_payout", "seller_payout_total")
_MEAN = _average("order_amount", "avg_order_value")
_SELLERS = "count(DISTINCT seller_id) AS active_sellers"
_CUSTOMERS = "count(DISTINCT customer_id) AS active_customers"

_SELLER_METRICS = f"""SELECT event_date, seller_id, {_COUNT}, {_GROSS}, {_FEES}, {_PAYOUTS}, {_MEAN}
FROM captured GROUP BY event_date, seller_id"""
_CITY_METRICS = f"""SELECT event_date, city, {_COUNT}, {_GROSS}, {_FEES}, {_MEAN}, {_SELLERS}
FROM captured GROUP BY event_date, city"""
_PLATFORM_METRICS = f"""SELECT event_date, {_COUNT}, {_GROSS}, {_FEES}, {_PAYOUTS}, {_MEAN},
  {_SELLERS}, {_CUSTOMERS}
FROM captured GROUP BY event_date"""

_OUTCOMES = """count(*) FILTER (event_type = 'payment_captured') AS captured_count,
  count(*) FILTER (event_type = 'payment_failed') AS failed_count,
  CASE WHEN count(*) FILTER (event_type IN ('payment_captured', 'payment_failed')) > 0
    THEN CAST(count(*) FILTER (event_type = 'payment_captured') AS DOUBLE)
      / CAST(count(*) FILTER (event_type IN ('payment_captured', 'payment_failed')) AS DOUBLE)
    END AS success_rate"""

_SELLER_PAYOUTS = f"""SELECT event_date, seller_id,
  count(*) FILTER (event_type = 'payment_captured') AS captured_count,
  count(*) FILTER (event_type = 'payout_sent') AS payout_count,
  {_sum("CASE WHEN event_type = 'payment_captured' THEN seller_payout ELSE 0 END", "payable_total")},
  {_sum("CASE WHEN event_type = 'payout_sent' THEN seller_payout ELSE 0 END", "paid_total")}
FROM silver WHERE event_type IN ('payment_captured', 'payout_sent') GROUP BY event_date, seller_id"""

_CONTRACT_RULES = {
    **{
        f"{name}_null": f"{name} IS NULL"
        for name in _EVENT_FIELDS
    },
    "event_type_not_allowed": "event_type NOT IN ('payment_authorized', 'payment_captured',"
    " 'refund_issued', 'payout_sent', 'payment_failed')",
    "payment_method_not_allowed": "payment_method NOT IN ('card', 'wallet', 'upi')",
    "order_category_not_allowed": "order_category NOT IN ('food_delivery', 'groceries', 'pharmacy',"
    " 'retail')",
    "order_amount_negative": "order_amount < 0",
    "platform_fee_negative": "platform_fee < 0",
    "seller_payout_negative": "seller_payout < 0",
    "payout_mismatch": "abs(seller_payout - (order_amount - platform_fee)) >= 0.01",
    "event_timestamp_unparseable": "event_timestamp IS NOT NULL AND event_ts IS NULL",
}


def _check(name: str, value: str, severity: str, passed: str = "= 0") -> str:
    return (
        f"SELECT '{name}' AS check_name, CAST({value} AS BIGINT) AS value,"
        f" '{severity}' AS severity, CAST({value} AS BIGINT) {passed} AS passed"
    )


def _gold_checks(damaged: bool = False) -> str:
    """The report; with `damaged`, on the last day's sellers twice, dearer by one, and no city table."""
    checks = []
    if damaged:
        checks.append(_check("city_metrics_readable (PATH_NOT_FOUND)", "0", "error", "= 1"))
        checks.append(_check("city_metrics_wrong_columns", "7", "error"))
    sellers = f"({_SELLER_METRICS})"
    if damaged:
        sellers = f"""(SELECT * FROM written UNION ALL SELECT * REPLACE (gross_sales + 1 AS gross_sales) FROM written
          WHERE event_date = (SELECT max(event_date) FROM written))"""
    for table, grain, null_key in [
        ("seller_metrics", "event_date, seller_id", "event_date IS NULL OR seller_id IS NULL"),
        ("city_metrics", "event_date, city", "event_date IS NULL OR city IS NULL"),
        ("platform_metrics", "event_date", "event_date IS NULL"),
    ]:
        if damaged and table == "city_metrics":
            continue
        copies = f"(SELECT {grain}, count(*) AS copies FROM {table} GROUP BY {grain} HAVING copies > 1)"
        checks += [
            _check(f"{table}_readable", "1", "error", "= 1"),
            _check(f"{table}_wrong_columns", "0", "error"),
            _check(f"{table}_rows", f"(SELECT count(*) FROM {table})", "warning", "> 0"),
            _check(f"{table}_repeated_keys", f"(SELECT count(*) FROM {copies})", "error"),
            _check(f"{table}_null_keys", f"(SELECT count(*) FROM {table} WHERE {null_key})", "warning"),
        ]
    for table in ["seller_metrics"] if damaged else ["seller_metrics", "city_metrics"]:
        days = f"""(SELECT t.n IS DISTINCT FROM p.transaction_count AS other_count,
          greatest(abs(t.gross - p.gross_sales), abs(t.fees - p.platform_fee_revenue)) AS gap,
          (t.parts + 1) * 0.005 AS rounding
          FROM (SELECT event_date, count(*) AS parts, sum(transaction_count) AS n,
                  sum(gross_sales) AS gross, sum(platform_fee_revenue) AS fees
                FROM {table} GROUP BY event_date) t
          FULL JOIN platform_metrics p ON t.event_date = p.event_date)"""
        checks += [
            _check(
                f"{table}_days_with_other_count",
                f"(SELECT count(*) FROM {days} WHERE other_count)",
                "error",
            ),
            _check(
                f"{table}_days_with_other_money",
                f"(SELECT count(*) FROM {days} WHERE gap > rounding)",
                "error",
            ),
            _check(
                f"{table}_days_with_rounding_gap",
                f"(SELECT count(*) FROM {days} WHERE round(gap, 2) > 0)",
                "warning",
            ),
        ]
    for check, condition in [
        ("captured_rows_with_fraction_of_cent", "abs({0} * 100 - round({0} * 100)) > 0.0001"),
        ("captured_rows_beyond_exact_sums", "{0} >= 1e18"),
    ]:
        odd = " OR ".join(condition.format(name) for name in ["order_amount", "platform_fee", "seller_payout"])
        checks.append(_check(check, f"(SELECT count(*) FROM captured WHERE {odd})", "warning"))
    return f"""written AS ({_SELLER_METRICS}),
seller_metrics AS {sellers},
city_metrics AS ({_CITY_METRICS}),
platform_metrics AS ({_PLATFORM_METRICS})
{" UNION ALL ".join(checks)}"""


def _lane_p(events: str = "events") -> str:
    return _LANE_P.replace("{events}", events)


def _lane_l(amount: str, fee_steps: str, steps: str) -> str:
    parts = {"{amount}": amount, "{fee_steps}": f"{fee_steps}::DOUBLE", "{steps}": f"{steps}::DOUBLE"}
    lane = _LANE_L
    for name, value in parts.items():
        lane = lane.replace(name, value)
    return f"WITH {lane}, {_BRONZE}, {_SILVER}"


_BRONZE_P = f"WITH {_lane_p()}, {_BRONZE}"
_SILVER_P = f"{_BRONZE_P}, {_SILVER}"
_SILVER_C = f"WITH {_lane_p(_LATER_COPIES)}, {_BRONZE}, {_SILVER}"
_SILVER_L = _lane_l("l_extendedprice", "12.0", "100.0")
_SILVER_F = _lane_l("(l_extendedprice / 10000.0::DOUBLE)", "120000.0", "1000000.0")
_SILVER_H = _lane_l("(l_extendedprice + 950000000.0::DOUBLE)", "12.0", "100.0")

_BRONZE_VALID = f"{_BRONZE_P} SELECT {_EVENT_COLUMNS} FROM flagged WHERE is_valid_record"
_QUARANTINE = f"""{_BRONZE_P} SELECT {_EVENT_COLUMNS}, {_REASONS}{{extra}}
FROM flagged WHERE NOT is_valid_record"""

_NUMBERS = ["order_amount", "platform_fee", "seller_payout"]


def _payload() -> str:
    """JSON objects leave out null fields."""
    parts = []
    for name in _EVENT_FIELDS:
        quote = "" if name in _NUMBERS else '"'
        parts.append(f"""'"{name}":{quote}' || {name} || '{quote}'""")
    return f"WITH {_lane_p()} SELECT '{{' || concat_ws(',', {', '.join(parts)}) || '}}' AS value FROM lane"


# Every capture against every payout of its seller.
_LINES = """, sides AS (
  SELECT seller_id, event_id, event_date, event_type, seller_payout::DECIMAL(28, 10) AS amount,
    sum(seller_payout::DECIMAL(28, 10)) OVER (PARTITION BY seller_id, event_type ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS stop
  FROM silver WHERE event_type IN ('payment_captured', 'payout_sent') AND seller_payout::DECIMAL(28, 10) > 0 AND seller_id IS NOT NULL),
captures AS (SELECT *, stop - amount AS start FROM sides WHERE event_type = 'payment_captured'),
payouts AS (SELECT *, stop - amount AS start FROM sides WHERE event_type = 'payout_sent')"""
_MATCHES = f"""{_LINES}
SELECT c.seller_id, c.event_id AS capture_id, p.event_id AS payout_id, round(least(c.stop, p.stop) - greatest(c.start, p.start), 2)::DOUBLE AS amount
FROM captures c JOIN payouts p ON c.seller_id = p.seller_id AND c.start < p.stop AND p.start < c.stop"""
_OPEN = f"""{_LINES}, sent AS (SELECT seller_id, max(stop) AS sent FROM payouts GROUP BY seller_id),
aged AS (SELECT c.*, coalesce(sent, 0) AS sent, greatest(stop - greatest(start, coalesce(sent, 0)), 0) AS unpaid,
    (SELECT max(event_date) FROM silver) - event_date AS age FROM captures c LEFT JOIN sent USING (seller_id)),
owed AS (SELECT seller_id, max(stop) AS earned,
    round(coalesce(sum(CASE WHEN age BETWEEN 0 AND 7 THEN unpaid END), 0), 2)::DOUBLE AS open_0_to_7,
    round(coalesce(sum(CASE WHEN age BETWEEN 8 AND 30 THEN unpaid END), 0), 2)::DOUBLE AS open_8_to_30,
    round(coalesce(sum(CASE WHEN age > 30 THEN unpaid END), 0), 2)::DOUBLE AS open_over_30 FROM aged GROUP BY seller_id)
SELECT seller_id, coalesce(open_0_to_7, 0) AS open_0_to_7, coalesce(open_8_to_30, 0) AS open_8_to_30, coalesce(open_over_30, 0) AS open_over_30,
    round(greatest(coalesce(sent, 0) - coalesce(earned, 0), 0), 2)::DOUBLE AS paid_ahead
FROM owed FULL JOIN sent USING (seller_id)"""

ORACLES: dict[str, str] = {
    "bronze_flags": f"""{_BRONZE_P}
SELECT event_id, is_amount_positive, payout_matches, is_valid_record FROM flagged""",
    "bronze_valid": _BRONZE_VALID,
    "bronze_quarantine": _QUARANTINE.format(extra=", event_id AS payload_event_id"),
    "kafka_payload": _payload(),
    "silver_events": f"{_SILVER_P} SELECT {_EVENT_COLUMNS}, event_date FROM silver",
    "silver_dedup": f"{_SILVER_L} SELECT {_EVENT_COLUMNS}, event_date FROM silver",
    "gold_seller_metrics": f"{_SILVER_P} {_SELLER_METRICS}",
    "gold_city_metrics": f"{_SILVER_P} {_CITY_METRICS}",
    "gold_platform_metrics": f"{_SILVER_P} {_PLATFORM_METRICS}",
    "gold_seller_metrics_l": f"{_SILVER_L} {_SELLER_METRICS}",
    "gold_city_metrics_l": f"{_SILVER_L} {_CITY_METRICS}",
    "gold_platform_metrics_l": f"{_SILVER_L} {_PLATFORM_METRICS}",
    "payment_outcomes": f"{_SILVER_P} SELECT event_date, {_OUTCOMES} FROM silver GROUP BY event_date",
    "city_outcomes": f"""{_SILVER_P}
SELECT event_date, city, {_OUTCOMES} FROM silver GROUP BY event_date, city""",
    "seller_payouts": f"{_SILVER_P} {_SELLER_PAYOUTS}",
    "seller_payouts_l": f"{_SILVER_L} {_SELLER_PAYOUTS}",
    "contract_violations": _BRONZE_P
    + " UNION ALL ".join(
        f" SELECT '{rule}' AS rule, count(*) AS violations FROM bronze WHERE {breach}"
        for rule, breach in _CONTRACT_RULES.items()
    ),
    "stream_bronze": _BRONZE_VALID,
    "stream_quarantine": _QUARANTINE.format(extra=""),
    "bronze_ready": _BRONZE_P
    + " "
    + " UNION ALL ".join(
        [
            _check("bronze_readable", "1", "error", "= 1"),
            _check("bronze_wrong_columns", "0", "error"),
            _check("bronze_rows", "(SELECT count(*) FROM flagged WHERE is_valid_record)", "error", "> 0"),
        ]
    ),
    "gold_checks": f"{_SILVER_P}, {_gold_checks()}",
    "batch_run": f"{_SILVER_P} {_PLATFORM_METRICS}",
    "gold_seller_metrics_fine": f"{_SILVER_F} {_SELLER_METRICS}",
    "gold_platform_metrics_huge": f"{_SILVER_H} {_PLATFORM_METRICS}",
    **{
        f"{job}_{name}": f"{_SILVER_C} {query}"
        for job in ["batch", "refresh"]
        for name, query in {
            "silver": f"SELECT {_EVENT_COLUMNS}, event_date FROM silver",
            "seller_metrics": _SELLER_METRICS,
            "city_metrics": _CITY_METRICS,
            "platform_metrics": _PLATFORM_METRICS,
        }.items()
    },
    "silver_former_version": f"{_SILVER_P} SELECT {_EVENT_COLUMNS}, event_date FROM silver",
    "resumed_seller_metrics": f"{_SILVER_C} {_SELLER_METRICS}",
    "resumed_platform_metrics": f"{_SILVER_C} {_PLATFORM_METRICS}",
    "states_seller_metrics": f"{_SILVER_C} {_SELLER_METRICS}",
    "states_city_metrics": f"{_SILVER_C} {_CITY_METRICS}",
    "states_platform_metrics": f"{_SILVER_C} {_PLATFORM_METRICS}",
    "distinct_by_month_and_city": f"""{_SILVER_P}
SELECT strftime(event_date, '%Y-%m') AS month, city, count(DISTINCT seller_id) AS active_sellers, count(DISTINCT customer_id) AS active_customers
FROM silver WHERE event_type = 'payment_captured' GROUP BY ALL""",
    "distinct_over_all_days": f"""{_SILVER_P}
SELECT city, count(DISTINCT seller_id) AS active_sellers, count(DISTINCT customer_id) AS active_customers
FROM silver WHERE event_type = 'payment_captured' GROUP BY city""",
    "settlement_matches": f"{_SILVER_P} {_MATCHES}",
    "settlement_matches_l": f"{_SILVER_L} {_MATCHES}",
    "settlement_open": f"{_SILVER_P} {_OPEN}",
    "settlement_open_l": f"{_SILVER_L} {_OPEN}",
    "bronze_damaged": _check("bronze_readable", "1", "error", "= 1")
    + " UNION ALL "
    + _check("bronze_wrong_columns", "1", "error"),
    "gold_damaged": f"{_SILVER_P}, {_gold_checks(damaged=True)}",
}
