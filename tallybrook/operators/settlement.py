"""Settlement: which payouts paid for which captured payments, first in first out per seller.

All captures of a seller, by event time, lie end to end on a line of money, each as long as its payout
amount; so do the payouts that were sent. A payout settles the captures that it overlaps on that line.
What lies beyond the last payout is open.

Positions are prefix sums, first over days and then within a day, so that a seller with very many
payments is no single sorted group. The line is cut into stretches of some `STRETCH_ROWS` intervals; an
interval stands in every stretch that it touches, and each stretch is swept by itself, in the order of
where intervals start. No two lists are compared pair by pair.

Amounts are exact decimals; amounts of 0 or less, those too large for them, and rows without a seller
settle nothing and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.contract import CAPTURED, PAYOUT_SENT
from tallybrook.functions import money

STRETCH_ROWS = 4000
AGES = [7, 30]  # days; the last group is older
_MONEY = "decimal(38,10)"


def _intervals(silver: DataFrame) -> DataFrame:
    """seller_id, is_capture, event_id, event_date, start, stop of captures and payouts on their lines."""
    rows = silver.where(F.col("event_type").isin(CAPTURED, PAYOUT_SENT)).select(
        "seller_id", (F.col("event_type") == CAPTURED).alias("is_capture"), "event_id", "event_date", "event_ts", money.exact(F.col("seller_payout")).alias("amount")
    )
    rows = rows.where("amount > 0 AND seller_id IS NOT NULL")
    line = ["seller_id", "is_capture"]
    earlier = Window.partitionBy(*line).orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*line, "event_date").agg(F.sum("amount").cast(_MONEY).alias("day_amount"))
    days = days.select(*line, "event_date", F.coalesce(F.sum("day_amount").over(earlier), F.lit(0)).cast(_MONEY).alias("day_start"))
    within = Window.partitionBy(*line, "event_date").orderBy("event_ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("amount").over(within)).join(days, [*line, "event_date"])
    stop = (F.col("day_start") + F.col("upto")).cast(_MONEY)
    return placed.select(*line, "event_id", "event_date", (stop - F.col("amount")).cast(_MONEY).alias("start"), stop.alias("stop"))


def _stretched(intervals: DataFrame) -> DataFrame:
    """Each interval once for every stretch that it touches, cut to it."""
    sellers = intervals.groupBy("seller_id").agg(F.max("stop").alias("whole"), F.ceil(F.count("*") / STRETCH_ROWS).alias("stretches"))
    # a stretch is as many whole units of money long, as fractions of it would not be exact
    sellers = sellers.select("seller_id", F.ceil(F.col("whole") / F.col("stretches")).cast("decimal(27,0)").alias("width"), "stretches")

    def stretch(position: Column) -> Column:
        return F.least(F.call_function("div", position, F.col("width")), F.col("stretches") - 1)

    cut = intervals.join(sellers, "seller_id").withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("stop")))))
    stretch_number = F.col("stretch").cast("decimal(10,0)")
    low = (stretch_number * F.col("width")).cast(_MONEY)
    high = F.when(F.col("stretch") < F.col("stretches") - 1, ((stretch_number + 1) * F.col("width")).cast(_MONEY)).otherwise(F.col("stop"))
    cut = cut.withColumns({"start": F.greatest("start", low), "stop": F.least("stop", high)})
    return cut.where("start < stop").drop("width", "stretches")


def matches(silver: DataFrame) -> DataFrame:
    """seller_id, capture_id, payout_id and the amount that the payout paid for the capture."""
    sweep = Window.partitionBy("seller_id", "stretch").orderBy("start", "is_capture")
    so_far = sweep.rowsBetween(Window.unboundedPreceding, 0)
    swept = _stretched(_intervals(silver)).withColumn("next", F.lead("start").over(sweep))
    for side, is_side in (("capture", F.col("is_capture")), ("payout", ~F.col("is_capture"))):
        latest = F.last(F.when(is_side, F.struct("event_id", "stop")), ignorenulls=True).over(so_far)
        swept = swept.withColumn(side, latest)
    end = F.least(F.coalesce("next", "capture.stop"), F.col("capture.stop"), F.col("payout.stop"))
    paid = swept.where("capture IS NOT NULL AND payout IS NOT NULL").withColumn("amount", end - F.col("start"))
    paid = paid.where("amount > 0").groupBy("seller_id", F.col("capture.event_id").alias("capture_id"), F.col("payout.event_id").alias("payout_id"))
    return paid.agg(F.sum("amount").cast(_MONEY).alias("amount"))


def open_by_age(silver: DataFrame) -> DataFrame:
    """Per seller, what captures are not paid for yet, by their age in days at the table's last day, and
    what was paid ahead of captures.

    Captures of a day lie end to end on the seller's line, so what is open of them is the part of the
    day's stretch beyond all payouts: sums per seller and day suffice, and are exact. Rows that settle
    nothing only count for the last day. It and the lines read the same sums, as the shuffle that makes
    them is used again; so `silver` is computed once.
    """
    amount = money.exact(F.col("seller_payout"))
    settles = F.col("event_type").isin(CAPTURED, PAYOUT_SENT) & (amount > 0) & F.col("event_date").isNotNull()
    rows = silver.select(
        "event_date",
        F.when(settles, F.col("seller_id")).alias("seller_id"),
        *[F.when(settles & F.col("seller_id").isNotNull() & (F.col("event_type") == kind), amount).alias(name) for name, kind in (("earned", CAPTURED), ("sent", PAYOUT_SENT))],
    )
    sums = rows.groupBy("seller_id", "event_date").agg(*[F.sum(name).cast(_MONEY).alias(name) for name in ("earned", "sent")])
    # the sums go into this maximum to keep both sides alike; a filter on the seller would be pushed below them
    last = sums.agg(F.max(F.struct("event_date", "earned", "sent")).getField("event_date").alias("last_day"))
    days = sums.where("earned IS NOT NULL OR sent IS NOT NULL")

    zero = F.lit(0).cast(_MONEY)
    whole = Window.partitionBy("seller_id")
    so_far = whole.orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns(
        {
            "earned": F.coalesce("earned", zero),
            "stop": F.coalesce(F.sum("earned").over(so_far), zero).cast(_MONEY),
            "all_sent": F.coalesce(F.sum("sent").over(whole), zero).cast(_MONEY),
        }
    )
    start = (F.col("stop") - F.col("earned")).cast(_MONEY)
    unpaid = F.greatest(F.col("stop") - F.greatest(start, "all_sent"), zero)
    age = F.date_diff("last_day", "event_date")
    lows = [0, *[days_old + 1 for days_old in AGES]]
    ages = {f"open_{low}_to_{high}": age.between(low, high) for low, high in zip(lows, AGES)} | {f"open_over_{AGES[-1]}": age > AGES[-1]}
    aged = days.crossJoin(last).select("seller_id", "stop", "all_sent", *[F.when(is_in, unpaid).alias(name) for name, is_in in ages.items()])

    def cents(amount: Column) -> Column:
        return F.round(F.coalesce(amount, F.lit(0)), 2).cast("double")

    ahead = F.greatest(F.max("all_sent") - F.max("stop"), zero)
    return aged.groupBy("seller_id").agg(*[cents(F.sum(name)).alias(name) for name in ages], F.round(ahead, 2).cast("double").alias("paid_ahead"))
