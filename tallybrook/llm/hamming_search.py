"""Exact k nearest binary codes by incremental multi-index hashing.

Method: a code is cut into segments of a little less than log2(number of codes) bits, each with an
index of its own. Round r probes the m segments at radius r: by the pigeonhole principle, every code within
distance m (r + 1) - 1 of a query then has met it in some segment. A query is closed as soon as the
distance of its k-th verified neighbour is covered in this sense; the others go on. The k nearest among a few
codes of each probed bucket bound the distance from the start, so that the join by segment value
returns only pairs that can still matter.

Equal codes are searched once, whether as queries or as neighbours, with the k + 1 smallest ids of
each; so a code that a third of the rows share costs no more than any other.

Cases: a row is not its own neighbour, but rows with equal codes are neighbours at distance 0; ties
go to the smaller id; rows with a null code, id or vector neither search nor are found; of rows with
the same id and code one counts; a query with fewer than k other rows gets them all; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import staged

BITS = 64


def sign_code(vector: Column) -> Column:
    """One bit per dimension: whether it is positive; dimensions beyond 64 flip the bits again."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(i, F.lit(BITS)))).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(vector) >= 0, F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b)))


def segments(codes: int) -> list[tuple[int, int]]:
    """Shift and width of each segment, for this many distinct codes.

    Some six codes share a value on average: to meet them costs less than the probes of a larger
    radius, which wider segments would need. At most six segments keep the plans of a round small.
    """
    count = max(2, min(6, round(BITS / max(math.log2(max(codes, 2)) - 2.5, 4))))
    ends = [BITS * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _value(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND((1 << width) - 1)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """Per query the k + 1 best codes, and `bound`: the distance that k + 1 ids have, if known."""
    best = Window.partitionBy("query").orderBy("distance", "lowest")
    kept = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    enough = F.sum("many").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow)) >= k + 1
    bound = F.min(F.when(F.col("enough"), F.col("distance"))).over(Window.partitionBy("query"))
    return kept.withColumn("enough", enough).withColumn("bound", bound).drop("rank", "enough")


def _probe(pending: DataFrame, index: DataFrame, shift: int, width: int, radius: int) -> DataFrame:
    """Codes that meet a query in this segment at this radius, and lie within the query's bound."""
    flips = np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)
    probes = pending.withColumn("flip", F.explode(F.lit(flips)))
    probes = probes.select("query", "bound", _value(F.col("query"), shift, width).bitwiseXOR(F.col("flip")).alias("value"))
    buckets = index.withColumn("v", _value(F.col("code"), shift, width))
    # Spark takes probes for as few as the queries they come from, and would broadcast them; a merge
    # spills, and Spark splits its skewed buckets
    met = probes.join(buckets.hint("merge"), (F.col("value") == F.col("v")) & (_distance("query", "code") <= F.col("bound")))
    return met.select("query", "code", "lowest", "many", _distance("query", "code").alias("distance"))


def search(rows: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", code_column: str = "code") -> DataFrame:
    """query id, rank from 1, neighbour id and distance: the k nearest of every query row."""
    rows = rows.select(F.col(id_column).alias("id"), F.col(code_column).alias("code"), is_query.alias("asks")).where("id is not null and code is not null")
    rows = staged(rows, "codes")
    smallest = Window.partitionBy("code").orderBy("id")
    few = rows.select("id", "code").distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    codes = few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most
    codes = staged(codes.withColumn("lowest", F.col("ids")[0]).withColumn("many", F.size("ids")), "distinct-codes")
    cuts = segments(codes.count())
    asked = staged(rows.where("asks").select(F.col("code").alias("query")).distinct(), "queries")
    index = codes.select("code", "lowest", "many")

    found = None
    for shift, width in cuts:
        value = _value(F.col("code"), shift, width)
        bucket = Window.partitionBy("value").orderBy("lowest")
        sample = index.withColumn("value", value).withColumn("n", F.row_number().over(bucket)).where(F.col("n") <= k + 1)
        near = asked.withColumn("value", _value(F.col("query"), shift, width)).join(sample, "value").select("query", "code", "lowest", "many")
        found = near if found is None else found.union(near)
    best = _nearest(found.distinct().withColumn("distance", _distance("query", "code")), k)
    best = staged(best, "nearest")
    bounds = best.groupBy("query").agg(F.first("bound").alias("bound"))
    pending = staged(asked.join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(BITS))), "open")
    closed = []
    for radius in range(max(w for _, w in cuts) + 1):
        met = best.join(pending.select("query"), "query").select("query", "code", "lowest", "many", "distance")
        for shift, width in cuts:
            if radius <= width:
                met = met.union(_probe(pending, index, shift, width, radius))
        best = staged(_nearest(met.distinct(), k), "nearest")
        bounds = best.groupBy("query").agg(F.first("bound").alias("new"))
        after = pending.join(bounds, "query", "left").select("query", F.coalesce("new", "bound").alias("bound"))
        covered = len(cuts) * (radius + 1) - 1
        closed.append(best.join(after.where(F.col("bound") <= covered).select("query"), "query"))
        pending = staged(after.where(F.col("bound") > covered), "open")
        if pending.isEmpty():
            break
    else:
        closed.append(best.join(pending.select("query"), "query"))
    done = closed[0]
    for part in closed[1:]:
        done = done.union(part)
    neighbours = done.join(codes.select("code", "ids"), "code").select("query", "distance", F.explode("ids").alias("neighbour_id"))
    # ids of a query's own code: each row takes the k best of k + 1, itself left out
    ranked = Window.partitionBy("query").orderBy("distance", "neighbour_id")
    lists = neighbours.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1)
    lists = lists.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour_id"))).alias("list"))
    asking = rows.where("asks").select("id", F.col("code").alias("query")).distinct()
    others = asking.join(lists, "query").select("id", F.slice(F.filter("list", lambda x: x["neighbour_id"] != F.col("id")), 1, k).alias("list"))
    return others.select(F.col("id").alias("query_id"), F.posexplode("list").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.neighbour_id").alias("neighbour_id"), F.col("x.distance").cast("int").alias("distance")
    )


def oracle(k: int = 10, embeddings: str = "embeddings") -> str:
    """Brute force in DuckDB over the same sign codes, as 64-character bit strings."""
    return f"""WITH flipped AS (SELECT vec_id, ((i - 1) % 64) AS bit, sum(CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END) % 2 AS b
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {embeddings}) GROUP BY ALL),
    codes AS (SELECT vec_id, list(b::INT ORDER BY bit) AS code FROM flipped GROUP BY vec_id),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.code[i] <> c.code[i] THEN 1 ELSE 0 END))::INT AS distance
        FROM codes q, codes c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INT AS rank, neighbour_id, distance
    FROM pairs QUALIFY rank <= {k}"""
