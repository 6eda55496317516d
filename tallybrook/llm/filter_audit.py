"""Audit of how filters interact: what every order of five filters removes, step by step.

Method: a document becomes a mask of the filters it fails, and a part (its language) becomes mask
cells with their counts. A recursive CTE starts with an empty prefix per part; each level extends
every prefix by each unused letter, carries the bits applied so far, joins the part's mask cells and
emits that step's metrics from them. A prefix serves all orders that begin with it, so a part has 325
steps to compute instead of 600.

Filter E (a copy of a smaller id's text) asks about the whole table. Texts are told apart by a 128-bit
hash and their length. Rows are first counted per (text, id), then per (text, part, label) with the
rows that hold the group's smallest id kept apart; only these few rows of a text meet, so a text with
a third of all rows sends one row per part, label and task.

Cases: a null text counts as an empty one, a null language as the part ''; empty texts are copies of
each other; rows that repeat an id are no copies of each other, as none is smaller; a null id is
neither smaller than any nor has any smaller; a document is good (toxic) if any label row of its id
says so, and a null id has no label; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import UPPER, let, salted_left_join, staged, words

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
# A part has 326 rows of recursion; Spark's own limit would stop at some 3,000 parts.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D, which look at one text only."""

    def of(w: Column) -> Column:
        upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
        fails = [F.size(w) < 100, 100 * F.size(F.array_distinct(w)) < 80 * F.size(w), 10 * upper > F.length(text), text.rlike(r"[#$%&*|]")]
        return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))

    return let(words(text), of)


def _facts(docs: DataFrame, id_column: str, text_column: str, part_column: str) -> DataFrame:
    """One narrow row per document: id, part, mask, and a digest that tells its text from others."""
    text = F.coalesce(text_column, F.lit(""))
    digest = F.struct(F.unhex(F.md5(text.cast("binary"))).alias("hash"), F.length(text).alias("length"))
    return docs.select(F.col(id_column).alias("id"), F.coalesce(part_column, F.lit("")).alias("part"), own_mask(text).alias("mask"), digest.alias("digest"))


def _labelled(facts: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good OR toxic")
    flags = {name: F.coalesce(name, F.lit(False)) for name in ("good", "toxic")}
    return salted_left_join(facts, known, ["id"], grows=True).withColumns(flags)


def mask_cells(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents per part and set of failed filters, among them labelled ones."""
    facts = staged(_facts(docs, id_column, text_column, part_column), "audit-facts")
    own = ["digest", "part", "mask", "good", "toxic"]
    per_id = _labelled(facts, labels, id_column).groupBy(*own, "id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    per_text = per_id.groupBy(*own).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), first.alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    originals = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    counted = per_text.withColumn("least", least).withColumn("originals", originals)
    sides = F.array(F.struct("mask", F.col("originals").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    rows = counted.select("part", "good", "toxic", F.inline(sides)).where("n > 0")

    def among(flag: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0)).alias(flag)

    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), among("good"), among("toxic"))


def _recursion() -> str:
    """Rows (part, prefix, applied, letter, step) with the metrics of the step that ends the prefix."""
    letters = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(LETTERS))
    earlier, now = "(e.mask & w.applied) <> 0", "(e.mask & x.bit) <> 0"
    metrics = {
        "kept": (f"NOT {earlier} AND NOT {now}", "n"),
        "removed": (f"NOT {earlier} AND {now}", "n"),
        "redundant": (f"{earlier} AND {now}", "n"),
        "unique_fails": ("e.mask = x.bit", "n"),
        "good_lost": (f"NOT {earlier} AND {now}", "good"),
        "toxic_lost": (f"NOT {earlier} AND {now}", "toxic"),
    }
    summed = ", ".join(f"aggregate(filter(c.cells, e -> {which}), 0L, (total, e) -> total + e.{count})" for which, count in metrics.values())
    return f"""WITH RECURSIVE walk (part, prefix, applied, letter, step, {", ".join(metrics)}) AS (
        SELECT part, '', 0, '', 0, {", ".join("0L" for _ in metrics)} FROM {{cells}}
        UNION ALL
        SELECT w.part, w.prefix || x.letter, w.applied | x.bit, x.letter, w.step + 1, {summed}
        FROM walk w JOIN {{cells}} c ON w.part = c.part
        LATERAL VIEW explode(filter(array({letters}), x -> (w.applied & x.bit) = 0)) unused AS x)
    SELECT * FROM walk WHERE step > 0"""


def prefix_steps(cells: DataFrame) -> DataFrame:
    """The metrics of every prefix of every order, per part."""
    spark = cells.sparkSession
    per_part = staged(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "audit-cells")
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return staged(spark.sql(_recursion(), cells=per_part), "audit-steps")
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """One row per part, order of the filters, and step."""
    steps = prefix_steps(mask_cells(docs, labels, id_column, text_column, part_column))
    # an order shares its prefix of length k with (5 - k)! orders
    orders_of = F.element_at(F.array(*[F.lit(factorial(len(LETTERS) - k)) for k in range(1, len(LETTERS) + 1)]), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_of).alias("shapley"))
    whole = steps.where(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    places = whole.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("at"))
    places = places.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("at"))).drop("at")
    return places.join(steps, ["part", "prefix"]).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def oracle(documents: str = "documents", labels: str = "labels") -> str:
    """Every order walked by itself over single documents, without cells or shared prefixes."""
    return f"""WITH known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id),
    texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
    judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
        FROM texts LEFT JOIN known USING (doc_id)),
    docs AS (SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL),
    letter AS (SELECT unnest(string_split('ABCDE', '')) AS x),
    orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
    asked AS (SELECT d.*, s.filter_order, s.step, fails[ascii(filter_order[s.step]) - 64] AS here,
        len(list_filter(range(1, s.step), lambda k: fails[ascii(filter_order[k]) - 64])) > 0 AS before, len(list_filter(fails, lambda f: f)) AS failed
        FROM docs d, steps s),
    metrics AS (SELECT part, filter_order, step, filter_order[step] AS x,
        sum(CASE WHEN NOT before AND NOT here THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT before AND here THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN before AND here THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN NOT before AND here AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT before AND here AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
        FROM asked GROUP BY part, filter_order, step)
    SELECT * EXCLUDE (x, step), step::INT AS step, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM metrics"""
