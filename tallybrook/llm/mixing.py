"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Method: a source's target beyond its size is met by complete epochs; the rest is a selection without
replacement. Every document draws an exponential key, divided by its quality weight; documents are
taken in key order until the rest of the budget is spent, the one at the border if that brings the
sum nearer. Keys follow from the id alone, so reruns agree.

A source is not sorted in one task: its keys fall into bins of bounded size, bins are prefix-summed,
and only the bin at the border is looked into. Rows of equal key, id and size are one class, with their
number: classes before the border are taken whole, and of the class at the border as many rows as the
budget allows. These are found by numbering its rows in salts of bounded size.

Cases: null texts and texts without words have size 0 and are never taken; a null source is a source
of its own, the last one; documents with the same id, and so the same key, are ordered by size, equal
rows being interchangeable; a null id draws its key from the text; a source without words has target
0; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import WORD, salted_left_join, staged, with_plain_names

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
BIN_DOCS = 4000  # documents of one source in a bin, on average
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column, size: Column) -> Column:
    """1 for clean text, down to 0.25 as symbols approach one a word; in quarters."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(4 * symbols > 3 * size, 0.25).when(4 * symbols > 2 * size, 0.5).when(4 * symbols > size, 0.75).otherwise(1.0)


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), from the first 52 bits of the md5 of the id as text; without an id, of the text."""
    seed = F.concat(F.lit("mix-"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), text)))
    return (F.conv(F.substring(F.md5(seed.cast("binary")), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Rows (source, source_size) with `target`: shares by weight of all sizes, filled up like water
    below caps of `max_repeats` times the size. One row per source, so one task orders them."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)) + 1).cast("bigint")
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    rows = rows.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    # in order of cap by weight, the first source that stays below its cap sets the level for the rest
    level = F.when(F.col("cap") * F.col("left_weight") > F.col("left") * F.col("weight"), F.col("left") / F.col("left_weight"))
    level = F.first(level, ignorenulls=True).over(everything)
    capped = F.coalesce(F.col("cap") <= F.col("level") * F.col("weight"), F.lit(True))
    return rows.withColumn("level", level).select(
        "source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target")
    )


def _keyed(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """`docs` with __id, __source, __size and __key; the sampling key is exp(__key), larger comes first."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    return docs.withColumns({"__id": F.col(id_column), "__source": F.col(source_column), "__size": size}).withColumn(
        "__key", F.log(uniform(F.col("__id"), text)) / quality_weight(text, F.col("__size"))
    )


def _class_of() -> Column:
    """Orders the rows of a source; rows that are equal here are interchangeable."""
    return F.struct(-F.col("__key"), "__id", "__size")


def cutoffs(keyed: DataFrame) -> DataFrame:
    """One row per source: source_size, target, epochs, and the class at the border of the selection
    (`border`) with the number of its rows (`border_rows`) and how many of them are taken (`border_taken`).

    All rows before the border's class are selected and none after it, as a document's middle only
    moves up in the order of keys. keyed: __id, __source, __size, __key.
    """
    sources = keyed.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"), F.count("*").alias("docs"))
    sources = staged(sources, "mix-sources")
    bins = sources.select(F.col("source").alias("s"), F.ceil(F.col("docs") / BIN_DOCS).alias("bins"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets(sources.select("source", "source_size")).withColumn("epochs", epochs)
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = staged(plan.join(bins, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-plan")

    per_source = plan.select(F.col("source").alias("__source"), "bins", "rest")
    spread = salted_left_join(keyed, per_source, ["__source"])
    spread = spread.withColumn("bin", F.least(F.floor((1 - F.exp("__key")) * F.col("bins")), F.col("bins") - 1))
    earlier = Window.partitionBy("__source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("__source", "bin").agg(F.sum("__size").alias("bin_size"), F.first("rest").alias("rest"))
    sums = staged(sums.withColumn("bin_before", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0))), "mix-bins")
    border = sums.where((F.col("bin_before") <= F.col("rest")) & (F.col("bin_before") + F.col("bin_size") > F.col("rest")))
    border = border.select(F.col("__source").alias("s"), F.col("bin").alias("b"), "bin_before")
    inside = spread.join(border, F.col("__source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    classes = inside.groupBy("__source", "__key", "__id", "__size").agg(F.count("*").alias("n"), F.first("bin_before").alias("bin_before"), F.first("rest").alias("rest"))
    running = Window.partitionBy("__source").orderBy(_class_of()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("bin_before") + F.coalesce(F.sum(F.col("n") * F.col("__size")).over(running), F.lit(0))
    classes = classes.withColumn("before", before)

    def fits(rows: Column) -> Column:
        """Whether so many rows of the class are taken: the middle of the last one lies within the budget."""
        return F.col("before") + (rows - 1) * F.col("__size") + F.col("__size") / 2 <= F.col("rest")

    # the quotient may be off by one where it is rounded; the condition itself decides
    about = F.floor((F.col("rest") - F.col("before")) / F.greatest("__size", F.lit(1)) + 0.5).cast("bigint")
    taken = F.when(fits(about + 1), about + 1).when(fits(about), about).otherwise(about - 1)
    taken = F.when(fits(F.col("n")), F.col("n")).otherwise(F.greatest(taken, F.lit(0).cast("bigint")))
    # the first class that is not taken whole, or else the last one before the next bin's first row
    one = F.struct(_class_of().alias("border"), "n", "taken")
    classes = classes.withColumn("taken", taken).groupBy(F.col("__source").alias("s"))
    first = classes.agg(F.coalesce(F.min(F.when(F.col("taken") < F.col("n"), one)), F.max(one)).alias("first"))
    found = plan.select("source", "source_size", "target", "epochs").join(first, F.col("source").eqNullSafe(F.col("s")), "left")
    found = found.select("source", "source_size", "target", "epochs", "first.border", F.col("first.n").alias("border_rows"), F.col("first.taken").alias("border_taken"))
    return staged(found, "mix-cutoffs")


def _numbered(rows: DataFrame) -> DataFrame:
    """Add __number: 1, 2, ... over the rows of a source, in any order. rows: __source, __border_rows.

    A source is numbered in salts of some `BIN_DOCS` rows. The rows are written first, so that a number
    stays what it is when a task runs again.
    """
    rows = staged(rows.withColumn("__row", F.monotonically_increasing_id()), "mix-border")
    salt = F.pmod(F.xxhash64("__row"), F.ceil(F.col("__border_rows") / BIN_DOCS)).alias("__part")
    rows = rows.withColumn("__part", salt)
    order = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__source", "__part").agg(F.count("*").alias("n"))
    sizes = sizes.select(F.col("__source").alias("s"), F.col("__part").alias("p"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__source", "__part").orderBy("__row"))
    numbered = rows.withColumn("__own", own).join(sizes, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__part") == F.col("p")))
    return numbered.withColumn("__number", F.col("__own") + F.col("__before")).drop("s", "p", "__before", "__own", "__part", "__row")


def _copied(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Add __source_size, __target and __copies. keyed: __id, __source, __size, __key and more."""
    plan = plan.withColumnsRenamed({c: f"__{c}" for c in plan.columns if c != "source"})
    # the rows at the border have its id, so that only these are looked at closely
    border = plan.where("__border_taken > 0").select(F.col("source").alias("s"), F.col("__border").alias("b"), "__border_rows")
    at_border = keyed.join(border, F.col("__source").eqNullSafe(F.col("s")) & F.col("__id").eqNullSafe(F.col("b.__id")))
    at_border = at_border.where(_class_of().eqNullSafe(F.col("b"))).drop("s", "b")
    chosen = _numbered(at_border).drop("__border_rows")
    rows = salted_left_join(keyed, plan.withColumnRenamed("source", "__source"), ["__source"])
    away = rows.where("__border IS NULL OR __border_taken = 0").unionByName(rows.where(~_class_of().eqNullSafe(F.col("__border"))).where("__border_taken > 0"))
    close = salted_left_join(chosen, plan.withColumnRenamed("source", "__source"), ["__source"])
    both = away.withColumn("__number", F.lit(None).cast("bigint")).unionByName(close)
    picked = F.when(F.col("__number").isNull(), _class_of() < F.col("__border")).otherwise(F.col("__number") <= F.col("__border_taken"))
    picked = F.coalesce(picked, F.lit(False)).cast("bigint")
    return both.withColumn("__copies", F.when(F.col("__size") > 0, F.col("__epochs") + picked).otherwise(0))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """id, source, size, source_size, target, taken (words) and copies of every document."""
    keyed = _keyed(docs.select(id_column, text_column, source_column), id_column, text_column, source_column)
    keyed = staged(keyed.select("__id", "__source", "__size", "__key"), "mix-keys")
    rows = _copied(keyed, cutoffs(keyed))
    return rows.select(
        F.col("__id").alias(id_column), F.col("__source").alias(source_column), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"),
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; texts are not shuffled for sampling."""

    def mixed(rows: DataFrame) -> DataFrame:
        keyed = _keyed(rows, id_column, text_column, source_column)
        small = staged(keyed.select("__id", "__source", "__size", "__key"), "mix-keys")
        copied = _copied(keyed, cutoffs(small)).where("__copies > 0")
        return copied.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).select(*rows.columns)

    return with_plain_names(docs, [id_column, text_column, source_column], mixed)


def oracle(documents: str = "documents", select: str = "doc_id, size, source_size, target, taken") -> str:
    weight = "CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END"
    return f"""WITH sized AS (SELECT *, coalesce(text, '') AS t, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS symbols FROM {documents}),
    keyed AS (SELECT * EXCLUDE (t), ln((('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, 'null' || t)), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE)
        / CASE WHEN 4 * symbols > 3 * size THEN 0.25::DOUBLE WHEN 4 * symbols > 2 * size THEN 0.5 WHEN 4 * symbols > size THEN 0.75 ELSE 1 END AS key FROM sized),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
    weighed AS (SELECT *, {weight} AS weight, source_size * {MAX_REPEATS} AS cap FROM sources),
    filled AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS rest_weight
        FROM weighed WINDOW f AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    levelled AS (SELECT *, first_value(CASE WHEN cap * rest_weight > rest * weight THEN rest::DOUBLE / rest_weight::DOUBLE END IGNORE NULLS) OVER
            (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM filled),
    plan AS (SELECT source, source_size, CASE WHEN level IS NULL OR cap <= level * weight THEN cap::DOUBLE ELSE level * weight END AS target FROM levelled),
    budget AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs, target - epochs * source_size AS rest FROM plan),
    ranked AS (SELECT k.*, b.source_size, b.target, b.epochs, b.rest, sum(size) OVER (PARTITION BY k.source ORDER BY key DESC, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS earlier
        FROM keyed k JOIN budget b ON k.source IS NOT DISTINCT FROM b.source),
    result AS (SELECT *, CASE WHEN size > 0 THEN epochs + (earlier + size / 2 <= rest)::INT ELSE 0 END::BIGINT AS copies, copies * size AS taken FROM ranked)
    SELECT {select} FROM result"""
