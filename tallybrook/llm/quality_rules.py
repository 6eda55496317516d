"""Quality rules: base rules per document, then verdicts per host from shrunk failure rates.

Method: failures of the base rules are counted per host (the `source` of a document); an empirical
beta prior is fitted to all hosts' rates by moments; each host's posterior mean is its shrunk rate.
A host beyond `MAX_RATE` is rejected with all its documents.

Cases: a null text has no words and fails; a null host is a host of its own; repeated rows count as
often as they stand; a rate equal to `MAX_RATE` keeps; with one host, or hosts with equal rates, the
prior has no spread and counts as `FLAT` documents at the common rate; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import WHITE_SPACE, let, salted_left_join, staged, with_plain_names, words

MAX_RATE = 0.8
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
FLAT = 100.0
SYMBOLS = "#*$%&|<>"  # fixed value


def repeated_words(all_words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash within one text: below 10^-10 chance of a collision in a
    text of 20,000 words.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - x, F.lit(3)))),
            F.lit(0).cast("bigint"),
            lambda total, x: total + x,
        )

    def twice(windows: Column) -> Column:
        found = F.filter(
            windows,
            lambda x, i: F.coalesce(F.get(windows, i + 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(windows, i - 1)["h"] == x["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
        return F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(let(F.sort_array(hashed), twice))

    return windows(all_words)


def base_features(docs: DataFrame, keep: list[Column], text_column: str = "text") -> DataFrame:
    """The columns `keep` of every document with the five counts and `base_failed`."""
    text = F.coalesce(text_column, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = F.struct(
        F.length(F.translate(text, WHITE_SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
    )
    # inline keeps the counts from being computed again in each later expression
    found = docs.select(F.struct(*keep).alias("kept"), F.inline(F.array(counts)))
    failed = (F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("w.n_words"))
    return found.select("kept.*", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"))


def host_verdicts(features: DataFrame) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and whether it is rejected."""
    hosts = features.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    moments = hosts.agg((F.sum("failed") / F.sum("docs")).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("spread"))
    spread, even = F.col("spread"), F.col("mean") * (1 - F.col("mean"))
    strength = F.when((spread <= 1e-9) | (even <= 0), FLAT).otherwise(F.greatest(even / spread - 1, F.lit(1.0)))
    shrunk = (F.col("failed") + F.col("strength") * F.col("mean")) / (F.col("docs") + F.col("strength"))
    return (
        hosts.join(F.broadcast(moments.withColumn("strength", strength)), F.lit(True))  # one row
        .select("host", "docs", "failed", shrunk.alias("rate"), (shrunk > MAX_RATE).alias("rejected"))
    )


def judge_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Base features of every document, `base_failed`, and `kept` by base rules and host."""
    features = base_features(docs, [F.col(id_column).alias("id"), F.col(host_column).alias("host")], text_column)
    features = staged(features, "quality-features")
    judged = salted_left_join(features, host_verdicts(features).select("host", "rejected"), ["host"])
    return judged.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("rejected")).alias("kept"),
    )


def kept_documents(docs: DataFrame, text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The rows of `docs` that pass the base rules and whose host is not rejected.

    Documents are written once with their base verdict, which costs less than to judge them twice;
    the hosts' verdicts are written too, so that Spark knows their size and broadcasts them or not.
    """
    return with_plain_names(docs, [text_column, host_column], lambda rows: _kept_documents(rows, text_column, host_column))


def _kept_documents(docs: DataFrame, text_column: str, host_column: str) -> DataFrame:
    whole = F.struct(*docs.columns).alias("doc")
    flagged = base_features(docs, [whole, F.col(host_column).alias("host")], text_column).select("doc", "host", "base_failed")
    flagged = staged(flagged, "quality-documents")
    verdicts = staged(host_verdicts(flagged).select("host", "rejected"), "quality-hosts")
    judged = salted_left_join(flagged.where("not base_failed"), verdicts, ["host"])
    return judged.where("not rejected").select("doc.*")


def base_sql(documents: str = "documents") -> str:
    """The base features in DuckDB: CTEs that end in `base`."""
    return f"""texts AS (SELECT *, coalesce(text, '') AS t, row_number() OVER () AS rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM {documents}),
    grams AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM texts),
    twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
    base AS (SELECT texts.* EXCLUDE (t, w, l), len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
        FROM texts LEFT JOIN repeats USING (rid))"""


def oracle(documents: str = "documents", select: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    return f"""WITH {base_sql(documents)},
    judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM base),
    hosts AS (SELECT source, count(*)::DOUBLE AS docs, count(*) FILTER (base_failed)::DOUBLE AS failed FROM judged GROUP BY source),
    moments AS (SELECT sum(failed) / sum(docs) AS mean, coalesce(var_pop(failed / docs), 0) AS spread FROM hosts),
    prior AS (SELECT mean, CASE WHEN spread <= 1e-9 OR mean * (1 - mean) <= 0 THEN {FLAT} ELSE greatest(mean * (1 - mean) / spread - 1, 1.0) END AS strength FROM moments),
    verdicts AS (SELECT source, (failed + strength * mean) / (docs + strength) > {MAX_RATE} AS rejected FROM hosts, prior),
    result AS (SELECT j.*, NOT base_failed AND NOT rejected AS kept FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source)
    SELECT {select} FROM result"""
