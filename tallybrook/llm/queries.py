"""Registered queries of the operators here, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import filter_audit, hamming_search, jaccard_join, language_id, lm_score, mixing, packing, pieces, quality_model, quality_rules, source_divergence, toxicity, url_filter
from tallybrook.llm.common import fold, staged, table

# The contract's rules.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def op3_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", hamming_search.sign_code(F.col("embedding")).alias("code"))
    return hamming_search.search(vectors, F.col("vec_id") % 20 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identify(docs, model, ["doc_id", held_out.alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), F.col("doc_id"), ["doc_id"])
    return encoded.select("doc_id", "pieces", F.size("pieces").alias("n_pieces"), "lossless")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model, ["doc_id", held_out.alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def graded(labels: DataFrame) -> DataFrame:
    """Grades 0 (bad), 1 (good but toxic), 2 (good and not toxic) of the labelled documents."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    return labels.select("doc_id", grade.alias("grade"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels outside the fifth fold; selects what is likely good and not toxic."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality_model.fit(docs, graded(table(spark, sf_dir, "labels").where(~held_out)))
    rated = quality_model.rate(docs, model, ["doc_id", held_out.alias("held_out")])
    p_good, p_best = F.get("tails", F.lit(0)), F.get("tails", F.lit(1))
    return rated.select("doc_id", "held_out", "expected_grade", p_good.alias("p_good"), p_best.alias("p_best"), (p_good >= 0.5).alias("selected"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = staged(packing.pack(table(spark, sf_dir, "documents")), "packed")
    digest = packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.with_steps(digest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_hamming_search": op3_hamming_search,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_quality_model": op8_quality_model,
    "op9_lm_score": op9_lm_score,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_packing": op13_packing,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.oracle(URL_RULES),
    "op2_quality_rules": quality_rules.oracle(),
    "op3_hamming_search": hamming_search.oracle(),
    "op5_mixing": mixing.oracle(),
    "op10_jaccard_join": jaccard_join.oracle(),
    "op11_filter_audit": filter_audit.oracle(),
    "op12_source_divergence": source_divergence.oracle(),
}
