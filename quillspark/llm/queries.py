"""The registered queries of this subpackage and their DuckDB texts (``QUERIES``, ``SQL``).

Each query applies its operator to whole tables with production parameters and derives the columns that are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import alignment, decontaminate, exact_dedup, hard_negatives, language_id, line_dedup, lm_scoring, mixing, ngram_join, pii, quality, substring_dedup, suffix_dedup
from quillspark.llm.sql import SQL  # noqa: F401
from quillspark.llm.store import read_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_documents(spark, sf_dir).select("doc_id", "text"), read_documents(spark, sf_dir, "labels"))


@register
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 100 * intersection >= 90 * union."""
    return ngram_join.jaccard_components(read_documents(spark, sf_dir).select("doc_id", "text"), n=3, num=9, den=10)


@register
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source for each document; the mix takes 150% of all words, by weights 5, 2, 1 over the sources in order."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "source")
    out = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")), mixing.query_quotas())
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


@register
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words."""
    return substring_dedup.without_repeats(read_documents(spark, sf_dir).select("doc_id", "text")).drop("removed")


@register
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = read_documents(spark, sf_dir).select("doc_id", "text"), read_documents(spark, sf_dir, "benchmark")
    found = decontaminate.benchmark_hits(docs, bench)
    n = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


@register
def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.fuzzy_line_dedup(read_documents(spark, sf_dir).select("doc_id", "text"))
    return out.withColumn("removed", F.array_join("removed", ","))


@register
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_scores(read_documents(spark, sf_dir).select("doc_id", "text", "lang"))


@register
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the texts of ``conversations``; background: all documents but the one that is scored."""
    docs, target = read_documents(spark, sf_dir).select("doc_id", "text"), read_documents(spark, sf_dir, "conversations").select("text")
    out = lm_scoring.cross_entropy_difference(docs, target, leave_out=True)
    return out.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")))


@register
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count the base spans; ``spans`` also has what was discovered."""
    out = pii.personal_data(read_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(pii.span_text("base"), 256).alias("base_sha256"), pii.span_text("spans").alias("spans"))


@register
def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh vector are moved on by one; components become whole numbers."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = read_documents(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), hard_negatives.quantised("embedding").alias("vector"))
    return hard_negatives.hard_negatives(rows)


@register
def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 bytes."""
    return suffix_dedup.without_repeats(read_documents(spark, sf_dir).select("doc_id", "text")).drop("spans")


@register
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer_alignment(read_documents(spark, sf_dir).select("doc_id", "text"))


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline.py``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
