"""Scoring -> cohort statistics (the flagship chain) and its shared intermediate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.sequence import truncate
from quillspark.functions.text import tokens
from quillspark.operators.joins import attach_scores, index_body
from quillspark.operators.scoring import lexical_logits, softmax, threshold, threshold_sweep
from quillspark.plans.fixtures import essay_bodies, essay_index, reviews

# Sequence length of the scoring sets and the two decision thresholds.
SCORE_MAX_LEN = 128
ESSAY_THRESHOLD = 0.94
REVIEW_THRESHOLD = 0.5


def essay_rows(spark: SparkSession, sf_dir: str, max_len: int = SCORE_MAX_LEN) -> DataFrame:
    """J1 -> T1 -> T3 -> F1 -> T4: tokenized essays of at least ``max_len`` tokens, truncated."""
    rows = index_body(essay_index(spark, sf_dir), essay_bodies(spark, sf_dir), "filename")
    rows = rows.withColumn("tokens", tokens("text")).withColumn("text_len", F.size("tokens"))
    rows = rows.filter(F.col("text_len") >= max_len)
    return rows.withColumn("tokens", truncate("tokens", max_len))


def essay_scores(spark: SparkSession, sf_dir: str, max_len: int = SCORE_MAX_LEN) -> DataFrame:
    """D10 -> D1: (filename, fake, real) for every essay that passes the length filter."""
    scored = softmax(lexical_logits(essay_rows(spark, sf_dir, max_len)))
    return scored.select("filename", "fake", "real")


def essay_cohort_rows(spark: SparkSession, sf_dir: str, t: float = ESSAY_THRESHOLD) -> DataFrame:
    """D4 -> J2: index rows with their thresholded correctness (0/1)."""
    decided = threshold(essay_scores(spark, sf_dir), t).select(
        "filename", "real", F.col("correct").cast("int").alias("correct")
    )
    return attach_scores(essay_index(spark, sf_dir), decided, "filename")


def cohort_accuracy(spark: SparkSession, sf_dir: str, thresholds: Sequence[float] = (REVIEW_THRESHOLD, ESSAY_THRESHOLD)) -> DataFrame:
    """Flagship: accuracy of the detector per essay score level at each threshold (A1 + A2)."""
    decided = threshold_sweep(essay_scores(spark, sf_dir), thresholds).select("filename", "threshold", "correct")
    rows = attach_scores(essay_index(spark, sf_dir), decided, "filename")
    return rows.groupBy("threshold", "score_level").agg(
        F.count("correct").alias("n"),
        F.avg(F.col("correct").cast("int").cast("double")).alias("accuracy"),
    )


def review_rows(spark: SparkSession, sf_dir: str, t: float = REVIEW_THRESHOLD, max_len: int = SCORE_MAX_LEN) -> DataFrame:
    """Reviews scored on their first ``max_len`` tokens (no length filter) and thresholded.

    Metadata and scores come from the same rows here, so no join is needed: one pass.
    """
    meta = reviews(spark, sf_dir).withColumn("tokens", truncate(tokens("review_text"), max_len))
    scored = threshold(softmax(lexical_logits(meta)), t)
    return scored.drop("review_text", "tokens", "l_fake", "l_real", "fake").withColumn(
        "correct", F.col("correct").cast("int")
    )


def essay_dataset(spark: SparkSession, sf_dir: str, max_len: int = SCORE_MAX_LEN, skip_tokens: bool = False) -> DataFrame:
    """P8 rows handed to a model: (id, token_ids, mask, label, text), label 1 (human essays).

    T14: with ``skip_tokens`` the raw text comes back with empty id/mask arrays and no length
    filter; the tokenization columns are then never computed (Catalyst prunes them).
    """
    from quillspark.functions.sequence import mask_ones, special_pad
    from quillspark.operators.tokens import CLS_ID, SEP_ID, build_vocab, lookup_ids

    rows = index_body(essay_index(spark, sf_dir), essay_bodies(spark, sf_dir), "filename")
    if skip_tokens:
        empty = F.array().cast("array<int>")
        return rows.select(F.col("filename").alias("id"), empty.alias("token_ids"), empty.alias("mask"),
                           F.lit(1).alias("label"), "text")
    rows = rows.withColumn("tokens", tokens("text")).filter(F.size("tokens") >= max_len)
    rows = rows.withColumn("tokens", truncate("tokens", max_len))
    ids = lookup_ids(rows, build_vocab(rows), "filename")
    out = rows.join(ids, "filename").withColumn("token_ids", special_pad("ids", max_len, CLS_ID, SEP_ID))
    return out.select(F.col("filename").alias("id"), "token_ids", mask_ones("token_ids").alias("mask"),
                      F.lit(1).alias("label"), F.array_join("tokens", " ").alias("text"))
