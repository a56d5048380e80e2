"""Registered queries: flagship, cohort statistics (A*) and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.operators import cohorts as A
from quillspark.operators import scoring as D
from quillspark.operators.indexing import with_row_index
from quillspark.operators.joins import union_origins
from quillspark.plans.detector import (
    ESSAY_THRESHOLD, cohort_accuracy, essay_cohort_rows, essay_scores, review_rows,
)
from quillspark.plans.fixtures import generated_web_text, real_web_text
from quillspark.plans.registry import register, rounded
from quillspark.session import table

DETECTOR_BATCH = 32


@register("flagship_cohort_accuracy")
def q_flagship(spark, sf_dir):
    return rounded(cohort_accuracy(spark, sf_dir))


@register("A1_count_by")
def q_a1(spark, sf_dir):
    return A.count_by(essay_cohort_rows(spark, sf_dir), "score_level")


@register("A2_mean_by")
def q_a2(spark, sf_dir):
    return rounded(A.mean_by(review_rows(spark, sf_dir), "urbanicity"))


@register("A3_profile_by")
def q_a3(spark, sf_dir):
    return rounded(A.profile_by(essay_cohort_rows(spark, sf_dir), "language"))


@register("A4_above_mean")
def q_a4(spark, sf_dir):
    rows = review_rows(spark, sf_dir)
    rows = A.above_mean(rows, ["singleparent_share2010", "perwht"])
    # both covariates in one pass over the rows
    sides = [F.struct(F.lit(cov).alias("covariate"), F.col(f"{cov}_aboveavg").alias("above"))
             for cov in ("singleparent_share2010", "perwht")]
    rows = rows.select("correct", F.inline(F.array(*sides)))
    return rounded(rows.groupBy("covariate", "above").agg(
        F.count("correct").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")))


@register("A5_crosstab")
def q_a5(spark, sf_dir):
    return A.crosstab(essay_cohort_rows(spark, sf_dir), "score_level")


@register("A6_fisher_pairs")
def q_a6(spark, sf_dir):
    ct = A.crosstab(essay_cohort_rows(spark, sf_dir), "score_level")
    return rounded(A.fisher_pairs(ct, "score_level"))


@register("A7_std_by")
def q_a7(spark, sf_dir):
    return rounded(A.std_by(essay_cohort_rows(spark, sf_dir), "score_level"))


@register("A8_ttest_pairs")
def q_a8(spark, sf_dir):
    return rounded(A.ttest_pairs(essay_cohort_rows(spark, sf_dir, 0.5), "score_level"))


@register("A9_chisq")
def q_a9(spark, sf_dir):
    ct = A.crosstab(essay_cohort_rows(spark, sf_dir, 0.5), "score_level")
    return rounded(A.chisq(ct))


def labelled_corpus(spark, sf_dir):
    """Real web text (label 1) and generated turns (label 0) with their tokens."""
    real = real_web_text(spark, sf_dir).select("id", "text", F.lit(1).alias("label"))
    gen = generated_web_text(spark, sf_dir).select("id", "text", F.lit(0).alias("label"))
    both = union_origins(real, gen)
    return both.withColumn("tokens", tokens("text"))


@register("A11_corpus_report")
def q_a11(spark, sf_dir):
    c = labelled_corpus(spark, sf_dir).withColumn("text_len", F.size("tokens"))
    c = c.withColumn("origin", F.when(F.col("label") == 1, F.lit("real")).otherwise(F.lit("generated")))
    return rounded(A.corpus_report(c, ["origin"]))


@register("D1_softmax")
def q_d1(spark, sf_dir):
    return rounded(essay_scores(spark, sf_dir))


@register("D2_argmax")
def q_d2(spark, sf_dir):
    d = D.argmax(D.lexical_logits(labelled_corpus(spark, sf_dir)))
    return d.select("id", "label", "pred", "correct")


@register("D3_correct_rule")
def q_d3(spark, sf_dir):
    d = D.correct_by_rule(D.softmax(D.lexical_logits(labelled_corpus(spark, sf_dir))))
    return rounded(d.select("id", "label", "fake", "real", "correct"))


@register("D4_threshold")
def q_d4(spark, sf_dir):
    d = D.threshold_sweep(essay_scores(spark, sf_dir), (0.5, ESSAY_THRESHOLD))
    return d.select("filename", "threshold", "correct")


@register("D5_cross_entropy")
def q_d5(spark, sf_dir):
    return rounded(D.cross_entropy(D.lexical_logits(labelled_corpus(spark, sf_dir))))


@register("D6_epoch_metrics")
def q_d6(spark, sf_dir):
    c = D.lexical_logits(labelled_corpus(spark, sf_dir)).select("id", "label", "l_fake", "l_real")
    c = with_row_index(c, ["label", "id"]).withColumn("batch_id", F.floor(F.col("row_idx") / DETECTOR_BATCH))
    # (label, id) ascending puts generated rows first; the order is part of the batch definition
    return rounded(D.epoch_metrics(c))


@register("D7_last_write")
def q_d7(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", balance=True).select(
        F.col("conv_id").cast("string").alias("id"), "turn", tokens("text").alias("tokens")
    )
    c = D.softmax(D.lexical_logits(c))
    return rounded(D.last_write(c, "id", "turn", ["turn", "fake", "real"]))


@register("D10_lexical_score")
def q_d10(spark, sf_dir):
    d = table(spark, sf_dir, "documents", balance=True).select("doc_id", tokens("text").alias("tokens"))
    return rounded(D.lexical_logits(d).select("doc_id", "l_fake", "l_real"))
