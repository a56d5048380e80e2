"""Scoring and detector metrics (D1-D7, D10) as column expressions and aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.labels import argmax_pred, correct_rule, softmax_fake, softmax_real
from quillspark.functions.text import type_token_ratio

# Fixed values of the stand-in scorer: logit = SCALE * (type-token ratio of the first WINDOW tokens - CENTER).
LEXICAL_WINDOW = 128
LEXICAL_SCALE = 8.0
LEXICAL_CENTER = 0.45


def lexical_logits(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Deterministic stand-in scorer; logits (fake, real) = (0, z)."""
    ratio = type_token_ratio(tokens_col, LEXICAL_WINDOW)
    return df.withColumn("l_fake", F.lit(0.0)).withColumn("l_real", F.lit(LEXICAL_SCALE) * (ratio - LEXICAL_CENTER))


def softmax(df: DataFrame, l_fake: str = "l_fake", l_real: str = "l_real") -> DataFrame:
    """Probabilities in the order [fake, real]."""
    return df.withColumn("fake", softmax_fake(l_fake, l_real)).withColumn("real", softmax_real(l_fake, l_real))


def argmax(df: DataFrame, label: str = "label") -> DataFrame:
    """Predicted class and correctness from logits."""
    return df.withColumn("pred", argmax_pred("l_fake", "l_real")).withColumn(
        "correct", F.col("pred") == F.col(label)
    )


def correct_by_rule(df: DataFrame, label: str = "label") -> DataFrame:
    """D3: correctness from probabilities; a tie is incorrect."""
    return df.withColumn("correct", correct_rule("fake", "real", label))


def threshold(df: DataFrame, t: float | str, real: str = "real") -> DataFrame:
    """Re-decide with a strict ``real > t`` (inputs are all human, so correct = predicted human).

    ``t`` is a number or the name of a column holding per-row thresholds (a sweep).
    """
    tc = F.col(t) if isinstance(t, str) else F.lit(float(t))
    return df.withColumn("correct", F.col(real) > tc)


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], real: str = "real") -> DataFrame:
    """D4 over several thresholds: one copy of each row per threshold (a generator, not a join)."""
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    return threshold(df.withColumn("threshold", F.explode(arr)), "threshold", real)


def nll(l_fake: str = "l_fake", l_real: str = "l_real", label: str = "label") -> F.Column:
    """-ln p(label) from logits via log-sum-exp (stable)."""
    lf, lr = F.col(l_fake), F.col(l_real)
    m = F.greatest(lf, lr)
    lse = m + F.log(F.exp(lf - m) + F.exp(lr - m))
    return lse - F.when(F.col(label) == 1, lr).otherwise(lf)


def cross_entropy(df: DataFrame, label: str = "label") -> DataFrame:
    """Mean cross-entropy over all rows."""
    return df.agg(F.avg(nll(label=label)).alias("loss"))


def epoch_metrics(df: DataFrame, batch_col: str = "batch_id", label: str = "label") -> DataFrame:
    """Mean of per-batch mean loss and accuracy, plus the exact row means.

    Two aggregations: per batch (partial aggregation keeps it map-side), then a global one.
    """
    per_row = df.select(
        batch_col,
        nll(label=label).alias("_loss"),
        (argmax_pred("l_fake", "l_real") == F.col(label)).cast("int").alias("_acc"),
    )
    per_batch = per_row.groupBy(batch_col).agg(
        F.avg("_loss").alias("b_loss"), F.avg("_acc").alias("b_acc"),
        F.sum("_loss").alias("s_loss"), F.sum("_acc").alias("s_acc"), F.count(F.lit(1)).alias("n"),
    )
    return per_batch.agg(
        F.avg("b_loss").alias("avg_loss"),
        F.avg("b_acc").alias("avg_acc"),
        (F.sum("s_loss") / F.sum("n")).alias("row_loss"),
        (F.sum("s_acc") / F.sum("n")).alias("row_acc"),
        F.count(F.lit(1)).alias("n_batches"),
    )


def last_write(df: DataFrame, id_col: str, order_col: str, value_cols: Sequence[str]) -> DataFrame:
    """One row per id keeping the values of the last occurrence in processing order."""
    s = F.struct(*[F.col(c) for c in value_cols])
    agg = df.groupBy(id_col).agg(F.max_by(s, F.col(order_col)).alias("_last"))
    return agg.select(id_col, *[F.col(f"_last.{c}").alias(c) for c in value_cols])


def pad_to_batch_max(df: DataFrame, ids_col: str, batch_col: str, pad_id: int = 0) -> DataFrame:
    """Pad every row to the longest row of its mini-batch (batches hold a bounded k rows)."""
    w = Window.partitionBy(batch_col)
    longest = F.max(F.size(ids_col)).over(w)
    return df.withColumn(
        ids_col, F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id), longest - F.size(ids_col)))
    )
