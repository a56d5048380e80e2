"""Registered queries: count-table detector (D8, D9) and incremental streaming scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.operators import detector as DT
from quillspark.plans.q_prep import labelled
from quillspark.plans.registry import register, rounded
from quillspark.session import scratch_path, table
from quillspark.streaming.incremental import run_incremental, scored_batches

STREAM_FILES = 3


# first hex digits of the text hash: 0-2 test, 3-5 validation, the rest training
SPLIT = {"test_below": "3", "valid_below": "6"}


def detector_corpus(spark, sf_dir):
    # read for training, validation and test: hashed and tokenized once, each split in a folder of its own
    rows = DT.hash_split(labelled(spark, sf_dir), **SPLIT).select("id", "label", F.array_distinct(tokens("text")).alias("tokens"), "split")
    path = scratch_path(spark, "detector-corpus")
    rows.write.partitionBy("split").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def fitted(spark, sf_dir):
    c = detector_corpus(spark, sf_dir)
    model = DT.fit_counts(c.filter(F.col("split") == "train"))
    return c, model, DT.choose_smoothing(model, c.filter(F.col("split") == "valid"))


@register("D8_train_detector")
def q_d8(spark, sf_dir):
    return rounded(fitted(spark, sf_dir)[2])


@register("D9_score_detector")
def q_d9(spark, sf_dir):
    """Rows that neither fitted nor chose the model."""
    c, model, metrics = fitted(spark, sf_dir)
    best = metrics.filter("best").first()["smoothing"]
    return rounded(DT.score_counts(model, c.filter(F.col("split") == "test"), best))


def length_scorer(texts):
    """Stand-in for a user's model: (n, 2) logits [fake, real] from the number of characters."""
    import numpy as np

    n = texts.str.len().to_numpy(dtype=float)
    return np.stack([np.zeros(len(n)), np.log1p(n) - 6.0], axis=1)


@register("D9_user_scorer")
def q_d9_user(spark, sf_dir):
    """Every labelled text through a scorer that the caller brings."""
    return rounded(DT.score_with(labelled(spark, sf_dir), length_scorer))


@register("D11_incremental_score")
def q_d11(spark, sf_dir):
    base = scratch_path(spark, "stream")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # files arrive in three drops; each is picked up by its own micro-batch, however many files it has
    for i in range(STREAM_FILES):
        docs.filter(F.pmod(F.col("doc_id"), F.lit(STREAM_FILES)) == i).write.parquet(f"{base}/in/drop={i}")
        run_incremental(spark, f"{base}/in/*", "doc_id long, text string", f"{base}/out", f"{base}/ckpt")
    return rounded(scored_batches(spark, f"{base}/out"))
