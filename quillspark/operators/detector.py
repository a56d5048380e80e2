"""Detector training and scoring (D8, D9): smoothed log-odds from count tables, MLlib, and a user-scorer path.

The neural detector is re-aimed as a classifier whose model is a count table: for every token the number of real and of generated
texts that hold it. A text's logit is the sum of its distinct tokens' smoothed log-odds and the prior; smoothing is the grid that is
validated. Fitting is one aggregation and scoring one join on the token, for all grid values at once. The MLlib fit
(HashingTF -> IDF -> LogisticRegression) stays as an option.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.labels import correct_rule

NUM_FEATURES = 1 << 18
REG_GRID = (0.0, 0.01, 0.1)
SMOOTHING_GRID = (0.1, 1.0, 10.0)
# Probabilities below this count as this in a log loss.
LEAST = 1e-15


def hash_split(df: DataFrame, text_col: str = "text", seed: str = "42", valid_below: str = "3", test_below: str = "") -> DataFrame:
    """Split by a hash of the normalised text: exact copies always land on the same side. A first hex digit below ``test_below`` is
    ``test`` (none by default), below ``valid_below`` ``valid``, else ``train``. A null text is ``train``."""
    norm = F.regexp_replace(F.lower(F.trim(F.col(text_col))), r"[\t-\r ]+", " ")
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), norm)), 1, 1)
    return df.withColumn("split", F.when(h < test_below, F.lit("test")).when(h < valid_below, F.lit("valid")).otherwise(F.lit("train")))


@dataclass
class CountModel:
    """``counts`` (token, real, fake): texts of either label that hold the token."""

    counts: DataFrame
    n_real: int
    n_fake: int
    tokens_real: int
    tokens_fake: int
    vocab: int

    def logit(self, smoothing: float) -> F.Column:
        """Summand of one token; a token that was never seen counts as 0."""
        def share(c, total):
            return (F.coalesce(F.col(c), F.lit(0)) + F.lit(smoothing)) / F.lit(total + smoothing * (self.vocab + 1))

        return F.log(share("real", self.tokens_real)) - F.log(share("fake", self.tokens_fake))

    def unseen(self, smoothing: float) -> F.Column:
        share = lambda total: F.lit(0 + smoothing) / F.lit(total + smoothing * (self.vocab + 1))
        return F.log(share(self.tokens_real)) - F.log(share(self.tokens_fake))

    @property
    def prior(self) -> float:
        return float(np.log((self.n_real + 1) / (self.n_fake + 1)))


def fit_counts(train: DataFrame, tokens_col: str = "tokens", label_col: str = "label") -> CountModel:
    """One map-side combined aggregation over the distinct tokens of each text; only totals reach the driver."""
    held = train.select(F.col(label_col).alias("label"), F.explode(F.array_distinct(tokens_col)).alias("token"))
    counts = held.groupBy("token").agg(F.count_if(F.col("label") == 1).alias("real"), F.count_if(F.col("label") == 0).alias("fake")).persist(StorageLevel.MEMORY_AND_DISK)
    r = counts.agg(F.sum("real"), F.sum("fake"), F.count(F.lit(1))).first()
    n = train.agg(F.count_if(F.col(label_col) == 1), F.count_if(F.col(label_col) == 0)).first()
    return CountModel(counts, n[0], n[1], r[0] or 0, r[1] or 0, r[2])


def count_logits(model: CountModel, df: DataFrame, grid: Sequence[float], keys: Sequence[str] = ("id", "label"), tokens_col: str = "tokens") -> DataFrame:
    """(keys..., l_0, l_1, ...): the logit of every row for every smoothing of the grid. One join on the token; ``keys`` name a row."""
    held = df.select(*keys, F.explode_outer(F.array_distinct(tokens_col)).alias("token"))
    # summands belong to the counts, of which there are fewer; a token that was never seen has one summand
    j = held.join(model.counts.select("token", *[model.logit(a).alias(f"_l{i}") for i, a in enumerate(grid)]), "token", "left")
    own = lambda i, a: F.coalesce(f"_l{i}", model.unseen(a))
    return j.groupBy(*keys).agg(*[
        (F.lit(model.prior) + F.sum(F.when(F.col("token").isNotNull(), own(i, a)).otherwise(F.lit(0.0)))).alias(f"l_{i}")
        for i, a in enumerate(grid)])


def choose_smoothing(model: CountModel, valid: DataFrame, grid: Sequence[float] = SMOOTHING_GRID) -> DataFrame:
    """(smoothing, valid_loss, valid_acc, best), one row per grid value; the lowest validation log loss wins, ties go to the smaller value."""
    scored = count_logits(model, valid, grid)
    rows = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("smoothing"), F.col(f"l_{i}").alias("l")) for i, a in enumerate(grid)]))
    each = scored.select("label", rows.alias("r")).select("label", "r.smoothing", "r.l")
    real, fake = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("l"))), F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("l")))
    own = F.greatest(F.when(F.col("label") == 1, real).otherwise(fake), F.lit(LEAST))
    right = F.when(F.col("label") == 1, F.col("l") > 0).otherwise(F.col("l") < 0)
    m = each.groupBy("smoothing").agg(F.avg(-F.log(own)).alias("valid_loss"), F.avg(right.cast("double")).alias("valid_acc"))
    least = m.agg(F.min(F.struct("valid_loss", "smoothing")).alias("least"))
    return m.crossJoin(F.broadcast(least)).select("smoothing", "valid_loss", "valid_acc", (F.col("smoothing") == F.col("least.smoothing")).alias("best"))


def score_counts(model: CountModel, df: DataFrame, smoothing: float, keys: Sequence[str] = ("id", "label")) -> DataFrame:
    """(id, fake, real, correct) for every row, probabilities in the order [fake, real]."""
    s = count_logits(model, df, [smoothing], keys)
    s = s.withColumn("real", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("l_0")))).withColumn("fake", F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("l_0"))))
    return s.select(keys[0], "fake", "real", correct_rule("fake", "real", "label").alias("correct"))


def _probs(pred: DataFrame) -> DataFrame:
    p = vector_to_array("probability")
    return pred.withColumn("fake", p[0]).withColumn("real", p[1])


def validation_metrics(model, valid: DataFrame) -> tuple[float, float]:
    """(log loss, accuracy) on the given validation rows."""
    s = _probs(model.transform(valid))
    py = F.when(F.col("label") == 1, F.col("real")).otherwise(F.col("fake"))
    r = s.agg(F.avg(-F.log(F.greatest(py, F.lit(LEAST)))).alias("loss"),
              F.avg(correct_rule("fake", "real", "label").cast("double")).alias("acc")).first()
    return float(r["loss"]), float(r["acc"])


def train_detector(train: DataFrame, valid: DataFrame, grid: Sequence[float] = REG_GRID):
    """MLlib form of D8: the featurizer (HashingTF -> IDF) is fitted once, then one logistic regression per regularisation value over the
    cached features; the lowest validation log loss wins.

    Returns (best model, metrics DataFrame with one row per grid value).
    """
    spark = train.sparkSession
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=NUM_FEATURES)
    counted = tf.transform(train.select("tokens", F.col("label").cast("double").alias("label")))
    idf = IDF(inputCol="tf", outputCol="features").fit(counted)
    features = idf.transform(counted).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    held = idf.transform(tf.transform(valid.select("tokens", F.col("label").cast("double").alias("label")))).select("features", "label")
    held = held.persist(StorageLevel.MEMORY_AND_DISK)
    results, best = [], None
    for reg in grid:
        fitted = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=100).fit(features)
        loss, acc = validation_metrics(fitted, held)
        results.append((float(reg), loss, acc))
        if best is None or loss < best[1]:
            best = (PipelineModel(stages=[tf, idf, fitted]), loss)
    features.unpersist()
    held.unpersist()
    best_loss = best[1]
    metrics = spark.createDataFrame(results, "reg_param double, valid_loss double, valid_acc double")
    return best[0], metrics.withColumn("best", F.col("valid_loss") == F.lit(best_loss))


def score_detector(model: PipelineModel, df: DataFrame, id_col: str = "id") -> DataFrame:
    """MLlib form of D9: (id, fake, real, correct) for every row, probabilities in the order [fake, real]."""
    s = _probs(model.transform(df.withColumn("label", F.col("label").cast("double"))))
    return s.select(id_col, "fake", "real", correct_rule("fake", "real", "label").alias("correct"))


def score_with(df: DataFrame, scorer: Callable[[pd.Series], np.ndarray], text_col: str = "text",
               id_col: str = "id", label_col: str = "label") -> DataFrame:
    """D9 with a user-supplied scorer: texts in Arrow batches -> (n, 2) logits [fake, real].

    The scorer is shipped once per task with the closure (put large models behind a broadcast).
    """
    def run(batches):
        for pdf in batches:
            logits = np.asarray(scorer(pdf[text_col]), dtype=float).reshape(len(pdf), 2)
            m = logits.max(axis=1, keepdims=True)
            e = np.exp(logits - m)
            p = e / e.sum(axis=1, keepdims=True)
            yield pd.DataFrame({id_col: pdf[id_col], label_col: pdf[label_col], "fake": p[:, 0], "real": p[:, 1]})

    schema = f"{id_col} string, {label_col} int, fake double, real double"
    out = df.select(F.col(id_col).cast("string"), F.col(label_col).cast("int"), text_col).mapInPandas(run, schema)
    return out.withColumn("correct", correct_rule("fake", "real", label_col))
