"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_partners(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` without a partner in ``right`` (left anti join)."""
    return left.select(key).join(right.select(key), key, "left_anti")


def index_body(index: DataFrame, bodies: DataFrame, key: str = "filename", check: bool = True) -> DataFrame:
    """Join each index row to its body; a missing body fails the query naming the key.

    The check is a filter on a marker of the body side, in the same left join: it costs no extra job,
    holds whichever columns are selected later, and accepts a body whose text is null.
    """
    if not check:
        return index.join(bodies, key, "inner")
    j = index.join(bodies.withColumn("_body", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no body for {key}="), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return j.filter(F.when(F.col("_body").isNull(), missing).otherwise(F.col("_body"))).drop("_body")


def attach_scores(meta: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Scores onto metadata by key; duplicate metadata keys all get the score, unscored rows drop.

    A plain equi-join: AQE picks broadcast or sort-merge from runtime sizes and splits skewed keys.
    """
    return meta.join(scores, key, "inner")


def pair_outputs(prompts: DataFrame, outputs: DataFrame, keys=("prompt_id", "sample_idx")) -> DataFrame:
    """Pair each prompt with its generated outputs on (prompt id, sample index)."""
    return prompts.join(outputs, list(keys), "inner")


def union_origins(real: DataFrame, generated: DataFrame) -> DataFrame:
    """Real rows and generated rows as one labelled table (union all by name); a column that one side lacks is an error."""
    return real.unionByName(generated)
