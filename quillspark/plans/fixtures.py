"""Stand-in inputs derived from the given tables, one function per reference input.

Each function reads only the given parquet tables, so its work grows with them. The derivations
are the fixed rules of the fixture mapping (same text in Spark and in the SQL oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import tokens, type_token_ratio
from quillspark.operators.indexing import with_row_index
from quillspark.session import table

# Fixed values of the fixture mapping.
ORDER_SEED = "42"
MISSING_COVARIATE_MODULUS = 17
URBANICITY_MODULUS = 4
NEWS_SPLIT_MODULUS = 10


def score_level() -> F.Column:
    """Essay score level from the label flags."""
    return (
        F.when(F.col("toxic") == 1, F.lit("low"))
        .when(F.col("quality") == 1, F.lit("high"))
        .otherwise(F.lit("medium"))
    )


def order_key(id_col: str, seed: str = ORDER_SEED) -> F.Column:
    """Hash order key ``md5('<seed>:' || id)``; ties are broken by the id itself."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def essay_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, prompt, language, score_level): documents joined to their labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("filename"),
        F.col("source").alias("prompt"),
        F.col("lang").alias("language"),
        score_level().alias("score_level"),
    )


def essay_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, text): one body per document."""
    return table(spark, sf_dir, "documents", balance=True).select(
        F.col("doc_id").cast("string").alias("filename"), "text"
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, review_text, singleparent_share2010, perwht, urbanicity)."""
    d = table(spark, sf_dir, "documents", balance=True).select("doc_id", "text", "n_chars", tokens("text").alias("_t"))
    return d.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("review_text"),
        F.when(F.col("doc_id") % MISSING_COVARIATE_MODULUS == 0, F.lit(None).cast("double"))
        .otherwise(F.col("n_chars").cast("double"))
        .alias("singleparent_share2010"),
        type_token_ratio("_t").alias("perwht"),
        (F.col("doc_id") % URBANICITY_MODULUS).cast("string").alias("urbanicity"),
    )


def real_web_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ended, text) of the real side."""
    return table(spark, sf_dir, "documents", balance=True).select(
        F.col("doc_id").cast("string").alias("id"), F.lit(True).alias("ended"), "text"
    )


def generated_web_text(spark: SparkSession, sf_dir: str, roles=("assistant",)) -> DataFrame:
    """(id, text) of the generated side: conversation turns, id = conv_id '-' turn."""
    c = table(spark, sf_dir, "conversations", balance=True)
    if roles:
        c = c.filter(F.col("role").isin(*roles))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News rows: article = text, domain = source, split by position, label from quality.

    Positions are taken on the ids alone; text is joined to them and pruned where it is not used.
    """
    docs = table(spark, sf_dir, "documents", balance=True).select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    indexed = with_row_index(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    m = F.col("row_idx") % NEWS_SPLIT_MODULUS
    return docs.join(indexed, "doc_id").join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("url"),
        F.col("source").alias("domain"),
        F.when(m == 0, F.lit("val")).when(m == 1, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.col("text").alias("article"),
        F.when(F.col("quality") == 1, F.lit("human")).otherwise(F.lit("machine")).alias("label"),
    )
