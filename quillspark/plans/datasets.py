"""The four detector datasets by name, each as (id, token_ids, mask, label, text) rows of one split."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import sequence as S
from quillspark.functions.labels import decode_label, split_alias
from quillspark.functions.text import tokens
from quillspark.operators import tokens as TK
from quillspark.operators.sampling import position_split
from quillspark.plans.detector import essay_dataset
from quillspark.plans.fixtures import generated_web_text, news, real_web_text
from quillspark.session import table

# Tokens of a prepared sequence, and the position bounds of the review splits (per origin).
MAX_LEN = 192
REVIEW_BOUNDS = (5000, 6000, 7000)


def document_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TK.build_vocab(table(spark, sf_dir, "documents", balance=True).select(tokens("text").alias("tokens")), min_count=2)


def _prepared(rows: DataFrame, vocab: DataFrame, whole: bool, max_len: int = MAX_LEN) -> DataFrame:
    """(id, text, label) to model rows. ``whole``: only rows of at least max_len tokens, mask of ones; else all rows, and the
    mask has one for each token that the text has."""
    rows = rows.withColumn("_t", tokens("text")).withColumn("_n", F.size("_t"))
    rows = (rows.filter(F.col("_n") >= max_len) if whole else rows).withColumn("_t", S.truncate("_t", max_len))
    rows = rows.select("id", "label", "_n", "_t").persist(StorageLevel.MEMORY_AND_DISK)  # read by the lookup and the projection
    out = rows.join(TK.lookup_ids(rows, vocab, "id", "_t"), "id").withColumn("token_ids", S.special_pad("ids", max_len, TK.CLS_ID, TK.SEP_ID))
    mask = S.mask_ones("token_ids") if whole else S.mask_prefix("_n", max_len)
    return out.select("id", "token_ids", mask.alias("mask"), "label", F.array_join("_t", " ").alias("text"))


def web_text(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """Real and generated web text; split by the hash of the id."""
    both = real_web_text(spark, sf_dir).select("id", "text", F.lit(1).alias("label")).unionByName(
        generated_web_text(spark, sf_dir).select("id", "text", F.lit(0).alias("label")))
    h = F.substring(F.md5(F.concat(F.lit("42:"), F.col("id"))), 1, 1)
    own = F.when(h < "d", "train").when(h < "e", "val").otherwise("test")
    return _prepared(both.filter(own == _stored(spark, split)), document_vocabulary(spark, sf_dir), True)


def real_news(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """News articles of a stored split, of any length; label 1: human."""
    rows = news(spark, sf_dir).filter(F.col("split") == _stored(spark, split))
    return _prepared(rows.select(F.col("url").alias("id"), F.col("article").alias("text"), decode_label("label").alias("label")), document_vocabulary(spark, sf_dir), False)


def school_reviews(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """Human and generated reviews, split by position within their origin; rows past the last bound belong to no split."""
    docs = table(spark, sf_dir, "documents", balance=True).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("id"), "text", F.lit(1).alias("label"), F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"))
    turns = table(spark, sf_dir, "conversations", balance=True).filter(F.col("role") == "assistant").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", F.lit(0).alias("label"), F.col("conv_id").cast("long").alias("k1"), F.col("turn").cast("long").alias("k2"))
    # positions are taken on the keys alone
    keys = docs.drop("text").unionByName(turns.drop("text"))
    named = position_split(keys, ["k1", "k2"], REVIEW_BOUNDS, ("train", "val", "test"), ["label"]).filter(F.col("split") == _stored(spark, split))
    rows = docs.select("id", "text", "label").unionByName(turns.select("id", "text", "label")).join(named.select("id", "label"), ["id", "label"])
    return _prepared(rows, document_vocabulary(spark, sf_dir), False)


def essays(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """Scored human essays (one split: all rows)."""
    _stored(spark, split)
    return essay_dataset(spark, sf_dir)


DATASETS = {"web_text": web_text, "real_news": real_news, "school_reviews": school_reviews, "essays": essays}


def _stored(spark: SparkSession, split: str) -> str:
    """Stored name of a requested split; an unknown one is an error."""
    if split not in ("train", "valid", "val", "test"):
        raise ValueError(f"unknown split {split!r}")
    return spark.range(1).select(split_alias(F.lit(split))).first()[0]


def dataset(spark: SparkSession, sf_dir: str, name: str, split: str = "train") -> DataFrame:
    """A dataset's rows of one split; an unknown name is an error."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, sf_dir, split)
