"""Registered queries: sampling (L*), projections (P*), filters (F*), joins (J*) and U1."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from quillspark.functions import sequence as S
from quillspark.functions.labels import bool_to_int, decode_label, gen_method, origin_label, split_alias
from quillspark.functions.text import first_word, joined, tokens
from quillspark.operators import cohorts as A
from quillspark.operators import sampling as L
from quillspark.operators import tokens as TK
from quillspark.operators.indexing import with_row_index
from quillspark.operators.joins import attach_scores, index_body, missing_partners, pair_outputs, union_origins
from quillspark.operators.scoring import threshold
from quillspark.plans.datasets import dataset
from quillspark.plans.detector import ESSAY_THRESHOLD, essay_cohort_rows, essay_dataset, essay_scores, review_rows
from quillspark.plans.fixtures import essay_bodies, essay_index, generated_web_text, news, order_key, real_web_text
from quillspark.plans.registry import register, rounded
from quillspark.session import table

# Fixed parameters of the registered queries.
TRAIN_MAX_LEN = 192
POSITION_BOUNDS = (300, 400, 500)
SAMPLE_N = 500
SHARD_SIZE = 100
PROMPT_BATCH = 10
EPOCHS = 3
REPLICAS = 7
# decode settings (top_p, top_k) assigned to conversations by conv_id % 3
DECODE_SETTINGS = ((0.96, 0), (1.0, 0), (1.0, 40))


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def with_seed(df, seed: int):
    """M7: the seed of a random choice stays with its rows."""
    return df.withColumn("seed", F.lit(seed).cast("long"))


def lm_split(spark, sf_dir):
    return L.shuffle_split(docs(spark, sf_dir).select("doc_id"), "doc_id", 0.9)


def prompts(spark, sf_dir):
    """P1 + P7: first word of each non-blank document, positioned by doc_id."""
    p = docs(spark, sf_dir).select("doc_id", first_word("text").alias("prefix")).filter(F.col("prefix") != "")
    return with_row_index(p, ["doc_id"])


@register("L1_shuffle_split")
def q_l1(spark, sf_dir):
    return with_seed(lm_split(spark, sf_dir), 42)


@register("L2_sample_n")
def q_l2(spark, sf_dir):
    train = lm_split(spark, sf_dir).filter(F.col("split") == "train")
    return with_seed(L.sample_n(train, "doc_id", SAMPLE_N, seed="43"), 43)


@register("L3_position_split")
def q_l3(spark, sf_dir):
    human = docs(spark, sf_dir).select(
        F.lit("human").alias("origin"), F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"))
    gen = table(spark, sf_dir, "conversations").select(
        F.lit("generated").alias("origin"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").alias("k1"), F.col("turn").alias("k2"))
    split = L.position_split(human.unionByName(gen), ["k1", "k2"], POSITION_BOUNDS, group_cols=["origin"])
    return split.select("origin", "id", "row_idx", "split")


@register("L4_range_shard")
def q_l4(spark, sf_dir):
    return L.range_shard(prompts(spark, sf_dir), shard_size=SHARD_SIZE).select("doc_id", "row_idx", "shard")


@register("L5_mini_batch")
def q_l5(spark, sf_dir):
    return L.mini_batch(prompts(spark, sf_dir), PROMPT_BATCH).select("doc_id", "batch_id", "batch_pos")


@register("L6_epoch_order")
def q_l6(spark, sf_dir):
    s = lm_split(spark, sf_dir)
    train = L.epoch_order(s.filter(F.col("split") == "train"), "doc_id", EPOCHS, shuffle=True)
    valid = L.epoch_order(s.filter(F.col("split") == "valid"), "doc_id", EPOCHS, shuffle=False)
    return with_seed(train.unionByName(valid).select("split", "epoch", "doc_id", "pos"), 42)


@register("L7_replica_shard")
def q_l7(spark, sf_dir):
    train = lm_split(spark, sf_dir).filter(F.col("split") == "train")
    return with_seed(L.replica_shard(train, "doc_id", REPLICAS, shuffle=True).select("doc_id", "replica", "slot"), 42)


@register("L8_sorted_groups")
def q_l8(spark, sf_dir):
    return rounded(L.sorted_groups(A.mean_by(review_rows(spark, sf_dir), "urbanicity"), "urbanicity"))


@register("P1_prefix")
def q_p1(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", first_word("text").alias("prefix")).filter(F.col("prefix") != "")


def labelled(spark, sf_dir):
    real = real_web_text(spark, sf_dir).select("id", "text", *origin_label(True))
    gen = generated_web_text(spark, sf_dir).select("id", "text", *origin_label(False))
    return union_origins(real, gen)


@register("P2_label_source")
def q_p2(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "label", "label_text")


@register("P3_label_decode")
def q_p3(spark, sf_dir):
    return news(spark, sf_dir).select("url", decode_label("label").alias("label_id"))


@register("P4_split_alias")
def q_p4(spark, sf_dir):
    counts = news(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    req = spark.createDataFrame([("train",), ("valid",), ("test",)], "requested string")
    req = req.withColumn("stored", split_alias("requested"))
    return req.join(F.broadcast(counts.withColumnRenamed("split", "stored")), "stored", "left").select(
        "requested", "stored", F.coalesce("n", F.lit(0)).alias("n"))


@register("P5_gen_method")
def q_p5(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id")
    m = F.col("conv_id") % len(DECODE_SETTINGS)
    p = F.when(m == 0, DECODE_SETTINGS[0][0]).when(m == 1, DECODE_SETTINGS[1][0]).otherwise(DECODE_SETTINGS[2][0])
    k = F.when(m == 0, DECODE_SETTINGS[0][1]).when(m == 1, DECODE_SETTINGS[1][1]).otherwise(DECODE_SETTINGS[2][1])
    named = c.select(gen_method(F.lit("gpt2"), p, k).alias("gen_method"))
    return named.groupBy("gen_method").agg(F.count(F.lit(1)).alias("n"))


@register("P6_bool_to_int")
def q_p6(spark, sf_dir):
    d = threshold(essay_scores(spark, sf_dir), ESSAY_THRESHOLD)
    return d.select("filename", bool_to_int("correct").alias("correct"))


@register("P7_row_index")
def q_p7(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id").withColumn("_k", order_key("doc_id"))
    return with_row_index(d, ["_k", "doc_id"]).drop("_k")


@register("P8_output_projection")
def q_p8(spark, sf_dir):
    # tokenized once and reused by the vocabulary, the lookup and the final projection
    rows = labelled(spark, sf_dir).withColumn("tokens", tokens("text")).persist(StorageLevel.MEMORY_AND_DISK)
    vocab = TK.build_vocab(rows, min_count=2)
    rows = rows.filter(F.size("tokens") >= TRAIN_MAX_LEN).withColumn("tokens", S.truncate("tokens", TRAIN_MAX_LEN))
    ids = TK.lookup_ids(rows, vocab, "id")
    prepared = rows.join(ids, "id").withColumn(
        "token_ids", S.special_pad("ids", TRAIN_MAX_LEN, TK.CLS_ID, TK.SEP_ID))
    return prepared.select(
        "id", joined("token_ids").alias("token_ids"), joined(S.mask_ones("token_ids")).alias("mask"),
        "label", F.array_join("tokens", " ").alias("text"))


def shown(df):
    """Arrays as text, for comparison."""
    return df.select("id", joined("token_ids").alias("token_ids"), joined("mask").alias("mask"), "label", "text")


@register("P8_real_news")
def q_p8_news(spark, sf_dir):
    return shown(dataset(spark, sf_dir, "real_news", "valid"))


@register("P8_school_reviews")
def q_p8_reviews(spark, sf_dir):
    return shown(dataset(spark, sf_dir, "school_reviews", "train"))


@register("P8_essays")
def q_p8_essays(spark, sf_dir):
    return shown(dataset(spark, sf_dir, "essays", "test"))


@register("T14_skip_tokens")
def q_t14(spark, sf_dir):
    rows = essay_dataset(spark, sf_dir, skip_tokens=True)
    return rows.select("id", F.size("token_ids").alias("n_ids"), F.size("mask").alias("n_mask"), "label", "text")


@register("F1_min_tokens")
def q_f1(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", "label", F.size(tokens("text")).cast("long").alias("text_len"))
    return rows.filter(F.col("text_len") >= TRAIN_MAX_LEN)


@register("F2_split_filter")
def q_f2(spark, sf_dir):
    return news(spark, sf_dir).filter(F.col("split") == "train").select("url", "split")


@register("F4_scored_only")
def q_f4(spark, sf_dir):
    return essay_cohort_rows(spark, sf_dir).select("filename", "score_level", "correct")


@register("F5_level_pair")
def q_f5(spark, sf_dir):
    r = essay_cohort_rows(spark, sf_dir).filter(F.col("score_level").isin("high", "medium"))
    return r.select("filename", "score_level", "correct")


@register("J1_index_body")
def q_j1(spark, sf_dir):
    j = index_body(essay_index(spark, sf_dir), essay_bodies(spark, sf_dir), "filename")
    return j.select("filename", "prompt", "language", "score_level", F.size(tokens("text")).cast("long").alias("text_len"))


@register("J2_score_meta")
def q_j2(spark, sf_dir):
    d = threshold(essay_scores(spark, sf_dir), ESSAY_THRESHOLD).select("filename", "real", "correct")
    return rounded(attach_scores(essay_index(spark, sf_dir), d, "filename"))


@register("J4_prompt_output")
def q_j4(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    p = c.filter(F.col("role") == "user").select(
        F.col("conv_id").alias("prompt_id"), F.col("turn").alias("sample_idx"),
        F.size(tokens("text")).cast("long").alias("prompt_tokens"))
    o = c.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("prompt_id"), (F.col("turn") - 1).alias("sample_idx"),
        F.size(tokens("text")).cast("long").alias("output_tokens"))
    return pair_outputs(p, o)


@register("J5_missing_body")
def q_j5(spark, sf_dir):
    return missing_partners(docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


@register("U1_union_origin")
def q_u1(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "label", "label_text", F.size(tokens("text")).cast("long").alias("text_len"))
