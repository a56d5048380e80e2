"""Registered queries: token and sequence preparation."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from quillspark.functions import sequence as S
from quillspark.functions.text import joined, nonblank, tokens
from quillspark.operators import tokens as TK
from quillspark.operators.indexing import with_row_index
from quillspark.operators.sampling import mini_batch, shuffle_split
from quillspark.operators.scoring import pad_to_batch_max
from quillspark.plans.fixtures import news
from quillspark.plans.registry import register
from quillspark.session import table

# Fixed parameters of the registered queries.
MAX_LEN = 128
LM_SEQ_LEN = 256
MIN_COUNT = 2
MODEL_MAX = 512
LM_BATCH = 4
# A line of up to TOKEN_CAP tokens has several chunks, so the batch cap can be overshot
TOKEN_CAP = 64
CAP_SEQ_LEN = 4
BATCH_CAP = 3


def doc_tokens(spark, sf_dir, shared: bool = False):
    """(doc_id, tokens). ``shared`` keeps the tokenized corpus (spillable) when a query reads it more
    than once: re-running the tokenizer over whole texts costs more than reading the cache."""
    dt = table(spark, sf_dir, "documents", balance=True).select("doc_id", tokens("text").alias("tokens"))
    return dt.persist(StorageLevel.MEMORY_AND_DISK) if shared else dt


def doc_ids(spark, sf_dir, head: int | None = None):
    """T1 -> T2 -> J3: token ids of every document against the corpus vocabulary.

    The vocabulary always counts whole texts; with ``head`` only the first ``head`` tokens of each
    document are looked up (what padding / model windows keep), which bounds the exploded rows.
    """
    dt = doc_tokens(spark, sf_dir, shared=True)
    vocab = TK.build_vocab(dt, min_count=MIN_COUNT)
    if head is not None:
        dt = dt.withColumn("tokens", F.slice("tokens", 1, head))
    return TK.lookup_ids(dt, vocab, "doc_id")


@register("T1_tokenize")
def q_t1(spark, sf_dir):
    return doc_tokens(spark, sf_dir).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@register("T2_vocab")
def q_t2(spark, sf_dir):
    return TK.build_vocab(doc_tokens(spark, sf_dir), min_count=MIN_COUNT)


@register("T3_token_len")
def q_t3(spark, sf_dir):
    return doc_tokens(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("text_len"))


@register("T4_truncate")
def q_t4(spark, sf_dir):
    return doc_tokens(spark, sf_dir).select("doc_id", S.truncated_text("tokens", MAX_LEN).alias("text_trunc"))


@register("J3_vocab_lookup")
def q_j3(spark, sf_dir):
    return doc_ids(spark, sf_dir).select("doc_id", joined("ids").alias("ids"))


@register("T5_special_pad")
def q_t5(spark, sf_dir):
    ids = doc_ids(spark, sf_dir, head=MAX_LEN)
    return ids.select("doc_id", joined(S.special_pad("ids", MAX_LEN, TK.CLS_ID, TK.SEP_ID, TK.PAD_ID)).alias("token_ids_padded"))


@register("T6_mask_ones")
def q_t6(spark, sf_dir):
    # every padded row has the same length, so no token needs to be read
    return table(spark, sf_dir, "documents").select("doc_id", joined(F.array_repeat(F.lit(1), MAX_LEN + 2)).alias("mask"))


@register("T7_mask_prefix")
def q_t7(spark, sf_dir):
    n = news(spark, sf_dir).select("url", F.size(tokens("article")).alias("text_len"))
    return n.select("url", joined(S.mask_prefix("text_len", MAX_LEN)).alias("mask"))


@register("T8_chunk")
def q_t8(spark, sf_dir):
    c = doc_tokens(spark, sf_dir).select("doc_id", F.posexplode(S.chunks("tokens", LM_SEQ_LEN)).alias("chunk_idx", "chunk"))
    return c.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"),
                    F.size("chunk").cast("long").alias("n"), F.array_join("chunk", " ").alias("text"))


def doc_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents", balance=True).select("doc_id", F.posexplode(TK.lines("text")).alias("line_idx", "line"))
    return d.withColumn("line_idx", F.col("line_idx").cast("long"))


@register("F3_nonblank")
def q_f3(spark, sf_dir):
    return doc_lines(spark, sf_dir).filter(nonblank("line"))


@register("T9_chunk_fast")
def q_t9(spark, sf_dir):
    ls = doc_lines(spark, sf_dir).filter(nonblank("line"))
    h = S.head_chunk(tokens("line"), LM_SEQ_LEN)
    return ls.select("doc_id", "line_idx", F.size(h).cast("long").alias("n"), F.array_join(h, " ").alias("text"))


@register("T10_caps")
def q_t10(spark, sf_dir):
    ls = doc_lines(spark, sf_dir).filter(nonblank("line"))
    ls = ls.select("doc_id", "line_idx", F.slice(tokens("line"), 1, TOKEN_CAP).alias("capped"))
    ls = ls.select("doc_id", "line_idx", S.chunks("capped", CAP_SEQ_LEN).alias("chunks"))
    kept = TK.capped_texts(ls, "doc_id", "line_idx", "chunks", BATCH_CAP)
    return kept.select("doc_id", "line_idx", F.size("chunks").cast("long").alias("n_chunks"))


def lm_split(spark, sf_dir):
    return shuffle_split(table(spark, sf_dir, "documents", balance=True).select("doc_id", "text"), "doc_id", 0.9)


@register("T11_corpus_counts")
def q_t11(spark, sf_dir):
    return TK.all_mode_counts(lm_split(spark, sf_dir), "text", LM_SEQ_LEN, ["split"])


@register("T12_pad_batch")
def q_t12(spark, sf_dir):
    # tokens are written in packed form: a cache of them is many times the input, and its blocks that do not fit are mapped into memory whole
    packed = TK.packed_tokens(doc_tokens(spark, sf_dir), "doc_id")
    ids, sizes = TK.lookup_sized(packed, TK.build_vocab(packed, min_count=MIN_COUNT), "doc_id")
    # a chunk's position is its document's first position (a running sum over ids and counts alone) and its number: no sort of arrays
    sizes = sizes.select("doc_id", S.chunk_count("n", LM_SEQ_LEN).cast("long").alias("n"))
    first = with_row_index(sizes, ["doc_id"], cum_of="n", cum_out="first").select("doc_id", "first")
    ids = ids.join(first, "doc_id").select("first", F.posexplode(S.chunks("ids", LM_SEQ_LEN)).alias("chunk_idx", "ids"))
    ch = mini_batch(ids.select((F.col("first") + F.col("chunk_idx")).alias("row_idx"), "ids"), LM_BATCH)
    padded = pad_to_batch_max(ch, "ids", "batch_id", TK.PAD_ID)
    return padded.select("row_idx", "batch_id", joined("ids").alias("ids"))


@register("T13_model_window")
def q_t13(spark, sf_dir):
    counts = doc_tokens(spark, sf_dir, shared=True).select("doc_id", F.size("tokens").cast("long").alias("all_tokens"))
    ids = doc_ids(spark, sf_dir, head=MODEL_MAX - 2).join(counts, "doc_id")
    return ids.select(
        "doc_id", "all_tokens",
        F.least(F.col("all_tokens"), F.lit(MODEL_MAX - 2)).alias("used_tokens"),
        joined(S.model_window("ids", MODEL_MAX, TK.CLS_ID, TK.SEP_ID)).alias("ids"),
    )
