"""Registered queries: readers and writers as round trips through the shared checkpoint folder.

Each query derives the reference's input format from the given tables, writes it with Spark,
and reads it back with the matching reader, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from quillspark.functions import sequence as S
from quillspark.functions.text import joined, python_repr, tokens
from quillspark.operators import tokens as TK
from quillspark.operators.generate import generate
from quillspark.operators.indexing import with_row_index
from quillspark.operators.ngram import decode_filter
from quillspark.operators.sampling import shuffle_split
from quillspark.operators.training_log import log_epochs, write_share_counts
from quillspark.plans.detector import essay_scores
from quillspark.plans.fixtures import essay_bodies, essay_index, news, real_web_text, reviews
from quillspark.plans.q_lm import GENERATE, GREEDY_LEN, LM_EPOCHS, lm_chunks, lm_held_out, lm_metrics
from quillspark.plans.q_prep import DECODE_SETTINGS, TRAIN_MAX_LEN, labelled
from quillspark.plans.registry import register, rounded
from quillspark.session import scratch_path, table
from quillspark.sources import readers as R
from quillspark.sources import sinks as K

GEN_SHARD_SIZE = 100
MAP_ENTRIES_PER_FILE = 10_000
REVIEW_SCHEMA = "url string, review_text string, singleparent_share2010 double, perwht double, urbanicity string"


def text_digest(c: str = "text"):
    return [F.length(c).cast("long").alias("n_chars"), F.md5(F.col(c)).alias("text_md5")]


@register("S1_reviews_csv")
def q_s1(spark, sf_dir):
    path = scratch_path(spark, "reviews-csv")
    reviews(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return rounded(R.read_reviews_csv(spark, path, REVIEW_SCHEMA))


@register("S2_index_csv")
def q_s2(spark, sf_dir):
    path = scratch_path(spark, "index-csv")
    idx = essay_index(spark, sf_dir).select(*[F.col(dst).alias(src) for src, dst in R.INDEX_COLUMNS.items()])
    idx.write.option("header", True).option("escape", '"').csv(path)
    return R.read_index_csv(spark, path)


def strip_writer_newline(c: str = "text"):
    return F.when(F.col(c).endswith("\n"), F.expr(f"substring({c}, 1, length({c}) - 1)")).otherwise(F.col(c))


@register("S3_whole_text")
def q_s3(spark, sf_dir):
    path = scratch_path(spark, "bodies")
    K.write_members(essay_bodies(spark, sf_dir), path, "filename")
    return R.read_members(spark, path).select(F.col("name").alias("filename"), *text_digest())


@register("S4_jsonl_real")
def q_s4(spark, sf_dir):
    path = scratch_path(spark, "real-jsonl")
    real_web_text(spark, sf_dir).write.json(path)
    return R.read_jsonl(spark, path).select("id", "ended", *text_digest())


def generated_rows(spark, sf_dir):
    """Generated turns with decode-setting name, split and position (fixture rules)."""
    c = table(spark, sf_dir, "conversations")
    m = F.col("conv_id") % len(DECODE_SETTINGS)
    name = F.when(m == 0, "gpt2_p96").when(m == 1, "gpt2_p100").otherwise("gpt2_k40")
    c = with_row_index(c.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    r = F.col("row_idx") % 10
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text",
        name.alias("gen_method"),
        F.when(r == 0, "valid").when(r == 1, "test").otherwise("train").alias("split"), "row_idx",
    )


def written_shards(spark, sf_dir):
    root = scratch_path(spark, "shards")
    K.write_generated_shards(generated_rows(spark, sf_dir), root, shard_size=GEN_SHARD_SIZE)
    return root


@register("K1_jsonl_sink")
def q_k1(spark, sf_dir):
    back = R.read_generated(spark, written_shards(spark, sf_dir))
    return back.select("gen_method", "split", "shard", "id", *text_digest())


@register("S5_jsonl_shards")
def q_s5(spark, sf_dir):
    back = R.read_generated(spark, written_shards(spark, sf_dir), "valid")
    return back.select("gen_method", "split", "shard", "id", *text_digest())


@register("F6_file_prefix")
def q_f6(spark, sf_dir):
    back = R.read_generated(spark, written_shards(spark, sf_dir), "val", prefix=True)
    return back.select("id", "split")


@register("S6_jsonl_news")
def q_s6(spark, sf_dir):
    path = scratch_path(spark, "news-jsonl")
    n = news(spark, sf_dir).withColumn("title", F.lit(None).cast("string"))
    n.write.json(path)
    return R.read_news(spark, path, "valid").select("url", "split", "label", *text_digest("article"))


@register("S7_json_array")
def q_s7(spark, sf_dir):
    path = scratch_path(spark, "json-arrays")
    c = with_row_index(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["turn"], ["conv_id"], out="idx")
    K.write_array_parts(c, path, ["conv_id"], "idx")
    return R.read_array_parts(spark, path, "conv_id long").select("conv_id", "idx", *text_digest())


@register("S8_json_map")
def q_s8(spark, sf_dir):
    path = scratch_path(spark, "json-maps")
    # read by the count and by the writer: the scoring chain runs once
    s = essay_scores(spark, sf_dir).withColumn("correct", F.col("real") > F.col("fake")).persist(StorageLevel.MEMORY_AND_DISK)
    files = max(1, s.count() // MAP_ENTRIES_PER_FILE)
    entry = F.struct(F.col("filename"), F.struct("fake", "real", "correct"))
    maps = s.groupBy(F.pmod(F.hash("filename"), F.lit(files)).alias("bucket")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    maps.write.partitionBy("bucket").text(path)
    s.unpersist()
    return rounded(R.read_json_maps(spark, path))


def lm_docs(spark, sf_dir):
    return shuffle_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 0.9)


@register("K3_text_sink")
def q_k3(spark, sf_dir):
    path = scratch_path(spark, "lm-text")
    K.write_escaped_lines(lm_docs(spark, sf_dir), path, "text", ["split"])
    return R.read_text_corpus(spark, path).select("split", F.col("value").alias("line"))


@register("S9_text_corpus")
def q_s9(spark, sf_dir):
    path = scratch_path(spark, "lm-text")
    K.write_escaped_lines(lm_docs(spark, sf_dir), path, "text", ["split"])
    lines = R.read_text_corpus(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n_lines"))
    whole = R.read_text_corpus(spark, path, whole=True).groupBy("split").agg(
        F.sum(F.length("value")).cast("long").alias("n_chars"))
    return lines.join(whole, "split")


@register("S10_format_dispatch")
def q_s10(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = scratch_path(spark, "dispatch")
    out = []
    for ext in ("parquet", "json", "csv", "txt"):
        path = f"{base}/docs.{ext}"
        K.save(d.select(python_repr("text").alias("value")) if ext == "txt" else d, path)
        t = F.col("value" if ext == "txt" else "text")
        out.append(R.load(spark, path, d.schema).agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(t)).cast("long").alias("n_chars"),
            F.sum(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")).alias("text_sum"),
        ).select(F.lit(R.format_of(path)).alias("format"), "n_rows", "n_chars", "text_sum"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


@register("K2_result_sink")
def q_k2(spark, sf_dir):
    path = scratch_path(spark, "results")
    s = essay_scores(spark, sf_dir).withColumn("correct", F.col("real") > F.col("fake"))
    K.write_results(s.withColumnRenamed("filename", "id"), path)
    back = spark.read.schema("id string, fake double, real double, correct boolean").json(path)
    return rounded(back)


@register("K4_prepared_sink")
def q_k4(spark, sf_dir):
    path = scratch_path(spark, "prepared")
    # tokenized once and reused by the vocabulary, the lookup and the final projection
    rows = labelled(spark, sf_dir).withColumn("tokens", tokens("text")).persist(StorageLevel.MEMORY_AND_DISK)
    vocab = TK.build_vocab(rows, min_count=2)
    rows = rows.filter(F.size("tokens") >= TRAIN_MAX_LEN).withColumn("tokens", S.truncate("tokens", TRAIN_MAX_LEN))
    ids = TK.lookup_ids(rows, vocab, "id")
    prepared = rows.join(ids, "id").select(
        "id", "label", "label_text",
        S.special_pad("ids", TRAIN_MAX_LEN, TK.CLS_ID, TK.SEP_ID).alias("token_ids"),
        F.array_join("tokens", " ").alias("text"),
        F.when(F.col("label") == 1, "human").otherwise("gpt2_p100").alias("gen_method"),
        F.when(F.substring(F.md5(F.concat(F.lit("42:"), F.col("id"))), 1, 1) < "d", "train")
        .otherwise("test").alias("split"))
    K.write_prepared(prepared, path)
    return spark.read.parquet(path).select("id", "label", "label_text", joined("token_ids").alias("token_ids"), "text", "gen_method", "split")


@register("K5_metric_log")
def q_k5(spark, sf_dir):
    """The language model's log: after each share of the training texts, losses of the held-out texts and a greedy sample."""
    counts, held = scratch_path(spark, "share-counts"), scratch_path(spark, "held-out-pairs")
    train = lm_chunks(spark, sf_dir).filter(F.col("split") == "train")
    write_share_counts(train.withColumn("share", F.pmod("doc_id", F.lit(LM_EPOCHS)).cast("int")), counts)
    pairs, pieces = lm_held_out(spark, sf_dir)
    pairs.write.parquet(held)
    pairs = spark.read.schema(pairs.schema).parquet(held)
    prompt = spark.range(1).select("id", F.array().cast("array<string>").alias("prompt_tokens"))

    def evaluate(model):
        sample = generate(prompt, decode_filter(model, GENERATE), sample_len=GREEDY_LEN, do_sample=False)
        metrics = lm_metrics(model, pairs, pieces).select(
            F.col("loss").alias("val_loss"), F.col("ppl").alias("val_ppl"), F.col("adjusted_ppl").alias("val_adjusted_ppl"))
        # metric columns and a sample become one row, also when either is absent
        both = metrics.unionByName(sample.select(F.col("text").alias("sample")), allowMissingColumns=True)
        return both.agg(*[F.max(c).alias(c) for c in ("val_loss", "val_ppl", "val_adjusted_ppl", "sample")])

    path = scratch_path(spark, "metrics")
    log_epochs(spark, counts, LM_EPOCHS, evaluate, path)
    return rounded(spark.read.parquet(path))
