"""Count-based language model held as tables (M1-M3) and per-chunk losses (M2).

p(tok | ctx) = (n(ctx, tok) + k * q(tok)) / (n(ctx) + k), with the add-one unigram prior
q(tok) = (u(tok) + 1) / (N + V + 1) over the training targets (one extra slot for unseen tokens).
The first token of a chunk has the begin marker as context.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.indexing import with_row_index

# Begin-of-chunk context marker (the tokenizer can never produce it).
BOS = "<s>"
# Model tables up to this many rows are broadcast into joins; larger ones are shuffle-joined.
MODEL_BROADCAST_ROWS = 2_000_000
# A context with at most this many followers is ranked by a window inside one task; beyond it
# (a hot context) the range-partitioned plan spreads the context over several tasks.
CONTEXT_WINDOW_ROWS = 1_000_000


# Parts that a hot context or token is dealt over when pairs look it up by a shuffle.
CONTEXT_SALT = 16
# Whole-number mass of the likeliest candidate of a context, and parts of a nucleus bound.
UNIT, PARTS = 1 << 40, 1_000_000


# Tokens that are counted together inside a task before the shuffle.
COUNT_TOKENS = 1 << 20


def whole_mass(x) -> F.Column:
    """A share in (0, 1] as a whole number of at least one: sums do not depend on their order."""
    return F.greatest(F.floor(x * float(UNIT)), F.lit(1)).cast("long")


def pairs(chunks_df: DataFrame, chunk_col: str = "chunk", keep=(), end: str | None = None) -> DataFrame:
    """(keep..., ctx, tok) for every token of every chunk; ctx of the first token is BOS. ``end`` is a marker put after the last one."""
    chunks_df = chunks_df if end is None else chunks_df.withColumn(chunk_col, F.array_append(chunk_col, end))
    c = F.col(chunk_col)
    ctxs = F.transform(c, lambda t, i: F.when(i == 0, F.lit(BOS)).otherwise(F.element_at(c, i)))
    z = F.arrays_zip(ctxs.alias("ctx"), c.alias("tok"))
    return chunks_df.select(*keep, F.explode(z).alias("_p")).select(*keep, "_p.ctx", "_p.tok")


@dataclass
class BigramModel:
    bigrams: DataFrame   # (ctx, tok, n, ctx_n)
    counts: DataFrame    # (ctx, tok, n), partitioned by (ctx, tok) and kept
    contexts: DataFrame  # (ctx, ctx_n)
    unigrams: DataFrame  # (tok, u)
    total: int           # N: training targets
    vocab: int           # V: distinct training targets
    bigram_rows: int
    context_rows: int
    max_followers: int
    k: float = 1.0
    held: tuple = ()     # persisted count tables

    def release(self) -> None:
        for t in self.held:
            t.unpersist()


def pair_counts(chunks_df: DataFrame, keys=(), chunk_col: str = "chunk", end: str | None = None, out: str = "n") -> DataFrame:
    """(keys..., ctx, tok, ``out``: occurrences). Counts of disjoint sets of chunks add up to the counts of all of them."""
    chunks_df = chunks_df if end is None else chunks_df.withColumn(chunk_col, F.array_append(chunk_col, end))
    rows = chunks_df.select(*keys, F.col(chunk_col).cast("array<string>").alias("_chunk"))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("ctx", T.StringType()), T.StructField("tok", T.StringType()), T.StructField("_n", T.LongType())])
    return rows.mapInArrow(_count_pairs(len(keys)), schema).groupBy(*keys, "ctx", "tok").agg(F.sum("_n").alias(out))


def slices(lists: pa.ListArray, tokens: int):
    """(from, to) of consecutive rows with at most ``tokens`` list items, or of one row."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    i = 0
    while i < len(lists):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + tokens, side="right")) - 1)
        yield i, j
        i = j


def _count_pairs(n_keys: int):
    """Pairs of the rows (keys..., chunk), counted within each slice; a row is its own group, without keys all are one."""

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(n_keys), COUNT_TOKENS):
                part = b.slice(i, j - i)
                lists = part.column(n_keys)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = lists.flatten().cast(pa.string()).dictionary_encode(null_encoding="encode")
                if not len(coded):
                    continue
                words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([BOS], pa.string())])
                tok = coded.indices.to_numpy().astype(np.int64)
                ctx = np.concatenate([[0], tok[:-1]])
                ctx[(np.cumsum(sizes) - sizes)[sizes > 0]] = len(words) - 1
                pair = ctx * len(words) + tok
                if n_keys:
                    # ids of pairs within the slice, so that (row, pair) fits a number
                    kinds, pair = np.unique(pair, return_inverse=True)
                    both, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(kinds) + pair, return_counts=True)
                    row, pair = both // len(kinds), kinds[both % len(kinds)]
                else:
                    pair, n = np.unique(pair, return_counts=True)
                own = [c.take(pa.array(row)) for c in part.columns[:n_keys]] if n_keys else []
                yield pa.RecordBatch.from_arrays(
                    [*own, words.take(pa.array(pair // len(words))), words.take(pa.array(pair % len(words))), pa.array(n.astype(np.int64))],
                    [*b.schema.names[:n_keys], "ctx", "tok", "_n"])
        pa.default_memory_pool().release_unused()

    return run


def fit(chunks_df: DataFrame, chunk_col: str = "chunk", k: float = 1.0, end: str | None = None) -> BigramModel:
    """M1: bigram and unigram counts (map-side combined aggregations). ``end``: an end-of-text marker that the model learns
    after every chunk, for generation that stops there."""
    return model_of(pair_counts(chunks_df, chunk_col=chunk_col, end=end), k)


def model_of(counts: DataFrame, k: float = 1.0) -> BigramModel:
    """The model of a table (ctx, tok, n), one row for each pair."""
    # the count tables are reused by the size checks and every join: keep them (spillable)
    big = counts.select("ctx", "tok", "n").persist(StorageLevel.MEMORY_AND_DISK)
    ctx_f = big.groupBy("ctx").agg(F.sum("n").alias("ctx_n"), F.count(F.lit(1)).alias("_f"))
    ctx_f = ctx_f.persist(StorageLevel.MEMORY_AND_DISK)
    ctx = ctx_f.select("ctx", "ctx_n")
    uni = big.groupBy("tok").agg(F.sum("n").alias("u")).persist(StorageLevel.MEMORY_AND_DISK)
    stats = uni.agg(F.sum("u").alias("N"), F.count(F.lit(1)).alias("V")).first()
    cstats = ctx_f.agg(F.count(F.lit(1)).alias("C"), F.sum("_f").alias("B"), F.max("_f").alias("F")).first()
    bigrams = big.join(ctx, "ctx")
    return BigramModel(bigrams, big, ctx, uni, int(stats["N"] or 0), int(stats["V"] or 0),
                       int(cstats["B"] or 0), int(cstats["C"] or 0), int(cstats["F"] or 0), k, (uni, ctx_f, big))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a model table only when its (already counted) size is under the bound."""
    return F.broadcast(df) if rows <= MODEL_BROADCAST_ROWS else df


def token_probs(model: BigramModel, ctx_tok: DataFrame) -> DataFrame:
    """Attach p(tok | ctx) to rows holding (ctx, tok); unseen pairs / contexts / tokens are smoothed.

    The main join on (ctx, tok) meets the pair counts as they were counted, so the model's largest table is not moved. Context and
    token are looked up against broadcast tables while these are small (counted), else by two joins that salt the context or the token.
    """
    own = [c for c in ctx_tok.columns if c not in ("ctx", "tok")]
    j = ctx_tok.join(_sized(model.counts, model.bigram_rows), ["ctx", "tok"], "left")
    for t, c, other, rows in ((model.contexts, "ctx", "tok", model.context_rows), (model.unigrams, "tok", "ctx", model.vocab)):
        if rows <= MODEL_BROADCAST_ROWS:
            j = j.join(F.broadcast(t), c, "left")
        else:
            salt = F.pmod(F.xxhash64(other), F.lit(CONTEXT_SALT)).cast("int").alias("_salt")
            j = j.select("*", salt).join(t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(CONTEXT_SALT - 1)))), [c, "_salt"], "left").drop("_salt")
    j = j.select("ctx", "tok", *own, "n", "ctx_n", "u")
    return j.withColumn("p", _prob(model)).drop("n", "ctx_n", "u")


def _prob(model: BigramModel) -> F.Column:
    q = (F.coalesce(F.col("u"), F.lit(0)) + 1) / F.lit(float(model.total + model.vocab + 1))
    return (F.coalesce(F.col("n"), F.lit(0)) + F.lit(model.k) * q) / (F.coalesce(F.col("ctx_n"), F.lit(0)) + F.lit(model.k))


def chunk_losses(model: BigramModel, chunks_df: DataFrame, keys=("doc_id", "chunk_idx"), chunk_col: str = "chunk") -> DataFrame:
    """M2: per chunk, token count and mean -ln p. Pairs are pre-aggregated per chunk before the joins."""
    return pair_losses(model, pair_counts(chunks_df, keys, chunk_col, out="m"), keys)


def pair_losses(model: BigramModel, counted: DataFrame, keys=("doc_id", "chunk_idx")) -> DataFrame:
    """M2 of pairs that are counted already: ``counted`` is (keys..., ctx, tok, m)."""
    scored = token_probs(model, counted)
    return scored.groupBy(*keys).agg(
        F.sum("m").cast("long").alias("n_tokens"),
        (F.sum(F.col("m") * -F.log("p")) / F.sum("m")).alias("loss"),
        F.sum(F.col("m") * -F.log("p")).alias("loss_sum"),
    )


@dataclass
class DecodeParams:
    temperature: float = 1.0
    repetition_penalty: float = 1.0
    top_k: int = 0
    top_p: float = 1.0


def _per_ctx(model: BigramModel, df: DataFrame) -> DataFrame:
    """A one-row-per-context table, broadcast when the (already counted) number of contexts is small."""
    return _sized(df, model.context_rows)


def decode_filter(model, params: DecodeParams):
    """M3: (ctx, tok, prob, mass), next-token distributions per context: penalty -> temperature -> top-k -> top-p -> renormalise.

    Candidates are the observed followers of each context. The repetition penalty applies to the
    token equal to its context (the one history token a bigram context knows). top_k = 0 is off and
    keeps ties at the k-th value; the nucleus keeps tokens whose preceding cumulative mass is
    <= top_p, so at least one stays.

    Mass is a whole number, so no result depends on the order of summation: without penalty and temperature it is the exact
    n (N + V + 1) + u + 1, to which the probability is proportional (while the corpus is below 2^31 tokens), otherwise the likelihood
    relative to the context's best in steps of 2^-40.

    When the largest context has at most CONTEXT_WINDOW_ROWS followers (counted at fit time),
    per-context windows rank it inside one task (one shuffle). Otherwise positions and running mass
    come from the range-partitioned index helper, so a hot context spans several tasks. Both give the same table.

    The distributions of a ``packed.PackedModel`` are worked out bucket by bucket (``packed.NextTokens``).
    """
    if not isinstance(model, BigramModel):
        from quillspark.operators.packed import NextTokens

        return NextTokens(model, params)
    # the context comes last: the windows find the rows where its join has put them
    b = model.counts.join(_sized(model.unigrams, model.vocab), "tok", "left").join(_per_ctx(model, model.contexts), "ctx")
    exact = params.temperature == 1 and params.repetition_penalty == 1 and model.k == 1 and model.total + model.vocab < 1 << 31
    whole = F.col("n") * F.lit(model.total + model.vocab + 1) + F.coalesce(F.col("u"), F.lit(0)) + 1
    t = b.select("ctx", "tok", F.log(_prob(model)).alias("l"), *([whole.cast("long").alias("mass")] if exact else []))
    if not exact:
        pen = F.lit(float(params.repetition_penalty))
        penalised = F.when(F.col("l") < 0, F.col("l") * pen).otherwise(F.col("l") / pen)
        t = t.withColumn("l", F.when(F.col("tok") == F.col("ctx"), penalised).otherwise(F.col("l")))
        t = t.withColumn("l", F.col("l") / F.lit(float(params.temperature)))
    if model.max_followers <= CONTEXT_WINDOW_ROWS:
        return _filter_by_windows(t, params)
    return _filter_by_index(model, t, params)


def _in_nucleus(top_p: float) -> F.Column:
    """Whole-number form of before / total <= top_p."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return wide("_before") * PARTS <= wide("_total") * round(top_p * PARTS)


def _filter_by_windows(t: DataFrame, params: DecodeParams) -> DataFrame:
    by_ctx = Window.partitionBy("ctx")
    if params.top_k and params.top_k > 0:
        t = t.withColumn("_r", F.rank().over(by_ctx.orderBy(F.col("l").desc()))).filter(
            F.col("_r") <= params.top_k).drop("_r")
    if "mass" not in t.columns:
        t = t.withColumn("mass", whole_mass(F.exp(F.col("l") - F.max("l").over(by_ctx))))
    t = t.withColumn("_total", F.sum("mass").over(by_ctx))
    if params.top_p < 1.0:
        ordered = by_ctx.orderBy(F.col("mass").desc(), F.col("l").desc(), F.col("tok"))
        before = F.sum("mass").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        t = t.withColumn("_before", F.coalesce(before, F.lit(0))).filter(_in_nucleus(params.top_p))
        t = t.withColumn("_total", F.sum("mass").over(by_ctx))
    return t.select("ctx", "tok", (F.col("mass") / F.col("_total")).alias("prob"), "mass")


def _filter_by_index(model: BigramModel, t: DataFrame, params: DecodeParams) -> DataFrame:
    t = t.withColumn("_neg", -F.col("l"))
    if params.top_k and params.top_k > 0:
        ranked = with_row_index(t, ["_neg", "tok"], ["ctx"], out="_r")
        kth = ranked.filter(F.col("_r") == params.top_k - 1).select("ctx", F.col("l").alias("_kth"))
        t = ranked.join(_per_ctx(model, kth), "ctx", "left").filter(
            F.col("_kth").isNull() | (F.col("l") >= F.col("_kth"))).drop("_r", "_kth")
    if "mass" not in t.columns:
        mx = t.groupBy("ctx").agg(F.max("l").alias("_mx"))
        t = t.join(_per_ctx(model, mx), "ctx").withColumn("mass", whole_mass(F.exp(F.col("l") - F.col("_mx"))))
    total = lambda d: _per_ctx(model, d.groupBy("ctx").agg(F.sum("mass").alias("_total")))
    t = t.select("ctx", "tok", "_neg", "mass")
    if params.top_p < 1.0:
        run = with_row_index(t.withColumn("_least", -F.col("mass")), ["_least", "_neg", "tok"], ["ctx"], out="_r", cum_of="mass", cum_out="_before")
        t = run.join(total(t), "ctx").filter(_in_nucleus(params.top_p)).drop("_total")
    t = t.join(total(t), "ctx")
    return t.select("ctx", "tok", (F.col("mass") / F.col("_total")).alias("prob"), "mass")
