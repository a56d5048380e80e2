"""Vocabulary, id lookup, line splitting, chunk caps and corpus counts."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.sequence import chunks
from quillspark.functions.text import nonblank, py_strip, space_pieces
from quillspark.operators.indexing import with_row_index
from quillspark.operators.ngram import COUNT_TOKENS, slices
from quillspark.operators.packed import _words, pack, unpack
from quillspark.session import scratch_path

# Reserved vocabulary entries and their ids.
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_ID = 4
# The most frequent entries, of at most so many bytes each, go to every task (at most 16 MB); only rarer or longer tokens are joined.
HEAD_ROWS, HEAD_TOKEN_BYTES = 200_000, 64
# Salt of the tail join: one long token may be frequent.
TAIL_SALT = 16


def _count_tokens(batches):
    """Tokens counted within each slice of rows."""
    import pyarrow as pa

    for b in batches:
        for i, j in slices(b.column(0), COUNT_TOKENS):
            counted = b.column(0).slice(i, j - i).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts").cast(pa.int64())], ["token", "n"])
    pa.default_memory_pool().release_unused()


def _pack_tokens(batches):
    """(keys, blob) of each slice of rows (key, tokens): its words once, sizes (0: null list) and tokens as numbers (0: null)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        for i, j in slices(b.column(1), COUNT_TOKENS):
            lists = b.column(1).slice(i, j - i)
            sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            keys = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))
            yield pa.RecordBatch.from_arrays([keys, pa.array([pack(coded.dictionary, sizes, codes)], pa.binary())], ["keys", "blob"])
    pa.default_memory_pool().release_unused()


def _unpacked(batches):
    """The rows (key, tokens) of packed slices, a batch for each."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for k in range(b.num_rows):
            a, c, sizes, codes = unpack(b.column(1)[k].as_py())
            words = pa.concat_arrays([pa.nulls(1, pa.string()), _words(a, c)])
            own = b.column(0)[k].values
            ends = np.concatenate([[0], np.cumsum(np.maximum(sizes.astype(np.int64) - 1, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(codes.astype(np.int64))), mask=pa.array(sizes == 0))
            yield pa.RecordBatch.from_arrays([own, lists], ["key", "tokens"])


def packed_tokens(df: DataFrame, key: str, tokens_col: str = "tokens") -> DataFrame:
    """Tokens of a corpus for ``build_vocab`` and ``lookup_sized``: written once, about two bytes a token."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col(tokens_col).cast("array<string>").alias("tokens")).mapInArrow(_pack_tokens, f"keys array<{kind}>, blob binary")
    path = scratch_path(df.sparkSession, "tokens")
    rows.write.option("compression", "uncompressed").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _count_packed(batches):
    import pyarrow as pa

    return _count_tokens(pa.RecordBatch.from_arrays([b.column(1)], ["tokens"]) for b in _unpacked(batches))


def build_vocab(df: DataFrame, tokens_col: str = "tokens", min_count: int = 1) -> DataFrame:
    """(token, id, count); ids by descending count then token, after the reserved ids.

    Counting starts inside the tasks, on slices of rows, and ends in a map-side combined aggregation; the dense ids come from the range-partitioned
    index helper, so no single task sorts the whole vocabulary. ``df`` may be ``packed_tokens``.
    """
    packed = df.columns == ["keys", "blob"]
    rows = df if packed else df.select(F.col(tokens_col).cast("array<string>").alias("tokens"))
    counts = (
        rows.mapInArrow(_count_packed if packed else _count_tokens, "token string, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("count"))
        .filter(F.col("count") >= min_count)
        .withColumn("neg_count", -F.col("count"))
    )
    ranked = with_row_index(counts, ["neg_count", "token"])
    words = ranked.select("token", (F.col("row_idx") + FIRST_ID).alias("id"), "count")
    spark = df.sparkSession
    reserved = spark.createDataFrame(
        [(PAD, PAD_ID, 0), (UNK, UNK_ID, 0), (CLS, CLS_ID, 0), (SEP, SEP_ID, 0)], "token string, id long, count long"
    )
    # reused by the size check and the lookup join: computed once, kept spillable
    return reserved.unionByName(words).persist(StorageLevel.MEMORY_AND_DISK)


def lookup_ids(df: DataFrame, vocab: DataFrame, key: str, tokens_col: str = "tokens", out: str = "ids") -> DataFrame:
    """(key, ids), tokens -> ids (unknown -> [UNK]), order kept; rows with no tokens get an empty list. ``key`` is unique."""
    return _lookup(df.select(key, tokens_col), vocab, key, df.schema[key].dataType.simpleString(), out, False)[0]


def lookup_sized(packed: DataFrame, vocab: DataFrame, key: str, out: str = "ids") -> tuple[DataFrame, DataFrame]:
    """(J3 of ``packed_tokens`` as ``lookup_ids``, (key, n: tokens of the row, null for a null list))."""
    ids, mapped = _lookup(packed, vocab, key, packed.schema["keys"].dataType.elementType.simpleString(), out, True)
    return ids, mapped.select(key, F.col("_n").alias("n"))


def _lookup(rows: DataFrame, vocab: DataFrame, key: str, kind: str, out: str, packed: bool) -> tuple[DataFrame, DataFrame]:
    """(result of J3, ids found inside the rows, with sizes). What is found inside is worked out again from packed rows, else kept.

    Ids are dense by falling frequency, so the entries with the smallest ids hold nearly all occurrences: they are looked up inside
    the row, batch by batch, in an array of bounded size that every task has. Only the other tokens are exploded, joined (salted)
    with the rest of the vocabulary and put back at their places; the corpus itself is never shuffled by token.
    """
    head_of = (F.col("id") < HEAD_ROWS) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)
    head = vocab.filter(head_of).select("token", F.col("id").cast("int").alias("id")).toArrow().combine_chunks()
    bound = rows.sparkSession.sparkContext.broadcast((head.column("token").combine_chunks(), head.column("id").combine_chunks()))
    rest = vocab.count() - head.num_rows

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words, ids = bound.value
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        for b in (x.slice(i, j - i) for x in (_unpacked(batches) if packed else batches) for i, j in slices(x.column(1), COUNT_TOKENS)):
            lists = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten().cast(words.type)
            found = pc.fill_null(ids.take(pc.index_in(flat, value_set=words)), -1)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            miss = np.flatnonzero(found.to_numpy(zero_copy_only=False) == -1)
            own = np.repeat(np.arange(len(sizes)), sizes)[miss]
            per = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends), found), pa.ListArray.from_arrays(pa.array(per), pa.array((miss - ends[own]).astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(per), flat.take(pa.array(miss))), pc.list_value_length(lists).cast(pa.int32())], [key, "_ids", "_pos", "_tok", "_n"])
            del lists, flat, found, own, miss, ends, per
            pa.default_memory_pool().release_unused()

    mapped = rows.mapInArrow(run, f"`{key}` {kind}, _ids array<int>, _pos array<int>, _tok array<string>, _n int")
    known = F.transform("_ids", lambda x: F.when(x < 0, F.lit(UNK_ID)).otherwise(x))
    if not rest:
        return mapped.select(key, known.alias(out)), mapped
    if not packed:
        mapped = mapped.persist(StorageLevel.MEMORY_AND_DISK)  # read for the tail and for the result
    tail = vocab.filter(~head_of).select("token", F.col("id").cast("int").alias("_tid"), F.explode(F.sequence(F.lit(0), F.lit(TAIL_SALT - 1))).alias("_salt"))
    asked = mapped.filter(F.size("_tok") > 0).select(key, F.explode(F.arrays_zip("_pos", "_tok")).alias("m")).select(key, "m._pos", F.col("m._tok").alias("token"))
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64(key, "_pos"), F.lit(TAIL_SALT)).cast("int"))
    hits = asked.join(tail, ["token", "_salt"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_tid"))).alias("_late"))
    late = lambda x, i: F.when(x < 0, F.coalesce(F.try_element_at("_late", i), F.lit(UNK_ID))).otherwise(x)
    return mapped.join(hits, key, "left").select(key, F.when(F.col("_late").isNull(), known).otherwise(F.transform("_ids", late)).alias(out)), mapped


def lines(text) -> F.Column:
    """Lines as Python iterates a text file: universal newlines, no empty piece after a final newline.

    ``text`` should be a column (not a nested expression): it is referenced twice.
    """
    t = F.col(text) if isinstance(text, str) else text
    body = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"\n\z", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def capped_texts(df: DataFrame, path_col: str, idx_col: str, chunks_col: str, n_batches: int) -> DataFrame:
    """Per file keep texts until the running chunk count reaches ``n_batches`` (overshoot kept).

    A text is kept when it is the first of its file or the chunks of the earlier texts are below the
    cap. The running count uses the partitioned index helper, so a huge file spans several tasks.
    """
    if n_batches < 0:
        return df
    with_cum = with_row_index(
        df.withColumn("_n", F.size(chunks_col)), [idx_col], [path_col], out="_ti", cum_of="_n", cum_out="_before"
    )
    kept = with_cum.filter((F.col("_ti") == 0) | (F.col("_before") < n_batches))
    return kept.drop("_n", "_ti", "_before")


def original_tokens(text_col: str) -> F.Column:
    """Pieces of a stripped text cut at single spaces, as the adjusted perplexity counts them."""
    return space_pieces(py_strip(text_col))


def whole_mode_counts(df: DataFrame, text_col: str, seq_len: int, group_cols=()) -> DataFrame:
    """T11 (whole-file mode): n_tokens (sum of chunk lengths), n_original_tokens, n_chunks."""
    from quillspark.functions.text import tokens

    # tokens are a column of their own: the chunk expression references them several times
    c = df.select(*group_cols, tokens(text_col).alias("_t"), original_tokens(text_col).alias("_orig"))
    c = c.select(*group_cols, chunks("_t", seq_len).alias("_chunks"), "_orig")
    return c.groupBy(*group_cols).agg(
        F.sum(F.aggregate("_chunks", F.lit(0), lambda acc, x: acc + F.size(x))).cast("long").alias("n_tokens"),
        F.sum("_orig").cast("long").alias("n_original_tokens"),
        F.sum(F.size("_chunks")).cast("long").alias("n_chunks"),
    )


def line_mode_counts(df: DataFrame, text_col: str, seq_len: int, group_cols=(), fast: bool = False) -> DataFrame:
    """T11 (line mode): original pieces over all lines (blank included); chunks over non-blank lines."""
    from quillspark.functions.sequence import head_chunk
    from quillspark.functions.text import tokens

    ls = df.select(*group_cols, F.explode(lines(text_col)).alias("line"))
    ls = ls.select(*group_cols, "line", nonblank("line").alias("_nb"), tokens("line").alias("_t"))
    per_line = F.when(F.col("_nb"), F.array(head_chunk("_t", seq_len)) if fast else chunks("_t", seq_len))
    c = ls.select(*group_cols, space_pieces("line").alias("_orig"), per_line.alias("_chunks"))
    return c.groupBy(*group_cols).agg(
        F.coalesce(F.sum(F.aggregate("_chunks", F.lit(0), lambda acc, x: acc + F.size(x))), F.lit(0)).cast("long").alias("n_tokens"),
        F.sum("_orig").cast("long").alias("n_original_tokens"),
        F.coalesce(F.sum(F.size("_chunks")), F.lit(0)).cast("long").alias("n_chunks"),
    )


def all_mode_counts(df: DataFrame, text_col: str, seq_len: int, group_cols=()) -> DataFrame:
    """T11 in one pass: (group_cols..., mode, n_tokens, n_original_tokens, n_chunks) for ``whole``, ``line`` and ``fast``.

    A text is tokenized once, line by line (no token crosses a line end, so the lines' counts add up to the text's), and the
    lengths of chunks follow from counts alone. Null texts have no lines and count nothing.
    """
    from quillspark.functions.text import tokens

    def total(rows, value):
        return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, x: acc + value(x))

    def kept(n):
        return F.when(n < seq_len, n).otherwise(n - n % seq_len)

    def n_chunks(n):
        return F.when(n < seq_len, F.lit(1).cast("long")).otherwise(F.floor(n / seq_len).cast("long"))

    per_line = F.transform(lines(text_col), lambda x: F.struct(F.size(tokens(x)).cast("long").alias("n"), nonblank(x).alias("nb"), space_pieces(x).cast("long").alias("orig")))
    c = df.filter(F.col(text_col).isNotNull()).select(*group_cols, per_line.alias("_all"), space_pieces(py_strip(text_col)).cast("long").alias("_orig"))
    c = c.select(*group_cols, "_orig", "_all", F.filter("_all", lambda x: x["nb"]).alias("_some"), total("_all", lambda x: x["n"]).alias("_n"), total("_all", lambda x: x["orig"]).alias("_pieces"))
    modes = [
        ("whole", kept(F.col("_n")), F.col("_orig"), n_chunks(F.col("_n"))),
        ("line", total("_some", lambda x: kept(x["n"])), F.col("_pieces"), total("_some", lambda x: n_chunks(x["n"]))),
        ("fast", total("_some", lambda x: F.least(x["n"], F.lit(seq_len).cast("long"))), F.col("_pieces"), F.size("_some").cast("long")),
    ]
    names = ("n_tokens", "n_original_tokens", "n_chunks")
    rows = F.array(*(F.struct(F.lit(mode).alias("mode"), *(v.alias(k) for k, v in zip(names, values))) for mode, *values in modes))
    return c.select(*group_cols, F.inline(rows)).groupBy(*group_cols, "mode").agg(*(F.sum(k).cast("long").alias(k) for k in names))
