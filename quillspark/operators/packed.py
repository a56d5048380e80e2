"""Count model and next-token table in packed form (M1, M3), for corpora whose pairs are too many to be moved as rows.

Pairs are kept by the bucket of their context, a row for each bucket: its contexts and tokens as two sorted lists of words, its pairs as
numbers that point into them (about three bytes a pair instead of twenty). They are counted inside the tasks, cross one shuffle, and all
followers of a context are in one place from then on: filter and ranges of draws need no window. How often a token occurs in the whole
corpus is asked for once by each bucket and comes back in the order of its words. Tokens are not null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import ngram as M
from quillspark.session import free_shuffles, scratch_path

# Buckets of contexts; pairs that a task holds before it passes them on; words of a bucket of tokens.
BUCKETS, HELD_PAIRS, TOKEN_WORDS = 256, 1 << 21, 250_000
# Rows of a batch of results; parts of an octave of mass in a histogram.
OUT_ROWS, BINS = 1 << 17, 16
# Draws are whole numbers in [0, 2^32).
DRAW_BITS = 32

PAIRS = "share int, bucket int, pairs long, contexts long, words long, n long, blob binary"
TOTALS = "bucket int, part int, vocab long, blob binary"


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder as it is (blobs are compressed already) and read back."""
    path = scratch_path(df.sparkSession, name)
    spark, schema = df.sparkSession, df.schema
    df.write.option("compression", "uncompressed").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _strings(words: pa.Array) -> list[np.ndarray]:
    """(sizes, bytes) of some strings."""
    words = words.cast(pa.string())
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = words.buffers()[2]
    return [np.diff(off), np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)]


def _words(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))


def pack(*columns) -> bytes:
    """Columns of strings or of whole numbers from 0 on: each in the narrowest type, byte by byte, compressed."""
    cols = [x for c in columns for x in (_strings(c) if isinstance(c, pa.Array) else [c])]
    cols = [c.astype(np.min_scalar_type(int(c.max()) if len(c) else 0)) for c in cols]
    body = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in cols)
    head = np.array([len(cols), len(body), *(x for c in cols for x in (c.itemsize, len(c)))], np.int64).tobytes()
    return head + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns of ``pack``, a column of strings as two (see ``_words``)."""
    n, size = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    shape = np.frombuffer(blob, np.int64, 2 * n, 16).reshape(n, 2).tolist()
    body = pa.decompress(blob[16 + 16 * n :], size, codec="zstd") if size else pa.py_buffer(b"")
    out, at = [], 0
    for width, rows in shape:
        part = np.frombuffer(body, np.uint8, width * rows, at).reshape(width, rows) if rows else np.zeros((width, 0), np.uint8)
        out.append(np.ascontiguousarray(part.T).view(f"u{width}").ravel() if width > 1 else part.ravel())
        at += width * rows
    return out


@dataclass
class Part:
    """Pairs by context: sorted contexts, followers of each, sorted tokens, each pair's token (rising within a context) and count."""

    ctx: pa.Array
    size: np.ndarray
    tok: pa.Array
    at: np.ndarray
    n: np.ndarray

    def blob(self) -> bytes:
        step, first = np.diff(self.at, prepend=0), np.cumsum(self.size) - self.size
        step[first] = self.at[first]
        return pack(self.ctx, self.size, self.tok, step, self.n)

    @staticmethod
    def of(blob: bytes) -> Part:
        a, b, size, c, d, step, n = unpack(blob)
        size = size.astype(np.int64)
        run = np.concatenate([[0], np.cumsum(step, dtype=np.int64)])
        return Part(_words(a, b), size, _words(c, d), run[1:] - np.repeat(run[np.cumsum(size) - size], size), n.astype(np.int64))


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different codes, sums of n), sorted."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
    return code[new], np.add.reduceat(n[order], new) if len(new) else n[:0]


def _sorted_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(different words, sorted; place of each given word)."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _merged(parts: list[Part]) -> Part:
    if len(parts) == 1:
        return parts[0]
    ctx, c = _sorted_words(pa.concat_arrays([p.ctx for p in parts]))
    tok, t = _sorted_words(pa.concat_arrays([p.tok for p in parts]))
    c = np.repeat(c, np.concatenate([p.size for p in parts]))
    first = np.cumsum([0] + [len(p.tok) for p in parts])
    t = t[np.concatenate([p.at + k for p, k in zip(parts, first)])]
    code, n = _summed(c * len(tok) + t, np.concatenate([p.n for p in parts]))
    return Part(ctx, np.bincount(code // len(tok), minlength=len(ctx)), tok, code % len(tok), n)


def bucket_of(words: pa.Array, buckets: int | None = None) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words)) % (buckets or BUCKETS)


class _Counter:
    """Pairs of a task's chunks, counted together; words have numbers in the order in which they come (0: the begin marker)."""

    def __init__(self):
        self.words, self.codes, self.counts, self.held = pa.array([M.BOS], pa.string()), [], [], 0

    def add(self, lists: pa.ListArray) -> None:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().cast(pa.string()).dictionary_encode()
        if not len(coded):
            return
        own = coded.dictionary.cast(pa.string())
        ids = pc.index_in(own, value_set=self.words)
        new = ids.is_null()
        ids = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids[ids < 0] = len(self.words) + np.arange(int((ids < 0).sum()))
        self.words = pa.concat_arrays([self.words, own.filter(new)])
        tok = ids[coded.indices.to_numpy()]
        ctx = np.concatenate([[0], tok[:-1]])
        ctx[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        code, n = np.unique(ctx << 32 | tok, return_counts=True)
        self.codes.append(code)
        self.counts.append(n.astype(np.int64))
        self.held += len(code)
        if self.held > HELD_PAIRS:
            self._reduce()

    def _reduce(self) -> None:
        code, n = _summed(np.concatenate(self.codes), np.concatenate(self.counts))
        self.codes, self.counts, self.held = [code], [n], len(code)

    def full(self) -> bool:
        return self.held > HELD_PAIRS // 2 and len(self.codes) == 1

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob); empties the counter."""
        if self.held:
            self._reduce()
            words, rank = _sorted_words(self.words)
            ctx, tok = rank[self.codes[0] >> 32], rank[self.codes[0] & 0xFFFFFFFF]
            place = bucket_of(words)[ctx]
            order = np.argsort((place * len(words) + ctx) * len(words) + tok)
            place, ctx, tok, n = place[order], ctx[order], tok[order], self.counts[0][order]
            cut = np.flatnonzero(np.diff(place, prepend=-1))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(place)]):
                c, size = np.unique(ctx[i:j], return_counts=True)
                t, at = np.unique(tok[i:j], return_inverse=True)
                yield int(place[i]), Part(words.take(pa.array(c)), size, words.take(pa.array(t)), at, n[i:j]).blob()
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(share, bucket, blob) of chunks (share, chunk)."""
    held: dict[int, _Counter] = {}

    def sent(shares):
        for s in shares:
            bucket, blob = zip(*held[s].rows()) if held[s].held else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(blob), pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], ["share", "bucket", "blob"])

    for b in batches:
        for i, j in M.slices(b.column(1), M.COUNT_TOKENS):
            part = b.slice(i, j - i)
            for s in pc.unique(part.column(0)).to_pylist():
                lists = part.column(1).filter(pc.equal(part.column(0), s)) if s is not None else part.column(1).filter(part.column(0).is_null())
                key = -1 if s is None else s
                held.setdefault(key, _Counter()).add(lists)
                if held[key].full():
                    yield from sent([key])
        pa.default_memory_pool().release_unused()
    yield from sent(list(held))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(first columns, rows of the others) for each run of equal first columns in a sorted partition."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != now and held:
                yield now, held
                held = []
            now = row[:keys]
            held.append(row[keys:])
    if held:
        yield now, held


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAIRS of the sorted rows (share, bucket, blob)."""
    now, parts = None, []

    def row():
        p = _merged(parts)
        out = (*now, len(p.n), len(p.ctx), len(p.tok), int(p.n.sum()), p.blob())
        return pa.RecordBatch.from_pylist([dict(zip(names, out))], schema)

    names = ["share", "bucket", "pairs", "contexts", "words", "n", "blob"]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int32(), *4 * [pa.int64()], pa.binary()])))
    for b in batches:
        for share, bucket, blob in zip(*(c.to_pylist() for c in b.columns)):
            if (share, bucket) != now and parts:
                yield row()
                parts = []
            now = (share, bucket)
            parts.append(Part.of(blob))
            # what is held stays near what is left in the end
            if len(parts) > 1 and sum(len(p.n) for p in parts[1:]) > max(HELD_PAIRS, len(parts[0].n)):
                parts = [_merged(parts)]
    if parts:
        yield row()


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_bucket(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(_partitions(df), *keys[-1:]).sortWithinPartitions(*keys)


def counted(chunks_df: DataFrame, chunk_col: str = "chunk", share_col: str | None = None, end: str | None = None) -> DataFrame:
    """M1: rows of PAIRS, by share and bucket. ``end`` is a marker put after the last token of a chunk."""
    chunk = F.col(chunk_col) if end is None else F.array_append(chunk_col, end)
    share = F.lit(0) if share_col is None else F.col(share_col)
    rows = chunks_df.select(share.cast("int").alias("share"), chunk.cast("array<string>").alias("chunk"))
    return _by_bucket(rows.mapInArrow(_count, "share int, bucket int, blob binary"), "share", "bucket").mapInArrow(_merge, PAIRS)


@dataclass
class PackedModel:
    """Counts of pairs (written rows of PAIRS, one a bucket) and of tokens (written rows of TOTALS), as BigramModel has them as rows."""

    pairs: DataFrame
    totals: DataFrame
    token_buckets: int
    total: int
    vocab: int
    max_followers: int = 0
    k: float = 1.0

    def release(self) -> None:
        """Nothing is kept in memory."""


def _ask(buckets: int):
    """(bucket of tokens, bucket, words and their counts) of the rows of PAIRS."""

    def run(batches):
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = Part.of(blob)
                n = np.bincount(p.at, weights=p.n, minlength=len(p.tok)).astype(np.int64)
                part = bucket_of(p.tok, buckets)
                order = np.argsort(part, kind="stable")
                cut = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist()
                segments = [order[i:j] for i, j in zip(cut, [*cut[1:], len(order)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[s[0]]) for s in segments], pa.int32()), pa.array([bucket] * len(segments), pa.int32()),
                     pa.array([pack(p.tok.take(pa.array(s)), n[s]) for s in segments], pa.binary())], ["part", "bucket", "blob"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of TOTALS: for the words of a bucket their counts in all of them."""
    for (part,), rows in groups(batches, 1):
        cols = [unpack(blob) for _, blob in rows]
        coded = pa.concat_arrays([_words(a, b) for a, b, _ in cols]).dictionary_encode()
        at = coded.indices.to_numpy()
        u = np.bincount(at, weights=np.concatenate([n for _, _, n in cols]), minlength=len(coded.dictionary)).astype(np.int64)[at]
        ends = np.cumsum([len(n) for _, _, n in cols])
        blobs = [pack(x) for x in np.split(u, ends[:-1])]
        vocab = [len(coded.dictionary)] + [0] * (len(rows) - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array(vocab, pa.int64()), pa.array(blobs, pa.binary())],
            ["bucket", "part", "vocab", "blob"])


def model_of(pairs: DataFrame, k: float = 1.0, merge: bool = False) -> PackedModel:
    """The model of written rows of PAIRS; ``merge``: a bucket has several rows (of shares)."""
    if merge:
        rows = pairs.select(F.lit(0).alias("share"), "bucket", "blob")
        pairs = written(_by_bucket(rows, "share", "bucket").mapInArrow(_merge, PAIRS), "pairs")
    n, words = pairs.agg(F.sum("n"), F.sum("words")).first()
    free_shuffles(pairs.sparkSession)
    parts = min(BUCKETS, 1 << ((words or 0) // TOKEN_WORDS).bit_length())
    asked = pairs.select("bucket", "blob").mapInArrow(_ask(parts), "part int, bucket int, blob binary")
    totals = written(_by_bucket(asked, "part").mapInArrow(_answer, TOTALS), "token-counts")
    del asked
    free_shuffles(pairs.sparkSession)
    return PackedModel(pairs, totals, parts, int(n or 0), int(totals.agg(F.sum("vocab")).first()[0] or 0), k=k)


def fit(chunks_df: DataFrame, chunk_col: str = "chunk", k: float = 1.0, end: str | None = None) -> PackedModel:
    """M1 in packed form."""
    return model_of(written(counted(chunks_df, chunk_col, end=end), "pairs"), k)


def with_totals(p: Part, blobs: list[tuple[int, bytes]], parts: int) -> np.ndarray:
    """Counts in the corpus of a bucket's tokens, from the answers sorted by part."""
    u = np.empty(len(p.tok), np.int64)
    u[np.argsort(bucket_of(p.tok, parts), kind="stable")] = np.concatenate([unpack(b)[0] for _, b in blobs])
    return u


@dataclass
class NextTokens:
    """M3 of a packed model: ``table`` has the distributions as rows, ``ranges`` as packed ranges of draws."""

    model: PackedModel
    params: M.DecodeParams

    def _grouped(self) -> DataFrame:
        m = self.model
        rows = m.pairs.select("bucket", F.lit(-1).alias("part"), "blob").unionAll(m.totals.select("bucket", "part", "blob"))
        return rows.repartition(_partitions(rows), "bucket").sortWithinPartitions("bucket", "part")

    def table(self) -> DataFrame:
        """(ctx, tok, prob, mass)."""
        return self._grouped().mapInArrow(_table(self.model.total, self.model.vocab, self.model.k, self.model.token_buckets, self.params), "ctx string, tok string, prob double, mass long")

    def ranges(self, do_sample: bool = True) -> DataFrame:
        """(bucket, bytes of the rows by mass, blob: contexts, rows of each, tokens, each row's token, begin of its range and bin of its mass)."""
        run = _ranges(self.model.total, self.model.vocab, self.model.k, self.model.token_buckets, self.params, do_sample)
        return written(self._grouped().mapInArrow(run, "bucket int, bins array<long>, blob binary"), "ranges")


def _filtered(p: Part, u: np.ndarray, total: int, vocab: int, k: float, params: M.DecodeParams) -> tuple[np.ndarray, ...]:
    """(context, token, mass) of the candidates that the filter keeps (see ``ngram.decode_filter``), sorted by context and falling mass."""
    own = np.repeat(np.arange(len(p.ctx)), p.size)
    ctx_n = np.bincount(own, weights=p.n, minlength=len(p.ctx))[own]
    at, u = p.at, u[p.at]
    like = np.log((p.n + k * ((u + 1) / float(total + vocab + 1))) / (ctx_n + k))
    exact = params.temperature == 1 and params.repetition_penalty == 1 and k == 1 and total + vocab < 1 << 31
    if exact:
        mass = p.n * (total + vocab + 1) + u + 1
    else:
        self_at = pc.fill_null(pc.index_in(p.ctx, value_set=p.tok), -1).to_numpy(zero_copy_only=False)
        pen = float(params.repetition_penalty)
        like = np.where(at == self_at[own], np.where(like < 0, like * pen, like / pen), like) / float(params.temperature)
    # equal likelihoods come in the order of tokens
    order = np.lexsort((at, -like, own) if not exact else (at, -like, -mass, own))
    own, at, like = own[order], at[order], like[order]
    mass = mass[order] if exact else None
    if params.top_k and params.top_k > 0:
        by_like = like if not exact else like[np.lexsort((-like, own))]
        first = np.cumsum(p.size) - p.size
        keep = like >= by_like[first + np.minimum(params.top_k, p.size) - 1][own]
        own, at, like, mass = own[keep], at[keep], like[keep], mass[keep] if exact else None
    size = np.bincount(own, minlength=len(p.ctx))
    first = (np.cumsum(size) - size)[own]
    if not exact:
        mass = np.maximum(np.floor(np.exp(like - like[first]) * float(M.UNIT)), 1).astype(np.int64)
    if params.top_p < 1.0:
        run = np.concatenate([[0], np.cumsum(mass)])
        whole = (run[np.cumsum(size)] - run[np.cumsum(size) - size])[own]
        # before * PARTS <= total * share, without leaving 64 bits
        share = round(params.top_p * M.PARTS)
        bound = whole // M.PARTS * share + whole % M.PARTS * share // M.PARTS
        keep = run[:-1] - run[first] <= bound
        own, at, mass = own[keep], at[keep], mass[keep]
    return own, at, mass


def _totals(own: np.ndarray, mass: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of each context, mass before each row in its context, mass of its context)."""
    size = np.bincount(own, minlength=contexts)
    run = np.concatenate([[0], np.cumsum(mass)])
    ends = np.cumsum(size)
    return size, run[:-1] - run[(ends - size)[own]], (run[ends] - run[ends - size])[own]


def _table(total: int, vocab: int, k: float, parts: int, params: M.DecodeParams):
    def run(batches):
        for _, ((_, blob), *answers) in groups(batches, 1):
            p = Part.of(blob)
            own, at, mass = _filtered(p, with_totals(p, answers, parts), total, vocab, k, params)
            whole = _totals(own, mass, len(p.ctx))[2]
            for i in range(0, len(own), OUT_ROWS):
                s = slice(i, i + OUT_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [p.ctx.take(pa.array(own[s])), p.tok.take(pa.array(at[s])), pa.array(mass[s] / whole[s]), pa.array(mass[s])], ["ctx", "tok", "prob", "mass"])

    return run


def scaled(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """ceil(part * 2^DRAW_BITS / whole) for 0 <= part <= whole < 2^62, exactly: some bits at a time."""
    out, rest = part // whole, part % whole
    step = max(1, 62 - int(whole.max()).bit_length()) if len(whole) else 1
    bits = DRAW_BITS
    while bits:
        s = min(step, bits)
        rest = rest << s
        out = (out << s) + rest // whole
        rest, bits = rest % whole, bits - s
    return out + (rest > 0)


def mass_bin(mass: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(mass.astype(np.float64)) * BINS).astype(np.int64)


def _ranges(total: int, vocab: int, k: float, parts: int, params: M.DecodeParams, do_sample: bool):
    def run(batches):
        for (bucket,), ((_, blob), *answers) in groups(batches, 1):
            p = Part.of(blob)
            own, at, mass = _filtered(p, with_totals(p, answers, parts), total, vocab, k, params)
            order = np.lexsort((at, -mass, own))
            own, at, mass = own[order], at[order], mass[order]
            size, before, whole = _totals(own, mass, len(p.ctx))
            if do_sample:
                lo, hi = scaled(before, whole), scaled(before + mass, whole)
                keep = hi > lo
            else:
                lo, keep = np.zeros(len(own), np.int64), before == 0
            own, at, lo, mass = own[keep], at[keep], lo[keep], mass[keep]
            words, at = np.unique(at, return_inverse=True)
            bins = mass_bin(mass)
            blob = pack(p.ctx, np.bincount(own, minlength=len(p.ctx)), p.tok.take(pa.array(words)), at, lo, bins)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.bincount(bins)], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["bucket", "bins", "blob"])

    return run
