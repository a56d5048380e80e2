"""Substring dedup by compacting the de Bruijn graph of word k-mers.

Edges of the graph are the windows of ``n`` consecutive words; its nodes are their shorter overlaps. Windows that follow one
another in a text and have the same smallest inner k-mer (their minimizer) make one path, which is carried as one row:
(minimizer, hash of the path's words, source coordinates). Equal windows always lie in paths with the same minimizer.

1. Spark counts minimizers; paths of a minimizer that occurs once hold no repeated window and are dropped.
2. A repeated minimizer with one path only (all occurrences have the same words around them) does not branch: its path is
   compacted to the first occurrence, and all windows of the other occurrences repeat it. A join with the first
   occurrences marks them by their source coordinates, a path at a time.
3. Where a minimizer branches (occurrences go on differently, as at the ends of a repeated passage), its paths are opened into
   windows, and a window is compared with the first one of the same two hashes (128 bits; neither alone decides).

Every word in a window that also starts earlier (smaller doc_id, or same document and earlier start) is marked; the marks are
taken from the input, not from what is left. Words are runs of other than ASCII space and 0x09-0x0D, unchanged.

Null, empty and short texts have no window and stay whole. Rows that repeat an id are the same document: of their windows only
the start decides what is earlier, so repeated rows do not remove one another. A null id comes after all others. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import id_filter, written
from quillspark.llm.words import Words, batch_words, list_array, mix

#: Words of a window and of a minimizer.
WINDOW, KMER = 20, 6
_INDEX = np.uint64((1 << 26) - 1)
_POWER = np.uint64(0xD1342543DE82EF95)
_LAST = (1 << 63) - 1

PATHS = "row long, doc long, doc_id long, n_words long, words_sha256 string, words_key long, minimizers array<long>, contents array<long>, starts array<int>, counts array<int>"
WINDOWS = "doc long, words_key long, h long, g long, start int"
TEXTS = "doc long, words_key long, text string"


def paths(w: Words, n: int, k: int) -> tuple[np.ndarray, ...]:
    """Per path: document, first window's start (word index of the slice), number of windows, minimizer hash, content hash."""
    total, none = len(w.h), np.zeros(0, np.int64)
    if total < n:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    kmers = w.windows(k, salt=1)
    key = (kmers & ~_INDEX) | np.arange(len(kmers), dtype=np.uint64)
    span, low = n - k + 1, key
    have = 1
    while have * 2 <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    owner = np.repeat(np.arange(len(w)), np.diff(w.first))
    start = np.arange(total - n + 1)
    start = start[owner[: total - n + 1] == owner[n - 1 :]]
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = (low[start] & _INDEX).astype(np.int64)
    new = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(start) != 1)])
    lo = start[new]
    count = np.diff(np.append(np.flatnonzero(new), len(start)))
    power = np.cumprod(np.full(total, _POWER))
    back = np.cumprod(np.full(total, np.uint64(pow(int(_POWER), -1, 1 << 64))))
    run = np.zeros(total + 1, np.uint64)
    np.cumsum(w.h * power, out=run[1:])
    content = mix((run[lo + count + n - 1] - run[lo]) * back[lo] + count.astype(np.uint64))
    return owner[lo], lo, count, mix(kmers[at[new]]), content


def _digests(w: Words, docs) -> list[bytes]:
    """sha256 of the words of some documents, joined by one space (``bytes.split`` splits where the words end)."""
    return [hashlib.sha256(b" ".join(w.buf[int(w.offsets[k]) : int(w.offsets[k + 1])].tobytes().split())).digest() for k in docs]


def _key(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


def _path_rows(n: int, k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in batch_words(b.column(2), "space"):
                doc, lo, count, mini, content = paths(w, n, k)
                per = np.bincount(doc, minlength=len(w))
                shas, ids = _digests(w, range(len(w))), b.column(1)[i:j]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], ids.fill_null(_LAST), ids, pa.array(np.diff(w.first), pa.int64()), pa.array([d.hex() for d in shas], pa.string()), pa.array(_key(shas)),
                     list_array(mini.view(np.int64), per, pa.int64()), list_array(content.view(np.int64), per, pa.int64()),
                     list_array((lo - w.first[doc]).astype(np.int32), per, pa.int32()), list_array(count.astype(np.int32), per, pa.int32())],
                    ["row", "doc", "doc_id", "n_words", "words_sha256", "words_key", "minimizers", "contents", "starts", "counts"],
                )

    return make


def _window_rows(n: int, k: int, wanted):
    """Windows of the paths whose minimizer may branch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in batch_words(b.column(1), "space"):
                doc, lo, count, mini, _ = paths(w, n, k)
                some = wanted(mini.view(np.int64)) if len(mini) else np.zeros(0, bool)
                if some.any():
                    doc, lo, count = doc[some], lo[some], count[some]
                    own = np.repeat(doc, count)
                    at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(own))
                    hit, which = np.unique(own, return_inverse=True)
                    ids = b.column(0)[i:j].fill_null(_LAST).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[own], pa.int64()), pa.array(_key(_digests(w, hit.tolist()))[which]), pa.array(w.windows(n)[at].view(np.int64)), pa.array(w.windows(n, base=_POWER)[at].view(np.int64)), pa.array((at - w.first[own]).astype(np.int32))],
                        ["doc", "words_key", "h", "g", "start"],
                    )

    return make


def _wanted_texts(wanted):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(_LAST)
            some = wanted(ids.to_numpy(zero_copy_only=False))
            if some.any():
                ids, texts = ids.filter(pa.array(some)), b.column(1).filter(pa.array(some))
                for i, j, w in batch_words(texts, "space"):
                    yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(_key(_digests(w, range(len(w))))), texts[i:j]], ["doc", "words_key", "text"])

    return make


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the words outside the merged ranges."""
    for b in batches:
        for i, j, w in batch_words(b.column(1), "space"):
            shas = []
            for k, ranges in enumerate(b.column(2)[i:j].to_pylist()):
                words = w.buf[int(w.offsets[k]) : int(w.offsets[k + 1])].tobytes().split()
                for r in reversed(ranges):
                    del words[r["start"] : r["end"]]
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(shas, pa.string())], ["row", "kept_sha256"])


def _merged(ranges):
    """Union of sorted ranges, as disjoint ones in order."""
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def step(done, r):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= r["start"]), joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), zero, step)


def repeated_ranges(docs: DataFrame, n: int = WINDOW, k: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, ranges): rows (row, doc, doc_id, n_words, words_sha256, words_key); ranges (row, start, end) of words in windows that
    also start earlier, with the source coordinates ``src`` (doc, start) of the first occurrence."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = written(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_path_rows(n, k), PATHS), "paths")
    rows = made.select("row", "doc", "doc_id", "n_words", "words_sha256", "words_key")
    twice = made.select(F.explode("minimizers").alias("m")).groupBy("m").agg(F.count("*").alias("held")).where("held > 1").select("m")
    twice = written(twice, "twice")  # a plain table on this side lets Spark split a hot minimizer's rows
    each = made.select("doc", "row", F.explode(F.arrays_zip("minimizers", "contents", "starts", "counts")).alias("p"))
    each = each.select("doc", "row", F.col("p.minimizers").alias("m"), F.col("p.contents").alias("content"), F.col("p.starts").alias("start"), F.col("p.counts").alias("windows"))
    shared = written(each.join(twice, "m"), "shared")

    at = F.struct("doc", "start")
    edges = shared.groupBy("m").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.min(at).alias("src"))
    edges = written(edges.select("m", (F.col("lo") != F.col("hi")).alias("branches"), "src"), "edges")
    compact = shared.join(edges.where("not branches"), "m").where(at > F.col("src"))
    compact = compact.select("row", "start", (F.col("start") + F.col("windows") + (n - 1)).alias("end"), "src")

    forks = edges.where("branches").select("m")
    wanted = id_filter(forks, forks.count())
    windows = written(texts.mapInArrow(_window_rows(n, k, wanted), WINDOWS), "windows")
    first = windows.groupBy("h", "g").agg(F.min(at).alias("src"), F.max(at).alias("other")).where("src < other").select("h", "g", "src")
    # windows know their row by id and words; equal rows of one id have equal windows
    again = windows.join(written(first, "first-windows"), ["h", "g"]).where(at > F.col("src")).join(rows.select("doc", "words_key", "row"), ["doc", "words_key"])
    return rows, compact.unionAll(again.select("row", "start", (F.col("start") + n).alias("end"), "src"))


def without_repeats(docs: DataFrame, n: int = WINDOW, k: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed: merged word ranges) of every row."""
    rows, ranges = repeated_ranges(docs, n, k, id_col, text_col)
    spans = ranges.groupBy("row").agg(_merged(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("removed"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda x, r: x + r["end"] - r["start"])
    marked = written(rows.join(spans.withColumn("n_removed", n_removed), "row", "left"), "marked")
    partly = marked.where("n_removed < n_words").select("row", "doc", "words_key", "removed")
    ids = partly.select("doc").distinct()
    wanted = id_filter(ids, ids.count())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_wanted_texts(wanted), TEXTS)
    texts = texts.dropDuplicates(["doc", "words_key"])
    kept = partly.join(texts, ["doc", "words_key"]).select("row", "text", "removed").mapInArrow(_kept, "row long, kept_sha256 string")
    out = marked.join(kept, "row", "left")
    whole = F.when(F.col("n_removed") == F.col("n_words"), F.sha2(F.lit(""), 256)).otherwise(F.col("words_sha256"))
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", whole).alias("kept_sha256"), "removed")
