"""Language-model scoring by cross-entropy difference.

A target and a background model are matched: the same vocabulary, order and smoothing, each counted over its whole corpus. A
document's score is the mean difference of its words' losses, background minus target; the higher, the more it is like the target.

The models are word bigrams: p(w | v) = (c(v, w) + PRIOR p(w)) / (c(v) + PRIOR), p(w) = (c(w) + ADDED) / (c + ADDED V). The vocabulary
is every word of both corpora (a least count of one), so all words of a scored document are in it. With ``leave_out`` a document's own
counts are taken from the background before its words are scored, as otherwise a long document would be its own model.

Counts are Spark tables that grow with the corpora. A pair that the background has once and the target never needs no row: its counts
follow from its absence. So a document's loss is a sum over its words, which takes every pair for such a one, and corrections for the
pairs that have a row. The most frequent words and pairs (``HEAD_WORDS``, ``HEAD_PAIRS``: bounds, found by histograms of the counts)
are looked up inside the tasks; the others are joined with the tables, where a filter of bounded size first drops most pairs without
a row. The driver gets the heads, the filter, two histograms and three numbers.

Words are lower-cased (A-Z) runs of other than ASCII space and 0x09-0x0D. Null and empty texts have no words and score 0; a corpus without
words has a uniform model. Repeated rows count each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import id_filter, written
from quillspark.llm.words import _R, Words, batch_words, mix

#: Smoothing counts of words and of words after a word.
ADDED, PRIOR = 0.5, 20.0
#: The context of a document's first word; it has a row among the words, with no occurrences but as a context.
START = np.uint64(0)
#: Most words and pairs that every task holds (40 and 24 bytes each).
HEAD_WORDS, HEAD_PAIRS = 1 << 18, 1 << 19
#: Keys by their highest bits: 00 a pair of head words (their numbers), 01 a document, 10 another pair (hash), 11 a word (hash).
_LOW, _DOC, _PAIR, _WORD = (np.uint64(x) for x in ((1 << 62) - 1, 1 << 62, 2 << 62, 3 << 62))
_SHIFT = 20

WORDS = "w long, wt long, wb long, vt long, vb long"
PAIRS = "key long, w long, t long, b long"
USES = "row long, key long, n long, m long, size long, base struct<doc_id: long, t: double, b: double>"


class _Slice:
    """Words of some texts by their numbers in the slice's own vocabulary: ``h`` (hashes; START is 0), ``word`` and ``before`` of each position."""

    def __init__(self, w: Words):
        words, number = np.unique(w.h, return_inverse=True)
        self.n, self.h = len(w.h), np.concatenate([[START], words])
        self.word = number.astype(np.int64) + 1
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[w.first[:-1][np.diff(w.first) > 0]] = 0

    def keys(self, of_word: np.ndarray, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key of each pair, whether both words are in the head) from the head's numbers of the slice's words."""
        v, w = of_word[before], of_word[word]
        head = (v >= 0) & (w >= 0)
        other = mix(self.h[before] * _R + self.h[word]) & _LOW | _PAIR
        return np.where(head, (v << _SHIFT | w), other.view(np.int64)), head


class _Head:
    """Rows of a bounded table, sorted by key."""

    def __init__(self, rows: DataFrame):
        columns = [c.to_numpy() for c in rows.toArrow().columns]
        order = np.argsort(columns[0].view(np.uint64), kind="stable")
        self.key, self.counts = columns[0].view(np.uint64)[order], [c[order] for c in columns[1:]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is absent."""
        if not len(self.key):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, at, -1)


def _frequent(table: DataFrame, n: Column, most: int) -> Column:
    """Condition for the rows of the highest counts, as many whole steps of a sixteenth of a power of two as ``most`` rows hold."""
    step = F.floor(F.log2(n) * 16)
    least, total = 1 << 20, 0
    for r in sorted(table.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return step >= least


def _word_counter(target: bool):
    """Rows of WORDS for the words of each slice of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, w in batch_words(b.column(0), "space_lower"):
                s = _Slice(w)
                zero = np.zeros(len(s.h), np.int64)
                word, before = (np.bincount(x, minlength=len(s.h)) for x in (s.word, s.before))
                columns = [s.h.view(np.int64), word, zero, before, zero] if target else [s.h.view(np.int64), zero, word, zero, before]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["w", "wt", "wb", "vt", "vb"])

    return count


def _pair_counter(target: bool, head: _Head):
    """Rows of PAIRS for the pairs of each slice of texts; w is the hash of the second word, 0 where both are in the head."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, w in batch_words(b.column(0), "space_lower"):
                s = _Slice(w)
                pair, n = np.unique(s.before * len(s.h) + s.word, return_counts=True)
                before, word = np.divmod(pair, max(1, len(s.h)))
                key, inside = s.keys(head.find(s.h), word, before)
                zero = np.zeros(len(key), np.int64)
                columns = [key, np.where(inside, zero, s.h.view(np.int64)[word]), n if target else zero, zero if target else n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "w", "t", "b"])

    return count


class _Model:
    """Sizes of both corpora and of the vocabulary, and whether a document's own counts are left out; formulas for numpy and for columns."""

    def __init__(self, size: int, all_t: int, all_b: int, leave_out: bool):
        self.size, self.all_t, self.all_b, self.out = max(size, 1), all_t, all_b, int(leave_out)

    def terms(self, log, x: tuple, y: tuple, n, m, words) -> tuple:
        """Losses of a document's word: x occurrences and y uses as a context in (target, background), n and m of them in the document of so many words."""
        t = m * log(y[0] + PRIOR) - n * log(self.prior(0, x[0], 0, 0))
        b = m * log(y[1] - self.out * m + PRIOR) - n * log((1 - self.out) + self.prior(1, x[1], n, words))
        return t, b

    def corrections(self, log, x: tuple, y: tuple, n, m, words) -> tuple:
        """What the losses of a document's pair differ from those of a pair without a row: x its counts, y those of its second word."""
        p, q = self.prior(0, y[0], 0, 0), self.prior(1, y[1], m, words)
        return n * (log(p) - log(x[0] + p)), n * (log((1 - self.out) + q) - log(x[1] - self.out * n + q))

    def prior(self, background: int, count, own, words):
        total = self.all_b - self.out * words if background else self.all_t
        return PRIOR * (count - self.out * own + ADDED) / (total + ADDED * self.size)


def _uses(head: _Head, pairs: _Head, wanted, model: _Model):
    """Rows of USES: one for each document with what the heads give, under a key of its own, and those of its other words and wanted pairs."""
    wt, wb, vt, vb = head.counts

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in batch_words(batch.column(2), "space_lower"):
                s, size = _Slice(w), np.diff(w.first)
                row, docs, width = batch.column(0)[i:j].to_numpy(), j - i, max(1, len(s.h))
                doc, of_word = np.repeat(np.arange(docs), size), head.find(s.h)
                # words of each document: a word is a context as often as it stands, but for the last place; START is one once
                both, at, n = np.unique(doc * width + s.word, return_inverse=True, return_counts=True)
                some = np.flatnonzero(size)
                m = n - np.bincount(at[w.first[1:][some] - 1], minlength=len(both))
                d, local = np.divmod(np.concatenate([both, some * width]), width)
                n, m = np.concatenate([n, np.zeros(len(some), np.int64)]), np.concatenate([m, np.ones(len(some), np.int64)])
                k = of_word[local]
                t, b = np.zeros(docs), np.zeros(docs)
                own = np.flatnonzero(k >= 0)
                for total, part in zip((t, b), model.terms(np.log, (wt[k[own]], wb[k[own]]), (vt[k[own]], vb[k[own]]), n[own], m[own], size[d[own]])):
                    total += np.bincount(d[own], part, docs)
                rest = np.flatnonzero(k < 0)
                yield _use_rows(row, d[rest], (mix(s.h[local[rest]]) & _LOW | _WORD).view(np.int64), n[rest], m[rest], size)
                _, first, times = np.unique((doc * width + s.before) * width + s.word, return_index=True, return_counts=True)
                key, inside = s.keys(of_word, s.word[first], s.before[first])
                d, m = doc[first], n[at[first]]
                k = np.where(inside, pairs.find(key.view(np.uint64)), -1)
                own = np.flatnonzero(k >= 0)
                w2 = of_word[s.word[first[own]]]
                for total, part in zip((t, b), model.corrections(np.log, tuple(c[k[own]] for c in pairs.counts), (wt[w2], wb[w2]), times[own], m[own], size[d[own]])):
                    total += np.bincount(d[own], part, docs)
                rest = np.flatnonzero(k < 0)
                rest = rest[wanted(key[rest])]
                yield _use_rows(row, d[rest], key[rest], times[rest], m[rest], size)
                key = (mix(row.view(np.uint64) + _R) & _LOW | _DOC).view(np.int64)
                zero = pa.array(np.zeros(docs, np.int64))
                base = pa.StructArray.from_arrays([batch.column(1)[i:j], pa.array(t), pa.array(b)], ["doc_id", "t", "b"])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(key), zero, zero, pa.array(size.astype(np.int64)), base], ["row", "key", "n", "m", "size", "base"])

    return use


def _use_rows(row: np.ndarray, doc: np.ndarray, key: np.ndarray, n: np.ndarray, m: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    base = pa.nulls(len(doc), pa.struct([("doc_id", pa.int64()), ("t", pa.float64()), ("b", pa.float64())]))
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (row[doc], key, n, m, size[doc])] + [base], ["row", "key", "n", "m", "size", "base"])


def _with_word_counts(head: _Head):
    """(key, t, b, wt, wb) of pairs of head words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = b.column(0).to_numpy() & ((1 << _SHIFT) - 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head.counts[0][w]), pa.array(head.counts[1][w])], ["key", "t", "b", "wt", "wb"])

    return add


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", leave_out: bool = False) -> DataFrame:
    """(doc_id, n_words, loss_target, loss_background, score) of every row; losses are nats a word."""
    back, front = docs.select(F.col(text_col).alias("text")), target.select(F.col(target_text).alias("text"))
    words = back.mapInArrow(_word_counter(False), WORDS).unionAll(front.mapInArrow(_word_counter(True), WORDS))
    words = written(words.groupBy("w").agg(*(F.sum(c).alias(c) for c in ("wt", "wb", "vt", "vb"))), "word-counts")
    seen = F.col("wt") + F.col("wb")
    sizes = words.agg(F.count_if(seen > 0), F.coalesce(F.sum("wt"), F.lit(0)), F.coalesce(F.sum("wb"), F.lit(0))).first()
    model = _Model(*sizes, leave_out)
    head = _Head(words.where(_frequent(words, seen + F.col("vt") + F.col("vb"), HEAD_WORDS)))

    counted = back.mapInArrow(_pair_counter(False, head), PAIRS).unionAll(front.mapInArrow(_pair_counter(True, head), PAIRS))
    counted = counted.groupBy("key", "w").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).where("t > 0 or b > 1")
    counted = written(counted, "pair-counts")
    common = (F.col("key") >= 0) & _frequent(counted.where("key >= 0"), F.col("t") + F.col("b"), HEAD_PAIRS)
    pairs, others = _Head(counted.where(common).select("key", "t", "b")), counted.where(~common)
    wanted = id_filter(others.select("key"), others.count())

    # one table of words and pairs: (key, two counts x, two counts y, whether it is a pair)
    inner = others.where("key >= 0").select("key", "t", "b").mapInArrow(_with_word_counts(head), "key long, t long, b long, wt long, wb long")
    outer = others.where("key < 0").join(words.select("w", "wt", "wb"), "w").select("key", "t", "b", "wt", "wb")
    known = words.mapInArrow(_word_keys(head), WORDS.replace("w long", "key long", 1)).withColumn("pair", F.lit(False))
    table = inner.unionAll(outer).withColumn("pair", F.lit(True)).unionAll(known).toDF("key", "xt", "xb", "yt", "yb", "pair")

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    used = rows.mapInArrow(_uses(head, pairs, wanted, model), USES).join(table, "key", "left")
    args = (F.log, (F.col("xt"), F.col("xb")), (F.col("yt"), F.col("yb")), F.col("n"), F.col("m"), F.col("size"))
    sums = [F.sum(F.coalesce(F.col(f"base.{c}"), F.lit(0.0)) + F.when(F.col("pair"), p).when(~F.col("pair"), w).otherwise(0.0)).alias(c) for c, p, w in zip("tb", model.corrections(*args), model.terms(*args))]
    total = used.groupBy("row").agg(F.max("base.doc_id").alias("doc_id"), F.max("size").alias("n_words"), *sums)
    mean = [F.col(c) / F.greatest("n_words", F.lit(1)) for c in ("t", "b")]
    return total.select("doc_id", "n_words", mean[0].alias("loss_target"), mean[1].alias("loss_background"), (mean[1] - mean[0]).alias("score"))


def _word_keys(head: _Head):
    """The words outside the head, under their keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = b.column(0).to_numpy().view(np.uint64)
                at = pa.array(np.flatnonzero(head.find(h) < 0))
                key = pa.array((mix(h) & _LOW | _WORD).view(np.int64))
                yield pa.RecordBatch.from_arrays([c.take(at) for c in (key, *b.columns[1:])], ["key", "wt", "wb", "vt", "vb"])

    return make
