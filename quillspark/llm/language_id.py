"""Language identification by segmentation-marginalised unigrams.

A word (with a mark for its begin) is a chain of pieces of a fixed public vocabulary, bytes included, so that each word has at
least one segmentation. Each language has its own piece probabilities. A forward pass over the bytes of a word sums the
probabilities of all its segmentations; a text's log probability is the sum over its words, and the languages' posterior
follows by Bayes' rule.

Learning: distinct words of each language are counted over all training documents by Spark; expectation maximisation
(expected counts of pieces by forward and backward sums) runs over that table, each round as sums over partitions.

Words are runs of other than ASCII space and 0x09-0x0D; a word of more than ``MAX_BYTES`` bytes is cut between characters.
Texts that are null or hold no letter are ``und`` with score 0, as are all when no language can be learned. Rows with a
null lang or id are not learned from; repeated rows count each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import PARTIALS, crc_part, partials, summed, written
from quillspark.llm.words import Words, _tables, mix, text_slices

#: The vocabulary, rounds of expectation maximisation, added count of a piece, longest word (bytes), text bytes at once.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS, ADDED, MAX_BYTES, BYTES_AT_ONCE, BATCH = 2, 0.05, 24, 12 << 20, 50_000
#: Languages that may be learned.
MAX_LANGUAGES = 500
_R = np.uint64(0x9E3779B97F4A7C15)
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))


def pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces as bytes; the mark of a word's begin is a space. Control pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {bytes([i]) for i in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            out.add(sp.id_to_piece(i).replace("▁", " ").encode())
    return sorted(p for p in out if len(p) <= MAX_BYTES + 1)


class Lattice:
    """Pieces by length, as sorted hashes; finds the pieces at all places of equally long words."""

    def __init__(self, vocabulary: list[bytes]):
        self.size, self.longest, self.hashes, self.ids = len(vocabulary), max(map(len, vocabulary)), [], []
        for n in range(self.longest + 1):
            own = [i for i, p in enumerate(vocabulary) if len(p) == n]
            h = self._extend(np.array([list(vocabulary[i]) for i in own], np.uint8).reshape(len(own), n))
            order = np.argsort(h)
            self.hashes.append(h[order])
            self.ids.append(np.array(own, np.int32)[order])

    @staticmethod
    def _extend(block: np.ndarray) -> np.ndarray:
        h = np.zeros(len(block), np.uint64)
        for k in range(block.shape[1]):
            h = h * _R + block[:, k].astype(np.uint64) + np.uint64(1)
        return h

    def edges(self, block: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(length, ids by [start, word]) for words of the same length (rows of bytes); ``size`` stands for no piece."""
        m, n = block.shape
        cols = np.ascontiguousarray(block.T).astype(np.uint64) + np.uint64(1)
        h, out = np.zeros((n, m), np.uint64), []
        for length in range(1, min(n, self.longest) + 1):
            h = h[: n - length + 1] * _R + cols[length - 1 :]
            table = self.hashes[length]
            if len(table):
                at = np.minimum(np.searchsorted(table, h.ravel()), len(table) - 1)
                ids = np.where(table[at] == h.ravel(), self.ids[length][at], self.size).astype(np.int32).reshape(h.shape)
                if (ids != self.size).any():
                    out.append((length, ids))
        return out


def _forward(edges, prob: np.ndarray, n: int, m: int) -> np.ndarray:
    """Sums over all segmentations up to each place: [place, word]; ``prob`` has a closing 0 for no piece."""
    a = np.zeros((n + 1, m))
    a[0] = 1
    for end in range(1, n + 1):
        for length, ids in edges:
            if length <= end:
                a[end] += a[end - length] * prob[ids[end - length]]
    return a


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, bytes with a leading space) of the words of each length."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offs)
    for n in np.unique(size).tolist():
        for part in np.array_split(np.flatnonzero(size == n), max(1, int((size == n).sum()) // BATCH)):
            block = np.full((len(part), n + 1), 32, np.uint8)
            block[:, 1:] = data[offs[part][:, None] + np.arange(n)]
            yield part, block


def word_scores(column: pa.Array, lattice: Lattice, probs: np.ndarray) -> np.ndarray:
    """log probability of each word in each language: [word, language]."""
    out = np.zeros((len(column), len(probs)))
    for part, block in _groups(column):
        edges = lattice.edges(block)
        for k, p in enumerate(probs):
            out[part, k] = np.log(_forward(edges, p, block.shape[1], len(part))[-1])
    return out


def distinct_words(w: Words) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words or parts of long ones, number of each word's, its document); a long word takes several places."""
    start, end, doc = w.start, w.end, np.repeat(np.arange(len(w)), np.diff(w.first))
    h = w.h
    long = np.flatnonzero(end - start > MAX_BYTES)
    if len(long):
        s, e, d, hh = [], [], [], []
        for i in long.tolist():
            a, z = int(start[i]), int(end[i])
            while a < z:
                b = min(z, a + MAX_BYTES)
                while b < z and b > a + 1 and w.buf[b] & 0xC0 == 0x80:
                    b -= 1
                s.append(a), e.append(b), d.append(doc[i])
                hh.append(hash(w.buf[a:b].tobytes()) & 0xFFFFFFFFFFFFFFFF)
                a = b
        keep = np.ones(len(start), bool)
        keep[long] = False
        start, end, doc = np.concatenate([start[keep], s]), np.concatenate([end[keep], e]), np.concatenate([doc[keep], d])
        h = np.concatenate([h[keep], mix(np.array(hh, np.uint64))])
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    s, size = start[first], (end - start)[first]
    at = np.repeat(s - np.cumsum(size) + size, size) + np.arange(size.sum())
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    # parts of broken texts need not be whole characters, so the words are bytes
    words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(w.buf[at].tobytes())])
    return words, which, doc


def _word_counts(languages: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        tables = _tables("space")
        for b in batches:
            lang = np.array([number[x] for x in b.column(1).to_pylist()])
            for i, j, buf, off in text_slices(b.column(0), BYTES_AT_ONCE):
                w = Words(buf, off, tables)
                if len(w.h):
                    words, which, doc = distinct_words(w)
                    key, n = np.unique(which * len(languages) + lang[i:j][doc], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((key % len(languages)).astype(np.int32)), words.take(pa.array(key // len(languages))), pa.array(n.astype(np.int64))], ["lang", "word", "n"])

    return count


def learn(docs: DataFrame, languages: list[str], vocabulary: list[bytes]) -> np.ndarray:
    """Piece probabilities [language, piece + 1] (the last is 0, for no piece), from columns text and lang."""
    lattice, v, m = Lattice(vocabulary), len(vocabulary), len(languages)
    counted = docs.select("text", "lang").mapInArrow(_word_counts(languages), "lang int, word binary, n long")
    table = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    probs = np.full((m, v + 1), 1.0 / v)
    probs[:, v] = 0
    for _ in range(ROUNDS):

        def expected(batches: Iterator[pa.RecordBatch], probs=probs) -> Iterator[pa.RecordBatch]:
            total = np.zeros((m, v + 1))
            for b in batches:
                lang, times = b.column(0).to_numpy(), b.column(2).to_numpy()
                for part, block in _groups(b.column(1)):
                    n, edges = block.shape[1], lattice.edges(block)
                    for k in np.unique(lang[part]).tolist():
                        own = lang[part] == k
                        few, p = [(length, ids[:, own]) for length, ids in edges], probs[k]
                        count = times[part][own].astype(float)
                        a = _forward(few, p, n, len(count))
                        z = np.zeros_like(a)
                        z[n] = count / a[n]
                        for start in range(n - 1, -1, -1):
                            for length, ids in few:
                                if start + length <= n:
                                    flow = z[start + length] * p[ids[start]]
                                    z[start] += flow
                                    total[k] += np.bincount(ids[start], a[start] * flow, v + 1)
            yield partials(total.ravel(), 1 << 13)

        got = summed(table.mapInArrow(expected, PARTIALS), m * (v + 1), 1 << 13, np.float64).reshape(m, v + 1)
        got[:, :v] += ADDED
        got[:, v] = 0
        probs = got / got.sum(1, keepdims=True)
    return probs


def language_scores(docs: DataFrame, vocabulary_path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; rows whose crc32(doc_id as text) mod 5 is 0 are held out of learning."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    train = rows.where((crc_part("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = train.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages, vocabulary = [r["lang"] for r in found], pieces(vocabulary_path)
    probs = learn(train, languages, vocabulary) if languages else np.zeros((0, len(vocabulary) + 1))
    lattice, prior = Lattice(vocabulary), np.log(np.array([r["count"] for r in found], float) / max(1, sum(r["count"] for r in found)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables("space")
        for b in batches:
            for i, j, buf, off in text_slices(b.column(1), BYTES_AT_ONCE):
                w = Words(buf, off, tables)
                log = np.tile(prior, (j - i, 1))
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])[off]
                some = np.diff(letters) > 0
                for k in np.flatnonzero(~some):
                    some[k] = bool(_LETTER.search(buf[off[k] : off[k + 1]].tobytes().decode("utf-8", "ignore")))
                if len(w.h) and languages:
                    words, which, doc = distinct_words(w)
                    scores = word_scores(words, lattice, probs)
                    for k in range(len(languages)):
                        log[:, k] += np.bincount(doc, scores[which, k], j - i)
                if languages:
                    best = log.argmax(1)
                    top = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
                    names = [languages[x] if ok else "und" for x, ok in zip(best.tolist(), some.tolist())]
                else:
                    names, top = ["und"] * (j - i), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(names, pa.string()), pa.array(np.where(some, top, 0.0))], ["doc_id", "lang_pred", "score"])

    out = rows.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_part("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
