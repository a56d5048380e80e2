"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration.

1. A pass over the texts makes a short vector of statistics for each document (kinds of bytes, word lengths, repetition).
2. The standardised vectors of the labelled training rows are mapped to cosines of random directions, whose inner products
   approximate a Gaussian kernel. Each partition sums the normal equations, for each fold apart; the driver adds them up and
   solves a system of fixed size, once for all folds and once without each.
3. Each labelled row is scored by the model that has not seen it; these scores and labels, summed in bins, give a
   monotone calibration (pool adjacent violators), which turns a score into the share of label 1.

Learning uses all labelled rows outside the held-out part; labels, lang, source and doc_id are no inputs of a score. Null and
empty texts are scored by their (zero) statistics. Repeated label rows of an id count by their mean; null labels and ids are left
out of learning; a null id is not held out. Repeated documents are scored each. Without labels of two kinds every score is the
mean label (0.5 without any). Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import PARTIALS, crc_part, partials, summed, written
from quillspark.llm.words import batch_words, list_array

#: Cosines, ridge weight a row, kernel width (times the square root of the number of statistics), folds, calibration bins.
COSINES, RIDGE, WIDTH, FOLDS, BINS, SEED = 256, 1e-4, 0.7, 3, 1024, 20250
#: A document counts as good from this score on.
KEEP_FROM = 0.7
LOW, HIGH = -0.5, 1.5

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b"!?", b"|", b"*%$#&@^~+=<>", b".", b",;:", b"()[]{}'\"`", b"-_/\\"]


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, len(_GROUPS))
    kind[0xC0:] = len(_GROUPS) + 1
    kind[0x80:0xC0] = len(_GROUPS) + 2
    for i, g in enumerate(_GROUPS):
        kind[list(g)] = i
    return kind


KINDS = len(_GROUPS) + 3
STATS = KINDS + 9


def statistics(w) -> np.ndarray:
    """One row of numbers for each document of a slice."""
    docs, kind = len(w), _byte_kinds()
    size = np.diff(w.offsets)
    owner = np.repeat(np.arange(docs), size)
    counts = np.bincount(owner * KINDS + kind[w.buf], minlength=docs * KINDS).reshape(docs, KINDS)
    out = np.zeros((docs, STATS))
    out[:, :KINDS] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    n = np.diff(w.first)
    of = np.repeat(np.arange(docs), n)
    length = (w.end - w.start).astype(float)
    many = np.maximum(n, 1)
    mean = np.bincount(of, length, docs) / many
    out[:, KINDS] = np.log1p(n)
    out[:, KINDS + 1] = mean
    out[:, KINDS + 2] = np.sqrt(np.maximum(np.bincount(of, length**2, docs) / many - mean**2, 0))
    head, tail = w.buf[w.start], w.buf[w.end - 1]
    out[:, KINDS + 3] = np.bincount(of, (head >= 65) & (head <= 90), docs) / many
    out[:, KINDS + 4] = np.bincount(of, np.isin(tail, np.frombuffer(b"!*%$#&|", np.uint8)), docs) / many
    out[:, KINDS + 5] = np.sqrt(counts[:, 4] / many)
    pair = np.zeros(0, np.uint64)
    if len(w.h) > 1:
        pair = w.windows(2)
    for k in range(docs):
        lo, hi = int(w.first[k]), int(w.first[k + 1])
        if hi > lo:
            _, c = np.unique(w.h[lo:hi], return_counts=True)
            out[k, KINDS + 6] = len(c) / (hi - lo)
            out[k, KINDS + 7] = c.max() / (hi - lo)
        if hi > lo + 1:
            out[k, KINDS + 8] = len(np.unique(pair[lo : hi - 1])) / (hi - lo - 1)
    return out


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, w in batch_words(b.column(1), "space"):
            x = statistics(w).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], list_array(x.ravel(), np.full(len(x), STATS), pa.float32())], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATS).astype(float)


class Model:
    """Standardisation, random directions, weights and calibration; ``score`` maps statistics to the share of label 1."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, prior: float):
        rng = np.random.default_rng(SEED)
        self.mean, self.std, self.prior = mean, np.where(std > 1e-9, std, 1.0), prior
        self.turn = rng.normal(size=(STATS, COSINES)) / (WIDTH * np.sqrt(STATS))
        self.shift = rng.uniform(0, 2 * np.pi, COSINES)
        self.weights: np.ndarray | None = None
        self.levels: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.levels is None:
            return np.full(len(x), self.prior)
        at = (np.arange(BINS) + 0.5) / BINS * (HIGH - LOW) + LOW
        return np.interp(self.features(x) @ self.weights, at, self.levels)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Nondecreasing means of bins by pooling adjacent violators; an empty bin takes the level between its neighbours."""
    pools: list[list[float]] = []
    for i in np.flatnonzero(count):
        pools.append([count[i], total[i], i, i])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    xs = [x for _, _, a, z in pools for x in ((a, z) if z > a else (a,))]
    ys = [t / c for c, t, a, z in pools for _ in ((a, z) if z > a else (a,))]
    return np.interp(np.arange(len(count)), xs, ys)


def fit(stats: DataFrame, labels: DataFrame, label: str, held_out) -> Model:
    """The model from all labelled rows that are not held out; only sums of fixed size reach the driver."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(label).alias("y"))
    fold = F.crc32(F.concat(F.lit("fold:"), F.col("doc_id").cast("string"))) % FOLDS
    train = written(stats.join(own, "doc_id").where(~held_out).select("x", "y", fold.cast("int").alias("fold")), "labelled")

    def moments(batches):
        total = np.zeros(2 * STATS + 3)
        for b in batches:
            x, y = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            total += np.concatenate([x.sum(0), (x**2).sum(0), [len(x), y.sum(), (y**2).sum()]])
        yield partials(total, 1 << 16)

    m = summed(train.mapInArrow(moments, PARTIALS), 2 * STATS + 3, 1 << 16, np.float64)
    n, ones = m[2 * STATS], m[2 * STATS + 1]
    if not n:
        return Model(np.zeros(STATS), np.ones(STATS), 0.5)
    mean = m[:STATS] / n
    model = Model(mean, np.sqrt(np.maximum(m[STATS : 2 * STATS] / n - mean**2, 0)), ones / n)
    if m[2 * STATS + 2] / n - (ones / n) ** 2 < 1e-12:
        return model
    d = COSINES + 1
    one = d * d + d + 1

    def equations(batches):
        total = np.zeros((FOLDS, one))
        for b in batches:
            x, y, f = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                z, t = model.features(x[f == k]), y[f == k]
                total[k] += np.concatenate([(z.T @ z).ravel(), z.T @ t, [len(t)]])
        yield partials(total.ravel(), 1 << 13)

    sums = summed(train.mapInArrow(equations, PARTIALS), FOLDS * one, 1 << 13, np.float64).reshape(FOLDS, one)

    def solve(s: np.ndarray) -> np.ndarray:
        a = s[: d * d].reshape(d, d) + np.eye(d) * max(RIDGE * s[-1], 1e-9)
        return np.linalg.solve(a, s[d * d : -1])

    unseen = np.array([solve(sums.sum(0) - sums[k]) for k in range(FOLDS)])

    def calibration(batches):
        total = np.zeros(2 * BINS)
        for b in batches:
            x, y, f = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            at = _bin((model.features(x) * unseen[f]).sum(1))
            total += np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])
        yield partials(total, 1 << 16)

    c = summed(train.mapInArrow(calibration, PARTIALS), 2 * BINS, 1 << 16, np.float64)
    model.weights, model.levels = solve(sums.sum(0)), np.clip(isotonic(c[:BINS], c[BINS:]), 0, 1)
    return model


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """(model, statistics of every row). Rows whose crc32(doc_id as text) mod 4 is 2 are held out."""
    stats = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_stat_rows, "doc_id long, x array<float>"), "statistics")
    return fit(stats, labels, label, crc_part("doc_id", 4) == 2), stats


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model, stats = quality_model(docs, labels, label, id_col, text_col)

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], ["doc_id", "score"])

    out = stats.mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(crc_part("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; texts stay where they are, only they go to Python."""
    model, _ = quality_model(docs, labels, label, id_col, text_col)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        x = np.concatenate([np.zeros((0, STATS)), *(statistics(w) for _, _, w in batch_words(text, "space"))])
        return pa.array(model.score(x.astype(np.float32).astype(float)) >= KEEP_FROM)

    return docs.where(good(text_col))
