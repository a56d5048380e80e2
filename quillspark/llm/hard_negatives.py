"""Hard-negative mining with an inverted multi-index.

Vectors are split into two halves, each with a codebook of its own; a cell is a pair of codewords. Rows are stored cell by cell in
shards of bounded size (a cell that holds many rows is dealt over several shards). For a query, a codeword's half-score is at most
``<half, centroid> + |half| * radius``; the sum of two such bounds holds for every row of the cell. A heap visits a shard's cells by
falling sum (multi-sequence order) and stops as soon as no unvisited cell can change the shard's answer: the window is certified, so
the result is that of a full scan. Queries go in blocks; blocks and shards meet in pairs, one row each, so a task holds one of each.

Two searches: first an anchor's positives (best rows of its label), then, for every positive, the best rows of other labels in the
window of scores that the positive sets. A bounded sample of rows, which also fits the codebooks, gives each search a first threshold.

Rows with a null label, a null vector, or a null or non-finite component take no part. Missing components of shorter vectors count as
0. A null id is no anchor and loses ties. Positives and negatives are rows with another id; every row of a repeated anchor id is an anchor of its own, and
repeated rows count as often as they stand. Extra columns are ignored. Without anchors or rows there is no result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.store import written

#: Rows that fit the codebooks and set first thresholds; rows of a shard; queries of a block; rows a cell should have; most codewords of a half.
SAMPLE, SHARD, BLOCK, CELL, CODEWORDS = 8192, 8192, 512, 256, 256
_LAST = (1 << 63) - 1

SHARDS = "shard int, ids binary, labels binary, cells binary, matrix binary, width int"
BLOCKS = "block int, ids binary, labels binary, matrix binary, width int"
POSITIVES = "block int, slot int, id long, score long"
NEGATIVES = "block int, slot int, place int, id long, score long"


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as long; null when the vector or a component is null or not finite."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Long vectors of any length up to ``width`` as one matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), np.int64)
    if len(flat):
        rows = np.repeat(np.arange(len(vectors)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _packed(m: np.ndarray) -> bytes:
    """Narrowest integer type that holds the matrix, then its bytes."""
    top = int(np.abs(m).max(initial=0))
    kind = "h" if top < 1 << 15 else "i" if top < 1 << 31 else "q"
    return kind.encode() + m.astype(kind).tobytes()


def _unpacked(b: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(b[1:], b[:1].decode())
    return flat.reshape(-1, width) if width else flat.reshape(0, 0)


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in float64 if every inner product is then exact, else in int64."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float64 if top < 1 << 53 else np.int64
    return a.astype(kind), b.astype(kind)


def k_means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of Lloyd's rounds from evenly spaced points; an empty cluster keeps its centroid."""
    centers = points[np.linspace(0, len(points) - 1, k).astype(int)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(points, centers)[0]
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centers))
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each point and the distance to it."""
    own = (np.einsum("ij,ij->i", centers, centers) - 2 * points.astype(np.float64) @ centers.T).argmin(1)
    return own, np.sqrt(((points - centers[own]) ** 2).sum(1))


class MultiIndex:
    """Two half-space codebooks with the radii of all rows' halves."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books, self.split = (first, second), first.shape[1]
        self.radii = (np.zeros(len(first)), np.zeros(len(second)))

    def assign(self, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [nearest(m[:, : self.split], self.books[0]), nearest(m[:, self.split :], self.books[1])]

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(middle, reach) of the half-scores of each codeword: scores lie within middle -+ reach."""
        halves = q[:, : self.split].astype(np.float64), q[:, self.split :].astype(np.float64)
        return [(h @ c.T, np.sqrt((h * h).sum(1))[:, None] * r[None, :]) for h, c, r in zip(halves, self.books, self.radii)]


def multi_sequence(upper1: np.ndarray, upper2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all pairs by falling upper1[i] + upper2[j], with a heap over the sorted halves."""
    a, b = np.argsort(-upper1, kind="stable"), np.argsort(-upper2, kind="stable")
    heap, done = [(-(upper1[a[0]] + upper2[b[0]]), 0, 0)], [0] * len(a)  # done[i]: pairs of row i that are out
    while heap:
        low, i, j = heapq.heappop(heap)
        yield -low, int(a[i]), int(b[j])
        done[i] = j + 1
        if i + 1 < len(a) and done[i + 1] == j:  # the pair below waits until its row's earlier pairs are out
            heapq.heappush(heap, (-(upper1[a[i + 1]] + upper2[b[j]]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (-(upper1[a[i]] + upper2[b[j + 1]]), i, j + 1))


class Shard:
    """Rows of one shard, sorted by cell and label, and where each cell lies."""

    def __init__(self, ids: bytes, labels: bytes, cells: bytes, packed: bytes, width: int, codes: int):
        self.ids, self.labels, cell = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(cells, np.int64)
        self.m = _unpacked(packed, width)
        names, at = np.unique(cell, return_index=True)
        ends = np.append(at[1:], len(cell))
        self.spans = {(int(c) // codes, int(c) % codes): (int(s), int(e)) for c, s, e in zip(names, at, ends)}
        self.one, self.two = np.unique(names // codes), np.unique(names % codes)

    def cells(self, bounds, k: int) -> Iterator[tuple[float, float, int, int]]:
        """(upper, lower, start, end) of the shard's cells for query ``k``, by falling upper bound."""
        (m1, r1), (m2, r2) = bounds
        m1, r1, m2, r2 = m1[k, self.one], r1[k, self.one], m2[k, self.two], r2[k, self.two]
        for upper, i, j in multi_sequence(m1 + r1, m2 + r2):
            span = self.spans.get((int(self.one[i]), int(self.two[j])))
            if span:
                yield upper, float(m1[i] - r1[i] + m2[j] - r2[j]), *span


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best by (falling score, id)."""
    order = np.lexsort((ids, -scores))[:n]
    return scores[order], ids[order]


_NONE = np.zeros(0, np.int64)


def positives(shard: Shard, m: np.ndarray, q: np.ndarray, bounds, k: int, own_id: int, label: int, floor: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's n best other rows of the same label; rows below ``floor`` may be missing."""
    top, ids = _NONE, _NONE
    for upper, _, s, e in shard.cells(bounds, k):
        need = max(floor, float(top[-1])) if len(top) == n else floor
        if upper + 1e-6 * (1 + abs(upper)) < need:
            break
        lo, hi = s + np.searchsorted(shard.labels[s:e], [label, label + 1])
        if lo < hi:
            other = shard.ids[lo:hi] != own_id
            score = (m[lo:hi] @ q)[other].astype(np.int64)
            top, ids = best(np.concatenate([top, score]), np.concatenate([ids, shard.ids[lo:hi][other]]), n)
    return top, ids


def windows(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole score s with low * p <= 100 * s <= high * p."""
    return -((-low * positive) // 100), (high * positive) // 100


def negatives(shard: Shard, m: np.ndarray, q: np.ndarray, bounds, k: int, own_id: int, label: int, lo: np.ndarray, hi: np.ndarray, floors: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every window, the shard's n best rows of other labels in it; rows below its floor may be missing."""
    found = [(_NONE, _NONE)] * len(lo)
    open_ = [w for w in range(len(lo)) if lo[w] <= hi[w]]
    if not open_:
        return found
    need, top = np.maximum(floors, lo).astype(np.float64), max(hi[w] for w in open_)
    for upper, lower, s, e in shard.cells(bounds, k):
        slack = 1e-6 * (1 + abs(upper))
        if upper + slack < min(need[w] for w in open_):
            break
        if lower - slack > top:
            continue
        other = (shard.labels[s:e] != label) & (shard.ids[s:e] != own_id)
        score, ids = (m[s:e] @ q)[other].astype(np.int64), shard.ids[s:e][other]
        for w in open_:
            fits = (score >= need[w]) & (score <= hi[w])
            if fits.any():
                found[w] = best(np.concatenate([found[w][0], score[fits]]), np.concatenate([found[w][1], ids[fits]]), n)
                if len(found[w][0]) == n:
                    need[w] = max(need[w], float(found[w][0][-1]))
    return found


class _Sample:
    """Sample rows, for first thresholds."""

    def __init__(self, ids, labels, m):
        self.ids, self.labels, self.m = ids, labels, m

    def nth_positive(self, scores: np.ndarray, own_id: int, label: int, n: int) -> float:
        s = scores[(self.labels == label) & (self.ids != own_id)]
        return float(np.partition(s, len(s) - n)[len(s) - n]) if len(s) >= n else -math.inf

    def nth_negatives(self, scores: np.ndarray, own_id: int, label: int, lo, hi, n: int) -> np.ndarray:
        s = np.sort(scores[(self.labels != label) & (self.ids != own_id)])
        at, end = np.searchsorted(s, hi, side="right") - n, np.searchsorted(s, lo)
        return np.array([float(s[a]) if a >= e else -math.inf for a, e in zip(at, end)])


def _columns(b: pa.RecordBatch, r: int) -> dict:
    return {name: b.column(i)[r].as_py() for i, name in enumerate(b.schema.names)}


def _search(index: MultiIndex, sample: _Sample, n: int):
    """Positives of every (block, shard) pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = _columns(b, r)
                shard = Shard(x["ids"], x["labels"], x["cells"], x["matrix"], x["width"], len(index.books[1]))
                q_ids, q_labels, q = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["q_labels"], np.int64), _unpacked(x["q_matrix"], x["width"])
                (m, qm), (sm, sq) = exact(shard.m, q), exact(sample.m, q)
                bounds, seen = index.bounds(q), sm @ sq.T
                for k in range(len(q_ids)):
                    floor = sample.nth_positive(seen[:, k], q_ids[k], q_labels[k], n)
                    top, ids = positives(shard, m, qm[k], bounds, k, q_ids[k], q_labels[k], floor, n)
                    if len(top):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), x["block"], np.int32)), pa.array(np.full(len(top), k, np.int32)), pa.array(ids), pa.array(top)], ["block", "slot", "id", "score"])

    return run


def _search_negatives(index: MultiIndex, sample: _Sample, n: int, low: int, high: int):
    """Negatives of every (block, shard) pair, in the windows of the anchors' positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = _columns(b, r)
                shard = Shard(x["ids"], x["labels"], x["cells"], x["matrix"], x["width"], len(index.books[1]))
                q_ids, q_labels, q = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["q_labels"], np.int64), _unpacked(x["q_matrix"], x["width"])
                (m, qm), (sm, sq) = exact(shard.m, q), exact(sample.m, q)
                bounds, seen, out = index.bounds(q), sm @ sq.T, []
                for a in x["anchors"]:
                    k = a["slot"]
                    lo, hi = windows(np.array([p["score"] for p in a["positives"]], np.int64), low, high)
                    floors = sample.nth_negatives(seen[:, k], q_ids[k], q_labels[k], lo, hi, n)
                    for p, (top, ids) in zip(a["positives"], negatives(shard, m, qm[k], bounds, k, q_ids[k], q_labels[k], lo, hi, floors, n)):
                        out.append((np.full(len(top), k), np.full(len(top), p["place"]), ids, top))
                if out:
                    slot, place, ids, top = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), x["block"], np.int32)), pa.array(slot.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(ids), pa.array(top)], ["block", "slot", "place", "id", "score"])

    return run


def _assigned(index: MultiIndex, width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                (c1, d1), (c2, d2) = index.assign(matrix(b.column(2), width))
                cell = c1.astype(np.int64) * len(index.books[1]) + c2
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d1), pa.array(d2)], ["id", "label", "v", "cell", "d1", "d2"])

    return make


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector", anchor_every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for integer vectors: anchors are the rows whose id is divisible by
    ``anchor_every``; a negative's score lies between ``low`` and ``high`` per cent of the positive's."""
    spark = rows.sparkSession
    clean = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("v"))
    clean = clean.where("label is not null and v is not null and not exists(v, x -> x is null)")
    is_anchor = (F.col("id") % anchor_every == 0) & (F.col("id") != _LAST)
    total, width, n_anchors = clean.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(is_anchor, 1))).first()
    if not n_anchors or not width:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    some = clean.orderBy(F.xxhash64("id", "label", "v"), "id").limit(SAMPLE).toArrow().combine_chunks()
    vectors = some.column(2).chunk(0)
    sample = _Sample(some.column(0).to_numpy(), some.column(1).to_numpy(), matrix(vectors, width))
    codes = int(min(CODEWORDS, max(1, round(math.sqrt(total / CELL))), len(sample.ids)))
    index = MultiIndex(k_means(sample.m[:, : width // 2], codes), k_means(sample.m[:, width // 2 :], codes))

    placed = written(clean.mapInArrow(_assigned(index, width), "id long, label long, v array<long>, cell long, d1 double, d2 double"), "placed")
    sizes = np.zeros(codes * codes, np.int64)
    for cell, n, d1, d2 in placed.groupBy("cell").agg(F.count("*"), F.max("d1"), F.max("d2")).collect():  # at most CODEWORDS**2 rows
        sizes[cell] = n
        index.radii[0][cell // codes], index.radii[1][cell % codes] = max(index.radii[0][cell // codes], d1), max(index.radii[1][cell % codes], d2)

    # consecutive cells share a shard; a large cell is dealt over several
    parts = np.maximum(1, -(-sizes // SHARD))
    first = np.zeros(len(sizes), np.int64)
    shard, room = -1, 0
    for c in np.flatnonzero(sizes):
        if parts[c] > 1 or sizes[c] > room:
            shard, room = shard + 1, SHARD
        first[c] = shard
        shard, room = shard + int(parts[c]) - 1, (room - sizes[c] if parts[c] == 1 else 0)
    n_shards = shard + 1

    def pack(table: pa.Table) -> pa.Table:
        cell, label, ids = (table.column(c).to_numpy() for c in ("cell", "label", "id"))
        order = np.lexsort((ids, label, cell))
        m = matrix(table.column("v").combine_chunks() if table.column("v").num_chunks != 1 else table.column("v").chunk(0), width)[order]
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "labels": [label[order].tobytes()], "cells": [cell[order].tobytes()], "matrix": [_packed(m)], "width": pa.array([width], pa.int32())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, ids = b.column(3).to_numpy(), b.column(0).to_numpy()
            spread = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
            if (parts > 1).any():  # equal ids of one cell are spread by their place as well
                spread = (spread + np.arange(len(ids))) % parts[cell]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array((first[cell] + spread).astype(np.int32))], ["id", "label", "v", "cell", "shard"])

    dealt = placed.mapInArrow(deal, "id long, label long, v array<long>, cell long, shard int")
    shards = written(dealt.groupBy("shard").applyInArrow(pack, SHARDS), "shards")

    n_blocks = -(-n_anchors // BLOCK)

    def pack_queries(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("label").to_numpy(), table.column("id").to_numpy()))
        ids, label = table.column("id").to_numpy()[order], table.column("label").to_numpy()[order]
        m = matrix(table.column("v").combine_chunks() if table.column("v").num_chunks != 1 else table.column("v").chunk(0), width)[order]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": [ids.tobytes()], "labels": [label.tobytes()], "matrix": [_packed(m)], "width": pa.array([width], pa.int32())})

    anchors = placed.where(is_anchor).select("id", "label", "v", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int").alias("block"))
    blocks = written(anchors.groupBy("block").applyInArrow(pack_queries, BLOCKS), "query-blocks")
    queries = blocks.select("block", F.col("ids").alias("q_ids"), F.col("labels").alias("q_labels"), F.col("matrix").alias("q_matrix"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")

    pairs = shards.join(queries.select("*", every), "shard").select("block", "q_ids", "q_labels", "q_matrix", "ids", "labels", "cells", "matrix", "width")
    order = Window.partitionBy("block", "slot").orderBy(F.desc("score"), "id")
    pos = pairs.mapInArrow(_search(index, sample, n_positives), POSITIVES).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    pos = written(pos, "positives")

    per_anchor = pos.groupBy("block", "slot").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("positives"))
    per_block = per_anchor.groupBy("block").agg(F.collect_list(F.struct("slot", "positives")).alias("anchors"))
    asked = written(queries.join(per_block, "block"), "asked")
    pairs = shards.join(asked.select("*", every), "shard").select("block", "q_ids", "q_labels", "q_matrix", "anchors", "ids", "labels", "cells", "matrix", "width")
    order = Window.partitionBy("block", "slot", "place").orderBy(F.desc("score"), "id")
    neg = pairs.mapInArrow(_search_negatives(index, sample, n_negatives, low, high), NEGATIVES).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    neg = neg.select("block", "slot", "place", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = np.frombuffer(b.column(1)[r].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b.column(0)[r].as_py(), np.int32)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["block", "slot", "anchor_id"])

    names = blocks.select("block", "ids").mapInArrow(ids_of, "block int, slot int, anchor_id long")
    out = neg.join(pos.select("block", "slot", "place", F.col("id").alias("positive"), F.col("score").alias("positive_score")), ["block", "slot", "place"]).join(names, ["block", "slot"])
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return out.select("anchor_id", known("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative").alias("negative_id"), "positive_score", "negative_score")
