"""N-gram Jaccard join: prefix filtering with length, positional and suffix filters.

A document is the set of its distinct word shingles, as 64-bit hashes. Two documents link when their sets' Jaccard
similarity is at least ``num/den``, decided exactly in integers.

1. A pass over the texts counts, for each of a fixed number of hash buckets, the documents' shingles in it. The global
   order "rare first" is (count of the shingle's bucket, hash): every size of input has the same order rule, and shingles that many
   documents share come last.
2. A second pass makes each document's prefix: the first ``n - ceil(t n) + 1`` shingles in that order. Two linked
   documents share one of them. Equal sets are one class from here on; its smallest row stands for it.
3. Prefix shingles that at least two classes hold give candidates, which length, positional and suffix filter thin out.
   Rather than all pairs of such a group, first each member is checked against the group's most central one (the one
   with the fewest rarer shingles), and linked members merge. Then only pairs of different components are looked at:
   the members outside a group's largest component, against all members. No link between different components is
   missed, and groups of copies cost what their size is, not its square.
4. A pair is verified once, on the whole sets, which are made again only for documents in a candidate pair.

Words are lower-cased (A-Z) runs of other than ASCII space and 0x09-0x0D. A text with fewer words than a shingle has one
shingle of them all; null, empty and word-less texts have an empty set and link with nothing. Rows with the same id
are one document: it links when one of its texts does, and its rows share a component. Rows with a null id are linked by
their sets and take part like others; a component of null ids alone has the id null. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import connected
from quillspark.llm.store import PARTIALS, id_filter, partials, summed, unused, written
from quillspark.llm.words import Words, batch_words, mix

#: Buckets of the shingle counts (as a power of two), 64-bit words of the suffix filter's parities, and its counted parts
#: for sets of at least LONG shingles, whose differences are too many for the parities.
SKETCH_BITS, BLOCK, WORDS, PARTS, LONG = 20, 4096, 8, 256, 512
PARITY = [f"k{i}" for i in range(WORDS)]

PREFIX = "row long, doc_id long, n long, sig1 long, sig2 long, prefix array<long>, " + ", ".join(f"{k} long" for k in PARITY) + ", parts array<int>"
SETS = "row long, shingles array<long>"


def doc_sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    win = w.windows(n)
    for k in range(len(w)):
        lo, hi = int(w.first[k]), int(w.first[k + 1])
        if hi - lo >= n:
            yield np.unique(win[lo : hi - n + 1])
        elif hi > lo:
            h = np.full(1, np.uint64(hi - lo))
            for x in w.h[lo:hi]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
            yield h
        else:
            yield np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> int:
    return int(mix(s).sum(dtype=np.uint64))


def _keys(ids: pa.Array, sets: list[np.ndarray]) -> np.ndarray:
    """The documents' ids; for a null one a negative number made from its set, far below real ids."""
    out = ids.fill_null(0).to_numpy(zero_copy_only=False).copy()
    for k in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)):
        out[k] = -(1 << 62) - (_signature(sets[k]) >> 2)
    return out


def _parity(s: np.ndarray) -> np.ndarray:
    """For each of 512 fixed parts of the shingle space, whether the set has an odd number there."""
    odd = np.bincount((mix(s) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _parts(s: np.ndarray) -> np.ndarray:
    """How many shingles of a long set fall into each of fixed parts; nothing for a short one."""
    return np.bincount((mix(s) >> np.uint64(40) & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32) if len(s) >= LONG else np.zeros(0, np.int32)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _counter(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for _, _, w in batch_words(b.column(1), "space_lower"):
                sets = list(doc_sets(w, n))
                total += np.bincount(_bucket(np.concatenate(sets)), minlength=len(total))
        yield partials(total, BLOCK)

    return count


def _prefixes(n: int, num: int, den: int, counts: np.ndarray):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in batch_words(b.column(1), "space_lower"):
                sets, size, sig1, sig2, prefix, odd, parts = list(doc_sets(w, n)), [], [], [], [], [], []
                for s in sets:
                    p = len(s) - (num * len(s) + den - 1) // den + 1 if len(s) else 0
                    head = s[np.lexsort((s, counts[_bucket(s)]))[:p]]
                    size.append(len(s))
                    sig1.append(_signature(s))
                    sig2.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), initial=np.uint64(0))))
                    prefix.append(head.view(np.int64))
                    odd.append(_parity(s))
                    parts.append(_parts(s))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_keys(b.column(0)[i:j], sets), pa.int64()), b.column(0)[i:j], pa.array(size, pa.int64()), pa.array(np.array(sig1, np.uint64).view(np.int64)), pa.array(np.array(sig2, np.uint64).view(np.int64)),
                     pa.array(prefix, pa.list_(pa.int64())), *(pa.array(x) for x in np.array(odd, np.int64).reshape(-1, WORDS).T), pa.array(parts, pa.list_(pa.int32()))],
                    ["row", "doc_id", "n", "sig1", "sig2", "prefix", *PARITY, "parts"],
                )

    return make


def _set_maker(n: int, wanted):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            some = wanted(ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            if some.any():
                b = b.filter(pa.array(some))
                for i, j, w in batch_words(b.column(1), "space_lower"):
                    sets = list(doc_sets(w, n))
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(b.column(0)[i:j], sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["row", "shingles"])

    return make


def _need(na: Column, nb: Column, num: int, den: int) -> Column:
    """Least intersection of a linked pair: ceil(num (na + nb) / (num + den))."""
    least = num * (na + nb)
    return F.floor((least + (num + den - 1) - F.pmod(least + (num + den - 1), F.lit(num + den))) / (num + den)).cast("long")


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Length and positional filter of two prefix entries (n, pos) with the same shingle."""
    na, nb, pa_, pb = (F.col(f"{x}.{y}") for y in ("n", "pos") for x in (a, b))
    length = (den * F.least(na, nb)) >= (num * F.greatest(na, nb))
    # before the shingle at most min(pos) are shared, after it at most the shorter rest
    bound = F.least(pa_, pb) + F.least(na - pa_, nb - pb)
    return length & (bound >= _need(na, nb, num, den))


def _close(a: str, b: str, num: int, den: int) -> Column:
    """Suffix filter: sets whose counts differ in parity in some parts differ by at least as many shingles."""
    apart = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in PARITY), F.lit(0))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return na + nb - apart >= 2 * _need(na, nb, num, den)


class _Join:
    def __init__(self, texts: DataFrame, reps: DataFrame, n: int, num: int, den: int):
        self.texts, self.reps, self.n, self.num, self.den = texts, reps, n, num, den

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass the suffix filter. An id with several texts has several sets; one pair of them is enough."""
        sets = self.reps.select("row", F.struct("n", *PARITY, "parts").alias("k"))
        two = pairs.join(sets.select(F.col("row").alias("a"), F.col("k").alias("ka")), "a").join(sets.select(F.col("row").alias("b"), F.col("k").alias("kb")), "b")
        na, nb = F.col("ka.n"), F.col("kb.n")
        apart = F.aggregate(F.zip_with("ka.parts", "kb.parts", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
        long_close = (F.least(na, nb) < LONG) | (na + nb - apart >= 2 * _need(na, nb, self.num, self.den))
        return two.where(_close("ka", "kb", self.num, self.den) & long_close).select("a", "b").distinct()

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets."""
        num, den = self.num, self.den
        left = written(pairs, name)
        ids = left.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        wanted = id_filter(ids, ids.count())
        sets = written(self.texts.mapInArrow(_set_maker(self.n, wanted), SETS), f"{name}-sets")
        both = left.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa")), "a")
        both = both.join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(den * shared >= num * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct()


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, parts, links) of a table: rows (doc_id, n_shingles, class), parts (id, component) of the classes that link with
    another one, and enough verified links (a, b) between classes to connect each component."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = summed(texts.mapInArrow(_counter(n), PARTIALS), 1 << SKETCH_BITS, BLOCK, np.int64).astype(np.int32)
    made = written(texts.mapInArrow(_prefixes(n, num, den, counts), PREFIX), "prefixes")
    same = ["sig1", "sig2", "n"]
    reps = written(made.where("n > 0").groupBy(*same).agg(F.min(F.struct("row", "prefix", *PARITY, "parts")).alias("r")).select(*same, "r.*"), "classes")

    entries = reps.select("row", "n", F.posexplode("prefix").alias("pos", "token"))
    groups = entries.groupBy("token").agg(F.count("*").alias("held"), F.min(F.struct("pos", "n", "row")).alias("hub")).where("held > 1").select("token", "hub")
    shared = written(entries.join(groups, "token").select("token", F.struct("row", "n", "pos").alias("e"), "hub"), "shared")

    join = _Join(texts, reps, n, num, den)
    near = shared.where((F.col("e.row") != F.col("hub.row")) & _may_link("e", "hub", num, den)).select(F.col("hub.row").alias("a"), F.col("e.row").alias("b"))
    stars = written(join.verified(join.close(near.distinct()), "stars"), "star-links")
    merged = connected(stars)

    known = reps.select(F.col("row").alias("id"), F.col("n").alias("size"), *PARITY).join(merged, "id", "left")
    label = shared.select("token", "e", F.col("e.row").alias("id")).join(known, "id").where("e.n = size")
    label = written(label.select("token", F.struct("e.row", "e.n", "e.pos", *PARITY).alias("e"), F.coalesce("component", "id").alias("c")), "labelled")
    largest = label.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("cs")).where("cs > 1")
    mixed = label.join(largest.select("token", F.col("top.c").alias("main")), "token")
    few = mixed.where("c <> main").select("token", F.col("e").alias("x"), F.col("c").alias("cx"))
    pairs = few.join(mixed.select("token", F.col("e").alias("y"), F.col("c").alias("cy"), "main"), "token")
    pairs = pairs.where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x.row") < F.col("y.row"))) & _may_link("x", "y", num, den) & _close("x", "y", num, den))
    rest = pairs.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()
    links = written(stars.unionAll(join.verified(join.close(rest), "rest")), "links")

    rows = written(made.select("row", "doc_id", "n", "sig1", "sig2").join(reps.select(*same, F.col("row").alias("class")), same, "left").select("row", "doc_id", F.col("n").alias("n_shingles"), "class"), "rows")
    texts_of = rows.groupBy("row").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("row", "a")
    several = rows.join(texts_of, "row").select("a", F.col("class").alias("b")).where("b is not null")
    return rows, connected(links.unionAll(several)), links


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id of the rows that links connect."""
    rows, parts, _ = jaccard_links(docs, n, num, den, id_col, text_col)
    # a class of one row that links with nothing is its own component
    labelled = written(rows.join(parts.select(F.col("id").alias("class"), "component"), "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "class").alias("c")), "components")
    first = labelled.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k")
    out = labelled.join(written(first, "firsts"), "c", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last), then the first. Rows are told apart by a number,
    not by their ids, so rows with null or repeated ids take part. Documents without words stay."""
    row = unused("__row", docs.columns)
    # numbers are taken once and read back: another execution could number the rows in another order
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", codec="zstd")
    rows, parts, _ = jaccard_links(numbered, n, num, den, row, text_col)
    ids = numbered.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"))
    labelled = rows.join(parts.select(F.col("id").alias("class"), "component"), "class", "left").select(F.col("doc_id").alias("row"), F.coalesce("component", "class").alias("c"))
    labelled = written(labelled.where("c is not null").join(ids, "row"), "numbered-components")
    first = labelled.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("k")).where("k > 1")
    gone = labelled.join(written(first.select("c", F.col("first.row").alias("stays")), "stays"), "c").where("row <> stays").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(docs.columns)
