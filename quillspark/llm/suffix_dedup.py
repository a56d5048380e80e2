"""Suffix-array dedup over bytes: maximal repeats from the interval tree of common prefixes.

A suffix array of the whole corpus would move every byte position many times, so it is built only where it has something to decide:

1. Every window of ``n`` bytes has an anchor, its leftmost smallest hashed run of ``GRAM`` bytes; windows that follow one another with the same anchor are
   one block of text. Equal windows have equal anchor runs and lie at the same place around them.
2. Spark counts anchor runs; blocks whose run occurs once hold no repeat. Equal blocks (64-bit hash of the run, independent 64-bit hash of the block)
   are one class: the first occurrence stands for it, every window of the others repeats it. Classes are combined before the shuffle.
3. Where a run has several classes, the bytes of their first occurrences meet in one task and an enhanced suffix array is built over them: the suffixes that begin
   with a repeated window, sorted, with the longest common prefixes of neighbours. A stack scan makes the tree of common-prefix intervals of at least
   ``n`` bytes; an interval whose suffixes have different bytes (or the end of their block) to the left is a maximal repeat, and is
   reported with all its occurrences, held at the deepest interval of each. Bytes are compared as they are, no hash decides.
4. A run with very many classes is dealt over chunks of bounded size; windows that are first in their chunk are then compared between the chunks by a 128-bit digest.

Every byte in an occurrence that is not the repeat's first is marked. First means smaller doc_id, then earlier start; marks are taken from the input.

Null, empty and short texts have no window and stay whole. Rows that repeat an id are the same document: only the start decides
what is earlier there, so repeated rows do not remove one another. A null id comes after all others. A very long text is cut into pieces that overlap by a
window. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import id_filter, written
from quillspark.llm.words import list_array, mix, text_buffer

#: Bytes of a window and of an anchor run; text bytes looked at at once; classes of a run that one chunk takes, text bytes of a suffix array.
WINDOW, GRAM, PIECE, CLASSES, ARRAY = 100, 32, 1 << 20, 4096, 1 << 20
_LAST = (1 << 63) - 1
_LOW = 127  # a block's number of windows is kept in the low bits of its text's key
_INDEX = np.uint64((1 << 24) - 1)
_POWERS = np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xD1342543DE82EF95)

BLOCK = "h long, content long, doc long, at long, start int"
FOUND = "kind byte, one long, two long, doc long, text_key long, start int, end int, block int"
SPANS = "doc long, text_key long, n_removed long, spans array<int>"


class Blocks:
    """Windows of some texts, as blocks: owner text, first window's start, number of windows, run hash, block hash."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, n: int, gram: int):
        none = np.zeros(0, np.int64)
        self.owner, self.lo, self.count, self.h, self.content = none, none, none, none, none
        size = len(buf)
        if size < n:
            return
        runs, inverses = [], []
        for k, r in enumerate(_POWERS):
            values = mix(np.arange(1 + 512 * k, 257 + 512 * k, dtype=np.uint64))[buf]
            run = np.zeros(size + 1, np.uint64)
            np.cumsum(values * np.cumprod(np.full(size, r)), out=run[1:])
            runs.append(run)
            inverses.append(np.cumprod(np.full(size + 1, np.uint64(pow(int(r), -1, 1 << 64)))))
        grams = mix((runs[0][gram:] - runs[0][:-gram]) * inverses[0][: size - gram + 1])
        key = (grams & ~_INDEX) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal runs is the smallest
        span, low, have = n - gram + 1, key, 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
        owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
        start = np.arange(size - n + 1)
        start = start[owner[: size - n + 1] == owner[n - 1 :]]
        if not len(start):
            return
        at = (low[start] & _INDEX).astype(np.int64)
        new = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(start) != 1)])
        self.lo = start[new]
        self.count = np.diff(np.append(np.flatnonzero(new), len(start)))
        self.owner = owner[self.lo]
        self.h = grams[at[new]].view(np.int64)
        self.content = mix((runs[1][self.lo + self.count + n - 1] - runs[1][self.lo]) * inverses[1][self.lo] + self.count.astype(np.uint64)).view(np.int64)


def pieces(column: pa.Array, n: int, limit: int = 0) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, offset in the text, bytes, offsets): runs of rows of about ``limit`` bytes; a longer text comes in pieces that
    hold each of its windows once."""
    limit = limit or PIECE
    buf, off = text_buffer(column)
    i, rows = 0, len(off) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        if off[j] - off[i] <= limit:
            yield i, j, 0, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        else:
            for shift in range(0, int(off[j] - off[i]), limit):
                part = buf[off[i] + shift : min(off[i] + shift + limit + n - 1, off[j])]
                yield i, j, shift, part, np.array([0, len(part)])
        i = j


def _run_hashes(n: int, gram: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, buf, off in pieces(b.column(0), n):
                h, held = np.unique(Blocks(buf, off, n, gram).h, return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(held.astype(np.int64))], ["h", "held"])

    return make


def _block_rows(n: int, gram: int, wanted: Callable[[np.ndarray], np.ndarray]):
    """Blocks whose run may be shared, of rows (doc, text_key, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, _, shift, buf, off in pieces(b.column(2), n):
                x = Blocks(buf, off, n, gram)
                some = wanted(x.h) if len(x.h) else np.zeros(0, bool)
                if some.any():
                    row = i + x.owner[some]
                    start = x.lo[some] - off[x.owner[some]] + shift
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.h[some]), pa.array(x.content[some]), pa.array(docs[row]), pa.array(keys[row] & ~_LOW | x.count[some]), pa.array(start.astype(np.int32))],
                        ["h", "content", "doc", "at", "start"],
                    )

    return make


class Suffixes:
    """Enhanced suffix array over some pieces of text: of the given windows those that another window equals, sorted, with common prefixes."""

    def __init__(self, text: np.ndarray, off: np.ndarray, windows: np.ndarray, n: int):
        """``windows``: windows of each piece; its suffixes begin at its first so many bytes."""
        own = np.repeat(np.arange(len(windows)), windows)
        at = off[:-1][own] + np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        run = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[text] * np.cumprod(np.full(len(text), _POWERS[0])), out=run[1:])
        inverse = np.cumprod(np.full(len(text) + 1, np.uint64(pow(int(_POWERS[0]), -1, 1 << 64))))
        _, name, held = np.unique((run[at + n] - run[at]) * inverse[at], return_inverse=True, return_counts=True)
        twice = held[name] > 1  # a suffix whose window stands alone is a leaf under no interval
        own, at = own[twice], at[twice]
        left = off[1:][own] - at
        width = int(left.max(initial=0))
        padded = np.concatenate([text, np.zeros(width, np.uint8)])
        rows = padded[at[:, None] + np.arange(width)[None, :]]
        rows[np.arange(width)[None, :] >= left[:, None]] = 0
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable") if len(at) else np.zeros(0, np.int64)
        self.own, self.at, self.left = own[order], at[order], left[order]
        rows = rows[order]
        self.first = self.at - off[:-1][self.own]  # place in the piece
        self.before = np.where(self.first > 0, text[np.maximum(self.at - 1, 0)].astype(np.int16), -1)
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width) if len(at) > 1 else np.zeros(0, np.int64)
        self.lcp = np.concatenate([[0], np.minimum(common, np.minimum(self.left[1:], self.left[:-1])), [0]]) if len(at) else np.zeros(1, np.int64)


def intervals(lcp: np.ndarray, before: np.ndarray, n: int) -> Iterator[tuple[int, int, int, list[tuple[int, int]], bool]]:
    """Common-prefix intervals of at least ``n`` bytes, children before parents: (length, first, last, parts, left-diverse). ``parts`` are the
    ranges of the suffix array that lie directly in it: its child intervals and single suffixes, in order."""
    stack: list[list] = []  # [length, first, parts, byte before all of them, or -1 if there are several or an end]
    for k in range(1, len(lcp)):
        here = int(lcp[k])
        part, byte = (k - 1, k - 1), int(before[k - 1])
        while stack and stack[-1][0] > here:
            length, first, parts, left = stack.pop()
            parts.append(part)
            left = left if left == byte else -1
            yield length, first, k - 1, parts, left < 0
            part, byte = (first, k - 1), left
        if here >= n and (not stack or stack[-1][0] < here):
            stack.append([here, part[0], [part], byte])
        elif stack:
            stack[-1][2].append(part)
            stack[-1][3] = stack[-1][3] if stack[-1][3] == byte else -1


def repeats(suffixes: Suffixes, order: np.ndarray, n: int) -> Iterator[tuple[int, int, int, list[int], bool]]:
    """(length, first, last, later suffixes held here, maximal) of every interval; ``order`` is the rank of a suffix's occurrence (ties are
    the same place). An interval's occurrences are the suffixes first..last; those that are not the earliest in it are held at the deepest such interval."""
    earliest: dict[tuple[int, int], list[int]] = {}
    for length, first, last, parts, maximal in intervals(suffixes.lcp, suffixes.before, n):
        heads = [earliest.pop(p, None) or [p[0]] for p in parts]
        least = min(order[h[0]] for h in heads)
        kept = [x for h in heads for x in h if order[x] == least]
        later = [x for h in heads for x in h if order[x] != least]
        earliest[first, last] = kept
        yield length, first, last, later, maximal


def _array_rows(n: int, every: bool):
    """Rows (h, chunk, chunks, doc, text_key, start, windows, piece), sorted by (h, chunk), to marked ranges (kind 0) and, where a run is dealt over
    chunks, the windows that are first in their chunk (kind 1); with ``every`` also all occurrences of the maximal repeats (kind 2)."""

    def scan(t: pa.Table) -> pa.RecordBatch:
        doc, key, start, windows, chunks = (t.column(c).to_numpy() for c in ("doc", "text_key", "start", "windows", "chunks"))
        column = t.column("piece").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        text, off = text_buffer(column.cast(pa.binary()).view(pa.binary()))
        s = Suffixes(text, off, windows, n)
        place = start[s.own] + s.first
        order = np.empty(len(place), np.int64)
        by = np.lexsort((place, doc[s.own]))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(doc[s.own][by]) != 0) | (np.diff(place[by]) != 0)
        order[by] = np.cumsum(new)
        own, lo, hi = [], [], []
        gone = np.zeros(len(place), bool)
        groups = []
        for length, first, last, later, maximal in repeats(s, order, n):
            gone[later] = True
            if maximal:
                own += later
                hi += [length] * len(later)
                if every:
                    groups.append((length, first, last))
        own = np.array(own, np.int64)
        lo = place[own]
        hi = lo + np.array(hi, np.int64)
        row = s.own[own]
        zero = np.zeros(len(own), np.int64)
        out = [(zero.astype(np.int8), zero, zero, doc[row], key[row], lo, hi, start[row])]
        for length, first, last in groups:
            digest = np.frombuffer(hashlib.blake2b(text[s.at[first] : s.at[first] + length].tobytes(), digest_size=16).digest(), np.int64)
            x, full = np.arange(first, last + 1), np.ones(last + 1 - first, np.int64)
            out.append((2 * full, digest[0] * full, digest[1] * full, doc[s.own[x]], key[s.own[x]], place[x], place[x] + length, start[s.own[x]]))
        if (chunks > 1).any():
            # windows that stand alone in the chunk are first there as well
            each = np.repeat(np.arange(len(windows)), windows)
            inside = np.arange(len(each)) - np.repeat(np.cumsum(windows) - windows, windows)
            alive = chunks[each] > 1
            dead = np.zeros(len(each), bool)
            dead[(np.cumsum(windows) - windows)[s.own[gone]] + s.first[gone]] = True
            pick = np.flatnonzero(alive & ~dead)
            at = off[:-1][each[pick]] + inside[pick]
            raw = text.tobytes()
            digest = np.frombuffer(b"".join(hashlib.blake2b(raw[a : a + n], digest_size=16).digest() for a in at.tolist()), np.int64).reshape(-1, 2)
            begin = start[each[pick]] + inside[pick]
            out.append((np.ones(len(pick), np.int8), digest[:, 0], digest[:, 1], doc[each[pick]], key[each[pick]], begin, begin + n, start[each[pick]]))
        kind, one, two, d, k, a, z, block = (np.concatenate(c) for c in zip(*out))
        ints = [pa.array(c.astype(np.int32)) for c in (a, z, block)]
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), pa.array(one), pa.array(two), pa.array(d), pa.array(k), *ints], ["kind", "one", "two", "doc", "text_key", "start", "end", "block"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            h, chunk = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = np.append(np.flatnonzero((np.diff(h) != 0) | (np.diff(chunk) != 0)) + 1, len(h)) if len(h) else []
            begin = 0
            for end in ends:
                if held and size >= ARRAY and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (int(h[begin]), int(chunk[begin])):
                    yield scan(pa.Table.from_batches(held))
                    held, size = [], 0
                part = b.slice(begin, end - begin)
                size += int(part.column("windows").to_numpy().sum()) + n * (end - begin)
                held.append(part)
                begin = end
        if held:
            yield scan(pa.Table.from_batches(held))

    return make


def _cut(n: int):
    """Rows (text, [(h, chunk, chunks, doc, text_key, start, windows)]) to one row a block with its bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_buffer(b.column(2))
            lists = b.column(3)
            x = {c: lists.flatten().field(c).to_numpy() for c in ("h", "chunk", "chunks", "start", "windows")}
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            docs, keys, raw = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row], buf.tobytes()
            lo = off[row] + x["start"]
            step = 1 << 14
            for i in range(0, len(row), step):
                s = slice(i, i + step)
                parts = [raw[a : a + w + n - 1] for a, w in zip(lo[s].tolist(), x["windows"][s].tolist())]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[c][s]) for c in ("h", "chunk", "chunks")), pa.array(docs[s]), pa.array(keys[s]), pa.array(x["start"][s]), pa.array(x["windows"][s]), pa.array(parts, pa.binary())], ["h", "chunk", "chunks", "doc", "text_key", "start", "windows", "piece"])

    return make


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (doc, text_key, start, end), sorted, to one row a text: disjoint spans [start, end, ...] in order."""

    def merged(doc, key, start, end):
        text = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(key) != 0)])
        base = np.cumsum(text) - 1
        far = (base << 32) + end  # running ends never reach into the next text
        reach = np.maximum.accumulate(far)
        new = text.copy()
        new[1:] |= ((base << 32) + start)[1:] > reach[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        spans = np.stack([start[first], reach[last] - (base[last] << 32)], 1)
        per = np.bincount(base[first])
        removed = np.bincount(base[first], weights=spans[:, 1] - spans[:, 0]).astype(np.int64)
        at = np.flatnonzero(text)
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(key[at]), pa.array(removed), list_array(spans.ravel().astype(np.int32), 2 * per, pa.int32())], ["doc", "text_key", "n_removed", "spans"])

    held = None
    for b in batches:
        cols = [b.column(i).to_numpy().astype(np.int64) for i in range(4)]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1]) + 1 if (cols[0][0], cols[1][0]) != (cols[0][-1], cols[1][-1]) else 0
        if cut:
            yield merged(*(c[:cut] for c in cols))
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield merged(*held)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the bytes outside the spans, of rows (doc, text_key, text, spans)."""
    for b in batches:
        buf, off = text_buffer(b.column(2))
        raw, shas = memoryview(buf.tobytes()), []
        for k, spans in enumerate(b.column(3).to_pylist()):
            sha, at = hashlib.sha256(), int(off[k])
            for s, e in zip(spans[::2], spans[1::2]):
                sha.update(raw[at : int(off[k]) + s])
                at = int(off[k]) + e
            sha.update(raw[at : int(off[k + 1])])
            shas.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shas, pa.string())], ["doc", "text_key", "kept_sha256"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc: id with null last, text_key, text); a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).bitwiseAND(F.lit(~_LOW)).alias("text_key"), text.alias("text"))


def _classes(docs: DataFrame, n: int, gram: int, id_col: str, text_col: str, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks whose run is shared, their classes with the first occurrence, what the suffix arrays found)."""
    if not gram <= n <= gram + _LOW - 1:
        raise ValueError(f"a window of {n} bytes needs a run of {n - _LOW + 1} to {n} bytes")
    texts = keyed(docs, id_col, text_col)
    long_ = texts.where(F.octet_length("text") >= n)
    held = long_.select("text").mapInArrow(_run_hashes(n, gram), "h long, held long").groupBy("h").agg(F.sum("held").alias("held"))
    shared = written(held.where("held > 1").select("h"), "shared-runs")
    blocks = long_.select("doc", "text_key", "text").mapInArrow(_block_rows(n, gram, id_filter(shared, shared.count())), BLOCK)
    classes = written(blocks.groupBy("h", "content").agg(F.count("*").alias("held"), F.min(F.struct("doc", "start", "at")).alias("src")), "classes")

    # runs of several classes: their first occurrences, with their bytes, in chunks of bounded size
    forks = classes.groupBy("h").agg(F.count("*").alias("classes")).where("classes > 1")
    forks = written(forks.select("h", F.ceil(F.col("classes") / CLASSES).cast("int").alias("chunks")), "forks")
    first = classes.join(forks, "h").select("h", F.pmod("content", "chunks").cast("int").alias("chunk"), "chunks", "src.doc", "src.start", "src.at")
    lists = first.select("doc", *_unpacked(), F.struct("h", "chunk", "chunks", "start", _unpacked()[1]).alias("b")).groupBy("doc", "text_key").agg(F.collect_list("b").alias("blocks"))
    lists = written(lists, "class-places")
    ids = lists.select("doc").distinct()
    some = long_.select("doc", "text_key", "text").mapInArrow(_of_docs(id_filter(ids, ids.count())), "doc long, text_key long, text string")
    cut = some.dropDuplicates(["doc", "text_key"]).join(lists, ["doc", "text_key"]).mapInArrow(_cut(n), "h long, chunk int, chunks int, doc long, text_key long, start int, windows int, piece binary")
    found = cut.repartition("h", "chunk").sortWithinPartitions("h", "chunk").mapInArrow(_array_rows(n, every), FOUND)
    return blocks, classes, written(found, "found")


def _unpacked() -> tuple[Column, Column]:
    """Text key and number of windows of a block."""
    return F.col("at").bitwiseAND(F.lit(~_LOW)).alias("text_key"), F.col("at").bitwiseAND(F.lit(_LOW)).cast("int").alias("windows")


def repeated_ranges(docs: DataFrame, n: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_key, start, end) of byte ranges whose windows of ``n`` bytes all start earlier as well; ranges may overlap."""
    blocks, classes, found = _classes(docs, n, gram, id_col, text_col, False)
    # every occurrence of a class but the first
    twice = classes.where("held > 1").select("h", "content", F.col("src.doc").alias("src_doc"), F.col("src.start").alias("src_start"))
    again = blocks.join(written(twice, "twice"), ["h", "content"]).where("doc > src_doc or doc = src_doc and start > src_start")
    ranges = again.select("doc", _unpacked()[0], "start", (F.col("start") + _unpacked()[1] + (n - 1)).cast("int").alias("end"))
    ranges = ranges.unionAll(found.where("kind = 0").select("doc", "text_key", "start", "end"))
    # windows that are first in their chunk, against the other chunks
    alive = found.where("kind = 1")
    least = alive.groupBy("one", "two").agg(F.count("*").alias("held"), F.min(F.struct("doc", "start")).alias("src")).where("held > 1").select("one", "two", "src")
    between = alive.join(written(least, "first-windows"), ["one", "two"]).where(F.struct("doc", "start") > F.col("src"))
    return ranges.unionAll(between.select("doc", "text_key", "start", "end"))


def maximal_repeats(docs: DataFrame, n: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat, doc_id, start, n_bytes): every occurrence of every maximal repeat of at least ``n`` bytes inside a block; ``repeat`` names the
    repeated bytes. A longer repeat is reported as the chain of its blocks' repeats, each shifted by some bytes."""
    blocks, classes, found = _classes(docs, n, gram, id_col, text_col, True)
    at = blocks.select("h", "content", "doc", "start", *_unpacked())
    # a class of its own: the block is the repeat
    alone = at.join(classes.where("held > 1").select("h", "content"), ["h", "content"])
    alone = alone.select(F.concat_ws("-", F.hex("h"), F.hex("content")).alias("repeat"), "doc", "start", (F.col("windows") + (n - 1)).alias("n_bytes"))
    # an occurrence in the first block of a class stands for one in every block of it
    first = classes.select("h", "content", "src.doc", F.col("src.start").alias("block"), F.col("src.at").bitwiseAND(F.lit(~_LOW)).alias("text_key"))
    inside = found.where("kind = 2").join(first, ["doc", "text_key", "block"])
    inside = inside.select("h", "content", F.concat_ws("-", F.hex("one"), F.hex("two")).alias("repeat"), (F.col("start") - F.col("block")).alias("shift"), (F.col("end") - F.col("start")).alias("n_bytes"))
    spread = at.select("h", "content", "doc", "start").join(inside, ["h", "content"]).select("repeat", "doc", (F.col("start") + F.col("shift")).alias("start"), "n_bytes")
    out = spread.unionAll(alone.select("repeat", "doc", "start", "n_bytes")).distinct()
    return out.select("repeat", F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "start", "n_bytes")


def _of_docs(wanted: Callable[[np.ndarray], np.ndarray]):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = wanted(b.column(0).to_numpy())
            if some.any():
                yield b.filter(pa.array(some))

    return make


def _sha(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def without_repeats(docs: DataFrame, n: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: [start, end, ...] of the removed bytes) of every row."""
    ranges = repeated_ranges(docs, n, gram, id_col, text_col).select("doc", "text_key", "start", "end")
    spans = written(ranges.repartition("doc", "text_key").sortWithinPartitions("doc", "text_key", "start").mapInArrow(_span_rows, SPANS), "spans")
    texts = keyed(docs, id_col, text_col)
    rows = texts.select("doc_id", "doc", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), _sha("text").alias("sha256"))
    marked = rows.join(spans, ["doc", "text_key"], "left")
    partly = written(marked.where("n_removed < n_bytes").select("doc", "text_key", "spans").dropDuplicates(["doc", "text_key"]), "partly")
    ids = partly.select("doc").distinct()
    some = texts.select("doc", "text_key", "text").mapInArrow(_of_docs(id_filter(ids, ids.count())), "doc long, text_key long, text string").dropDuplicates(["doc", "text_key"])
    kept = some.join(partly, ["doc", "text_key"]).select("doc", "text_key", "text", "spans").mapInArrow(_kept, "doc long, text_key long, kept_sha256 string")
    out = marked.join(kept, ["doc", "text_key"], "left")
    whole = F.when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(""), 256)).otherwise(F.col("sha256"))
    spans = F.coalesce("spans", F.array().cast("array<int>"))
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), (F.size(spans) / 2).cast("long").alias("n_spans"), F.coalesce("kept_sha256", whole).alias("kept_sha256"), spans.alias("spans"))
