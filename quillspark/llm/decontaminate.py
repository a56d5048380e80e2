"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark windows.

Texts are normalised to lower-case words (ASCII letters and digits, and all other non-ASCII characters)
with one space between; the patterns are the windows of ``n`` consecutive words of each item, with a space on either
side, so that a match is a run of whole words. One scan of a text by the automaton finds all of them, and word
numbers lead back to code-point offsets in the original text.

Null and word-less texts have no words and no hits; an item without words has no window; an item shorter than a
window is one window. Repeated items count each for itself; an item's null id is left out of the list of ids. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import written
from quillspark.llm.words import batch_words

#: Words in a window; bytes of benchmark text in one automaton. A larger benchmark is cut into several, each scanned for.
WINDOW, AUTOMATON_BYTES = 10, 16 << 20

FOUND = "doc_id long, n_words long, hits array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def patterns(items: list[tuple[str | None, str | None]], n: int) -> dict[str, tuple[int, list[str]]]:
    """Pattern -> (its number of words, ids of the items that hold it)."""
    out: dict[str, tuple[int, set]] = {}
    column = pa.array([t for _, t in items], pa.string())
    for i, _, w in batch_words(column, "alnum_lower"):
        for k in range(len(w)):
            lo, hi = int(w.first[k]), int(w.first[k + 1])
            for s in range(lo, max(lo + 1, hi - n + 1)) if hi > lo else ():
                e = min(hi, s + n)
                key = " " + w.joined(s, e).lower().decode() + " "
                out.setdefault(key, (e - s, set()))[1].add(items[i + k][0])
    return {p: (m, sorted(x for x in ids if x is not None)) for p, (m, ids) in out.items()}


def _automaton(table: dict[str, tuple[int, list[str]]]):
    auto = ahocorasick.Automaton()
    for p, value in table.items():
        auto.add_word(p, value)
    auto.make_automaton()
    return auto


def _scan(auto, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND for a batch of texts."""
    for i, j, w in batch_words(texts, "alnum_lower"):
        hits, items, spans = [], [], []
        for k in range(len(w)):
            lo, hi = int(w.first[k]), int(w.first[k + 1])
            found = _hits(auto, w, lo, hi) if hi > lo and len(auto) else None
            words, own = found or (np.zeros(0, int), ())
            hits.append(words.tolist())
            items.append(sorted(own))
            spans.append(_spans(w, k, lo, words) if found else [])
        yield pa.RecordBatch.from_arrays(
            [ids[i:j], pa.array(np.diff(w.first), pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            ["doc_id", "n_words", "hits", "items", "spans"],
        )


def _scanner(table: dict[str, tuple[int, list[str]]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(table)
        for b in batches:
            yield from _scan(auto, b.column(0), b.column(1))

    return scan


def _hits(auto, w, lo: int, hi: int):
    """(numbers of the words that are hit, items found) in one document; None if there are none."""
    text = " " + w.joined(lo, hi).lower().decode() + " "
    found = list(auto.iter(text))
    if not found:
        return None
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    last = np.searchsorted(spaces, [at for at, _ in found])  # the space after word k is number k + 1
    mark = np.zeros(hi - lo + 1, np.int32)
    size = np.array([m for _, (m, _) in found])
    np.add.at(mark, last - size, 1)
    np.add.at(mark, last, -1)
    return np.flatnonzero(np.cumsum(mark)[:-1]), {x for _, (_, ids) in found for x in ids}


def _spans(w, k: int, lo: int, words: np.ndarray) -> list[dict]:
    """Runs of hit words as code-point offsets of the document."""
    base = int(w.offsets[k])
    first = words[np.concatenate([[True], np.diff(words) > 1])]
    last = words[np.concatenate([np.diff(words) > 1, [True]])]
    starts = np.concatenate([[0], np.cumsum((w.buf[base : int(w.offsets[k + 1])] & 0xC0) != 0x80)])
    return [{"start": int(starts[w.start[lo + a] - base]), "end": int(starts[w.end[lo + z] - base])} for a, z in zip(first, last)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits: numbers of the hit words, items: ids found, spans: code-point offsets) for every row.

    The automaton is bounded by ``AUTOMATON_BYTES`` of benchmark text; the items of a larger benchmark are dealt to several
    automata by size, and the results are put together row by row.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + total // AUTOMATON_BYTES
    if shards == 1:
        return rows.mapInArrow(_scanner(patterns([tuple(r) for r in items.collect()], n)), FOUND)
    rows = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for k in range(int(shards)):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k)
        part = rows.mapInArrow(_scanner(patterns([tuple(r) for r in own.toLocalIterator()], n)), FOUND)
        found = part if found is None else found.unionAll(part)
    lists = (F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items"))
    parts = F.collect_list(F.when(F.size("hits") > 0, F.struct("hits", "spans"))).alias("parts")
    merged = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), *lists, parts)
    merged = merged.mapInArrow(_merged, FOUND)
    ids = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).cast("long").alias("id"))
    return merged.join(ids, F.col("__row") == F.col("doc_id")).select(F.col("id").alias("doc_id"), "n_words", "hits", "items", "spans")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND whose spans are the runs of all hit words: pieces of several automata that touch or overlap become one."""
    for b in batches:
        spans = []
        for parts in b.column(4).to_pylist():
            pieces, out = [], []
            for x in parts:
                words = np.array(x["hits"])
                first = words[np.concatenate([[True], np.diff(words) > 1])]
                last = words[np.concatenate([np.diff(words) > 1, [True]])]
                pieces += [(int(p), int(q), s["start"], s["end"]) for p, q, s in zip(first, last, x["spans"])]
            until = None
            for p, q, start, end in sorted(pieces):
                if until is not None and p <= until + 1:
                    out[-1]["end"] = max(out[-1]["end"], end)
                    until = max(until, q)
                else:
                    out.append({"start": start, "end": end})
                    until = q
            spans.append(out)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(spans, kind)], ["doc_id", "n_words", "hits", "items", "spans"])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window, whatever their ids; the scan runs beside the rows, so no text is shuffled.

    Above ``AUTOMATON_BYTES`` the rows pass one automaton after the other; what is left is written in between, so that a task holds
    one automaton at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + total // AUTOMATON_BYTES

    def clean(table: dict[str, tuple[int, list[str]]]):
        @F.arrow_udf("boolean")
        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            auto = _automaton(table)
            for text in texts:
                found = _scan(auto, pa.nulls(len(text), pa.int64()), text)
                yield pa.array(np.concatenate([np.zeros(0, int), *(x.column(2).value_lengths().to_numpy() for x in found)]) == 0)

        return run

    out = docs
    for k in range(int(shards)):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k)
        out = out.where(clean(patterns([tuple(r) for r in own.toLocalIterator()], n))(text_col))
        if k + 1 < shards:
            out = written(out, "clean")
    return out
