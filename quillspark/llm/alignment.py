"""Cross-tokenizer alignment of two public tokenizers, each distinct text once.

1. Texts are shuffled by the full text and grouped: one row for each distinct text, with the number of rows that hold it.
2. A task takes the distinct texts in slices of a few MB. Each is encoded by both tokenizers as a space and the text; the cumulative
   byte lengths of the two token lists are merged. Every stretch between two neighbouring ends of either list is one link (one token of
   each), and offsets where both lists end cut the tokens into groups. A slice becomes one row: the measures of its texts, its distinct
   id pairs with their link counts weighted by multiplicity, and its texts' links as places in that list of pairs.
3. Pair counts are summed over the corpus; the highest count of every id of the second tokenizer is found (one row per vocabulary entry).
4. The counts of a slice's pairs go back to the slice (a slice's own distinct pairs, not its links), which makes the measures that
   depend on them. Measures join the documents by the digest of the text.

The byte-level tokenizer's vocabulary and merge order come from its file; it is run by the byte-pair encoder of ``tiktoken``, which gives the same ids
as the file's own library. Special tokens are never made: their strings are plain text.

Null and empty texts, and texts whose tokens of either side do not join to a space and the text, have no tokens: zeros, and an empty
``groups_sha256``. Repeated rows and null ids get the measures of their text. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import written
from quillspark.llm.words import text_slices

#: Folder of the public vocabulary files, and the two used; text bytes of a slice.
VOCABULARIES = os.environ.get("QUILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE, PIECE_BPE, SLICE = "byte_bpe_50k.json", "piece_bpe_32k.model", 4 << 20
#: How the byte-level file splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SLICES = "slice long, digests array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, pairs array<long>, weights array<long>, places binary, counts binary, sizes array<int>"
MEASURES = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE file; ``token`` has the bytes of every id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"] if t["special"]}
        byte = byte_alphabet()
        vocab = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if i not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"]["".join(m)] for m in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the merge order")
        self.token = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for raw, i in vocab.items():
            self.token[i] = raw
        self._encode = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        return self._encode(" " + text)


class PieceBpe:
    """A sentencepiece file that puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.token = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


_LOADED: dict[str, tuple] = {}


def tokenizers(folder: str) -> tuple[ByteBpe, PieceBpe]:
    """Both tokenizers, loaded once by each worker."""
    if folder not in _LOADED:
        _LOADED[folder] = (ByteBpe(f"{folder}/{BYTE_BPE}"), PieceBpe(f"{folder}/{PIECE_BPE}"))
    return _LOADED[folder]


class Aligner:
    """Aligns texts; ids of the two sides make pairs ``a * n_b + b``."""

    def __init__(self, a, b):
        self.a, self.b, self.n_b = a, b, len(b.token)
        self.length_a, self.length_b = (np.array([len(x) for x in t.token], np.int64) for t in (a, b))
        self.text = [[b"%d%s" % (i, end) for t in (a, b) for i in range(len(t.token))] for end in (b",", b"|", b";", b"")]

    def align(self, text: str) -> tuple[int, int, int, np.ndarray, str] | None:
        """(tokens of A, of B, groups, linked pairs in order, digest of the groups); None without tokens."""
        whole = b" " + text.encode()
        ids = self.a.encode(text), self.b.encode(text)
        if any(b"".join(map(t.token.__getitem__, x)) != whole for t, x in zip((self.a, self.b), ids)):
            return None
        a, b = np.array(ids[0], np.int64), np.array(ids[1], np.int64)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.union1d(end_a, end_b)
        pairs = a[np.searchsorted(end_a, ends)] * self.n_b + b[np.searchsorted(end_b, ends)]
        closes_a, closes_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        # tokens of each group: A's, then B's; what follows an id depends on whether it closes its side
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        per_a, per_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        at_a = np.arange(len(a)) + np.where(group_a > 0, per_b[group_a - 1], 0)
        at_b = np.arange(len(b)) + per_a[group_b]
        code, kind = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int8)
        code[at_a], kind[at_a] = a, closes_a
        code[at_b], kind[at_b] = b + len(self.length_a), 2 * closes_b
        kind[-1] = 3
        parts = np.empty(len(code), object)
        for k, table in enumerate(self._tables()):
            mine = kind == k
            parts[mine] = table[code[mine]]
        return len(a), len(b), int(closes_a.sum()), pairs, hashlib.sha256(b"".join(parts.tolist())).hexdigest()

    def _tables(self) -> list[np.ndarray]:
        if not hasattr(self, "_objects"):
            self._objects = []
            for t in self.text:
                x = np.empty(len(t), object)
                x[:] = t
                self._objects.append(x)
        return self._objects


def _slices(folder: str):
    """Distinct texts (text, n) to one row a slice."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*tokenizers(folder))
        held: list[tuple[str, int]] = []
        size = 0
        for b in batches:
            for i, j, _, off in text_slices(b.column(0), SLICE):
                held += zip(b.column(0)[i:j].to_pylist(), b.column(1)[i:j].to_pylist())
                size += int(off[-1])
                if size >= SLICE:
                    yield _row(aligner, held)
                    held, size = [], 0
        if held:
            yield _row(aligner, held)

    return make


def _row(aligner: Aligner, texts: list[tuple[str, int]]) -> pa.RecordBatch:
    digests, measures, shas, own, sizes, weights = [], [], [], [], [], []
    for text, n in texts:
        found = aligner.align(text)
        digests.append(hashlib.sha256(text.encode()).digest())
        n_a, n_b, n_groups, pairs, sha = found or (0, 0, 0, np.zeros(0, np.int64), "")
        distinct, counts = np.unique(pairs, return_counts=True)
        measures.append((n_a, n_b, n_groups, len(pairs)))
        shas.append(sha)
        own.append((distinct, counts))
        sizes.append(len(distinct))
        weights.append(counts * n)
    every = np.concatenate([d for d, _ in own])
    names, places = np.unique(every, return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, places, np.concatenate(weights))
    counts = np.concatenate([c for _, c in own]).astype(np.int32)
    n_a, n_b, n_groups, n_links = zip(*measures)
    first = int.from_bytes(hashlib.blake2b(b"".join(digests), digest_size=8).digest(), "little", signed=True)
    lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (n_a, n_b, n_groups, n_links)]
    return pa.RecordBatch.from_arrays(
        [pa.array([first]), pa.array([digests], pa.list_(pa.binary())), *lists, pa.array([shas], pa.list_(pa.string())), pa.array([names.tolist()], pa.list_(pa.int64())), pa.array([total.tolist()], pa.list_(pa.int64())),
         pa.array([zlib.compress(places.astype(np.int32).tobytes(), 1)], pa.binary()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary()), pa.array([sizes], pa.list_(pa.int32()))],
        ["slice", "digests", "n_a", "n_b", "n_groups", "n_links", "shas", "pairs", "weights", "places", "counts", "sizes"],
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with the counts of their pairs (by place) to one row a text."""
    for b in batches:
        for x in b.to_pylist():
            # pos in a slice: counts arrive in order of place
            known = np.array([c["count"] for c in x["known"]], np.int64)
            top = np.array([c["best"] for c in x["known"]], bool)
            places, counts = (np.frombuffer(zlib.decompress(x[c]), np.int32) for c in ("places", "counts"))
            owner = np.repeat(np.arange(len(x["sizes"])), x["sizes"])
            n_best, total = np.zeros(len(x["sizes"]), np.int64), np.zeros(len(x["sizes"]), np.int64)
            if len(places):
                np.add.at(n_best, owner, counts * top[places])
                np.add.at(total, owner, counts * known[places])
            lists = [pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([pa.array(x["digests"], pa.binary()), *lists, pa.array(n_best), pa.array(total), pa.array(x["shas"], pa.string())], ["digest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def aligned_slices(docs: DataFrame, text_col: str = "text", folder: str = VOCABULARIES) -> DataFrame:
    """Every distinct text encoded and aligned once (schema ``SLICES``)."""
    texts = docs.where(F.octet_length(text_col) > 0).groupBy(F.col(text_col).alias("text")).agg(F.count("*").alias("n"))
    return written(texts.mapInArrow(_slices(folder), SLICES), "aligned")


def pair_counts(slices: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, b, count, best): links of each id pair over all rows of the corpus; ``best``: no pair of the same b has more."""
    held = slices.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("count"))
    counts = written(counts.select("pair", F.expr(f"pair div {n_b}").alias("a"), (F.col("pair") % n_b).alias("b"), "count"), "pair-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))  # at most one row for each vocabulary entry
    return counts.join(top, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def cross_tokenizer_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    slices = aligned_slices(docs, text_col, folder)
    counts = pair_counts(slices, len(tokenizers(folder)[1].token)).select("pair", "count", "best")
    asked = slices.select("slice", F.posexplode("pairs").alias("pos", "pair"))
    known = asked.join(counts, "pair").groupBy("slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "count", "best"))), lambda x: F.struct(x["count"].alias("count"), x["best"].alias("best"))).alias("known"))
    per_slice = slices.drop("pairs", "weights").join(known, "slice", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<count:long,best:boolean>>")))
    measures = written(per_slice.mapInArrow(_measured, MEASURES), "measures")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)).alias("digest"))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.join(measures, "digest", "left").select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
