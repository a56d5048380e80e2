"""Exact dedup by content-defined chunk recipes.

A text without its white space is cut where a rolling hash of its bytes says so; a chunk is known by a
64-bit fingerprint, which counts as an identifier once it is verified that all chunks with it have the same
128-bit digest (a fingerprint shared by different chunks is lengthened by the digest). Documents are equal
when their ordered identifier lists are. Texts are read once and never shuffled.

Null texts count as empty; empty and white-space-only texts are equal to one another. Of repeated rows
(same id and text) one stays. A null id loses ties. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.store import unused, written
from quillspark.llm.words import byte_class, mix, text_slices

#: Bytes that the cut decision looks at, and one cut in so many positions.
CUT_WINDOW, CUT_EVERY = 16, 1024
_SPACE = ~byte_class("space")[0]
_GEAR = (mix(np.arange(7, 263, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

RECIPE = "row long, doc_id long, n_chars long, text_sha256 string, fps array<long>, checks array<binary>"


def cut_points(norm: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks in a buffer of documents: content-defined cuts and the documents' ends."""
    h = np.zeros(len(norm), np.uint32)
    gear = _GEAR[norm]
    for k in range(CUT_WINDOW):
        h[k:] += gear[: len(norm) - k] << np.uint32(2 * k)
    cut = (h >> np.uint32(32 - CUT_EVERY.bit_length() + 1)) == 0
    cut[1:] &= ~cut[:-1]  # a constant run makes one cut, not one for each byte
    at = np.flatnonzero(cut)
    inside = at - offsets[np.searchsorted(offsets, at, side="right") - 1] >= CUT_WINDOW
    return np.unique(np.concatenate([at[inside] + 1, offsets[1:]]))


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, buf, off in text_slices(b.column(2), 4 << 20):
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
            keep = ~_SPACE[buf]
            norm, at = buf[keep], np.concatenate([[0], np.cumsum(keep)])[off]
            ends, raw = cut_points(norm, at), norm.tobytes()
            shas, fps, checks = [], [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                shas.append(hashlib.sha256(raw[s:e]).hexdigest())
                own = ends[np.searchsorted(ends, s, side="right") : np.searchsorted(ends, e, side="right")].tolist()
                digests = [hashlib.blake2b(raw[x:y], digest_size=24).digest() for x, y in zip([s, *own], own)]
                fps.append([int.from_bytes(d[:8], "little", signed=True) for d in digests])
                checks.append([d[8:] for d in digests])
            yield pa.RecordBatch.from_arrays(
                [b.column(0)[i:j], b.column(1)[i:j], pa.array(np.diff(chars), pa.int64()), pa.array(shas, pa.string()), pa.array(fps, pa.list_(pa.int64())), pa.array(checks, pa.list_(pa.binary()))],
                ["row", "doc_id", "n_chars", "text_sha256", "fps", "checks"],
            )


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row`` (a number of its own), id, code points of the text, digest, chunk fingerprints and digests."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_recipes, RECIPE), "recipes")


def with_identifiers(r: DataFrame) -> DataFrame:
    """``recipe``: the ordered list of verified chunk identifiers of each row."""
    chunks = r.select(F.explode(F.arrays_zip("fps", "checks")).alias("c")).select("c.fps", "c.checks")
    shared = chunks.groupBy("fps").agg(F.min("checks").alias("lo"), F.max("checks").alias("hi")).where("lo <> hi").select("fps")
    shared = written(shared, "ambiguous")
    if shared.isEmpty():
        return r.withColumn("recipe", F.col("fps"))
    parts = r.select("row", F.posexplode(F.arrays_zip("fps", "checks")).alias("pos", "c")).select("row", "pos", "c.fps", "c.checks")
    marked = parts.join(shared.withColumn("dup", F.lit(True)), "fps", "left")
    name = F.concat(F.hex("fps"), F.when(F.col("dup"), F.concat(F.lit("-"), F.hex("checks"))).otherwise(F.lit("")))
    lists = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("name")))).alias("l")).select("row", F.col("l.name").alias("recipe"))
    return r.join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<string>")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chars) for every row. Of equal texts the one with the most code
    points stays, then the smallest id, then one of the repeated rows."""
    r = with_identifiers(recipes(docs, id_col, text_col))
    key = F.xxhash64("recipe").alias("key")
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg"), (-F.col("row")).alias("negrow")))
    groups = r.groupBy(key, "recipe").agg(F.count("*").alias("size"), best.alias("best")).where("size > 1")
    groups = groups.select(F.col("key").alias("gkey"), F.col("recipe").alias("grecipe"), "size", F.col("best.neg").alias("neg"), F.col("best.negrow").alias("negrow"))
    groups = written(groups, "groups")  # a plain table on this side lets Spark split a large group's rows
    rows = r.select("row", "doc_id", "n_chars", "text_sha256", "recipe", key)
    joined = rows.join(groups, (F.col("key") == F.col("gkey")) & (F.col("recipe") == F.col("grecipe")), "left")
    keep_id, keep_row = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(-F.col("neg")), F.coalesce(-F.col("negrow"), F.col("row"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (F.col("row") == keep_row).alias("kept"), "text_sha256", "n_chars")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged."""
    own, n, known, sha = (unused(c, docs.columns) for c in ("__own", "__n", "__id", "__sha"))
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(known), F.col("text_sha256").alias(sha))
    norm = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]", ""), 256)
    both = docs.withColumn(own, norm).join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(known)) & (F.col(own) == F.col(sha)))
    order = Window.partitionBy(known, sha).orderBy(F.length(text_col).desc(), F.col(text_col))
    return both.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(*docs.columns)
