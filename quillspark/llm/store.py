"""Small shared parts: written tables, sums of vectors over partitions, id filters of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.words import mix
from quillspark.session import scratch_path

#: Largest id filter (bits); 16 MB, whatever the data.
MAX_FILTER_BITS = 27


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors. ``codec``: zstd for whole texts."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def partials(vector: np.ndarray, block: int) -> pa.RecordBatch:
    """A vector as rows (block, values); each block in the narrowest type that holds it."""
    blocks, parts = [], []
    for i in range(0, len(vector), block):
        part = vector[i : i + block]
        if part.any():
            if part.dtype.kind in "iu":
                part = part.astype(np.min_scalar_type(int(part.max())))
            blocks.append(i // block)
            parts.append(part.dtype.char.encode() + part.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())], ["block", "part"])


def _decode(part: bytes) -> np.ndarray:
    return np.frombuffer(part[1:], np.dtype(part[:1].decode()))


PARTIALS = "block int, part binary"


def summed(df: DataFrame, length: int, block: int, dtype, bits: bool = False, parts: int = 32) -> np.ndarray:
    """Sum (with ``bits``: bitwise or) of the partial vectors of ``df`` (rows of ``partials``): blocks are dealt out, each task
    adds up what comes in, row by row, and the driver gets one vector of the given fixed length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = _decode(part)
                if k not in sums:
                    sums[k] = np.zeros(len(v), dtype)
                if bits:
                    sums[k] |= v
                else:
                    sums[k] += v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "part"])

    out = np.zeros(length, dtype)
    for k, part in df.repartition(parts, "block").mapInArrow(add, PARTIALS).toLocalIterator():
        v = np.frombuffer(bytes(part), dtype)
        out[k * block : k * block + len(v)] = v
    return out


def _slots(ids: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return [((h + np.uint64(k) * (h >> np.uint64(32) | np.uint64(1))) & mask).astype(np.int64) for k in range(3)]


def id_filter(ids: DataFrame, expected: int) -> Callable[[np.ndarray], np.ndarray]:
    """Bloom filter over a table of long ids (one column): ids -> may be in it. Of bounded size; when it is too full it lets
    more rows through, so an exact semi-join must follow, and it only saves work."""
    bits = min(MAX_FILTER_BITS, max(16, int(np.ceil(np.log2(max(1, expected) * 12)))))
    mask, block = np.uint64((1 << bits) - 1), 1 << 13

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            for s in _slots(b.column(0).to_numpy(zero_copy_only=False), mask):
                np.bitwise_or.at(seen, s >> 3, (128 >> (s & 7)).astype(np.uint8))
        yield partials(seen, block)

    packed = summed(ids.mapInArrow(fill, PARTIALS), 1 << (bits - 3), block, np.uint8, bits=True) if expected else np.zeros(1 << (bits - 3), np.uint8)
    return _Filter(packed, bits)


class _Filter:
    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        hit = np.ones(len(ids), bool)
        for s in _slots(ids, np.uint64((1 << self.bits) - 1)):
            hit &= (self.packed[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1).astype(bool)
        return hit


def crc_part(column: str, n: int):
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n
