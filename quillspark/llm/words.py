"""Vectorised words and word hashes over Arrow text batches (used inside ``mapInArrow`` tasks).

A slice of a batch is looked at as one byte buffer: word borders come from a 256-entry byte class,
and word hashes from differences of a running polynomial sum modulo 2**64, so no Python object is
made for a word. Slices hold a few MB, whatever the batch size, which bounds a task's memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20
_BLOCK = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15 | 5)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection that spreads every input bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, byte after folding) for ``space`` (split at ASCII space and 0x09-0x0D, kept as is),
    ``space_lower`` (the same, A-Z folded) and ``alnum_lower`` (ASCII letters, digits and every non-ASCII byte, A-Z folded)."""
    b = np.arange(256)
    fold = b.copy()
    if kind != "space":
        fold[65:91] += 32
    if kind == "alnum_lower":
        word = (b >= 128) | ((fold >= 97) & (fold <= 122)) | ((b >= 48) & (b <= 57))
    else:
        word = (b != 32) & ((b < 9) | (b > 13))
    return word, fold.astype(np.uint8)


def _tables(kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte class, byte values, powers and inverse powers; made once for a batch."""
    word, fold = byte_class(kind)
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[fold]
    power = np.cumprod(np.full(_BLOCK, _R))
    inverse = np.cumprod(np.full(_BLOCK + 1, np.uint64(pow(int(_R), -1, 1 << 64))))
    return word, values, power, inverse


class Words:
    """Words of some documents: ``h`` hashes, ``start``/``end`` byte offsets, ``first`` (per document, the index of its first word; one more entry closes)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, tables: tuple):
        word, values, power, inverse = tables
        at = word[buf] if len(buf) else np.zeros(0, bool)
        cut = np.zeros(len(buf) + 1, bool)
        cut[offsets] = True
        before = np.empty(len(buf), bool)
        before[:1] = False
        before[1:] = at[:-1]
        self.start = np.flatnonzero(at & (~before | cut[:-1]))
        after = np.empty(len(buf), bool)
        after[-1:] = False
        after[:-1] = at[1:]
        self.end = np.flatnonzero(at & (~after | cut[1:])) + 1
        self.buf, self.offsets = buf, offsets
        self.first = np.searchsorted(self.start, offsets)
        self.h = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):  # blocks that begin with a word and hold whole words
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + _BLOCK, side="right")))
            hi = self.end[j - 1]
            if hi - lo > _BLOCK:  # a word longer than a block
                self.h[i] = self._long(values[buf[lo:hi]], power)
            else:
                run = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(values[buf[lo:hi]] * power[: hi - lo], out=run[1:])
                s, e = self.start[i:j] - lo, self.end[i:j] - lo
                self.h[i:j] = (run[e] - run[s]) * inverse[s]
            i = j
        self.h = mix(self.h + (self.end - self.start).astype(np.uint64))

    @staticmethod
    def _long(values: np.ndarray, power: np.ndarray) -> np.uint64:
        """The same polynomial for one long word, block by block."""
        total, scale = 0, 1
        for k in range(0, len(values), _BLOCK):
            part = values[k : k + _BLOCK]
            total = (total + scale * int((part * power[: len(part)]).sum(dtype=np.uint64))) & _MASK
            scale = scale * pow(int(_R), _BLOCK, 1 << 64) & _MASK
        return np.uint64(total * pow(int(_R), -1, 1 << 64) & _MASK)

    def __len__(self) -> int:
        return len(self.first) - 1

    def windows(self, n: int, salt: int = 0, base: np.uint64 = _R) -> np.ndarray:
        """Hash of the n words from each word on (meaningless for the last n-1 words of a document); another base is another hash."""
        m = max(0, len(self.h) - n + 1)
        out = np.full(m, np.uint64(n * 2 + 1 + (salt << 8)))
        for k in range(n):
            out = out * base + self.h[k : k + m]
        return mix(out)

    def joined(self, lo: int, hi: int) -> bytes:
        """Words lo..hi-1 with one space between them (bytes as they stand)."""
        raw = self.buf.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        return b" ".join(raw[s:e] for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist()))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``limit`` bytes, at least one row each."""
    buf, off = text_buffer(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    release()


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, and what they keep counts for the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def batch_words(column: pa.Array, kind: str) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, their words) slice by slice."""
    tables = _tables(kind)
    for i, j, buf, off in text_slices(column):
        yield i, j, Words(buf, off, tables)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and one length for each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
