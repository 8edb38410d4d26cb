"""Words and word hashes of Arrow text columns, computed for a batch at a time with numpy.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. All arithmetic on hashes is
modulo 2**64. Memory follows the slice in work: at most ``SLICE_BYTES`` of text or one document.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHORT = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def release() -> None:
    """Gives free memory back to the system: workers live on, and what a stage held would count against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about ``size`` bytes of text."""
    if not batch.num_rows:
        return
    part = np.cumsum(np.diff(offsets(batch.column(text))[0])) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
        yield batch.slice(int(lo), int(hi - lo))
    release()


def offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return raw - raw[0], data[raw[0] : raw[-1]]


class Words:
    """Words of a binary column: ``starts`` and ``ends`` are byte positions in ``data``; row r owns words first[r] to first[r + 1]."""

    def __init__(self, column: pa.Array, lower: bool = False):
        rows, data = offsets(column)
        self.data = np.ascontiguousarray(_LOWER[data] if lower else data)
        word = ~_SPACE[self.data]
        before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = rows[(rows > 0) & (rows < len(word))]
        before[inner], after[inner - 1] = False, False
        self.starts, self.ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, rows)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal bytes wherever they occur."""
        size = self.ends - self.starts
        h = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        todo = np.flatnonzero(size <= _SHORT)
        for at in range(0, _SHORT, 8):
            todo = todo[size[todo] > at]
            if not len(todo):
                break
            chunk = eight[self.starts[todo] + at] & _KEEP[np.minimum(size[todo] - at, 8)]
            h[todo] = mix((h[todo] ^ chunk) * np.uint64(_BASE))
        for k in np.flatnonzero(size > _SHORT):
            h[k] = int.from_bytes(hashlib.blake2b(self.data[self.starts[k] : self.ends[k]].tobytes(), digest_size=8).digest(), "little")
        return h


class Rolling:
    """Hashes of any run of consecutive words from one pass of prefix sums."""

    def __init__(self, h: np.ndarray):
        n = len(h) + 1
        power = np.full(n, _BASE, np.uint64)
        power[0] = 1
        self.back = np.full(n, _INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(h * power[:-1], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the words from lo up to hi, position by position."""
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
