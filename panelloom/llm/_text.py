"""Vectorised word, line and shingle hashing over Arrow string batches (numpy inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Fixed value: ASCII bytes between words, the complement of [^\x20\x09-\x0D].
SEPARATORS = (9, 10, 11, 12, 13, 32)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(SEPARATORS)] = True

_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER_VALUE = np.random.default_rng(20250611).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; kept per worker process."""
    global _powers
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        out = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash of values[start:end] for each span; it depends on the content and the length alone."""
    powers, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:], dtype=np.uint64)
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ..., size - 1 for each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class TextBlock:
    """Some consecutive texts as one byte array; null texts have no bytes."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def words(self, separator: np.ndarray = IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, byte ends and row numbers of the words, in order; separator: whether a byte value parts words."""
        data, offsets = self.data, self.offsets
        inside = np.zeros(len(data) + 2, dtype=bool)
        np.logical_not(separator[data], out=inside[1:-1])
        begin = inside[1:-1] & ~inside[:-2]
        finish = inside[1:-1] & ~inside[2:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begin[cuts] = inside[1:-1][cuts]
        finish[cuts - 1] = inside[1:-1][cuts - 1]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(finish) + 1, self.row_of(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the \\n-split lines of non-empty texts."""
        breaks = np.flatnonzero(self.data == 10)
        full = self.offsets[1:] > self.offsets[:-1]
        starts = np.sort(np.concatenate([breaks + 1, self.offsets[:-1][full]]))
        ends = np.sort(np.concatenate([breaks, self.offsets[1:][full]]))
        rows = np.concatenate([self.row_of(breaks), np.flatnonzero(full)])
        return starts, ends, np.sort(rows)

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def byte_values(self) -> np.ndarray:
        return _BYTE_VALUE[self.data]

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(self.byte_values(), starts, ends)

    def second_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words that do not depend on word_hashes; the work follows the bytes of the given words."""
        sizes = ends - starts
        upto = np.cumsum(sizes)
        return span_hashes(_OTHER_VALUE[self.data[np.repeat(starts, sizes) + ranges(sizes)]], upto - sizes, upto)


def shingle_hashes(word_hash: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside one row, and the index of each first word."""
    if len(word_hash) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[k - 1 :] == rows[: len(rows) - k + 1])
    return span_hashes(word_hash, first, first + k), first


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[TextBlock]:
    """Cuts a batch into blocks of whole texts of about `limit` bytes, so that arrays stay small."""
    array = batch.column(batch.schema.get_field_index(column))
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[array.offset : array.offset + n + 1].astype(np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        yield TextBlock(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), 0)
        return
    data = np.frombuffer(buffers[2], dtype=np.uint8)
    if array.null_count:
        present = np.asarray(array.is_valid())
        if (np.diff(offsets)[~present] > 0).any():
            array = array.fill_null("")
            yield from text_blocks(pa.record_batch([array], names=[column]), column, limit)
            return
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield TextBlock(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], low)
        low = high
