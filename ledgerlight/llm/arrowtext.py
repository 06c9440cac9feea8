"""Vectorised text primitives over Arrow string buffers.

A column of texts is seen as one byte array with document offsets, so words,
hashes and windows of thousands of documents come from a few numpy passes.
Null texts count as empty.  Nothing here copies a text into a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; temporaries are a small multiple of it.
SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return fmix(U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def fmix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Rolling:
    """Hashes of arbitrary slices of a sequence from one prefix sum, modulo 2**64."""

    def __init__(self, seed: int):
        self.base = int(splitmix(1, seed)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.symbols = splitmix(256, seed + 1)
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if n >= len(self.up):
            n = max(n + 1, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                step = np.full(n, base, U64)
                step[0] = 1
                setattr(self, name, np.multiply.accumulate(step))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: uint8 symbols, or 64-bit names."""
        self._powers(len(values))
        out = np.zeros(len(values) + 1, U64)
        v = self.symbols[values] if values.dtype == np.uint8 else values
        np.cumsum(v * self.up[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(prefix))
        raw = (prefix[end] - prefix[start]) * self.down[start]
        return fmix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Two independent families: together 128 bits.
HASH_A, HASH_B = Rolling(0x5EED0001), Rolling(0x5EED0101)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) with about `most` bytes each; a longer text stands alone."""
    raw, offsets = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each text its first word (n + 1 numbers)."""
    solid = ~WHITE[raw]
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1]
    tail[:-1] &= ~solid[1:]
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    head[cut] = solid[cut]
    tail[cut - 1] = solid[cut - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(start, offsets)


def word_names(raw: np.ndarray, start: np.ndarray, end: np.ndarray, family: Rolling = HASH_A) -> np.ndarray:
    return family.slices(family.prefix(raw), start, end)


def owners(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(names: np.ndarray, first: np.ndarray, k: int, family: Rolling = HASH_A) -> tuple[np.ndarray, np.ndarray]:
    """Start word and name of every run of k words inside one text."""
    own = owners(first)
    at = np.flatnonzero(own[: len(own) - k + 1] == own[k - 1 :]) if len(own) >= k else np.zeros(0, np.int64)
    return at, family.slices(family.prefix(names), at, at + k)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] numbers, then those of start[1], and so on."""
    total = int(count.sum())
    shift = np.repeat(start - (np.cumsum(count) - count), count)
    return shift + np.arange(total)


def hex_digests(parts, make) -> list[str]:
    return [make(p).hexdigest() for p in parts]
