"""Vectorised helpers that run inside Spark tasks: words and hashes of one Arrow batch.

Everything works on whole texts.  A batch is cut into chunks at document
boundaries only to keep the temporary arrays small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E6C63D0876A9A47)  # odd, so that it has an inverse modulo 2**64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept by the worker."""

    forward = np.ones(1, _U)
    backward = np.ones(1, _U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.forward) < n:
            size = 1 << int(n - 1).bit_length()
            for name, base in (("forward", _BASE), ("backward", _INVERSE)):
                powers = np.full(size, base, _U)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers))
        return cls.forward, cls.backward


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(rows, max(row + 1, end))
        yield row, end
        row = end


def byte_table(separators: bytes) -> np.ndarray:
    """For each byte its value with A-Z in lower case, plus one; 0 marks a separator."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words of shingles: everything but space and tab to carriage return.
SPACES = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of letters and digits; all other ASCII separates.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows of a chunk, and each row's offset into them."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    codes = table[data]
    inside = codes != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _byte_hashes((codes - 1).astype(np.uint8), starts, ends - starts), np.searchsorted(starts, offsets)


def _byte_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, eight at a time; long words get a cryptographic one."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # at each byte it and the next seven
    out = mix(sizes.astype(_U) + _U(0x9E3779B97F4A7C15))
    left, at = sizes, np.arange(len(sizes))
    for lane in range(LONG_WORD // 8):
        part = eight[starts[at] + 8 * lane] & _FIRST_BYTES[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ part) * _U(0xD6E8FEB86659FD93) + _U(lane + 1))
        more = left > 8
        at, left = at[more], left[more] - 8
        if not len(at):
            return out
    for k in at.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : starts[k] + sizes[k]], digest_size=8).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of n consecutive words, across row borders too."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    out = np.full(count, _U(n + seed), _U)
    for k, m in enumerate(_multipliers(n, seed)):
        out += words[k : k + count] * m
    return mix(out)


def masked_hashes(words: np.ndarray, mask: str, seed: int) -> np.ndarray:
    """As gram_hashes, over the positions of the mask that hold a 1."""
    count = len(words) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, _U)
    out = np.full(count, _U(seed), _U)
    for k, m in enumerate(_multipliers(len(mask), seed)):
        if mask[k] == "1":
            out += words[k : k + count] * m
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Row by row the sorted distinct hashes of its n-word shingles.

    A row with fewer words has one shingle of all its words, one without words none.
    """
    words, at = word_hashes(data, offsets, SPACES)
    grams = gram_hashes(words, n)
    for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if end - start >= n:
            yield np.unique(grams[start : end - n + 1])
        elif end > start:
            yield gram_hashes(words[start:end], end - start)
        else:
            yield np.zeros(0, _U)
