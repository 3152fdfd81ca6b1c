"""Vectorised word scanning and hashing over the buffers of an Arrow string column.

No Python object is made per word: words are byte ranges of the column's data buffer and
their 64-bit hashes come from one running polynomial sum (mod 2**64, odd base, so that the
sum up to any start can be divided out) and a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _members(separators: set[int]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Bytes of words between white space (space, \t \n \v \f \r).
NOT_SPACE = _members({0x20, *range(0x09, 0x0E)})
#: Bytes of words made of digits, lower-case letters and all that is not ASCII.
ALNUM = _members({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        got = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, CHUNK_BYTES) + 1, base, dtype=U64)
            p[0] = 1
            got.append(np.multiply.accumulate(p))
        if n > 2 * CHUNK_BYTES:  # too large to be kept
            return got[0], got[1]
        _powers = (got[0], got[1])
    return _powers


@dataclass
class Words:
    """Words of a chunk: starts, ends are byte places in data; word i of text d is first[d] <= i < first[d + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their parts before `ends`."""
        if not len(self.starts):
            return np.zeros(0, U64)
        n = len(self.data)
        power, inverse = _power(n)
        total = np.empty(n + 1, U64)
        total[0] = 0
        own = total[1:]
        np.add(self.data, U64(1), out=own, dtype=U64)
        own *= power[:n]
        np.cumsum(own, out=own)
        return mix((total[self.ends if ends is None else ends] - total[self.starts]) * inverse[self.starts])


def scan(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: np.ndarray = LOWER) -> Words:
    """Words (longest runs of member bytes that stay within a text) of texts offsets[d] to offsets[d + 1] of data."""
    raw = data.tobytes().translate(lower.tobytes())  # some five times faster than looking up by index
    b, m = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(member.tobytes()), bool)
    st, en = m.copy(), m.copy()
    if len(m):
        st[1:] &= ~m[:-1]
        en[:-1] &= ~m[1:]
        full = offsets[1:] > offsets[:-1]
        s, e = offsets[:-1][full], offsets[1:][full] - 1
        st[s] = m[s]
        en[e] = m[e]
    starts = np.flatnonzero(st)
    return Words(b, starts, np.flatnonzero(en) + 1, np.searchsorted(starts, offsets))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and offsets (int64, from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, raw = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES, most: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, end row, data, offsets) of about `size` bytes and `most` rows at most, of whole texts."""
    data, off = buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = min(n, i + most, max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
