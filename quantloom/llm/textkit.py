"""Vectorised word splitting and hashing on Arrow text columns.

A column's UTF-8 bytes are handled as one numpy array, so that no Python
object is made for a word.  All functions treat null texts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_BASE = 0xD1342543DE82EF95
#: Another base, for a second hash where 64 bits are not enough.
OTHER_BASE = 0x2545F4914F6CDD1D
_WORD_BASE = 0xAF251AF3B0F025B5
_MASK = (1 << 64) - 1


def byte_class(separators: bytes) -> np.ndarray:
    """A table of 256 flags: True for bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words of `[^\x20\x09-\x0D]+`.
SPACE_WORDS = byte_class(b" \t\n\x0b\x0c\r")
#: Words of letters, digits and all beyond ASCII, for lower-cased text.
ALNUM_WORDS = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        full[0] = 1
        have = _powers[base] = np.multiply.accumulate(full)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most max_bytes of text; a longer text stands alone."""
    sizes = np.nan_to_num(pa.compute.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, end to end, and each row's offsets."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """The words of a slice of texts: byte spans, hashes, first word of each row."""

    def __init__(self, column: pa.Array, word_bytes: np.ndarray, lower: bool):
        data, self.offsets = utf8(column)
        self._by_base: dict[int, np.ndarray] = {}
        self.data = data = (LOWER if lower else SAME)[data]
        n = len(data)
        inside = word_bytes[data]
        first = np.zeros(n + 1, dtype=bool)
        first[self.offsets] = True
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        begins = inside & (~before[:n] | first[:n])
        ends = before[1:] & np.append(~inside[1:] | first[1:n], True)[:n] if n else inside
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.rows = np.searchsorted(self.starts, self.offsets)  # row i has words rows[i]:rows[i+1]

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def _sums(self, base: int) -> np.ndarray:
        if base not in self._by_base:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.multiply(self.data, powers(base, len(self.data)), out=sums[1:])
            sums[1:] += powers(base, len(self.data))
            self._by_base[base] = np.cumsum(sums, out=sums)
        return self._by_base[base]

    def hashes(self, ends: np.ndarray | None = None, base: int = _BYTE_BASE) -> np.ndarray:
        """A 64-bit hash of each word, or of its bytes up to `ends`; hashes of two bases are independent."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        ends = self.ends if ends is None else ends
        sums, inverse = self._sums(base), powers(pow(base, -1, 1 << 64), len(self.data))
        h = (sums[ends] - sums[self.starts]) * inverse[self.starts]
        return mix(h + (ends - self.starts).astype(np.uint64) * _ODD)


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """The hash of each run of `width` word hashes; one for each start that has a whole run."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    base = (_WORD_BASE + 2 * salt) & _MASK
    np.cumsum(words * powers(base, n), out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), n)
    return mix((sums[width:] - sums[:-width]) * inverse[: n - width + 1] + np.uint64(width))


def signed(x: np.ndarray) -> np.ndarray:
    """Spark has no unsigned 64-bit type."""
    return x.view(np.int64)
