"""Words and hashes of many texts at once, on numpy arrays over Arrow's string buffers.

A span's hash joins two polynomials modulo the prime 2**31 - 1, over random values of the bytes and two random bases, and is finished by
a mixing step. Two different spans of n bytes meet with a chance of (n / 2**31)**2 at most, whatever they hold. The sums run along the
block, so the hash of any span comes from two entries of each. Hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES, BLOCK_TEXTS = 1 << 19, 1 << 15

_PRIME, _BITS = np.uint64(2**31 - 1), np.uint64(31)
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUES = [_rng.integers(1, 2**31 - 1, 256, dtype=np.uint64) for _ in range(4)]
_BASES = [int(x) for x in _rng.integers(2**30, 2**31 - 1, 4)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * np.uint64(3) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def _reduced(x: np.ndarray, folds: int = 1) -> np.ndarray:
    """x modulo the prime, in place. One fold is enough for a product of two residues, two for a sum of up to 2**33 of them."""
    for _ in range(folds):
        high = x >> _BITS
        x &= _PRIME
        x += high
    return np.minimum(x, x - _PRIME, out=x)  # a difference below zero wraps round and is the larger


def _power_tables(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the lane's base, and of its inverse."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        size, tables = max(n, BLOCK_BYTES + 1), []
        for base in (_BASES[lane], pow(_BASES[lane], -1, int(_PRIME))):
            t = np.ones(1, np.uint64)
            while len(t) < size:
                t = np.concatenate((t, _reduced(t * np.uint64(pow(base, len(t), int(_PRIME))))))
            tables.append(t[:size].astype(np.uint32))  # residues of 31 bits; a worker keeps them
        have = tables[0], tables[1]
        if size <= 4 * BLOCK_BYTES:
            _powers[lane] = have
    return have


class Texts:
    """A block of texts: data (uint8) and offsets (int64, one more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._sums: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        """A-Z lowered, other bytes as they are."""
        return Texts(_LOWER[self.data], self.offsets)

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes that table allows, and each text's first place among them (one more at the end)."""
        w = table[self.data]
        if not len(w):
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(len(self.offsets), np.int64)
        before, after = np.empty_like(w), np.empty_like(w)
        before[0], before[1:] = False, w[:-1]
        after[-1], after[:-1] = False, w[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(w))]
        before[inner] = False
        after[inner - 1] = False
        starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def _summed(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the lane's terms, and the powers of its base's inverse."""
        n = len(self.data)
        powers, inverses = _power_tables(n + 1, lane)
        sums = self._sums.get(lane)
        if sums is None:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_reduced(_VALUES[lane][self.data] * powers[:n]), out=sums[1:])
            self._sums[lane] = sums
        return sums, inverses

    def hashes(self, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
        """64-bit hashes of the spans; second: others, independent of the first."""
        out = np.zeros(len(starts), np.uint64)
        for lane in (2, 3) if second else (0, 1):
            sums, inverses = self._summed(lane)
            out = (out << _BITS) | _reduced(_reduced(sums[ends] - sums[starts], 2) * inverses[starts])
        return mix(out)

    def windows(self, size: int) -> np.ndarray:
        """Hashes of the windows of size bytes at every place of the block (those that cross texts too); empty if it is shorter."""
        n = len(self.data) - size + 1
        out = np.zeros(max(n, 0), np.uint64)
        if n > 0:
            for lane in range(2):
                sums, inverses = self._summed(lane)
                out = (out << _BITS) | _reduced(_reduced(sums[size:] - sums[:n], 2) * inverses[:n])
        return mix(out)


def byte_table(words: str) -> np.ndarray:
    """Which bytes belong to words: 'nonspace' all but 0x20 and 0x09-0x0D; 'alnum' digits, letters and bytes over 0x7F."""
    t = np.ones(256, bool)
    if words == "nonspace":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[:] = False
        for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
            t[lo:hi] = True
    return t


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
NONSPACE, ALNUM = byte_table("nonspace"), byte_table("alnum")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive runs (first, past the last, texts) of an Arrow string or binary column, null as empty; a run has at most limit bytes or one text,
    and BLOCK_TEXTS texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n, i + BLOCK_TEXTS)
        yield i, j, Texts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
