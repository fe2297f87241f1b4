"""Words of whole texts as NumPy arrays, and 64-bit hashes of words and of runs of words.

A word is a run of bytes other than space and the control characters 9 to 13 (UTF-8 never uses those bytes
inside another character).  Hashes are Rabin-Karp polynomials modulo 2^64, so a run's hash is a difference
of two prefix sums; a final mix spreads the bits.  Texts are worked on in pieces of ``PIECE`` bytes, so the
memory follows the number of words, not some multiple of the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SLICE = 1 << 20  # bytes of text that a task works on at once
_MASK = (1 << 64) - 1
_BASE, _RUN = 0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93 | 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values; another seed gives another function."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2^64 for i < n; kept between calls."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, PIECE + 1), b, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * PIECE:  # a giant word or text: not worth keeping
            return made[0], made[1]
        known = _POWERS[base] = (made[0], made[1])
    return known


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words:
    """Words of several texts: ``start`` and ``end`` are byte offsets in ``data``, ``doc`` is the text's number;
    the words of text i are ``first[i]:first[i + 1]``.  A null text has no words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("").cast(pa.large_string())
        self.n = len(texts)
        _, offsets, data = texts.buffers()
        if self.n == 0 or data is None or offsets is None:
            self.offsets = np.zeros(self.n + 1, dtype=np.int64)
            self.data = np.zeros(0, dtype=np.uint8)
        else:
            raw = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + self.n + 1]
            self.data = np.frombuffer(data, dtype=np.uint8)[raw[0] : raw[-1]]
            self.offsets = raw - raw[0]
        if lower:
            self.data = _LOWER[self.data]
        inside = ~_SPACE[self.data]
        size = len(inside)
        edge = np.zeros(size + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(size, dtype=bool)
        after = np.zeros(size, dtype=bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:size]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        out, at, total = np.empty(len(self.start), dtype=np.uint64), 0, len(self.start)
        while at < total:
            stop = max(at + 1, int(np.searchsorted(self.end, self.start[at] + PIECE, "right")))
            low, high = self.start[at], self.end[stop - 1]
            power, inverse = powers(_BASE, high - low + 1)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data[low:high]] * power[: high - low], out=sums[1:])
            s, e = self.start[at:stop] - low, self.end[at:stop] - low
            out[at:stop] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = stop
        return out


def run_hashes(values: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of ``values[i : i + length]`` for every i at which a run of that length begins."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, step = np.empty(n, dtype=np.uint64), PIECE - length if length < PIECE // 2 else PIECE
    for at in range(0, n, step):
        stop = min(n, at + step)
        part = values[at : stop + length - 1]
        power, inverse = powers(_RUN, len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((mix(part, seed) if seed else part) * power[: len(part)], out=sums[1:])
        out[at:stop] = mix((sums[length:] - sums[:-length]) * inverse[: stop - at], seed)
    return out


def give_back() -> None:
    """Hand freed memory back to the system: workers are kept between stages, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterable[pa.RecordBatch], text: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``size`` bytes of text; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()))
        ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()
